"""Candidates from feeds, listings and pages, and the write of new articles."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import reduce
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.markup import pieces
from ..functions.session import small_batches
from ..functions.text import date_in, date_in_name, normalize_url
from ..functions.time import jst_midnight

#: Elements whose end breaks a line, and those without text of the page (fixed values of the format).
BLOCKS = frozenset("address article aside blockquote br dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
SILENT = frozenset("script style noscript template".split())


def feed(spark: SparkSession, path: str, base: str) -> DataFrame:
    """A1: (url, title, published, summary, content) of the items of RSS, RDF and Atom files; entries without a link are dropped, relative links resolved
    on the base, updated stands in for published."""
    item = "struct<title string, link string, pubDate string, date string, description string, encoded string>"
    fields = item.removeprefix("struct<").removesuffix(">")
    options = {"ignoreNamespace": "true", "attributePrefix": "_"}
    items = spark.read.format("xml").options(rowTag="item", **options).schema(fields).load(path)
    items = items.select(F.trim("link").alias("link"), "title", F.coalesce("pubDate", "date").alias("published"), F.col("description").alias("summary"), F.col("encoded").alias("content"))
    entry = "title string, link array<struct<_href string, _rel string>>, published string, updated string, summary string, content string"
    entries = spark.read.format("xml").options(rowTag="entry", **options).schema(entry).load(path)
    alternate = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    entries = entries.select(F.trim(F.get(alternate, 0)["_href"]).alias("link"), "title", F.coalesce("published", "updated").alias("published"), "summary", "content")
    both = items.unionByName(entries).filter(F.coalesce("link", F.lit("")) != "")
    site = re.match(r"https?://[^/]+", base)[0]
    url = F.when(F.col("link").rlike("^(?i)https?://"), F.col("link")).when(F.col("link").startswith("//"), F.concat(F.lit(base.split("//")[0]), "link")).when(F.col("link").startswith("/"), F.concat(F.lit(site), "link")).otherwise(F.concat(F.lit(base.rsplit("/", 1)[0] + "/"), "link"))
    stamp = F.coalesce(F.try_to_timestamp("published", F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.try_to_timestamp(F.regexp_replace("published", "^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.regexp_replace(F.regexp_replace("published", "^[A-Za-z]{3}, ", ""), "GMT$", "+0000"), F.lit("d MMM yyyy HH:mm:ss Z")))
    return both.select(url.alias("url"), "title", stamp.alias("published"), "summary", "content")


def json_listing(spark: SparkSession, path: str) -> DataFrame:
    """A2: (url, title, published, category) of a JSON array of {title, href, date, category}; without a link they are dropped, dates are JST days."""
    rows = spark.read.schema("title string, href string, date string, category string").option("multiLine", True).json(path)
    parts = F.split("date", "-")
    day = F.try_to_date(F.concat_ws("-", F.get(parts, 0), F.lpad(F.get(parts, 1), 2, "0"), F.lpad(F.get(parts, 2), 2, "0")), "yyyy-MM-dd")
    return rows.filter(F.trim(F.coalesce("href", F.lit(""))) != "").select(F.trim("href").alias("url"), "title", jst_midnight(day).alias("published"), "category")


_HREF = re.compile(r"""(?:^|\s)href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def page_links(page: str) -> list[tuple[str, str, str]]:
    """The links of a page as (href, text, text of the item that holds it), in one pass over its tags."""
    links: list[tuple[str, str, int]] = []
    items: list[list[str]] = [[]]
    href, said = None, []
    for name, end, attributes, text in pieces(page, SILENT):
        if text:
            text = html.unescape(text)
            said.append(text)
            items[-1].append(text)
        elif name == "br":
            said.append(" ")
        elif name == "a" and end and href:
            links.append((href, " ".join("".join(said).split()), len(items) - 1))
            href = None
        elif name == "a" and not end:
            found = _HREF.search(attributes)
            href, said = html.unescape("".join(found.groups(""))) if found else None, []
        elif name in ("li", "dt", "tr", "article") and not end:
            items.append([])
    whole = ["".join(item) for item in items]
    return [(to, text, whole[item]) for to, text, item in links]


def listing_links(pages: DataFrame) -> DataFrame:
    """A3: (page_id, url, title, day) of every link of listing pages (page_id, url, html): no links to the page itself, none but http(s), none without
    text; the day from the item's text, else from the URL's file name."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, base, page in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                base = base or ""
                for href, title, item in page_links(page or ""):
                    url = urljoin(base, href)
                    if title and url.startswith(("http://", "https://")) and url.split("#")[0] != base.split("#")[0]:
                        rows.append((page_id, url, title, item))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (batch.schema.field("page_id").type, pa.string(), pa.string(), pa.string())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "url", "title", "item"])

    kind = pages.schema["page_id"].dataType.simpleString()
    found = small_batches(pages.select("page_id", "url", "html")).mapInArrow(links, f"page_id {kind}, url string, title string, item string")
    return found.select("page_id", "url", "title", F.coalesce(date_in(F.col("item")), date_in_name(F.col("url"))).alias("day"))


def body_text(page: str) -> str | None:
    """The lines of a page's first article element, or of the whole page: blocks break lines, white space is one space, empty lines go; null if nothing is left."""
    out: list[str] = []
    inside = False
    for name, end, _, text in pieces(page, SILENT):
        if text:
            out.append(re.sub(r"\s+", " ", html.unescape(text)))
        elif name == "article" and end and inside:
            break
        elif name == "article" and not end and not inside:
            out, inside = [], True
        elif name in BLOCKS:
            out.append("\n")
    lines = (" ".join(line.split()) for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line) or None


def article_bodies(pages: DataFrame) -> DataFrame:
    """A4: (page_id, body) of every page (page_id, html)."""

    kind = pages.schema["page_id"].dataType.simpleString()

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("page_id"), pa.array([body_text(page.as_py() or "") for page in batch.column("html")], pa.string())], names=["page_id", "body"])

    return small_batches(pages.select("page_id", "html")).mapInArrow(bodies, f"page_id {kind}, body string")


def first_of(tables: list[DataFrame], key: str, order: list[str]) -> DataFrame:
    """A6: the union of listings, the first row of each key kept."""
    rows = reduce(DataFrame.unionByName, tables)
    turn = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_turn", turn).filter("_turn = 1").drop("_turn")


def new_articles(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """A5: candidates (position, url, ...) with normalised URLs, each URL once, without those already known and those that aren't URLs."""
    rows = candidates.withColumn("url", normalize_url(F.col("url"))).filter("url is not null")
    return first_of([rows], "url", ["position"]).join(known.select("url"), "url", "left_anti")


def save_snapshot(df: DataFrame, path: str, by: str) -> None:
    """A7: a table as Parquet, partitioned by a day or hash column; only the partitions at hand are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
