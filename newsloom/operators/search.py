"""Text search: documents, terms, trigram postings, results."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import saved, small_batches
from ..functions.text import contains_literal
from .latest import list_order, top

#: Characters of texts whose trigrams are listed at once: what a worker holds is bounded, however long a text.
SLICE = 2_000_000

#: Ids up to which they are broadcast to pick out texts.
FEW = 100_000


def documents(articles: DataFrame, contents: DataFrame, digests: DataFrame) -> DataFrame:
    """(article_id, artifact_id, origin, text): titles, contents and digests of every article."""
    none = F.lit(None).cast("bigint").alias("artifact_id")
    titles = articles.select(F.col("id").alias("article_id"), none, F.lit("title").alias("origin"), F.col("title").alias("text"))
    parts = contents.select("article_id", none, F.col("kind").alias("origin"), "text")
    made = digests.select("article_id", F.col("id").alias("artifact_id"), F.lit("digest").alias("origin"), F.concat_ws("\n", "title_x", "summary_x").alias("text"))
    return titles.unionByName(parts).unionByName(made)


def contains_term(text: Column, term: str) -> Column:
    """Terms of three characters and more fold the case of all letters, shorter ones that of ASCII only."""
    if len(term) >= 3:
        return contains_literal(text, term)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.contains(F.translate(text, upper, lower), F.lit(term.translate(str.maketrans(upper, lower))))


def matching(docs: DataFrame, terms: list[str]) -> DataFrame:
    """The articles of which every term stands in some document. One pass: a flag for each term, joined by or within an article."""
    hit = docs.groupBy("article_id").agg(*(F.max(contains_term(F.col("text"), t)).alias(f"_{k}") for k, t in enumerate(terms)))
    return hit.filter(" and ".join(f"_{k}" for k in range(len(terms))) or "true").select("article_id")


class TrigramIndex:
    """Postings (gram, doc_ids) of the distinct trigrams of the texts in lower case, as a table in a shared folder that lives on: by buckets of the grams, and by the number of the update that
    added them. A row lists the texts of one slice that hold a gram, so a gram has a row for each slice. An update adds the postings of new and changed texts; those of a text's earlier versions stay, and are masked by
    its version, the last update that touched it. Versions are written last: an update that failed before that is done over and replaces its own partitions. A search reads the buckets of its grams only."""

    def __init__(self, spark: SparkSession, place: str, buckets: int = 256):
        self.spark, self.place, self.buckets = spark, place, buckets

    def versions(self) -> DataFrame:
        """(doc_id, digest, update) of every update; no digest where the text went."""
        schema = "doc_id long, digest string, update int"
        try:
            # not "versions", which speak of postings with a row for each text: an index of these is built anew
            return self.spark.read.schema(schema).parquet(f"{self.place}/listed")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def newest(self, versions: DataFrame) -> DataFrame:
        last = versions.groupBy("doc_id").agg(F.max_by(F.struct("digest", "update"), "update").alias("v"))
        return last.select("doc_id", "v.digest", "v.update")

    def _bucket(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.buckets)).cast("int")

    def update(self, texts: DataFrame) -> int:
        """Takes up what differs in the texts (doc_id, text), all that there are now; how many texts were new, changed or gone."""
        versions = self.versions()
        number = (versions.agg(F.max("update")).first()[0] or 0) + 1
        held = self.newest(versions).filter("digest is not null").select("doc_id", F.col("digest").alias("_held"))
        now = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))
        differ = saved(now.join(held, "doc_id", "full").filter(~F.col("digest").eqNullSafe(F.col("_held"))).select("doc_id", "digest"))
        n = differ.count()
        if n or number == 1:
            fresh = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
            if number > 1:  # before that all texts are new
                fresh = _of(fresh, differ.filter("digest is not null").select("doc_id").distinct(), n)
            rows = small_batches(fresh.select("doc_id", F.lower("text").alias("text"))).mapInArrow(_lists, "gram string, doc_ids array<long>").withColumn("bucket", self._bucket(F.col("gram"))).withColumn("update", F.lit(number))
            # Spark deals large buckets over several tasks; this version of Parquet stores ids as differences
            by_bucket = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "update", "gram")
            by_bucket.write.mode("overwrite").options(**{"partitionOverwriteMode": "dynamic", "parquet.writer.version": "v2"}).partitionBy("bucket", "update").parquet(f"{self.place}/postings")
            differ.write.mode("overwrite").parquet(f"{self.place}/listed/update={number}")
        return n

    def postings(self, grams: list[str]) -> DataFrame:
        """(gram, doc_id, update) of these grams."""
        buckets = [r[0] for r in self.spark.createDataFrame([(g,) for g in grams], "gram string").select(self._bucket(F.col("gram"))).distinct().collect()]
        rows = self.spark.read.schema("gram string, doc_ids array<long>, bucket int, update int").parquet(f"{self.place}/postings")
        return rows.filter(F.col("bucket").isin(buckets) & F.col("gram").isin(grams)).select("gram", F.explode("doc_ids").alias("doc_id"), "update")

    def search(self, texts: DataFrame, *terms: str) -> DataFrame:
        """doc_id of the texts that contain any of the terms of three characters or more: those with all trigrams of a term in their present version, then checked."""
        grams = {t: sorted({low[k : k + 3] for k in range(len(low) - 2)}) for t in terms if len(low := t.lower()) > 2}
        bits = {g: (k // 62, 1 << k % 62) for k, g in enumerate(sorted({g for of in grams.values() for g in of}))}
        if not bits:
            return texts.select("doc_id").filter(F.lit(False))
        # the grams that a text has are bits of as few numbers as hold them, as terms may be long
        numbered = self.spark.createDataFrame([(g, *b) for g, b in bits.items()], "gram string, _word int, _bit long")
        words = range(max(w for w, _ in bits.values()) + 1)
        found = self.postings(list(bits)).join(F.broadcast(numbered), "gram").groupBy("doc_id", "update").agg(*(F.bit_or(F.when(F.col("_word") == w, F.col("_bit"))).alias(f"_{w}") for w in words))
        likely = {}
        for k, (term, of) in enumerate(grams.items()):
            masks = {w: sum(b for x, b in (bits[g] for g in of) if x == w) for w in words}
            likely[f"_term{k}"] = F.when(reduce(and_, (F.col(f"_{w}").bitwiseAND(F.lit(m)) == m for w, m in masks.items() if m)), F.lit(term))
        held = saved(found.select("doc_id", "update", *(c.alias(k) for k, c in likely.items())).filter(F.coalesce(*likely).isNotNull()))
        n = held.count()
        now = self.newest(_of(self.versions(), held.select("doc_id").distinct(), n)).filter("digest is not null")
        present = held.join(now.select("doc_id", "update"), ["doc_id", "update"]).select("doc_id", *likely)
        contains = lambda terms: reduce(or_, (contains_literal(F.col("text"), t) for t in terms))
        if n > FEW:
            # where the postings leave many, texts are checked where they are read: only those that pass are shuffled, without their text
            return _of(texts.filter(contains(grams)).select("doc_id"), present, n).select("doc_id")
        # the terms come from the postings' side, so that Spark checks no text before the join
        return _of(texts.select("doc_id", "text"), present, n).filter(contains(map(F.col, likely))).select("doc_id")


def _of(rows: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """The rows of these distinct ids, of which there are n at most, with what else ids hold. Few are broadcast; of more, each task hashes its own, so that long rows needn't be sorted."""
    return rows.join(F.broadcast(ids) if n <= FEW else ids.hint("shuffle_hash"), "doc_id")


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, doc_ids) of slices of texts. Texts longer than a slice are cut into parts that share two characters, so a text may be listed twice."""
    parts, held = [], 0
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            for k in range(0, len(text) - 2, SLICE):
                part = text[k : k + SLICE + 2]
                if held + len(part) > SLICE + 2:
                    yield from _listed(parts)
                    parts, held = [], 0
                parts.append((doc, part))
                held += len(part)
    if parts:
        yield from _listed(parts)


def _listed(parts: list[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
    """The trigrams of a slice in the order of their characters, each with the ids of its texts. Gram and text are one number while it fits, with the slice's own characters as digits; else the slice is halved."""
    parts = sorted(parts, key=lambda p: p[0])
    points = np.frombuffer("".join(text for _, text in parts).encode("utf-32-le"), np.uint32)
    known = np.zeros(0x110000, bool)
    known[points] = True
    letters = np.flatnonzero(known)
    base, n = len(letters), len(parts)
    if base**3 * n >= 2**63:
        yield from _listed(parts[: n // 2])
        yield from _listed(parts[n // 2 :])
        return
    digit = (np.cumsum(known) - 1)[points]
    of = np.repeat(np.arange(n), [len(text) for _, text in parts])
    key = (((digit[:-2] * base + digit[1:-1]) * base + digit[2:]) * n + of[:-2])[of[:-2] == of[2:]]
    key.sort()
    gram, text = np.divmod(key[np.diff(key, prepend=-1) > 0], n)
    first = np.flatnonzero(np.diff(gram, prepend=-1))
    own = gram[first]
    letter = letters[np.stack((own // base**2, own // base % base, own % base), axis=1)].astype("<u4").tobytes().decode("utf-32-le")
    docs = np.array([doc for doc, _ in parts], np.int64)[text]
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(docs)).astype(np.int32)), pa.array(docs))
    yield pa.record_batch([pa.array([letter[k : k + 3] for k in range(0, len(letter), 3)], pa.string()), lists], names=["gram", "doc_ids"])


def result(rows: DataFrame, hits: DataFrame, condition: Column, by: list[str], newest_first: bool = False, limit: int = 200) -> DataFrame:
    """Each user's first matching articles that meet the conditions, in list order, stories not folded."""
    return top(rows.join(hits.withColumnRenamed("article_id", "id"), "id", "left_semi").filter(condition), by, list_order(newest_first), limit)


def facets(vocabulary: DataFrame, tags: DataFrame) -> DataFrame:
    """(facet, name, uses) of the topics in use."""
    uses = tags.groupBy(F.col("topic").alias("name")).agg(F.count("*").alias("uses"))
    return vocabulary.join(uses, "name").select("facet", "name", "uses")
