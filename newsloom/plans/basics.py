"""Sources of candidates, filters, scalar functions and set operations over the tables."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import Tables
from ..functions import score, text, time
from ..functions.session import shared_folder
from ..operators import predicates, sets
from ..registry import query
from ..sources import ingest

NORMAL_SQL = """SELECT page_id, url, CASE WHEN regexp_matches(url, '^(?i)https?://[^/?#]') THEN concat(scheme, '://',
 CASE WHEN scheme = 'http' THEN regexp_replace(host, ':80$', '') ELSE regexp_replace(host, ':443$', '') END, CASE WHEN path = '' THEN '/' ELSE path END, CASE WHEN kept = '' THEN '' ELSE concat('?', kept) END) END AS normal FROM (
 SELECT page_id, url, lower(regexp_extract(u, '^(?i)(https?)://', 1)) AS scheme, lower(regexp_extract(u, '^(?i)https?://([^/?]*)', 1)) AS host, regexp_extract(u, '^(?i)https?://[^/?]*([^?]*)', 1) AS path,
 array_to_string(list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda p: NOT regexp_matches(p, '^(utm_[^=]*|fbclid|gclid)(=|$)')), '&') AS kept
 FROM (SELECT page_id, url, regexp_replace(trim(url), '#.*$', '') AS u FROM v_url_candidates) AS a) AS b"""


# --- A: ingest ------------------------------------------------------------------------------------------------------


@query("A5_ingest_new_articles", f"""WITH n AS ({NORMAL_SQL}) SELECT normal AS url, min(page_id) AS page_id FROM n WHERE normal IS NOT NULL
 AND normal NOT IN (SELECT normal FROM n WHERE page_id % 5 = 0 AND normal IS NOT NULL) GROUP BY normal""")
def ingest_new(t: Tables) -> DataFrame:
    candidates = t.v_url_candidates.withColumn("position", F.col("page_id"))
    known = candidates.filter("page_id % 5 = 0").select(text.normalize_url(F.col("url")).alias("url"))
    return ingest.new_articles(candidates, known).select("url", "page_id")


@query("A6_listing_union", """SELECT page_id, page, url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page, page_id) AS r FROM (
 SELECT page_id, 1 AS page, concat('/', CAST(page_id % 40 AS STRING)) AS url FROM pages UNION ALL SELECT page_id, 2 AS page, concat('/', CAST(page_id % 60 AS STRING)) AS url FROM pages) AS u) AS x WHERE r = 1""")
def listing_union(t: Tables) -> DataFrame:
    listings = [t.pages.select("page_id", F.lit(k).alias("page"), F.concat(F.lit("/"), (F.col("page_id") % m).cast("string")).alias("url")) for k, m in ((1, 40), (2, 60))]
    return ingest.first_of(listings, "url", ["page", "page_id"])


@query("A7_snapshot_days", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def snapshot_days(t: Tables) -> DataFrame:
    """Counts over a snapshot of the events by day: written, its later half written anew, and read back."""
    place = f"{shared_folder(t.spark)}/snapshot-{uuid.uuid4().hex}"
    kept = t.events.withColumn("day", F.to_date("ts"))
    ingest.save_snapshot(kept, place, "day")
    ingest.save_snapshot(kept.filter("day >= date'2024-01-15'"), place, "day")
    return t.spark.read.parquet(place).groupBy("day", "event_type").agg(F.count("*").alias("n"))


FEED_SITE = "https://news.example/feed/all.xml"


@query("A1_feed_items", """SELECT CASE WHEN doc_id % 3 = 0 THEN concat('https://', source, '.example/a/', CAST(doc_id AS STRING)) WHEN doc_id % 3 = 1 THEN concat('https://news.example/a/', CAST(doc_id AS STRING)) ELSE concat('https://news.example/feed/', CAST(doc_id AS STRING)) END AS url,
 concat('Text & ', CAST(doc_id AS STRING)) AS title, TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '37' MINUTE AS published, CASE WHEN doc_id % 2 = 0 THEN lang END AS summary FROM documents WHERE doc_id % 11 <> 0""")
def feed_items(t: Tables) -> DataFrame:
    """Every document as an item of RSS or Atom feeds of 500, written as files and read back; those without a link go."""
    place = f"{shared_folder(t.spark)}/feed-{uuid.uuid4().hex}"
    number = F.col("doc_id").cast("string")
    link = F.when(F.col("doc_id") % 11 == 0, "").when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://"), "source", F.lit(".example/a/"), number)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("/a/"), number)).otherwise(number)
    at = F.expr("timestamp'2024-01-01 00:00:00' + doc_id * interval '37' minute")
    title, summary = F.concat(F.lit("<title>Text &amp; "), number, F.lit("</title>")), lambda name: F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(f"<{name}>"), "lang", F.lit(f"</{name}>"))).otherwise("")
    item = F.concat(F.lit("<item>"), title, F.lit("<link>"), link, F.lit("</link><pubDate>"), F.date_format(at, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate>"), summary("description"), F.lit("</item>"))
    entry = F.concat(F.lit("<entry>"), title, F.lit('<link rel="self" href="https://x.example/self"/><link rel="alternate" href="'), link, F.lit('"/><updated>'), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z</updated>"), summary("summary"), F.lit("</entry>"))
    one = F.when(F.length("text") % 2 == 0, item).otherwise(entry)
    feeds = t.documents.groupBy(F.floor(F.col("doc_id") / 500).alias("page")).agg(F.concat(F.lit("<feed>"), F.array_join(F.collect_list(one), "\n"), F.lit("</feed>")).alias("value"))
    feeds.write.partitionBy("page").text(place)
    return ingest.feed(t.spark, place, FEED_SITE).select("url", "title", "published", "summary")


@query("A2_json_listing", "SELECT concat('/d/', CAST(doc_id AS STRING)) AS url, concat('Text ', CAST(doc_id AS STRING)) AS title, TIMESTAMP '2024-01-01 00:00:00' + (doc_id % 300) * INTERVAL '1' DAY - INTERVAL '9' HOUR AS published, lang AS category FROM documents WHERE doc_id % 11 <> 0")
def json_listing(t: Tables) -> DataFrame:
    """Every document in JSON listings of 500 entries, written as files and read back; those without a link go."""
    place = f"{shared_folder(t.spark)}/listing-{uuid.uuid4().hex}"
    number, day = F.col("doc_id").cast("string"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int"))
    entry = F.struct(F.concat(F.lit("Text "), number).alias("title"), F.when(F.col("doc_id") % 11 != 0, F.concat(F.lit("/d/"), number)).alias("href"), F.concat_ws("-", F.year(day), F.month(day), F.dayofmonth(day)).alias("date"), F.col("lang").alias("category"))
    pages = t.documents.groupBy(F.floor(F.col("doc_id") / 500).alias("page")).agg(F.to_json(F.collect_list(entry)).alias("value"))
    pages.write.partitionBy("page").text(place)
    return ingest.json_listing(t.spark, place).select("url", "title", "published", "category")


@query("A3_listing_links")
def listing_links(t: Tables) -> DataFrame:
    return ingest.listing_links(t.pages)


@query("A4_article_body")
def article_body(t: Tables) -> DataFrame:
    return ingest.article_bodies(t.pages)


# --- B: filters ------------------------------------------------------------------------------------------------------


@query("B1_effective_time", "SELECT id, coalesce(published_at, fetched_at) AS at FROM v_articles WHERE coalesce(published_at, fetched_at) >= TIMESTAMP '2024-01-05 00:00:00'")
def effective_time(t: Tables) -> DataFrame:
    return predicates.backlog(t.v_articles, datetime(2024, 1, 5)).select("id", "at")


@query("B2_source_filter", """SELECT id, source_id FROM v_articles WHERE NOT contains(title, 'idiot') AND
 (source_id NOT IN ('src1', 'src2') OR (source_id = 'src1' AND contains(title, 'the ')) OR (source_id = 'src2' AND (contains(title, 'tion') OR contains(url, '7'))))""")
def source_filter(t: Tables) -> DataFrame:
    rules = "source_id string, keywords array<string>, url_contains array<string>, title_excludes array<string>"
    named = t.spark.createDataFrame([("src1", ["the "], [], ["idiot"]), ("src2", ["tion"], ["7"], ["idiot"])], rules)
    others = t.v_articles.select("source_id").distinct().join(named, "source_id", "left_anti").select("source_id", F.array().cast("array<string>").alias("keywords"), F.array().cast("array<string>").alias("url_contains"), F.array(F.lit("idiot")).alias("title_excludes"))
    return predicates.relevant(t.v_articles.withColumn("summary", F.lit(None).cast("string")), named.unionByName(others)).select("id", "source_id")


REQUIRED = "SELECT d.id AS artifact_id, c.access_membership_id AS membership_id FROM v_digests d JOIN v_contents c ON c.article_id = d.article_id WHERE c.access_membership_id IS NOT NULL"


def required(t: Tables) -> DataFrame:
    contents = t.v_contents.filter("access_membership_id is not null").select("article_id", F.col("access_membership_id").alias("membership_id"))
    return t.v_digests.select(F.col("id").alias("artifact_id"), "article_id").join(contents, "article_id").drop("article_id")


@query("B3_viewable", f"SELECT user_id, artifact_id, version FROM v_scores s WHERE NOT EXISTS (SELECT 1 FROM ({REQUIRED}) r WHERE r.artifact_id = s.artifact_id AND NOT EXISTS (SELECT 1 FROM v_user_memberships m WHERE m.user_id = s.user_id AND m.membership_id = r.membership_id))")
def viewable(t: Tables) -> DataFrame:
    return predicates.viewable(t.v_scores.select("user_id", "artifact_id", "version"), required(t), t.v_user_memberships)


@query("B4_artifact_scope", f"SELECT d.id AS artifact_id, coalesce(max(CASE WHEN r.membership_id IS NOT NULL THEN concat('m', CAST(r.membership_id AS STRING)) END), 'public') AS scope FROM v_digests d LEFT JOIN ({REQUIRED}) r ON r.artifact_id = d.id GROUP BY d.id")
def artifact_scope(t: Tables) -> DataFrame:
    codes = required(t).withColumn("code", F.concat(F.lit("m"), F.col("membership_id").cast("string")))
    return predicates.scope(t.v_digests.select(F.col("id").alias("artifact_id")), codes).select("artifact_id", "scope")


@query("B5_locked_by", "SELECT DISTINCT i.user_id, i.article_id, 'member 1' AS locks FROM v_interactions i JOIN v_contents c ON c.article_id = i.article_id WHERE c.access_membership_id = 1 AND i.user_id NOT IN (SELECT user_id FROM v_user_memberships)")
def locked_by(t: Tables) -> DataFrame:
    need = t.v_contents.filter("access_membership_id is not null").select("article_id", F.col("access_membership_id").alias("membership_id"), F.concat(F.lit("member "), F.col("access_membership_id").cast("string")).alias("name"))
    pairs = t.v_interactions.select("user_id", "article_id").distinct()
    return predicates.locked_by(pairs, need, t.v_user_memberships).withColumn("locks", F.concat_ws(", ", "locks"))


@query("B6_default_visibility", "SELECT s.user_id, s.article_id, s.score FROM v_scores s JOIN v_digests d ON d.id = s.artifact_id WHERE s.version = 1 AND d.relevant AND s.score >= 50")
def default_visibility(t: Tables) -> DataFrame:
    rows = t.v_scores.filter("version = 1").join(t.v_digests.select(F.col("id").alias("artifact_id"), "relevant"), "artifact_id")
    return rows.filter(predicates.visible(50)).select("user_id", "article_id", "score")


@query("B7_rating_filter", "SELECT s.user_id, s.article_id, r.stars, r.stars IS NULL OR r.stars > 2 AS hide_low, coalesce(r.stars >= 4, false) AS at_least_4, r.stars IS NULL AS unrated FROM v_scores s LEFT JOIN (SELECT user_id, article_id, max(stars) AS stars FROM v_interactions GROUP BY 1, 2) r ON r.user_id = s.user_id AND r.article_id = s.article_id WHERE s.version = 1")
def rating_filter(t: Tables) -> DataFrame:
    stars = t.v_interactions.groupBy("user_id", "article_id").agg(F.max("stars").alias("stars"))
    rows = t.v_scores.filter("version = 1").select("user_id", "article_id").join(stars, ["user_id", "article_id"], "left")
    return rows.select("user_id", "article_id", "stars", predicates.rated("hide_low").alias("hide_low"), predicates.rated("at_least", 4).alias("at_least_4"), predicates.rated("unrated").alias("unrated"))


@query("B8_mark_filters", """WITH r AS (SELECT user_id, article_id, min(ts) AS read_at FROM v_interactions WHERE event_type = 'view' GROUP BY 1, 2),
 s AS (SELECT r.user_id, t.story_id, min(r.read_at) AS story_read FROM r JOIN v_stories t ON t.article_id = r.article_id GROUP BY 1, 2)
 SELECT v.user_id, v.article_id, coalesce(r.read_at, s.story_read) IS NULL AS unread FROM v_scores v JOIN v_stories t ON t.article_id = v.article_id LEFT JOIN r ON r.user_id = v.user_id AND r.article_id = v.article_id LEFT JOIN s ON s.user_id = v.user_id AND s.story_id = t.story_id WHERE v.version = 1""")
def mark_filters(t: Tables) -> DataFrame:
    read = t.v_interactions.filter("event_type = 'view'").groupBy("user_id", "article_id").agg(F.min("ts").alias("read_at"))
    story = read.join(t.v_stories, "article_id").groupBy("user_id", "story_id").agg(F.min("read_at").alias("story_read_at"))
    rows = t.v_scores.filter("version = 1").select("user_id", "article_id").join(t.v_stories, "article_id").join(read, ["user_id", "article_id"], "left").join(story, ["user_id", "story_id"], "left")
    return rows.select("user_id", "article_id", predicates.marked("read_at", False, "story_read_at").alias("unread"))


@query("B9_search_conditions", """SELECT s.user_id, a.id FROM v_articles a JOIN v_scores s ON s.article_id = a.id AND s.version = 1
 WHERE a.lang = 'en' AND a.source_id IN ('src1', 'src2', 'src3') AND coalesce(a.published_at, a.fetched_at) >= TIMESTAMP '2024-01-02 00:00:00' AND coalesce(a.published_at, a.fetched_at) < TIMESTAMP '2024-03-01 00:00:00' AND s.score >= 30
 AND EXISTS (SELECT 1 FROM v_digest_topics d WHERE d.artifact_id = s.artifact_id AND d.topic IN ('t1', 't3', 't5', 't7')) AND NOT EXISTS (SELECT 1 FROM v_digest_topics d WHERE d.artifact_id = s.artifact_id AND d.topic = 't9')""")
def search_conditions(t: Tables) -> DataFrame:
    topics = t.v_digest_topics.groupBy("artifact_id").agg(F.collect_set("topic").alias("topics"))
    rows = t.v_articles.withColumn("at", time.effective(F.col("published_at"), F.col("fetched_at"))).join(t.v_scores.filter("version = 1").withColumnRenamed("article_id", "id"), "id").join(topics, "artifact_id")
    rows = rows.withColumn("stars", F.lit(None).cast("int"))
    wanted = predicates.Conditions(sources=["src1", "src2", "src3"], lang="en", since=datetime(2024, 1, 2), until=datetime(2024, 3, 1), min_score=30)
    any_topic = F.arrays_overlap("topics", F.array(*map(F.lit, ("t1", "t3", "t5", "t7"))))
    return rows.filter(wanted.column() & any_topic & ~F.array_contains("topics", "t9")).select("user_id", "id")


@query("B10_crawl_rules", r"""WITH u AS (SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS origin, regexp_extract(url, '^https?://[^/]+([^#]*)', 1) AS path FROM pages)
 SELECT page_id, path, NOT regexp_matches(path, '^/.*/5.*html$') AND (path LIKE '/en/7%' OR path NOT LIKE '/en/%') AS allowed FROM u""")
def crawl_rules(t: Tables) -> DataFrame:
    urls = t.pages.select("page_id", F.regexp_extract("url", "^(https?://[^/]+)", 1).alias("origin"), F.regexp_extract("url", "^https?://[^/]+([^#]*)", 1).alias("path"))
    rules = t.spark.createDataFrame([("*", "/en/", False), ("*", "/en/7", True), ("*", "/*/5*html$", False), ("other", "/", False)], "agent string, pattern string, allow boolean")
    rows = urls.select("origin").distinct().crossJoin(F.broadcast(rules))  # four rules for each origin
    return predicates.crawlable(urls, rows, "newsloom").select("page_id", "path", "allowed")


@query("B11_visit_split", "SELECT id, CASE WHEN fetched_at > TIMESTAMP '2024-01-10 00:00:00' THEN 'new' ELSE 'earlier' END AS section FROM v_articles")
def visit_split(t: Tables) -> DataFrame:
    return t.v_articles.select("id", predicates.visit_split(F.col("fetched_at"), F.lit(datetime(2024, 1, 10))).alias("section"))


@query("B12_record_validation", """WITH q AS (SELECT DISTINCT doc_id AS id FROM documents WHERE lang <> 'de'), r AS (SELECT turn + conv_id * 100 AS position, conv_id AS id, 1 + length(text) % 7 AS k, length(text) % 5 = 0 AS odd FROM conversations),
 seen AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY position) AS turn, id NOT IN (SELECT id FROM q) AS other FROM r)
 SELECT id, concat_ws('; ', CASE WHEN other THEN 'not required' END, CASE WHEN turn > 1 THEN 'repeated' END, CASE WHEN k > 5 THEN 'number of topics' END, CASE WHEN odd THEN 'unknown topic' END) AS reasons FROM seen WHERE other OR turn > 1 OR k > 5 OR odd
 UNION ALL SELECT id, 'missing' AS reasons FROM q WHERE id NOT IN (SELECT id FROM r)""")
def record_validation(t: Tables) -> DataFrame:
    """Records are asked for of all documents that aren't German; the turns of a conversation stand for records of the document of its number."""
    topics = F.transform(F.sequence(F.lit(1), (1 + F.length("text") % 7).cast("int")), lambda k: F.concat(F.lit("t"), k.cast("string")))
    odd = F.length("text") % 5 == 0
    records = t.conversations.select((F.col("turn") + F.col("conv_id") * 100).alias("position"), F.col("conv_id").alias("id"), F.when(odd, F.transform(topics, lambda x: F.concat(x, F.lit("?")))).otherwise(topics).alias("topics"), F.array().cast("array<string>").alias("new_topics"))
    asked = t.documents.filter("lang <> 'de'").select(F.col("doc_id").alias("id")).distinct()
    return predicates.rejected_records(records, asked, t.v_topics).withColumn("reasons", F.concat_ws("; ", "reasons"))


@query("B13_profile_validation", "SELECT user_id, concat_ws('; ', CASE WHEN user_id % 5 = 0 THEN 'repeated topic' END, CASE WHEN user_id % 3 = 0 THEN 'weight' END, CASE WHEN user_id % 7 = 0 THEN 'no positive weight' END) AS reasons FROM (SELECT DISTINCT user_id FROM events) AS u WHERE user_id % 3 = 0 OR user_id % 5 = 0 OR user_id % 7 = 0")
def profile_validation(t: Tables) -> DataFrame:
    u = F.col("user_id")
    interest = lambda topic, weight: F.struct(topic.alias("topic"), weight.cast("double").alias("weight"))
    second = F.when(u % 5 == 0, "a").otherwise("b")
    profiles = t.events.select("user_id").distinct().select("user_id", F.array(interest(F.lit("a"), F.when(u % 7 == 0, 0).otherwise(1)), interest(second, F.when(u % 3 == 0, -1).otherwise(0))).alias("interests"), F.array().cast("array<string>").alias("excludes"))
    return predicates.profile_faults(profiles).withColumn("reasons", F.concat_ws("; ", "reasons"))


@query("B14_merge_proposals", """WITH p AS (SELECT item_id AS position, concat('t', CAST(item_id % 18 AS STRING)) AS source, concat('t', CAST((item_id * 3 + 2) % 17 AS STRING)) AS target FROM benchmark),
 k AS (SELECT p.*, row_number() OVER (PARTITION BY p.source ORDER BY position) AS turn FROM p JOIN v_topics a ON a.name = p.source JOIN v_topics b ON b.name = p.target WHERE p.source <> p.target AND a.facet = b.facet AND p.source <> 't4'),
 f AS (SELECT * FROM k WHERE turn = 1) SELECT position, source, target FROM f WHERE target NOT IN (SELECT source FROM f)""")
def merge_proposals(t: Tables) -> DataFrame:
    topic = lambda c: F.concat(F.lit("t"), c.cast("string"))
    proposals = t.benchmark.select(F.col("item_id").alias("position"), topic(F.col("item_id") % 18).alias("source"), topic((F.col("item_id") * 3 + 2) % 17).alias("target"))
    return predicates.valid_merges(proposals, t.v_topics, ["t4"])


# --- G: sets ---------------------------------------------------------------------------------------------------------


@query("G1_union_distinct", "SELECT source_id AS id FROM v_articles UNION SELECT source_id FROM v_fetch_runs")
def union_distinct(t: Tables) -> DataFrame:
    return sets.all_ids(t.v_articles.select(F.col("source_id").alias("id")), t.v_fetch_runs.select(F.col("source_id").alias("id")))


@query("G2_union_all", "SELECT name, name AS topic FROM v_topics UNION ALL SELECT alias AS name, name AS topic FROM v_topic_aliases")
def union_all(t: Tables) -> DataFrame:
    return sets.names(t.v_topics, t.v_topic_aliases)


@query("G3_set_difference", "SELECT user_id, article_id FROM v_scores WHERE version = 1 EXCEPT SELECT user_id, article_id FROM v_scores WHERE version = 2")
def set_difference(t: Tables) -> DataFrame:
    of = lambda version: t.v_scores.filter(F.col("version") == version).select("user_id", "article_id")
    return sets.without(of(1), of(2), ["user_id", "article_id"])


@query("G4_profile_diff", """WITH a AS (SELECT * FROM v_profile_terms WHERE pos < 3), b AS (SELECT user_id, pos, kind, CASE WHEN pos = 1 THEN weight / 2 ELSE weight END AS weight, vec_id FROM v_profile_terms WHERE pos > 0)
 SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.vec_id, b.vec_id) AS topic, CASE WHEN a.user_id IS NULL THEN CASE WHEN b.kind = 'exclude' THEN 'exclude+' ELSE 'added' END WHEN b.user_id IS NULL THEN CASE WHEN a.kind = 'exclude' THEN 'exclude-' ELSE 'removed' END ELSE 'weight' END AS change
 FROM a FULL JOIN b ON a.user_id = b.user_id AND a.vec_id = b.vec_id AND a.kind = b.kind WHERE a.user_id IS NULL OR b.user_id IS NULL OR a.weight <> b.weight""")
def profile_diff(t: Tables) -> DataFrame:
    terms = t.v_profile_terms.select("user_id", "pos", "kind", "weight", F.col("vec_id").alias("topic"), F.lit(None).cast("string").alias("note"))
    after = terms.filter("pos > 0").withColumn("weight", F.when(F.col("pos") == 1, F.col("weight") / 2).otherwise(F.col("weight")))
    return sets.profile_diff(terms.filter("pos < 3"), after)


# --- H: functions ----------------------------------------------------------------------------------------------------


@query("H1_url_normalisation", NORMAL_SQL)
def url_normalisation(t: Tables) -> DataFrame:
    return t.v_url_candidates.select("page_id", "url", text.normalize_url(F.col("url")).alias("normal"))


@query("H2_text_normalisation", "SELECT doc_id, lower(regexp_replace(text, '[^\\p{L}\\p{M}\\p{N}]', '', 'g')) AS plain FROM documents")
def text_normalisation(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.comparable(F.col("text")).alias("plain"))


@query("H3_bigrams", "SELECT doc_id, CAST(greatest(length(text) - 1, 0) AS INT) AS n, substring(text, 1, 2) AS first FROM documents")
def bigrams(t: Tables) -> DataFrame:
    pairs = text.bigrams(F.col("text"))
    return t.documents.select("doc_id", F.size(pairs).alias("n"), F.get(pairs, 0).alias("first"))


@query("H4_one_line", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS line FROM documents")
def one_line(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.one_line(F.col("text")).alias("line"))


@query("H5_terms", "SELECT item_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS INT) AS n FROM benchmark")
def terms(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.size(text.terms(F.col("text"))).alias("n"))


@query("H6_mentions", """SELECT item_id, regexp_matches(trim(regexp_replace(text, '\\s+', ' ', 'g')), '(?i)(^|[^A-Za-z0-9])the(es|s)?($|[^A-Za-z0-9])') AS hit FROM benchmark""")
def mentions(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", text.mentions(F.col("text"), F.lit("the")).alias("hit"))


@query("H7_periods", """WITH p AS (SELECT DISTINCT strftime(published_at, '%Y-%m') AS text, date_trunc('month', published_at) AS m FROM v_articles WHERE published_at IS NOT NULL)
 SELECT text, m - INTERVAL '9' HOUR AS since, m + INTERVAL '1' MONTH - INTERVAL '9' HOUR AS until FROM p""")
def periods(t: Tables) -> DataFrame:
    months = t.v_articles.filter("published_at is not null").select(F.date_format("published_at", "yyyy-MM").alias("text")).distinct()
    since, until = time.period(F.col("text"))
    return months.select("text", since.alias("since"), until.alias("until"))


@query("H8_local_time", "SELECT id, strftime(fetched_at + INTERVAL '9' HOUR, '%Y-%m-%d %H:%M') AS local, CAST(fetched_at + INTERVAL '9' HOUR AS DATE) AS day FROM v_articles")
def local_time(t: Tables) -> DataFrame:
    return t.v_articles.select("id", time.jst_text(F.col("fetched_at")).alias("local"), time.jst_day(F.col("fetched_at")).alias("day"))


@query("H9_dates_in_text", "SELECT event_id, CAST(ts AS DATE) AS day, CAST(ts AS DATE) AS named FROM events")
def dates_in_text(t: Tables) -> DataFrame:
    said = F.concat(F.lit("on "), F.date_format("ts", "yyyy/M/d"), F.lit(" it was"))
    name = F.concat(F.lit("https://a.example/x/n"), F.date_format("ts", "yyyyMMdd"), F.lit(".html?p=1"))
    return t.events.select("event_id", text.date_in(said).alias("day"), text.date_in_name(name).alias("named"))


@query("H10_literal_search", "SELECT doc_id FROM documents WHERE contains(lower(text), '%%%')")
def literal_search(t: Tables) -> DataFrame:
    return t.documents.filter(text.contains_literal(F.col("text"), "%%%")).select("doc_id")


@query("H11_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("H12_profile_hash", """SELECT user_id, sha256(concat('[', string_agg(concat('{"pos":', CAST(pos AS STRING), ',"kind":"', kind, '","weight":', CAST(weight AS STRING), ',"vec_id":', CAST(vec_id AS STRING), '}'), ',' ORDER BY pos), ']')) AS hash FROM v_profile_terms GROUP BY user_id""")
def profile_hash(t: Tables) -> DataFrame:
    terms = t.v_profile_terms.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("pos", "kind", "weight", "vec_id"))).alias("terms"))
    return terms.select("user_id", F.sha2(F.to_json("terms"), 256).alias("hash"))


@query("H13_recommend_score", """SELECT user_id, artifact_id, version, CAST(round(100 / (1 + exp(-(ln(p / (1 - p)) + w)))) AS INT) AS score FROM (
 SELECT user_id, artifact_id, version, least(greatest(score / 100, 0.005), 0.995) AS p, (article_id % 7 - 3) / 4 AS w FROM v_scores) AS x""")
def recommend_score(t: Tables) -> DataFrame:
    return t.v_scores.select("user_id", "artifact_id", "version", score.recommend_score(F.col("score"), (F.col("article_id") % 7 - 3) / 4).alias("score"))


@query("H14_dot_and_unit", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 9) AS square, 1.0::DOUBLE AS length FROM embeddings")
def dot_and_unit(t: Tables) -> DataFrame:
    v = F.col("embedding")
    return t.embeddings.select("vec_id", F.round(score.dot(v, v), 9).alias("square"), F.round(score.dot(score.unit(v), score.unit(v)), 9).alias("length"))


@query("H16_backoff", "SELECT event_id, CAST(least(power(2, greatest(least(user_id % 12 - 1, 16), 0)), 168) AS INT) AS hours FROM events")
def backoff(t: Tables) -> DataFrame:
    return t.events.select("event_id", time.backoff_hours((F.col("user_id") % 12).cast("int")).alias("hours"))


@query("H17_truncate", "SELECT doc_id, substring(text, 1, 6000) AS start FROM documents")
def truncate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.substring("text", 1, 6000).alias("start"))


@query("H18_host_groups", "SELECT concat(lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)), CASE WHEN starts_with(url, 'https') THEN ':443' ELSE ':80' END) AS host, count(*) AS n FROM pages GROUP BY 1")
def host_groups(t: Tables) -> DataFrame:
    return t.pages.groupBy(text.host_key(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query("H19_embedding_text", "SELECT id, concat_ws(chr(10), title_x, summary_x) AS text FROM v_digests")
def embedding_text(t: Tables) -> DataFrame:
    return t.v_digests.select("id", F.concat_ws("\n", "title_x", "summary_x").alias("text"))


@query("H20_bands_and_targets", "SELECT user_id, artifact_id, version, CAST(floor(least(score, 99) / 10) * 10 AS INT) AS band, (score % 5) / 4 AS target FROM v_scores")
def bands_and_targets(t: Tables) -> DataFrame:
    return t.v_scores.select("user_id", "artifact_id", "version", score.band(F.col("score")).alias("band"), score.target(F.col("score") % 5 + 1).alias("target"))


@query("H21_slots_and_pace", """SELECT id, backend, CASE WHEN hour("at") < 8 THEN 1 ELSE 4 END AS slots, round(least((dayofweek("at")) / 7 + 1 / 7, 1.0), 9) AS pace FROM v_calls""")
def slots_and_pace(t: Tables) -> DataFrame:
    slots = t.spark.createDataFrame([(0, 8, 1), (8, 24, 4)], "first int, until int, slots int")
    calls = t.v_calls.withColumn("hour", F.hour("at"))
    joined = calls.join(F.broadcast(slots), (F.col("hour") >= F.col("first")) & (F.col("hour") < F.col("until")))
    return joined.select("id", "backend", "slots", F.round(score.pace((F.dayofweek("at") - 1) / 7), 9).alias("pace"))
