"""State folded from the tables' logs, in batch; the streams of newsloom.streaming give the same."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import Tables
from ..functions.session import shared_folder
from ..operators import joins, state
from ..registry import query
from ..streaming import jobs, keyed
from .basics import NORMAL_SQL
from .joins import mention_sql

NOW = datetime(2024, 1, 15)
NOW_SQL = "TIMESTAMP '2024-01-15 00:00:00'"
ERRORS = "SELECT user_id AS article_id, event_id % 7 AS attempts, ts + INTERVAL '20' DAY AS next_retry_at FROM events WHERE event_type = 'error' AND event_id % 3 = 0"
CLAIMS = "SELECT user_id AS article_id, ts AS until FROM events WHERE event_type = 'click' AND event_id % 11 = 0"


def errors(t: Tables) -> DataFrame:
    return t.events.filter("event_type = 'error' and event_id % 3 = 0").select(F.col("user_id").alias("article_id"), (F.col("event_id") % 7).alias("attempts"), (F.col("ts") + F.expr("interval 20 days")).alias("next_retry_at"))


def claims(t: Tables) -> DataFrame:
    return t.events.filter("event_type = 'click' and event_id % 11 = 0").select(F.col("user_id").alias("article_id"), F.col("ts").alias("until"))


BUSY = f"SELECT article_id FROM ({ERRORS}) e WHERE attempts >= 5 OR next_retry_at > {NOW_SQL} UNION SELECT article_id FROM ({CLAIMS}) c WHERE until > {NOW_SQL}"


@query("M1_stream_deduplicated_urls", f"WITH n AS ({NORMAL_SQL}) SELECT DISTINCT normal AS url FROM n WHERE normal IS NOT NULL")
def stream_urls(t: Tables) -> DataFrame:
    candidates = t.spark.readStream.schema(t.pages.schema).parquet(t.sf_dir + "/pages.parque[t]")
    seen = candidates.select("url", F.timestamp_seconds(F.col("page_id") * 60 + 1_704_067_200).alias("seen_at"))
    return jobs.kept_once(jobs.new_urls(seen), "url").select("url")


@query("M2_pending_work", f"SELECT id AS article_id FROM v_articles WHERE id NOT IN (SELECT article_id FROM v_digests WHERE model = 'm2') AND id IN (SELECT article_id FROM v_contents WHERE kind = 'body') AND id IN (SELECT article_id FROM v_digests WHERE model = 'm1') AND id NOT IN ({BUSY})")
def pending_work(t: Tables) -> DataFrame:
    rows = t.v_articles.select(F.col("id").alias("article_id"))
    return state.pending(rows, t.v_digests.filter("model = 'm2'"), [t.v_contents.filter("kind = 'body'"), t.v_digests.filter("model = 'm1'")], errors(t), claims(t), F.lit(NOW))


@query("M3_available", f"SELECT id AS article_id FROM v_articles WHERE id NOT IN ({BUSY})")
def available(t: Tables) -> DataFrame:
    return state.available(t.v_articles.select(F.col("id").alias("article_id")), errors(t), claims(t), F.lit(NOW))


RETRY_STATE = """WITH c AS (SELECT item_id, max(struct_pack(a := "at", e := event_id)) AS m FROM v_outcomes WHERE NOT failed GROUP BY item_id),
 f AS (SELECT o.* FROM v_outcomes o LEFT JOIN c ON c.item_id = o.item_id WHERE o.failed AND (c.m IS NULL OR struct_pack(a := o."at", e := o.event_id) > c.m)),
 g AS (SELECT item_id, CASE WHEN bool_or(permanent) THEN 5 ELSE least(count(*), 5) END AS attempts, max("at") AS last FROM f GROUP BY item_id)
 SELECT item_id, CAST(attempts AS INT) AS attempts, CASE WHEN attempts < 5 THEN last + CAST(power(2, attempts - 1) AS BIGINT) * INTERVAL '1' HOUR END AS next_retry_at FROM g"""


@query("M4_retry_state", RETRY_STATE)
def retry_state(t: Tables) -> DataFrame:
    return state.retries(t.v_outcomes)


ACTIONS = "SELECT user_id, article_id, event_id, ts, CASE event_type WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'bookmark' WHEN 'click' THEN 'rate' WHEN 'error' THEN 'unread' ELSE 'unbookmark' END AS action, stars - 1 AS stars FROM v_interactions"


def actions(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    action = F.when(kind == "view", "read").when(kind == "purchase", "bookmark").when(kind == "click", "rate").when(kind == "error", "unread").otherwise("unbookmark")
    return t.v_interactions.select("user_id", "article_id", "event_id", "ts", action.alias("action"), (F.col("stars") - 1).alias("stars"))


USER_MARKS = f"""WITH l AS (SELECT x.*, coalesce(t.story_id, x.article_id) AS story FROM ({ACTIONS}) x LEFT JOIN v_stories t ON t.article_id = x.article_id), u AS (SELECT *, max(CASE WHEN action = 'unread' THEN struct_pack(a := ts, e := event_id) END) OVER (PARTITION BY user_id, story) AS ur, max(CASE WHEN action = 'unbookmark' THEN struct_pack(a := ts, e := event_id) END) OVER w AS ub, max(CASE WHEN action = 'rate' THEN struct_pack(a := ts, e := event_id) END) OVER w AS lr FROM l WINDOW w AS (PARTITION BY user_id, article_id))
 SELECT user_id, article_id, nullif(max(CASE WHEN action = 'rate' AND struct_pack(a := ts, e := event_id) = lr THEN stars END), 0) AS stars, min(CASE WHEN action = 'read' AND (ur IS NULL OR struct_pack(a := ts, e := event_id) > ur) THEN ts END) AS read_at,
 min(CASE WHEN action = 'bookmark' AND (ub IS NULL OR struct_pack(a := ts, e := event_id) > ub) THEN ts END) AS bookmarked_at FROM u GROUP BY user_id, article_id"""


@query("M5_user_marks", USER_MARKS)
def user_marks(t: Tables) -> DataFrame:
    return state.marks(actions(t), t.v_stories)


@query("M6_stream_visits", "WITH d AS (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'view'), l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM d), v AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts - p > INTERVAL '30' MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM l) SELECT user_id, min(ts) AS first_view, max(ts) AS last_view FROM v GROUP BY user_id, k")
def stream_visits(t: Tables) -> DataFrame:
    views = events_stream(t, t.spark).filter("event_type = 'view'")
    end = t.events.agg(F.max("ts")).first()[0] + timedelta(days=3)
    return jobs.collected(jobs.visits(jobs.flushed(views, F.lit(end)))).filter("user_id is not null").drop("batch")


def events_stream(t: Tables, spark: SparkSession) -> DataFrame:
    return spark.readStream.schema(t.events.schema).parquet(t.sf_dir + "/events.parque[t]")


@query("M4_stream_retries", RETRY_STATE)
def stream_retries(t: Tables) -> DataFrame:
    """The keyed state of a stream of outcomes, at its end; cleared items have none."""
    events = events_stream(t, keyed.stateful_session(t.spark))
    outcomes = events.select(F.col("user_id").alias("item_id"), "event_id", F.col("ts").alias("at"), (F.col("event_type") == "error").alias("failed"), (F.col("value") > 480).alias("permanent"))
    return stream_state(t, keyed.retries(outcomes, "60 days"), ["item_id"]).filter("attempts > 0").select("item_id", "attempts", "next_retry_at")


@query("M5_stream_marks", USER_MARKS)
def stream_marks(t: Tables) -> DataFrame:
    """The keyed state of a stream of marks, at its end."""
    spark = keyed.stateful_session(t.spark)
    return stream_state(t, keyed.marks(stream_actions(events_stream(t, spark)), Tables(spark, t.sf_dir).v_stories, "60 days"), ["user_id", "article_id"])


def stream_state(t: Tables, stream: DataFrame, keys: list[str]) -> DataFrame:
    place = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    jobs.run(stream, f"{place}/checkpoint", keyed.changes(f"{place}/out"), "update")
    return keyed.current(t.spark, f"{place}/out", keys)


def stream_actions(events: DataFrame) -> DataFrame:
    """What v_interactions makes of events, as marks."""
    kind = F.col("event_type")
    action = F.when(kind == "view", "read").when(kind == "purchase", "bookmark").when(kind == "click", "rate").when(kind == "error", "unread").otherwise("unbookmark")
    stars = F.floor(F.least(F.col("value"), F.lit(499.0)) / 100).cast("int")
    return events.select("user_id", F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("article_id"), "event_id", "ts", action.alias("action"), stars.alias("stars"))


@query("M7_cascade", "SELECT id, article_id FROM v_digests WHERE article_id IN (SELECT id FROM v_articles WHERE lang <> 'de')")
def cascade(t: Tables) -> DataFrame:
    return state.cascade(t.v_digests, t.v_articles.filter("lang <> 'de'"), "article_id").select("id", "article_id")


@query("M8_versioned_append", "SELECT article_id, kind, backend, model, prompt_version, input_scope, glossary_at FROM (SELECT article_id, 'digest' AS kind, CASE WHEN article_id % 2 = 0 THEN 'a' ELSE 'b' END AS backend, model, CAST(article_id % 3 AS INT) AS prompt_version, CASE WHEN article_id % 11 = 0 THEN 'm1' ELSE 'public' END AS input_scope, CASE WHEN article_id % 4 = 0 THEN created_at END AS glossary_at FROM v_digests) AS x WHERE NOT (model = 'm1' AND article_id % 5 = 0)")
def versioned_append(t: Tables) -> DataFrame:
    """An artifact's identity is its article, kind, backend, model, prompt version, input scope and glossary time, null being a value. Each fresh row comes twice, and what is stored isn't appended."""
    a, key = F.col("article_id"), ["article_id", "kind", "backend", "model", "prompt_version", "input_scope", "glossary_at"]
    rows = t.v_digests.select("article_id", F.lit("digest").alias("kind"), F.when(a % 2 == 0, "a").otherwise("b").alias("backend"), "model", (a % 3).cast("int").alias("prompt_version"), F.when(a % 11 == 0, "m1").otherwise("public").alias("input_scope"), F.when(a % 4 == 0, F.col("created_at")).alias("glossary_at"))
    return state.appended(rows.filter("model = 'm1' and article_id % 5 = 0"), rows.unionByName(rows), key).select(*key)


CHANGES = "SELECT user_id, event_id, max(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS created_at, event_type AS hash, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events"


def versions(t: Tables) -> DataFrame:
    return state.history(t.events.select("user_id", F.col("event_id").alias("change_id"), F.col("ts").alias("at"), F.col("event_type").alias("hash")))


@query("M9_profile_history", f"""WITH c AS (SELECT c0.*, i.article_id AS basis FROM (SELECT event_id, {CHANGES[7:]}) AS c0 JOIN v_interactions i ON i.event_id = c0.event_id),
 h AS (SELECT user_id, row_number() OVER w AS version, hash, created_at, lead(created_at) OVER w AS retired_at, basis FROM c WHERE b IS DISTINCT FROM hash WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
 r AS (SELECT h.user_id, h.version, i.article_id, arg_max(i.stars, struct_pack(a := i.ts, e := i.event_id)) AS stars FROM h JOIN v_interactions i ON i.user_id = h.user_id AND i.ts >= h.created_at AND i.ts < h.retired_at AND i.article_id <> h.basis GROUP BY 1, 2, 3),
 s AS (SELECT r.*, v.score FROM r JOIN v_scores v ON v.version = 1 AND v.user_id = r.user_id AND v.article_id = r.article_id), n AS (SELECT user_id, version, count(*) AS rated FROM s GROUP BY 1, 2),
 p AS (SELECT x.user_id, x.version, avg(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0.0 END) AS concordance FROM s x JOIN s y ON y.user_id = x.user_id AND y.version = x.version AND x.stars > y.stars GROUP BY 1, 2)
 SELECT h.user_id, h.version, h.hash, h.created_at, h.retired_at, CASE WHEN h.retired_at IS NOT NULL THEN coalesce(n.rated, 0) END AS rated, p.concordance FROM h LEFT JOIN n ON n.user_id = h.user_id AND n.version = h.version LEFT JOIN p ON p.user_id = h.user_id AND p.version = h.version""")
def profile_history(t: Tables) -> DataFrame:
    """Versions, those retired with the figures of their time. A version rests on the article of the event that made it."""
    scores = t.v_scores.filter("version = 1").select("user_id", "article_id", "score")
    made = versions(t)
    basis = made.select("user_id", "version", F.col("change_id").alias("event_id")).join(t.v_interactions.select("event_id", "article_id"), "event_id").select("user_id", "version", "article_id")
    return state.frozen(made.drop("change_id"), t.v_interactions, scores, basis)


@query("M10_suggestions", f"""WITH m AS (SELECT user_id, event_id AS suggestion_id, max(event_id) OVER (PARTITION BY user_id) AS last FROM events WHERE event_id % 2 = 0), c AS (SELECT user_id, max(event_id) AS changed FROM ({CHANGES}) AS x WHERE b IS DISTINCT FROM hash GROUP BY user_id)
 SELECT m.suggestion_id, CASE WHEN m.suggestion_id % 6 = 0 THEN 'applied' WHEN m.suggestion_id % 10 = 0 THEN 'dismissed' WHEN m.suggestion_id < m.last OR m.suggestion_id < c.changed THEN 'superseded' ELSE 'pending' END AS status FROM m JOIN c ON c.user_id = m.user_id""")
def suggestions(t: Tables) -> DataFrame:
    even = t.events.filter("event_id % 2 = 0")
    made = even.select("user_id", F.col("event_id").alias("suggestion_id"), "event_id", F.lit("made").alias("action"))
    decided = lambda m, a, later: made.filter(F.col("suggestion_id") % m == 0).withColumn("action", F.lit(a)).withColumn("event_id", F.col("event_id") + later)
    return state.suggestions(made.unionByName(decided(6, "applied", 1)).unionByName(decided(10, "dismissed", 2)), versions(t))


def merges(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([("t1", "t3"), ("t6", "t2")], "source string, target string")


@query("M11_topic_merge", "SELECT DISTINCT artifact_id, CASE topic WHEN 't1' THEN 't3' WHEN 't6' THEN 't2' ELSE topic END AS topic FROM v_digest_topics")
def topic_merge(t: Tables) -> DataFrame:
    return state.merge_topics(t.v_digest_topics, t.v_topic_aliases, t.v_topics, merges(t))[0]


@query("M12_vocabulary_replace", "WITH gone AS (SELECT name FROM v_topics WHERE name NOT IN ('t1', 't13') AND facet = 'place') SELECT name, facet, false AS blocked FROM v_topics WHERE name NOT IN (SELECT name FROM gone) UNION ALL SELECT name, NULL AS facet, true AS blocked FROM gone WHERE name IN (SELECT topic FROM v_digest_topics)")
def vocabulary_replace(t: Tables) -> DataFrame:
    """The vocabulary after the replacement, and the names in use that stand against it."""
    wanted = t.v_topics.filter("facet <> 'place' or name in ('t1', 't13')")
    after, blocked = state.replace_vocabulary(t.v_topics, wanted, t.v_digest_topics)
    return after.withColumn("blocked", F.lit(False)).unionByName(blocked.select("name", F.lit(None).cast("string").alias("facet"), F.lit(True).alias("blocked")))


@query("M13_tag_linking", "SELECT x.artifact_id, x.name, coalesce(v.name, a.name) AS topic FROM (SELECT artifact_id, CASE WHEN artifact_id % 3 = 0 THEN concat('alias ', topic) ELSE topic END AS name FROM v_digest_topics) x LEFT JOIN v_topics v ON v.name = x.name LEFT JOIN v_topic_aliases a ON a.alias = x.name")
def tag_linking(t: Tables) -> DataFrame:
    names = t.v_digest_topics.select("artifact_id", F.when(F.col("artifact_id") % 3 == 0, F.concat(F.lit("alias "), "topic")).otherwise(F.col("topic")).alias("name"))
    return state.link_tags(names, t.v_topics, t.v_topic_aliases)


@query("M14_glossary_upsert", f"""WITH p AS (SELECT p_partkey AS k, p_partkey % 2 = 1 AS fresh FROM part),
 r AS (SELECT k, list_filter([CASE WHEN k % 9 = 0 THEN 'target' END, CASE WHEN k % 15 = 0 THEN 'abbr' END, CASE WHEN k % 21 = 0 THEN 'source' END], lambda x: x IS NOT NULL) AS reasons FROM p WHERE fresh)
 SELECT k AS term_id, concat('s', CAST(k AS STRING)) AS source, TIMESTAMP '2024-01-01 00:00:00' AS added_at, NULL AS reasons FROM p WHERE NOT fresh OR k IN (SELECT k FROM r WHERE len(reasons) > 0)
 UNION ALL SELECT k, concat('x', CAST(k AS STRING)), TIMESTAMP '2024-01-01 00:00:00', NULL FROM p
 UNION ALL SELECT k, concat('S', CAST(k AS STRING)), {NOW_SQL}, NULL FROM p WHERE fresh AND k NOT IN (SELECT k FROM r WHERE len(reasons) > 0)
 UNION ALL SELECT k, NULL, NULL, array_to_string(list_sort(reasons), ',') FROM r WHERE len(reasons) > 0""")
def glossary_upsert(t: Tables) -> DataFrame:
    """Each part is a term with two sources; every other one is given anew with one source in capitals and one kept, some of them with the target, abbreviation or a source of the term before."""
    k, text = F.col("p_partkey"), lambda s, c: F.concat(F.lit(s), c.cast("string"))
    terms = t.part.select(k.alias("term_id"), text("T", k).alias("target"), text("A", k).alias("abbr"))
    sources = t.part.select(F.explode(F.array(text("s", k), text("x", k))).alias("source"), k.alias("term_id"), F.lit(datetime(2024, 1, 1)).alias("added_at"))
    again = F.array_compact(F.array(text("S", k), text("x", k), F.when(k % 21 == 0, text("X", k - 1))))
    fresh = t.part.filter(k % 2 == 1).select(k.alias("term_id"), F.when(k % 9 == 0, text("T", k - 1)).otherwise(text("N", k)).alias("target"), F.when(k % 15 == 0, text("A", k - 1)).alias("abbr"), again.alias("sources"))
    after, rejected = state.glossary_upsert(terms, sources, fresh, F.lit(NOW))
    none = F.lit(None).cast("string")
    return after.select("term_id", "source", "added_at", none.alias("reasons")).unionByName(rejected.select("term_id", none.alias("source"), F.lit(None).cast("timestamp").alias("added_at"), F.concat_ws(",", "reasons").alias("reasons")))


@query("M15_translation_requests", "SELECT i.event_id, i.article_id, CASE WHEN d.made IS NOT NULL THEN greatest(i.ts, d.made) END AS done_at FROM v_interactions i LEFT JOIN (SELECT article_id, min(created_at) AS made FROM v_digests WHERE model = 'm2' GROUP BY 1) d ON d.article_id = i.article_id WHERE i.event_type = 'purchase'")
def translation_requests(t: Tables) -> DataFrame:
    asked = t.v_interactions.filter("event_type = 'purchase'").select("event_id", "article_id", "user_id", F.col("ts").cast("timestamp").alias("asked_at"))
    return state.requests_done(asked, t.v_digests.filter("model = 'm2'")).select("event_id", "article_id", "done_at")


@query("M16_redo_selection", "SELECT id AS article_id FROM v_articles WHERE source_id IN ('src1', 'src2', 'src3') AND id NOT IN (SELECT article_id FROM v_digests WHERE model = 'm2')")
def redo_selection(t: Tables) -> DataFrame:
    rows = t.v_articles.withColumnRenamed("id", "article_id")
    return state.redo(rows, t.v_digests, "m2", F.col("source_id").isin("src1", "src2", "src3")).select("article_id")


@query("M17_stale_by_glossary", f"""WITH h AS (SELECT d.doc_id AS article_id, max(TIMESTAMP '2024-02-01 00:00:00' + length(g.source) * 25 * INTERVAL '1' MINUTE) AS changed FROM documents d JOIN v_glossary_sources g ON {mention_sql("substring(d.text, 1, 6000)")} GROUP BY 1),
 l AS (SELECT article_id, max(created_at) AS made_at FROM v_digests GROUP BY 1) SELECT l.article_id, l.made_at FROM l JOIN h ON h.article_id = l.article_id WHERE h.changed > l.made_at""")
def stale_by_glossary(t: Tables) -> DataFrame:
    """A digest is made of a text's first 6,000 characters, so only terms in these make it stale."""
    texts = t.documents.select(F.col("doc_id").alias("id"), F.substring("text", 1, 6000).alias("text"))
    glossary = t.v_glossary_sources.select("term_id", F.timestamp_add("MINUTE", F.length("source") * 25, F.lit(datetime(2024, 2, 1))).alias("changed_at"))
    made = t.v_digests.groupBy("article_id").agg(F.max("created_at").alias("made_at"))
    return state.stale_by_glossary(made, joins.glossary_hits(texts, t.v_glossary_sources).withColumnRenamed("id", "article_id"), glossary)
