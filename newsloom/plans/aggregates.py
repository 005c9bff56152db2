"""Aggregations over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import Tables
from ..operators import counts, joins
from ..registry import query
from .joins import version_evidence

RATED = "SELECT user_id, article_id, arg_max(stars, event_id) AS stars, max(ts) AS rated_at FROM v_interactions GROUP BY user_id, article_id"


def ratings(t: Tables) -> DataFrame:
    """The latest stars of each user for each article."""
    return t.v_interactions.groupBy("user_id", "article_id").agg(F.max_by("stars", "event_id").alias("stars"), F.max("ts").alias("rated_at"))


def scored_ratings(t: Tables) -> DataFrame:
    return t.v_scores.select("user_id", "article_id", "version", "score", "created_at").join(ratings(t), ["user_id", "article_id"])


PAIRS = f"""WITH r AS ({RATED}), s AS (SELECT x.version, x.user_id, x.article_id, x.score, r.stars FROM v_scores x JOIN r ON r.user_id = x.user_id AND r.article_id = x.article_id)"""


@query("D1_source_overview", """WITH ids AS (SELECT source_id FROM v_articles UNION SELECT source_id FROM v_fetch_runs), e AS (SELECT event_type AS source_id, max(props) AS error FROM events GROUP BY event_type)
 SELECT i.source_id, coalesce(a.n, 0) AS articles, e.error, r.last_run FROM ids i LEFT JOIN (SELECT source_id, count(*) AS n FROM v_articles GROUP BY 1) a ON a.source_id = i.source_id
 LEFT JOIN e ON e.source_id = i.source_id LEFT JOIN (SELECT source_id, max(fetched_at) AS last_run FROM v_fetch_runs GROUP BY 1) r ON r.source_id = i.source_id""")
def source_overview(t: Tables) -> DataFrame:
    states = t.events.groupBy(F.col("event_type").alias("source_id")).agg(F.max("props").alias("error"))
    return counts.overview(t.v_articles, states, t.v_fetch_runs)


@query("D2_first_marks", "SELECT user_id, article_id, min(ts) AS read_at FROM v_interactions WHERE event_type IN ('view', 'click') GROUP BY user_id, article_id")
def first_marks(t: Tables) -> DataFrame:
    opens, rated = (t.v_interactions.filter(F.col("event_type") == kind).select("user_id", "article_id", "ts") for kind in ("view", "click"))
    return opens.unionByName(rated).groupBy("user_id", "article_id").agg(F.min("ts").alias("read_at"))


@query("D3_star_histogram", f"WITH r AS ({RATED}) SELECT user_id, " + ", ".join(f"CAST(count(*) FILTER (WHERE stars = {k}) AS BIGINT) AS stars_{k}" for k in range(1, 6)) + ", count(*) FILTER (WHERE stars >= 4) AS positive, count(*) FILTER (WHERE stars = 3) AS neutral, count(*) FILTER (WHERE stars <= 2) AS negative FROM r GROUP BY user_id")
def star_histogram(t: Tables) -> DataFrame:
    return counts.star_histogram(ratings(t), ["user_id"])


@query("D4_concordance", PAIRS + """ SELECT version, CASE WHEN sum(n) > 0 THEN sum(g) / sum(n) END AS concordance FROM (SELECT a.version, 1 AS n, CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END::DOUBLE AS g
 FROM s a JOIN s b ON a.version = b.version AND a.stars > b.stars) AS p GROUP BY version""")
def concordance(t: Tables) -> DataFrame:
    return counts.concordance(scored_ratings(t), ["version"])


@query("D5_band_counts", PAIRS + " SELECT version, CAST(floor(least(score, 99) / 10) * 10 AS INT) AS band, stars, count(*) AS n FROM s GROUP BY 1, 2, 3")
def band_counts(t: Tables) -> DataFrame:
    return counts.band_counts(scored_ratings(t), ["version"])


@query("D6_coverage", f"WITH r AS ({RATED}), n AS (SELECT user_id, count(*) AS labelled FROM r GROUP BY 1) SELECT s.user_id, s.version, coalesce(max(n.labelled), 0) AS labelled, count(r.article_id) AS scored, count(*) FILTER (WHERE s.created_at > r.rated_at) AS after_rating FROM v_scores s LEFT JOIN r ON r.article_id = s.article_id AND r.user_id = s.user_id LEFT JOIN n ON n.user_id = s.user_id GROUP BY 1, 2")
def coverage(t: Tables) -> DataFrame:
    return counts.coverage(ratings(t).select("user_id", "article_id", "rated_at"), t.v_scores.select("user_id", "version", "article_id", "created_at"), ["version"])


@query("D7_miss_rate", f"WITH r AS ({RATED}), p AS (SELECT DISTINCT user_id, article_id FROM v_interactions WHERE event_type = 'click') SELECT p.user_id, count(*) AS picked, count(r.stars) AS rated, count(*) FILTER (WHERE r.stars >= 4) AS positive, count(*) FILTER (WHERE r.stars >= 4) / count(r.stars) AS miss_rate FROM p LEFT JOIN r ON r.user_id = p.user_id AND r.article_id = p.article_id GROUP BY p.user_id")
def miss_rate(t: Tables) -> DataFrame:
    picks = t.v_interactions.filter("event_type = 'click'").select("user_id", "article_id").distinct()
    return counts.missed(picks, ratings(t).drop("rated_at"))


TOPICS = "SELECT d.article_id, x.topic FROM v_digest_topics x JOIN v_digests d ON d.id = x.artifact_id"


def article_topics(t: Tables) -> DataFrame:
    return t.v_digest_topics.join(t.v_digests.select(F.col("id").alias("artifact_id"), "article_id"), "artifact_id").select("article_id", "topic")


@query("D8_topic_sentiment", f"WITH r AS ({RATED}), x AS ({TOPICS}) SELECT x.topic, count(*) FILTER (WHERE stars >= 4) AS positive, count(*) FILTER (WHERE stars <= 2) AS negative, count(*) AS total FROM r JOIN x ON x.article_id = r.article_id GROUP BY x.topic")
def topic_sentiment(t: Tables) -> DataFrame:
    return counts.topic_sentiment(ratings(t), article_topics(t))


@query("D9_topic_usage", "SELECT t.name, count(d.artifact_id) AS uses FROM v_topics t LEFT JOIN v_digest_topics d ON d.topic = t.name GROUP BY t.name")
def topic_usage(t: Tables) -> DataFrame:
    return counts.usage(t.v_topics, t.v_digest_topics)


@query("D10_stage_failures", """WITH e AS (SELECT event_id, item_id AS article_id, 1 + event_id % 7 AS attempts, CASE WHEN event_id % 3 = 0 THEN 'embed:s' ELSE 'digest' END AS stage, concat('error ', CAST(event_id AS STRING)) AS error, "at" FROM v_outcomes WHERE failed)
 SELECT stage, 'b' AS backend, 'm' AS model, count(DISTINCT article_id) AS failing, count(DISTINCT CASE WHEN attempts >= 5 THEN article_id END) AS given_up, arg_max(error, struct_pack(a := "at", b := article_id)) FILTER (WHERE attempts >= 5) AS last_error FROM e GROUP BY stage""")
def stage_failures(t: Tables) -> DataFrame:
    e = F.col("event_id")
    errors = t.v_outcomes.filter("failed").select(F.when(e % 3 == 0, F.concat(F.lit("embed:s:"), (e % 2).cast("string"))).otherwise("digest").alias("stage"), F.lit("b").alias("backend"), F.lit("m").alias("model"),
        F.col("item_id").alias("article_id"), (1 + e % 7).alias("attempts"), F.concat(F.lit("error "), e.cast("string")).alias("error"), F.col("at").alias("next_retry_at"))
    return counts.failures(errors)


@query("D11_inbox_counts", "SELECT s.status, count(o.o_orderkey) AS n FROM (SELECT 'F' AS status UNION ALL SELECT 'O' UNION ALL SELECT 'P' UNION ALL SELECT 'none') s LEFT JOIN orders o ON o.o_orderstatus = s.status GROUP BY s.status")
def inbox_counts(t: Tables) -> DataFrame:
    statuses = t.spark.createDataFrame([(s,) for s in ("F", "O", "P", "none")], "status string")
    n = t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return statuses.join(n, "status", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("D12_usage_ledger", """WITH d AS (SELECT backend, CAST("at" AS DATE) AS day, sum(credits) AS credits FROM v_calls GROUP BY 1, 2)
 SELECT backend, day, round(sum(credits) OVER (PARTITION BY backend, date_trunc('month', day) ORDER BY day), 4) AS used, round(1e6 * day(day) / day(last_day(day)), 4) AS allowed FROM d""")
def usage_ledger(t: Tables) -> DataFrame:
    return counts.ledger(t.v_calls, 1e6).withColumn("used", F.round("used", 4)).withColumn("allowed", F.round("allowed", 4))


@query("D13_rate_windows", """WITH u AS (SELECT event_type AS kind, date_trunc('day', ts) AS resets_at, value AS utilization, ts AS seen FROM events), l AS (SELECT kind, max(seen) AS m FROM u GROUP BY kind),
 r AS (SELECT u.* FROM u JOIN l ON l.kind = u.kind WHERE u.seen > l.m - INTERVAL '8' DAY) SELECT kind, max(resets_at) AS resets_at, max(utilization) FILTER (WHERE resets_at = mx) AS utilization FROM (SELECT *, max(resets_at) OVER (PARTITION BY kind) AS mx FROM r) AS x GROUP BY kind""")
def rate_windows(t: Tables) -> DataFrame:
    return counts.newest_windows(t.events.select(F.col("event_type").alias("kind"), F.date_trunc("day", "ts").alias("resets_at"), F.col("value").alias("utilization"), F.col("ts").alias("at")))


@query("D14_hidden_counts", """WITH f AS (SELECT score >= 50 AS a, article_id % 5 <> 0 AS b, version = 1 AS c FROM v_scores)
 SELECT 'score' AS condition, count(*) FILTER (WHERE NOT a AND b AND c) AS hidden FROM f UNION ALL SELECT 'relevant', count(*) FILTER (WHERE a AND NOT b AND c) FROM f UNION ALL SELECT 'version', count(*) FILTER (WHERE a AND b AND NOT c) FROM f""")
def hidden_counts(t: Tables) -> DataFrame:
    return counts.lifted(t.v_scores, {"score": F.col("score") >= 50, "relevant": F.col("article_id") % 5 != 0, "version": F.col("version") == 1})


@query("D15_version_stats", PAIRS.replace("WITH r AS", "WITH r0 AS", 1).split(", s AS")[0] + """, r AS (SELECT r0.*, p.version AS pv FROM r0 JOIN v_profile_versions p ON p.user_id = r0.user_id AND p.created_at <= r0.rated_at AND (p.retired_at IS NULL OR r0.rated_at < p.retired_at)
  WHERE NOT EXISTS (SELECT 1 FROM v_version_evidence e WHERE e.user_id = p.user_id AND e.created_at = p.created_at AND e.article_id = r0.article_id)),
 s AS (SELECT r.user_id, r.pv, r.stars, x.score FROM r JOIN v_scores x ON x.user_id = r.user_id AND x.article_id = r.article_id AND x.version = 1),
 c AS (SELECT a.user_id, a.pv, avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) AS concordance FROM s a JOIN s b ON a.user_id = b.user_id AND a.pv = b.pv AND a.stars > b.stars GROUP BY 1, 2)
 SELECT n.user_id, n.pv AS version, n.rated, c.concordance FROM (SELECT user_id, pv, count(*) AS rated FROM s GROUP BY 1, 2) n LEFT JOIN c ON c.user_id = n.user_id AND c.pv = n.pv""")
def version_stats(t: Tables) -> DataFrame:
    rated = joins.during(ratings(t), t.v_profile_versions, ["user_id"], "rated_at", version_evidence(t))
    rows = rated.join(t.v_scores.filter("version = 1").select("user_id", "article_id", "score"), ["user_id", "article_id"])
    by = ["user_id", "version"]
    out = rows.groupBy(*by).agg(F.count("*").alias("rated")).join(counts.concordance(rows, by), by, "left")
    return out.withColumn("version", F.col("version").cast("bigint"))


@query("D16_feature_sums", "SELECT s.user_id, s.article_id, round(sum(p.weight), 9) AS weight_sum FROM (SELECT user_id, article_id FROM v_scores WHERE version = 1) s JOIN (SELECT DISTINCT article_id, topic FROM (" + TOPICS + ") AS q) d ON d.article_id = s.article_id JOIN (SELECT user_id, concat('t', CAST(pos AS STRING)) AS topic, weight FROM v_profile_terms) p ON p.user_id = s.user_id AND p.topic = d.topic GROUP BY 1, 2")
def feature_sums(t: Tables) -> DataFrame:
    weights = t.v_profile_terms.select("user_id", F.concat(F.lit("t"), F.col("pos").cast("string")).alias("feature"), "weight")
    topics = article_topics(t).groupBy("article_id").agg(F.collect_list("topic").alias("features"))
    rows = t.v_scores.filter("version = 1").select("user_id", "article_id").join(topics, "article_id")
    listed = joins.weight_sums(rows, weights, ["user_id", "article_id"])
    return listed.filter(F.arrays_overlap("features", F.array(*(F.lit(f"t{k}") for k in range(4))))).select("user_id", "article_id", F.round("weight_sum", 9).alias("weight_sum"))


@query("D19_ordered_lists", "SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS types FROM events GROUP BY user_id")
def ordered_lists(t: Tables) -> DataFrame:
    gathered = F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return t.events.groupBy("user_id").agg(F.array_join(F.transform(gathered, lambda x: x["event_type"]), ",").alias("types"))
