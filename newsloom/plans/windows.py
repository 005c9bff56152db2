"""Latest versions, sorts, limits and samples over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixtures import Tables
from ..functions.time import effective
from ..operators import joins, latest
from ..registry import query
from .basics import REQUIRED, required

ARTICLES = "SELECT id, source_id, lang, coalesce(published_at, fetched_at) AS at FROM v_articles"


def articles(t: Tables) -> DataFrame:
    return t.v_articles.withColumn("at", effective(F.col("published_at"), F.col("fetched_at"))).select("id", "source_id", "lang", "at")


@query("E1_latest_digest", f"""WITH u AS (SELECT DISTINCT user_id FROM events), r AS ({REQUIRED}),
 v AS (SELECT u.user_id, d.id, d.article_id, d.created_at FROM v_digests d CROSS JOIN u WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.artifact_id = d.id AND NOT EXISTS (SELECT 1 FROM v_user_memberships m WHERE m.user_id = u.user_id AND m.membership_id = r.membership_id)))
 SELECT user_id, article_id, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, article_id ORDER BY created_at DESC, id DESC) AS k FROM v) AS x WHERE k = 1""")
def latest_digest(t: Tables) -> DataFrame:
    """Users with the same memberships see the same versions: the newest is chosen once for each membership set, then given to its users."""
    newest = newest_viewable(t).select("has", "article_id", "id")
    return joins.given_to_members(newest, memberships(t), "has", "user_id").select("user_id", "article_id", "id")


def memberships(t: Tables) -> DataFrame:
    """(user_id, has): each user's memberships."""
    users = t.events.select("user_id").distinct()
    owned = users.join(t.v_user_memberships.groupBy("user_id").agg(F.sort_array(F.collect_set("membership_id")).alias("has")), "user_id", "left")
    return owned.withColumn("has", F.coalesce("has", F.array().cast("array<int>")))


def newest_viewable(t: Tables) -> DataFrame:
    """(has, article_id, id, relevant): the newest digest of each article that a set of memberships opens."""
    need = required(t).groupBy("artifact_id").agg(F.collect_set("membership_id").alias("need")).withColumnRenamed("artifact_id", "id")
    digests = t.v_digests.select("id", "article_id", "created_at", "relevant").join(need, "id", "left")
    fine = joins.each_with_each(digests, memberships(t).select("has").distinct()).filter(F.col("need").isNull() | (F.size(F.array_except("need", "has")) == 0))
    return latest.newest(fine, ["has", "article_id"]).select("has", "article_id", "id", "relevant")


@query("E2_display_title", """WITH d AS (SELECT article_id, title_x, row_number() OVER (PARTITION BY article_id ORDER BY created_at DESC, id DESC) AS k FROM v_digests),
 l AS (SELECT article_id, title_x, row_number() OVER (PARTITION BY article_id ORDER BY created_at DESC, id DESC) AS k FROM v_title_translations)
 SELECT a.id, coalesce(nullif(trim(d.title_x), ''), nullif(trim(l.title_x), ''), nullif(trim(a.title), ''), a.url) AS title FROM v_articles a LEFT JOIN d ON d.article_id = a.id AND d.k = 1 LEFT JOIN l ON l.article_id = a.id AND l.k = 1""")
def display_title(t: Tables) -> DataFrame:
    digest = latest.newest(t.v_digests, ["article_id"]).select(F.col("article_id").alias("id"), F.col("title_x").alias("digest"))
    translated = latest.newest(t.v_title_translations, ["article_id"]).select(F.col("article_id").alias("id"), F.col("title_x").alias("translated"))
    rows = t.v_articles.join(digest, "id", "left").join(translated, "id", "left")
    return rows.select("id", latest.display_title(F.col("digest"), F.col("translated"), F.col("title"), F.col("url")).alias("title"))


@query("E3_ranking_score", "SELECT user_id, artifact_id, version, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id, artifact_id ORDER BY version DESC, created_at DESC) AS k FROM v_scores) AS x WHERE k = 1")
def ranking_score(t: Tables) -> DataFrame:
    return latest.top(t.v_scores, ["user_id", "artifact_id"], [F.col("version").desc(), F.col("created_at").desc()]).select("user_id", "artifact_id", "version", "score")


@query("E4_evaluation_score", "SELECT version, user_id, article_id, score FROM (SELECT *, row_number() OVER (PARTITION BY version, user_id, article_id ORDER BY created_at DESC, artifact_id DESC) AS k FROM v_scores) AS x WHERE k = 1")
def evaluation_score(t: Tables) -> DataFrame:
    return latest.newest(t.v_scores, ["version", "user_id", "article_id"], ident="artifact_id").select("version", "user_id", "article_id", "score")


FOLD = f"""WITH a AS ({ARTICLES}), r AS (SELECT s.user_id, a.id, a.at, t.story_id, s.score FROM v_scores s JOIN a ON a.id = s.article_id JOIN v_stories t ON t.article_id = a.id WHERE s.version = 1 AND s.score >= 20),
 f AS (SELECT *, row_number() OVER (PARTITION BY user_id, story_id ORDER BY score DESC NULLS LAST, "at" DESC, id DESC) AS k FROM r)"""


def scored_articles(t: Tables) -> DataFrame:
    return articles(t).join(t.v_scores.filter("version = 1").select("user_id", F.col("article_id").alias("id"), "score"), "id").join(t.v_stories.withColumnRenamed("article_id", "id"), "id")


@query("E5_story_fold", FOLD + " SELECT user_id, id, story_id, score FROM f WHERE k = 1 AND score % 5 <> 0")
def story_fold(t: Tables) -> DataFrame:
    rows = scored_articles(t).filter("score >= 20")
    return latest.fold_stories(rows, ["user_id"], latest.list_order(), F.col("score") % 5 != 0).select("user_id", "id", "story_id", "score")


@query("E6_last_run", "SELECT source_id, fetched_at, total FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY fetched_at DESC) AS k FROM v_fetch_runs) AS x WHERE k = 1")
def last_run(t: Tables) -> DataFrame:
    return latest.top(t.v_fetch_runs, ["source_id"], [F.col("fetched_at").desc()]).select("source_id", "fetched_at", "total")


@query("E7_last_21_runs", "SELECT source_id, fetched_at, total FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY fetched_at DESC) AS k FROM v_fetch_runs) AS x WHERE k <= 21")
def last_runs(t: Tables) -> DataFrame:
    return latest.top(t.v_fetch_runs, ["source_id"], [F.col("fetched_at").desc()], 21).select("source_id", "fetched_at", "total")


@query("E8_day_gaps", "SELECT user_id, day, CAST(gap AS INT) AS gap FROM (SELECT user_id, day, datediff('day', lag(day) OVER (PARTITION BY user_id ORDER BY day), day) AS gap FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events) AS d) AS x WHERE gap IS NOT NULL")
def day_gaps(t: Tables) -> DataFrame:
    return latest.gaps(t.events.withColumn("day", F.to_date("ts")), "user_id")


@query("E9_latest_judgment", "SELECT article_id, id FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY created_at DESC, id DESC) AS k FROM v_digests) AS x WHERE k = 1")
def latest_judgment(t: Tables) -> DataFrame:
    return latest.newest(t.v_digests, ["article_id"]).select("article_id", "id")


@query("E10_first_occurrence", "SELECT conv_id, role, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations) AS x WHERE k = 1")
def first_occurrence(t: Tables) -> DataFrame:
    return latest.top(t.conversations, ["conv_id", "role"], [F.col("turn").asc()]).select("conv_id", "role", "turn")


@query("E11_visits", """WITH d AS (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'view'), l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM d),
 e AS (SELECT user_id, ts, CASE WHEN ts - p > INTERVAL '30' MINUTE THEN p END AS cut FROM l)
 SELECT user_id, ts, count(cut) OVER w + 1 AS visit, max(cut) OVER w AS boundary FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)""")
def visits(t: Tables) -> DataFrame:
    return latest.visits(t.events.filter("event_type = 'view'"))


@query("E12_percentile", """WITH v AS (SELECT user_id, artifact_id AS id, CAST(score - 5 AS DOUBLE) AS value, version, created_at FROM v_scores),
 r AS (SELECT user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS k FROM v WHERE version = 2) AS x WHERE k <= 3000)
 SELECT v.user_id, v.id, v.value, CAST(CASE WHEN v.value <= 0 THEN 0 WHEN count(r.value) = 0 THEN 50 ELSE round(100 * (count(*) FILTER (WHERE r.value < v.value) + count(*) FILTER (WHERE r.value = v.value) / 2) / count(r.value)) END AS INT) AS score
 FROM v LEFT JOIN r ON r.user_id = v.user_id WHERE v.version = 1 GROUP BY v.user_id, v.id, v.value""")
def percentile(t: Tables) -> DataFrame:
    """Each user's scores among the newest ones of the other version."""
    rows = t.v_scores.select("user_id", F.col("artifact_id").alias("id"), (F.col("score") - 5).cast("double").alias("value"), "version", "created_at")
    known = latest.top(rows.filter("version = 2"), ["user_id"], [F.col("created_at").desc(), F.col("id").desc()], latest.REFERENCE)
    return latest.percentile(rows.filter("version = 1"), known, "user_id")


@query("E13_median", "SELECT event_type, CAST(floor((s[(n + 1) // 2] + s[n // 2 + 1]) / 2) AS BIGINT) AS median FROM (SELECT event_type, list_sort(list(CAST(value AS BIGINT))) AS s, count(*) AS n FROM events GROUP BY event_type) AS x")
def median(t: Tables) -> DataFrame:
    return latest.medians(t.events.select("event_type", F.round("value").cast("bigint").alias("value")), "event_type", "value")


@query("F1_list_order", FOLD + """ SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC NULLS LAST, "at" DESC, id DESC) AS place, row_number() OVER (PARTITION BY user_id ORDER BY "at" DESC, id DESC) AS newest FROM r""")
def list_order(t: Tables) -> DataFrame:
    rows = scored_articles(t).filter("score >= 20")
    place = lambda newest: F.row_number().over(Window.partitionBy("user_id").orderBy(*latest.list_order(newest))).cast("bigint")
    return rows.select("user_id", "id", place(False).alias("place"), place(True).alias("newest"))


@query("F2_limit_after_fold", FOLD + """, g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC NULLS LAST, "at" DESC, id DESC) AS n FROM f WHERE k = 1) SELECT user_id, id, score FROM g WHERE n <= 20""")
def limit_after_fold(t: Tables) -> DataFrame:
    return latest.fold_stories(scored_articles(t).filter("score >= 20"), ["user_id"], latest.list_order(), limit=20).select("user_id", "id", "score")


@query("F3_two_quotas", """WITH c AS (SELECT user_id AS target, article_id AS unit, max(stars) AS similarity, article_id % 2 = 0 AS other_source FROM v_interactions GROUP BY user_id, article_id),
 k AS (SELECT *, row_number() OVER (PARTITION BY target, other_source ORDER BY similarity DESC, unit) AS r FROM c) SELECT target, unit FROM k WHERE r <= CASE WHEN other_source THEN 5 ELSE 3 END""")
def two_quotas(t: Tables) -> DataFrame:
    c = t.v_interactions.groupBy(F.col("user_id").alias("target"), F.col("article_id").alias("unit")).agg(F.max("stars").alias("similarity"))
    return latest.two_quotas(c.withColumn("other_source", F.col("unit") % 2 == 0)).select("target", "unit")


EXPLORE = """WITH d AS (SELECT article_id, relevant, row_number() OVER (PARTITION BY article_id ORDER BY created_at DESC, id DESC) AS k FROM v_digests),
 fit AS (SELECT s.user_id, s.article_id, t.story_id FROM v_scores s JOIN d ON d.article_id = s.article_id AND d.k = 1 JOIN v_stories t ON t.article_id = s.article_id WHERE s.version = 1 AND s.score < 50 AND d.relevant),
 rated AS (SELECT DISTINCT i.user_id, t.story_id FROM v_interactions i JOIN v_stories t ON t.article_id = i.article_id WHERE i.event_type = 'purchase'),
 seen AS (SELECT * FROM rated UNION SELECT i.user_id, t.story_id FROM v_interactions i JOIN v_stories t ON t.article_id = i.article_id WHERE i.event_type = 'view'),
 picked AS (SELECT DISTINCT user_id, article_id, CAST(ts AS DATE) AS day FROM v_interactions WHERE event_type = 'click'),
 free AS (SELECT f.* FROM fit f WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.user_id = f.user_id AND seen.story_id = f.story_id) AND NOT EXISTS (SELECT 1 FROM picked p WHERE p.user_id = f.user_id AND p.article_id = f.article_id)),
 ranked AS (SELECT user_id, article_id, row_number() OVER (PARTITION BY user_id ORDER BY md5(concat_ws('-', CAST(user_id AS STRING), '2024-01-30', CAST(article_id AS STRING))), article_id) AS turn FROM free),
 done AS (SELECT user_id, count(*) AS n FROM picked WHERE day = DATE '2024-01-30' GROUP BY user_id),
 today AS (SELECT user_id, article_id FROM picked WHERE day = DATE '2024-01-30' UNION SELECT r.user_id, r.article_id FROM ranked r LEFT JOIN done ON done.user_id = r.user_id WHERE r.turn <= 2 - coalesce(done.n, 0))
 SELECT t.user_id, t.article_id FROM today t JOIN fit ON fit.user_id = t.user_id AND fit.article_id = t.article_id WHERE NOT EXISTS (SELECT 1 FROM rated WHERE rated.user_id = t.user_id AND rated.story_id = fit.story_id)"""


@query("F5_daily_picks", EXPLORE)
def daily_picks(t: Tables) -> DataFrame:
    """The day's sample of every user: clicks stand for earlier picks, views for readings, purchases for ratings."""
    day, below = "2024-01-30", 50
    relevant = latest.newest(t.v_digests, ["article_id"]).select("article_id", "relevant")
    rows = t.v_scores.filter("version = 1").select("user_id", "article_id", "score").join(relevant, "article_id")
    acts = lambda kind: t.v_interactions.filter(F.col("event_type") == kind)
    picked = acts("click").select("user_id", "article_id", F.to_date("ts").alias("picked_on")).distinct()
    fresh = latest.daily_picks(latest.explorable(rows, t.v_stories, acts("view"), acts("purchase"), below), picked, day)
    picked = picked.unionByName(fresh.withColumn("picked_on", F.lit(day).cast("date")))
    return latest.explored(picked, rows, t.v_stories, acts("purchase"), day, below)


@query("F6_translation_queue", f"""WITH a AS ({ARTICLES}), q AS (SELECT article_id, min(ts) AS asked FROM v_interactions WHERE event_type = 'purchase' GROUP BY article_id), s AS (SELECT article_id, max(score) AS score FROM v_scores GROUP BY article_id)
 SELECT a.id, row_number() OVER (ORDER BY q.asked IS NULL, q.asked, s.score DESC NULLS LAST, a."at" DESC, a.id DESC) AS place FROM a LEFT JOIN q ON q.article_id = a.id LEFT JOIN s ON s.article_id = a.id ORDER BY place LIMIT 100""")
def translation_queue(t: Tables) -> DataFrame:
    asked = t.v_interactions.filter("event_type = 'purchase'").groupBy(F.col("article_id").alias("id")).agg(F.min("ts").alias("asked"))
    best = t.v_scores.groupBy(F.col("article_id").alias("id")).agg(F.max("score").alias("score"))
    order = [F.col("asked").asc_nulls_last(), *latest.list_order()]
    first = articles(t).join(asked, "id", "left").join(best, "id", "left").orderBy(*order).limit(100)
    return first.select("id", F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("place"))


@query("F7_newest_work", f"""WITH a AS ({ARTICLES}) SELECT id FROM a WHERE NOT EXISTS (SELECT 1 FROM v_digests d WHERE d.article_id = a.id) ORDER BY "at" DESC, id DESC LIMIT 50""")
def newest_work(t: Tables) -> DataFrame:
    return articles(t).join(t.v_digests.select(F.col("article_id").alias("id")), "id", "left_anti").orderBy(F.col("at").desc(), F.col("id").desc()).limit(50).select("id")


@query("F8_newest_evidence", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM v_interactions WHERE event_type = 'view') AS x WHERE k <= 100")
def newest_evidence(t: Tables) -> DataFrame:
    return latest.top(t.v_interactions.filter("event_type = 'view'"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 100).select("user_id", "event_id")


