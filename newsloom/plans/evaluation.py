"""Corrected scores, the ranked feed and evaluation reports, for every user."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixtures import Tables
from ..functions.session import saved
from ..operators import adjust, counts, latest, predicates, stories
from ..registry import query
from .aggregates import RATED, ratings
from .basics import REQUIRED, required
from .windows import ARTICLES, articles, memberships, newest_viewable

KEYED = "SELECT a.id AS article_id, list_sort(list_distinct(list_concat([concat('source:', a.source_id)], coalesce(list(concat('topic:', d.topic)) FILTER (WHERE d.topic IS NOT NULL), [])))) AS features FROM v_articles a LEFT JOIN v_digest_topics d ON d.artifact_id = a.id * 10 + 1 GROUP BY a.id, a.source_id"


def keyed(t: Tables) -> DataFrame:
    """(article_id, features) of every article."""
    topics = t.v_digest_topics.groupBy("artifact_id").agg(F.collect_set("topic").alias("topics"))
    none = F.lit(None).cast("array<string>")
    rows = t.v_articles.select("id", "source_id", (F.col("id") * 10 + 1).alias("artifact_id")).join(topics, "artifact_id", "left")
    return rows.select(F.col("id").alias("article_id"), adjust.features(F.col("source_id"), F.col("topics"), none, none).alias("features"))


def train(t: Tables) -> DataFrame:
    scores = t.v_scores.filter("version = 1").select("user_id", "article_id", "score")
    stars = ratings(t).select("user_id", "article_id", "stars")
    rows = stars.join(scores.withColumnRenamed("score", "base"), ["user_id", "article_id"]).join(keyed(t), "article_id")
    return rows.select("user_id", "article_id", "base", "stars", "features")


#: Fixed weights by a rule, so that what follows from weights can be compared with SQL.
WEIGHTS = "SELECT DISTINCT s.user_id, concat('topic:', d.topic) AS feature, ((s.user_id + length(d.topic) * 3 + CAST(substring(d.topic, 2) AS INT)) % 9 - 4) / 4.0::DOUBLE AS weight FROM (SELECT DISTINCT user_id FROM v_scores) s CROSS JOIN (SELECT DISTINCT topic FROM v_digest_topics) d"


def weights(t: Tables) -> DataFrame:
    users, topics = t.v_scores.select("user_id").distinct(), t.v_digest_topics.select("topic").distinct()
    rule = ((F.col("user_id") + F.length("topic") * 3 + F.substring("topic", 2, 9).cast("int")) % 9 - 4) / 4.0
    return users.crossJoin(F.broadcast(topics)).select("user_id", F.concat(F.lit("topic:"), "topic").alias("feature"), rule.alias("weight"))  # topics are a fixed vocabulary


def scored_rows(t: Tables) -> DataFrame:
    return t.v_scores.filter("version = 1").select("user_id", "article_id", F.col("score").alias("base")).join(keyed(t), "article_id")


RECOMMENDED = f"""k AS ({KEYED}), w AS ({WEIGHTS}), e AS (SELECT article_id, unnest(features) AS feature FROM k), b AS (SELECT user_id, article_id, score AS base FROM v_scores WHERE version = 1),
 s AS (SELECT b.user_id, b.article_id, b.base, coalesce(sum(w.weight), 0) AS ws FROM b JOIN e ON e.article_id = b.article_id LEFT JOIN w ON w.user_id = b.user_id AND w.feature = e.feature GROUP BY 1, 2, 3),
 rec AS (SELECT user_id, article_id, base, ws, CAST(round(100 / (1 + exp(-(ln(p / (1 - p)) + ws)))) AS INT) AS score FROM (SELECT *, least(greatest(base / 100, 0.005), 0.995) AS p FROM s) AS x)"""


@query("L1_features", KEYED.replace("SELECT a.id AS article_id, ", "SELECT a.id AS article_id, array_to_string(").replace(" AS features FROM", ", ',') AS features FROM"))
def features(t: Tables) -> DataFrame:
    return keyed(t).select("article_id", F.array_join(F.sort_array("features"), ",").alias("features"))


@query("L2_training_set", f"WITH r AS ({RATED}) SELECT r.user_id, r.article_id, s.score AS base, r.stars FROM r JOIN v_scores s ON s.user_id = r.user_id AND s.article_id = r.article_id AND s.version = 1")
def training_set(t: Tables) -> DataFrame:
    return train(t).drop("features")


@query("L3_fitted_weights")
def fitted_weights(t: Tables) -> DataFrame:
    return adjust.fit(train(t))


@query("L4_recommended", f"WITH {RECOMMENDED} SELECT user_id, article_id, base, score FROM rec")
def recommended(t: Tables) -> DataFrame:
    return adjust.recommended(scored_rows(t), weights(t)).select("user_id", "article_id", "base", "score")


@query("L5_contributions", f"""WITH {RECOMMENDED}, c AS (SELECT s.user_id, s.article_id, e.feature, rec.score - CAST(round(100 / (1 + exp(-(ln(p / (1 - p)) + s.ws - w.weight)))) AS INT) AS contribution FROM (SELECT *, least(greatest(base / 100, 0.005), 0.995) AS p FROM s) s
 JOIN rec ON rec.user_id = s.user_id AND rec.article_id = s.article_id JOIN e ON e.article_id = s.article_id JOIN w ON w.user_id = s.user_id AND w.feature = e.feature) SELECT * FROM c WHERE contribution <> 0""")
def contributions(t: Tables) -> DataFrame:
    return adjust.contributions(scored_rows(t), weights(t)).drop("place")


@query("L6_leave_one_out")
def leave_one_out(t: Tables) -> DataFrame:
    return adjust.leave_one_out(train(t))


def evaluation_report(t: Tables) -> DataFrame:
    """A row for each user and scorer key, the current one (version 1) first, then the candidate (version 2): its role, coverage, concordance as it is and corrected by leave-one-out,
    ratings by score band and stars, and whether the user has few labels of a kind."""
    rated = ratings(t)
    rows = saved(t.v_scores.join(rated.select("user_id", "article_id", "stars", "rated_at"), ["user_id", "article_id"]))
    by = ["user_id", "version"]
    covered = counts.coverage(rated.select("user_id", "article_id", "rated_at"), t.v_scores.select("user_id", "version", "article_id", "created_at"), ["version"])
    corrected = None
    for version in (1, 2):
        examples = rows.filter(F.col("version") == version).select("user_id", "article_id", F.col("score").alias("base"), "stars").join(keyed(t), "article_id")
        one = counts.concordance(adjust.leave_one_out(examples).join(rated.select("user_id", "article_id", "stars"), ["user_id", "article_id"]), ["user_id"], "prediction").withColumn("version", F.lit(version))
        corrected = one if corrected is None else corrected.unionByName(one)
    bands = counts.band_counts(rows, by).groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("band")).alias("low"), "stars", "n"))), lambda x: F.format_string("%d/%d:%d", -x["low"], x["stars"], x["n"])), " ").alias("bands"))
    kinds = counts.star_histogram(rated, ["user_id"]).select("user_id", ((F.col("positive") < 5) | (F.col("negative") < 5)).alias("few"))
    role = F.when(F.col("version") == 1, "current").when(F.col("version") == 2, "candidate").otherwise("trial")
    out = covered.join(counts.concordance(rows, by), by, "left").join(corrected.withColumnRenamed("concordance", "corrected"), by, "left").join(bands, by, "left").join(kinds, "user_id", "left")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.when(role == "current", 0).when(role == "candidate", 1).otherwise(2), "version")).cast("bigint")
    return out.select("user_id", place.alias("place"), "version", role.alias("role"), "labelled", "scored", "after_rating", "concordance", "corrected", "bands", "few")


@query("L7_evaluation_report")
def evaluation_reports(t: Tables) -> DataFrame:
    return evaluation_report(t)


@query("L7_plain_report", f"""WITH r AS ({RATED}), s AS (SELECT v.*, r.stars, r.rated_at FROM v_scores v JOIN r ON r.user_id = v.user_id AND r.article_id = v.article_id), k AS (SELECT DISTINCT user_id, version FROM v_scores),
 n AS (SELECT user_id, count(*) AS labelled, count(*) FILTER (WHERE stars >= 4) < 5 OR count(*) FILTER (WHERE stars <= 2) < 5 AS few FROM r GROUP BY 1), c AS (SELECT user_id, version, count(*) AS scored, count(*) FILTER (WHERE created_at > rated_at) AS after_rating FROM s GROUP BY 1, 2),
 p AS (SELECT x.user_id, x.version, avg(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0.0 END) AS concordance FROM s x JOIN s y ON y.user_id = x.user_id AND y.version = x.version AND x.stars > y.stars GROUP BY 1, 2),
 b AS (SELECT user_id, version, string_agg(concat(CAST(band AS STRING), '/', CAST(stars AS STRING), ':', CAST(n AS STRING)), ' ' ORDER BY band DESC, stars) AS bands FROM (SELECT user_id, version, least(score, 99) // 10 * 10 AS band, stars, count(*) AS n FROM s GROUP BY 1, 2, 3, 4) AS z GROUP BY 1, 2)
 SELECT k.user_id, row_number() OVER (PARTITION BY k.user_id ORDER BY k.version) AS place, k.version, CASE k.version WHEN 1 THEN 'current' ELSE 'candidate' END AS role, coalesce(n.labelled, 0) AS labelled, coalesce(c.scored, 0) AS scored, coalesce(c.after_rating, 0) AS after_rating, p.concordance, b.bands, n.few
 FROM k LEFT JOIN n ON n.user_id = k.user_id LEFT JOIN c ON c.user_id = k.user_id AND c.version = k.version LEFT JOIN p ON p.user_id = k.user_id AND p.version = k.version LEFT JOIN b ON b.user_id = k.user_id AND b.version = k.version""")
def plain_report(t: Tables) -> DataFrame:
    """The report without what SQL can't express, the corrected concordance."""
    return evaluation_report(t).drop("corrected")


@query("L8_review_due", f"WITH r AS ({RATED}), l AS (SELECT user_id, max(created_at) AS m FROM v_profile_versions GROUP BY 1), f AS (SELECT r.user_id, count(*) AS fresh FROM r JOIN l ON l.user_id = r.user_id WHERE r.rated_at > l.m GROUP BY 1), q AS (SELECT user_id, min(ts) AS requested_at FROM events WHERE event_id % 50 = 0 GROUP BY 1) SELECT coalesce(f.user_id, q.user_id) AS user_id, q.requested_at, coalesce(f.fresh, 0) AS fresh FROM f FULL JOIN q ON q.user_id = f.user_id WHERE q.requested_at IS NOT NULL OR f.fresh >= 3")
def review_due(t: Tables) -> DataFrame:
    none = t.v_profile_versions.select("user_id", F.col("created_at").alias("at")).limit(0)
    asked = t.events.filter("event_id % 50 = 0").select("user_id", F.col("ts").alias("requested_at"))
    return adjust.review_due(ratings(t), none, t.v_profile_versions, asked, 3)


@query("L9_auto_apply", f"WITH r AS ({RATED}) SELECT user_id, user_id % 3 / 20 >= 0.05 - 1e-9 AND count(*) FILTER (WHERE stars >= 4) >= 5 AND CASE WHEN count(*) FILTER (WHERE stars <= 2) > 0 THEN count(*) FILTER (WHERE stars <= 2) ELSE count(*) FILTER (WHERE stars = 3) END >= 5 AS apply FROM r GROUP BY user_id")
def auto_apply(t: Tables) -> DataFrame:
    kinds = counts.star_histogram(ratings(t), ["user_id"])
    comparison = kinds.select("user_id", F.lit(0.5).alias("current"), (0.5 + F.col("user_id") % 3 / 20).alias("candidate"))
    return adjust.auto_apply(comparison, kinds)


FEED = f"""WITH a AS ({ARTICLES}), {RECOMMENDED}, r AS ({REQUIRED}), v AS (SELECT u.user_id, d.article_id, d.id, d.relevant, d.created_at FROM v_digests d CROSS JOIN (SELECT DISTINCT user_id FROM v_scores) u WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.artifact_id = d.id AND NOT EXISTS (SELECT 1 FROM v_user_memberships m WHERE m.user_id = u.user_id AND m.membership_id = r.membership_id))),
 d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, article_id ORDER BY created_at DESC, id DESC) AS k FROM v) AS x WHERE k = 1), st AS ({RATED}),
 f AS (SELECT d.user_id, d.article_id AS id, a."at", t.story_id, rec.score, st.stars FROM d JOIN a ON a.id = d.article_id JOIN v_stories t ON t.article_id = d.article_id JOIN rec ON rec.user_id = d.user_id AND rec.article_id = d.article_id LEFT JOIN st ON st.user_id = d.user_id AND st.article_id = d.article_id WHERE d.relevant AND rec.score >= 50),
 g AS (SELECT *, row_number() OVER (PARTITION BY user_id, story_id ORDER BY score DESC NULLS LAST, "at" DESC, id DESC) AS s FROM f),
 h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC NULLS LAST, "at" DESC, id DESC) AS n FROM g WHERE s = 1 AND (stars IS NULL OR stars > 2)) SELECT user_id, id, story_id, score, stars FROM h WHERE n <= 200"""


def feed_rows(t: Tables) -> DataFrame:
    """What each user may see, with corrected scores: the newest viewable digest of every scored article. It is chosen once for each set of memberships."""
    newest, owned = newest_viewable(t).drop("id"), memberships(t)
    scores = adjust.recommended(scored_rows(t), weights(t)).select("user_id", "article_id", "score").join(owned, "user_id")
    rows = scores.join(newest, ["has", "article_id"]).join(ratings(t).select("user_id", "article_id", "stars"), ["user_id", "article_id"], "left")
    return rows.join(t.v_stories, "article_id").withColumnRenamed("article_id", "id").join(articles(t).select("id", "at"), "id")


@query("L10_ranked_feed", FEED)
def ranked_feed(t: Tables) -> DataFrame:
    """Entitlement, newest version, corrected score, visibility, story fold, rating filter, limit: in this order, for all users at once."""
    shown = feed_rows(t).filter(predicates.visible(50))
    return latest.fold_stories(shown, ["user_id"], latest.list_order(), predicates.rated("hide_low"), 200).select("user_id", "id", "story_id", "score", "stars")


@query("L11_article_detail", f"""WITH {RECOMMENDED}, a AS ({ARTICLES}), d AS (SELECT article_id, string_agg(CAST(id AS STRING), ',' ORDER BY created_at DESC, id DESC) AS versions FROM v_digests GROUP BY 1), m AS (SELECT story_id, count(*) AS members FROM v_stories GROUP BY 1),
 c AS (SELECT s.user_id, s.article_id, e.feature, rec.score - CAST(round(100 / (1 + exp(-(ln(p / (1 - p)) + s.ws - w.weight)))) AS INT) AS contribution FROM (SELECT *, least(greatest(base / 100, 0.005), 0.995) AS p FROM s) s
  JOIN rec ON rec.user_id = s.user_id AND rec.article_id = s.article_id JOIN e ON e.article_id = s.article_id JOIN w ON w.user_id = s.user_id AND w.feature = e.feature),
 cs AS (SELECT user_id, article_id, string_agg(concat(feature, ' ', CAST(contribution AS STRING)), ', ' ORDER BY abs(contribution) DESC, feature) AS contributions FROM c WHERE contribution <> 0 GROUP BY 1, 2),
 l AS (SELECT DISTINCT user_id AS a, article_id AS b FROM v_interactions WHERE stars >= 3), bw AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
 rs AS (SELECT story_id, string_agg(CAST(related AS STRING), ',' ORDER BY related) AS related FROM (SELECT DISTINCT x.story_id, y.story_id AS related FROM bw JOIN v_stories x ON x.article_id = bw.a JOIN v_stories y ON y.article_id = bw.b WHERE x.story_id <> y.story_id) AS q GROUP BY 1)
 SELECT rec.user_id, a.id, d.versions, rec.score, cs.contributions, t.story_id, m.members, rs.related FROM rec JOIN a ON a.id = rec.article_id LEFT JOIN d ON d.article_id = a.id LEFT JOIN cs ON cs.user_id = rec.user_id AND cs.article_id = rec.article_id
 JOIN v_stories t ON t.article_id = a.id JOIN m ON m.story_id = t.story_id LEFT JOIN rs ON rs.story_id = t.story_id""")
def article_detail(t: Tables) -> DataFrame:
    """Every scored article for every user: its versions, corrected score with what each feature contributes, story and related stories."""
    gathered = F.sort_array(F.collect_list(F.struct("created_at", "id")), asc=False)
    versions = t.v_digests.groupBy("article_id").agg(F.array_join(F.transform(gathered, lambda x: x["id"].cast("string")), ",").alias("versions"))
    parts = F.array_join(F.transform("contributions", lambda x: F.concat_ws(" ", x["feature"], x["contribution"].cast("string"))), ", ")
    scores = adjust.explained(scored_rows(t), weights(t)).select("user_id", "article_id", "score", F.when(F.size("contributions") > 0, parts).alias("contributions"))
    links = t.v_interactions.select(F.col("user_id").alias("a"), F.col("article_id").alias("b"), F.when(F.col("stars") >= 3, "related").otherwise("unrelated").alias("verdict"))
    related = stories.related(links, t.v_stories, articles(t)).groupBy("story_id").agg(F.array_join(F.transform(F.sort_array(F.collect_set("related")), lambda x: x.cast("string")), ",").alias("related"))
    members = t.v_stories.groupBy("story_id").agg(F.count("*").alias("members")).join(related, "story_id", "left")
    about = t.v_stories.join(members, "story_id").join(versions, "article_id", "left").join(t.v_articles.select(F.col("id").alias("article_id")), "article_id", "left_semi")
    # what an article has for all users comes last: it is wide, and goes through no shuffle beside users
    return scores.join(about, "article_id").select("user_id", F.col("article_id").alias("id"), "versions", "score", "contributions", "story_id", "members", "related")
