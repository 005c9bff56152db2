"""Story grouping over the documents. Their text is alphabetic, so thresholds are high."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import Tables
from ..functions.session import saved, written
from ..functions.text import bigrams, comparable
from ..operators import stories
from ..registry import query
from .basics import required
from .windows import ARTICLES, articles

LEAST = 0.95
TEXTS = """SELECT a.id, coalesce(d.s, l.title_x, CASE WHEN a.lang = 'en' THEN a.title END) AS text FROM v_articles a
 LEFT JOIN (SELECT article_id, concat_ws(chr(10), title_x, summary_x) AS s, row_number() OVER (PARTITION BY article_id ORDER BY created_at DESC, id DESC) AS k FROM v_digests WHERE article_id % 11 <> 0) d ON d.article_id = a.id AND d.k = 1
 LEFT JOIN (SELECT article_id, title_x, row_number() OVER (PARTITION BY article_id ORDER BY created_at DESC, id DESC) AS k FROM v_title_translations) l ON l.article_id = a.id AND l.k = 1
 WHERE coalesce(d.s, l.title_x, CASE WHEN a.lang = 'en' THEN a.title END) IS NOT NULL"""
TFIDF = f"""WITH x AS ({TEXTS}), p AS (SELECT id, lower(regexp_replace(text, '[^\\p{{L}}\\p{{M}}\\p{{N}}]', '', 'g')) AS s FROM x), g AS (SELECT id, substring(s, CAST(k AS INT), 2) AS gram FROM p, range(1, length(s)) AS r(k)),
 tf AS (SELECT id, gram, count(*) AS tf FROM g GROUP BY id, gram), df AS (SELECT gram, count(*) AS df FROM tf GROUP BY gram),
 w AS (SELECT id, tf.gram, tf * (ln(((SELECT count(*) FROM x) + 1) / (df + 1)) + 1) AS w FROM tf JOIN df ON df.gram = tf.gram), v AS (SELECT id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM w)"""
PAIRS = TFIDF + f""", a AS ({ARTICLES}), c AS (SELECT l.id AS target, r.id, round(sum(l.weight * r.weight), 9) AS similarity FROM v l JOIN v r ON l.gram = r.gram AND l.id <> r.id JOIN a la ON la.id = l.id JOIN a ra ON ra.id = r.id
 WHERE abs(epoch(la."at") - epoch(ra."at")) <= 21 * 86400 GROUP BY l.id, r.id HAVING round(sum(l.weight * r.weight), 9) >= {LEAST})"""


def texts(t: Tables) -> DataFrame:
    """The comparison texts of all articles: titles and summaries of public digests, else translated titles, else English titles."""
    public = t.v_digests.select("id").join(required(t).select(F.col("artifact_id").alias("id")), "id", "left_anti")
    return stories.comparison_texts(t.v_articles, t.v_digests, public, t.v_title_translations, "en")


def pooled(t: Tables) -> DataFrame:
    """The texts of the pool around a batch, here that of all articles."""
    timed = texts(t).join(articles(t).select("id", "at"), "id")
    return stories.pool(timed, timed)


def pairs(t: Tables) -> DataFrame:
    return stories.similar_texts(pooled(t), saved, LEAST)


@query("J1_comparison_texts", TEXTS)
def comparison_texts(t: Tables) -> DataFrame:
    return texts(t)


@query("J2_pool", f"""WITH a AS ({ARTICLES}), s AS (SELECT min("at") - INTERVAL '1' DAY AS f, max("at") + INTERVAL '1' DAY AS u FROM a WHERE id BETWEEN 50 AND 60) SELECT a.id FROM a, s WHERE a."at" BETWEEN s.f AND s.u""")
def pool(t: Tables) -> DataFrame:
    rows = articles(t)
    return stories.pool(rows, rows.filter("id between 50 and 60"), 1).select("id")


@query("D17_term_statistics", TFIDF + " SELECT gram, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM tf GROUP BY gram")
def term_statistics(t: Tables) -> DataFrame:
    tf = texts(t).select("id", F.explode(bigrams(comparable(F.col("text")))).alias("gram")).groupBy("id", "gram").agg(F.count("*").alias("n"))
    return tf.groupBy("gram").agg(F.count("*").alias("df"), F.sum("n").alias("tf"))


@query("J3_tf_idf", TFIDF + " SELECT id, gram, round(weight, 8) AS weight FROM v")
def tf_idf(t: Tables) -> DataFrame:
    return stories.tf_idf(pooled(t)).select("id", "gram", F.round("weight", 8).alias("weight"))


@query("C8_similar_pairs", PAIRS + " SELECT target, id, round(similarity, 6) AS similarity FROM c")
def similar_pairs(t: Tables) -> DataFrame:
    return pairs(t).withColumn("similarity", F.round("similarity", 6))


@query("H15_sparse_cosine", PAIRS + " SELECT least(target, id) AS a, greatest(target, id) AS b, round(max(similarity), 6) AS cosine FROM c GROUP BY 1, 2")
def sparse_cosine(t: Tables) -> DataFrame:
    return pairs(t).groupBy(F.least("target", "id").alias("a"), F.greatest("target", "id").alias("b")).agg(F.round(F.max("similarity"), 6).alias("cosine"))


CANDIDATES = PAIRS + """, q AS (SELECT c.target, s.story_id AS unit, max(c.similarity) AS similarity, max(CASE WHEN b.source_id <> o.source_id THEN 1 ELSE 0 END) AS other FROM c JOIN v_stories s ON s.article_id = c.id JOIN v_stories own ON own.article_id = c.target JOIN a b ON b.id = c.id JOIN a o ON o.id = c.target WHERE s.story_id <> own.story_id GROUP BY 1, 2),
 k AS (SELECT *, row_number() OVER (PARTITION BY target, other ORDER BY similarity DESC, unit) AS r FROM q), best AS (SELECT target, unit, similarity, other = 1 AS other_source FROM k WHERE r <= CASE WHEN other = 1 THEN 5 ELSE 3 END)"""


def candidates(t: Tables) -> DataFrame:
    return stories.candidates(pairs(t), t.v_articles, t.v_stories)


@query("J4_candidates", CANDIDATES + " SELECT target, unit, round(similarity, 6) AS similarity, other_source FROM best")
def story_candidates(t: Tables) -> DataFrame:
    return candidates(t).select("target", "unit", F.round("similarity", 6).alias("similarity"), "other_source")


@query("J5_imported_judgments", CANDIDATES + " SELECT b.target AS a, s.article_id AS b, CASE WHEN b.unit % 2 = 0 THEN 'same' ELSE 'unrelated' END AS verdict FROM best b JOIN v_stories s ON s.story_id = b.unit")
def imported_judgments(t: Tables) -> DataFrame:
    cand = saved(candidates(t))
    judged = cand.filter("unit % 2 = 0").select("target", F.col("unit").alias("id"), F.lit("same").alias("verdict"))
    return stories.import_judgments(cand, judged, t.v_stories)[0]


@query("J6_automatic_verdicts", CANDIDATES + " SELECT target, unit, CASE WHEN similarity >= 0.99 THEN 'same' WHEN similarity >= 0.97 THEN 'related' ELSE 'unrelated' END AS verdict FROM best")
def automatic_verdicts(t: Tables) -> DataFrame:
    return stories.judge(candidates(t), 0.99, 0.97).select("target", "unit", "verdict")


def grouped(t: Tables) -> DataFrame:
    found = saved(pairs(t).select(F.col("target").alias("a"), F.col("id").alias("b"), "similarity"))
    return stories.groups(found, found.filter("(a + b) % 7 = 0").select("a", "b"), written)


@query("J7_groups")
def story_groups(t: Tables) -> DataFrame:
    return grouped(t)


@query("J8_latest_links", """WITH l AS (SELECT user_id AS a, article_id AS b, CASE WHEN stars >= 4 THEN 'same' ELSE 'unrelated' END AS verdict, date_trunc('day', ts) AS judged_at FROM v_interactions),
 n AS (SELECT a, b, verdict FROM (SELECT *, max(judged_at) OVER (PARTITION BY a) AS m FROM l) AS x WHERE judged_at = m AND a <> b) SELECT least(a, b) AS a, greatest(a, b) AS b, CASE WHEN bool_or(verdict <> 'same') THEN 'apart' ELSE 'same' END AS verdict FROM n GROUP BY 1, 2""")
def latest_links(t: Tables) -> DataFrame:
    links = t.v_interactions.select(F.col("user_id").alias("a"), F.col("article_id").alias("b"), F.when(F.col("stars") >= 4, "same").otherwise("unrelated").alias("verdict"), F.date_trunc("day", "ts").alias("judged_at"))
    same, apart = stories.same_and_apart(stories.latest_judgments(links))
    return same.withColumn("verdict", F.lit("same")).unionByName(apart.withColumn("verdict", F.lit("apart")))


@query("J9_group_delta", "SELECT article_id, article_id - article_id % 2 AS story_id FROM v_stories WHERE article_id % 5 <> 0 AND story_id <> article_id - article_id % 2 UNION ALL SELECT article_id, article_id FROM v_stories WHERE article_id % 5 = 0 AND story_id <> article_id")
def group_delta(t: Tables) -> DataFrame:
    after = t.v_stories.filter("article_id % 5 <> 0").select("article_id", (F.col("article_id") - F.col("article_id") % 2).alias("story_id"))
    return stories.changed(t.v_stories, after)


@query("J10_related_stories", f"""WITH a AS ({ARTICLES}), l AS (SELECT DISTINCT user_id AS a, article_id AS b FROM v_interactions WHERE stars >= 3), w AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
 p AS (SELECT DISTINCT x.story_id, y.story_id AS related FROM w JOIN v_stories x ON x.article_id = w.a JOIN v_stories y ON y.article_id = w.b WHERE x.story_id <> y.story_id),
 f AS (SELECT s.story_id AS related, count(*) - 1 AS others, arg_max(a.id, struct_pack(t := a."at", i := a.id)) AS newest FROM v_stories s JOIN a ON a.id = s.article_id GROUP BY 1) SELECT p.story_id, p.related, f.others, f.newest FROM p JOIN f ON f.related = p.related""")
def related_stories(t: Tables) -> DataFrame:
    links = t.v_interactions.select(F.col("user_id").alias("a"), F.col("article_id").alias("b"), F.when(F.col("stars") >= 3, "related").otherwise("unrelated").alias("verdict"))
    return stories.related(links, t.v_stories, articles(t))


@query("J11_after_delete", "SELECT article_id, min(article_id) OVER (PARTITION BY story_id) AS story_id FROM v_stories WHERE article_id % 4 <> 0")
def after_delete(t: Tables) -> DataFrame:
    return stories.after_delete(t.v_stories, t.v_stories.filter("article_id % 4 = 0").select("article_id"))
