"""Joins and text search over the tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import Tables
from ..functions.session import shared_folder
from ..operators import joins, search
from ..registry import query
from .windows import ARTICLES, articles


@query("C1_inner_join", "SELECT s.user_id, s.artifact_id, s.score, a.source_id FROM v_scores s JOIN v_articles a ON a.id = s.article_id WHERE s.version = 1")
def inner_join(t: Tables) -> DataFrame:
    return t.v_scores.filter("version = 1").join(t.v_articles.select(F.col("id").alias("article_id"), "source_id"), "article_id").select("user_id", "artifact_id", "score", "source_id")


@query("C2_left_join", "SELECT a.id, d.id AS digest_id FROM v_articles a LEFT JOIN v_digests d ON d.article_id = a.id AND d.model = 'm1'")
def left_join(t: Tables) -> DataFrame:
    return t.v_articles.select("id").join(t.v_digests.filter("model = 'm1'").select(F.col("article_id").alias("id"), F.col("id").alias("digest_id")), "id", "left")


@query("C3_semi_join", "SELECT id FROM v_articles a WHERE EXISTS (SELECT 1 FROM v_contents c WHERE c.article_id = a.id AND c.kind = 'body')")
def semi_join(t: Tables) -> DataFrame:
    return t.v_articles.select("id").join(t.v_contents.filter("kind = 'body'").select(F.col("article_id").alias("id")), "id", "left_semi")


@query("C4_anti_join", "SELECT id FROM v_articles a WHERE NOT EXISTS (SELECT 1 FROM v_digests d WHERE d.article_id = a.id)")
def anti_join(t: Tables) -> DataFrame:
    return t.v_articles.select("id").join(t.v_digests.select(F.col("article_id").alias("id")), "id", "left_anti")


@query("C5_group_members", f"""WITH a AS ({ARTICLES}), m AS (SELECT t.story_id, a.id, a."at", a.source_id FROM a JOIN v_stories t ON t.article_id = a.id)
 SELECT x.id, coalesce(string_agg(y.source_id, ',' ORDER BY y."at", y.id), '') AS others FROM m x LEFT JOIN m y ON y.story_id = x.story_id AND y.id <> x.id GROUP BY x.id""")
def group_members(t: Tables) -> DataFrame:
    members = articles(t).join(t.v_stories.withColumnRenamed("article_id", "id"), "id").select(F.col("story_id").alias("group"), "id", "at", F.col("source_id").alias("source"))
    return joins.others_in_group(members).select("id", F.array_join("others", ",").alias("others"))


@query("C6_requested_ids", "WITH r AS (SELECT user_id AS request, article_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM v_interactions WHERE event_type = 'click') SELECT r.request, r.place, a.id, a.source_id FROM r JOIN v_articles a ON a.id = r.article_id")
def requested_ids(t: Tables) -> DataFrame:
    lists = t.v_interactions.filter("event_type = 'click'").groupBy(F.col("user_id").alias("request")).agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "article_id"))), lambda x: x["article_id"]).alias("ids"))
    return joins.requested(t.v_articles.select("id", "source_id"), lists, "id").select("request", F.col("place").cast("bigint").alias("place"), "id", "source_id")


@query("C7_open_version", """SELECT i.event_id, p.version FROM v_interactions i JOIN v_profile_versions p ON p.user_id = i.user_id AND p.created_at <= i.ts AND (p.retired_at IS NULL OR i.ts < p.retired_at)
 WHERE i.event_type = 'view' AND NOT EXISTS (SELECT 1 FROM v_version_evidence e WHERE e.user_id = p.user_id AND e.created_at = p.created_at AND e.article_id = i.article_id)""")
def open_version(t: Tables) -> DataFrame:
    views = t.v_interactions.filter("event_type = 'view'").select("event_id", "user_id", "article_id", "ts")
    return joins.during(views, t.v_profile_versions, ["user_id"], "ts", version_evidence(t)).select("event_id", F.col("version").cast("bigint").alias("version"))


def version_evidence(t: Tables) -> DataFrame:
    """(user_id, version, article_id): what the versions rest on."""
    return t.v_version_evidence.join(t.v_profile_versions.select("user_id", "version", "created_at"), ["user_id", "created_at"]).select("user_id", "version", "article_id")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def mention_sql(text: str) -> str:
    """Whether g.source stands in a text: ASCII letters of either case but for abbreviations, a plural may follow."""
    plain, abbreviation = f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))", "regexp_matches(g.source, '^[A-Z0-9]*[A-Z][A-Z0-9]*$')"
    fold = lambda x: f"CASE WHEN {abbreviation} THEN {x} ELSE translate({x}, '{UPPER}', '{LOWER}') END"
    return f"regexp_matches({fold(plain)}, concat('(^|[^A-Za-z0-9])', regexp_escape({fold('g.source')}), '(es|s)?($|[^A-Za-z0-9])'))"


@query("C9_glossary_hits", f"SELECT d.doc_id AS id, g.term_id FROM documents d JOIN (SELECT DISTINCT term_id, source FROM v_glossary_sources) g ON {mention_sql('d.text')} GROUP BY 1, 2")
def glossary_hits(t: Tables) -> DataFrame:
    """Words and pairs of words of all languages, as they stand."""
    return joins.glossary_hits(t.documents.select(F.col("doc_id").alias("id"), "text"), t.v_glossary_sources)


@query("C10_weight_lookup", "SELECT s.user_id, s.artifact_id, round(coalesce(sum(w.weight), 0), 9) AS weight_sum FROM v_scores s LEFT JOIN v_digest_topics d ON d.artifact_id = s.artifact_id LEFT JOIN (SELECT DISTINCT concat('t', CAST(pos * 2 AS STRING)) AS feature, user_id, weight - 0.5 AS weight FROM v_profile_terms) w ON w.feature = d.topic AND w.user_id = s.user_id WHERE s.version = 1 GROUP BY s.user_id, s.artifact_id")
def weight_lookup(t: Tables) -> DataFrame:
    weights = t.v_profile_terms.select("user_id", F.concat(F.lit("t"), (F.col("pos") * 2).cast("string")).alias("feature"), (F.col("weight") - 0.5).alias("weight")).distinct()
    topics = t.v_digest_topics.groupBy("artifact_id").agg(F.collect_list("topic").alias("features"))
    rows = t.v_scores.filter("version = 1").select("user_id", "artifact_id").join(topics, "artifact_id", "left")
    return joins.weight_sums(rows, weights, ["user_id", "artifact_id"]).select("user_id", "artifact_id", F.round("weight_sum", 9).alias("weight_sum"))


# --- I: search --------------------------------------------------------------------------------------------------------

DOCS = """SELECT id AS article_id, CAST(NULL AS BIGINT) AS artifact_id, 'title' AS origin, title AS text FROM v_articles UNION ALL SELECT article_id, NULL, kind, text FROM v_contents
 UNION ALL SELECT article_id, id, 'digest', concat_ws(chr(10), title_x, summary_x) FROM v_digests"""


def docs(t: Tables) -> DataFrame:
    return search.documents(t.v_articles, t.v_contents, t.v_digests)


@query("I1_search_documents", DOCS)
def search_documents(t: Tables) -> DataFrame:
    return docs(t)


@query("I2_term_match", f"WITH d AS ({DOCS}) SELECT DISTINCT x.article_id FROM d x WHERE contains(lower(x.text), 'tion the') AND EXISTS (SELECT 1 FROM d y WHERE y.article_id = x.article_id AND contains(lower(y.text), 'of'))")
def term_match(t: Tables) -> DataFrame:
    return search.matching(docs(t), ["Tion the", "of"])


#: Buckets of the index: few, as Spark lists the folders of more by a job of its own; large tables take more.
BUCKETS = 32


@query("I3_trigram_postings", "SELECT doc_id FROM documents WHERE contains(lower(text), 'nguage') OR contains(lower(text), 'thonthe')")
def trigram_postings(t: Tables) -> DataFrame:
    """The index of a table lives on in the shared folder: the first call builds it, later ones take up what has changed."""
    index = search.TrigramIndex(t.spark, f"{shared_folder(t.spark)}/trigrams-{BUCKETS}-{hashlib.md5(t.sf_dir.encode()).hexdigest()}", BUCKETS)
    texts = t.documents.select("doc_id", "text")
    index.update(texts)
    return index.search(texts, "thonthe", "nguage")


@query("I4_search_result", f"""WITH d AS ({DOCS}), a AS ({ARTICLES}), m AS (SELECT DISTINCT article_id FROM d WHERE contains(lower(text), 'tion the'))
 SELECT user_id, id, score FROM (SELECT s.user_id, a.id, s.score, row_number() OVER (PARTITION BY s.user_id ORDER BY s.score DESC NULLS LAST, a."at" DESC, a.id DESC) AS k FROM a JOIN m ON m.article_id = a.id JOIN v_scores s ON s.article_id = a.id AND s.version = 1 WHERE a.lang = 'en') AS x WHERE k <= 50""")
def search_result(t: Tables) -> DataFrame:
    rows = articles(t).join(t.v_scores.filter("version = 1").select("user_id", F.col("article_id").alias("id"), "score"), "id")
    return search.result(rows, search.matching(docs(t), ["tion the"]), F.col("lang") == "en", ["user_id"], limit=50).select("user_id", "id", "score")


@query("I5_topic_facets", "SELECT t.facet, t.name, count(*) AS uses FROM v_topics t JOIN v_digest_topics d ON d.topic = t.name GROUP BY t.facet, t.name")
def topic_facets(t: Tables) -> DataFrame:
    return search.facets(t.v_topics, t.v_digest_topics)


