"""The driver tables seen as the tables of the article model: one SQL text for each view, run by Spark here and by DuckDB in the oracles."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "v_articles": """SELECT doc_id AS id, source AS source_id, concat('https://', source, '.example/', CAST(doc_id AS STRING)) AS url,
        substring(text, 1, 60) AS title, lang,
        CASE WHEN doc_id % 10 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '37' MINUTE END AS published_at,
        TIMESTAMP '2024-01-01 00:30:00' + doc_id * INTERVAL '37' MINUTE AS fetched_at FROM documents""",
    "v_contents": """SELECT doc_id AS id, doc_id AS article_id, CASE WHEN doc_id % 4 = 0 THEN 'lead' ELSE 'body' END AS kind,
        CASE WHEN doc_id % 11 = 0 THEN 1 END AS access_membership_id, text FROM documents""",
    "v_digests": """SELECT doc_id * 10 + v AS id, doc_id AS article_id, concat('m', CAST(v AS STRING)) AS model,
        TIMESTAMP '2024-02-01 00:00:00' + (doc_id + 5 * v) * INTERVAL '1' MINUTE AS created_at,
        substring(text, 1, 40) AS title_x, substring(text, 1, 300) AS summary_x, doc_id % 5 <> 0 AS relevant
        FROM documents CROSS JOIN (SELECT 1 AS v UNION ALL SELECT 2 AS v) AS n WHERE doc_id % 7 <> 0 AND (v = 1 OR doc_id % 3 = 0)""",
    "v_digest_topics": """SELECT DISTINCT id AS artifact_id, topic FROM (
        SELECT doc_id * 10 + 1 AS id, concat('t', CAST(doc_id % 12 AS STRING)) AS topic FROM documents UNION ALL
        SELECT doc_id * 10 + 1 AS id, concat('t', CAST(n_chars % 12 AS STRING)) AS topic FROM documents) AS x""",
    "v_interactions": """SELECT event_id, ts, user_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS article_id,
        CAST(floor(CASE WHEN value > 499 THEN 499 ELSE value END / 100) AS INT) + 1 AS stars FROM events""",
    "v_user_memberships": "SELECT DISTINCT user_id, 1 AS membership_id FROM events WHERE user_id % 4 = 0",
    "v_profile_terms": """SELECT u.user_id, p.pos, p.kind, CAST(p.weight AS DOUBLE) AS weight, (u.user_id * 3 + p.pos * 7) % 500 AS vec_id
        FROM (SELECT DISTINCT user_id FROM events) AS u CROSS JOIN (SELECT 0 AS pos, 'interest' AS kind, 1.0 AS weight
        UNION ALL SELECT 1, 'interest', 0.6 UNION ALL SELECT 2, 'interest', 0.3 UNION ALL SELECT 3, 'exclude', 1.0) AS p""",
    "v_fetch_runs": """SELECT event_type AS source_id, date_trunc('day', ts) AS fetched_at, count(*) AS total, count(DISTINCT user_id) AS matched
        FROM events GROUP BY event_type, date_trunc('day', ts)""",
    "v_calls": "SELECT o_orderkey AS id, o_orderdate AS at, o_orderpriority AS backend, o_orderstatus <> 'F' AS ok, o_totalprice AS credits FROM orders",
    "v_outcomes": "SELECT event_id, ts AS at, user_id AS item_id, event_type = 'error' AS failed, value > 480 AS permanent FROM events",
    "v_glossary_sources": "SELECT item_id * 2 + n AS term_id, CASE WHEN n = 0 THEN split_part(text, ' ', 1) ELSE concat(split_part(text, ' ', 2), ' ', split_part(text, ' ', 3)) END AS source FROM benchmark CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 AS n) AS k",
    "v_url_candidates": "SELECT page_id, url, concat('page ', CAST(page_id AS STRING)) AS title FROM pages",
    # topics, and scores by a rule of the ids, for all users: of the articles that they act on and of one more for each event
    "v_topics": "SELECT DISTINCT topic AS name, CASE WHEN CAST(substring(topic, 2) AS INT) % 2 = 0 THEN 'field' ELSE 'place' END AS facet FROM (SELECT concat('t', CAST(doc_id % 16 AS STRING)) AS topic FROM documents) AS x",
    "v_topic_aliases": "SELECT concat('alias ', name) AS alias, name FROM (SELECT DISTINCT concat('t', CAST(doc_id % 5 AS STRING)) AS name FROM documents) AS x",
    "v_scores": """SELECT user_id, article_id * 10 + 1 AS artifact_id, article_id, v AS version, CAST((article_id * 7 + user_id * 13 + v * 5) % 101 AS INT) AS score,
        TIMESTAMP '2024-01-20 00:00:00' + (article_id + v) * INTERVAL '1' MINUTE AS created_at
        FROM (SELECT DISTINCT user_id, article_id FROM (SELECT user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS article_id FROM events
            UNION ALL SELECT user_id, event_id * 31 % n AS article_id FROM events CROSS JOIN (SELECT count(*) AS n FROM documents) AS c) AS p) AS u
        CROSS JOIN (SELECT 1 AS v UNION ALL SELECT 2 AS v) AS n WHERE article_id % 7 <> 0 AND (v = 1 OR (article_id + user_id) % 2 = 0)""",
    # translated titles, of articles without a digest above all
    "v_title_translations": """SELECT doc_id * 10 + 4 + v AS id, doc_id AS article_id, TIMESTAMP '2024-02-03 00:00:00' + v * INTERVAL '1' MINUTE AS created_at,
        CASE WHEN v = 2 AND doc_id % 5 = 0 THEN '  ' ELSE concat('translated ', CAST(v AS STRING), ' ', substring(text, 1, 30)) END AS title_x
        FROM documents CROSS JOIN (SELECT 1 AS v UNION ALL SELECT 2 AS v) AS n WHERE doc_id % 7 = 0 OR doc_id % 13 = 0""",
    "v_stories": "SELECT doc_id AS article_id, doc_id - doc_id % 3 AS story_id FROM documents",
    "v_profile_versions": """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY day) AS version, day AS created_at, lead(day) OVER (PARTITION BY user_id ORDER BY day) AS retired_at
        FROM (SELECT DISTINCT user_id, date_trunc('week', ts) AS day FROM events) AS x""",
    # what a version rests on: articles of the purchases of the week before it
    "v_version_evidence": """SELECT DISTINCT v.user_id, v.created_at, e.article_id FROM (SELECT DISTINCT user_id, date_trunc('week', ts) AS created_at FROM events) AS v
        JOIN (SELECT user_id, ts, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS article_id FROM events WHERE event_type = 'purchase') AS e
        ON e.user_id = v.user_id AND e.ts < v.created_at AND e.ts >= v.created_at - INTERVAL '7' DAY""",
}

_WORD = re.compile(r"\b(v_\w+)\b")


class Tables:
    """Driver tables and views of one folder by name: tables.documents, tables.v_articles."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        sql = VIEWS[name]
        used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", sql)]
        for t in used:
            sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
        return self.spark.sql(sql, **{t: getattr(self, t) for t in used})


def oracle(body: str) -> str:
    """DuckDB SQL with the views that the body names in front of it."""
    body = body.strip()
    ctes = [f"{v} AS ({VIEWS[v]})" for v in dict.fromkeys(_WORD.findall(body)) if v in VIEWS]
    if not ctes:
        return body
    return f"WITH {', '.join(ctes)}" + (", " + body[5:] if body[:5].upper() == "WITH " else " " + body)
