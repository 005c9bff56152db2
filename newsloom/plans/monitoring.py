"""Monitoring of sources and calls, and notes, over the tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import Tables
from ..functions.session import saved
from ..operators import monitor
from ..registry import query
from .windows import ARTICLES, articles

#: Each type of event of a tenth of the users is a source, read once a day; some of late find little or nothing.
RUNS = """SELECT source_id, fetched_at, CASE WHEN fetched_at >= TIMESTAMP '2024-01-28 00:00:00' AND source_id LIKE 'click%' THEN 0 WHEN fetched_at >= TIMESTAMP '2024-01-28 00:00:00' AND source_id LIKE 'view%' THEN 1 ELSE total + 9 END AS total
 FROM (SELECT concat(event_type, '-', CAST(user_id % 10 AS STRING)) AS source_id, date_trunc('day', ts) AS fetched_at, count(*) AS total FROM events GROUP BY 1, 2) AS q"""
#: What stands for the state of sources: the last event that is cheap was a success, the newest one is an error if it is dear.
STATES = "SELECT source_id, max(ts) FILTER (WHERE value < 100) AS last_success_at, CASE WHEN max(ts) FILTER (WHERE value >= 450) = max(ts) THEN 'failed' END AS last_error FROM ({}) AS q GROUP BY source_id"
SOURCES = "SELECT concat(event_type, '-', CAST(user_id % 10 AS STRING)) AS source_id, ts, value FROM events"
QUIET = "SELECT concat('u', CAST(user_id AS STRING)) AS source_id, ts, value FROM events"
#: Days of sources that one task takes.
DAYS_EACH = 50_000
SINCE, SINCE_SQL = datetime(2024, 1, 29, 12), "TIMESTAMP '2024-01-29 12:00:00'"


def anomalies_sql(runs: str, states: str) -> str:
    """Two steps, g and m, over runs and states."""
    return f"""k AS (SELECT r.*, row_number() OVER (PARTITION BY source_id ORDER BY fetched_at DESC) AS n FROM ({runs}) AS r WHERE source_id IN (SELECT source_id FROM ({states}) AS s WHERE last_success_at >= {SINCE_SQL})),
 g AS (SELECT source_id, max(total) FILTER (WHERE n = 1) AS latest, list_sort(list(total) FILTER (WHERE n BETWEEN 2 AND 21)) AS b FROM k GROUP BY 1),
 m AS (SELECT source_id, latest, CASE WHEN len(b) >= 8 THEN CAST(floor((b[(len(b) + 1) // 2] + b[len(b) // 2 + 1]) / 2) AS BIGINT) END AS median FROM g)"""


def sources(t: Tables) -> DataFrame:
    return t.events.select(F.concat("event_type", F.lit("-"), (F.col("user_id") % 10).cast("string")).alias("source_id"), "ts", "value")


def quiet_tables(t: Tables, each: int = DAYS_EACH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """States, runs and days of the users as sources, from one table of users and days. All three are dealt by source to as many tasks as that has rows for, which the joins and windows behind them keep: as
    bytes these rows are so few that Spark would make few tasks of any number of them."""
    until = F.timestamp_add("DAY", (F.col("user_id") % 15).cast("int"), F.lit(datetime(2024, 1, 12)))
    newest = lambda c: F.max(F.when(c, F.col("ts")))
    daily = t.events.groupBy("user_id", F.date_trunc("day", "ts").alias("fetched_at")).agg(
        F.count("*").alias("total"), newest(F.col("value") < 100).alias("good"), newest(F.col("value") >= 450).alias("bad"), F.max("ts").alias("last"), F.max(F.col("ts") < until).alias("seen")
    )
    daily = saved(daily.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source_id"), "fetched_at", "total", "good", "bad", "last", "seen"))
    tasks = -(-daily.count() // each) or 1
    dealt = lambda rows: rows.repartition(tasks, "source_id")
    states = dealt(daily.select("source_id", "good", "bad", "last")).groupBy("source_id").agg(F.max("good").alias("last_success_at"), F.when(F.max("bad") == F.max("last"), "failed").alias("last_error"))
    return states, dealt(daily.select("source_id", "fetched_at", "total")), dealt(daily.filter("seen").select("source_id", F.to_date("fetched_at").alias("day")))


def states(rows: DataFrame) -> DataFrame:
    """(source_id, last_success_at, last_error)."""
    newest = lambda c: F.max(F.when(c, F.col("ts")))
    return rows.groupBy("source_id").agg(newest(F.col("value") < 100).alias("last_success_at"), F.when(newest(F.col("value") >= 450) == F.max("ts"), "failed").alias("last_error"))


@query("N1_count_anomalies", f"WITH {anomalies_sql(RUNS, STATES.format(SOURCES))} SELECT source_id, CASE WHEN latest = 0 THEN 'empty' ELSE 'dropped' END AS kind, latest, median FROM m WHERE latest = 0 OR latest * 3 < median")
def count_anomalies(t: Tables) -> DataFrame:
    counted = sources(t).groupBy("source_id", F.date_trunc("day", "ts").alias("fetched_at")).agg(F.count("*").alias("total"))
    late = F.col("fetched_at") >= F.lit(datetime(2024, 1, 28))
    runs = counted.withColumn("total", F.when(late & F.col("source_id").startswith("click"), 0).when(late & F.col("source_id").startswith("view"), 1).otherwise(F.col("total") + 9))
    return monitor.count_anomalies(runs, states(sources(t)), F.lit(SINCE))


DAYS = "SELECT DISTINCT concat('u', CAST(user_id AS STRING)) AS source_id, CAST(ts AS DATE) AS day FROM events WHERE ts < TIMESTAMP '2024-01-12 00:00:00' + user_id % 15 * INTERVAL '1' DAY"
DAY_RUNS = "SELECT source_id, date_trunc('day', ts) AS fetched_at, count(*) AS total FROM (" + QUIET + ") AS q GROUP BY 1, 2"


@query("N2_stale_sources", f"""WITH {anomalies_sql(DAY_RUNS, STATES.format(QUIET))}, ok AS (SELECT source_id FROM ({STATES.format(QUIET)}) AS s WHERE last_success_at >= {SINCE_SQL} AND last_error IS NULL AND source_id NOT IN (SELECT source_id FROM m WHERE latest = 0 OR latest * 3 < median)),
 d AS ({DAYS}), l AS (SELECT source_id, max(day) AS last FROM d WHERE source_id IN (SELECT source_id FROM ok) GROUP BY 1),
 q AS (SELECT d.source_id, datediff('day', lag(day) OVER (PARTITION BY d.source_id ORDER BY day), day) AS gap FROM d JOIN l ON l.source_id = d.source_id WHERE datediff('day', day, last) <= 60), s AS (SELECT source_id, list_sort(list(gap)) AS b FROM q WHERE gap IS NOT NULL GROUP BY 1 HAVING count(*) >= 5),
 x AS (SELECT s.source_id, datediff('day', l.last, DATE '2024-01-31') AS idle, b[(len(b) + 1) // 2] + b[len(b) // 2 + 1] AS median2 FROM s JOIN l ON l.source_id = s.source_id) SELECT source_id, CAST(idle AS INT) AS idle, CAST(median2 AS INT) AS median2 FROM x WHERE 2 * idle > greatest(14, 3 * median2)""")
def stale_sources(t: Tables) -> DataFrame:
    """Each user is a source, whose articles end at some day."""
    own, runs, days = quiet_tables(t)
    return monitor.stale(days, own, monitor.count_anomalies(runs, own, F.lit(SINCE)), F.lit(SINCE), F.lit("2024-01-31").cast("date"))


@query("N3_failing_sources", "SELECT user_id AS source_id, arg_max(props, event_id) AS error FROM events WHERE event_type = 'error' GROUP BY user_id")
def failing_sources(t: Tables) -> DataFrame:
    states = t.events.groupBy(F.col("user_id").alias("source_id")).agg(F.max_by(F.when(F.col("event_type") == "error", F.col("props")), F.when(F.col("event_type") == "error", F.col("event_id"))).alias("error"))
    return monitor.failing(states)


@query("N4_failed_last_call", """SELECT backend, "at", id FROM (SELECT *, row_number() OVER (PARTITION BY backend ORDER BY "at" DESC, id DESC) AS k FROM (SELECT concat(backend, CAST(id % 40 AS STRING)) AS backend, "at", id, ok FROM v_calls) c WHERE "at" >= TIMESTAMP '1995-01-01 00:00:00') AS x WHERE k = 1 AND NOT ok""")
def failed_last_call(t: Tables) -> DataFrame:
    calls = t.v_calls.withColumn("backend", F.concat("backend", (F.col("id") % 40).cast("string")))
    return monitor.failed_last(calls, F.lit(datetime(1995, 1, 1)))


@query("N5_run_counters", "SELECT event_type AS source_id, CAST(ts AS DATE) AS run, count(*) AS total, count(*) FILTER (WHERE value > 100) AS matched, count(*) FILTER (WHERE value > 100 AND event_id % 3 = 0) AS new, count(*) FILTER (WHERE value > 100 AND event_id % 3 <> 0) AS duplicate, true AS sound FROM events GROUP BY 1, 2")
def run_counters(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("event_type").alias("source_id"), F.to_date("ts").alias("run"), (F.col("value") > 100).alias("matched"), (F.col("event_id") % 3 == 0).alias("fresh"))
    return monitor.run_counters(rows)


@query("N6_freshness", f"""WITH a AS ({ARTICLES}), n AS (SELECT source_id, max("at") AS newest FROM a GROUP BY 1), c AS (SELECT concat('src', CAST(r_regionkey AS STRING)) AS source_id, CAST(r_regionkey AS BIGINT) AS place FROM region UNION ALL SELECT 'never', 99) SELECT coalesce(c.source_id, n.source_id) AS source_id, place, newest FROM c FULL JOIN n ON n.source_id = c.source_id""")
def freshness(t: Tables) -> DataFrame:
    configured = t.region.select(F.concat(F.lit("src"), F.col("r_regionkey").cast("string")).alias("source_id"), F.col("r_regionkey").cast("bigint").alias("place"))
    never = configured.limit(1).select(F.lit("never").alias("source_id"), F.lit(99).cast("bigint").alias("place"))
    return monitor.freshness(configured.unionByName(never), articles(t))


@query("O1_comments", "SELECT event_id, user_id, ts FROM events WHERE event_id % 4 = 0 OR user_id = 3")
def comments(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "ts", (F.col("event_id") % 4 == 0).alias("public"))
    return monitor.shown_comments(rows, F.lit(3)).select("event_id", "user_id", "ts")


@query("O2_report_inbox", "SELECT i.event_id, a.title, i.event_type AS kind FROM v_interactions i LEFT JOIN v_articles a ON a.id = i.article_id WHERE i.event_type = 'error'")
def report_inbox(t: Tables) -> DataFrame:
    reports = t.v_interactions.select("event_id", "article_id", F.col("event_type").alias("kind"), F.lit("open").alias("status"))
    return monitor.inbox(reports, t.v_articles.select(F.col("id").alias("article_id"), "title"), "open", "error").select("event_id", "title", "kind")
