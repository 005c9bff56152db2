"""Warnings about sources and calls, and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .latest import median_floor


def count_anomalies(runs: DataFrame, states: DataFrame, since: Column, history: int = 20, least: int = 8) -> DataFrame:
    """(source_id, kind, latest, median) of sources whose newest run (source_id, fetched_at, total) found nothing (empty), or less than a third of the median of up to so many earlier
    runs (dropped). Only sources that were read without error since then (states: source_id, last_success_at, last_error) can be judged by their counts."""
    alive = states.filter(F.col("last_success_at") >= since).select("source_id")
    newest = Window.partitionBy("source_id").orderBy(F.col("fetched_at").desc())
    recent = runs.join(alive, "source_id", "left_semi").withColumn("_turn", F.row_number().over(newest)).filter(F.col("_turn") <= history + 1)
    rows = recent.groupBy("source_id").agg(F.max(F.when(F.col("_turn") == 1, F.col("total"))).alias("latest"), F.collect_list(F.when(F.col("_turn") > 1, F.col("total"))).alias("_before"))
    rows = rows.withColumn("median", F.when(F.size("_before") >= least, median_floor(F.col("_before"))))
    kind = F.when(F.col("latest") == 0, "empty").when(F.col("latest") * 3 < F.col("median"), "dropped")
    return rows.select("source_id", kind.alias("kind"), "latest", "median").filter("kind is not null")


def stale(days: DataFrame, states: DataFrame, flagged: DataFrame, since: Column, today: Column, window: int = 60, least: int = 5, idle: int = 14) -> DataFrame:
    """(source_id, idle, median2) of sources (source_id, day) that were quiet for long: among the distinct days of so many before the newest there are enough gaps, and twice the idle days are more
    than idle and six times the median gap. Left out are sources that weren't read since then or fail now (states), which says why they are quiet, and those flagged for their counts
    (source_id)."""
    alive = states.filter((F.col("last_success_at") >= since) & F.col("last_error").isNull()).select("source_id").join(flagged.select("source_id"), "source_id", "left_anti")
    own = Window.partitionBy("source_id")
    # the newest day stands beside each day: joining it would do all the steps before it again in the same task
    days = days.join(alive, "source_id", "left_semi").select("source_id", "day").distinct().withColumn("_last", F.max("day").over(own)).filter(F.datediff("_last", "day") <= window)
    apart = days.withColumn("gap", F.datediff("day", F.lag("day").over(own.orderBy("day"))))
    found = apart.groupBy("source_id").agg(F.collect_list("gap").alias("_gaps"), F.max("_last").alias("_last")).filter(F.size("_gaps") >= least)
    s, n = F.sort_array("_gaps"), F.size("_gaps")
    twice = F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))
    rows = found.withColumn("idle", F.datediff(today, "_last")).withColumn("median2", twice)
    return rows.filter(2 * F.col("idle") > F.greatest(F.lit(idle), 3 * F.col("median2"))).select("source_id", "idle", "median2")


def failing(states: DataFrame) -> DataFrame:
    return states.filter("error is not null")


def failed_last(calls: DataFrame, since: Column) -> DataFrame:
    """Backends whose newest call since then failed, with its time."""
    last = calls.filter(F.col("at") >= since).groupBy("backend").agg(F.max(F.struct("at", "id", "ok")).alias("c"))
    return last.filter("not c.ok").select("backend", "c.at", "c.id")


def run_counters(rows: DataFrame) -> DataFrame:
    """Per run (source_id, run): total, matched, new and duplicate candidates of rows with the flags matched and fresh, and whether they add up."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = rows.groupBy("source_id", "run").agg(F.count("*").alias("total"), n(F.col("matched")).alias("matched"), n(F.col("matched") & F.col("fresh")).alias("new"), n(F.col("matched") & ~F.col("fresh")).alias("duplicate"))
    return out.withColumn("sound", (F.col("new") + F.col("duplicate") <= F.col("matched")) & (F.col("matched") <= F.col("total")))


def freshness(configured: DataFrame, articles: DataFrame) -> DataFrame:
    """(source_id, place, newest): configured sources (source_id, place) in their order, then those only in the data by name."""
    newest = articles.groupBy("source_id").agg(F.max("at").alias("newest"))
    return configured.join(newest, "source_id", "full").select("source_id", "place", "newest")


def shown_comments(comments: DataFrame, user: Column) -> DataFrame:
    """A user's own comments and public ones."""
    return comments.filter(F.col("public") | (F.col("user_id") == user))


def inbox(reports: DataFrame, titles: DataFrame, status: str | None = None, kind: str | None = None) -> DataFrame:
    """Reports with their article's title, by optional status and kind."""
    rows = reports.join(titles, "article_id", "left")
    for column, wanted in (("status", status), ("kind", kind)):
        if wanted is not None:
            rows = rows.filter(F.col(column) == wanted)
    return rows
