"""Streams against their batch forms: rows in any order and batches, restarts, late rows, bounded state, files read."""

import os
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.operators import state
from newsloom.streaming import jobs, keyed

START = datetime(2024, 1, 1)


def dealt(df, place, parts, seed):
    """A folder of files, each with a random part of the rows, and a function that adds one."""
    rows = df.withColumn("_part", F.pmod(F.xxhash64("event_id", F.lit(seed)), F.lit(parts))).collect()

    def add(k):
        df.sparkSession.createDataFrame([tuple(r[c] for c in df.columns) for r in rows if r["_part"] == k], df.schema).coalesce(1).write.mode("append").parquet(place)

    return add


def outcomes(spark, n=1500, items=40):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(0, items)), k, START + timedelta(minutes=int(rng.integers(0, 4000))), bool(rng.random() < 0.7), bool(rng.random() < 0.03)) for k in range(n)]
    return spark.createDataFrame(rows, "item_id long, event_id long, at timestamp, failed boolean, permanent boolean")


def plain(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_streamed_retries_equal_batch_after_a_restart(spark, tmp_path, seed):
    log = outcomes(spark)
    add = dealt(log, str(tmp_path / "in"), 5, seed)
    own = keyed.stateful_session(spark)

    def go():
        stream = own.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        jobs.run(keyed.retries(stream, "30 days"), str(tmp_path / "checkpoint"), keyed.changes(str(tmp_path / "out")), "update")

    for k in range(3):
        add(k)
    go()
    for k in (3, 4):
        add(k)
    go()
    found = keyed.current(spark, str(tmp_path / "out"), ["item_id"])
    want = state.retries(log)
    assert plain(found.filter("attempts > 0").select(want.columns).collect()) == plain(want.collect())
    # what is written follows the batch, what is held an item
    sizes = [spark.read.parquet(str(tmp_path / "out")).filter(F.col("batch") == k).count() for k in range(5)]
    assert all(n <= 40 for n in sizes)
    held = own.read.format("statestore").option("stateVarName", "state").load(str(tmp_path / "checkpoint"))
    assert held.count() == 40 and held.selectExpr("max(length(value.value))").first()[0] < 500


def test_retries_are_due_when_their_time_comes(spark, tmp_path):
    """A timer tells of the next try; a success in time stops it."""
    own = keyed.stateful_session(spark)
    at = lambda h: START + timedelta(hours=h)
    batches = [[(1, 1, at(0), True, False), (2, 2, at(0), True, False), (3, 3, at(0), True, True)], [(2, 4, at(0.5), False, False)], [(9, 5, at(30), False, False)], [(9, 6, at(31), False, False)]]
    schema = "item_id long, event_id long, at timestamp, failed boolean, permanent boolean"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = own.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        jobs.run(keyed.retries(stream, "1 hour"), str(tmp_path / "checkpoint"), keyed.changes(str(tmp_path / "out")), "update")
    due = spark.read.parquet(str(tmp_path / "out")).filter("due").collect()
    assert [(r.item_id, r.attempts, r.next_retry_at) for r in due] == [(1, 1, at(1))]


@pytest.mark.parametrize("seed", [1, 2])
def test_streamed_marks_equal_batch_after_a_restart(spark, tmp_path, seed):
    rng = np.random.default_rng(3)
    actions = ["read", "bookmark", "rate", "unread", "unbookmark"]
    rows = [(int(rng.integers(0, 6)), int(rng.integers(0, 9)), k, START + timedelta(minutes=int(rng.integers(0, 3000))), actions[rng.integers(0, 5)], int(rng.integers(0, 5))) for k in range(900)]
    log = spark.createDataFrame(rows, "user_id long, article_id long, event_id long, ts timestamp, action string, stars int")
    stories = spark.createDataFrame([(k, k - k % 3) for k in range(7)], "article_id long, story_id long")
    add = dealt(log, str(tmp_path / "in"), 4, seed)
    own = keyed.stateful_session(spark)
    for part in ((0, 1), (2, 3)):
        for k in part:
            add(k)
        stream = own.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        table = own.createDataFrame(stories.collect(), stories.schema)
        jobs.run(keyed.marks(stream, table, "30 days"), str(tmp_path / "checkpoint"), keyed.changes(str(tmp_path / "out")), "update")
    want = state.marks(log, stories)
    found = keyed.current(spark, str(tmp_path / "out"), ["user_id", "article_id"])
    assert plain(found.select(want.columns).collect()) == plain(want.collect())


def test_marks_hold_one_reading_of_those_that_are_final(spark):
    """Behind the watermark nothing undoes a reading any more, so only the first of them is held."""
    import pandas as pd

    rows = pd.DataFrame({"at": [m * 60_000_000 for m in range(1, 200)], "event_id": range(199), "article_id": 5, "action": "read", "stars": 0})
    held, out, _ = keyed._mark_step((1, 5), None, rows, 150 * 60_000)
    assert len(held["articles"]["5"]["read"]) == 1 + 50 and out["read"][0] == 60_000_000


def views(minutes, user=1):
    return [(user, START + timedelta(minutes=m)) for m in minutes]


def test_visits_leave_the_state_and_late_views_are_counted(spark, tmp_path):
    """Thirty days of visits, a file a day: the state never holds more than the visits of the last days; a view that is too late is dropped and counted, and the open visits come with the end."""
    schema = "user_id long, ts timestamp"
    place = str(tmp_path / "in")
    minutes = [d * 1440 + h * 60 + m for d in range(30) for h in (8, 20) for m in (0, 10, 39)]
    held, late = [], 0

    def go(stream):
        job = jobs.run(jobs.visits(stream), str(tmp_path / "checkpoint"), keyed.changes(str(tmp_path / "out")))
        held.extend(o.numRowsTotal for p in job.recentProgress for o in p.stateOperators)
        return jobs.late_rows(job)

    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(place)
    for d in range(30):
        spark.createDataFrame(views([m for m in minutes if m // 1440 == d]), schema).coalesce(1).write.mode("append").parquet(place)
    late += go(read())
    spark.createDataFrame(views([5]), schema).coalesce(1).write.mode("append").parquet(place)
    late += go(read())
    assert late == 1 and max(held) <= 6
    found = spark.read.parquet(str(tmp_path / "out"))
    assert 54 <= found.count() < 60
    out = jobs.collected(jobs.visits(jobs.flushed(spark.readStream.schema(schema).parquet(place), F.lit(START + timedelta(days=40))))).filter("user_id is not null").collect()
    assert sorted((r.first_view, r.last_view) for r in out) == [(START + timedelta(minutes=5), START + timedelta(minutes=5)), *((START + timedelta(minutes=d * 1440 + h * 60), START + timedelta(minutes=d * 1440 + h * 60 + 39)) for d in range(30) for h in (8, 20))]


def test_new_rows_read_the_buckets_of_their_batch(spark, tmp_path):
    """Batches add what is new, a repeated one nothing; files of other buckets aren't read."""
    place = str(tmp_path / "t")
    write = jobs.append_new(place, "url", 64)
    rows = spark.range(2000).selectExpr("concat('u', id) as url", "id as n")
    write(rows, 0)
    write(rows, 0)
    assert spark.read.parquet(place).count() == 2000
    before = {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(place) for f in names if f.endswith(".parquet")}
    few = spark.range(1999, 2002).selectExpr("concat('u', id) as url", "id as n")
    write(few, 1)
    write(few.limit(0), 2)
    assert spark.read.parquet(place).count() == 2002
    buckets = [r[0] for r in few.selectExpr("pmod(xxhash64(url), 64L) b").distinct().collect()]
    for f in before:  # a broken file elsewhere doesn't matter
        if int(f.split("bucket=")[1].split("/")[0]) not in buckets:
            os.remove(os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc"))
            open(f, "w").close()
    write(few, 3)
    write(spark.createDataFrame([("u1999", 7)], "url string, n long"), 4)
    kept = spark.read.schema("url string, n long, bucket int").parquet(place).filter(F.col("bucket").isin(buckets))
    assert kept.filter("n >= 1999").count() == 3
