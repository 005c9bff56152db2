"""Structured Streaming jobs: new URLs once, retries, marks and visits, each equal to its batch form over what has arrived."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.session import saved, shared_folder
from ..functions.text import normalize_url
from . import keyed

GAP = "30 minutes"


def new_urls(candidates: DataFrame, at: str = "seen_at", late: str = "7 days") -> DataFrame:
    """M1: each normalised URL of a stream of candidates (url, at, ...) once within the time that candidates may be late. So the state holds the URLs of that time only; what comes
    again after it is kept out when a batch is written, as are URLs of earlier runs (append_new)."""
    rows = candidates.withColumn("url", normalize_url(F.col("url"))).filter("url is not null")
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(["url"])


def append_new(path: str, key: str, buckets: int = 256) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: adds the rows whose key the table doesn't hold. The table is laid out by buckets of the key, and a batch reads the key's column of its own buckets only. A batch that is
    repeated after a failure adds nothing twice."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = saved(batch.dropDuplicates([key]).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
        held = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # so many buckets at most
        if not held:
            return
        try:
            known = spark.read.schema(fresh.schema).parquet(path).filter(F.col("bucket").isin(held)).select(key)
        except AnalysisException as e:  # no table yet
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            known = fresh.select(key).limit(0)
        fresh.join(known, key, "left_anti").repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)

    return write


def visits(views: DataFrame, late: str = "1 day", gap: str = GAP) -> DataFrame:
    """M6: (user_id, first_view, last_view) of each visit in a stream of views (user_id, ts), for append mode: a visit is given, and leaves the state, when the watermark has passed its end. So the
    state holds the visits of the time that views may be late. Later views are dropped (late_rows counts them)."""
    window = F.session_window("ts", gap)
    return views.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("user_id", window).agg(F.min("ts").alias("first_view"), F.max("ts").alias("last_view")).select("user_id", "first_view", "last_view")


def late_rows(job: StreamingQuery) -> int:
    """The rows that a stream's job has dropped as too late."""
    return sum(operator.numRowsDroppedByWatermark for progress in job.recentProgress for operator in progress.stateOperators)


retries, marks = keyed.retries, keyed.marks


def kept_once(stream: DataFrame, key: str, buckets: int = 32) -> DataFrame:
    """What a stream gives for all that is there now, as a table that holds each key once."""
    spark = stream.sparkSession
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    run(stream, f"{place}/checkpoint", append_new(f"{place}/out", key, buckets))
    return spark.read.parquet(f"{place}/out").drop("bucket")


def run(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """The job of a stream until the input that is there now is used up; with the same checkpoint it goes on where it ended."""
    job = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    job.awaitTermination()
    return job


def flushed(views: DataFrame, at: Column) -> DataFrame:
    """A stream of views (user_id, ts) and, for a job that ends for good, one view of nobody (its table is written here) at a time far enough behind all that the watermark closes every visit."""
    spark = views.sparkSession
    place = f"{shared_folder(spark)}/flush-{uuid.uuid4().hex}"
    spark.range(1).select(F.lit(None).cast(views.schema["user_id"].dataType).alias("user_id"), at.cast("timestamp").alias("ts")).write.parquet(place)
    end = spark.readStream.schema(spark.read.parquet(place).schema).parquet(place)
    return views.select("user_id", F.col("ts").cast("timestamp").alias("ts")).unionByName(end)


def collected(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives for all that is there now, as a table with the number of each batch: the job runs until the input is used up, with its checkpoint and output in the session's shared folder."""
    spark = stream.sparkSession
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    run(stream, f"{place}/checkpoint", keyed.changes(f"{place}/out"), mode)
    return spark.read.schema(stream.schema).parquet(f"{place}/out")
