"""What the two classifiers share: labelled rows of the training fold, isotonic calibration, and scores beside the columns of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, small_batches, text_bytes

#: Raw scores are averaged over so many bins before calibration, so that its input is of fixed size.
BINS = 1000
#: Columns that stand beside those of the input while it is scored.
X, RAW, SCORE, ROW = "_features", "_raw", "_score", "_row"


def whole(docs: DataFrame) -> DataFrame:
    """The rows of docs as one column ROW beside their text, so that no name in them can clash with those used here."""
    return docs.select(F.struct(*docs.columns).alias(ROW), "text")


def measured(docs: DataFrame, keep: list[str], measure: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """The columns to keep of docs, and X, what measure makes of each text's bytes (data and offsets to a row for each text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_text"):
            x = measure(*text_bytes(batch.column("_text")))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.record_batch([*batch.columns[:-1], lists], names=[*keep, X])

    given = small_batches(docs).select(*keep, F.col("text").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return given.mapInArrow(run, f"{kinds}, {X} array<double>")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def labelled(rows: DataFrame, labels: DataFrame, label: str, learns: Column) -> DataFrame:
    """The rows (doc_id, ...) of the training fold that have a label of 0 or 1, with it."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label"))
    known = known.filter(F.col("label").isin(0.0, 1.0)).groupBy("doc_id").agg(F.max("label").alias("label"))
    return rows.withColumn("doc_id", F.col("doc_id").cast("long")).filter(learns).join(known, "doc_id")


def sampled(rows: DataFrame, most: int, count: int) -> DataFrame:
    """About so many rows at most, by a hash of their ids."""
    return rows if count <= most else rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < int(1_000_000 * most / count))


def calibration(train: DataFrame, unknown: float = 0.5) -> Callable[[DataFrame], DataFrame]:
    """From train (RAW within 0 and 1, label) what adds SCORE to rows with RAW: the share of label 1 that it stands for, rising with it. Without both
    labels it is their mean, or what is given for none."""
    bins = train.groupBy(F.round(F.greatest(F.least(F.col(RAW), F.lit(1.0)), F.lit(0.0)) * BINS).alias("bin")).agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("weight"))
    bins = bins.withColumn(RAW, F.col("bin") / BINS)
    low, top = bins.agg(F.min("label"), F.max("label")).collect()[0]
    if low is None or low == top:
        return lambda rows: rows.withColumn(SCORE, F.lit(unknown if low is None else float(low)))
    model = IsotonicRegression(featuresCol=RAW, labelCol="label", weightCol="weight", predictionCol=SCORE).fit(bins)
    return lambda rows: model.transform(rows).withColumn(SCORE, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(SCORE))))


def judged(scored: DataFrame, held_out: Column, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted and the raw score."""
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= threshold).cast("int").alias("predicted"), F.col(RAW).alias("raw"))
