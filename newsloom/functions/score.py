"""Scores, bands and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def recommend_score(base: Column, weight_sum: Column) -> Column:
    """A score of 0 to 100 moved by learned weights on the scale of log odds; null where either is."""
    p = F.least(F.greatest(base / 100, F.lit(0.005)), F.lit(0.995))
    return F.round(100 / (1 + F.exp(-(F.log(p / (1 - p)) + weight_sum)))).cast("int")


def band(score: Column) -> Column:
    """0, 10, ... 90; 100 is in the last one."""
    return (F.floor(F.least(score, F.lit(99)) / 10) * 10).cast("int")


def target(stars: Column) -> Column:
    """One to five stars as 0 to 1."""
    return (stars - 1) / 4


def dot(a: Column, b: Column) -> Column:
    """The product of two arrays, summed in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector of length one; null for zero or non-finite ones."""
    norm = F.sqrt(dot(v, v))
    return F.when((norm > 0) & ~F.isnan(norm) & (norm < float("inf")), F.transform(v, lambda x: x / norm))


def pace(used_share: Column, ahead_days: int = 1) -> Column:
    """The share of a week's allowance that may be used by now."""
    return F.least(used_share + ahead_days / 7, F.lit(1.0))
