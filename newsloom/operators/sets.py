"""Unions, differences and the differences of profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def all_ids(*tables: DataFrame) -> DataFrame:
    """Every id once."""
    return reduce(DataFrame.unionByName, tables).distinct()


def names(topics: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, topic): topics by their own names and by their aliases."""
    return topics.select("name", F.col("name").alias("topic")).unionByName(aliases.select(F.col("alias").alias("name"), F.col("name").alias("topic")))


def without(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(others, keys, "left_anti")


def profile_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(user_id, topic, change) between profiles in rows (user_id, kind, topic, weight, note): added, removed, weight, note, exclude+ and exclude-. A
    blank note is none."""
    side = lambda df, p: df.select("user_id", "kind", "topic", F.lit(True).alias(p), F.col("weight").alias(f"{p}_weight"), F.coalesce(F.trim("note"), F.lit("")).alias(f"{p}_note"))
    both = side(before, "old").join(side(after, "new"), ["user_id", "kind", "topic"], "full")
    out = F.col("kind") == "exclude"
    change = (
        F.when(F.col("old").isNull(), F.when(out, "exclude+").otherwise("added")).when(F.col("new").isNull(), F.when(out, "exclude-").otherwise("removed"))
        .when(F.col("old_weight") != F.col("new_weight"), "weight").when(F.col("old_note") != F.col("new_note"), "note")
    )
    return both.select("user_id", "topic", change.alias("change")).filter("change is not null")
