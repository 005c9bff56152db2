"""Aggregations: overviews, histograms, concordance, ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.score import band


def overview(articles: DataFrame, states: DataFrame, runs: DataFrame) -> DataFrame:
    """(source_id, articles, error, last_run) over all ids of the three tables."""
    ids = articles.select("source_id").union(states.select("source_id")).union(runs.select("source_id")).distinct()
    last = runs.groupBy("source_id").agg(F.max("fetched_at").alias("last_run"))
    counted = articles.groupBy("source_id").agg(F.count("*").alias("articles"))
    return ids.join(counted, "source_id", "left").join(states.select("source_id", "error"), "source_id", "left").join(last, "source_id", "left").withColumn("articles", F.coalesce("articles", F.lit(0)))


def star_histogram(ratings: DataFrame, by: list[str]) -> DataFrame:
    """Ratings by stars, and positive (4 and 5), neutral (3) and negative ones."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    stars = F.col("stars")
    return ratings.groupBy(*by).agg(*(n(stars == k).alias(f"stars_{k}") for k in range(1, 6)), n(stars >= 4).alias("positive"), n(stars == 3).alias("neutral"), n(stars <= 2).alias("negative"))


def concordance(rows: DataFrame, by: list[str], score: str = "score", stars: str = "stars") -> DataFrame:
    """The share of pairs with different stars of which the one with more stars has the higher score, ties counting half; null without such pairs. Pairs
    aren't made: per distinct score the lower ones are counted by running sums for each number of stars."""
    kinds = range(1, 6)
    hist = rows.groupBy(*by, F.col(score).alias("_s")).agg(*(F.sum(F.when(F.col(stars) == k, 1).otherwise(0)).alias(f"_n{k}") for k in kinds))
    below = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1) if by else Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    for k in kinds:
        hist = hist.withColumn(f"_b{k}", F.coalesce(F.sum(f"_n{k}").over(below), F.lit(0)))
    good = sum((F.col(f"_n{k}") * (F.col(f"_b{j}") + F.col(f"_n{j}") / 2) for k in kinds for j in range(1, k)), F.lit(0.0))
    totals = hist.groupBy(*by).agg(F.sum(good).alias("_good"), *(F.sum(f"_n{k}").alias(f"_t{k}") for k in kinds))
    pairs = sum((F.col(f"_t{k}") * F.col(f"_t{j}") for k in kinds for j in range(1, k)), F.lit(0))
    return totals.select(*by, F.when(pairs > 0, F.col("_good") / pairs).alias("concordance"))


def band_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Ratings by score band and stars, long: by, band, stars, n."""
    return rows.groupBy(*by, band(F.col("score")).alias("band"), "stars").agg(F.count("*").alias("n"))


def coverage(labels: DataFrame, scores: DataFrame, by: list[str]) -> DataFrame:
    """Per user and key of scores (user_id, by, article_id, created_at): how many labels (user_id, article_id, rated_at) the user has, how many are scored, how many after the rating."""
    total, by = labels.groupBy("user_id").agg(F.count("*").alias("labelled")), ["user_id", *by]
    hit = scores.join(labels, ["user_id", "article_id"]).groupBy(*by).agg(F.count("*").alias("scored"), F.sum(F.when(F.col("created_at") > F.col("rated_at"), 1).otherwise(0)).alias("after_rating"))
    keys = scores.select(*by).distinct()
    return keys.join(hit, by, "left").join(total, "user_id", "left").select(*by, F.coalesce("labelled", F.lit(0)).alias("labelled"), F.coalesce("scored", F.lit(0)).alias("scored"), F.coalesce("after_rating", F.lit(0)).alias("after_rating"))


def missed(picks: DataFrame, ratings: DataFrame) -> DataFrame:
    """Exploration picks (user_id, article_id): how many, how many rated, and the share of interest among the rated."""
    rows = picks.join(ratings, ["user_id", "article_id"], "left")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = rows.groupBy("user_id").agg(F.count("*").alias("picked"), F.count("stars").alias("rated"), n(F.col("stars") >= 4).alias("positive"))
    return out.withColumn("miss_rate", F.when(F.col("rated") > 0, F.col("positive") / F.col("rated")))


def topic_sentiment(ratings: DataFrame, topics: DataFrame) -> DataFrame:
    """(topic, positive, negative, total) over the topics of rated articles."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return ratings.join(topics, "article_id").groupBy("topic").agg(n(F.col("stars") >= 4).alias("positive"), n(F.col("stars") <= 2).alias("negative"), F.count("*").alias("total"))


def usage(vocabulary: DataFrame, tags: DataFrame) -> DataFrame:
    """How many artifact versions carry each topic, 0 included."""
    n = tags.groupBy(F.col("topic").alias("name")).agg(F.count("*").alias("uses"))
    return vocabulary.select("name").join(n, "name", "left").withColumn("uses", F.coalesce("uses", F.lit(0)))


def failures(errors: DataFrame) -> DataFrame:
    """Per stage group, backend and model: distinct articles that fail and that were given up, and the newest error of the latter. A stage such as embed:s:a
    counts with embed:s."""
    group = F.array_join(F.slice(F.split("stage", ":"), 1, 2), ":")
    gave_up = F.col("attempts") >= 5
    return errors.groupBy(group.alias("stage"), "backend", "model").agg(
        F.count_distinct("article_id").alias("failing"), F.count_distinct(F.when(gave_up, F.col("article_id"))).alias("given_up"),
        F.max_by(F.when(gave_up, F.col("error")), F.when(gave_up, F.struct("next_retry_at", "article_id"))).alias("last_error"),
    )


def ledger(calls: DataFrame, monthly: float, extra: float = 1.0) -> DataFrame:
    """Per backend and day of a month: credits so far, and what the month's share and the pace allow by then."""
    day = calls.groupBy("backend", F.to_date("at").alias("day")).agg(F.sum("credits").alias("credits"))
    month = Window.partitionBy("backend", F.trunc("day", "month")).orderBy("day")
    share = F.dayofmonth("day") / F.dayofmonth(F.last_day("day"))
    return day.select("backend", "day", F.sum("credits").over(month).alias("used"), (monthly * share * extra).alias("allowed"))


def newest_windows(usage: DataFrame, since_days: int = 8) -> DataFrame:
    """Of the reported rate windows (kind, resets_at, utilization, at) each kind's newest reset with its highest utilization; reports older than so many
    days before the newest don't count. Any order of reports gives the same."""
    last = usage.groupBy("kind").agg(F.max("at").alias("_last"))
    recent = usage.join(last, "kind").filter(F.col("at") > F.col("_last") - F.make_interval(days=F.lit(since_days)))
    return recent.groupBy("kind").agg(F.max(F.struct("resets_at", "utilization")).alias("w")).select("kind", "w.resets_at", "w.utilization")


def lifted(rows: DataFrame, conditions: dict[str, object]) -> DataFrame:
    """(condition, hidden): how many rows appear if one condition alone is lifted. One pass over flags."""
    flags = rows.select(*(F.coalesce(c, F.lit(False)).alias(n) for n, c in conditions.items()))
    only = [F.sum(F.when(~F.col(n) & F.expr(" and ".join(m for m in conditions if m != n) or "true"), 1).otherwise(0)).alias(n) for n in conditions]
    one = flags.agg(*only)
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, conditions)), F.array(*(F.coalesce(F.col(n), F.lit(0)) for n in conditions)))).alias("condition", "hidden"))


def baseline(similarities: DataFrame, by: list[str], value: str = "similarity") -> DataFrame:
    """Mean and standard deviation of each preference text's similarities; 0 and 1 where there are fewer than two or they hardly differ."""
    s = similarities.groupBy(*by).agg(F.count("*").alias("_n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    flat = (F.col("_n") < 2) | (F.col("sd") < 1e-6)
    return s.select(*by, F.when(flat, 0.0).otherwise(F.col("mean")).alias("mean"), F.when(flat, 1.0).otherwise(F.col("sd")).alias("sd"))
