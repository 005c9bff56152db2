"""One version of many: windows, limits, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a reference sample.
REFERENCE = 3000


def top(rows: DataFrame, by: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each group in an order (Spark prunes within each task before the shuffle)."""
    turn = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_turn", turn).filter(F.col("_turn") <= k).drop("_turn")


def newest(rows: DataFrame, by: list[str], at: str = "created_at", ident: str = "id") -> DataFrame:
    return top(rows, by, [F.col(at).desc(), F.col(ident).desc()])


def display_title(digest: Column, translated: Column, original: Column, url: Column) -> Column:
    """The digest's title, else its translation, else the original, else the URL; blank ones count as none."""
    some = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.coalesce(some(digest), some(translated), some(original), url)


def fold_stories(rows: DataFrame, by: list[str], order: list[Column], then: Column | None = None, limit: int | None = None) -> DataFrame:
    """The first row of each story in list order (within each user), then a filter, then the limit: in this order, as a story whose first row is
    filtered out doesn't come back with another."""
    folded = top(rows, [*by, "story_id"], order)
    if then is not None:
        folded = folded.filter(then)
    return top(folded, by, order, limit) if limit and by else folded.orderBy(*order).limit(limit) if limit else folded


def list_order(newest_first: bool = False) -> list[Column]:
    """By score with unscored last, then time, then id; or by time alone."""
    time = [F.col("at").desc(), F.col("id").desc()]
    return time if newest_first else [F.col("score").desc_nulls_last(), *time]


def gaps(days: DataFrame, by: str) -> DataFrame:
    """(by, day, gap): days since the day before among distinct days."""
    distinct = days.select(by, "day").distinct()
    before = F.lag("day").over(Window.partitionBy(by).orderBy("day"))
    return distinct.withColumn("gap", F.datediff("day", before)).filter("gap is not null")


def visits(views: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """(user_id, ts, visit, boundary) of views (user_id, ts): a view more than the gap after the one before starts a visit; the boundary is the last view of
    the visit before."""
    by = Window.partitionBy("user_id").orderBy("ts")
    before = F.lag("ts").over(by)
    starts = F.when(before.isNotNull() & (F.unix_micros("ts") - F.unix_micros(before) > gap_minutes * 60_000_000), before)
    rows = views.select("user_id", F.col("ts").cast("timestamp").alias("ts")).distinct().withColumn("_end", starts)
    return rows.withColumn("visit", F.count("_end").over(by) + 1).withColumn("boundary", F.last("_end", ignorenulls=True).over(by)).drop("_end")


def percentile(values: DataFrame, reference: DataFrame, by: str) -> DataFrame:
    """values (by, id, value) with score: 0 where the value isn't positive, 50 without reference, else the share of the reference (by, value) that is
    below, ties counting half, in hundredths. A reference is a sample of bounded size (REFERENCE rows): only its rows are sorted. Of its values those at or behind which the
    score rises are kept, a hundred at most, and each row of values looks its score up in that list."""
    counted = reference.groupBy(by, "value").agg(F.count("*").alias("_n"))
    until = Window.partitionBy(by).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    counted = counted.withColumn("_to", F.sum("_n").over(until)).withColumn("_all", F.sum("_n").over(Window.partitionBy(by)))
    rank = lambda below: F.round(100 * below / F.col("_all")).cast("int")
    at, behind = rank(F.col("_to") - F.col("_n") + F.col("_n") / 2), rank(F.col("_to").cast("double"))
    steps = counted.select(by, F.explode(F.array(F.struct(F.col("value").alias("x"), F.lit(False).alias("over"), at.alias("score")), F.struct(F.col("value").alias("x"), F.lit(True).alias("over"), behind.alias("score")))).alias("s"))
    rises = steps.withColumn("_rise", F.col("s.score") > F.coalesce(F.lag("s.score").over(Window.partitionBy(by).orderBy("s.x", "s.over")), F.lit(0)))
    known = rises.groupBy(by).agg(F.array_sort(F.collect_list(F.when(F.col("_rise"), F.col("s")))).alias("_steps"))
    passed = F.filter("_steps", lambda s: (F.col("value") > s["x"]) | ((F.col("value") == s["x"]) & ~s["over"]))
    score = F.when(F.col("value") <= 0, 0).when(F.col("_steps").isNull(), 50).otherwise(F.coalesce(F.get(passed, F.size(passed) - 1)["score"], F.lit(0)))
    return values.select(by, "id", "value").join(known, by, "left").select(by, "id", "value", score.cast("int").alias("score"))


def median_floor(values: Column) -> Column:
    """The middle of an array of whole numbers; of the two middle ones the mean, cut to a whole number."""
    s, n = F.sort_array(values), F.size(values)
    return F.when(n > 0, F.floor((F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2))


def medians(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, median) as median_floor, of any number of rows: values are counted, and the middle ones found by running sums of the counts."""
    counts = rows.groupBy(by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    until = Window.partitionBy(by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_to", F.sum("_n").over(until)).withColumn("_all", F.sum("_n").over(Window.partitionBy(by)))
    first, second = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    at = lambda k: F.max(F.when((F.col("_to") >= k) & (F.col("_to") - F.col("_n") < k), F.col("_v")))
    return counts.groupBy(by).agg(F.floor((at(first) + at(second)) / 2).alias("median"))


def two_quotas(candidates: DataFrame, others: int = 5, same: int = 3) -> DataFrame:
    """Of each target's candidates (target, unit, similarity, other_source) the most similar: so many with another source, so many without."""
    turn = F.row_number().over(Window.partitionBy("target", "other_source").orderBy(F.col("similarity").desc(), "unit"))
    return candidates.withColumn("_turn", turn).filter(F.col("_turn") <= F.when(F.col("other_source"), others).otherwise(same)).drop("_turn")


def explorable(rows: DataFrame, stories: DataFrame, read: DataFrame, rated: DataFrame, below: int) -> DataFrame:
    """The rows (user_id, article_id, score, relevant) that a daily sample may take: relevant, scored below the least score of lists, of a story of which the user has
    neither read nor rated an article. read and rated: (user_id, article_id)."""
    seen = read.select("user_id", "article_id").unionByName(rated.select("user_id", "article_id")).join(stories, "article_id").select("user_id", "story_id").distinct()
    fit = rows.filter(F.col("relevant") & (F.col("score") < below)).join(stories, "article_id")
    return fit.join(seen, ["user_id", "story_id"], "left_anti").select("user_id", "article_id")


def explored(picked: DataFrame, rows: DataFrame, stories: DataFrame, rated: DataFrame, day: str, below: int) -> DataFrame:
    """(user_id, article_id) of a day's picks that still show: the same ones all day, but for those that were rated since, they or another article of their story, and those
    that aren't relevant or below the least score any more."""
    today = picked.filter(F.col("picked_on") == F.lit(day).cast("date")).select("user_id", "article_id").distinct()
    done = rated.select("user_id", "article_id").join(stories, "article_id").select("user_id", "story_id").distinct()
    fit = rows.filter(F.col("relevant") & (F.col("score") < below)).select("user_id", "article_id")
    return today.join(fit, ["user_id", "article_id"], "left_semi").join(stories, "article_id").join(done, ["user_id", "story_id"], "left_anti").select("user_id", "article_id")


def daily_picks(eligible: DataFrame, picked: DataFrame, day: str, per_day: int = 2) -> DataFrame:
    """(user_id, article_id) to add for a day: of eligible articles never picked for the user, by a hash of user, day and article; as many as the day
    still lacks."""
    done = picked.filter(F.col("picked_on") == F.lit(day).cast("date")).groupBy("user_id").agg(F.count("*").alias("done"))
    fresh = eligible.select("user_id", "article_id").join(picked.select("user_id", "article_id"), ["user_id", "article_id"], "left_anti")
    order = F.md5(F.concat_ws("-", "user_id", F.lit(day), "article_id"))
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy(order, "article_id"))
    return fresh.withColumn("turn", turn).join(done, "user_id", "left").filter(F.col("turn") <= per_day - F.coalesce("done", F.lit(0))).select("user_id", "article_id")
