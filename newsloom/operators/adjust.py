"""Scores corrected by ratings: features, the fit of each user's weights, recommended scores, contributions, leave-one-out."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.score import recommend_score
from ..functions.session import saved

PRIOR = 20.0
#: Rows of models that one task takes.
EACH = 20_000


def features(source: Column, topics: Column, interests: Column, excludes: Column) -> Column:
    """The keys of a row: source:, topic:, interest:, exclude:."""
    keyed = lambda name, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit(f"{name}:"), x))
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("source:"), source)), keyed("topic", topics), keyed("interest", interests), keyed("exclude", excludes)))


def training_set(ratings: DataFrame, scores: DataFrame, keyed: DataFrame) -> DataFrame:
    """(user_id, article_id, base, stars, features) of rated articles with a score under the current profile."""
    return ratings.join(scores.withColumnRenamed("score", "base"), ["user_id", "article_id"]).join(keyed, ["user_id", "article_id"]).select("user_id", "article_id", "base", "stars", "features")


def fit_weights(base: np.ndarray, target: np.ndarray, x: np.ndarray, prior: float = PRIOR, rounds: int = 100, times: np.ndarray | float = 1.0) -> np.ndarray:
    """The weights w that minimise the cross-entropy of target with sigmoid(logit(base) + x w) plus prior / 2 times their squares: Newton steps, halved while they don't
    improve. A row may stand for several (times), then target is their sum."""
    p0 = np.clip(base / 100, 0.005, 0.995)
    offset = np.log(p0 / (1 - p0))
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        z = offset + x @ w
        return float(np.sum(times * np.logaddexp(0, z) - target * z) + prior / 2 * w @ w)

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(offset + x @ w)))
        gradient = x.T @ (times * p - target) + prior * w
        step = np.linalg.solve((x.T * (times * p * (1 - p))) @ x + prior * np.eye(len(w)), gradient)
        size = 1.0
        while size > 1e-8 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-10 * max(1.0, abs(before)):
            break
    return w


def without_each(base: np.ndarray, target: np.ndarray, x: np.ndarray, which: np.ndarray, times: np.ndarray, prior: float = PRIOR, chunk: int = 256) -> np.ndarray:
    """For each of these rows its prediction (0 to 100) by the weights of all rows less one such: Newton steps from the full fit, for many rows together. Their matrix is that of the full fit less the
    row's own part, whose inverse is an update of the one inverse by rank one; it stays while the weights move to the minimum. What hasn't come to rest after 50 steps is fitted for itself."""
    p0 = np.clip(base / 100, 0.005, 0.995)
    offset = np.log(p0 / (1 - p0))
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    full = fit_weights(base, target * times, x, prior, times=times)
    p = sigmoid(offset + x @ full)
    inverse = np.linalg.inv((x.T * (times * p * (1 - p))) @ x + prior * np.eye(x.shape[1]))
    out = np.zeros(len(which))
    for at in range(0, len(which), chunk):
        i = which[at : at + chunk]
        k = np.arange(len(i))
        own, spread = x[i], p[i] * (1 - p[i])
        turned = own @ inverse
        update = spread / (1 - spread * np.einsum("kd,kd->k", own, turned))
        w = np.tile(full, (len(i), 1))
        for _ in range(50):
            now = sigmoid(offset[:, None] + x @ w.T)
            gradient = (times[:, None] * now - (times * target)[:, None]).T @ x + prior * w - (now[i, k] - target[i])[:, None] * own
            step = gradient @ inverse
            step += (update * np.einsum("kd,kd->k", own, step))[:, None] * turned
            w -= step
            rest = np.abs(step).max(axis=1, initial=0.0)
            if (rest < 1e-10).all():
                break
        for j in np.flatnonzero(~(rest < 1e-10)):
            others = times - (np.arange(len(base)) == i[j])
            w[j] = fit_weights(base, target * others, x, prior, times=others)
        out[at : at + chunk] = 100 * sigmoid(offset[i] + np.einsum("kd,kd->k", own, w))
    return out


def _design(rows: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    names = sorted({f for fs in rows.features for f in fs})
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, fs in enumerate(rows.features):
        x[i, [at[f] for f in set(fs)]] = 1
    return names, x


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Saved rows dealt by keys, EACH of them to a task, or over all cores."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(-(-rows.count() // EACH), 2 * cores), *keys)


def fit(train: DataFrame, prior: float = PRIOR, by: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """(by, feature, weight): each user's ratings are a model of their own, so the fits spread over tasks; a user's group is as large as what one person rates."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("article_id")
        names, x = _design(rows)
        w = fit_weights(rows.base.to_numpy(float), (rows.stars.to_numpy(float) - 1) / 4, x, prior)
        return pd.DataFrame({**{k: rows[k].iloc[0] for k in by}, "feature": names, "weight": w})

    kinds = ", ".join(f"{k} {train.schema[k].dataType.simpleString()}" for k in by)
    return dealt(saved(train), *by).groupBy(*by).applyInPandas(one, f"{kinds}, feature string, weight double")


def recommended(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """rows (user_id, article_id, base, features) with score: the base moved by the weights of the row's features; unmoved for users without a model."""
    listed = rows.select("user_id", "article_id", F.explode(F.array_distinct("features")).alias("feature"))
    sums = listed.join(weights, ["user_id", "feature"]).groupBy("user_id", "article_id").agg(F.sum("weight").alias("_w"))
    out = rows.join(sums, ["user_id", "article_id"], "left").withColumn("_w", F.coalesce("_w", F.lit(0.0)))
    return out.withColumn("score", recommend_score(F.col("base"), F.col("_w"))).drop("_w")


def contributions(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(user_id, article_id, feature, contribution, place): the score less what it would be without the feature; zeros left out, the largest first."""
    listed = rows.select("user_id", "article_id", "base", F.explode(F.array_distinct("features")).alias("feature")).join(weights, ["user_id", "feature"])
    row = Window.partitionBy("user_id", "article_id")
    total = F.sum("weight").over(row)
    out = listed.withColumn("_t", total).withColumn("contribution", recommend_score(F.col("base"), F.col("_t")) - recommend_score(F.col("base"), F.col("_t") - F.col("weight"))).filter("contribution <> 0")
    order = row.orderBy(F.abs("contribution").desc(), "feature")
    return out.select("user_id", "article_id", "feature", "contribution", F.row_number().over(order).alias("place"))


def explained(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """rows (user_id, article_id, base, features) with score, as recommended gives it, and contributions (feature, contribution), the largest first, as contributions gives them. A user's weights are
    gathered and meet each of the user's rows: no row is made for a feature."""
    own = weights.groupBy("user_id").agg(F.collect_list(F.struct("feature", "weight")).alias("_own"))
    used = F.filter("_own", lambda w: F.array_contains("features", w["feature"]))
    out = rows.join(own, "user_id", "left").withColumn("_own", F.coalesce(used, F.array().cast(own.schema["_own"].dataType)))
    out = out.withColumn("_t", F.aggregate("_own", F.lit(0.0), lambda s, w: s + w["weight"])).withColumn("score", recommend_score(F.col("base"), F.col("_t")))
    less = lambda w: F.col("score") - recommend_score(F.col("base"), F.col("_t") - w["weight"])
    parts = F.filter(F.transform("_own", lambda w: F.struct(-F.abs(less(w)).alias("place"), w["feature"].alias("feature"), less(w).alias("contribution"))), lambda p: p["contribution"] != 0)
    listed = F.transform(F.sort_array(parts), lambda p: F.struct(p["feature"].alias("feature"), p["contribution"].alias("contribution")))
    return out.withColumn("contributions", listed).drop("_own", "_t")


def leave_one_out(train: DataFrame, prior: float = PRIOR, share: int = 2000) -> DataFrame:
    """(user_id, article_id, prediction): each rating predicted by a model of all of the user's other ones. Ratings alike in base, stars and features have the same
    prediction, so each kind is one row with its count. They are predicted together, from the user's one full fit; those of users with many kinds are spread over parts of so many, which hold all of the user's kinds."""
    alike = ["user_id", "base", "stars", "_kind"]
    rows = saved(train.select("user_id", "article_id", "base", "stars", F.array_sort(F.array_distinct("features")).alias("_kind")))
    kinds = rows.groupBy(*alike).agg(F.count("*").alias("_times"))
    user = Window.partitionBy("user_id")
    kinds = kinds.withColumn("_turn", F.row_number().over(user.orderBy("base", "stars", "_kind"))).withColumn("_parts", F.ceil(F.count("*").over(user) / share).cast("int"))
    parts = kinds.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))

    def one(turn: np.ndarray, base: np.ndarray, stars: np.ndarray, times: np.ndarray, ends: np.ndarray, features: np.ndarray, parts: int, part: int) -> tuple[np.ndarray, np.ndarray]:
        own = np.flatnonzero(turn % parts == part)
        x = np.zeros((len(turn), features.max(initial=-1) + 1))
        x[np.repeat(np.arange(len(turn)), np.diff(ends)), features] = 1
        x = x[:, x.any(axis=0)]
        return turn[own], without_each(base, (stars - 1) / 4, x, own, times, prior)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in chain(batches, [None]):
            rows = pa.Table.from_batches([b for b in (held, batch) if b is not None]) if held is not None or batch is not None else None
            if rows is None or not rows.num_rows:
                continue
            rows = rows.combine_chunks()
            user, part, turn, base, stars, times, parts = (rows.column(c).to_numpy() for c in ("user_id", "part", "_turn", "base", "stars", "_times", "_parts"))
            starts = np.concatenate(([0], np.flatnonzero((user[1:] != user[:-1]) | (part[1:] != part[:-1])) + 1, [len(user)]))
            # the last user may go on in the next batch
            done = len(starts) - (1 if batch is None else 2)
            listed = rows.column("_kind").combine_chunks()
            listed = listed.chunk(0) if isinstance(listed, pa.ChunkedArray) else listed
            ends = listed.offsets.to_numpy()
            names = listed.values.dictionary_encode()
            numbers = names.indices.to_numpy()
            out = []
            for i, j in pairwise(starts[: done + 1]):
                _, own = np.unique(numbers[ends[i] : ends[j]], return_inverse=True)
                out.append((user[i], *one(turn[i:j], base[i:j].astype(float), stars[i:j].astype(float), times[i:j].astype(float), ends[i : j + 1], own, parts[i], part[i])))
            held = rows.slice(starts[done]).to_batches()[0] if starts[done] < rows.num_rows else None
            if out:
                users, turns, found = zip(*out, strict=True)
                yield pa.record_batch([pa.array(np.repeat(users, [len(t) for t in turns])), pa.array(np.concatenate(turns), pa.int32()), pa.array(np.concatenate(found))], names=["user_id", "_turn", "prediction"])

    # dealt by number: these rows are few bytes and much work, which Spark would leave to a few tasks; users come one after another, as a call of Python for each would cost more than its fit
    found = dealt(saved(parts), "user_id", "part").sortWithinPartitions("user_id", "part", "_turn").mapInArrow(predict, "user_id long, _turn int, prediction double")
    predicted = kinds.join(found, ["user_id", "_turn"]).select(*alike, "prediction")
    return rows.join(predicted, alike).select("user_id", "article_id", "prediction")


def review_due(ratings: DataFrame, suggested: DataFrame, versions: DataFrame, requests: DataFrame, least: int = 10) -> DataFrame:
    """(user_id, requested_at, fresh) of users with so many ratings since their last suggestion or profile version, or who asked; those who asked come first."""
    last = suggested.select("user_id", "at").unionByName(versions.select("user_id", F.col("created_at").alias("at"))).groupBy("user_id").agg(F.max("at").alias("_last"))
    fresh = ratings.join(last, "user_id", "left").filter(F.col("_last").isNull() | (F.col("rated_at") > F.col("_last"))).groupBy("user_id").agg(F.count("*").alias("fresh"))
    asked = requests.groupBy("user_id").agg(F.min("requested_at").alias("requested_at"))
    both = fresh.join(asked, "user_id", "full").withColumn("fresh", F.coalesce("fresh", F.lit(0)))
    return both.filter(F.col("requested_at").isNotNull() | (F.col("fresh") >= least)).select("user_id", "requested_at", "fresh")


def auto_apply(comparison: DataFrame, histogram: DataFrame, gain: float = 0.05, least: int = 5) -> DataFrame:
    """(user_id, apply): the candidate's concordance is better by the gain, with enough high ratings and enough low ones (below 3 stars, or at 3 where there are none)."""
    rows = comparison.join(histogram, "user_id")
    low = F.when(F.col("negative") > 0, F.col("negative")).otherwise(F.col("neutral"))
    enough = (F.col("positive") >= least) & (low >= least)
    return rows.select("user_id", F.coalesce((F.col("candidate") - F.col("current") >= gain - 1e-9) & enough, F.lit(False)).alias("apply"))
