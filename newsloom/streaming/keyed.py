"""Folds of logs in the keyed state of a stream: each equals its batch form over all rows that have arrived, in whatever order and batches these came.

A key's state is what the fold needs of its rows and no more, so its size doesn't follow the log; a batch touches the state of its own keys only and gives one row for
each, which says what holds for that key now. The state stores need RocksDB (stateful_session)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.state import MOST_ATTEMPTS

STORE = "spark.sql.streaming.stateStore.providerClass"


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session beside the caller's for such streams: the caller's settings stay as they are."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.session.timeZone", "UTC")
    own.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


class Fold(StatefulProcessor):
    """step(key, state, rows, watermark) gives the new state (None to drop it), the rows for the output and the time (ms) to be woken at, if any; woken(key, state) the rows of that time."""

    def __init__(self, step: Callable, woken: Callable | None = None):
        self.step, self.woken = step, woken

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "value string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = json.loads(self.state.get()[0]) if self.state.exists() else None
        state, out, wake = self.step(key, held, pd.concat(list(rows)), timerValues.getCurrentWatermarkInMs() if self.woken else 0)
        if state is None:
            self.state.clear()
        else:
            self.state.update((json.dumps(state),))
        if self.woken:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
            if wake is not None:
                self.handle.registerTimer(wake)
        yield out

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.woken and self.state.exists():
            yield self.woken(key, json.loads(self.state.get()[0]))

    def close(self) -> None:
        pass


# --- M4: retries -------------------------------------------------------------------------------------------------------

RETRIES = "item_id long, attempts int, next_retry long, due boolean"
HOUR = 3_600_000_000


def _retry_row(key: tuple, state: dict, due: bool) -> pd.DataFrame:
    """What holds for an item: no attempts once a success came behind all failures."""
    given_up = state["permanent"] is not None
    n = MOST_ATTEMPTS if given_up else min(len(state["failures"]), MOST_ATTEMPTS)
    later = state["failures"][0][0] + min(2 ** (n - 1), 7 * 24) * HOUR if 0 < n < MOST_ATTEMPTS else None
    return pd.DataFrame({"item_id": [key[0]], "attempts": pd.array([n], "int32"), "next_retry": pd.array([later], "Int64"), "due": [due]})


def _retry_step(key: tuple, state: dict | None, rows: pd.DataFrame, watermark: int) -> tuple[dict, pd.DataFrame, int | None]:
    """Held are the last success and, of the failures behind it, the newest ones up to the most attempts and the newest permanent one: enough for a success that comes late, too."""
    state = state or {"cleared": None, "failures": [], "permanent": None}
    failures = [tuple(f) for f in state["failures"]]
    for at, event, failed, permanent in rows[["at", "event_id", "failed", "permanent"]].itertuples(index=False):
        mark = (int(at), int(event))
        if not failed:
            state["cleared"] = max(mark, tuple(state["cleared"] or mark))
        else:
            failures.append(mark)
            if permanent:
                state["permanent"] = max(mark, tuple(state["permanent"] or mark))
    cleared = tuple(state["cleared"]) if state["cleared"] else (float("-inf"), 0)
    state["failures"] = sorted({f for f in failures if f > cleared}, reverse=True)[:MOST_ATTEMPTS]
    if state["permanent"] is not None and tuple(state["permanent"]) <= cleared:
        state["permanent"] = None
    out = _retry_row(key, state, False)
    later = out["next_retry"][0]
    return state, out, None if later is pd.NA or later // 1000 <= watermark else int(later) // 1000


def _retry_due(key: tuple, state: dict) -> pd.DataFrame:
    return _retry_row(key, state, True)


def retries(outcomes: DataFrame, late: str = "7 days") -> DataFrame:
    """M4: of a stream of outcomes (item_id, event_id, at, failed, permanent) a row (item_id, attempts, next_retry_at, due) for each item that a batch holds, 0 attempts once a success clears it;
    and one that is due when the time of the stream passes its next try (a timer). Outcomes that come later than the watermark are dropped."""
    rows = outcomes.withColumn("_time", F.col("at").cast("timestamp")).withWatermark("_time", late).withColumn("at", F.unix_micros("_time"))
    found = rows.groupBy("item_id").transformWithStateInPandas(Fold(_retry_step, _retry_due), RETRIES, "Update", "eventTime")
    return found.select("item_id", "attempts", F.timestamp_micros("next_retry").alias("next_retry_at"), "due")


# --- M5: marks ---------------------------------------------------------------------------------------------------------

MARKS = "user_id long, story long, article_id long, stars int, read long, bookmarked long"
MARK = ["at", "event_id", "article_id", "action", "stars"]


def _story_marks(key: tuple, state: dict | None, rows: Iterable[tuple], watermark: int) -> tuple[dict, list[tuple]]:
    """Held for a story are the last undoing of a reading, and for its articles the last rating and undoing of a bookmark, and the readings and bookmarks behind these: of those before the watermark,
    behind which no undoing can come any more, the first only."""
    state = state or {"unread": None, "articles": {}}
    newest = lambda a, b: b if a is None else max(tuple(a), b)
    for ts, event, article, action, stars in rows:
        mark = (int(ts), int(event))
        own = state["articles"].setdefault(str(int(article)), {"rate": None, "unmark": None, "read": [], "bookmark": []})
        if action == "unread":
            state["unread"] = newest(state["unread"], mark)
        elif action == "unbookmark":
            own["unmark"] = newest(own["unmark"], mark)
        elif action == "rate":
            own["rate"] = newest(own["rate"], (*mark, int(stars)))
        else:
            own[action].append(mark)
    out = []
    for article, own in state["articles"].items():
        for action, undone in (("read", state["unread"]), ("bookmark", own["unmark"])):
            kept = sorted({tuple(m) for m in own[action] if undone is None or tuple(m) > tuple(undone)})
            final = [m for m in kept if m[0] < watermark * 1000]
            own[action] = final[:1] + kept[len(final) :]
        stars = own["rate"][2] if own["rate"] and own["rate"][2] > 0 else None
        out.append((*key, int(article), stars, *(own[a][0][0] if own[a] else None for a in ("read", "bookmark"))))
    return state, out


def _mark_frame(out: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(out, columns=["user_id", "story", "article_id", "stars", "read", "bookmarked"])
    return frame.astype({"stars": "Int32", "read": "Int64", "bookmarked": "Int64"})


def _mark_step(key: tuple, state: dict | None, rows: pd.DataFrame, watermark: int) -> tuple[dict, pd.DataFrame, None]:
    """One story's marks."""
    state, out = _story_marks(key, state, rows[MARK].itertuples(index=False), watermark)
    return state, _mark_frame(out), None


def _user_marks_step(key: tuple, state: dict | None, rows: pd.DataFrame, watermark: int) -> tuple[dict, pd.DataFrame, None]:
    """A user's stories together: a call, a state and a frame for each story cost more than its marks. Rows are given for the stories that were touched."""
    state, touched, out = state or {}, {}, []
    for story, *mark in rows[["story", *MARK]].itertuples(index=False):
        touched.setdefault(int(story), []).append(mark)
    for story, marked in touched.items():
        state[str(story)], rows_ = _story_marks((*key, story), state.get(str(story)), marked, watermark)
        out += rows_
    return state, _mark_frame(out), None


def _no_wake(key: tuple, state: dict) -> pd.DataFrame:
    return pd.DataFrame()


def marks(log: DataFrame, stories: DataFrame, late: str = "7 days") -> DataFrame:
    """M5: of a stream of marks (user_id, article_id, event_id, ts, action, stars) a row (user_id, article_id, stars, read_at, bookmarked_at) for each marked article of the stories that a batch touches.
    stories (article_id, story_id) is a table; articles without one are their own. Marks that come later than the watermark are dropped."""
    rows = log.join(stories.select("article_id", "story_id"), "article_id", "left").withColumn("story", F.coalesce("story_id", "article_id"))
    rows = rows.withColumn("_time", F.col("ts").cast("timestamp")).withWatermark("_time", late).withColumn("at", F.unix_micros("_time"))
    rows = rows.select("user_id", "story", "article_id", "event_id", "at", "_time", "action", "stars")
    found = rows.groupBy("user_id").transformWithStateInPandas(Fold(_user_marks_step, _no_wake), MARKS, "Update", "eventTime")
    return found.select("user_id", "article_id", "stars", F.timestamp_micros("read").alias("read_at"), F.timestamp_micros("bookmarked").alias("bookmarked_at"))


# --- what such streams write -------------------------------------------------------------------------------------------


def changes(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch's rows as a partition under its number; a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def current(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """What the newest change of each key says."""
    rows = spark.read.parquet(path)
    values = F.struct(*[c for c in rows.columns if c not in (*keys, "batch")])
    return rows.groupBy(*keys).agg(F.max_by(values, F.col("batch").cast("long")).alias("_v")).select(*keys, "_v.*")
