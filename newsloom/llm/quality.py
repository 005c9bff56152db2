"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

STATISTICS of a text are standardised over the training rows; cosines of random projections approximate a Gaussian
kernel on them. Each partition sums its part of the normal equations, the sums are added by slices, and the driver
solves one system of FEATURES unknowns. All labelled rows of the training fold are used.

Defined results: null and empty texts are scored by their (zero) statistics. Without labels every score is one half. Null ids are scored and
in no fold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, saved, spread, word_hashes, word_spans
from .learning import RAW, ROW, X, calibration, judged, labelled, matrix, measured, whole

FEATURES, WIDTH, RIDGE, SEED, SLICES = 256, 4.0, 1e-3, 20240502, 16
STATISTICS = (
    "log_bytes log_words word_length longest_word letters capitals digits marks symbols spaces lines bytes_a_line capital_words words_with_symbols words_without_letters "
    "distinct_words common_word distinct_triples repeated_lines marks_at_line_ends entropy control"
).split()

_LETTER, _CAPITAL, _DIGIT, _MARK, _SYMBOL = (np.zeros(256, bool) for _ in range(5))
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CAPITAL[65:91] = True
_DIGIT[48:58] = True
_MARK[list(b".,;:!?'\"()-")] = True
_SYMBOL[[c for c in range(33, 127) if not (_LETTER[c] or _DIGIT[c] or _MARK[c])]] = True
_LINE = np.zeros(256, bool)
_LINE[[10, 13]] = True


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text."""
    rows, size = len(offsets) - 1, np.diff(offsets)
    start, end, words = word_spans(data, offsets)
    h = word_hashes(data, start, end)
    line_start, line_end, lines = word_spans(data, offsets, _LINE)
    line_hash = word_hashes(data, line_start, line_end)
    total = np.maximum(size, 1)
    out = np.zeros((rows, len(STATISTICS)))
    sums = {}
    for name, table in (("letters", _LETTER), ("capitals", _CAPITAL), ("digits", _DIGIT), ("marks", _MARK), ("symbols", _SYMBOL), ("spaces", SPACE)):
        running = np.concatenate(([0], np.cumsum(table[data], dtype=np.int32)))
        sums[name] = (np.diff(running[offsets]), running[end] - running[start])
    edge, line_edge = np.concatenate(([0], np.cumsum(words))), np.concatenate(([0], np.cumsum(lines)))
    length = end - start
    count, n_lines = np.maximum(words, 1), np.maximum(lines, 1)
    letters, capitals = sums["letters"][1], sums["capitals"][1]
    put = dict(zip(STATISTICS, range(len(STATISTICS)), strict=True))
    out[:, put["log_bytes"]] = np.log1p(size)
    out[:, put["log_words"]] = np.log1p(words)
    out[:, put["word_length"]] = spread(length, edge) / count
    for name in ("letters", "digits", "marks", "symbols", "spaces"):
        out[:, put[name]] = sums[name][0] / total
    out[:, put["capitals"]] = sums["capitals"][0] / np.maximum(sums["letters"][0], 1)
    out[:, put["lines"]] = n_lines / count
    out[:, put["bytes_a_line"]] = np.log1p(size / n_lines)
    out[:, put["capital_words"]] = spread((letters > 1) & (capitals == letters), edge) / count
    out[:, put["words_with_symbols"]] = spread(sums["symbols"][1] > 0, edge) / count
    out[:, put["words_without_letters"]] = spread(letters == 0, edge) / count
    last = data[line_end - 1] if len(line_end) else np.zeros(0, np.uint8)
    out[:, put["marks_at_line_ends"]] = spread(_MARK[last], line_edge) / n_lines
    control = (data < 32) & ~SPACE[data]
    out[:, put["control"]] = spread(control, offsets) / total
    with np.errstate(over="ignore"):
        triple = h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] if len(h) > 2 else np.zeros(0, np.uint64)
    for i in range(rows):
        a, b = edge[i], edge[i + 1]
        if b > a:
            _, n = np.unique(h[a:b], return_counts=True)
            out[i, put["longest_word"]] = np.log1p(length[a:b].max())
            out[i, put["distinct_words"]] = len(n) / np.sqrt(b - a)
            out[i, put["common_word"]] = n.max() / (b - a)
        if b - a > 2:
            out[i, put["distinct_triples"]] = len(np.unique(triple[a : b - 2])) / (b - 2 - a)
        a, b = line_edge[i], line_edge[i + 1]
        if b > a:
            out[i, put["repeated_lines"]] = 1 - len(np.unique(line_hash[a:b])) / (b - a)
        if size[i]:
            p = np.bincount(data[offsets[i] : offsets[i + 1]], minlength=256) / size[i]
            out[i, put["entropy"]] = -(p[p > 0] * np.log2(p[p > 0])).sum()
    return out


class Features:
    """Random Fourier features of standardised statistics, and a constant."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int = FEATURES):
        rng = np.random.default_rng(SEED)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.turn = rng.normal(size=(len(mean), features)) / WIDTH
        self.shift = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -6, 6)
        return np.concatenate([np.cos(z @ self.turn + self.shift) * np.sqrt(2 / len(self.shift)), np.ones((len(x), 1))], axis=1)


def normal_sums(train: DataFrame, features: Features) -> np.ndarray:
    """Of train (X, label, part) the normal equations of either part: summed in each partition, then by slices of their rows."""
    n = len(features.shift) + 1
    cut = np.linspace(0, 2 * n, SLICES + 1).astype(int)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, n, n + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                rows = batch.slice(at, 4096)
                z, part, label = features(matrix(rows.column(X), len(STATISTICS))), rows.column("part").to_numpy(), rows.column("label").to_numpy()
                for k in (0, 1):
                    total[k] += z[part == k].T @ np.column_stack([z[part == k], label[part == k]])
        if total.any():
            both = total.reshape(2 * n, n + 1)
            yield pa.record_batch([pa.array(range(SLICES), pa.int32()), pa.array([both[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["slice", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column("slice").to_pylist(), batch.column("sums"), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(x.as_buffer())
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["slice", "sums"])

    schema = "slice int, sums binary"
    rows = train.select(X, "label", "part").mapInArrow(partial, schema).repartition("slice").mapInArrow(add, schema).collect()  # SLICES rows of fixed size
    return np.concatenate([np.frombuffer(r["sums"]) for r in sorted(rows, key=lambda r: r["slice"])]).reshape(2, n, n + 1)


def solved(sums: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Ridge weights from summed normal equations."""
    n = len(sums)
    return np.linalg.solve(sums[:, :-1] + ridge * max(sums[-1, -2], 1.0) * np.eye(n) / n, sums[:, -1])


def model(rows: DataFrame, labels: DataFrame, learns: Column) -> tuple[Callable[[np.ndarray], np.ndarray], Callable[[DataFrame], DataFrame]]:
    """From rows (doc_id, X) and labels (doc_id, quality) the raw score of statistics, and what adds SCORE to rows with RAW. The calibration is learned from
    raw scores of rows that their model hasn't seen: each half of the training fold is scored by the weights of the other."""
    train = saved(labelled(rows, labels, "quality", learns).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).cast("int")))
    wide = range(len(STATISTICS))
    moments = train.agg(F.count("*"), *(F.avg(F.col(X)[k]) for k in wide), *(F.stddev_pop(F.col(X)[k]) for k in wide)).collect()[0]
    if not moments[0]:
        return lambda x: np.full(len(x), 0.5), calibration(train.withColumn(RAW, F.lit(0.5)))
    features = Features(np.array(moments[1 : 1 + len(wide)]), np.array(moments[1 + len(wide) :]))
    sums = normal_sums(train, features)

    def scorer(sums: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        weights = solved(sums)
        return lambda x: np.concatenate([features(x[at : at + 4096]) @ weights for at in range(0, len(x), 4096)]) if len(x) else np.zeros(0)

    raw = scorer(sums.sum(axis=0))
    halves = [with_raw(train.filter(F.col("part") == k), scorer(sums[1 - k]) if sums[1 - k].any() else raw) for k in (0, 1)]
    return raw, calibration(halves[0].unionByName(halves[1]))


def with_raw(rows: DataFrame, raw: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """rows with RAW in place of X."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*batch.columns[:-1], pa.array(raw(matrix(batch.column(X), len(STATISTICS))))], names=[*batch.schema.names[:-1], RAW])

    rows = rows.select(*(c for c in rows.columns if c != X), X)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, {RAW} double")


def quality(docs: DataFrame, labels: DataFrame, learns: Column, held_out: Column, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (the probability of quality 1), predicted and raw of every row of docs (doc_id, text). learns and held_out are
    conditions on doc_id."""
    rows = saved(measured(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id"], statistics))
    raw, calibrate = model(rows, labels, learns)
    return judged(calibrate(with_raw(rows, raw)), held_out, threshold)


def scored(docs: DataFrame, labels: DataFrame, learns: Column) -> DataFrame:
    """ROW, RAW and SCORE of every row of docs; texts are read twice, and never shuffled."""
    raw, calibrate = model(measured(docs, ["doc_id"], statistics), labels, learns)
    one = measured(whole(docs), [ROW], lambda data, offsets: raw(statistics(data, offsets))[:, None])
    return calibrate(one.withColumn(RAW, F.col(X)[0]).drop(X))
