"""Language-model scores: context-tree weighting over bytes.

A text is its words, lower-cased (A-Z), each followed by a space, the last by a newline that stands for the end. Every byte is eight
binary decisions; a decision's contexts are the 0 to DEPTH bytes before. Each context has a Krichevsky-Trofimov estimate
of each of its 255 decisions, and weighting mixes, over all depths and with the weights that the training corpus gives
them, "this context decides" and "longer contexts decide".

The counts cover all training documents, and every context that occurs in them is a node, to the full depth. A node holds its
decisions sparsely. Grams (a byte and the DEPTH before it) are dealt into buckets by the TOP + 1 nearest bytes of their context, so
the nodes from there on are weighted within a bucket; what they come to is summed for the nodes above, of which there are at most 256 ** TOP
with 255 decisions each, whatever the corpus. Those are weighted on the driver and broadcast.

A text's grams with at least GRAM_SHARE of the training bytes are looked up in a broadcast table (at most 1 / GRAM_SHARE of them); the
others go to their bucket, where those not seen in training end at their longest context that was.

The base score is that of a unigram of words with one added to each count. Words with at least WORD_SHARE of the corpus are looked up in
a broadcast table (at most 1 / WORD_SHARE of them); the others are joined, so that no word gathers in a task.

Defined results: null or empty text is its end alone. Without any training document all estimates are one half, and the base has N = V =
0. Null ids are in no fold (not held out, not learned from) and keep their rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, chunks, row_sums, saved, small_batches, text_bytes, word_hashes, word_spans

DEPTH, TOP, GRAM_SHARE, WORD_SHARE = 5, 2, 2.0**-22, 2.0**-20
#: Grams of a bucket, about.
BUCKET = 1 << 15
#: Counts that a task holds before it merges them.
HELD = 4_000_000


# --- text to bytes and contexts ----------------------------------------------------------------------------------------


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every row's words, each with one space behind it but the last with a newline; a row without words is the newline."""
    data = np.insert(LOWER[data], offsets[1:], 10)
    offsets = offsets + np.arange(len(offsets))
    inside = ~SPACE[data]
    after = np.zeros(len(data), bool)
    after[1:] = ~inside[1:] & inside[:-1]
    keep = inside | after
    words = np.concatenate(([0], np.cumsum(after)))[offsets]
    keep[offsets[1:][np.diff(words) == 0] - 1] = True
    out = np.where(inside, data, np.uint8(32))[keep]
    offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
    out[offsets[1:] - 1] = 10
    return out, offsets


def grams(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """For each byte: itself in the lowest eight bits, above it the bytes before, the nearest lowest; before a row stands a newline."""
    out = data.astype(np.int64)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, depth + 1):
        before = np.full(len(data), 10, np.int64)
        before[k:] = data[:-k] if len(data) > k else []
        before[place < k] = 10
        out |= before << (8 * k)
    return out


class Counts:
    """Counts of 64-bit keys, merged now and then."""

    def __init__(self) -> None:
        self.keys, self.counts, self.more = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        self.waiting = 0

    def add(self, keys: np.ndarray) -> None:
        keys, n = np.unique(keys, return_counts=True)
        self.more.append((keys, n))
        self.waiting += len(keys)
        if self.waiting > max(HELD // 2, len(self.keys) // 2):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.more)])
        counts = np.concatenate([self.counts, *(n for _, n in self.more)])
        self.keys, at = np.unique(keys, return_inverse=True)
        self.counts = np.bincount(at, weights=counts, minlength=len(self.keys)).astype(np.int64)
        self.more, self.waiting = [], 0

    def rows(self, kind: int) -> Iterator[pa.RecordBatch]:
        self.merge()
        for low in range(0, len(self.keys), 100_000):
            k, n = self.keys[low : low + 100_000], self.counts[low : low + 100_000]
            yield pa.record_batch([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n)], names=["kind", "key", "n"])
        self.__init__()


def corpus_counts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(kind, key, n) over all of docs: 0 for grams of bytes, 1 for hashes of words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Counts(), Counts()
        for batch in chunks(batches):
            data, offsets = text_bytes(batch.column("text"))
            both[0].add(grams(*canonical(data, offsets), depth))
            start, end, _ = word_spans(data, offsets)
            both[1].add(word_hashes(data, start, end).view(np.int64))
            for kind, c in enumerate(both):
                if len(c.keys) > HELD:
                    yield from c.rows(kind)
        for kind, c in enumerate(both):
            yield from c.rows(kind)

    return docs.select("text").mapInArrow(count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


# --- the tree --------------------------------------------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function of positive numbers, by Stirling's series from 8 on."""
    x = np.array(x, np.float64)
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        shift[low] -= np.log(x[low])
        x[low] += 1
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)


def decisions(n: np.ndarray) -> np.ndarray:
    """From counts of 256 bytes (rows) the counts of zeros and ones at each of the 255 decisions."""
    return np.concatenate([n.reshape(len(n), 1 << b, 2, 1 << (7 - b)).sum(axis=3) for b in range(8)], axis=1)


def log_kt(d: np.ndarray) -> np.ndarray:
    """The log probability that the estimator gives to a decision's zeros and ones."""
    return log_gamma(d[..., 0] + 0.5) + log_gamma(d[..., 1] + 0.5) - log_gamma(d.sum(axis=-1) + 1) - math.log(math.pi)


def next_kt(d: np.ndarray) -> np.ndarray:
    """The probability of a one at the next decision."""
    return (d[..., 1] + 0.5) / (d.sum(axis=-1) + 1)


def byte_logs(one: np.ndarray) -> np.ndarray:
    """log10 probabilities of 256 bytes from those of a one at 255 decisions."""
    x = np.arange(256)
    out = np.zeros((len(one), 256))
    for b in range(8):
        p = one[:, (1 << b) - 1 + (x >> (8 - b))]
        out += np.log10(np.where(x >> (7 - b) & 1, p, 1 - p))
    return out


class Tree:
    """The same in memory for a small corpus, with given contexts; rarer ones of a node are one leaf together.

    The nodes (depth, context) and, for each, the log10 probabilities of the next byte where no longer context is a node."""

    def __init__(self, nodes: dict[tuple[int, int], np.ndarray], depth: int = DEPTH):
        nodes = dict(nodes) if nodes else {(0, 0): np.zeros(256)}
        keys = sorted(nodes)
        row = {k: i for i, k in enumerate(keys)}
        level = np.array([d for d, _ in keys])
        parent = np.array([row[d - 1, c & (1 << 8 * (d - 1)) - 1] if d else -1 for d, c in keys])
        n = np.stack([nodes.pop(k) for k in keys]).astype(np.float64)
        rest = n.copy()
        np.subtract.at(rest, parent[level > 0], n[level > 0])
        own, below = np.zeros((len(keys), 255)), np.zeros((len(keys), 255))
        one, one_below = np.zeros((len(keys), 255), np.float32), np.zeros((len(keys), 255), np.float32)
        for low in range(0, len(keys), 2000):
            part = slice(low, low + 2000)
            d = decisions(n[part])
            own[part], one[part] = log_kt(d), next_kt(d)
            d = decisions(rest[part])
            below[part], one_below[part] = log_kt(d), next_kt(d)
        del n, rest
        below[level == depth] = 0
        stop = np.ones(own.shape, np.float32)  # the weight of "this context decides"
        for d in range(depth, -1, -1):
            at = np.flatnonzero(level == d)
            weighted = own[at]
            if d < depth:
                weighted = np.logaddexp(own[at], below[at]) - math.log(2)
                stop[at] = np.exp(own[at] - math.log(2) - weighted)
            if d:
                np.add.at(below, parent[at], weighted)
        del own, below
        mixed, left = np.zeros(stop.shape, np.float32), np.ones(stop.shape, np.float32)
        for d in range(depth + 1):
            at = np.flatnonzero(level == d)
            if d:
                mixed[at], left[at] = mixed[parent[at]], left[parent[at]]
            mixed[at] += left[at] * stop[at] * one[at]
            left[at] *= 1 - stop[at]
        mixed += left * one_below  # 0 is left at the full depth
        self.depth = depth
        self.logs = np.zeros((len(keys), 256), np.float32)
        for low in range(0, len(keys), 2000):
            self.logs[low : low + 2000] = byte_logs(np.clip(mixed[low : low + 2000].astype(np.float64), 1e-9, 1 - 1e-9))
        # nodes by a hash table of open addresses
        self.bits = max(4, (8 * len(keys)).bit_length())
        self.slots, self.rows = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        for i, (d, c) in enumerate(keys):
            key = np.array([c << 3 | d])
            s = int(self._slot(key)[0])
            while self.slots[s] != -1:
                s = (s + 1) & ((1 << self.bits) - 1)
            self.slots[s], self.rows[s] = key[0], i

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def leaf(self, context: np.ndarray) -> np.ndarray:
        """The row of the longest node that ends each context."""
        out = np.zeros(len(context), np.int32)
        todo = np.arange(len(context))
        for d in range(self.depth, -1, -1):
            key = ((context[todo] & (1 << 8 * d) - 1) << 3) | d
            slot = self._slot(key)
            seen = self.slots[slot]
            hit = seen == key
            again = np.flatnonzero(~hit & (seen != -1))
            while len(again):
                slot[again] = (slot[again] + 1) & ((1 << self.bits) - 1)
                seen = self.slots[slot[again]]
                hit[again] = seen == key[again]
                again = again[(seen != key[again]) & (seen != -1)]
            out[todo[hit]] = self.rows[slot[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log10 probability of each canonical row."""
        g = grams(data, offsets, self.depth)
        return row_sums(self.logs[self.leaf(g >> 8), g & 255], np.diff(offsets))


# --- the tree in buckets ---------------------------------------------------------------------------------------------

#: Nodes of each depth: keys (decision above context, the nearest byte of the context highest), in order; the probability of a one from
#: this depth and those above it; the weight that is left to longer contexts.
Nodes = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
_SMALL = 1 << 12
_HALVES, _WHOLE = log_gamma(np.arange(_SMALL) + 0.5), log_gamma(np.arange(_SMALL) + 1.0)


def _gamma_of(n: np.ndarray, plus: float) -> np.ndarray:
    """log_gamma(n + plus) of counts, plus 0.5 or 1."""
    out = (_HALVES if plus == 0.5 else _WHOLE)[np.minimum(n, _SMALL - 1).astype(np.int64)]
    large = n >= _SMALL
    out[large] = log_gamma(n[large] + plus)
    return out


def turned(g: np.ndarray) -> np.ndarray:
    """Grams with the nearest byte of the context highest; the byte itself stays lowest."""
    out = g & 255
    for k in range(1, DEPTH + 1):
        out = out | (g >> 8 * k & 255) << 8 * (DEPTH + 1 - k)
    return out


def split(t: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of decision b of turned grams (1 to 255), and its outcome."""
    x = t & 255
    return x >> 8 - b | 1 << b, x >> 7 - b & 1


def ascend(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray, high: int, low: int) -> tuple[dict, tuple]:
    """From the nodes of depth high those down to depth low, weighted, and the keys, counts and log probabilities of the depth before."""
    levels = {}
    for d in range(high, low - 1, -1):
        own = _gamma_of(zeros, 0.5) + _gamma_of(ones, 0.5) - _gamma_of(zeros + ones, 1.0) - math.log(math.pi)
        weighted, stop, go = own, np.ones(len(keys)), np.zeros(len(keys))
        if d < DEPTH:
            weighted = np.logaddexp(own, below) - math.log(2)
            stop, go = (np.exp(x - math.log(2) - weighted) for x in (own, below))
        up = keys >> 8
        edge = np.append(True, up[1:] != up[:-1])[: len(up)]
        levels[d] = keys, stop * (ones + 0.5) / (zeros + ones + 1), go, np.cumsum(edge) - 1
        first = np.flatnonzero(edge)
        keys, zeros, ones, below = up[first], *(np.add.reduceat(v, first) if len(first) else v for v in (zeros, ones, weighted))
    return levels, (keys, zeros, ones, below)


def descend(levels: dict, mixed: np.ndarray, left: np.ndarray) -> Nodes:
    """The mixtures of weighted nodes, from those of the depth before."""
    out = {}
    for d in sorted(levels):
        keys, one, go, parent = levels[d]
        mixed, left = mixed[parent] + left[parent] * one, left[parent] * go
        out[d] = keys, mixed, left
    return out


def bucket_levels(g: np.ndarray, n: np.ndarray) -> tuple[dict, tuple]:
    """As ascend, of a bucket's grams and their counts, from DEPTH to TOP + 1."""
    t = turned(g)
    s, bit = (np.concatenate(x) for x in zip(*(split(t, b) for b in range(8)), strict=True))
    keys, at = np.unique(s << 8 * DEPTH | np.tile(t >> 8, 8), return_inverse=True)
    zeros, ones = (np.bincount(at, weights=np.tile(n, 8) * (bit == k), minlength=len(keys)) for k in (0, 1))
    return ascend(keys, zeros, ones, np.zeros(len(keys)), DEPTH, TOP + 1)


def bucket_nodes(g: np.ndarray, n: np.ndarray, top: Nodes) -> Nodes:
    levels, (keys, *_) = bucket_levels(g, n)
    known, mixed, left = top[TOP]
    at = np.searchsorted(known, keys)
    return top | descend(levels, mixed[at], left[at])


def gram_logs(nodes: Nodes, g: np.ndarray) -> np.ndarray:
    """log10 probabilities of grams: each decision by its longest context among the nodes; beyond it, and where there is none, by one half."""
    t, out = turned(g), np.zeros(len(g))
    for b in range(8):
        s, bit = split(t, b)
        one, todo = np.full(len(t), 0.5), np.arange(len(t))
        for d in range(DEPTH, -1, -1):
            if d not in nodes or not len(nodes[d][0]):
                continue
            keys, mixed, left = nodes[d]
            k = s[todo] << 8 * d | t[todo] >> 8 * (DEPTH + 1 - d)
            at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
            hit = keys[at] == k
            one[todo[hit]] = (mixed + left / 2)[at[hit]]
            todo = todo[~hit]
        out += np.log10(np.where(bit, one, 1 - one))
    return out


def bucket_of(g: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a gram, by the TOP + 1 nearest bytes of its context."""
    return ((g >> 8 & (1 << 8 * (TOP + 1)) - 1) * 2654435761 >> 16) % buckets


def in_buckets(of_bytes: DataFrame, buckets: int) -> DataFrame:
    """(bucket, key, n): a row for each bucket, with the grams and their counts."""
    context = F.shiftright("key", 8).bitwiseAND((1 << 8 * (TOP + 1)) - 1)
    bucket = (F.shiftright(context * F.lit(2654435761), 16) % buckets).cast("int")  # as bucket_of
    rows = of_bytes.groupBy(bucket.alias("bucket")).agg(F.collect_list(F.struct("key", "n")).alias("x"))
    return saved(rows.select("bucket", F.transform("x", lambda x: x["key"]).alias("key"), F.transform("x", lambda x: x["n"]).alias("n")))


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list]:
    """Each row's value, or array of values, of some columns."""
    for batch in batches:
        columns = [batch.column(c) for c in names]
        for i in range(batch.num_rows):
            yield [None if not c[i].is_valid else c[i].values.to_numpy() if pa.types.is_list(c.type) else c[i].as_py() for c in columns]


def fit_top(packed: DataFrame) -> Nodes:
    """The nodes up to depth TOP."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, n in _rows(batches, "key", "n"):
            _, sums = bucket_levels(g, n)
            yield pa.record_batch([pa.array(v) for v in sums], names=["key", "zeros", "ones", "below"])

    each = packed.mapInArrow(run, "key long, zeros double, ones double, below double")
    sums = each.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below"))).orderBy("key").toArrow()  # 256 ** TOP * 255 rows at most
    levels, _ = ascend(*(sums.column(c).to_numpy() for c in ("key", "zeros", "ones", "below")), TOP, 0)
    return descend(levels, np.zeros(1), np.ones(1))


def frequent_logs(packed: DataFrame, top: Broadcast, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The grams that occur so often, in order, and their log10 probabilities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, n in _rows(batches, "key", "n"):
            often = g[n >= least]
            if len(often):
                yield pa.record_batch([pa.array(often), pa.array(gram_logs(bucket_nodes(g, n, top.value), often))], names=["key", "log"])

    table = packed.mapInArrow(run, "key long, log double").toArrow()
    keys, logs = table.column("key").to_numpy(), table.column("log").to_numpy()
    order = np.argsort(keys)
    return keys[order], logs[order]


def rare_sums(packed: DataFrame, asked: DataFrame, top: Broadcast) -> DataFrame:
    """(row, rare_score): the sums of the log10 probabilities of the grams asked for (bucket, key, first, rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, nodes, waiting, size = None, top.value, [], 0

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, size
            if waiting:
                g, at = np.unique(np.concatenate([w[0] for w in waiting]), return_inverse=True)
                rows, logs = np.concatenate([w[1] for w in waiting]), gram_logs(nodes, g)[at]
                for low in range(0, len(rows), 100_000):
                    yield pa.record_batch([pa.array(rows[low : low + 100_000]), pa.array(logs[low : low + 100_000])], names=["row", "rare_score"])
            waiting, size = [], 0

        for at, g, n, first, local in _rows(batches, "bucket", "key", "n", "first", "rows"):
            if at != bucket:
                yield from settle()
                bucket, nodes = at, top.value
            if n is not None:
                nodes = bucket_nodes(g, n, top.value)
                continue
            waiting.append((g.copy(), local.astype(np.int64) + first))
            size += len(g)
            if size > HELD // 8:
                yield from settle()
        yield from settle()

    both = packed.select("bucket", "key", "n", F.lit(None).cast("long").alias("first"), F.lit(None).cast("array<int>").alias("rows"))
    both = both.unionByName(asked.select("bucket", "key", F.lit(None).cast("array<long>").alias("n"), "first", "rows"))
    both = both.repartition("bucket").sortWithinPartitions("bucket", F.col("first").asc_nulls_first())
    return both.mapInArrow(run, "row long, rare_score double").groupBy("row").agg(F.sum("rare_score").alias("rare_score"))


# --- scores ----------------------------------------------------------------------------------------------------------


def scores(docs: DataFrame, learns: Column, held_out: Column, gram_share: float = GRAM_SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row of docs (doc_id, text), learned from
    the rows where learns holds. gram_share: that of the grams that are broadcast, which doesn't change the scores."""
    spark = docs.sparkSession
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(learns, F.lit(False)).alias("learns"))
    learned = docs.filter("learns")
    counts = saved(corpus_counts(learned))
    of_bytes = counts.filter("kind = 0")
    n_bytes, n_grams = of_bytes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).collect()[0]
    buckets = n_grams // BUCKET + 1
    packed = in_buckets(of_bytes, buckets)
    top = spark.sparkContext.broadcast(fit_top(packed))
    often = spark.sparkContext.broadcast(frequent_logs(packed, top, max(1.0, gram_share * n_bytes)))
    ends = learned.count()
    words = counts.filter("kind = 1")
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).collect()[0]
    total, distinct = tokens + ends, distinct + (ends > 0)
    frequent = F.col("n") >= max(1.0, WORD_SHARE * total)
    known = words.filter(frequent).select("key", "n").orderBy("key").toPandas()  # 1 / WORD_SHARE rows at most
    known = spark.sparkContext.broadcast((known["key"].to_numpy(np.int64), known["n"].to_numpy(np.float64)))
    below = math.log10(total + distinct + 1)
    end_log = math.log10(ends + 1) - below

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = known.value
        logs = np.log10(n + 1) - below
        for batch in chunks(batches):
            data, offsets = text_bytes(batch.column("text"))
            plain, at = canonical(data, offsets)
            start, end, count = word_spans(data, offsets)
            h = word_hashes(data, start, end).view(np.int64)
            row = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
            hit = keys[row] == h if len(keys) else np.zeros(len(h), bool)
            edge = np.concatenate(([0], np.cumsum(count)))
            part = row_sums(np.where(hit, logs[row] if len(keys) else 0.0, 0.0), count)
            found = np.concatenate(([0], np.cumsum(hit)))[edge]
            rare = np.concatenate(([0], np.cumsum(~hit)))[edge]
            grams_of, doc = grams(plain, at), np.repeat(np.arange(len(at) - 1), np.diff(at))
            each, where = np.unique(grams_of, return_inverse=True)
            place = np.minimum(np.searchsorted(often.value[0], each), max(0, len(often.value[0]) - 1))
            common = often.value[0][place] == each if len(often.value[0]) else np.zeros(len(each), bool)
            score = row_sums(np.where(common, often.value[1][place], 0.0)[where] if len(often.value[0]) else np.zeros(len(where)), np.diff(at))
            columns = [
                batch.column("row"), batch.column("doc_id"), batch.column("held_out"), pa.array(count + 1, pa.int64()), pa.array(np.diff(found) + (ends > 0), pa.int64()),
                pa.array(part + end_log), pa.array(score), pa.array(np.diff(at), pa.int64()),
                pa.ListArray.from_arrays(pa.array(rare.astype(np.int32)), pa.array(h[~hit])),
            ]
            yield pa.record_batch([*columns, *(pa.nulls(batch.num_rows, f.type) for f in asks)], names=[*names, *asks.names])
            rare_at = np.flatnonzero(~common[where])
            if len(rare_at):
                b = bucket_of(grams_of[rare_at], buckets)
                order = np.argsort(b, kind="stable")
                rare_at, b = rare_at[order], b[order]
                first = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
                edges = pa.array(np.append(first, len(b)).astype(np.int32))
                key, rows = pa.array(grams_of[rare_at]), pa.array(doc[rare_at].astype(np.int32))  # row numbers of a batch follow on each other
                asked = [pa.array(b[first].astype(np.int32)), pa.ListArray.from_arrays(edges, key), pa.array(np.full(len(first), batch.column("row")[0].as_py())), pa.ListArray.from_arrays(edges, rows)]
                yield pa.record_batch([*(pa.nulls(len(first), c.type) for c in columns), *asked], names=[*names, *asks.names])

    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "n_bytes", "rare"]
    asks = pa.schema([("bucket", pa.int32()), ("key", pa.list_(pa.int64())), ("first", pa.int64()), ("rows", pa.list_(pa.int32()))])
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, n_bytes long, rare array<long>, bucket int, key array<long>, first long, rows array<int>"
    both = saved(docs.drop("learns").withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, schema))
    scored = both.filter("bucket is null").drop(*asks.names)
    rare_grams = rare_sums(packed, both.filter("bucket is not null"), top)
    # the words that aren't broadcast
    others = words.filter(~frequent).select("key", "n")
    rare = scored.select("row", F.explode("rare").alias("key")).join(others, "key", "left")
    c = F.coalesce("n", F.lit(0))
    rare = rare.groupBy("row").agg(F.sum(F.log10(c + 1) - below).alias("rare_base"), F.sum(F.when(c > 0, 1).otherwise(0)).alias("rare_known"))
    joined = scored.drop("rare").join(rare, "row", "left").join(rare_grams, "row", "left").withColumn("score", F.col("score") + F.coalesce("rare_score", F.lit(0.0)))
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), "score", (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )
