"""Helpers that the operators share: session folders, folds, byte views of Arrow text and vectorised word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import saved, shared_folder, written  # noqa: F401

#: Bytes of text that a task turns into arrays at a time; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 19
#: Rows of an Arrow batch.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """df, with batches of at most BATCH_ROWS rows for Python workers in its session: texts are long, and memory has to stay bounded."""
    if int(df.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")) % n


#: Bits of an id filter: fixed, so that it can be broadcast; with many more ids it only lets more rows through to the exact join.
FILTER_BITS = 1 << 23


def id_bit(column: str) -> Column:
    return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(FILTER_BITS))


def id_filter(ids: DataFrame, column: str) -> Broadcast:
    """A bitmap of hashed ids."""
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    words = ids.select(id_bit(column).alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    held = words.toArrow()  # FILTER_BITS / 64 rows at most
    bits[held.column("word").to_numpy()] = held.column("bits").to_numpy()
    return ids.sparkSession.sparkContext.broadcast(bits)


def holds(bits: np.ndarray, at: pa.Array) -> pa.Array:
    """Whether a bitmap has each of these bits set."""
    at = at.to_numpy(zero_copy_only=False)
    return pa.array((bits[at >> 6] >> (at & 63)) & 1 == 1, pa.bool_())


def maybe_in(df: DataFrame, column: str, bits: Broadcast, hit: bool = True) -> DataFrame:
    """The rows whose id has its bit set (all that are in the filter and a few more), or the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = holds(bits.value, batch.column(batch.num_columns - 1))
            yield pa.record_batch(batch.columns[:-1], names=batch.schema.names[:-1]).filter(keep if hit else pc.invert(keep))

    return df.select(*df.columns, id_bit(column).alias("_".join(["_at", *df.columns]))).mapInArrow(run, df.schema)


def once(df: DataFrame, ids: DataFrame, column: str, goes: str) -> DataFrame:
    """df without the rows of ids (column, goes) that go, and with one row of each of the others among ids. Only rows that may be concerned are shuffled for the exact
    join; those without an id stay. An id that repeats has to be among ids."""
    ids = saved(ids.select(column, goes))
    bits = id_filter(ids, column)
    some = maybe_in(df, column, bits).join(ids.filter(goes).select(column), column, "left_anti").select(df.columns)
    some = some.filter(F.col(column).isNotNull()).dropDuplicates([column]).unionByName(some.filter(F.col(column).isNull()))
    return maybe_in(df, column, bits, False).unionByName(some)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and where each row's begin and end (rows + 1 offsets); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    buffers = column.buffers()
    if len(column) == 0 or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many bytes of text, one row at least; no row is left out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(text))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def row_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of so many values."""
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=values, minlength=len(sizes))


def spread(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of whole numbers or flags between offsets."""
    return np.diff(np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[offsets])


# --- word hashes ---------------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


with np.errstate(over="ignore"):
    BASE = np.uint64(0x9E3779B97F4A7C15)
    INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
    BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes whose hashes are summed at a time.
SPAN = 1 << 19
with np.errstate(over="ignore"):
    UP, DOWN = (np.concatenate(([np.uint64(1)], np.cumprod(np.full(SPAN, x), dtype=np.uint64))) for x in (BASE, INVERSE))


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every run of bytes within a row that aren't between words (0x20 and 0x09-0x0D), and the number of words of each row."""
    n = len(data)
    inside = ~between[data]
    first = np.ones(n + 1, bool)
    first[1:] = ~np.append(inside[:-1], False) if n else first[1:]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = inside & (first[:n] | edge[:n])
    following = np.append(~inside[1:], True) if n else np.zeros(0, bool)
    end = inside & (following | edge[1:])
    counted = np.concatenate(([0], np.cumsum(start)))
    return np.flatnonzero(start), np.flatnonzero(end) + 1, np.diff(counted[offsets])


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans (in order, apart from each other) with A-Z lower-cased: a polynomial over random byte values, from running sums."""
    out = np.zeros(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(data), SPAN):
            own = data[at : at + SPAN]
            total = np.concatenate(([np.uint64(0)], np.cumsum(BYTE[LOWER[own]] * UP[: len(own)], dtype=np.uint64)))
            low, high = (0, len(start)) if len(data) <= SPAN else (np.searchsorted(end, at, side="right"), np.searchsorted(start, at + len(own)))
            s, e = np.maximum(start[low:high] - at, 0), np.minimum(end[low:high] - at, len(own))
            scale = DOWN[s]
            if high > low and start[low] < at:  # it began before
                scale[0] = np.uint64(pow(int(BASE), int(at - start[low]), 1 << 64))
            out[low:high] += (total[e] - total[s]) * scale
        return mix(out + (end - start).astype(np.uint64))


def hash_word(word: bytes) -> int:
    """As word_hashes, of one word."""
    data = np.frombuffer(word, np.uint8)
    return int(word_hashes(data, np.array([0]), np.array([len(data)]))[0])
