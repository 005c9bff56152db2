"""Vector codes: each of a vector's equal parts becomes the number of its nearest codebook entry, searched by integer Walsh-Hadamard transforms.

Each component x becomes floor(scale * x). Each part position has a codebook of its own, which starts as that part of the vectors with the smallest ids; a round assigns
every part to its nearest entry (squared Euclidean distance, ties to the lower index) and replaces each entry by the floor of its parts' mean; an unused one stays. Then parts are assigned once more.

Parts and entries are padded with zeros to a power of two and transformed by sums and differences, so that the squared differences of all coefficients add up to exactly
width times the squared distance. They are accumulated in sequency order (by changes of sign, so that the coarse shape comes first). The entry that is
nearest so far, after the first coefficient and after two, three, five and so on, gives a bound by its whole sum; an entry whose sum exceeds the smallest bound is eliminated, equal ones stay for the tie. All is in whole numbers.

Each task sums its parts by position and entry, so a round shuffles as many rows as there are tasks, positions and entries. Codebooks (positions x entries, parameters) are all that
driver and tasks hold. Errors by label are summed before they are joined to the rows by (label, salt), so that no label is one task's.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part; neither do those of another length than the vector with the smallest id, nor ones with
a component so large that errors may not fit 64 bits (beyond 2^18 at 64 dimensions and scale 256). A length that the number of parts doesn't divide is padded with zeros. Rows without an id are coded, but
start no entry. Rows that repeat are rows of their own; of equal ids the smaller vector comes first. With fewer vectors than entries there are as many entries. An empty table gives an empty one. A label's sum beyond 64 bits is null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .orchard import rows_of, whole_numbers

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Tasks that rows of one label are dealt to.
SALTS = 16


def sequency(width: int) -> np.ndarray:
    """The rows of the Hadamard matrix of this power of two, by their changes of sign."""
    h = np.ones((1, 1), np.int64)
    while len(h) < width:
        h = np.block([[h, h], [h, -h]])
    return np.argsort((np.diff(h, axis=1) != 0).sum(axis=1), kind="stable")


def transform(x: np.ndarray) -> np.ndarray:
    """The integer Walsh-Hadamard transform of rows, padded with zeros to a power of two, in sequency order."""
    rows, n = x.shape
    width = 1 << max(0, n - 1).bit_length()
    y = np.zeros((rows, width), np.int64)
    y[:, :n] = x
    h = 1
    while h < width:
        y = y.reshape(rows, width // (2 * h), 2, h)
        y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(rows, width)
        h *= 2
    return y[:, sequency(width)]


def lowest(row: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The place of the first lowest total of each row; rows stand together."""
    low = np.minimum.reduceat(total, np.flatnonzero(np.diff(row, prepend=-1)))
    hit = np.flatnonzero(total == low[row])
    return hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of transformed rows: the number and squared distance of each part's nearest entry, and how many squared differences that took."""
    n, width = parts.shape
    total = (parts[:, :1] - entries[:, 0]) ** 2
    bound = ((parts - entries[total.argmin(axis=1)]) ** 2).sum(axis=1)
    row, entry = np.nonzero(total <= bound[:, None])
    total = total[row, entry]
    taken = n * (len(entries) + width)
    for j in range(1, width):  # every row keeps one entry at least, in order
        total += (parts[row, j] - entries[entry, j]) ** 2
        taken += len(row)
        if j & (j - 1) == 0 and 2 * j < width:
            bound = np.minimum(bound, ((parts - entries[entry[lowest(row, total)]]) ** 2).sum(axis=1))
            taken += n * width
        stays = total <= bound[row]
        row, entry, total = row[stays], entry[stays], total[stays]
    first = lowest(row, total)
    return entry[first], total[first] // width, taken


class Codebooks:
    def __init__(self, at: np.ndarray):
        """at: position, entry, component."""
        self.at = at
        self.turned = [transform(book) for book in at]

    def split(self, x: np.ndarray) -> np.ndarray:
        """Rows of vectors as row, position, component."""
        positions, _, width = self.at.shape
        return np.pad(x, ((0, 0), (0, positions * width - x.shape[1]))).reshape(len(x), positions, width)

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries of every row's parts, and the sum of their squared distances."""
        parts = self.split(x)
        codes, error = np.zeros(parts.shape[:2], np.int64), np.zeros(len(x), np.int64)
        for p, book in enumerate(self.turned):
            codes[:, p], d, _ = nearest(transform(parts[:, p]), book)
            error += d
        return codes, error


def _sums(books: Codebooks, scale: int):
    """A task's number of parts and sums of components for each position and entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positions, entries, width = books.at.shape
        count, total = np.zeros((positions, entries), np.int64), np.zeros((positions, entries, width), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = rows_of(batch, scale)
                codes, _ = books.code(x)
                at = (np.arange(positions), codes)
                np.add.at(count, at, 1)
                np.add.at(total, at, books.split(x))
        p, e = np.nonzero(count)
        columns = [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), pa.array(total[p, e].tolist(), pa.list_(pa.int64()))]
        yield pa.record_batch(columns, names=["position", "entry", "n", "sums"])

    return run


def _coded(books: Codebooks, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, error = books.code(rows_of(batch, scale))
                text = [bytes(row).hex() for row in codes.astype(np.uint8)]
                yield pa.record_batch([batch.column("vec_id"), pa.array(text), pa.array(error), batch.column("label")], names=["vec_id", "code", "error", "label"])

    return run


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 for every row of vectors (vec_id, embedding, label) that takes part; at most 256 entries, two hex digits each."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's number has two hex digits")
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), "label")
    given = given.filter(whole_numbers(F.col("v"), scale, 2**52) & (F.size("v") > 0))
    smallest = given.filter("vec_id is not null").orderBy("vec_id", "v").select(F.size("v").alias("n")).first()
    if smallest is None:
        return given.select("vec_id", F.lit("").alias("code"), *(F.lit(0).cast("long").alias(c) for c in ("error", "label_error")), F.lit("").alias("codebooks_sha256")).filter("false")
    dimension = smallest.n
    width = -(-dimension // parts)
    padded = parts * (1 << max(0, width - 1).bit_length())
    largest = math.isqrt(2**62 // (padded // parts * padded)) // 2
    x = given.filter((F.size("v") == dimension) & whole_numbers(F.col("v"), scale, largest))
    first = x.filter("vec_id is not null").orderBy("vec_id", "v").limit(entries).select("v").collect()  # as many rows as entries
    if not first:
        return compress(vectors.filter("false"), parts, entries, rounds, scale)
    start = np.zeros((len(first), parts * width), np.int64)
    start[:, :dimension] = np.floor(np.array([r.v for r in first]) * scale)
    books = Codebooks(start.reshape(len(first), parts, width).transpose(1, 0, 2))
    for _ in range(rounds):
        sums = x.select("vec_id", "v").mapInArrow(_sums(books, scale), "position int, entry int, n long, sums array<long>")
        sums = sums.groupBy("position", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(width))).alias("sums"))
        at = books.at.copy()
        for r in sums.collect():  # positions x entries
            at[r.position, r.entry] = [int(s) // r.n for s in r.sums]
        books = Codebooks(at)
    digest = hashlib.sha256(",".join(map(str, books.at.ravel().tolist())).encode()).hexdigest()
    kind = x.schema["label"].dataType.simpleString()
    coded = saved(x.mapInArrow(_coded(books, scale), f"vec_id long, code string, error long, label {kind}")).withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    by_label = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    by_label = by_label.select(F.col("label").alias("of"), F.expr("try_cast(total as bigint)").alias("label_error"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("at"))
    found = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("at")))
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle_sql(dimension: int = 64) -> str:
    """DuckDB SQL for compress() of the table embeddings, of vectors of this dimension, with the production parameters."""
    width = dimension // PARTS
    square = " + ".join(f"(k.v[{i}] - c.v[{i}]) * (k.v[{i}] - c.v[{i}])" for i in range(1, width + 1))
    floors = ", ".join(f"CAST((s{i} - ((s{i} % n) + n) % n) // n AS BIGINT)" for i in range(1, width + 1))
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))""",
        f"cut AS MATERIALIZED (SELECT vec_id, p, v[p * {width} + 1 : p * {width} + {width}] AS v FROM kept CROSS JOIN (SELECT unnest(range({PARTS})) AS p) AS q)",
        f"""c0 AS MATERIALIZED (SELECT p, e, v FROM cut JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept WHERE vec_id IS NOT NULL) AS s USING (vec_id) WHERE e < {ENTRIES})""",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT k.vec_id, k.p, any_value(k.v) AS v, min({{'d': {square}, 'e': c.e}}) AS m FROM cut AS k JOIN c{r} AS c USING (p) GROUP BY k.vec_id, k.p)")
        if r < ROUNDS:
            sums = ", ".join(f"sum(v[{i}]) AS s{i}" for i in range(1, width + 1))
            steps.append(
                f"""c{r + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(n.v, c.v) AS v FROM c{r} AS c LEFT JOIN (
                    SELECT p, e, [{floors}] AS v FROM (SELECT p, m.e AS e, count(*) AS n, {sums} FROM a{r} GROUP BY p, m.e) AS t) AS n USING (p, e))"""
            )
    return f"""WITH {", ".join(steps)},
        coded AS (SELECT vec_id, string_agg(lower(format('{{:02x}}', m.e)), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id),
        digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS})
        SELECT coded.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY kept.label) AS BIGINT) AS label_error, codebooks_sha256
        FROM coded JOIN kept USING (vec_id) CROSS JOIN digest"""
