"""N-gram Jaccard join: documents whose word-shingle sets overlap by a share, and the components of these links.

Every shingle is a 63-bit token that sorts rare-first: above the hash stands the size class of its bucket in a table of
document counts (a fixed number of buckets over all documents, so of bounded size at any scale; any order that all
documents share keeps the join exact, the counts only make it cheap). A set of n tokens posts its first
n - ceil(share * n) + n / 16 tokens, and two sets that reach the share meet on a sixteenth of their tokens among these. Equal sets are one class.

Postings travel packed: each task sorts its own, and sends them by ranges of hashes as differences, with the sets' ids once a range. Of a hash so
many bits are kept that postings seldom meet by chance; those that do only cost a comparison. Only postings that sets of two classes share go on.
Tokens of a large part of all documents are dealt out over several groups.

Sets that meet are handled by blocks, never as listed pairs. Each takes the smallest set of the token that it shares most as its lead and is compared
with it; so a group of thousands of near copies costs its members once. What is linked with one lead, or over it with the lead's own, needs no comparison among
itself. The others, and different groups of these, are compared where they have enough tokens in common: by blocks of bounded size, each pair of blocks once, by
length, position and suffix filters and then exactly.

Defined results: null text, empty text or no words: n_shingles 0, alone. A null doc_id keeps its row, with a null
component. Rows that repeat a doc_id count as one document; with different texts each is of its own class. Sets are told apart by their size and a 128-bit digest, shingles by 64-bit hashes. Other columns of the input are ignored.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.stories import labels
from .common import chunks, holds, id_bit, id_filter, mix, saved, small_batches, text_bytes, word_hashes, word_spans, written

WORDS = 5
#: Links need SHARE hundredths of the union.
SHARE = 75
#: Buckets of the table of document counts: 2 ** BITS, in SLICES parts.
BITS, SLICES = 20, 16
#: Postings in a group on average, and those that a task holds before it sends them on; bits of a hash beyond those that number all postings.
GROUP, HELD, SPARE = 1 << 20, 1 << 21, 8
#: A token with more documents than this, and than one of 2 ** 14 of all shingles, is dealt out over several groups.
HOT = 100_000
#: Sets in a block and their tokens, on average; sets that one task compares with their lead.
BLOCK, TOKENS, STAR = 256, 500_000, 512
#: Rounds of components, by halves, that are kept as checkpoints.
CHECKPOINTS = 10
#: Sets of a token that one task takes at least, tokens with more at most.
SETS = 4096
#: One of so many tokens of a set has to be met by a partner among those that both post.
MEET = 16
#: Blocks of so many pairs and more are compared as matrices.
DENSE = 1024
#: A class of copies is common if it has more than one of so many documents.
COMMON = 1 << 16
_STEP = np.uint64(0xA0761D6478BD642F)
_LOW = np.int64((1 << 48) - 1)


# --- shingles ------------------------------------------------------------------------------------------------------


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """For each row the sorted distinct 64-bit hashes of its runs of so many words; with fewer words, one hash for the
    whole sequence; without words none."""
    start, end, count = word_spans(data, offsets)
    h = word_hashes(data, start, end)
    at = np.concatenate(([0], np.cumsum(count)))
    out: list[np.ndarray] = []
    with np.errstate(over="ignore"):
        if len(h) >= words:
            s = h[: len(h) - words + 1].copy()
            for k in range(1, words):
                s = s * _STEP + h[k : len(h) - words + 1 + k]
            s = mix(s + np.uint64(words))
        for i, n in enumerate(count):
            if n >= words:
                out.append(np.unique(s[at[i] : at[i + 1] - words + 1]))
            elif n:
                x = h[at[i]]
                for y in h[at[i] + 1 : at[i + 1]]:
                    x = x * _STEP + y
                out.append(mix(np.array([x + np.uint64(n)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _tokens(h: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Sorted tokens: the size class of the bucket, then 48 bits of the hash."""
    t = (classes[_bucket(h)].astype(np.int64) << 48) | (h & np.uint64((1 << 48) - 1)).astype(np.int64)
    t.sort()
    return t


def least_met(n: int) -> int:
    """The posted tokens of a set of n that a partner must post as well; more than one, so that a shared passage in long texts is not enough."""
    return max(1, n // MEET)


def packed(h: np.ndarray) -> bytes:
    """A set's hashes as its tokens have them, 48 bits each in ascending order: the form in which sets are compared."""
    low = np.sort(h & np.uint64((1 << 48) - 1)).astype("<u8")
    return low.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(data: pa.BinaryScalar) -> np.ndarray:
    six = np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, 6)
    eight = np.zeros((len(six), 8), np.uint8)
    eight[:, :6] = six
    return eight.view("<i8").ravel()


def prefix_length(n: int, share: int = SHARE) -> int:
    """Sets of n tokens that reach the share with another post so many, of which the two have least_met of the smaller in common."""
    return min(n, n + (-share * n) // 100 + least_met(n))


def _digest(h: np.ndarray) -> tuple[int, int]:
    """128 bits of a set: two sums of differently mixed members."""
    with np.errstate(over="ignore"):
        a, b = np.sum(mix(h), dtype=np.uint64), np.sum(mix(h ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def squeezed(x: np.ndarray) -> bytes:
    """An array byte plane by byte plane, so that bytes that hardly vary cost nothing."""
    return zlib.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), 1)


def unsqueezed(data: pa.BinaryScalar, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data.as_buffer()), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


SIGNED = "doc_id long, n long, d1 long, d2 long, slice int, counts binary"


def signed_and_counted(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Each document's number of shingles and digest of their set, and from each task the number of shingles in every bucket, in slices."""
    size = (1 << BITS) // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.uint32)
        names = ["doc_id", "n", "d1", "d2", "slice", "counts"]
        for batch in chunks(batches):
            sets = shingle_sets(*text_bytes(batch.column("text")), words)
            at, n = np.unique(_bucket(np.concatenate(sets)), return_counts=True)
            total[at] += n.astype(np.uint32)
            digests = np.array([_digest(h) for h in sets], np.int64).reshape(-1, 2)
            rows = len(sets)
            yield pa.record_batch([batch.column("doc_id"), pa.array([len(h) for h in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=names)
        if total.any():
            none = pa.nulls(SLICES, pa.int64())
            yield pa.record_batch([none, none, none, none, pa.array(range(SLICES), pa.int32()), pa.array([squeezed(total[k * size : (k + 1) * size]) for k in range(SLICES)], pa.binary())], names=names)

    return docs.mapInArrow(run, SIGNED)


def size_classes(counted: DataFrame) -> tuple[np.ndarray, int]:
    """For each bucket of shingle hashes, a class that grows with the number of documents' shingles in it, over all documents; and the number of all."""
    size = (1 << BITS) // SLICES

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column("slice").to_pylist(), batch.column("counts"), strict=True):
                total[k] = total.get(k, 0) + unsqueezed(x, np.uint32).astype(np.uint64)
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["slice", "counts"])

    parts = counted.filter("slice is not null").select("slice", "counts").repartition("slice").mapInArrow(add, "slice int, counts binary")
    count = np.zeros(1 << BITS, np.uint64)
    for k, counts in parts.collect():  # SLICES rows of fixed size
        count[k * size : (k + 1) * size] = np.frombuffer(counts, np.uint64)
    return (256 * np.log2(count + 1.0)).astype(np.uint16), int(count.sum())


# --- filters and exact comparison of two sorted token arrays ---------------------------------------------------------


def _needed(n: int, m: int, share: int) -> int:
    """The least overlap of sets of these sizes that reaches the share."""
    return -(-share * (n + m) // (100 + share))


def _apart(x: np.ndarray, y: np.ndarray, most: int, depth: int = 2) -> int:
    """A lower bound of the number of members in only one of two sorted arrays: both are split at a member of y."""
    if not len(x) or not len(y) or not depth or abs(len(x) - len(y)) > most:
        return abs(len(x) - len(y))
    mid = len(y) // 2
    at = int(np.searchsorted(x, y[mid]))
    hit = at < len(x) and x[at] == y[mid]
    left = _apart(x[:at], y[:mid], most, depth - 1)
    if left > most:
        return left
    return left + (not hit) + _apart(x[at + hit :], y[mid + 1 :], most - left, depth - 1)


def linked(x: np.ndarray, y: np.ndarray, share: int = SHARE) -> bool:
    """Whether two sorted token arrays reach the share: length, position and suffix filters, then the intersection."""
    n, m = len(x), len(y)
    if 100 * min(n, m) < share * max(n, m) or not n:
        return False
    need = _needed(n, m, share)
    p, q = x[: prefix_length(n, share)], y[: prefix_length(m, share)]
    at = np.searchsorted(q, p)
    hit = np.flatnonzero(q[np.minimum(at, len(q) - 1)] == p)
    if not len(hit):
        return False
    i, j = int(hit[0]), int(at[hit[0]])
    if 1 + min(n - i - 1, m - j - 1) < need:
        return False
    most = n - i - 1 + m - j - 1 - 2 * (need - 1)
    if _apart(x[i + 1 :], y[j + 1 :], most) > most:
        return False
    at = np.searchsorted(y, x)
    both = int(np.count_nonzero(y[np.minimum(at, m - 1)] == x))
    return 100 * both >= share * (n + m - both)


def _matrix(a: list[np.ndarray], b: list[np.ndarray], share: int) -> Iterator[tuple[int, int]]:
    """As linked, for all of a against all of b, by products of 0/1 matrices over slices of the tokens of both."""
    va, vb = np.concatenate(a), np.concatenate(b)
    vocabulary = np.intersect1d(va, vb)
    if not len(vocabulary):
        return
    both = np.zeros((len(a), len(b)), np.float32)

    def cells(values: np.ndarray, arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(arrays)), [len(x) for x in arrays])
        at = np.minimum(np.searchsorted(vocabulary, values), len(vocabulary) - 1)
        keep = vocabulary[at] == values
        return row[keep], at[keep]

    (ra, ca), (rb, cb) = cells(va, a), cells(vb, b)
    for low in range(0, len(vocabulary), 4096):
        width = min(4096, len(vocabulary) - low)
        x, y = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        for m, r, c in ((x, ra, ca), (y, rb, cb)):
            k = (c >= low) & (c < low + width)
            m[r[k], c[k] - low] = 1
        both += x @ y.T
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    yield from zip(*(x.tolist() for x in np.nonzero(100 * both >= share * (na[:, None] + nb[None, :] - both))), strict=True)


def _compare(batches: Iterator[pa.RecordBatch], share: int) -> Iterator[pa.RecordBatch]:
    """Rows of a pair of blocks stand together: (one, two, side, rep, set). Gives the links between side 0 and side 1, or within side 0 if
    the blocks are the same."""

    def links(key: tuple[int, int], sides: tuple[list, list]) -> Iterator[tuple[int, int]]:
        (ra, a), (rb, b) = (([r for r, _ in s], [t for _, t in s]) for s in sides)
        if key[0] == key[1]:
            rb, b = ra, a
        if not a or not b:
            return
        if len(a) * len(b) >= DENSE:
            found = _matrix(a, b, share)
        else:
            found = ((i, j) for i in range(len(a)) for j in range(i + 1 if b is a else 0, len(b)) if linked(a[i], b[j], share))
        for i, j in found:
            if ra[i] != rb[j] and (b is not a or i < j):
                yield min(ra[i], rb[j]), max(ra[i], rb[j])

    def made(rows: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["a", "b"])

    key, sides, out = None, ([], []), []
    for batch in batches:
        held = batch.column("set")
        for i, (one, two, side, rep) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("one", "two", "side", "rep")), strict=True)):
            if (one, two) != key:
                if key:
                    out += links(key, sides)
                key, sides = (one, two), ([], [])
            sides[side].append((rep, unpacked(held[i])))
            if len(out) > 10_000:
                yield made(out)
                out = []
    if key:
        out += links(key, sides)
    yield made(out)


# --- postings --------------------------------------------------------------------------------------------------------

PACKED = "part int, hot boolean, reps binary, sizes binary, tags binary, tokens binary, sets binary"


class Postings:
    """The postings of a task's sets, kept until they are sent on: by group, in the order of their hashes."""

    def __init__(self, groups: int, shift: int, limit: float):
        self.groups, self.shift, self.limit = groups, shift, limit
        self.clear()

    def clear(self) -> None:
        self.reps: list[int] = []
        self.sizes: list[int] = []
        self.tags: list[int] = []
        self.tokens: list[np.ndarray] = []
        self.count = 0

    def add(self, rep: int, size: int, tag: int, tokens: np.ndarray) -> None:
        self.reps.append(rep)
        self.sizes.append(size)
        self.tags.append(tag & 0xFFFFFFFF)
        self.tokens.append(tokens)
        self.count += len(tokens)

    def sent(self) -> Iterator[pa.RecordBatch]:
        if not self.count:
            return
        reps, sizes, tags = np.array(self.reps, np.int64), np.array(self.sizes, np.uint32), np.array(self.tags, np.uint32)
        tokens, own = np.concatenate(self.tokens), np.repeat(np.arange(len(reps), dtype=np.uint32), [len(t) for t in self.tokens])
        self.clear()
        documents = np.exp2((tokens >> 48) / 256)
        key = (tokens & _LOW).astype(np.uint64)
        group = ((key >> np.uint64(8)) * np.uint64(self.groups) >> np.uint64(40)).astype(np.int64)
        hot = documents > self.limit
        if hot.any():
            salts = np.ceil(documents[hot] / self.limit).astype(np.uint64)
            with np.errstate(over="ignore"):
                group[hot] = (mix(key[hot] + mix(reps[own[hot]].view(np.uint64)) % salts) % np.uint64(self.groups)).astype(np.int64)
        kept = key >> np.uint64(self.shift)
        rows = []
        for flag in (False, True):
            at = np.flatnonzero(hot == flag)
            if not len(at):
                continue
            at = at[np.lexsort((kept[at], group[at]))] if flag else at[np.argsort(key[at], kind="stable")]
            parts, first = np.unique(group[at], return_index=True)
            for part, a, b in zip(parts.tolist(), first, [*first[1:], len(at)], strict=True):
                used, place = np.unique(own[at[a:b]], return_inverse=True)
                rows.append((part, flag, squeezed(np.diff(reps[used], prepend=0)), squeezed(sizes[used]), squeezed(tags[used]), squeezed(np.diff(kept[at[a:b]], prepend=np.uint64(0))), squeezed(place.astype(np.uint32))))
        kinds = (pa.int32(), pa.bool_(), *(pa.binary(),) * 5)
        names = [c.split()[0] for c in PACKED.split(", ")]
        for at in range(0, len(rows), 64):
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 64], strict=True), kinds, strict=True)], names=names)


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a group stand together. Gives (rep, n, token, low) of the postings that sets of several classes share, low being the smallest of these; of a
    class the smallest set. All postings of tokens that are dealt out over groups."""

    def found(parts: list[list[np.ndarray]], hot: bool) -> Iterator[pa.RecordBatch]:
        first = np.cumsum([0, *(len(p[0]) for p in parts[:-1])])
        reps, sizes, tags, token, own = (np.concatenate(x) for x in zip(*parts, strict=True))
        own = own + np.repeat(first, [len(p[4]) for p in parts])
        if not hot:
            order = np.argsort(token, kind="stable")
            token, own = token[order], own[order]
            twin = token[1:] == token[:-1]
            some = np.append(twin, False) | np.append(False, twin)
            token, own = token[some], own[some]
        if not len(token):
            return
        rep, size, tag = reps[own], sizes[own], tags[own]
        order = np.lexsort((rep, tag, size, token))
        token, rep, size, tag = (x[order] for x in (token, rep, size, tag))
        new_token, new_class = np.ones(len(token), bool), np.ones(len(token), bool)
        new_token[1:] = token[1:] != token[:-1]
        new_class[1:] = new_token[1:] | (size[1:] != size[:-1]) | (tag[1:] != tag[:-1])
        group = np.cumsum(new_token) - 1
        keep = rep == rep[new_class][np.cumsum(new_class) - 1]
        if not hot:
            keep &= np.bincount(group[new_class])[group] > 1
        low = np.minimum.reduceat(rep, np.flatnonzero(new_token))[group]
        out = [pa.array(x[keep].astype(t)) for x, t in ((rep, np.int64), (size, np.int32), (token, np.int64), (low, np.int64))]
        whole = pa.record_batch(out, names=["rep", "n", "token", "low"])
        for at in range(0, whole.num_rows, 1 << 16):
            yield whole.slice(at, 1 << 16)

    key, parts = None, []
    for batch in batches:
        part, hot = (batch.column(c).to_pylist() for c in ("part", "hot"))
        for i in range(batch.num_rows):
            if (part[i], hot[i]) != key:
                if parts:
                    yield from found(parts, key[1])
                key, parts = (part[i], hot[i]), []
            reps, sizes, tags, token, own = (unsqueezed(batch.column(c)[i], t) for c, t in (("reps", np.int64), ("sizes", np.uint32), ("tags", np.uint32), ("tokens", np.uint64), ("sets", np.uint32)))
            parts.append([np.cumsum(reps), sizes, tags, np.cumsum(token), own])
    if parts:
        yield from found(parts, key[1])


def _cut() -> Callable[[DataFrame], DataFrame]:
    """How the rounds of components are kept: as checkpoints, and after so many as written tables, since what a plan's size is thought to be is squared with every checkpoint."""
    turn = itertools.count()
    return lambda df: saved(df) if next(turn) < CHECKPOINTS else written(df)


# --- the join --------------------------------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, words: int = WORDS, share: int = SHARE) -> DataFrame:
    """doc_id, n_shingles, class_id (the smallest doc_id with the same set) and component_id (the smallest that links reach) of every row."""
    context = docs.sparkSession.sparkContext
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = saved(signed_and_counted(docs, words))
    table, shingles = size_classes(counted)
    classes = context.broadcast(table)

    # classes of equal sets; copies within the common ones post nothing
    signed = counted.filter("slice is null").select("doc_id", "n", "d1", "d2")
    some = signed.filter("n > 0 and doc_id is not null")
    same = saved(some.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    members = some.join(same, ["n", "d1", "d2"]).select("doc_id", "n", "rep")
    documents, posted = same.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum(F.col("copies") * F.ceil((100 - share) * F.col("n") / 100 + F.col("n") / MEET + 1)), F.lit(0))).collect()[0]
    common = same.filter(F.col("copies") > max(1, documents // COMMON)).select("d1", "d2", "rep").toArrow()  # COMMON rows at most
    common = context.broadcast(dict(zip(zip(*(common.column(c).to_pylist() for c in ("d1", "d2")), strict=True), common.column("rep").to_pylist(), strict=True)))
    groups, shift, limit = max(1, -(-posted // GROUP)), max(0, 48 - SPARE - int(posted).bit_length()), float(max(HOT, shingles >> 14))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Postings(groups, shift, limit)
        for batch in chunks(batches):
            for d, h in zip(batch.column("doc_id").to_pylist(), shingle_sets(*text_bytes(batch.column("text")), words), strict=True):
                if len(h) and d is not None:
                    digest = _digest(h)
                    if common.value.get(digest, d) == d:
                        held.add(d, len(h), digest[0], _tokens(h, classes.value)[: prefix_length(len(h), share)])
            if held.count > HELD:
                yield from held.sent()
        yield from held.sent()

    # tokens that sets of several classes post, of sets that meet enough of them; each set's lead
    need = F.greatest(F.lit(1), F.floor(share * F.col("n") / (100 * MEET)))  # least_met of the smallest partner
    posts = docs.mapInArrow(post, PACKED).repartition("part", "hot").sortWithinPartitions("part", "hot").mapInArrow(shared, "rep long, n int, token long, low long")
    by = Window.partitionBy("rep")
    posts = posts.repartition("rep").withColumn("all", F.count("*").over(by)).filter(F.col("all") >= need)
    posts = posts.withColumn("with_low", F.count("*").over(Window.partitionBy("rep", "low")))
    posts = posts.withColumn("best", F.max(F.struct("with_low", -F.col("low"))).over(by))
    posts = saved(posts.select("rep", "n", "token", (-F.col("best.col2")).alias("lead"), (F.col("best.with_low") >= need).alias("hopeful")))
    classes.unpersist()
    common.unpersist()

    def sets(wanted: DataFrame) -> DataFrame:
        """wanted (rep, ...) with the sets, from the texts again."""
        bits = id_filter(wanted, "rep")

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.filter(holds(bits.value, batch.column("_at")))
                for part in chunks(iter([own])):
                    found = shingle_sets(*text_bytes(part.column("text")), words)
                    yield pa.record_batch([part.column("rep"), pa.array([packed(h) for h in found], pa.binary())], names=["rep", "set"])

        given = docs.filter("doc_id is not null").select(F.col("doc_id").alias("rep"), "text", id_bit("doc_id").alias("_at"))
        return given.mapInArrow(whole, "rep long, set binary").join(wanted, "rep")

    # those linked with their lead; a lead with many is compared in parts
    lead = saved(posts.groupBy("rep", "n", "lead", "hopeful").agg(F.count("*").alias("posts")))
    own = lead.filter("rep <> lead and hopeful").select("rep", "lead")
    size = own.groupBy("lead").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    mine = own.join(size, "lead").select("rep", "lead", F.pmod(F.xxhash64("rep"), "parts").cast("int").alias("part"), F.lit(1).alias("turn"))
    theirs = size.select(F.col("lead").alias("rep"), "lead", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("turn"))

    def starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None
        for batch in batches:
            keep = []
            for turn, x in zip(batch.column("turn").to_pylist(), batch.column("set"), strict=True):
                if not turn:
                    first = unpacked(x)
                keep.append(bool(turn) and linked(unpacked(x), first, share))
            yield pa.record_batch([batch.column("rep"), batch.column("lead")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    star = sets(saved(mine.unionByName(theirs))).repartition("lead", "part").sortWithinPartitions("lead", "part", "turn").select("rep", "lead", "turn", "set")
    star = saved(star.mapInArrow(starred, "a long, b long").distinct())

    # groups: what these links join over a lead and its own lead, which needs no comparison within, and blocks of the others of a lead
    ends = star.select(F.col("a").alias("rep"), F.col("b").alias("up")).unionByName(star.select(F.col("b").alias("rep"), F.lit(None).cast("long").alias("up")))
    ends = ends.groupBy("rep").agg(F.coalesce(F.max("up"), "rep").alias("up"))  # who has no lead is its own
    joined = ends.join(star.select(F.col("a").alias("up"), F.col("b").alias("top")), "up", "left").select("rep", F.coalesce("top", "up").alias("whole"))
    place = lead.select("rep", "n", "lead").join(joined, "rep", "left").withColumn("one", F.col("whole").isNotNull())
    key, flag = F.coalesce("whole", "lead"), F.col("one").cast("long")  # small numbers where ids are small: they travel better than hashes
    place = place.withColumn("base", F.when(key.between(-(1 << 61), 1 << 61), F.shiftleft(key, 1) + flag).otherwise(F.xxhash64(key, flag)))
    sized = place.groupBy("base").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / TOKENS)).alias("parts"))
    place = place.join(sized, "base").select("rep", "base", "one", F.pmod(F.xxhash64("rep"), "parts").cast("int").alias("part"))

    # sets that meet enough tokens of another group, or of others in their own, while some there meet theirs
    own = saved(posts.select("rep", "n", "token").join(place, "rep"))
    several = own.groupBy("token").agg(F.min("base").alias("l"), F.max("base").alias("h"), F.min("one").alias("one"), F.count("*").alias("k")).filter("l < h or not one and k > 1")
    own = saved(own.join(several.select("token"), "token", "left_semi"))
    many = max(SETS, posted // SETS)
    hot = own.groupBy("token").agg(F.count("*").alias("k")).filter(F.col("k") > many).select("token", F.ceil(F.col("k") / many).cast("int").alias("deals")).collect()  # SETS rows at most
    none_hot, hot = not hot, F.broadcast(docs.sparkSession.createDataFrame(hot, "token long, deals int"))

    def on_token(own: DataFrame, held: DataFrame) -> DataFrame:
        """own beside held of the same token; the sets of a token with many are dealt over tasks, each of which gets all that is held of it."""
        if none_hot:
            return own.join(held, "token")
        deals = F.coalesce("deals", F.lit(1))
        sets_ = own.join(hot, "token", "left").withColumn("deal", F.pmod(F.xxhash64("rep"), deals).cast("int")).drop("deals")
        groups_ = held.join(hot, "token", "left").withColumn("deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("deals")
        return sets_.join(groups_, ["token", "deal"]).drop("deal")

    held = own.groupBy("token", F.col("base").alias("other")).agg(F.count("*").alias("k"))
    far = on_token(own, held).filter("base <> other or not one and k > 1").groupBy("rep", "n", "base", "other").count().filter(F.col("count") >= need)
    far = saved(far.select("rep", "base", "other"))
    far = saved(far.join(far.select(F.col("other").alias("base"), F.col("base").alias("other")).distinct(), ["base", "other"], "left_semi"))

    # the same by blocks
    own = own.join(far.select("rep").distinct(), "rep", "left_semi")
    held = own.groupBy("token", F.col("base").alias("other"), F.col("part").alias("theirs")).agg(F.count("*").alias("k"))
    met = on_token(own, held).filter("base <> other or part <> theirs or k > 1").join(far.select("rep", "other"), ["rep", "other"])
    met = met.groupBy("rep", "n", "base", "part", "other", "theirs").count().filter(F.col("count") >= need)
    mine, other = F.xxhash64("base", "part"), F.xxhash64("other", "theirs")
    pairs = saved(met.select("rep", F.least(mine, other).alias("one"), F.greatest(mine, other).alias("two"), F.when(mine <= other, 0).otherwise(1).alias("side")))
    both = pairs.groupBy("one", "two").agg(F.min("side").alias("l"), F.max("side").alias("h"), F.count("*").alias("k")).filter("l < h or one = two and k > 1").select("one", "two")
    pairs = saved(pairs.join(both, ["one", "two"], "left_semi"))
    sides = sets(pairs).select("one", "two", "side", "rep", "set").repartition("one", "two").sortWithinPartitions("one", "two")
    found = sides.mapInArrow(lambda batches: _compare(batches, share), "a long, b long")

    label = labels(star.union(found), _cut()).select(F.col("node").alias("rep"), "component")
    grouped = members.join(label, "rep", "left").select("doc_id", "n", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"))
    alone = signed.filter("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    return grouped.union(alone).select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id")
