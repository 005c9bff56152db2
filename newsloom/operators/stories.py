"""Same-story grouping: comparison texts, TF-IDF similarity, candidates, judged links, groups of bounded size."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.session import small_batches
from ..functions.text import bigrams, comparable
from .latest import newest, two_quotas

MIN_SIMILARITY, WINDOW_DAYS, STORY_SIZE = 0.17, 21, 8
#: Edges of a node that one task takes at least, nodes with more at most.
HUB, HUBS = 100_000, 10_000
#: Shares of the bigrams whose norms bound a similarity, tasks that the copies of a text are dealt to, room for the rounding of sums.
SHARES, SALTS, SLACK = 64, 16, 1e-6
#: Places of a table of hashes, and numbers of which pairs are compared at once.
PLACES, ROOM = 1 << 16, 1 << 20
#: Postings of a block, in the mean.
BLOCK = 128
#: Texts of a block in the mean, blocks of a slot before they grow, pairs for which a task is made, left texts that are compared at once.
TEXTS, BLOCKS, PAIRS, ROWS = 1000, 16, 4_000_000, 256
#: Bigrams whose numbers of texts all tasks hold, the most frequent ones; of others a text brings the numbers along. Bits of a character, entries of a task that are counted together.
GRAMS, BITS, COUNTED = 1 << 18, 21, 1 << 20


def comparison_texts(articles: DataFrame, digests: DataFrame, public: DataFrame, translations: DataFrame, language: str = "ja") -> DataFrame:
    """(id, text): the newest public digest's title and summary, else the newest translation of the title, else the article's title if it is in the reader's
    language. public: ids of digests without required membership."""
    digest = newest(digests.join(public, "id", "left_semi"), ["article_id"])
    made = digest.select(F.col("article_id").alias("id"), F.concat_ws("\n", "title_x", "summary_x").alias("_digest"))
    translated = newest(translations, ["article_id"]).select(F.col("article_id").alias("id"), F.col("title_x").alias("_translated"))
    title = F.when(F.col("lang") == language, F.col("title"))
    rows = articles.join(made, "id", "left").join(translated, "id", "left")
    return rows.select("id", F.coalesce("_digest", "_translated", title).alias("text")).filter("text is not null")


def pool(texts: DataFrame, batch: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """texts (id, at, text) within so many days around the batch's first and last time."""
    span = batch.agg((F.min("at") - F.make_interval(days=F.lit(days))).alias("_from"), (F.max("at") + F.make_interval(days=F.lit(days))).alias("_to"))
    return texts.join(F.broadcast(span), F.col("at").between(F.col("_from"), F.col("_to"))).drop("_from", "_to")


def tf_idf(texts: DataFrame) -> DataFrame:
    """(id, gram, weight, df): tf * (ln((N + 1) / (df + 1)) + 1) of character bigrams within the pool, each text's vector of length one; df is the number of texts with the bigram."""
    grams = texts.select("id", F.explode(bigrams(comparable(F.col("text")))).alias("gram"))
    tf = grams.groupBy("id", "gram").agg(F.count("*").alias("tf"))
    df = tf.groupBy("gram").agg(F.count("*").alias("df"))
    n = texts.agg(F.count("*").alias("n"))
    raw = tf.join(df, "gram").crossJoin(F.broadcast(n)).withColumn("w", F.col("tf") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1))
    listed = raw.groupBy("id").agg(F.collect_list(F.struct("gram", "w", "df")).alias("_v"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return listed.select("id", "norm", F.explode("_v").alias("v")).select("id", "v.gram", (F.col("v.w") / F.col("norm")).alias("weight"), "v.df")


def similar_pairs(vectors: DataFrame, times: DataFrame, targets: DataFrame, save: Callable[[DataFrame], DataFrame], least: float = MIN_SIMILARITY, days: int = WINDOW_DAYS) -> DataFrame:
    """(target, id, similarity) of targets with any other text no more than so many days away: a cosine join by an inverted index.

    Bigrams are ordered from rare to frequent. Two texts that are similar enough share a first bigram, behind which (with it) each of their vectors still has a norm of at least the
    threshold, so it is enough to post a text under its bigrams until what is left is shorter (for 0.95 a tenth of the squared weights, the rarest). Postings meet by bigram and time slot, in
    their own slot and the next; a meeting goes on only if the product of both remaining norms reaches the threshold, and that of the
    norms in SHARES shares of the bigrams too. What remains is compared once, with the whole vectors.

    Texts of one slot with equal vectors are one entry, so copies cost as much as their pairs in the result. Entries are told apart by 128-bit and bigrams by 64-bit hashes. The threshold has to be positive."""
    micros = days * 86_400_000_000
    listed = vectors.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", F.xxhash64("gram").alias("h"), "weight"))).alias("v"))
    at = F.unix_micros(F.col("at").cast("timestamp"))
    rows = listed.join(times.select("id", at.alias("at")), "id").withColumn("slot", F.floor(F.col("at") / micros))
    rows = save(rows.select("id", "at", "slot", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"), F.col("v.h").alias("terms"), F.col("v.weight").alias("weights")))
    copies = ["slot", "h1", "h2"]
    # the smallest id stands for the copies of a slot; their many rows are dealt over salts
    entry = rows.groupBy(*copies).agg(F.min("id").alias("entry"), F.count("*").alias("copies"))
    salted = entry.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    wanted = targets.select("id", F.lit(True).alias("target")).distinct()
    members = rows.select("id", "at", *copies, F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt")).join(salted.select(*copies, "salt", "entry"), [*copies, "salt"])
    members = save(members.join(wanted, "id", "left").select("entry", "id", "at", F.coalesce("target", F.lit(False)).alias("target")))
    entries = rows.join(entry.select(F.col("entry").alias("id"), "copies"), "id").select(F.col("id").alias("entry"), "slot", "copies", "terms", "weights")

    posted = save(entries.select("entry", "slot", "terms", "weights").mapInArrow(_posted(least), "entry long, slot long, term long, rest double, shares binary"))
    # postings of a bigram and slot are gathered in blocks, and what two blocks have in common is a product of matrices
    count = posted.groupBy("term", "slot").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    block = posted.join(count, ["term", "slot"]).groupBy("term", "slot", F.pmod(F.xxhash64("entry"), F.col("blocks")).alias("block")).agg(F.collect_list(F.struct("entry", "rest", "shares")).alias("p"))
    gathered = save(block.select("term", "slot", "block", F.col("p.entry").alias("entry"), F.col("p.rest").alias("rest"), F.col("p.shares").alias("shares")))
    own = gathered.select("term", "slot", F.col("block").alias("ba"), F.col("entry").alias("a"), F.col("rest").alias("ra"), F.col("shares").alias("sa"))
    other = gathered.select("term", F.col("slot").alias("of"), F.explode(F.array("slot", F.col("slot") - 1)).alias("slot"), F.col("block").alias("bb"), F.col("entry").alias("b"), F.col("rest").alias("rb"), F.col("shares").alias("sb"))
    pairs = own.join(other, ["term", "slot"]).filter((F.col("slot") < F.col("of")) | (F.col("ba") <= F.col("bb")))
    met = small_batches(pairs.select((F.col("slot") == F.col("of")).alias("same"), "ba", "bb", "a", "ra", "sa", "b", "rb", "sb")).mapInArrow(_met(least), "a long, b long").distinct()
    # as bytes, since Spark hands arrays to Python one element at a time, and a vector goes with each of its pairs
    vector = lambda c: entries.select("entry", "terms", "weights").mapInArrow(_packed(c), f"{c} long, {c}_terms binary, {c}_weights binary")
    compared = met.join(vector("a"), "a").join(vector("b"), "b").mapInArrow(_compared(least), "a long, b long, similarity double")
    alike = entries.filter("copies > 1").select(F.col("entry").alias("a"), F.col("entry").alias("b"), F.lit(1.0).alias("similarity"))
    return _ways(compared.unionByName(alike), members, micros)


def _ways(found: DataFrame, members: DataFrame, micros: int) -> DataFrame:
    """(target, id, similarity) of the members (entry, id, at, target) of similar entries (a, b, similarity) that are no further apart; each pair of entries once, an entry with copies beside itself."""
    side = lambda c, i: members.select(F.col("entry").alias(c), F.col("id").alias(i), F.col("at").alias(f"{i}_at"), F.col("target").alias(f"{i}_target"))
    pairs = found.join(side("a", "x"), "a").join(side("b", "y"), "b").filter((F.abs(F.col("x_at") - F.col("y_at")) <= micros) & ((F.col("a") < F.col("b")) | (F.col("a") > F.col("b")) | (F.col("x") < F.col("y"))))
    ways = F.array(F.when(F.col("x_target"), F.struct(F.col("x").alias("target"), F.col("y").alias("id"))), F.when(F.col("y_target"), F.struct(F.col("y").alias("target"), F.col("x").alias("id"))))
    return pairs.select(F.explode(F.array_compact(ways)).alias("way"), "similarity").select("way.target", "way.id", "similarity")


def similar_texts(texts: DataFrame, save: Callable[[DataFrame], DataFrame], least: float = MIN_SIMILARITY, days: int = WINDOW_DAYS) -> DataFrame:
    """What similar_pairs gives for the vectors that tf_idf makes of texts (id, at, text), all of them targets: a cosine join within time.

    A vector is made of its text and the bigrams' numbers of texts wherever it is needed, so texts travel and neither vectors nor postings: a vector has ten times the bytes of its text, the postings of one with
    their norms as many again. Time slots are dealt into blocks of texts, and each pair of blocks of a slot, or of a slot and the next, is a group of its own. In it the norms of SHARES shares of the bigrams
    bound all similarities, by one product of matrices; what remains is compared once, with the whole vectors. Where slots hold many texts, blocks grow, so that copies stay few.

    Texts of one slot with the same characters are one entry, so copies cost as much as their pairs in the result; entries are told apart by 128-bit hashes. The threshold has to be positive."""
    micros = days * 86_400_000_000
    s, at = comparable(F.col("text")), F.unix_micros(F.col("at").cast("timestamp"))
    rows = texts.select("id", at.alias("at"), s.alias("s")).withColumn("slot", F.floor(F.col("at") / micros))
    rows = save(rows.select("id", "at", "slot", F.xxhash64("s").alias("h1"), F.xxhash64(F.lit(1), "s").alias("h2"), "s"))
    n, whole = rows.count(), rows.filter(F.char_length("s") > 1)
    copies = ["slot", "h1", "h2"]
    # the smallest id stands for the copies of a slot; their many rows are dealt over salts
    entries = save(whole.groupBy(*copies).agg(F.min("id").alias("entry"), F.count("*").alias("copies"), F.first("s").alias("s")))
    known, more = _statistics(rows, entries, save)
    salted = entries.select(*copies, "entry", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    members = whole.select("id", "at", *copies, F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt")).join(salted, [*copies, "salt"])
    members = members.select("entry", "id", "at", F.lit(True).alias("target"))

    # slots are few, however many texts: a timestamp has 175,000 of them at three weeks each
    slots = save(entries.groupBy("slot").agg(F.count("*").alias("n")))
    blocks = F.least(F.ceil(F.col("n") / TEXTS), F.greatest(F.lit(BLOCKS), F.ceil(F.col("n") / (BLOCKS * TEXTS)))).cast("int")
    beside = lambda k: slots.select((F.col("slot") + k).alias("slot"), blocks.alias("_before" if k > 0 else "_after" if k < 0 else "_own"), F.col("n").alias(f"_n{k}"))
    dealt = save(beside(0).join(beside(1), "slot", "left").join(beside(-1), "slot", "left"))
    pairs = dealt.agg(F.sum(F.col("_n0") * (F.col("_n0") / 2 + F.coalesce("_n-1", F.lit(0))))).first()[0] or 0
    x, each = F.col("_x"), lambda c, of: F.when(F.col(c).isNotNull(), F.transform(F.sequence(F.lit(0), F.coalesce(c, F.lit(1)) - 1), of)).otherwise(F.array())
    place = lambda near, slot, i, j, right: F.struct(F.lit(near).alias("next"), slot.cast("long").alias("of"), i.cast("int").alias("i"), j.cast("int").alias("j"), right.alias("right"))
    slot = F.col("slot")
    places = F.concat(each("_own", lambda j: place(False, slot, F.least(x, j), F.greatest(x, j), j < x)), each("_after", lambda j: place(True, slot, x, j, F.lit(False))), each("_before", lambda i: place(True, slot - 1, i, x, F.lit(True))))
    if more is not None:
        entries = entries.join(more, copies, "left")
    held = ["entry", "s", *(("grams", "numbers") if more is not None else ())]
    met = entries.join(F.broadcast(dealt), "slot").withColumn("_x", F.pmod(F.xxhash64("entry"), F.col("_own")).cast("int")).select(F.explode(places).alias("p"), *held).select("p.*", *held)
    keys = ["next", "of", "i", "j"]
    met = met.repartition(max(1, -(-int(pairs) // PAIRS)), *keys).sortWithinPartitions(*keys, "right")
    compared = met.mapInArrow(_by_blocks(n, known, least), "a long, b long, similarity double")
    alike = entries.filter("copies > 1").select(F.col("entry").alias("a"), F.col("entry").alias("b"), F.lit(1.0).alias("similarity"))
    return _ways(compared.unionByName(alike), save(members), micros)


def _statistics(rows: DataFrame, entries: DataFrame, save: Callable[[DataFrame], DataFrame]) -> tuple[Broadcast, DataFrame | None]:
    """The most frequent bigrams of rows (s) and their numbers of texts, GRAMS at most; and of others, if any, (slot, h1, h2, grams, numbers) of the entries that have them."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged() -> Iterator[pa.RecordBatch]:
            grams, of = np.unique(np.concatenate([g for g, _ in held]), return_inverse=True)
            yield pa.record_batch([pa.array(grams), pa.array(np.bincount(of, np.concatenate([c for _, c in held]), len(grams)).astype(np.int64))], names=["gram", "df"])

        for batch in batches:
            held.append(np.unique(_grams(batch.column("s"))[1], return_counts=True))
            size += len(held[-1][0])
            if size > COUNTED:
                yield from merged()
                held, size = [], 0
        if held:
            yield from merged()

    df = save(rows.select("s").mapInArrow(counted, "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df")))
    kinds, least = df.count(), 1
    if kinds > GRAMS:
        # the numbers of texts from which bigrams are few enough; they are as many as their kinds, at most
        least = 2
        while df.filter(F.col("df") >= least).count() > GRAMS:
            least *= 2
    often = df.filter(F.col("df") >= least).sort("gram").toArrow()
    known = rows.sparkSession.sparkContext.broadcast(tuple(often.column(c).to_numpy() for c in ("gram", "df")))
    if least == 1:
        return known, None

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, gram, _ = _grams(batch.column("s"))
            rare = np.flatnonzero(~np.isin(gram, known.value[0]))
            yield pa.record_batch([*(batch.column(c).take(pa.array(row[rare])) for c in copies), pa.array(gram[rare])], names=[*copies, "gram"])

    copies = ["slot", "h1", "h2"]
    rare = entries.select(*copies, "s").mapInArrow(others, "slot long, h1 long, h2 long, gram long").join(df.filter(F.col("df") < least), "gram")
    listed = rare.groupBy(*copies).agg(F.sort_array(F.collect_list(F.struct("gram", "df"))).alias("v"))
    return known, listed.select(*copies, F.col("v.gram").alias("grams"), F.col("v.df").alias("numbers"))


def _grams(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bigram, times) of texts, in the order of rows and bigrams; a bigram is the number of its two characters."""
    lists = [np.frombuffer((t or "").encode("utf-32-le"), np.uint32) for t in texts.to_pylist()]
    sizes = np.array([len(x) for x in lists], np.int64)
    if not sizes.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.concatenate(lists).astype(np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)
    inner = np.flatnonzero(row[1:] == row[:-1])
    row, gram = row[inner], (c[inner] << BITS) | c[inner + 1]
    kinds, of = np.unique(gram, return_inverse=True)
    both, times = np.unique(row * max(len(kinds), 1) + of, return_counts=True)
    return both // max(len(kinds), 1), kinds[both % max(len(kinds), 1)], times


def _by_blocks(n: int, known: Broadcast, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The similar pairs of each two blocks of texts, of n texts in all, or within a block. A group's rows follow one another, the left block first."""

    def vectors(block: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
        """(row, bigram, weight) of the block's texts, and the norms of the shares of each, never below."""
        text = pa.chunked_array([b.column("s") for b in block]).combine_chunks()
        row, gram, times = _grams(text)
        grams, numbers = known.value
        at = np.minimum(np.searchsorted(grams, gram), max(len(grams) - 1, 0))
        df = np.where(grams[at] == gram, numbers[at], 0) if len(grams) else np.zeros(len(gram), np.int64)
        if "grams" in block[0].schema.names:
            # the others of a text come in the order of bigrams, as here
            df[df == 0] = np.concatenate([b.column("numbers").flatten().to_numpy(zero_copy_only=False).astype(np.int64) for b in block])
        w = times * (np.log((n + 1) / (df + 1)) + 1)
        w = w / np.sqrt(np.bincount(row, w * w, len(text)))[row]
        share = ((gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % SHARES
        norms = np.sqrt(np.bincount(row * SHARES + share, w * w, len(text) * SHARES)).reshape(-1, SHARES)
        return row, gram, w, np.nextafter(norms.astype(np.float32), np.float32(2))

    def compared(left: list[pa.RecordBatch], right: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        within = not right
        ids = [np.concatenate([b.column("entry").to_numpy() for b in side]) for side in (left, right or left)]
        one = vectors(left)
        two = one if within else vectors(right)
        kinds = np.unique(np.concatenate((one[1], two[1])))
        (la, ga, wa), (lb, gb, wb) = ((row, np.searchsorted(kinds, gram), w) for row, gram, w, _ in (one, two))
        begin, start = np.searchsorted(la, np.arange(len(ids[0]) + 1)), np.searchsorted(lb, np.arange(len(ids[1]) + 1))
        laid, out = np.zeros(len(kinds)), ([], [], [])
        for at in range(0, len(ids[0]), ROWS):
            i, j = np.nonzero(one[3][at : at + ROWS] @ two[3].T >= least - 10 * SLACK)
            i += at
            if within:
                i, j = i[i < j], j[i < j]
            for k, of in zip(*np.unique(i, return_index=True), strict=True):
                others = j[of : np.searchsorted(i, k, "right")]
                own = slice(begin[k], begin[k + 1])
                laid[ga[own]] = wa[own]
                size = start[others + 1] - start[others]
                ends = np.cumsum(size)
                terms = np.arange(ends[-1]) + np.repeat(start[others] - (ends - size), size)
                s = np.round(np.add.reduceat(laid[gb[terms]] * wb[terms], ends - size), 9)
                laid[ga[own]] = 0
                hit = np.flatnonzero(s >= least)
                for held, found in zip(out, (np.full(len(hit), ids[0][k]), ids[1][others[hit]], s[hit]), strict=True):
                    held.append(found)
        if out[0]:
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in out], names=["a", "b", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [])

        def done() -> Iterator[pa.RecordBatch]:
            if held[0] and (held[1] or not now[0] and now[2] == now[3]):
                yield from compared(*held)

        for batch in batches:
            places = list(zip(*(batch.column(c).to_pylist() for c in ("next", "of", "i", "j", "right")), strict=True))
            at = 0
            for place, same in itertools.groupby(places):
                size = sum(1 for _ in same)
                if place[:-1] != now:
                    yield from done()
                    now, held = place[:-1], ([], [])
                held[place[-1]].append(batch.slice(at, size))
                at += size
        yield from done()

    return run


def _posted(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each entry, whose bigrams stand from rare to frequent, those behind which its vector still has the least norm; with that norm and the norms of the shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, weights = batch.column("terms"), batch.column("weights")
            sizes = np.diff(terms.offsets.to_numpy())
            if not len(sizes):
                continue
            begin = terms.offsets.to_numpy()[0]
            h, w = (x.values.to_numpy()[begin : begin + sizes.sum()] for x in (terms, weights))
            row = np.repeat(np.arange(len(sizes)), sizes)
            total = np.concatenate(([0.0], np.cumsum(w * w)))
            ends = np.cumsum(sizes)
            rest = np.sqrt(np.maximum(total[ends][row] - total[:-1], 0))
            shares = np.zeros((len(sizes), SHARES))
            np.add.at(shares, (row, (h % SHARES).astype(np.int64)), w * w)
            shares = np.nextafter(np.sqrt(shares).astype(np.float32), np.float32(2))  # never below
            at = np.flatnonzero(rest >= least - SLACK)
            of = row[at]
            lists = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(np.arange(0, (len(of) + 1) * SHARES * 4, SHARES * 4, dtype=np.int32)), pa.py_buffer(shares[of].tobytes())])
            yield pa.record_batch([batch.column("entry").take(pa.array(of)), batch.column("slot").take(pa.array(of)), pa.array(h[at]), pa.array(rest[at]), lists], names=["entry", "slot", "term", "rest", "shares"])

    return run


def _packed(c: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Entries with their terms and weights, eight bytes each, as binary values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("entry"), *(pack(batch.column(x)) for x in ("terms", "weights"))], names=[c, f"{c}_terms", f"{c}_weights"])

    return run


def _met(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pairs of two blocks of postings that both bounds let pass: the norms of what is left, and those of the shares. Within a block's own slot the smaller entry stands first, each pair once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, ba, bb = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("same", "ba", "bb"))
            ends, entry, rest, shares = {}, {}, {}, {}
            for c in "ab":
                ends[c] = batch.column(c).offsets.to_numpy()
                entry[c], rest[c] = batch.column(c).values.to_numpy(), batch.column(f"r{c}").values.to_numpy()
                held = batch.column(f"s{c}").values
                first = np.frombuffer(held.buffers()[1], np.int32, 1, held.offset * 4)[0] if len(held) else 0
                shares[c] = np.frombuffer(held.buffers()[2], np.float32, len(held) * SHARES, first).reshape(-1, SHARES) if len(held) else np.zeros((0, SHARES), np.float32)
            left, right = [], []
            for k in range(batch.num_rows):
                a, b = (slice(ends[c][k], ends[c][k + 1]) for c in "ab")
                bound = shares["a"][a] @ shares["b"][b].T
                i, j = np.nonzero((bound >= least - 10 * SLACK) & (np.outer(rest["a"][a], rest["b"][b]) >= least - SLACK))
                x, y = entry["a"][a][i], entry["b"][b][j]
                if same[k]:
                    # two blocks of a slot meet once, a block meets itself
                    own = x < y if ba[k] == bb[k] else x != y
                    x, y = np.minimum(x, y)[own], np.maximum(x, y)[own]
                left.append(x)
                right.append(y)
            if left:
                found = np.unique(np.stack((np.concatenate(left), np.concatenate(right))), axis=1) if sum(map(len, left)) else np.zeros((2, 0), np.int64)
                yield pa.record_batch([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])

    return run


def pack(lists: pa.ListArray) -> pa.BinaryArray:
    """Lists of values of eight bytes as binary values."""
    ends = lists.offsets.to_numpy() if len(lists) else np.zeros(1, np.int32)
    values = lists.values.to_numpy()[ends[0] : ends[-1]]
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(((ends - ends[0]) * 8).astype(np.int32)), pa.py_buffer(values.tobytes())])


def _values(packed: pa.BinaryArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Where the rows of a packed column end, from 0, and their values."""
    n, start = len(packed), packed.offset
    ends = np.frombuffer(packed.buffers()[1], np.int32, n + 1, start * 4).astype(np.int64) if n else np.zeros(1, np.int64)
    data = packed.buffers()[2]
    size = int(ends[-1] - ends[0]) // 8
    return (ends - ends[0]) // 8, np.frombuffer(data, kind, size, int(ends[0])) if size else np.zeros(0, kind)


class _Numbers:
    """Numbers of hashes as they come up: by a table of their last bits, and for those whose place is taken by a sorted list."""

    def __init__(self) -> None:
        self.held, self.number, self.size = np.zeros(PLACES, np.int64), np.full(PLACES, -1), 0
        self.more, self.more_number = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def of(self, h: np.ndarray) -> np.ndarray:
        place = h & (PLACES - 1)
        out = np.where(self.held[place] == h, self.number[place], -1)
        left = np.flatnonzero(out < 0)
        if len(left):
            kinds, of = np.unique(h[left], return_inverse=True)
            new = kinds[~np.isin(kinds, self.more)]
            new = new[(self.held[new & (PLACES - 1)] != new) | (self.number[new & (PLACES - 1)] < 0)]
            fresh = np.arange(self.size, self.size + len(new))
            self.size += len(new)
            _, first = np.unique(new & (PLACES - 1), return_index=True)
            first = first[self.number[new[first] & (PLACES - 1)] < 0]
            self.held[new[first] & (PLACES - 1)], self.number[new[first] & (PLACES - 1)] = new[first], fresh[first]
            rest = np.setdiff1d(np.arange(len(new)), first)
            more, number = np.concatenate((self.more, new[rest])), np.concatenate((self.more_number, fresh[rest]))
            order = np.argsort(more)
            self.more, self.more_number = more[order], number[order]
            place = kinds & (PLACES - 1)
            found = np.where((self.held[place] == kinds) & (self.number[place] >= 0), self.number[place], -1)
            lacking = np.flatnonzero(found < 0)
            found[lacking] = self.more_number[np.searchsorted(self.more, kinds[lacking])]
            out[left] = found[of]
        return out


def _compared(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pairs that are similar enough by their whole vectors. Many pairs are compared at once: the left vectors are laid out by pair and number of the bigram, and looked up by the right ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers()
        for batch in batches:
            found = np.zeros(batch.num_rows)
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sides = []
                if numbers.size > PLACES // 4:
                    numbers = _Numbers()
                for c in "ab":
                    ends, h = _values(part.column(f"{c}_terms"), np.int64)
                    _, w = _values(part.column(f"{c}_weights"), np.float64)
                    row = np.repeat(np.arange(part.num_rows), np.diff(ends))
                    sides.append((row, numbers.of(h), w))
                (ra, na, wa), (rb, nb, wb) = sides
                rows = max(1, ROOM // max(numbers.size, 1))
                for k in range(0, part.num_rows, rows):
                    a, b = (slice(*np.searchsorted(r, (k, k + rows))) for r in (ra, rb))
                    laid = np.zeros(min(rows, part.num_rows - k) * numbers.size)
                    laid[(ra[a] - k) * numbers.size + na[a]] = wa[a]
                    shared = laid[(rb[b] - k) * numbers.size + nb[b]] * wb[b]
                    found[at + k : at + min(k + rows, part.num_rows)] = np.bincount(rb[b] - k, shared, min(rows, part.num_rows - k))
            found = np.round(found, 9)
            hit = np.flatnonzero(found >= least)
            yield pa.record_batch([batch.column("a").take(pa.array(hit)), batch.column("b").take(pa.array(hit)), pa.array(found[hit])], names=["a", "b", "similarity"])

    return run


def candidates(pairs: DataFrame, articles: DataFrame, stories: DataFrame) -> DataFrame:
    """(target, unit, similarity, other_source): units are stories; not the target's own; a unit is as similar as its most similar member and has another
    source if any similar member has. The best few of either kind are kept."""
    unit = stories.select(F.col("article_id").alias("id"), F.col("story_id").alias("unit"))
    source = articles.select("id", "source_id")
    of_target = unit.join(source, "id").select(F.col("id").alias("target"), F.col("unit").alias("_own"), F.col("source_id").alias("_source"))
    rows = pairs.join(unit, "id").join(source, "id").join(of_target, "target").filter("unit <> _own")
    best = rows.groupBy("target", "unit").agg(F.max("similarity").alias("similarity"), F.max(F.col("source_id") != F.col("_source")).alias("other_source"))
    return two_quotas(best)


def judge(rows: DataFrame, same: float, related: float) -> DataFrame:
    """A verdict by similarity alone."""
    s = F.col("similarity")
    return rows.withColumn("verdict", F.when(s >= same, "same").when(s >= related, "related").otherwise("unrelated"))


def import_judgments(cand: DataFrame, judged: DataFrame, stories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, verdict) from a target to every member of its judged units, what isn't named being unrelated; and the targets whose judgment (target,
    id of any member, verdict) puts one unit in both lists, which is rejected whole."""
    unit = stories.select(F.col("article_id").alias("id"), F.col("story_id").alias("unit"))
    said = judged.join(unit, "id").select("target", "unit", "verdict").distinct()
    torn = said.groupBy("target", "unit").agg(F.count_distinct("verdict").alias("n")).filter("n > 1").select("target").distinct()
    rows = cand.select("target", "unit").join(torn, "target", "left_anti").join(said, ["target", "unit"], "left")
    links = rows.join(unit, "unit").select(F.col("target").alias("a"), F.col("id").alias("b"), F.coalesce("verdict", F.lit("unrelated")).alias("verdict"))
    return links, torn


def latest_judgments(links: DataFrame) -> DataFrame:
    """Each article's newest judgment's links (a, b, verdict, judged_at)."""
    last = links.groupBy("a").agg(F.max("judged_at").alias("judged_at"))
    return links.join(last, ["a", "judged_at"])


def same_and_apart(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From latest links (a, b, verdict, ...) the pairs (a, b), smaller first, that are the same, and those judged apart: what either side says counts, and apart wins over the same."""
    pairs = links.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max(F.col("verdict") != "same").alias("apart"))
    return pairs.filter("not apart").select("a", "b"), pairs.filter("apart").select("a", "b")


def labels(edges: DataFrame, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component) of edges (a, b) by alternating stars: each node first hands the smallest of its neighbours (or itself) to its larger neighbours, then to its smaller ones, until every
    node is linked with the smallest of its component alone. Rounds grow with the logarithm of the longest path; save cuts the lineage between them. Links that are such stars already need none. The edges
    of a node with many are dealt over tasks: such nodes are HUBS at most, so that their list is small whatever the graph."""
    pairs = save(edges.filter("a <> b").select(F.greatest("a", "b").alias("h"), F.least("a", "b").alias("l")).distinct())

    def state(pairs: DataFrame) -> Row:
        """The number of pairs, and whether a node with a smaller neighbour has others as well."""
        ends = pairs.select(F.col("h").alias("u"), F.lit(1).alias("smaller")).union(pairs.select("l", F.lit(0)))
        nodes = ends.groupBy("u").agg(F.count("*").alias("degree"), F.max("smaller").alias("smaller"))
        return nodes.agg((F.coalesce(F.sum("degree"), F.lit(0)) / 2).cast("long").alias("n"), F.coalesce(F.max((F.col("smaller") > 0) & (F.col("degree") > 1)), F.lit(False)).alias("open")).first()

    def with_smallest(pairs: DataFrame, key: str, smallest: DataFrame, many: int) -> DataFrame:
        """pairs beside their key's m of smallest (key, m, degree)."""
        if 2 * now.n <= many:  # no node has more edges
            return pairs.join(smallest.select(key, "m"), key)
        hubs = F.broadcast(smallest.filter(F.col("degree") > many).select(key, F.ceil(F.col("degree") / many).cast("int").alias("_parts")))  # HUBS rows at most
        dealt = pairs.join(hubs, key, "left").withColumn("_part", F.pmod(F.xxhash64("h", "l"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
        copies = smallest.withColumn("_part", F.explode(F.sequence(F.lit(0), F.ceil(F.col("degree") / many).cast("int") - 1)))
        return dealt.join(copies.select(key, "m", "_part"), [key, "_part"])

    while (now := state(pairs)).open:
        many = max(HUB, -(-2 * now.n // HUBS))
        ends = pairs.select(F.col("l").alias("u"), F.col("h").alias("v")).union(pairs.select("h", "l"))
        near = ends.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("degree"))
        large = save(with_smallest(pairs, "l", near.withColumnRenamed("u", "l"), many).select("h", F.col("m").alias("l")).distinct())
        low = large.groupBy("h").agg(F.min("l").alias("m"), F.count("*").alias("degree"))
        small = with_smallest(large, "h", low, many).select(F.explode(F.array(F.struct("h", F.col("m").alias("l")), F.struct(F.col("l").alias("h"), F.col("m").alias("l")))).alias("p")).select("p.h", "p.l")
        pairs = save(small.filter("h <> l").distinct())
    return pairs.select(F.col("h").alias("node"), F.col("l").alias("component")).union(pairs.select("l", "l").distinct())


def groups(same: DataFrame, apart: DataFrame, save: Callable[[DataFrame], DataFrame], most: int = STORY_SIZE) -> DataFrame:
    """(article_id, story_id) for the ends of same-links (a, b, similarity): links join groups by falling similarity, then ids; one is refused if the group would be too large or
    two of its members were judged apart (a, b). A link that comes first for both of its groups can be decided at once, whatever happens elsewhere, so
    all such links are decided together in rounds; no component has to fit a task."""
    edges = same.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").filter("a <> b").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    edges = save(edges.withColumn("ga", F.col("a")).withColumn("gb", F.col("b")))
    group = save(edges.select(F.col("a").alias("article_id")).union(edges.select("b")).distinct().withColumn("story_id", F.col("article_id")))
    cut = save(apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rank = F.struct(-F.col("similarity"), "a", "b")
    while True:
        size = group.groupBy("story_id").agg(F.count("*").alias("n"))
        of = lambda c: group.select(F.col("article_id").alias(c), F.col("story_id").alias(f"g{c}"))
        barred = cut.join(of("a"), "a").join(of("b"), "b").select(F.least("ga", "gb").alias("l"), F.greatest("ga", "gb").alias("h")).distinct()
        live = edges.filter("ga <> gb").join(size.select(F.col("story_id").alias("ga"), F.col("n").alias("na")), "ga").join(size.select(F.col("story_id").alias("gb"), F.col("n").alias("nb")), "gb").filter(F.col("na") + F.col("nb") <= most)
        live = live.withColumn("l", F.least("ga", "gb")).withColumn("h", F.greatest("ga", "gb")).join(barred, ["l", "h"], "left_anti")
        live = save(live.select("a", "b", "similarity", "ga", "gb"))
        if live.isEmpty():
            return group
        best = live.select(F.col("ga").alias("g"), rank.alias("r")).union(live.select("gb", rank)).groupBy("g").agg(F.min("r").alias("r"))
        first = live.join(best.select(F.col("g").alias("ga"), F.col("r").alias("ra")), "ga").join(best.select(F.col("g").alias("gb"), F.col("r").alias("rb")), "gb").filter((F.col("ra") == rank) & (F.col("rb") == rank))
        move = save(first.select(F.greatest("ga", "gb").alias("gone"), F.least("ga", "gb").alias("to")))
        group = save(group.join(move, F.col("story_id") == F.col("gone"), "left").select("article_id", F.coalesce("to", "story_id").alias("story_id")))
        for c in ("ga", "gb"):
            live = live.join(move.withColumnRenamed("gone", c), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        edges = save(live)


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows (article_id, story_id) that differ from before; who left a group is its own story again."""
    both = before.withColumnRenamed("story_id", "_old").join(after, "article_id", "full").withColumn("story_id", F.coalesce("story_id", "article_id"))
    return both.filter(F.coalesce("_old", "article_id") != F.col("story_id")).select("article_id", "story_id")


def related(links: DataFrame, stories: DataFrame, articles: DataFrame) -> DataFrame:
    """(story_id, related, others, newest): the stories that any member's link, in either direction, names, each by its newest article and how many more there
    are."""
    unit = stories.select(F.col("article_id").alias("a"), F.col("story_id").alias("story_id"))
    way = links.filter("verdict <> 'unrelated'").select("a", "b").distinct()
    one = way.join(unit, "a").join(unit.select(F.col("a").alias("b"), F.col("story_id").alias("related")), "b").filter("story_id <> related").select("story_id", "related").distinct()
    pairs = one.union(one.select("related", "story_id")).distinct()
    face = stories.join(articles.select(F.col("id").alias("article_id"), "at"), "article_id").groupBy(F.col("story_id").alias("related")).agg(F.max_by("article_id", F.struct("at", "article_id")).alias("newest"), (F.count("*") - 1).alias("others"))
    return pairs.join(face, "related").select("story_id", "related", "others", "newest")


def after_delete(stories: DataFrame, deleted: DataFrame) -> DataFrame:
    """Groups without the deleted articles, named by their smallest remaining member."""
    left = stories.join(deleted, "article_id", "left_anti")
    return left.withColumn("story_id", F.min("article_id").over(Window.partitionBy("story_id")))
