"""Toxicity scores: boosted trees over dense features, with isotonic calibration.

The features are densities of a fixed lexicon and of a learned one (whole words and word beginnings, which hold for inflected
forms), how near its words stand to the second person, capitals, exclamation and other marks, and words that look
obfuscated (letters broken by digits or signs, single letters in a row, one letter repeated). The learned lexicon comes
from one half of the training fold and the trees from the other, so that the densities mean the same for new texts. The calibration is learned from raw scores
of rows that their trees haven't seen: half of these rows, scored by trees from the other half.

Learning uses at most SAMPLE labelled rows for each half, chosen by a hash of their ids; scoring uses all rows and whole texts.

Defined results: null and empty texts are scored by their (zero) features. Without both labels in the training fold the score is the mean
label, without any one half, or what scored is given for that. Null ids are scored and in no fold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, chunks, hash_word, mix, saved, spread, text_bytes, word_hashes, word_spans
from .learning import RAW, ROW, X, calibration, judged, labelled, measured, sampled, whole

#: Labelled rows for the lexicon and for the trees; entries of the learned lexicon; words that count as near.
SAMPLE, ENTRIES, NEAR = 40_000, 600, 6
#: An entry is in so many toxic texts of the sample at least, and so many times as often in toxic ones as in others.
SUPPORT, RATIO = 5, 12.0
#: Lengths in bytes of word beginnings.
BEGINNINGS = (4, 5, 6)
TREES, DEPTH, STEP = 12, 4, 0.3
# fixed word lists
INSULTS = "idiot moron loser pathetic worthless scum clown trash disgusting stupid dumb fool imbecile cretin vermin filth garbage parasite coward liar".split()
SECOND_PERSON = "you your yours yourself u du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro".split()
FEATURES = "insults learned_words learned_beginnings distinct_hits near_second_person second_person capitals capital_words exclamations marks symbols broken_words single_letters repeated_letters log_words".split()

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_SIGN = np.zeros(256, bool)
_SIGN[list(b"*@$#0123456789_+-.")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?'\"()-")] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[c for c in range(33, 127) if not (_LETTER[c] or _MARK[c] or 48 <= c < 58)]] = True


def hashes(words: list[str]) -> np.ndarray:
    return np.sort(np.array([hash_word(w.encode()) for w in words], np.uint64))


def within(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in a sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def beginnings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of a beginning, which words are longer and the hashes of their beginnings."""
    for n in BEGINNINGS:
        longer = np.flatnonzero(end - start > n)
        yield longer, mix(word_hashes(data, start[longer], start[longer] + n) + np.uint64(n))


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words and beginnings of each row: row numbers and hashes."""
    start, end, count = word_spans(data, offsets, ~_LETTER)
    row = np.repeat(np.arange(len(count)), count)
    rows, found = [row], [word_hashes(data, start, end)]
    for longer, h in beginnings(data, start, end):
        rows.append(row[longer])
        found.append(h)
    row, h = np.concatenate(rows), np.concatenate(found)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[first], h[first]


def lexicon(train: DataFrame) -> np.ndarray:
    """Sorted hashes of words and beginnings that tell toxic texts of train (text, label) from the others."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            row, h = terms(*text_bytes(batch.column("text")))
            toxic = batch.column("label").to_numpy()[row] > 0
            keys, at = np.unique(h, return_inverse=True)
            n, t = np.bincount(at, minlength=len(keys)), np.bincount(at, weights=toxic, minlength=len(keys))
            yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(t.astype(np.int64))], names=["h", "n", "t"])

    rows, toxic = train.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).collect()[0]
    if not toxic or toxic == rows:
        return np.zeros(0, np.uint64)
    found = train.select("text", "label").mapInArrow(count, "h long, n long, t long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    rate = (F.col("t") / toxic) / ((F.col("n") - F.col("t") + 1) / (rows - toxic))
    kept = found.filter((F.col("t") >= SUPPORT) & (rate >= RATIO)).orderBy(F.col("t") * F.log(rate), "h", ascending=[False, True]).limit(ENTRIES)
    return np.sort(np.array([r["h"] for r in kept.select("h").collect()], np.int64).view(np.uint64))


def features(data: np.ndarray, offsets: np.ndarray, learned: np.ndarray, insults: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text."""
    start, end, count = word_spans(data, offsets, ~_LETTER)
    h = word_hashes(data, start, end)
    edge = np.concatenate(([0], np.cumsum(count)))
    words = np.maximum(count, 1)
    put = {f: k for k, f in enumerate(FEATURES)}
    out = np.zeros((len(count), len(FEATURES)))
    insult, word, you = within(h, insults), within(h, learned), within(h, second)
    begin = np.zeros(len(h), bool)
    for longer, b in beginnings(data, start, end):
        begin[longer] |= within(b, learned)
    hit = insult | word | begin
    for name, flags in (("insults", insult), ("learned_words", word), ("learned_beginnings", begin)):
        n = spread(flags, edge)
        out[:, put[name]] = np.minimum(n, 20) + 100 * n / words
    at = np.flatnonzero(hit)
    row = np.searchsorted(edge, at, side="right") - 1
    if len(at):
        pairs = np.unique(np.stack([row.astype(np.uint64), h[at]]), axis=1)
        out[:, put["distinct_hits"]] = np.bincount(pairs[0].astype(np.int64), minlength=len(count))
        # the share of hits with a second person within NEAR words, in the same text
        running = np.concatenate(([0], np.cumsum(you)))
        near = running[np.minimum(at + NEAR + 1, edge[row + 1])] - running[np.maximum(at - NEAR, edge[row])] > 0
        out[:, put["near_second_person"]] = np.bincount(row, weights=near, minlength=len(count)) / np.maximum(np.bincount(row, minlength=len(count)), 1)
    out[:, put["second_person"]] = spread(you, edge) / words
    size = np.maximum(np.diff(offsets), 1)
    capital = np.concatenate(([0], np.cumsum(_CAPITAL[data], dtype=np.int64)))
    out[:, put["capitals"]] = np.diff(capital[offsets]) / size
    out[:, put["capital_words"]] = spread((end - start > 1) & (capital[end] - capital[start] == end - start), edge) / words
    out[:, put["exclamations"]] = spread(data == 33, offsets) / size
    out[:, put["marks"]] = spread(_MARK[data], offsets) / size
    out[:, put["symbols"]] = spread(_SYMBOL[data], offsets) / size
    # a sign or digit between two letters; letters that stand alone; a letter three times
    inner = np.zeros(len(data), bool)
    inner[1:-1] = _SIGN[data[1:-1]] & _LETTER[data[:-2]] & _LETTER[data[2:]]
    out[:, put["broken_words"]] = spread(inner, offsets) / words
    out[:, put["single_letters"]] = spread(end - start == 1, edge) / words
    low = LOWER[data]
    same = np.zeros(len(data), bool)
    same[2:] = (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & _LETTER[data[2:]]
    out[:, put["repeated_letters"]] = spread(same, offsets) / words
    out[:, put["log_words"]] = np.log1p(count)
    return out


def measure(learned: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """What makes a row of FEATURES for each text with a learned lexicon."""
    tables = learned, hashes(INSULTS), hashes(SECOND_PERSON)
    return lambda data, offsets: features(data, offsets, *tables)


def learned_lexicon(docs: DataFrame, labels: DataFrame, learns: Column) -> tuple[np.ndarray, int]:
    """The lexicon from one half of the training fold, and the number of labelled rows in all of it."""
    known = labelled(docs.select("doc_id"), labels, "toxic", learns)
    count = known.count()
    first = sampled(known.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)) == 0), SAMPLE, count // 2)
    return lexicon(saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(first), "doc_id"))), count  # SAMPLE rows


def model(rows: DataFrame, labels: DataFrame, learns: Column, count: int, unknown: float = 0.5) -> Callable[[DataFrame], DataFrame]:
    """From rows (doc_id, X) and labels (doc_id, toxic), the half that the lexicon doesn't come from, what adds RAW and SCORE to rows with X."""
    other = labelled(rows, labels, "toxic", learns).filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)) == 1)
    train = saved(sampled(other, SAMPLE, count // 2).withColumn("_half", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2)).cast("int")))
    low, high, mean = train.agg(F.min("label"), F.max("label"), F.avg("label")).collect()[0]
    if low == high:
        raw = unknown if mean is None else mean
        return lambda rows: calibration(train.withColumn(RAW, F.lit(raw)), unknown)(rows.withColumn(RAW, F.lit(raw)))
    trees = GBTClassifier(featuresCol="_v", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, minInstancesPerNode=10, seed=17, maxMemoryInMB=64, predictionCol="_c")
    trees = trees.setRawPredictionCol("_rp").setProbabilityCol("_p")

    def raw_from(rows: DataFrame) -> Callable[[DataFrame], DataFrame]:
        fitted = trees.fit(rows.select(array_to_vector(X).alias("_v"), "label").repartition(8))
        return lambda df: fitted.transform(df.withColumn("_v", array_to_vector(X))).withColumn(RAW, vector_to_array("_p")[1]).drop("_v", X, "_rp", "_p", "_c")

    raw = raw_from(train)
    first, second = (train.filter(F.col("_half") == k) for k in (0, 1))
    both = all(h.agg(F.coalesce(F.min("label") != F.max("label"), F.lit(False))).collect()[0][0] for h in (first, second))
    calibrate = calibration(raw_from(first)(second) if both else raw(train))
    return lambda rows: calibrate(raw(rows))


def toxicity(docs: DataFrame, labels: DataFrame, learns: Column, held_out: Column, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (the probability of toxic 1), predicted and raw of every row of docs (doc_id, text). learns and held_out are
    conditions on doc_id."""
    learned, count = learned_lexicon(docs, labels, learns)
    rows = saved(measured(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id"], measure(learned)))
    return judged(model(rows, labels, learns, count)(rows), held_out, threshold)


def scored(docs: DataFrame, labels: DataFrame, learns: Column, unknown: float = 0.5) -> DataFrame:
    """ROW, RAW and SCORE of every row of docs; only the sample's texts are shuffled."""
    learned, count = learned_lexicon(docs, labels, learns)
    fitted = model(measured(docs, ["doc_id"], measure(learned)), labels, learns, count, unknown)
    return fitted(measured(whole(docs), [ROW], measure(learned)))
