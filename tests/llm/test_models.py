import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import ann, common, ctw, quality, toxicity
from newsloom.llm.common import fold


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_base_scores_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in docs.select("doc_id").collect()}
    texts = {r.doc_id: [*words(r.text), "<end>"] for r in docs.collect()}
    c = Counter(w for i, t in texts.items() if not held[i] for w in t)
    total = sum(c.values())
    got = ctw.scores(docs, fold("doc_id", 7) != 2, fold("doc_id", 7) == 2).collect()
    for r in got:
        t = texts[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(w in c for w in t), total)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (total + len(c) + 1)) for w in t), rel=1e-9)
        assert r.score < 0


def test_tree_equals_plain_context_tree_weighting():
    """Against the recursion on every node, over a short text with all contexts kept."""
    text = b"abracadabra abracadabra\n"
    depth = 2
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    g = ctw.grams(data, offsets, depth)
    nodes = {}
    for d in range(depth + 1):
        for x in g.tolist():
            n = nodes.setdefault((d, (x >> 8) & (1 << 8 * d) - 1), np.zeros(256))
            n[x & 255] += 1
    tree = ctw.Tree(nodes, depth)

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def counts(d, c, bits):
        n = nodes.get((d, c), np.zeros(256))
        low = int(bits, 2) << (8 - len(bits)) if bits else 0
        half = 1 << (7 - len(bits))
        return n[low : low + half].sum(), n[low + half : low + 2 * half].sum()

    def weighted(d, c, bits, extra=None):
        """Log probability of a decision's data below a node; extra: the longest context and bit of one decision more."""
        a, b = counts(d, c, bits)
        if extra is not None and extra[0] & (1 << 8 * d) - 1 == c:
            a, b = a + (extra[1] == 0), b + (extra[1] == 1)
        if d == depth:
            return kt(a, b)
        below = sum(weighted(d + 1, k, bits, extra) for e, k in nodes if e == d + 1 and k & (1 << 8 * d) - 1 == c)
        rest = kt(0, 0)  # no rare contexts here
        return np.logaddexp(kt(a, b), below + rest) - math.log(2)

    context = int(g[5]) >> 8
    for x in (ord("a"), ord("b"), ord("z")):
        bits = format(x, "08b")
        expected = sum(weighted(0, 0, bits[:k], (context, int(bits[k]))) - weighted(0, 0, bits[:k]) for k in range(8)) / math.log(10)
        assert tree.logs[tree.leaf(np.array([context]))[0], x] == pytest.approx(expected, abs=1e-4)


def test_tree_rows_are_distributions():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 103, 5000).astype(np.uint8)
    g = ctw.grams(data, np.array([0, 5000]), 3)
    nodes = {}
    for d in range(4):
        keys, n = np.unique((g >> 8) & (1 << 8 * d) - 1, return_counts=True)
        for c in keys[n > 40]:
            nodes[d, int(c)] = np.bincount(g[((g >> 8) & (1 << 8 * d) - 1) == c] & 255, minlength=256).astype(float)
    assert np.allclose((10.0 ** ctw.Tree(nodes, 3).logs.astype(float)).sum(axis=1), 1, atol=1e-4)


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 3, 7.9, 8, 100.25, 1e7])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-10)


@pytest.mark.parametrize("share", [0.0, 1e-4, 1.0])
def test_every_context_is_a_node(spark, share):
    """However few of the training bytes a context has; against the tree in memory with all contexts, on texts with grams that weren't seen."""
    rng = np.random.default_rng(9)
    common = " ".join(["the same words again and again"] * 400)
    texts = [common] * 8 + [" ".join("".join(rng.choice(list("abcdeé"), 5)) for _ in range(60)) for _ in range(30)] + ["zq zq xy", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    learned = [t.encode() for i, t in enumerate(texts) if i % 3 != 1]
    plain, at = ctw.canonical(np.frombuffer(b"".join(learned), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in learned]))).astype(np.int64))
    nodes = {}
    for d in range(ctw.DEPTH + 1):
        for x in ctw.grams(plain, at).tolist():
            nodes.setdefault((d, (x >> 8) & (1 << 8 * d) - 1), np.zeros(256))[x & 255] += 1
    assert min(n.sum() for n in nodes.values()) < 2.0**-16 * len(plain)
    tree = ctw.Tree(nodes)
    got = ctw.scores(docs, F.col("doc_id") % 3 != 1, F.col("doc_id") % 3 == 1, gram_share=share).collect()
    assert len(got) == len(texts)
    for r in got:
        t = (texts[r.doc_id] or "").encode()
        one = ctw.canonical(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert r.score == pytest.approx(tree.score(*one)[0], rel=1e-3, abs=1e-3)


def test_ctw_odd_rows(odd_documents, no_documents):
    got = ctw.scores(odd_documents, fold("doc_id", 7) != 2, fold("doc_id", 7) == 2).collect()
    assert len(got) == odd_documents.count() and all(r.score < 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (3, 4, 5)} == {1}
    assert ctw.scores(no_documents, F.lit(True), F.lit(False)).count() == 0
    assert all(r.train_tokens == 0 and r.base_score == 0 for r in ctw.scores(odd_documents, F.lit(False), F.lit(True)).collect())


@pytest.mark.parametrize("score", [quality.quality, toxicity.toxicity])
def test_classifiers_odd_rows(score, odd_documents, no_documents, labels):
    learns, held = fold("doc_id", 4) != 2, fold("doc_id", 4) == 2
    got = score(odd_documents, labels, learns, held).collect()
    assert len(got) == odd_documents.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out is not None for r in got)
    assert score(no_documents, labels, learns, held).count() == 0
    assert {r.score for r in score(odd_documents, labels.limit(0), learns, held).collect()} == {0.5}


@pytest.mark.parametrize("module", [quality, toxicity])
def test_filters_keep_columns(module, odd_documents, labels):
    out = module.scored(odd_documents, labels, fold("doc_id", 4) != 2).select("_row.*")
    assert out.dtypes == odd_documents.dtypes and out.count() == odd_documents.count()


@pytest.mark.parametrize(("score", "label", "n", "rest", "least"), [(quality.quality, "quality", 5, 0, 0.9), (toxicity.toxicity, "toxic", 4, 2, 0.75)])
def test_held_out_accuracy(spark, score, label, n, rest, least):
    sf = "/root/testdata/sf0.01"
    docs, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = score(docs, marks, fold("doc_id", n) != rest, fold("doc_id", n) == rest)
    rows = got.filter("held_out").join(marks, "doc_id").select("score", label).collect()
    ones, zeros = ([r.score for r in rows if r[label] == k] for k in (1, 0))
    auc = np.mean([(a > b) + (a == b) / 2 for a in ones for b in zeros])
    assert auc > least


def test_statistics_don_t_depend_on_neighbours():
    texts = [b"One line.\nOne line.\nTHREE WORDS HERE!!", b"", b"x%%% y### 12"]
    alone = np.concatenate([quality.statistics(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in texts])
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    assert np.allclose(alone, quality.statistics(np.frombuffer(b"".join(texts), np.uint8), at))


def test_hadamard_keeps_length():
    x = np.random.default_rng(6).normal(size=(10, 64))
    assert np.allclose(np.linalg.norm(ann.hadamard(x), axis=1), np.linalg.norm(x, axis=1))


def exact(rows, query, k):
    q = np.array(rows[query])
    near = sorted((float(np.sqrt(((np.array(v) - q) ** 2).sum())), i) for i, v in rows.items() if i != query and len(v) == len(q))
    return [(i, d) for d, i in near[:k]]


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = {i: [float(x) for x in rng.normal(size=32)] for i in range(1500)}
    for i in range(40):  # copies
        rows[2000 + i] = rows[100]
    odd = [(5000, None), (5001, [0.0] * 32), (5002, [float("nan")] * 32), (5003, [1.0, None] * 16), (5004, []), (None, rows[0]), (5005, [1.0, 2.0, 3.0]), (5100, [1.0, 2.0, 4.0])]
    df = spark.createDataFrame([*rows.items(), *odd], "vec_id long, embedding array<double>").selectExpr("*", "'x' rank", "1 part", "2 ids")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    asked = [i for i in rows if i % 100 == 0]
    assert set(got) == {*asked, 5100}
    assert got[5100] == {1: (5005, 1.0)}
    found = 0
    for q in asked:
        want = exact(rows, q, 10)
        found += len({i for i, _ in want} & {i for i, _ in got[q].values()})
        scores = [got[q][k][1] for k in sorted(got[q])]
        assert scores == sorted(scores) and q not in {i for i, _ in got[q].values()}
    assert found >= 0.9 * 10 * len(asked)
    assert [got[100][k][0] for k in range(1, 11)] == list(range(2000, 2010))


@pytest.mark.parametrize("n, low, high", [(1000, 0.5, 2.0), (5000, 0.5, 2.0), (5000, 0.1, 10.0)])
def test_neighbours_of_unequal_lengths(spark, n, low, high):
    """Hashes see directions only; recall of the ten nearest by Euclidean distance, at two sizes."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(n, 64))
    x *= (np.exp(rng.uniform(np.log(low), np.log(high), n)) / np.linalg.norm(x, axis=1))[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    found = 0
    for q in range(0, n, 100):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        found += len(got[q] & set(np.argsort(d)[:10].tolist()))
    print("recall", n, low, high, found / (n // 10))
    assert found >= 0.9 * (n // 10)


def test_neighbours_empty_table(spark):
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).count() == 0


def test_few_vectors_give_all_candidates(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=64)]) for i in range(0, 700, 100)] + [(100, [float(x) for x in rng.normal(size=64)])]  # one id with two vectors
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in range(0, 700, 100):
        nearest = {}
        for a, x in rows:
            for b, y in rows:
                if a == q and b != q:
                    nearest[b] = min(nearest.get(b, math.inf), float(np.sqrt(((np.array(y) - np.array(x)) ** 2).sum())))
        assert [(v, pytest.approx(s)) for _, v, s in sorted(got[q])] == [(v, s) for s, v in sorted((s, v) for v, s in nearest.items())]


def plain_statistics(text):
    """Some of the statistics of a text, by plain Python."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", text)
    lines = [x for x in re.split(rb"[\n\r]+", text) if x]
    low = [w.lower() for w in words]
    n = max(1, len(words))
    letters = lambda w: [c for c in w if c >= 128 or chr(c).isalpha()]
    share = Counter(text)
    return {
        "log_bytes": math.log1p(len(text)), "log_words": math.log1p(len(words)), "word_length": sum(map(len, words)) / n, "longest_word": math.log1p(max(map(len, words), default=0)),
        "letters": len(letters(text)) / max(1, len(text)), "digits": sum(48 <= c < 58 for c in text) / max(1, len(text)), "distinct_words": len(set(low)) / math.sqrt(len(words)) if words else 0,
        "common_word": max(Counter(low).values()) / len(words) if words else 0, "words_without_letters": sum(not letters(w) for w in words) / n,
        "repeated_lines": 1 - len({x.lower() for x in lines}) / len(lines) if lines else 0, "entropy": -sum(k / len(text) * math.log2(k / len(text)) for k in share.values()),
    }


def test_statistics_equal_plain_python(spark, sf):
    texts = [(r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + [b"", b"A\nA\nb 1 22", b"\x00 x"]
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = quality.statistics(np.frombuffer(b"".join(texts), np.uint8), at)
    for row, text in zip(got, texts, strict=True):
        for name, value in plain_statistics(text).items():
            assert row[quality.STATISTICS.index(name)] == pytest.approx(value, abs=1e-9), (name, text[:60])


def test_normal_sums_equal_one_product(spark):
    rng = np.random.default_rng(2)
    x, label, part = rng.normal(size=(500, len(quality.STATISTICS))), rng.integers(0, 2, 500).astype(float), rng.integers(0, 2, 500)
    features = quality.Features(x.mean(axis=0), x.std(axis=0))
    rows = spark.createDataFrame([(a.tolist(), float(b), int(c)) for a, b, c in zip(x, label, part, strict=True)], f"{quality.X} array<double>, label double, part int").repartition(7)
    got = quality.normal_sums(rows, features)
    for k in (0, 1):
        z = features(x[part == k])
        assert np.allclose(got[k], z.T @ np.column_stack([z, label[part == k]]))


def test_toxic_words_counted_as_by_plain_python():
    texts = [b"You idiot, you are a moron and a clown.", b"the sea is calm", b"", b"IDIOT idiot! y0u stuuupid i d i o t"]
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = toxicity.measure(np.zeros(0, np.uint64))(np.frombuffer(b"".join(texts), np.uint8), at)
    for row, text in zip(got, texts, strict=True):
        words = [w.lower() for w in re.findall(rb"[A-Za-z\x80-\xff]+", text)]
        hits = sum(w.decode() in toxicity.INSULTS for w in words)
        assert row[toxicity.FEATURES.index("insults")] == pytest.approx(min(hits, 20) + 100 * hits / max(1, len(words)))
        assert row[toxicity.FEATURES.index("second_person")] == pytest.approx(sum(w.decode() in toxicity.SECOND_PERSON for w in words) / max(1, len(words)))
        assert row[toxicity.FEATURES.index("exclamations")] == pytest.approx(text.count(b"!") / max(1, len(text)))
        assert row[toxicity.FEATURES.index("single_letters")] == pytest.approx(sum(len(w) == 1 for w in words) / max(1, len(words)))


def test_hashes_of_long_texts_equal_those_of_their_words():
    rng = np.random.default_rng(1)
    data = rng.choice(np.frombuffer(b"abcDEF   \n", np.uint8), 3 * common.SPAN)
    data[common.SPAN // 2 : 2 * common.SPAN] = 97  # a word over three spans
    start, end, _ = common.word_spans(data, np.array([0, len(data)]))
    whole = common.word_hashes(data, start, end)
    for i in [*range(20), int((end - start).argmax()), len(start) - 1]:
        word = data[start[i] : end[i]]
        assert common.word_hashes(word, np.array([0]), np.array([len(word)]))[0] == whole[i]
