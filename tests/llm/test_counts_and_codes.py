import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from newsloom.llm import codes, orchard, tokencounts

VECTORS = "vec_id long, embedding array<float>, label int, code string, error string, cluster string, v string, hash string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "y", "z", None, None) for i, v, label in rows], VECTORS)


@pytest.fixture(scope="module")
def odd_vectors(spark):
    """Ties, repeated rows, equal vectors, a hot label, and rows that take no part."""
    rng = np.random.default_rng(5)
    made = [(i, (rng.integers(-3, 4, 64) / 256 + (0.001 if i % 3 else 0)).tolist(), None if i % 5 == 0 else int(i % 3 == 0)) for i in range(150)]
    made += [(200 + i, made[7][1], 1) for i in range(40)] + [made[9], made[9], (None, made[11][1], 2)]
    bad = [(300, None, 1), (301, [None, *[0.0] * 63], 1), (302, [float("nan"), *[0.0] * 63], 1), (303, [*[0.0] * 63, float("-inf")], 1), (304, [], 1), (305, [0.5] * 63, 1), (306, [1e30, *[0.0] * 63], 1)]
    return made, vectors(spark, made + bad)


def clustered(rows, k, rounds):
    x = [(i, [int(np.floor(256 * np.float32(a).astype(float))) for a in v]) for i, v, _ in rows]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in x if i is not None)[:k]
    at = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(at))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in x]
        for j in range(len(at)):
            held = [v for (_, v), o in zip(x, own, strict=True) if o == j]
            if held:
                at[j] = [sum(c) // len(held) for c in zip(*held, strict=True)]
    found = [(i, *nearest(v)[::-1]) for i, v in x]
    total = sum(d for _, _, d in found)
    return [(i, j, d, sum(e for _, o, e in found if o == j), total, hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest()) for i, j, d in found]


@pytest.mark.parametrize("k, rounds", [(40, 5), (3, 2), (500, 1), (1, 3)])
def test_clusters_equal_brute_force(odd_vectors, k, rounds):
    rows, df = odd_vectors
    found = [tuple(r) for r in orchard.cluster(df, k=k, rounds=rounds).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()]
    assert sorted(found, key=str) == sorted(clustered(rows, k, rounds), key=str)


def test_orchard_search_looks_at_few_and_finds_the_nearest():
    rng = np.random.default_rng(1)
    at = rng.integers(-1000, 1000, (40, 8)) * 50
    x = at[rng.integers(0, 40, 500)] + rng.integers(-40, 41, (500, 8))
    own, d, taken = orchard.Centroids(at).nearest(x)
    every = ((x[:, None] - at[None]) ** 2).sum(axis=2)
    assert (own == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()
    assert taken < 500 * 40 / 10
    # equal centroids, and rows as far from several: the smaller number
    at = np.concatenate([at[:5], at[:5], at[:5]])
    own, _, _ = orchard.Centroids(at).nearest(x)
    assert (own == ((x[:, None] - at[None]) ** 2).sum(axis=2).argmin(axis=1)).all()


def coded(rows, parts, entries, rounds):
    x = [(i, [int(np.floor(256 * np.float32(a).astype(float))) for a in v], label) for i, v, label in rows]
    width = len(x[0][1]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    first = sorted((i, v) for i, v, _ in x if i is not None)[:entries]
    books = [[cut(v)[p] for _, v in first] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            held = {}
            for _, v, _ in x:
                held.setdefault(nearest(cut(v)[p], book)[1], []).append(cut(v)[p])
            books[p] = [[sum(c) // len(held[j]) for c in zip(*held[j], strict=True)] if j in held else e for j, e in enumerate(book)]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    out = []
    for i, v, label in x:
        near = [nearest(part, book) for part, book in zip(cut(v), books, strict=True)]
        out.append((i, "".join(f"{j:02x}" for _, j in near), sum(d for d, _ in near), label))
    return [(i, c, e, sum(f for _, _, f, other in out if other == label), digest) for i, c, e, label in out]


@pytest.mark.parametrize("parts, entries, rounds", [(16, 64, 2), (16, 3, 1), (2, 200, 2), (1, 5, 3)])
def test_codes_equal_brute_force(odd_vectors, parts, entries, rounds):
    rows, df = odd_vectors
    found = [tuple(r) for r in codes.compress(df, parts, entries, rounds).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()]
    assert sorted(found, key=str) == sorted(coded(rows, parts, entries, rounds), key=str)


def test_a_length_that_parts_do_not_divide_is_padded(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=10).astype(np.float32).tolist(), 0) for i in range(30)]
    padded = [(i, v + [0.0, 0.0], label) for i, v, label in rows]
    one, two = (sorted(map(tuple, codes.compress(vectors(spark, r), 4, 8, 2).collect())) for r in (rows, padded))
    assert [r[:3] for r in one] == [r[:3] for r in two]


def test_transform_keeps_squared_distances_and_sequency():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 4, 7, 16):
        x, y = rng.integers(-(2**20), 2**20, (2, 50, n))
        width = codes.transform(x).shape[1]
        assert (((codes.transform(x) - codes.transform(y)) ** 2).sum(axis=1) == width * ((x - y) ** 2).sum(axis=1)).all()
        basis = codes.transform(np.eye(width, dtype=np.int64))
        assert ((np.diff(basis, axis=0) != 0).sum(axis=0) == np.arange(width)).all()


def test_elimination_looks_at_fewer_differences_and_keeps_ties():
    rng = np.random.default_rng(4)
    book = rng.integers(-500, 500, (64, 16))
    book[40] = book[3]
    x = book[rng.integers(0, 64, 400)] + rng.integers(-20, 21, (400, 16))
    entry, d, taken = codes.nearest(codes.transform(x), codes.transform(book))
    every = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    assert (entry == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()
    assert taken < 400 * 64 * 16 / 4


def test_no_vectors(spark):
    none = vectors(spark, [])
    useless = vectors(spark, [(1, None, 1), (2, [float("nan")] * 64, None), (None, [0.5] * 64, 1)])
    for df in (none, useless):
        assert orchard.cluster(df).count() == codes.compress(df).count() == 0
    one = vectors(spark, [(5, [0.5] * 64, None)])
    assert [r.distance for r in orchard.cluster(one).collect()] == [0] and [(r.code, r.label_error) for r in codes.compress(one).collect()] == [("00" * 16, 0)]


TEXTS = ["", " ", "Hello world", "  two  spaces\n\n and\tmore ", "it's we'll I'M they'd", "日本語のテキスト" * 30, "été größe", "a" * 400, "=" * 1999, "a" * 5000, "<|endoftext|>x<|endoftext|>", "<|startoftext|><|end", "1234 ½ Ⅷ ١٢٣", "\x00\x1c\x85 　x", "👩‍👩‍👧 😀!!??", "ab" * 700 + " " + "yz" * 90]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("together", [True, False])
def test_counts_equal_the_library(name, together, spark, sf):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    rng = np.random.default_rng(6)
    texts = TEXTS + ["".join(rng.choice(list("abcdeinorst"), n)) for n in (3, 50, 64, 65, 1500, 2048, 2049, 3000)] + [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    c = tokencounts.Counter(path)
    if not together:  # one occurrence at a time
        c.together[:] = False
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert c.count_batch(texts).tolist() == want == c.count_batch(texts).tolist()
    c.forget()
    assert [int(c.count_batch([t])[0]) for t in texts[:20]] == want[:20]


def test_counts_of_odd_rows(odd_documents, no_documents):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    rows = tokencounts.counts(odd_documents, path, limit=5).collect()
    texts = [(r.doc_id, r.text or "") for r in odd_documents.collect()]
    want = [(i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 5) for i, t in texts]
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert tokencounts.counts(no_documents, path).count() == 0


def test_counts_of_a_long_text(spark):
    text = " ".join(f"word{k % 7919} {'x' * (k % 90)}" for k in range(60_000))
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    assert len(text) > 2_000_000
    rows = tokencounts.counts(spark.createDataFrame([(1, text), (2, "a")], "doc_id long, text string"), path).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {1: (len(text), len(library.encode(text, add_special_tokens=False).ids), True), 2: (1, 1, False)}
