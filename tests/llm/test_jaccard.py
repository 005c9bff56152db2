import re

import numpy as np
from pyspark.sql import functions as F

from newsloom.llm import jaccard
from newsloom.llm.common import once


def brute(rows):
    sets = {}
    for i, t in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(n, words, seed):
    """Documents of a few bases with edits, so that links chain and some copies stand alone."""
    rng = np.random.default_rng(seed)
    bases = [rng.integers(0, 5000, words) for _ in range(4)]
    passage = rng.integers(0, 5000, 60)
    rows = []
    for i in range(n):
        w = bases[i % 4].copy()
        at = rng.integers(0, words, rng.integers(0, 7))
        w[at] = rng.integers(0, 5000, len(at))
        if i % 9 == 0:
            w = np.concatenate([rng.integers(0, 5000, 80), passage])
        rows.append((i, " ".join(f"w{x}" for x in w)))
    return rows


def test_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "DENSE", 64)
    rows = near_copies(160, 150, 1) + [(1000 + i, t) for i, t in near_copies(12, 150, 1)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute(rows)


def test_documents_of_shared_paragraphs(spark, monkeypatch):
    """Hot tokens: documents put together from few paragraphs, of which some links join, dealt over tasks; and a text of 2 MB beside its near copy."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "SETS", 64)
    rng = np.random.default_rng(3)
    paragraphs = [" ".join(f"p{k}w{x}" for x in rng.integers(0, 900, 30)) for k in range(12)]
    rows = [(i, " ".join(paragraphs[k] for k in sorted(rng.choice(12, 6, replace=False)))) for i in range(220)]
    long = [f"long{x}" for x in rng.integers(0, 50_000, 220_000)]
    rows += [(900, " ".join(long)), (901, " ".join(long[:180_000]))]
    assert len(rows[-2][1]) > 2_000_000
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute(rows)
    assert got[901][1] == 900


def test_odd_rows(odd_documents):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(odd_documents).collect()]
    assert len(got) == odd_documents.count()
    by = {d: (n, c) for d, n, c in got}
    assert by[1] == (6, 1) and by[2] == (6, 1)
    assert by[3] == (0, 3) and by[4] == (0, 4) and by[5] == (0, 5)
    assert by[6] == (1, 6) and by[7] == (1, 6)
    assert by[9][1] == 8 and by[None][1] is None


def test_empty_table(no_documents):
    assert jaccard.near_duplicates(no_documents).count() == 0


def test_filters_never_lose_a_link():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        x = np.unique(rng.integers(0, 10**9, n))
        y = np.unique(np.concatenate([x[rng.random(len(x)) > rng.random() * 0.3], rng.integers(0, 10**9, rng.integers(0, 12))]))
        both = len(np.intersect1d(x, y))
        assert jaccard.linked(x, y) == (len(y) > 0 and 100 * both >= 75 * (len(x) + len(y) - both))


def test_once_keeps_every_other_row(spark):
    df = spark.range(5000).withColumnRenamed("id", "doc_id")
    gone = df.filter("doc_id % 3 = 0")
    got = once(df.unionByName(df), gone.withColumn("goes", F.lit(True)).unionByName(df.filter("doc_id % 3 = 1").withColumn("goes", F.lit(False))), "doc_id", "goes")
    assert got.count() == df.filter("doc_id % 3 = 1").count() + 2 * df.filter("doc_id % 3 = 2").count()
