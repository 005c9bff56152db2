import itertools
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from newsloom.llm import bpe, packing

TEXTS = ["", " ", "Hello world", "  two  spaces\n\n and\tmore ", "it's we'll I'M they'd", "日本語のテキスト" * 30, "ΟΔΟΣ Σ İstanbul ǅ", "été", "a" * 400, "<|endoftext|>x<|endoftext|>", "<|startoftext|>", "1234 ½ Ⅷ ١٢٣", "\x00\x1c\x85 　x", "👩‍👩‍👧 😀!!??", "x" * 70 + " " + "yz" * 90]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_library(name):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    ids, at = bpe.Encoder(path).encode_batch(TEXTS)
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(at)] == [library.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_decoding_gives_the_text():
    e = bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for t in TEXTS:
        assert e.decode(e.encode(t)) == t


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 2)
    e = bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    first = [e.encode(t) for t in TEXTS]
    assert [e.encode(t) for t in TEXTS] == first


def test_encoded_odd_rows(odd_documents, no_documents):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = bpe.encoded(odd_documents, path).collect()
    assert sorted((r.decoded for r in rows), key=str) == sorted(((r.text or "") for r in odd_documents.collect()), key=str)
    assert bpe.digests(no_documents, path).count() == 0


def test_packing_is_whole_and_tight(odd_documents, spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(odd_documents, path, capacity=64).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by.values():
        held.sort()
        assert [o for o, _ in held] == [0, *itertools.accumulate(n for _, n in held[:-1])]
        assert sum(n for _, n in held) <= 64
    assert sum(r.piece == 0 for r in rows) == odd_documents.count()
    assert len(by) == -(-sum(r.length for r in rows) // 64)


def test_packing_empty_table(no_documents):
    assert packing.pack(no_documents, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def least_bins(lengths, capacity):
    """Exhaustive search."""
    best = len(lengths)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[i]:
                go(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - lengths[i]])

    go(0, [])
    return best


def test_plan_finds_the_least_number():
    rng = np.random.default_rng(3)
    for _ in range(40):
        lengths = sorted(rng.integers(1, 30, rng.integers(1, 9)).tolist(), reverse=True)
        histogram = {}
        for n in lengths:
            histogram[n] = histogram.get(n, 0) + 1
        runs = packing.plan(histogram, 30)
        used = {}
        for r in runs:
            assert sum(a * m for a, m in r.filling) <= 30
            for a, m in r.filling:
                used[a] = used.get(a, 0) + m * r.times
        assert used == histogram
        assert sum(r.times for r in runs) == least_bins(lengths, 30)


def uses(runs):
    used = {}
    for r in runs:
        for a, m in r.filling:
            used[a] = used.get(a, 0) + m * r.times
    return used


@pytest.mark.parametrize("low, high, n", [(600, 2499, 1500), (1, 4096, 1000), (2049, 4096, 2000), (1400, 2000, 2000), (100, 1500, 2000), (1, 200, 50_000), (700, 3000, 300), (4096, 4096, 7)])
def test_plan_is_never_worse_than_best_fit(low, high, n):
    lengths, counts = np.unique(np.random.default_rng(n).integers(low, high + 1, n), return_counts=True)
    histogram = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    rooms = []  # best fit by falling lengths, piece by piece
    for a in sorted(np.repeat(lengths, counts).tolist(), reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= a] if n <= 2000 else []
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= a
        else:
            rooms.append(4096 - a)
    began = time.time()
    runs = packing.plan(histogram)
    assert time.time() - began < 60
    assert uses(runs) == histogram and all(sum(a * m for a, m in r.filling) <= 4096 for r in runs)
    found = sum(r.times for r in runs)
    assert packing.least_sequences(histogram, 4096) <= found <= len(rooms)


def test_bulk_best_fit_equals_piece_by_piece():
    rng = np.random.default_rng(8)
    for _ in range(50):
        lengths, counts = np.unique(rng.integers(1, 40, rng.integers(1, 200)), return_counts=True)
        rooms = []
        for a in sorted(np.repeat(lengths, counts).tolist(), reverse=True):
            fits = [k for k, r in enumerate(rooms) if r >= a]
            if fits:
                rooms[min(fits, key=lambda k: rooms[k])] -= a
            else:
                rooms.append(64 - a)
        found = packing.best_fit(dict(zip(lengths.tolist(), counts.tolist(), strict=True)), 64)
        assert sum(times for _, times in found) == len(rooms)


def test_lower_bound_holds():
    rng = np.random.default_rng(5)
    for _ in range(60):
        lengths = rng.integers(1, 30, rng.integers(1, 9)).tolist()
        assert packing.least_sequences({a: lengths.count(a) for a in lengths}, 30) <= least_bins(lengths, 30)


def test_packed_documents_are_those_of_the_library(spark, sf):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack(docs, path).collect()
    ids = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    assert len(rows) == sum(-(-len(x) // 4096) for x in ids.values())
    held = {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == 4096 * r.piece and len(part) == r.length == min(4096, len(ids[r.doc_id]) - r.start)
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        places.sort()
        assert [o for o, _ in places] == [0, *itertools.accumulate(n for _, n in places[:-1])] and sum(n for _, n in places) <= 4096
    assert len(held) == -(-sum(map(len, ids.values())) // 4096)


def test_packing_plan_keeps_no_counts_of_open_sequences():
    """Thousands of sequences are open at once; each kept a copy of the counts of all lengths, and so the driver some 260 MB."""
    rng = np.random.default_rng(8)
    histogram = {a: int(n) for a, n in zip(range(1, 4097), rng.integers(1, 90, 4096), strict=True)}
    alone = [(((a, 1),), n) for a, n in histogram.items()]
    tracemalloc.start()
    found = packing.completed(histogram, packing.CAPACITY, alone, packing.least_sequences(histogram, packing.CAPACITY))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    used = Counter()
    for filling, times in found:
        assert sum(a * m for a, m in filling) <= packing.CAPACITY
        for a, m in filling:
            used[a] += m * times
    assert used == histogram and len(found) > 3000
    assert most < 60e6
    left = packing.Lengths({3000: 2, 1096: 1, 900: 60, 200: 9}, packing.CAPACITY)
    before = left.count.copy()
    for _ in left.fillings(3000, packing.CAPACITY):
        assert (left.count == before).all()
    assert (left.count == before).all()
