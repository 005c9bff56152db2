"""The trigram index over several updates against a scan of the texts."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom.operators import search


def texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def scanned(rows, term):
    return sorted(i for i, t in rows if t and term.lower() in t.lower())


@pytest.fixture()
def rows():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdeÄ"), rng.integers(2, 6))) for _ in range(60)]
    return [(i, " ".join(rng.choice(words, rng.integers(0, 30)))) for i in range(200)] + [(500, None), (501, ""), (502, "ab")]


TERMS = ["abc", "CDE", "a b", "deÄ", "zzz", "abcdeabcde"]


def test_search_after_updates_equals_a_scan(spark, tmp_path, rows):
    index = search.TrigramIndex(spark, str(tmp_path), 16)
    found = lambda now, term: sorted(r.doc_id for r in index.search(texts(spark, now), term).collect())
    assert index.update(texts(spark, rows[:150])) == 150
    assert [found(rows[:150], t) for t in TERMS] == [scanned(rows[:150], t) for t in TERMS]
    # new texts, changed ones (to no longer match, and to match), and ones that went
    now = [(i, "nothing of it" if i < 20 else f"{t} xabcdeabcdex" if i < 25 else t) for i, t in rows if not 25 <= i < 40]
    assert index.update(texts(spark, now)) == 25 + 15 + 53
    assert [found(now, t) for t in TERMS] == [scanned(now, t) for t in TERMS] and found(now, "abcdeabcde")
    assert index.update(texts(spark, now)) == 0
    # back to the first texts: earlier postings of the same texts don't count twice
    assert index.update(texts(spark, rows)) == 40
    assert [found(rows, t) for t in TERMS] == [scanned(rows, t) for t in TERMS]


def test_an_update_that_failed_is_done_over(spark, tmp_path, rows):
    index = search.TrigramIndex(spark, str(tmp_path), 4)
    index.update(texts(spark, rows[:100]))
    # postings of an update without its versions
    spark.createDataFrame([("abc", 3, b, 2) for b in range(4)], "gram string, doc_id long, bucket int, update int").write.mode("append").partitionBy("bucket", "update").parquet(f"{tmp_path}/postings")
    found = lambda now: sorted(r.doc_id for r in index.search(texts(spark, now), "abc").collect())
    assert found(rows[:100]) == scanned(rows[:100], "abc")
    index.update(texts(spark, rows))
    assert found(rows) == scanned(rows, "abc")


def test_a_search_reads_the_buckets_of_its_grams(spark, tmp_path, rows):
    index = search.TrigramIndex(spark, str(tmp_path), 64)
    index.update(texts(spark, rows))
    files = index.postings(["abc", "bcd"]).select(F.input_file_name()).distinct().collect()
    held = [d for d in os.listdir(f"{tmp_path}/postings") if d.startswith("bucket=")]
    assert len(index.postings(["abc", "bcd"]).inputFiles()) >= len(files) and len({r[0].split("bucket=")[1].split("/")[0] for r in files}) <= 2 < len(held)
    assert "PartitionFilters: [bucket" in index.postings(["abc"])._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).replace("isnotnull(bucket", "bucket")


def grams_of(rows):
    return {(t.lower()[k : k + 3], i) for i, t in rows for k in range(len(t or "") - 2)}


def test_a_gram_has_a_row_for_each_slice_not_for_each_text(spark, tmp_path, rows):
    """what is shuffled, sorted and written are lists of texts."""
    index = search.TrigramIndex(spark, str(tmp_path), 4)
    index.update(texts(spark, rows))
    expected = grams_of(rows)
    names = sorted({g for g, _ in expected})
    assert spark.read.parquet(f"{tmp_path}/postings").count() <= 3 * len(names) < len(expected) / 2  # texts have three partitions
    assert sorted(tuple(r) for r in index.postings(names).select("gram", "doc_id").collect()) == sorted(expected)


@pytest.mark.parametrize("size", [7, 100, 10**6])
def test_slices_list_every_trigram(monkeypatch, rows, size):
    monkeypatch.setattr(search, "SLICE", size)
    rows = [(i, t.lower()) for i, t in rows if t is not None] + [(-3, "\ufeff\U0001f600\0a\U0010ffff"), (2**62, "the\nend")]
    batches = pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]}).to_batches(50)
    found = [(g, i) for b in search._lists(iter(batches)) for g, ids in zip(*(c.to_pylist() for c in b.columns)) for i in ids]
    assert set(found) == grams_of(rows) and (size < 10**6 or len(found) == len(set(found)))


def test_a_slice_of_very_many_letters_is_halved():
    letters = "".join(chr(c) for c in range(0x10000, 0x10000 + 150_000))
    parts = [(-1, letters)] + [(i, "abcd") for i in range(3000)]
    lists = [(g, ids) for b in search._listed(parts) for g, ids in zip(*(c.to_pylist() for c in b.columns))]
    found = {(g, i) for g, ids in lists for i in ids}
    assert found == {("abc", i) for i in range(3000)} | {("bcd", i) for i in range(3000)} | {(letters[k : k + 3], -1) for k in range(len(letters) - 2)}


@pytest.mark.parametrize("few", [0, 100_000])
def test_several_terms_and_updates_of_any_size(spark, tmp_path, monkeypatch, rows, few):
    monkeypatch.setattr(search, "FEW", few)
    index = search.TrigramIndex(spark, str(tmp_path), 8)
    for now in (rows[:100], rows[50:], rows):
        index.update(texts(spark, now))
        for terms in (["zzz", "a b", "abc", "CDE"], ["ab"]):
            expected = sorted({i for t in terms if len(t) > 2 for i in scanned(now, t)})
            assert sorted(r.doc_id for r in index.search(texts(spark, now), *terms).collect()) == expected


def test_few_candidates_are_checked_after_the_join(spark, tmp_path, rows):
    index = search.TrigramIndex(spark, str(tmp_path), 8)
    index.update(texts(spark, rows))
    plan = index.search(texts(spark, rows), "abc", "cde")._jdf.queryExecution().optimizedPlan().toString()
    assert [line.split()[1] for line in plan.splitlines() if "Contains(lower(text" in line] == ["Join"]


def test_long_terms(spark, tmp_path):
    long = "".join(np.random.default_rng(2).choice(list("abcdefghijklmnopqrstuvwxyz "), 3000))
    now = [(1, long), (2, long[:1500] + "-" + long[1500:]), (3, long[1:]), (4, long[1:] + long[:3]), (5, f"x{long.upper()}x"), (6, "zzzz")]
    index = search.TrigramIndex(spark, str(tmp_path), 4)
    index.update(texts(spark, now))
    assert sorted(r.doc_id for r in index.search(texts(spark, now), long, "zzzz").collect()) == [1, 5, 6]


def test_texts_that_share_an_id_and_tables_without_texts(spark, tmp_path):
    index = search.TrigramIndex(spark, str(tmp_path), 4)
    for now in ([], [(1, None), (2, "")], [(1, "xabcdx"), (1, "yabcdy"), (1, "none"), (2, "abcd")]):
        index.update(texts(spark, now))
        assert sorted(r.doc_id for r in index.search(texts(spark, now), "abcd").collect()) == ([1, 1, 2] if now[2:] else [])


def test_lists_of_an_update_that_failed_and_an_index_of_earlier_form(spark, tmp_path, rows):
    index = search.TrigramIndex(spark, str(tmp_path), 4)
    # an index with a row for each text and its versions, as it was written before
    spark.createDataFrame([("abc", i, b, u) for i in range(3) for b in range(4) for u in (1, 2)], "gram string, doc_id long, bucket int, update int").write.partitionBy("bucket", "update").parquet(f"{tmp_path}/postings")
    texts(spark, rows).select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest")).write.parquet(f"{tmp_path}/versions/update=2")
    found = lambda now, term: sorted(r.doc_id for r in index.search(texts(spark, now), term).collect())
    assert index.update(texts(spark, rows[:100])) == 100
    assert [found(rows[:100], t) for t in TERMS] == [scanned(rows[:100], t) for t in TERMS]
    # lists of an update without its versions, of texts that it would have changed
    spark.createDataFrame([(g, [3], b, 3) for g in ("zzz", "abc") for b in range(4)], "gram string, doc_ids array<long>, bucket int, update int").write.mode("append").partitionBy("bucket", "update").parquet(f"{tmp_path}/postings")
    assert [found(rows[:100], t) for t in TERMS] == [scanned(rows[:100], t) for t in TERMS]
    assert index.update(texts(spark, rows)) == 103
    assert index.update(texts(spark, rows[:3] + [(3, "zzz")] + rows[4:])) == 1
    assert found(rows[:3] + [(3, "zzz")] + rows[4:], "zzz") == [3]
