import pytest

import corpus_pipeline
from newsloom.llm import queries
from newsloom.llm.common import once


@pytest.fixture
def labelled(labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_odd_rows_in_every_stage(spark, odd_documents, labelled):
    docs = odd_documents.withColumnRenamed("n", "_at")
    rows = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, labelled)
        assert kept.columns == docs.columns and kept.count() <= rows, name
    kept = [r.doc_id for r in corpus_pipeline.STAGES[2][1](spark, docs, labelled).collect()]
    assert sorted(kept, key=str) == sorted([1, 3, 4, 5, 6, 8, 10, None], key=str)  # 7 says what 6 says, 2 what 1 does, 9 hardly differs from 8
    packed = corpus_pipeline.STAGES[3][1](spark, docs, labelled)
    assert packed.filter("piece = 0").count() == rows


def test_repeated_ids_stay_once(spark, labelled):
    docs = spark.createDataFrame([(1, "a text of its own that nothing else is like at all"), (1, "a text of its own that nothing else is like at all"), (2, ""), (2, ""), (None, "x"), (None, "x")], "doc_id long, text string")
    assert sorted((r.doc_id or 0 for r in corpus_pipeline.distinct(spark, docs, labelled).collect())) == [0, 0, 1, 2]


def test_empty_table_and_no_labels(spark, no_documents, labels, odd_documents, tmp_path):
    labels.limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_documents, str(tmp_path)).count() == 0
    for _, stage in corpus_pipeline.STAGES[:2]:
        assert stage(spark, odd_documents, str(tmp_path)).count() == odd_documents.count()


def test_once_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(k, 10 * k, str(k)) for k in range(50)], "doc_id long, _at long, text string")
    got = once(docs, docs.selectExpr("doc_id", "true goes").filter("doc_id % 2 = 0"), "doc_id", "goes")
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [(k, 10 * k, str(k)) for k in range(1, 50, 2)]



def test_stages_keep_columns_and_pack_everything(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, count = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
        assert docs.count() <= count
        count = docs.count()
    assert docs.select("doc_id").distinct().count() == count
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == count


def test_every_operator_is_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))
