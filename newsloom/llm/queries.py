"""The operators applied to the tables, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, codes, ctw, flac, html, jaccard, orchard, packing, quality, tokencounts, toxicity, urls
from .common import fold, table


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file: in the installed package, or in the folder that TOKENIZERS names."""
    if folder := os.environ.get("TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold("doc_id", 4) == 2
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out, held_out)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold("doc_id", 5) == 0
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out, held_out)


def op3_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold("doc_id", 7) == 2
    return ctw.scores(table(spark, sf_dir, "documents"), ~held_out, held_out)


def op4_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.digests(table(spark, sf_dir, "documents"))


def op5_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orchard.cluster(table(spark, sf_dir, "embeddings"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_quality, op3_context_tree_weighting, op4_flac_media, op5_bpe_encoding, op6_best_fit_packing, op7_html_extraction, op8_nearest_neighbours, op9_url_filters, op10_ngram_jaccard_join,
        op11_centroid_clustering, op12_token_counts, op13_vector_codes,
    )
}

ORACLE_SQL: dict[str, str] = {"op9_url_filters": urls.oracle_sql(), "op11_centroid_clustering": orchard.oracle_sql(), "op13_vector_codes": codes.oracle_sql()}
