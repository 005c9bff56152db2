"""A corpus pipeline over documents: quality filter, toxicity filter, one document of each near-duplicate group, packing.

Each stage takes (spark, docs, sf_dir) and gives a table that is written as Parquet and read again as the next one's docs. All but the
last keep the columns of documents, whatever else these are called.

Defined results of all stages: null and empty texts are judged by their (zero) statistics, are in no near-duplicate group and pack as their end token. Rows
without an id are judged and packed like others, and stay with the near duplicates. Rows that repeat an id are judged each, then one of them
stays. Without labels all documents pass the first two stages. An empty table gives empty ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.session import shared_folder
from newsloom.llm import jaccard, packing, quality, toxicity
from newsloom.llm.common import fold, once, table
from newsloom.llm.learning import ROW, SCORE
from newsloom.llm.queries import tokenizer

THRESHOLD = 0.3


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    scored = quality.scored(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return scored.filter(F.col(SCORE) >= THRESHOLD).select(f"{ROW}.*")


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject; without labels nothing is known to be toxic."""
    scored = toxicity.scored(docs, table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2, unknown=0.0)
    return scored.filter(F.col(SCORE) < THRESHOLD).select(f"{ROW}.*")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id, once if rows repeat it; documents without words stay."""
    groups = jaccard.near_duplicates(docs).filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("doc_id") != F.col("component_id")).alias("goes"), F.count("*").alias("rows"))
    return once(docs, groups.filter("goes or rows > 1"), "doc_id", "goes").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' tokens in sequences."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("quality", good), ("toxicity", civil), ("near_duplicates", distinct), ("packing", packed)]

#: The stages learn, search components and pack, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        place = f"{folder}/pipeline-{uuid.uuid4().hex}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
