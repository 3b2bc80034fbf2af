"""Corpus cleaning in stages: each reads what the stage before kept and writes Parquet.

Stages: quality classifier (rejected documents go), exact deduplication (the largest
doc_id of equal texts stays), near-duplicates (SimHash candidates, completed by shared
shingles: sets of five-word shingles with a Jaccard similarity of 0.8 or more; the smallest doc_id of a component stays), benchmark decontamination
(documents with a hit window go), SentencePiece encoding with the decoded text's digest as
the result.

All stages but the last return the columns of documents. Defined results: empty tables
pass through empty; null texts are rejected by the first stage, as they have no words.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attest.llm import decontaminate, exact_dedup, quality, sentencepiece_bpe, shingle_join
from attest.llm.queries import table
from attest.session import scratch, ship_package


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    judged = quality.score(docs, table(spark, sf_dir, "labels"))
    return judged.where(F.col(quality.added_names(docs.columns)[-1])).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return shingle_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return sentencepiece_bpe.digest(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding", encode),
]

# A fitted classifier decides the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written below the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, "stage-" + name.split()[0])
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
