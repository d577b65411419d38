"""A training-corpus pipeline over ``documents``: each stage decides on whole texts.

1. quality     documents that the boosted trees score below the threshold go
2. near_dedup  texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more
               are linked, and one of each component stays: the smallest doc_id
3. decontam    documents that hold too much of a benchmark go
4. byte_bpe    what is left becomes token ids, which are decoded again

Each stage reads the Parquet that the one before it wrote and keeps all columns
of its rows, except the last, which returns token counts, ids and digests.
Nulls, repeated rows and empty tables are treated as the operators state:
null and empty texts are scored like any text, share one set of shingles, so that
one row with such a text stays, are never contaminated and have no tokens.  Of
rows with the same doc_id and text one stays.
"""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from assayer.llm import bpe, decontam, nearcopies, quality
from assayer.llm.common import table
from assayer.llm.queries import MULTI_RANKS
from assayer.session import shared_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The trees are fitted on the labelled documents of the stage's own input."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.representatives(docs)


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    vocab = bpe.vocabulary(spark, public_tokenizers.path(MULTI_RANKS))
    coded = bpe.round_trip(docs.select("doc_id", "text"), vocab, public_tokenizers.PATTERN)
    return bpe.digests(coded, keep_ids=True)


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("decontam", decontam_stage),
          ("byte_bpe", encode_stage)]

#: No SQL: trees, fingerprints and merges are beyond it; a test compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES:
        path = os.path.join(shared_dir(spark), f"pipeline-{name}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
