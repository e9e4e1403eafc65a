"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Rejected documents go, duplicate lines go, one document of each group of near copies stays,
documents that hold benchmark passages go, and what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bin_packing, fuzzy_lines, jaccard_join, qgram_decontam, rff_classifier
from lodestone.session import materialize, prepare, table


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with the sequence and offset that each goes to."""
    return bin_packing.pack_documents(docs)


def _prepared(function):
    return lambda spark, docs, sf_dir: function(prepare(spark), docs, sf_dir)


STAGES = [
    ("quality classifier", _prepared(rff_classifier.stage)),
    ("line dedup", _prepared(fuzzy_lines.stage)),
    ("n-gram Jaccard join", _prepared(jaccard_join.stage)),
    ("benchmark decontamination", _prepared(qgram_decontam.stage)),
    ("best-fit packing", _prepared(packing)),
]

#: Kernel scores, MinHash candidates and tokens are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
