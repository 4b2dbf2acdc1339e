"""The training-text pipeline over ``documents``, one operator a stage.

1. quality: documents that the classifier rejects go;
2. lines: lines found in several documents stay only in the first;
3. near_duplicates: one document of each near-duplicate class stays;
4. substrings: byte strings that an earlier document has are cut out;
5. packing: what is left is tokenised and packed into sequences.

Every stage works on all that the one before kept; all but the last return the
columns of ``documents``. Documents are not dropped in stages 2 and 4 themselves,
even if their text becomes empty; but texts that are empty after stage 2 are equal
texts to stage 3, which keeps one row of them (no text is lost by that).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from patronage.llm import line_dedup, near_dup, packing, quality_model, suffix_dedup
from patronage.llm.common import shared_folder, table
from patronage.llm.registry import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_model.keep_quality(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.drop_near_duplicates(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.drop_repeated_substrings(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("packing", pack),
]

#: No SQL for a learnt classifier, sketches and packing; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
