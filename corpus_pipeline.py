"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again
before the next one. All stages but the last return the columns of documents; the last returns
the packed pieces with their ids (little-endian unsigned 32-bit). An empty table passes through
every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, encoding, jaccard, packing, quality, tables, toxicity


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects."""
    return quality.keep_good(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity scorer rejects."""
    return toxicity.keep_clean(docs, tables.table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return jaccard.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    return decontaminate.clean(docs, tables.table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs token documents into sequences."""
    found = packing.pieces(docs, encoding.tokenizer_path("byte_bpe_50k.json"))
    return packing.pack(found).withColumnRenamed("payload", "ids").withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL expresses none of the learned stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, on documents."""
    docs = tables.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        last, docs = docs, tables.saved(stage(spark, docs, sf_dir), name)
        tables.done_with(last)
    return STAGES[-1][1](spark, docs, sf_dir)
