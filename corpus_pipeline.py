"""The corpus pipeline: filters, deduplicates and packs the documents of a folder of tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import jaccard_join, kneser_ney, line_dedup, packing, quality_rules
from tessera.llm._io import shared_folder

STAGES = [
    ("quality classifier", kneser_ney.stage),
    ("quality rules", quality_rules.stage),
    ("line dedup", line_dedup.stage),
    ("n-gram Jaccard join", jaccard_join.stage),
    ("packing", packing.stage),
]

#: Perplexity models, learned cutoffs and SimHash have no form in SQL; tests hold line dedup, join and packing against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = shared_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
