"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run once to warm up and then three times; the median counts. Results are written to a
sink that takes every row, so that nothing is pruned away.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tessera.functions import text as tx  # noqa: E402
from tessera.operators import bpe, dedup  # noqa: E402
from tessera.plans.queries import QUERIES  # noqa: E402


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


HEADLINE = {
    "sum_of_lengths": lambda s, d: documents(s, d).agg(F.sum(F.length("text"))),
    "dedup_raw_hash": lambda s, d: dedup.first_ids(documents(s, d), "doc_id", normalization="none"),
    "dedup_whitespace_groupby": lambda s, d: dedup.first_ids(documents(s, d), "doc_id"),
    "dedup_whitespace_rows": lambda s, d: dedup.first_wins(documents(s, d), "doc_id"),
    "byte_token_count": lambda s, d: documents(s, d).agg(F.sum(tx.byte_token_count(F.col("text")))),
    "distinct_words": lambda s, d: bpe.word_counts(documents(s, d)).agg(F.count("*")),
    "repetition_filter": lambda s, d: documents(s, d).filter(tx.is_repetitive(F.col("text"))).agg(F.count("*")),
    **{name: QUERIES[name] for name in ("validate_report", "clean_documents", "quality_report", "token_stats", "pack_chunks", "split_hash", "sentences", "chat_prompt", "rise_streak", "early_stop")},
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.files.maxPartitionBytes", "4m")  # small tables, so that every core has a part
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name, query in HEADLINE.items():
        times = []
        for _ in range(4):
            began = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(median(times[1:]), 3)
    spark.stop()
    print(json.dumps({"metric": "sum of median query times", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
