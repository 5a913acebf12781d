"""Shards of token ids: numbered JSON lines files, and reading them back as examples."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.batches import bounded
from tessera.operators import pack
from tessera.operators.rowindex import with_row_index
from tessera.sources import shard_source


def assign(df: DataFrame, *order: str, shard_size: int = 10_000) -> DataFrame:
    """df with shard and its row's place in it."""
    index = uuid.uuid4().hex  # a name that no column of df has
    rows = with_row_index(df, *order, name=index)
    return rows.withColumn("shard", F.expr(f"`{index}` div {shard_size}")).withColumn("place", (F.col(index) % shard_size).cast("long")).drop(index)


def stats(sharded: DataFrame, ids: str = "input_ids") -> DataFrame:
    return sharded.groupBy("shard").agg(F.count("*").alias("n_records"), F.sum(F.size(ids)).cast("long").alias("n_tokens"))


def write(sharded: DataFrame, folder: str, prefix: str = "shard", mode: str = "overwrite") -> list[str]:
    """Each shard as folder/prefix-00000.jsonl by way of the data source; a task holds one row at a time. Names, in order.

    folder must be one that executors and driver share. Files appear under their names once the whole job is done,
    with a listing of their contents. mode "append" keeps the shards there are.
    """
    spark = sharded.sparkSession
    shard_source.register(spark)
    bounded(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = sharded.select("shard", "place", "input_ids", "text_preview").repartition(partitions, "shard").sortWithinPartitions("shard", "place")
    before = set() if mode == "overwrite" else {x["name"] for x in shard_source.listing(folder)}
    rows.write.format("shards").option("prefix", prefix).mode(mode).save(folder)
    return sorted(x["name"] for x in shard_source.listing(folder) if x["name"] not in before)


def read(spark: SparkSession, folder: str, names: list[str] | None = None) -> DataFrame:
    """Rows of the shards that the listing, the manifest or shard-*.jsonl names, or of those in names; missing ones are passed over."""
    shard_source.register(spark)
    rows = spark.read.format("shards").load(folder)
    return rows if names is None else rows.filter(F.col("shard").isin(names))


def examples(shards: DataFrame, context_length: int = 256, pad_id: int = pack.EOS) -> DataFrame:
    """A record each, cut or padded to context_length + 1, as input_ids and target_ids."""
    ids = F.coalesce("input_ids", F.array().cast("array<int>"))
    return shards.select(pack.shifted(pack.pad(ids, context_length, pad_id)).alias("e")).select("e.*")
