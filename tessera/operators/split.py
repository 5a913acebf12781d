"""Train, validation and test splits: the seeded one of a list, and one by hash for any size."""

from __future__ import annotations

import mmap
import random
import tempfile
import uuid
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import permute
from tessera.operators.rowindex import with_row_index
from tessera.sources.shared import materialise, shared_folder

#: Rows of the seeded permutation that are handed to Spark at a time.
BLOCK_ROWS = 1 << 20


def sizes(n: int, validation_ratio: float, test_ratio: float) -> tuple[int, int, int]:
    """Train, validation and test sizes; at least one row goes to each of the latter two."""
    if not 0 < validation_ratio < 1:
        raise ValueError("validation_ratio must be within (0, 1)")
    if not 0 <= test_ratio < 1:
        raise ValueError("test_ratio must be within [0, 1)")
    if validation_ratio + test_ratio >= 1:
        raise ValueError("validation_ratio + test_ratio must be below 1")
    val, test = max(1, int(n * validation_ratio)), max(1, int(n * test_ratio))
    if n - val - test <= 0:
        raise ValueError(f"no training rows are left of {n}")
    return n - val - test, val, test


def _named(df: DataFrame, rank: str, n: int, validation_ratio: float, test_ratio: float) -> DataFrame:
    train, val, _ = sizes(n, validation_ratio, test_ratio)
    return df.withColumn("split", F.when(F.col(rank) < train, "train").when(F.col(rank) < train + val, "val").otherwise("test"))


def _permutation(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """_index, split_rank: random.Random(seed).shuffle of range(n), shuffled in a file and written in blocks."""
    path, schema = shared_folder(spark), "_index long, split_rank long"
    with tempfile.TemporaryFile() as file:
        for at in range(0, n, BLOCK_ROWS):
            file.write(array("q", range(at, min(n, at + BLOCK_ROWS))).tobytes())
        file.flush()
        with mmap.mmap(file.fileno(), 8 * n) as mapped, memoryview(mapped) as held, held.cast("q") as places:
            random.Random(seed).shuffle(places)
            for at in range(0, n, BLOCK_ROWS):
                end = min(n, at + BLOCK_ROWS)
                block = pa.table({"_index": pa.array(array("q", places[at:end]), pa.int64()), "split_rank": pa.array(range(at, end), pa.int64())})
                spark.createDataFrame(block, schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def seeded(df: DataFrame, *order: str, validation_ratio: float = 0.1, test_ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """df with split and split_rank, as shuffling the ordered list with random.Random(seed) deals it, at any size.

    The permutation depends on n and the seed alone. It is sequential, so the driver makes it, in a mapped
    file of 8 bytes a row; Spark gets it in blocks, as a table that is joined.
    """
    index = uuid.uuid4().hex  # a name that no column of df has
    indexed = materialise(with_row_index(df, *order, name=index))
    n = indexed.count()
    sizes(n, validation_ratio, test_ratio)
    places = _permutation(df.sparkSession, n, seed).withColumnRenamed("_index", index)
    return _named(indexed.join(places, index).drop(index), "split_rank", n, validation_ratio, test_ratio)


def keyed(df: DataFrame, *order: str, validation_ratio: float = 0.1, test_ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """df with split and split_rank, a keyed permutation of the ordered rows: exact sizes, nothing through the driver."""
    index = uuid.uuid4().hex
    n = df.count()
    sizes(n, validation_ratio, test_ratio)
    ranked = with_row_index(df, *order, name=index).withColumn("split_rank", permute.position(F.col(index), n, seed)).drop(index)
    return _named(ranked, "split_rank", n, validation_ratio, test_ratio)


def by_hash(df: DataFrame, key: str, validation_ratio: float = 0.1, test_ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """df with split and split_rank: rows ranked by SHA-256 of seed and key; exact sizes, no driver list."""
    hashed_ = uuid.uuid4().hex  # a name that no column of df has
    hashed = df.withColumn(hashed_, F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256))
    ranked = with_row_index(hashed, hashed_, key, name="split_rank").drop(hashed_)
    return _named(ranked, "split_rank", df.count(), validation_ratio, test_ratio)


def sampler(df: DataFrame, index: str, n: int, world_size: int, rank: int, drop_last: bool = True) -> DataFrame:
    """The rows of one of world_size readers: index modulo world_size, cut to equal numbers if drop_last."""
    kept = df.filter(F.col(index) < n - n % world_size) if drop_last else df
    return kept.filter(F.col(index) % world_size == rank)


def batches(df: DataFrame, index: str, n: int, batch_size: int, drop_last: bool = True) -> DataFrame:
    kept = df.filter(F.col(index) < n - n % batch_size) if drop_last else df
    return kept.withColumn("batch", F.floor(F.col(index) / batch_size))


def oversample(df: DataFrame, times: int, key: str, seed: int = 42) -> DataFrame:
    """Each row times over, in an order of its own for each epoch."""
    epochs = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return epochs.withColumn("epoch_order", F.sha2(F.concat_ws(":", F.lit(seed), "epoch", F.col(key).cast("string")), 256))
