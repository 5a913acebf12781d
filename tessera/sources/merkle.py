"""A tree of digests over the files of a dataset: two trees name the files that differ by what they hold.

A leaf is a file's name, size and SHA-256, made where the file is read; a node is the SHA-256 of its two
children. Comparing two trees goes down only where nodes differ, and reads no file.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession


def leaf(name: str, size: int, digest: str) -> str:
    return hashlib.sha256(f"leaf\0{name}\0{size}\0{digest}".encode()).hexdigest()


def tree(leaves: list[str]) -> list[list[str]]:
    """Levels from the leaves to the root; of an odd level the last goes up as it is. No leaves: one empty root."""
    levels = [leaves or [hashlib.sha256(b"empty").hexdigest()]]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([hashlib.sha256(f"node\0{low[i]}\0{low[i + 1]}".encode()).hexdigest() if i + 1 < len(low) else low[i] for i in range(0, len(low), 2)])
    return levels


def root(leaves: list[str], *more: str) -> str:
    """The root, with the digests of what else the dataset depends on (a tokenizer's contents) above it."""
    top = tree(leaves)[-1][0]
    return hashlib.sha256("\0".join(["root", top, *more]).encode()).hexdigest() if more else top


def differing(a: list[list[str]], b: list[list[str]]) -> list[int]:
    """Places of the leaves that differ between two trees of one size, found from the root down."""
    if len(a[0]) != len(b[0]):
        raise ValueError("the trees do not have the same number of leaves")
    places = [0] if a[-1] != b[-1] else []
    for low_a, low_b in zip(a[-2::-1], b[-2::-1]):
        below = [c for p in places for c in (2 * p, 2 * p + 1) if c < len(low_a)]
        places = [c for c in below if low_a[c] != low_b[c]]
    return places


def digests(spark: SparkSession, paths: list[str], block: int = 1 << 20) -> DataFrame:
    """path, size and sha256 of each file, read in the executors a block at a time; null where a file is missing."""
    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 4 * spark.sparkContext.defaultParallelism)))

    def run(batches):
        import os

        import pyarrow as pa

        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                digest, size = hashlib.sha256(), 0
                if os.path.isfile(path):
                    with open(path, "rb") as file:
                        while part := file.read(block):
                            digest.update(part)
                            size += len(part)
                    out.append((path, size, digest.hexdigest()))
                else:
                    out.append((path, None, None))
            names, sizes, found = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(found, pa.string())], names=["path", "size", "sha256"])

    return rows.mapInArrow(run, "path string, size long, sha256 string")
