"""A Bloom filter over the keys of a small side, so that a join shuffles only those rows of the large side that may match.

The filter is a table first: each key's bits, added up by word of 64 bits in an aggregate. Its size follows from the
counted keys and the share of false hits allowed; up to MAX_BYTES its words come to the driver and are broadcast,
beyond that there is no filter. What passes must still be checked by the join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BYTES = 64 << 20


def shape(n: int, false_hits: float) -> tuple[int, int]:
    """Bits (a multiple of 64) and hash functions for n keys."""
    bits = max(64, -(-math.ceil(-max(1, n) * math.log(false_hits) / math.log(2) ** 2) // 64) * 64)
    return bits, max(1, round(bits / max(1, n) * math.log(2)) if n else 1)


@dataclass
class Bloom:
    bits: int
    hashes: int
    words: np.ndarray  # uint64

    def holds(self, h: np.ndarray) -> np.ndarray:
        """Whether each 64-bit hash may be among the keys; false is certain."""
        low, step = (h.astype(np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.int64), (h.astype(np.uint64) >> np.uint64(32)).astype(np.int64) | 1
        left = np.arange(len(h))
        for i in range(self.hashes):  # most fall out at the first
            at = (low[left] + i * step[left]) % self.bits
            left = left[(self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)]
        out = np.zeros(len(h), bool)
        out[left] = True
        return out


def build(keys: DataFrame, false_hits: float = 0.01) -> Bloom | None:
    """Over the one column of longs that keys has; None if the filter would be larger than MAX_BYTES. keys is read twice."""
    name = keys.columns[0]
    n = keys.count()
    bits, hashes = shape(n, false_hits)
    if bits // 8 > MAX_BYTES:
        return None
    low, step = F.col(name).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), F.shiftrightunsigned(name, 32).bitwiseOR(F.lit(1).cast("long"))
    places = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(hashes - 1).cast("long")), lambda i: (low + i * step) % bits)
    at = keys.select(F.explode(places).alias("at"))
    words = at.groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("held")).toArrow()
    found = np.zeros(bits // 64, np.int64)
    found[words["word"].to_numpy()] = words["held"].to_numpy()
    return Bloom(bits, hashes, found.view(np.uint64))


def may_hold(filter_: Bloom, key: Column, spark) -> Column:
    """A boolean column over a column of longs; false for null."""
    sent = spark.sparkContext.broadcast(filter_)

    @F.arrow_udf("boolean")
    def check(column: pa.Array) -> pa.Array:
        found = sent.value.holds(column.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64))
        return pa.array(found & column.is_valid().to_numpy(zero_copy_only=False))

    return check(key)
