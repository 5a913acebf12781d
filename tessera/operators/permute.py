"""Keyed permutations of 0..n-1, worked out row by row: no list of n numbers, no sort, no shuffle.

A swap-or-not network: in each round x has a partner, (key - x) mod n, and the two change places or not by
a bit that depends on the larger of them. Each round is its own inverse, so any n is permuted exactly,
which a Feistel network does only for powers of its radix. Rounds use products below 2^63 alone, so that
any SQL engine gives the same numbers.

Defined results: a null index stays null; n below 2 leaves 0 where it is; indices outside 0..n-1 give an error.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.rowindex import with_row_index

ROUNDS = 80  # twice the bits of the most rows meant, 2^40
PRIME = (1 << 31) - 1


def round_keys(seed: int, epoch: int = 0) -> list[dict[str, int]]:
    """The constants of each round: key below 2^62, the others below PRIME."""
    out = []
    for i in range(ROUNDS):
        digest = hashlib.sha512(f"{seed}:{epoch}:{i}".encode()).digest()
        parts = [int.from_bytes(digest[k : k + 8], "big") for k in range(0, 48, 8)]
        out.append({"key": parts[0] >> 2} | {name: x % PRIME for name, x in zip("abcde", parts[1:], strict=True)})
    return out


def position(index: Column, n: int, seed: int, epoch: int = 0) -> Column:
    """Where the permutation of (n, seed, epoch) puts each index."""
    if n < 2:
        return index.cast("long")
    keys = F.from_json(F.lit(json.dumps(round_keys(seed, epoch))), "array<struct<key: long, a: long, b: long, c: long, d: long, e: long>>")

    def one(x: Column, k: Column) -> Column:
        partner = F.pmod(k["key"] % n - x, F.lit(n).cast("long"))
        larger = F.greatest(x, partner)
        t = (larger % PRIME * k["a"] + F.shiftright(larger, 31) * k["b"] + k["c"]) % PRIME
        u = (t * t + k["d"]) % PRIME
        bit = F.shiftright(u * k["e"] % PRIME, 15).bitwiseAND(F.lit(1).cast("long"))
        return F.when(bit == 1, partner).otherwise(x)

    inside = F.when(index.between(0, n - 1), index.cast("long")).otherwise(F.when(index.isNotNull(), F.raise_error(F.lit("index outside the permutation")).cast("long")))
    return F.aggregate(keys, inside, one)


def epochs(df: DataFrame, *order: str, n_epochs: int, seed: int = 42, name: str = "position") -> DataFrame:
    """Each row once for each epoch, with epoch and its place in that epoch's order. Rows are numbered once, in `order`."""
    index = _fresh(df, "index")
    n = df.count()
    rows = with_row_index(df, *order, name=index)
    places = F.array(*[F.struct(F.lit(e).alias("epoch"), position(F.col(index), n, seed, e).alias("at")) for e in range(n_epochs)])
    made = _fresh(df, "made")
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], F.explode(places).alias(made)).select(*[F.col(f"`{c}`") for c in df.columns], F.col(f"{made}.epoch").alias("epoch"), F.col(f"{made}.at").alias(name))


def _fresh(df: DataFrame, stem: str) -> str:
    """A name that df has no column of."""
    while stem in df.columns:
        stem += "_"
    return stem


def reader(rows: DataFrame, n: int, world_size: int, rank: int, drop_last: bool = True, name: str = "position") -> DataFrame:
    """What one of world_size readers sees of epochs(): places modulo world_size.

    n: rows in an epoch. drop_last: the epoch is cut to a multiple of world_size; otherwise it is filled up to one
    by its first rows, which come again at the places n, n + 1, ...
    """
    if not 0 <= rank < world_size:
        raise ValueError("rank must be within 0..world_size-1")
    at = F.col(name)
    if drop_last:
        return rows.filter((at < n - n % world_size) & (at % world_size == rank))
    more = -n % world_size
    if not n:
        return rows
    # a small n may have to be gone through several times
    again = F.transform(F.sequence(F.lit(0), F.lit((n + more - 1) // n)), lambda k: at + k * n)
    filled = rows.withColumn(name, F.explode(again))
    return filled.filter((at < n + more) & (at % world_size == rank))
