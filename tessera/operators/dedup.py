"""Exact deduplication, overlap between datasets, and what is left without leakage."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import bloom
from tessera.sources.shared import materialise


@dataclass
class DedupReport:
    records_in: int
    records_out: int
    duplicates_removed: int
    unique_hashes: int
    normalization: str

    def summary(self) -> str:
        return f"DATA DEDUPLICATION ({self.normalization})\nRecords in:         {self.records_in:,}\nRecords out:        {self.records_out:,}\nDuplicates removed: {self.duplicates_removed:,}\nUnique hashes:      {self.unique_hashes:,}"


def with_key(df: DataFrame, text: str = "text", normalization: str = "whitespace", name: str = "key") -> DataFrame:
    return df.withColumn(name, tx.dedup_key(F.col(text), normalization))


def first_wins(df: DataFrame, *order: str, text: str = "text", normalization: str = "whitespace") -> DataFrame:
    """The first row in `order` of each text; Catalyst limits each key to one row before the shuffle as well."""
    key, rank = uuid.uuid4().hex, uuid.uuid4().hex  # names that no column of df has
    window = W.partitionBy(key).orderBy(*order)
    ranked = with_key(df, text, normalization, key).withColumn(rank, F.row_number().over(window))
    return ranked.filter(F.col(rank) == 1).drop(key, rank)


def first_ids(df: DataFrame, order: str, text: str = "text", normalization: str = "whitespace") -> DataFrame:
    """The order key of each text's first row."""
    return df.select(F.col(order), tx.dedup_key(F.col(text), normalization).alias("_key")).groupBy("_key").agg(F.min(order).alias(order)).select(order)


def report(df: DataFrame, text: str = "text", normalization: str = "whitespace") -> DataFrame:
    """One row: records_in, records_out, duplicates_removed, unique_hashes."""
    per = df.select(tx.dedup_key(F.col(text), normalization).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    n, unique = F.coalesce(F.sum("n"), F.lit(0)).cast("long"), F.count("*")
    return per.agg(n.alias("records_in"), unique.alias("records_out"), (n - unique).alias("duplicates_removed"), unique.alias("unique_hashes"))


def read_report(df: DataFrame, text: str = "text", normalization: str = "whitespace") -> DedupReport:
    return DedupReport(**report(df, text, normalization).first().asDict(), normalization=normalization)


def _sides(a: DataFrame, b: DataFrame, text: str, normalization: str, false_hits: float | None) -> tuple[DataFrame, DataFrame, str, Column | None]:
    """Keys of a, b with its key, the key's name, and, if asked for, whether a may hold a row's key."""
    key = uuid.uuid4().hex
    keys = with_key(a, text, normalization, key).select(key).distinct()
    keyed = with_key(b, text, normalization, key)
    if false_hits is None:
        return keys, keyed, key, None
    keys = materialise(keys.filter(F.col(key).isNotNull()))
    made = bloom.build(keys.select(F.xxhash64(key).alias("h")), false_hits)
    return keys, keyed, key, None if made is None else bloom.may_hold(made, F.when(F.col(key).isNotNull(), F.xxhash64(key)), a.sparkSession)


def overlap(a: DataFrame, b: DataFrame, text: str = "text", normalization: str = "whitespace", false_hits: float | None = None) -> DataFrame:
    """The rows of b, repeats included, whose text a holds too.

    false_hits: for an a much smaller than b. A Bloom filter over a's keys, with this share of false hits, goes before the
    join, so that of b only what passes is shuffled.
    """
    keys, keyed, key, may = _sides(a, b, text, normalization, false_hits)
    rows = keyed if may is None else keyed.filter(may)
    return rows.join(keys, key, "left_semi").select(*[F.col(f"`{c}`") for c in b.columns])


def without(a: DataFrame, b: DataFrame, text: str = "text", normalization: str = "whitespace", false_hits: float | None = None) -> DataFrame:
    """The rows of b whose text a does not hold; false_hits as in overlap(): rows that do not pass stay where they are."""
    keys, keyed, key, may = _sides(a, b, text, normalization, false_hits)
    own = [F.col(f"`{c}`") for c in b.columns]
    if may is None:
        return keyed.join(keys, key, "left_anti").select(*own)
    return keyed.filter(~may).select(*own).unionByName(keyed.filter(may).join(keys, key, "left_anti").select(*own))


def near_duplicate_clusters(df: DataFrame, threshold: float = 0.8, num_perm: int = 128) -> DataFrame:
    """Kept as an interface only."""
    raise NotImplementedError("near-duplicate clusters are not part of exact deduplication")
