"""Length and token statistics with positional percentiles, exact at any size.

sorted[int(n q)] needs no sorted list: lengths are counted per value, and a running sum over the
distinct values, of which there are few, finds the first that passes int(n q).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as tx

QUANTILES = {"p25": 0.25, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def positional(df: DataFrame, value: str, *by: str, quantiles: dict[str, float] = QUANTILES, p99_from: int = 100) -> DataFrame:
    """Per group (or one row): n, total, avg, min, max, median and the percentiles of an integer column.

    p99 of fewer than p99_from values is the maximum.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("long").alias("v")).agg(F.count("*").alias("c"))
    ranked = _ranked(counts, *by)
    out = _places(quantiles, p99_from)
    return _with_avg(ranked.groupBy(*by).agg(*out) if by else ranked.agg(*out))


def _ranked(counts: DataFrame, *by: str) -> DataFrame:
    """counts (by, v, c) with n, all of a group's values, and upto, those no greater; rows with a null v do not count."""
    group = [F.col(c) for c in by] or [F.lit(1)]
    c = F.when(F.col("v").isNotNull(), F.col("c"))
    return counts.withColumn("upto", F.sum(c).over(W.partitionBy(*group).orderBy("v").rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.sum(c).over(W.partitionBy(*group)))


def _places(quantiles: dict[str, float], p99_from: int) -> list[Column]:
    """n, total, min, max, median and the percentiles, as aggregates over ranked counts."""

    def at(position: Column) -> Column:
        return F.min(F.when(F.col("upto") > position, F.col("v")))

    out = [F.max("n").alias("n"), F.sum(F.col("v") * F.col("c")).alias("total"), F.min("v").alias("min"), F.max("v").alias("max")]
    low, high = at(F.floor((F.col("n") - 1) / 2)), at(F.floor(F.col("n") / 2))
    out.append(((low + high) / 2.0).alias("median"))
    for name, q in quantiles.items():
        found = at(F.floor(F.col("n") * F.lit(q)))
        out.append((F.when(F.max("n") < p99_from, F.max("v")).otherwise(found) if q == 0.99 else found).alias(name))
    return out


def _with_avg(places: DataFrame) -> DataFrame:
    return places.withColumn("avg", F.col("total") / F.col("n"))


def quality(df: DataFrame, *by: str, text: str = "text") -> DataFrame:
    """Documents, characters, length distribution, blank texts and duplicates (white space folded).

    Texts are read and folded once: each gives its length and its key, counted in one aggregate, and what follows
    works on a row per length. Every group has its row, a null group and one of blank texts alone as well; a null text counts
    nowhere, and an empty table gives zeros. Columns of by may have any name that the result does not have.
    """
    own = {c: uuid.uuid4().hex for c in by}
    group = list(own.values())
    folded = df.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], F.length(text).cast("long").alias("len"), tx.fold_ws(F.col(text)).alias("folded"))
    rows = folded.select(*group, "len", (F.length("folded") == 0).alias("blank"), tx.dedup_key(F.col("folded"), "none").alias("key"))
    good = F.expr("not coalesce(blank, true)")
    length = F.struct(F.when(good, F.col("len")).alias("v"), F.lit(None).cast("string").alias("k"), F.coalesce("blank", F.lit(False)).alias("empty"))
    key = F.struct(F.lit(None).cast("long").alias("v"), F.when(good, F.col("key")).alias("k"), F.lit(False).alias("empty"))
    facts = rows.select(*group, F.explode(F.array(length, key)).alias("fact")).select(*group, "fact.*")
    counts = facts.groupBy(*group, "v", "k", "empty").agg(F.count("*").alias("c"))
    counts = counts.groupBy(*group, "v", "empty").agg(F.sum("c").alias("c"), F.sum(F.expr("if(k is null, 0L, c - 1)")).alias("again"))
    out = [*_places(QUANTILES, 100), F.sum(F.expr("if(empty, c, 0L)")).alias("empty_documents"), F.sum("again").alias("duplicates")]
    ranked = _ranked(counts, *group)
    found = _with_avg(ranked.groupBy(*group).agg(*out) if by else ranked.agg(*out)).fillna(0, ["n", "total", "empty_documents", "duplicates"])
    return found.select(*[F.col(n).alias(c) for c, n in own.items()], F.col("n").alias("documents"), F.col("total").alias("characters"), F.col("avg").alias("avg_length"), F.col("min").alias("min_length"), F.col("max").alias("max_length"), F.col("median").alias("median_length"), *[F.col(p).alias(f"{p}_length") for p in QUANTILES], "empty_documents", "duplicates", F.try_divide("duplicates", "n").alias("duplicate_rate"))


def tokens(df: DataFrame, count: str, *by: str) -> DataFrame:
    """documents, total_tokens, avg, min, max, median, p25, p75, p95 of a token count; null counts as 0."""
    found = positional(df.withColumn(count, F.coalesce(count, F.lit(0))), count, *by, quantiles={k: QUANTILES[k] for k in ("p25", "p75", "p95")})
    return found.select(*by, F.col("n").alias("documents"), F.col("total").alias("total_tokens"), "avg", "min", "max", "median", "p25", "p75", "p95")


def corpus_totals(df: DataFrame, text: str = "text") -> DataFrame:
    return df.agg(F.count("*").alias("records"), F.coalesce(F.sum(F.length(text)), F.lit(0)).cast("long").alias("characters"), F.avg(F.length(text)).alias("avg_length"), F.count_distinct(text).alias("unique_texts"))


def mean_of_batch_means(df: DataFrame, loss: str, batch: str, n_batches: int | None = None) -> DataFrame:
    """Each batch weighs the same, whatever its size."""
    rows = df if n_batches is None else df.filter(F.col(batch) < n_batches)
    return rows.groupBy(batch).agg(F.avg(loss).alias("m")).agg(F.coalesce(F.avg("m"), F.lit(0.0)).alias("mean_loss"))
