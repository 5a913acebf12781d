"""Global row numbers and running sums without a window over one partition."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.sources.shared import materialise

_SEQ = (1 << 33) - 1


def with_row_index(df: DataFrame, *order: str, name: str = "row_index", running: dict[str, str] | None = None, made: dict[str, Column] | None = None) -> DataFrame:
    """df with its rank (from 0) in `order`, and for each name in running the sum of that column before the row.

    Rows are range-partitioned and sorted; a row's place in its partition is known, and what lies before
    the partition is a table with a row per partition, which alone comes to the driver. made: columns worked out
    once rows are sorted, and once only (finding the ranges reads df twice); running may name them.
    """
    running = running or {}
    id_, part, rows_ = (uuid.uuid4().hex for _ in range(3))  # names that no column of df has
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumns(made or {})
    placed = materialise(ranged.withColumn(id_, F.monotonically_increasing_id())).withColumn(part, F.shiftright(id_, 33))
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(k) for k, c in running.items()]
    before = {k: 0 for k in (rows_, *running)}
    rows = []
    for row in placed.groupBy(part).agg(F.count("*").alias(rows_), *sums).orderBy(part).collect():
        rows.append((row[part], *before.values()))
        before = {k: before[k] + row[k] for k in before}
    offsets = spark.createDataFrame(rows, f"`{part}` long, `{rows_}` long" + "".join(f", `{part}_{k}` long" for k in running))
    joined = placed.join(F.broadcast(offsets), part)  # a row per partition
    within = W.partitionBy(part).orderBy(id_).rowsBetween(W.unboundedPreceding, -1)
    sums = [(F.col(f"{part}_{k}") + F.coalesce(F.sum(c).over(within), F.lit(0))).cast("long").alias(k) for k, c in running.items()]
    return joined.select(*ranged.columns, (F.col(rows_) + F.col(id_).bitwiseAND(F.lit(_SEQ))).alias(name), *sums)
