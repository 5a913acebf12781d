"""Scaled dot-product attention over a long sequence, block by block.

Rows are gathered in blocks of positions. A block of queries meets each block of keys that it may look at, and
each meeting gives, for every query, the greatest score, the sum of exponentials below it and the weighted
sum of values: parts that are merged in any order. No task holds more than two blocks, and no row of
scores is ever longer than a block. `since` is the cached path: only queries from that position on are
worked out, against all keys before them, as when new tokens follow a sequence whose keys are kept.

Positions are distinct and from 0. Defined results: a query without a key it may look at gives null; an empty
table gives no rows; vectors that are null, or whose lengths differ, give an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 512
_PART = "struct<top: double, sum: double, held: array<double>>"


def _matrix(column, name: str) -> np.ndarray:
    """Rows of a list of structs' field as a matrix."""
    return np.array(column.field(name).to_pylist(), np.float64)


def partial(q: np.ndarray, k: np.ndarray, v: np.ndarray, seen: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """top, sum, held of each query over one block of keys; seen: which keys a query may look at."""
    scores = np.where(seen, q @ k.T * scale, -np.inf)
    top = scores.max(axis=1)
    weights = np.exp(scores - np.where(np.isfinite(top), top, 0.0)[:, None])
    return top, weights.sum(axis=1), weights @ v


def merged(parts: str) -> str:
    """SQL for the output vector of a list of parts."""
    top = f"array_max(transform({parts}, p -> p.top))"
    begin = f"named_struct('s', 0D, 'h', transform({parts}[0].held, x -> 0D), 't', {top})"
    step = "named_struct('s', a.s + p.sum * exp(p.top - a.t), 'h', zip_with(a.h, p.held, (x, y) -> x + y * exp(p.top - a.t)), 't', a.t)"
    return f"aggregate({parts}, {begin}, (a, p) -> {step}, a -> transform(a.h, x -> x / a.s))"


def attend(rows: DataFrame, position: str, q: str, k: str, v: str, causal: bool = True, since: int = 0, scale: float | None = None, block: int = BLOCK) -> DataFrame:
    """position and out (array of doubles) for every row from position `since` on."""
    named = rows.select(F.col(position).cast("long").alias("at"), F.col(q).cast("array<double>").alias("q"), F.col(k).cast("array<double>").alias("k"), F.col(v).cast("array<double>").alias("v"))
    named = named.withColumn("block", F.expr(f"at div {block}"))
    keys = named.groupBy("block").agg(F.collect_list(F.struct("at", "k", "v")).alias("keys")).withColumnRenamed("block", "key_block")
    queries = named.filter(F.col("at") >= since).groupBy("block").agg(F.collect_list(F.struct("at", "q")).alias("queries"))
    if causal:
        reach = F.sequence(F.lit(0).cast("long"), F.col("block"))
    else:
        last = named.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0]
        reach = F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))
    # each block of queries goes to each block of keys it sees: the meetings are the work itself
    met = queries.withColumn("key_block", F.explode(reach)).join(keys, "key_block").select("queries", "keys")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                own, other = batch.column(0)[i].values, batch.column(1)[i].values
                at, of = own.field("at").to_numpy(), other.field("at").to_numpy()
                vectors = [_matrix(own, "q"), _matrix(other, "k"), _matrix(other, "v")]
                factor = scale if scale is not None else 1 / np.sqrt(vectors[0].shape[1])
                seen = of <= at[:, None] if causal else np.ones((len(at), len(of)), bool)
                top, total, held = partial(*vectors, seen, factor)
                there = np.isfinite(top)
                parts = pa.StructArray.from_arrays([pa.array(top[there]), pa.array(total[there]), pa.array(list(held[there]), pa.list_(pa.float64()))], names=["top", "sum", "held"])
                yield pa.RecordBatch.from_arrays([pa.array(at[there]), parts], names=["at", "part"])

    parts = met.mapInArrow(run, f"at long, part {_PART}").groupBy("at").agg(F.collect_list("part").alias("parts"))
    out = parts.select("at", F.expr(merged("parts")).alias("out"))
    return named.filter(F.col("at") >= since).select("at").join(out, "at", "left").select(F.col("at").alias(position), "out")
