"""Operator 12: hard negatives by blocked matrix products.

Anchors come in blocks of bounded bytes. A block is broadcast and multiplied, tile by tile in float64,
with every row of the table; each task keeps the best five rows of the same label for each anchor, and
the tasks' fives are merged by anchor. A second pass over the table does the same for the best ten rows
of other labels within each positive's window of scores. A tile holds few columns at first, and more as
the scores kept so far rule more out, so what a task holds depends on the block and the tile alone.

Products are exact: components are whole numbers, and where a tile's sums could reach 2^53 they are made
of Python's integers instead. The query set (anchors) times all rows is the work asked for; nothing but
best rows is shuffled.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no
part; an anchor is compared with vectors of its own length; rows that repeat a vec_id are rows of their
own and no positives of each other, and of a repeated anchor each row has its own positives; scores
beyond 64 bits count as the largest or least long; an anchor without positives, or a positive without
negatives in its window, gives no rows; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm._io import arrow_limits, materialise, shared_folder

N_POSITIVES, N_NEGATIVES = 5, 10
#: A negative's score lies between these tenths of the positive's.
LOW_TENTHS, HIGH_TENTHS = 3, 9
#: Bytes of the vectors of a block of anchors, about the most that is broadcast at a time.
BLOCK_BYTES = 16 << 20
#: Scores in a tile, and its columns at first and at most.
TILE, FIRST_COLUMNS, MOST_COLUMNS = 1 << 21, 64, 2048
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T for matrices of whole numbers in float64, as exact longs."""
    most = max(1.0, np.abs(a).max(initial=0)) * max(1.0, np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a) @ whole(b).T, _LEAST, _MOST).astype(np.int64)


def window(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest score in a positive's window, without overflow."""
    tens, ones = positive // 10, positive % 10
    return LOW_TENTHS * tens - (-LOW_TENTHS * ones) // 10, HIGH_TENTHS * tens + HIGH_TENTHS * ones // 10


class Best:
    """The k best (score, id) of each slot; ties go to the smaller id. low: what a score must reach to count."""

    def __init__(self, k: int, low: np.ndarray):
        n = len(low)
        self.k, self.low, self.n = k, low.copy(), np.zeros(n, np.int64)
        self.score, self.id = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(slot)
        own, place = np.nonzero(np.arange(self.k) < self.n[touched, None])
        own = touched[own]
        slot, score, ids = np.append(slot, own), np.append(score, self.score[own, place]), np.append(ids, self.id[own, place])
        order = np.lexsort((ids, ~score, slot))  # ~ turns the order of longs round
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        place = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        keep = place < self.k
        slot, score, ids, place = slot[keep], score[keep], ids[keep], place[keep]
        self.score[slot, place], self.id[slot, place] = score, ids
        np.maximum.at(self.n, slot, place + 1)
        full = place == self.k - 1
        self.low[slot[full]] = np.maximum(self.low[slot[full]], score[full])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, place = np.nonzero(np.arange(self.k) < self.n[:, None])
        return slot, self.score[slot, place], self.id[slot, place]


@dataclass
class Block:
    """Anchors of one length of vector, and the scores of their positives (no window where there is none)."""

    uid: np.ndarray
    vec_id: np.ndarray
    label: np.ndarray
    vectors: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def _vectors(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length of vector: places of the rows that have it, and their vectors as whole numbers."""
    lengths = np.asarray(column.value_lengths()).astype(np.int64)
    flat = np.asarray(column.flatten()).astype(np.float64)
    ends = np.cumsum(lengths)
    out = {}
    with np.errstate(over="ignore"):
        whole = np.nan_to_num(np.floor(256 * flat))
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        out[n] = rows, whole[(ends[rows] - n)[:, None] + np.arange(n)]
    return out


def _tiles(n_rows: int, n_columns: int, seen: int):
    """Ranges of rows and columns; more columns at a time the more have been seen."""
    at = 0
    while at < n_columns:
        columns = min(max(FIRST_COLUMNS, seen + at), MOST_COLUMNS, n_columns - at)
        step = max(1, TILE // columns)
        for row in range(0, n_rows, step):
            yield slice(row, min(n_rows, row + step)), slice(at, at + columns)
        at += columns


def _same_label(own: Block, best: Best, ids, labels, vectors, seen: int) -> None:
    for label in np.intersect1d(own.label, labels):
        rows, columns = np.flatnonzero(own.label == label), np.flatnonzero(labels == label)
        for r, c in _tiles(len(rows), len(columns), seen):
            slots, here = rows[r], columns[c]
            scores = products(own.vectors[slots], vectors[here])
            a, b = np.nonzero((scores >= best.low[slots, None]) & (own.vec_id[slots, None] != ids[here]))
            if len(a):
                best.add(slots[a], scores[a, b], ids[here[b]])


def _other_label(own: Block, best: Best, ids, labels, vectors, seen: int) -> None:
    width = own.low.shape[1]
    for r, c in _tiles(len(own.uid), len(ids), seen):
        scores = products(own.vectors[r], vectors[c])
        other = own.label[r, None] != labels[c]
        for k in range(width):
            low = best.low.reshape(-1, width)[r, k]
            a, b = np.nonzero(other & (scores >= low[:, None]) & (scores <= own.high[r, k][:, None]))
            if len(a):
                best.add((r.start + a) * width + k, scores[a, b], ids[c][b])


def _scan(rows: DataFrame, blocks: dict[int, Block], negatives: bool) -> DataFrame:
    """uid, slot, score, vec_id: the best of every partition of rows. blocks are broadcast."""
    sent = rows.sparkSession.sparkContext.broadcast(blocks)
    k = N_NEGATIVES if negatives else N_POSITIVES

    def run(batches):
        held = {n: Best(k, own.low.ravel() if negatives else np.full(len(own.uid), _LEAST)) for n, own in sent.value.items()}
        seen = dict.fromkeys(held, 0)
        for batch in batches:
            ids, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for n, (places, vectors) in _vectors(batch.column(2)).items():
                if n in held:
                    (_other_label if negatives else _same_label)(sent.value[n], held[n], ids[places], labels[places], vectors, seen[n])
                    seen[n] += len(places)
        for n, best in held.items():
            slot, score, found = best.rows()
            width = sent.value[n].low.shape[1] if negatives else 1
            columns = (sent.value[n].uid[slot // width], slot % width, score, found)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["uid", "slot", "score", "vec_id"])

    return rows.mapInArrow(run, "uid long, slot long, score long, vec_id long")


def _top(found: DataFrame, k: int) -> DataFrame:
    """found with rank, from 1 to k in each slot."""
    order = W.partitionBy("uid", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def taking_part(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, embedding of the rows that take part, with the labels of the contract."""
    fit = "vec_id is not null and label is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('Infinity'))"
    label = F.expr("case when vec_id % 7 = 0 then (label + 1L) % 10 else label end").cast("long")
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").filter(fit).withColumn("label", label)


def mine(rows: DataFrame, anchors: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """RESULT's columns for every anchor; rows and anchors: vec_id, label, embedding without nulls.

    A block's anchors come to the driver to be broadcast, some block_bytes at a time, and so do the scores of its positives.
    """
    spark = rows.sparkSession
    arrow_limits(spark)
    path = shared_folder(spark)
    spark.createDataFrame([], RESULT).write.parquet(path)
    anchors = materialise(anchors.withColumn("uid", F.monotonically_increasing_id()))
    size = anchors.agg(F.coalesce(F.sum(F.size("embedding") * 8 + 64), F.lit(0))).first()[0]
    n_blocks = -(-size // block_bytes)
    anchors = materialise(anchors.withColumn("block", F.expr(f"cast(pmod(xxhash64(uid), {max(1, n_blocks)}L) as int)")), "block")
    for k in range(n_blocks):
        table = anchors.filter(F.col("block") == k).select("uid", "vec_id", "label", "embedding").toArrow().combine_chunks()
        if not table.num_rows:
            continue
        uid, vec_id, label = (table.column(i).to_numpy() for i in range(3))
        blocks = {n: Block(uid[at], vec_id[at], label[at], vectors) for n, (at, vectors) in _vectors(table.column(3).combine_chunks()).items()}
        positives = materialise(_top(_scan(rows, blocks, negatives=False), N_POSITIVES).select("uid", (F.col("rank") - 1).cast("long").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
        known = positives.select("uid", "slot", "positive_score").toArrow()
        of, slot, score = (known.column(i).to_numpy() for i in range(3))
        for own in blocks.values():
            own.low, own.high = (np.full((len(own.uid), N_POSITIVES), x) for x in (_MOST, _LEAST))
            order = np.argsort(own.uid)
            at = order[np.searchsorted(own.uid, of, sorter=order).clip(max=len(order) - 1)]
            mine_ = own.uid[at] == of
            own.low[at[mine_], slot[mine_]], own.high[at[mine_], slot[mine_]] = window(score[mine_])
        found = _top(_scan(rows, blocks, negatives=True), N_NEGATIVES).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
        named = found.join(positives, ["uid", "slot"]).join(anchors.filter(F.col("block") == k).select("uid", F.col("vec_id").alias("anchor_id")), "uid")
        named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.mode("append").parquet(path)
    return spark.read.schema(RESULT).parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = taking_part(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return mine(rows, rows.filter("vec_id % 100 = 0"))


def oracle() -> str:
    return """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10"""
