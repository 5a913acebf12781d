"""Operator 13: best-fit packing, sequences filled exactly first.

Documents are tokenized, ended with an end id, and cut only if longer than a sequence. A piece is worth
its length and nothing else, so the plan is made on the number of pieces of each length: at most
`capacity` numbers, whatever the table's size. Going from the longest length down, the gap that it
leaves is looked up among the sums of one, two and three lengths still to be had; what fills it exactly
is taken as many times as the counts allow. Lengths whose gap nothing fills are packed by best fit
decreasing. The plan is a list of patterns (the lengths of a sequence, and how many such sequences).

Spark does the rest: every piece gets its rank among the pieces of its length (its place in its
partition, plus the counts of the partitions before, by a window over counts), and the segment of a
pattern that holds this rank says where it goes. No group of pieces is ever gathered in one task.

Defined results: a null or empty text is the end id alone; rows that repeat a doc_id, or have none, are
packed each for itself; an empty table gives no pieces; extra columns are ignored. Which of several pieces of
one length goes where is not defined. sequence_id counts from 0 without gaps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm import packing
from tessera.llm._io import materialise

CAPACITY = 4096
#: Segments of patterns that are broadcast, of 48 bytes each; a plan has a few for each length.
BROADCAST_SEGMENTS = 1 << 20

Pattern = list[tuple[int, int]]  # (length, copies) in the order in which they stand in a sequence


class Sums:
    """Which sums of one, two or three lengths can be had of the counts; counts only ever fall.

    A sum once found to have no pair stays without, so that it is looked up once.
    """

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.no_pair = np.zeros(len(counts), bool)

    def single(self, total: int) -> Pattern | None:
        return [(total, 1)] if 0 < total < len(self.counts) and self.counts[total] else None

    def _halves(self, total: int) -> int:
        """The larger length of a pair that makes total, or 0."""
        top = min(total - 1, len(self.counts) - 1)
        least = (total + 1) // 2
        if top < least:
            return 0
        there = self.counts > 0
        fit = there[least : top + 1] & there[total - top : total - least + 1][::-1]
        if 2 * least == total and self.counts[least] < 2:
            fit[0] = False
        return top - int(np.argmax(fit[::-1])) if fit.any() else 0

    def pair(self, total: int) -> Pattern | None:
        """Two lengths that make total, the larger as large as can be."""
        if total < 2 or total < len(self.no_pair) and self.no_pair[total]:
            return None
        a = self._halves(total)
        if not a:
            self.no_pair[total] = True
            return None
        return [(a, 2)] if 2 * a == total else [(a, 1), (total - a, 1)]

    def triple(self, total: int) -> Pattern | None:
        """Three lengths that make total."""
        if total < 3:
            return None
        longest = np.flatnonzero(self.counts[: total - 1])[::-1]
        for a in longest[~self.no_pair[total - longest]].tolist():
            if 3 * a < total:  # none of the three is the longest
                break
            self.counts[a] -= 1
            b = self._halves(total - a)
            self.counts[a] += 1
            if b:
                return _counted([a, b, total - a - b])
            self.pair(total - a)  # with all copies of a: says whether it has none for good
        return None


def _counted(lengths: list[int]) -> Pattern:
    return [(x, lengths.count(x)) for x in dict.fromkeys(sorted(lengths, reverse=True))]


def exact(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns that fill a sequence exactly, and how often; what they use is taken from counts."""
    out = []
    left = counts.copy()  # a length is out of reach once its own turn is over
    sums = Sums(left)
    for length in range(capacity, 0, -1):
        while left[length]:
            gap = capacity - length
            left[length] -= 1
            rest = [] if not gap else sums.single(gap) or sums.pair(gap) or sums.triple(gap)
            left[length] += 1
            if rest is None:
                break
            pattern = _counted([length, *(x for x, n in rest for _ in range(n))])
            times = min(int(left[x]) // n for x, n in pattern)
            for x, n in pattern:
                left[x] -= n * times
                counts[x] -= n * times
            out.append((pattern, times))
        left[length] = 0
    return out


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit decreasing over all counted pieces: each goes to the open sequence with the least room that holds it."""
    open_: list[list[tuple[Pattern, int]]] = [[] for _ in range(capacity + 1)]  # by room
    has = np.zeros(capacity + 1, bool)

    def put(room: int, pattern: Pattern, times: int) -> None:
        if times:
            open_[room].append((pattern, times))
            has[room] = True

    for length in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[length])
        while n:
            fit = has[length:]
            room = length + int(np.argmax(fit)) if fit.any() else 0
            if room:
                pattern, times = open_[room].pop()
                has[room] = bool(open_[room])
            else:
                room, pattern, times = capacity, [], n
            most = room // length  # as the room shrinks, the same sequence stays the best
            whole = min(times, n // most)
            put(room - most * length, [*pattern, (length, most)], whole)
            n -= whole * most
            times -= whole
            if times and n:  # fewer than `most`: they end in one sequence
                put(room - n * length, [*pattern, (length, n)], 1)
                times -= 1
                n = 0
            if pattern:
                put(room, pattern, times)
    return [x for bins in open_ for x in bins]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Patterns and how often, which use each length exactly counts[length] times."""
    left = counts.astype(np.int64).copy()
    filled = exact(left, capacity)
    return filled + best_fit(left, capacity)


def segments(patterns: list[tuple[Pattern, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """length, first, last, sequences, base, at: pieces of a length ranked first to last - 1 go round the sequences
    from base on, the first round at offset `at` and each further one a length behind."""
    out, used, base = [], {}, 0
    for pattern, times in patterns:
        at = 0
        for length, copies in pattern:
            first = used.get(length, 0)
            used[length] = first + copies * times
            out.append((length, first, used[length], times, base, at))
            at += length * copies
        base += times
    return out


def _numbered(cut: DataFrame) -> DataFrame:
    """cut with part and nth: a piece's place among those of its length in its partition."""
    names = [*cut.columns, "nth"]
    where = cut.columns.index("length")

    def run(batches):
        seen: dict[int, int] = {}
        for batch in batches:
            nth = np.empty(batch.num_rows, np.int64)
            for i, length in enumerate(batch.column(where).to_pylist()):
                nth[i] = seen[length] = seen.get(length, -1) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth)], names=names)

    schema = ", ".join(f"{n} {kind}" for n, kind in cut.dtypes) + ", nth long"
    return cut.mapInArrow(run, schema).withColumn("part", F.spark_partition_id())


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut (with a column length, from 1 to capacity) with sequence_id and offset.

    To the driver comes the number of pieces of each length.
    """
    spark = cut.sparkSession
    rows = materialise(_numbered(cut))
    per = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r["length"]] = r["n"]
    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = per.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = rows.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    found = segments(plan(counts, capacity))
    table = spark.createDataFrame(found, "length long, first long, last long, sequences long, base long, at long")
    if len(found) <= BROADCAST_SEGMENTS:
        table = F.broadcast(table)
    held = ranked.join(table, "length").filter("first <= rank and rank < last")
    place = F.col("rank") - F.col("first")
    return held.select(
        *cut.columns,
        (F.col("base") + place % F.col("sequences")).alias("sequence_id"),
        (F.col("at") + F.col("length") * F.expr("(rank - first) div sequences")).alias("offset"),
    )


def pack_documents(documents: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The contract's columns for every piece of every document."""
    cut = packing.pieces(documents, tokenizer or packing._default_tokenizer(), capacity, with_ids=False)
    packed = pack(cut.drop("doc_tokens"), capacity)
    return packed.select("doc_id", F.expr(f"cast(start div {capacity} as int)").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
