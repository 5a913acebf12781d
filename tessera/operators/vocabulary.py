"""The strings of a table, however many, found wherever they stand in texts.

An automaton over all of them (functions/patterns.py) must fit in each worker, and its list in the driver. Here the driver gets
a Bloom filter of bounded size: over hashes of the strings and of their beginnings. Each place of a text is followed as long as
the filter holds what begins there; what it takes for a string is then checked against the table, so results are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.batches import bounded, slices
from tessera.operators import bloom
from tessera.sources.shared import drop, materialise

_BASE = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)
FALSE_HITS = 0.01


def _mixed(h: np.ndarray, whole: bool) -> np.ndarray:
    """Keys of the filter, of whole strings or of beginnings."""
    h = (h ^ (h >> np.uint64(32)) ^ np.uint64(0x5851F42D4C957F2D if whole else 0)) * _ODD
    return h ^ (h >> np.uint64(29))


def _kept(length: int) -> bool:
    """Whether beginnings of that length are in the filter: all up to 16, then powers of two."""
    return length <= 16 or length & (length - 1) == 0


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _keys(words: list[str], shortest: int) -> np.ndarray:
    """The filter's keys for words, as longs."""
    points, sizes = _points(words), np.array([len(x) for x in words], np.int64)
    starts, h, out = np.cumsum(sizes) - sizes, np.zeros(len(words), np.uint64), []
    for n in range(1, int(sizes.max(initial=0)) + 1):
        stay = sizes >= n
        starts, h, sizes = starts[stay], h[stay], sizes[stay]
        h = h * _BASE + points[starts + n - 1]
        if n >= shortest:
            out.append(_mixed(h[sizes == n], True))
            if _kept(n):
                out.append(np.unique(_mixed(h, False)))
    return np.concatenate([*out, np.zeros(0, np.uint64)]).view(np.int64)


def _spans(texts: list[str], filter_: bloom.Bloom, shortest: int, longest: int) -> list[set[str]]:
    """For each text what the filter takes for one of the strings."""
    found: list[set[str]] = [set() for _ in texts]
    text, points, sizes = "".join(texts), _points(texts), np.array([len(x) for x in texts], np.int64)
    ends = np.cumsum(sizes)
    if len(points) < shortest or longest < shortest:
        return found
    h = np.zeros(len(points) - shortest + 1, np.uint64)
    for k in range(shortest):
        h = h * _BASE + points[k : k + len(h)]
    at = np.flatnonzero(filter_.holds(_mixed(h, False)) if _kept(shortest) else np.ones(len(h), bool))
    h, end, n = h[at], np.repeat(ends, sizes)[at], shortest
    stay = at + n <= end
    while True:
        at, h, end = at[stay], h[stay], end[stay]
        if not len(at):
            return found
        whole = at[filter_.holds(_mixed(h, True))]
        for i, row in zip(whole.tolist(), np.searchsorted(ends, whole, "right").tolist()):
            found[row].add(text[i : i + n])
        n += 1
        if n > longest:
            return found
        stay = at + n <= end
        at, h, end = at[stay], h[stay], end[stay]
        h = h * _BASE + points[at + n - 1]
        stay = filter_.holds(_mixed(h, False)) if _kept(n) else np.ones(len(at), bool)


def held(rows: DataFrame, strings: DataFrame, shortest: int) -> DataFrame:
    """key and p for each row of rows (key, text) and each distinct string (the one column of strings, of `shortest` characters
    or more) that its text holds; rows that hold none, or have a null text, are not in it."""
    bounded()
    spark = rows.sparkSession
    table = materialise(strings.toDF("p").filter(F.length("p") >= shortest).distinct())
    longest = table.agg(F.max(F.length("p"))).first()[0] or 0

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(_keys(part.to_pylist(), shortest))], names=["key"])

    made = materialise(table.mapInArrow(keys, "key long").distinct())
    fits = math.exp(-0.95 * 8 * bloom.MAX_BYTES * math.log(2) ** 2 / max(1, made.count()))  # beyond that the filter lets more through
    sent = spark.sparkContext.broadcast(bloom.build(made, max(FALSE_HITS, fits)))
    drop(made)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for part in slices(batch.column(1)):
                found = [sorted(x) for x in _spans([x or "" for x in part.to_pylist()], sent.value, shortest, longest)]
                of = np.repeat(np.arange(start, start + len(part)), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array([p for x in found for p in x], pa.string())], names=["key", "p"])
                start += len(part)

    named = rows.toDF("key", "text")
    found = materialise(named.mapInArrow(look, f"key {named.schema['key'].dataType.simpleString()}, p string"))
    wrong = materialise(found.select("p").distinct().join(table, "p", "left_anti"))
    return found.join(wrong, "p", "left_anti").select("key", "p")
