"""BPE merges learned on the cluster: the driver sees the most frequent pairs, never the words.

Words are rows of blocks: the symbols of many words as numbers, each word with its end, and the words' frequencies.
A task applies merges to a block as array arithmetic and counts pairs within it; Spark adds the counts up. Pair counts
are a table that is kept up to date by what the touched words lose and gain. A round takes as many merges as are
certain to be the next ones in order:

* of the most frequent pairs, each one in turn, as long as it has no symbol in common with an earlier one
  of the round where the two could overlap, so that its count still holds;
* a pair that a merge brings about is at most as frequent as the pair it takes the place of, which comes
  later in the order; where the two are as frequent as the next merge, the round ends before it;
* a merge of a symbol with itself, or one whose result is a symbol already, ends the round.

The merges are those that taking one pair at a time gives, whatever the number of rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.batches import bounded
from tessera.operators import bpe
from tessera.sources.shared import drop, materialise

#: Pairs that the driver looks at in a round.
TOP = 512
#: Merges that are applied on the way before the words are written anew.
PENDING = 24
#: Symbols of a block of words, about.
BLOCK = 1 << 20
#: Stands after each word of a block.
END = -1

Pair = tuple[str, str]
_BLOCK = pa.schema([("symbols", pa.binary()), ("freqs", pa.binary())])
_PAIR = pa.schema([("left", pa.int32()), ("right", pa.int32()), ("freq", pa.int64())])


def _marked(words: pa.Array) -> np.ndarray:
    """The mark (32), the bytes and END of each word."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    out = np.full(offsets[-1] - offsets[0] + 2 * len(words), END, np.int32)
    starts = offsets[:-1] - offsets[0] + 2 * np.arange(len(words))
    out[starts] = 32
    inner = np.ones(len(out), bool)
    inner[starts] = inner[starts + np.diff(offsets) + 1] = False
    out[inner] = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return out


def blocks(words: DataFrame) -> DataFrame:
    """symbols and freqs of the words of each block; words: word, freq."""
    bounded(words.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append((_marked(batch.column(0).cast(pa.string())), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)))
            if sum(len(x) for x, _ in held) >= BLOCK:
                yield block(*map(np.concatenate, zip(*held)))
                held = []
        if held:
            yield block(*map(np.concatenate, zip(*held)))

    return words.select("word", "freq").mapInArrow(run, "symbols binary, freqs binary")


def block(symbols: np.ndarray, freqs: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([[symbols.tobytes()], [freqs.tobytes()]], schema=_BLOCK)


def merged(symbols: np.ndarray, merges: list[tuple[int, int, int]]) -> np.ndarray:
    """symbols after the merges (left, right, new symbol), one after another: every occurrence, from the left, without overlap."""
    for left, right, new in merges:
        at = np.flatnonzero(symbols[:-1] == left)
        at = at[symbols[at + 1] == right]
        if left == right and len(at):
            first = np.flatnonzero(np.diff(at, prepend=-2) != 1)  # of a run of the symbol every other place
            at = at[(at - np.repeat(at[first], np.diff(first, append=len(at)))) % 2 == 0]
        if len(at):
            symbols = symbols.copy()
            symbols[at] = new
            symbols = np.delete(symbols, at + 1)
    return symbols


def counted(symbols: np.ndarray, freqs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct neighbourhoods (left << 32 | right) and their frequencies."""
    at = np.flatnonzero((symbols[:-1] != END) & (symbols[1:] != END)) if len(symbols) else np.zeros(0, np.int64)
    weights = freqs[np.cumsum(symbols == END)[at]]
    codes = symbols[at].astype(np.int64) << 32 | symbols[at + 1]
    order = np.argsort(codes, kind="stable")
    codes, weights = codes[order], weights[order]
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[first], np.add.reduceat(weights, first) if len(first) else weights


def touched(symbols: np.ndarray, freqs: np.ndarray, merges: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The words that a merge changes."""
    word = np.cumsum(symbols == END)
    hit = np.zeros(len(freqs) + 1, bool)
    for left, right, _ in merges:
        at = np.flatnonzero(symbols[:-1] == left)
        hit[word[at[symbols[at + 1] == right]]] = True
    return symbols[hit[word - (symbols == END)]], freqs[hit[:-1]]


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for symbols, freqs in zip(batch.column(0), batch.column(1)):
            yield np.frombuffer(symbols.as_buffer(), np.int32), np.frombuffer(freqs.as_buffer(), np.int64)


def pairs(base: DataFrame, pending: list[tuple[int, int, int]], now: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """left, right, freq of the neighbourhoods in each block after the pending merges, not yet added up over blocks;
    with now, what these merges add to them and take from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for symbols, freqs in _arrays(batches):
            symbols = merged(symbols, pending)
            if now is not None:
                symbols, freqs = touched(symbols, freqs, now)
            found = [counted(symbols, freqs)]
            if now is not None:
                found = [(found[0][0], -found[0][1]), counted(merged(symbols, now), freqs)]
            for codes, sums in found:
                yield pa.record_batch([(codes >> 32).astype(np.int32), (codes & 0xFFFFFFFF).astype(np.int32), sums.astype(np.int64)], schema=_PAIR)

    return base.mapInArrow(run, "left int, right int, freq long")


def _anew(base: DataFrame, pending: list[tuple[int, int, int]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for symbols, freqs in _arrays(batches):
            yield block(merged(symbols, pending), freqs)

    return base.mapInArrow(run, "symbols binary, freqs binary")


def _summed(pairs_: DataFrame) -> DataFrame:
    return pairs_.groupBy("left", "right").agg(F.sum("freq").alias("freq")).filter("freq > 0")


def certain(top: list[tuple[int, str, str]], whole: bool, known: set[str], most: int) -> list[Pair]:
    """The merges of a round, in order. top: (freq, left, right), most frequent first, of equals the largest first;
    whole: top has all pairs there are; known: all symbols so far."""
    known, out = set(known), []
    for k, (freq, left, right) in enumerate(top):
        if out:
            ends, starts = {b for _, b in out}, {a for a, _ in out}
            if left in ends or right in starts:
                break
            if not whole and freq == top[-1][0]:
                break  # pairs as frequent as this one may lie beyond
            rivals = [x for x in top[k + 1 :] if x[0] == freq]  # as frequent and later in order
            if any(a in ends or b in starts for _, a, b in rivals):
                break
        out.append((left, right))
        if len(out) == most or left == right or left + right in known:
            break
        known.add(left + right)
    return out


def train(words: DataFrame, n_merges: int, rounds: list[int] | None = None) -> list[tuple[str, str, int]]:
    """left, right and count of up to n_merges merges, in order; words: word, freq. rounds, if given, gets each round's number of merges."""
    spark = words.sparkSession
    base = materialise(blocks(words))
    counts = materialise(_summed(pairs(base, [])))
    pending: list[tuple[int, int, int]] = []
    number = {c: b for b, c in enumerate(bpe.BYTES)}  # symbols by name
    out: list[tuple[str, str, int]] = []
    while len(out) < n_merges:
        names = spark.createDataFrame([(i, c) for c, i in number.items()], "i int, name string")  # as many as bytes and merges
        named = counts.join(F.broadcast(names.toDF("left", "l")), "left").join(F.broadcast(names.toDF("right", "r")), "right")
        best = [(r["freq"], r["l"], r["r"]) for r in named.orderBy(F.desc("freq"), F.desc("l"), F.desc("r")).limit(TOP).collect()]
        chosen = certain(best, len(best) < TOP, set(number), n_merges - len(out))
        if not chosen:
            break
        out += [(left, right, best[k][0]) for k, (left, right) in enumerate(chosen)]
        if rounds is not None:
            rounds.append(len(chosen))
        if len(out) == n_merges:
            break
        now = [(number[left], number[right], number.setdefault(left + right, len(number))) for left, right in chosen]
        if len(pending) + len(now) > PENDING:
            old, base, pending = base, materialise(_anew(base, pending)), []
            drop(old)
        old, counts = counts, materialise(_summed(counts.unionByName(pairs(base, pending, now))))
        drop(old)
        pending += now
    drop(base)
    drop(counts)
    return out


def merges_table(spark, merges: list[tuple[str, str, int]]) -> DataFrame:
    """rank (from 0), left, right, freq."""
    return spark.createDataFrame([(k, *m) for k, m in enumerate(merges)], "rank int, left string, right string, freq long")


