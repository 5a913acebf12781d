"""Counts of byte n-grams and words over a corpus, and values per n-gram brought back to every text.

A scan cuts the corpus into chunks and counts each chunk's distinct keys. Keys meet by hash in parts,
where counts are added up; whatever is worked out for each distinct key goes back through the same
parts to the chunks that hold it, next to their texts. So each distinct key of a chunk moves once
each way, in sorted compressed arrays, and no row is made per occurrence.

Texts move with their chunk, packed by bz2, which leaves a fifth less of them than zstd does.

A text is taken as `order` start bytes, its UTF-8 bytes, and an end byte; 0xFE and 0xFF never occur
in UTF-8. An n-gram is order + 1 bytes, the last of which is the one predicted, packed in a long.
"""

from __future__ import annotations

import bz2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _text as t
from tessera.llm._io import CHUNK_BYTES, n_chunks

START, END = 0xFE, 0xFF
#: Bytes of text whose n-grams are arrays at a time.
PIECE_BYTES = 1 << 18
#: The key that stands for the end of a text among word keys.
END_WORD = 0x1F2E3D4C5B6A7988


def parts_for(total_bytes: int, chunk_bytes: int = CHUNK_BYTES) -> int:
    """Parts in which keys meet; one takes a few million entries also where small partitions make many chunks."""
    return max(16, n_chunks(total_bytes, chunk_bytes) // 4)


def pack(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Sorted unsigned keys as steps, and values of 4 or 8 bytes, byte plane by byte plane."""
    import zstandard

    steps = np.diff(keys, prepend=keys[:1] * 0).astype("<u8").view(np.uint8).reshape(-1, 8).T
    planes = np.ascontiguousarray(values).astype(values.dtype.newbyteorder("<")).view(np.uint8).reshape(-1, values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate([np.ascontiguousarray(steps), np.ascontiguousarray(planes)]).tobytes())


def unpack(b: bytes, dtype: str = "<i8") -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8).reshape(8 + np.dtype(dtype).itemsize, -1)
    return np.cumsum(np.ascontiguousarray(raw[:8].T).view("<u8").ravel(), dtype=np.uint64), np.ascontiguousarray(raw[8:].T).view(dtype).ravel()


def byte_grams(column, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all texts one after another, and each text's bounds among them."""
    data, offsets = t.utf8(column)
    n = len(offsets) - 1
    of = np.repeat(np.arange(n), np.diff(offsets))
    padded = np.full(len(data) + (order + 1) * n, START, dtype=np.uint8)
    padded[np.arange(len(data)) + (order + 1) * of + order] = data
    padded[offsets[1:] + (order + 1) * np.arange(1, n + 1) - 1] = END
    found = np.zeros(len(padded), dtype=np.uint64)
    for k in range(order, -1, -1):
        found[k:] |= padded[: len(padded) - k].astype(np.uint64) << np.uint64(8 * k)
    symbols = np.ones(len(padded), dtype=bool)
    for k in range(order):
        symbols[offsets[:-1] + (order + 1) * np.arange(n) + k] = False
    return found[symbols], offsets + np.arange(n + 1)


def word_keys(column) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of the words of all texts (A-Z lower-cased), each text's followed by END_WORD; bounds."""
    data, offsets = t.utf8(column)
    data = t.lower_ascii(data)
    starts, ends = t.spans(~t.blank(data), offsets)
    n = len(offsets) - 1
    of = t.owner(starts, offsets)
    per = np.bincount(of, minlength=n)
    bounds = np.concatenate([[0], np.cumsum(per + 1)])
    out = np.full(bounds[-1], END_WORD, dtype=np.uint64)
    out[np.arange(len(starts)) + of] = t.span_hashes(data, starts, ends)
    return out, bounds


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    if not len(k):
        return k, c
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    del order
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(c, first, dtype=c.dtype)


class Sums:
    """Counts of a chunk's keys, as sorted runs each more than twice as long as the next: what is held grows with the
    distinct keys, not with the slices that they came from."""

    def __init__(self):
        self.runs = []

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.runs.append((keys, counts))
        while len(self.runs) > 1 and len(self.runs[-2][0]) <= 2 * len(self.runs[-1][0]):
            self._meet()

    def _meet(self) -> None:
        (k, c), (k2, c2) = self.runs.pop(), self.runs.pop()
        self.runs.append(_merged([k2, k], [c2, c]))

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct keys and their counts; nothing is held any more."""
        while len(self.runs) > 1:
            self._meet()
        return self.runs.pop() if self.runs else _merged([], [])


def scan(documents: DataFrame, order: int, parts: int, words: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """From doc_id, text, tag, train: kind 0, a chunk's rows and texts; kind 1, n-gram counts; kind 2, word counts.

    Counts are of rows with train; keys that only other rows hold come with 0.
    """
    schema = "kind int, chunk long, part long, doc_ids array<long>, tags array<string>, train array<boolean>, blob binary"
    types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.binary()]
    names = ["kind", "chunk", "part", "doc_ids", "tags", "train", "blob"]
    kinds = [(1, lambda c: byte_grams(c, order))] + [(2, word_keys)] * words

    def rows(*found):
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*found, strict=True), types, strict=True)], names=names)

    def run(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32

        def chunk(docs, tags, train, texts, sums):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("text", pa.large_string())])) as writer:
                while texts:
                    writer.write_batch(pa.RecordBatch.from_arrays([texts.pop(0).cast(pa.large_string())], names=["text"]))
            packed = bz2.compress(sink.getvalue())
            del sink
            yield rows((0, at, None, docs, tags, train, packed))
            del packed
            for kind, found in sums.items():
                k, c = found.take()
                part = (t.mix(k) % np.uint64(parts)).astype(np.uint32)
                by = np.argsort(part, kind="stable")
                edges = np.flatnonzero(np.diff(part[by].astype(np.int64), prepend=-1))
                for a, b in zip(edges, [*edges[1:], len(by)], strict=True):
                    own = by[a:b]
                    yield rows((kind, at, int(part[own[0]]), None, None, None, pack(k[own], c[own].astype(np.int64))))
            pa.default_memory_pool().release_unused()

        docs, tags, train, texts, sums, size = [], [], [], [], {k: Sums() for k, _ in kinds}, 0
        for batch in batches:
            for a, b in t.pieces(batch.column(1), PIECE_BYTES):
                column = batch.column(1).slice(a, b - a)
                learns = batch.column(3).slice(a, b - a).to_pylist()
                for kind, keys_of in kinds:
                    keys, bounds = keys_of(column)
                    mask = np.repeat(np.array(learns, dtype=bool), np.diff(bounds))
                    k, c = np.unique(keys[mask], return_counts=True)
                    sums[kind].add(k, c.astype(np.uint32))
                    k = np.unique(keys[~mask])
                    sums[kind].add(k, np.zeros(len(k), np.uint32))
                    del keys, mask, k, c
                docs += batch.column(0).slice(a, b - a).to_pylist()
                tags += batch.column(2).slice(a, b - a).to_pylist()
                train += learns
                texts.append(column)
                size += column.nbytes
                if size >= chunk_bytes:
                    yield from chunk(docs, tags, train, texts, sums)
                    docs, tags, train, texts, sums, size, at = [], [], [], [], {k: Sums() for k, _ in kinds}, 0, at + 1
        if docs:
            yield from chunk(docs, tags, train, texts, sums)

    return documents.select("doc_id", "text", "tag", "train").mapInArrow(run, schema)


def totals(counted: DataFrame) -> DataFrame:
    """part, g, c: each distinct key with its count over the corpus (0: only texts not trained on hold it)."""

    def run(table: pa.Table) -> pa.Table:
        found = [unpack(b.as_py()) for b in table.column("blob")]
        k, c = _merged([x for x, _ in found], [x for _, x in found])
        return pa.table({"part": pa.array(np.full(len(k), table.column("part")[0].as_py()), pa.int64()), "g": pa.array(k.view(np.int64), pa.int64()), "c": pa.array(c, pa.int64())})

    return counted.select("part", "blob").groupBy("part").applyInArrow(run, "part long, g long, c long")


def shared_totals(counted: DataFrame) -> DataFrame:
    """chunk, kind, blob: the corpus count of each key that a chunk holds."""

    def run(table: pa.Table) -> pa.Table:
        found = [unpack(b.as_py()) for b in table.column("blob")]
        k, c = _merged([x for x, _ in found], [x for _, x in found])
        return pa.table({"chunk": table.column("chunk"), "kind": table.column("kind"), "blob": pa.array([pack(x, c[np.searchsorted(k, x)]) for x, _ in found], pa.binary())})

    return counted.select("part", "chunk", "kind", "blob").groupBy("part").applyInArrow(run, "chunk long, kind int, blob binary")


def deliver(counted: DataFrame, values: DataFrame, dtype: str = "<f8") -> DataFrame:
    """chunk, kind, blob: the value (double) of each key that a chunk holds; values: part, g, value for every key."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        g = np.asarray(right.column("g")).view(np.uint64)
        order = np.argsort(g)
        g, value = g[order], np.asarray(right.column("value"))[order].astype(dtype)
        blobs = []
        for b in left.column("blob"):
            keys = unpack(b.as_py())[0]
            blobs.append(pack(keys, value[np.searchsorted(g, keys)]))
        return pa.table({"chunk": left.column("chunk"), "kind": left.column("kind"), "blob": pa.array(blobs, pa.binary())})

    return counted.select("part", "chunk", "kind", "blob").groupBy("part").cogroup(values.select("part", "g", "value").groupBy("part")).applyInArrow(run, "chunk long, kind int, blob binary")


def lookup(blobs: list[bytes], dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a chunk, sorted, and their values."""
    found = [unpack(b, dtype) for b in blobs]
    keys, values = np.concatenate([k for k, _ in found]), np.concatenate([v for _, v in found])
    order = np.argsort(keys)
    return keys[order], values[order]


def score(scanned: DataFrame, brought: DataFrame, order: int, finish, schema: str, dtype: str = "<f8") -> DataFrame:
    """A row per text from finish(doc_ids, tags, train, sums of the n-grams' values, symbols, column, tables).

    tables: the lookups of the kinds other than 1.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = np.asarray(right.column("kind"))
        blobs = right.column("blob")
        tables = {int(k): lookup([blobs[int(i)].as_py() for i in np.flatnonzero(kinds == k)], dtype if k == 1 else "<i8") for k in np.unique(kinds)}
        keys, values = tables.get(1, (np.zeros(0, np.uint64), np.zeros(0)))
        out = []
        for row in range(left.num_rows):
            docs, tags, train = (left.column(k)[row].as_py() for k in ("doc_ids", "tags", "train"))
            at = 0
            with pa.ipc.open_stream(bz2.decompress(left.column("blob")[row].as_py())) as reader:
                for batch in reader:
                    grams, bounds = byte_grams(batch.column(0), order)
                    running = np.concatenate([[0.0], np.cumsum(values[np.searchsorted(keys, grams)], dtype=np.float64)])
                    n = len(batch)
                    out.append(finish(docs[at : at + n], tags[at : at + n], train[at : at + n], running[bounds[1:]] - running[bounds[:-1]], np.diff(bounds), batch.column(0), tables))
                    at += n
        return pa.Table.from_batches(out)

    left = scanned.filter("kind = 0").select("chunk", "doc_ids", "tags", "train", "blob")
    return left.groupBy("chunk").cogroup(brought.groupBy("chunk")).applyInArrow(run, schema)


def suffix(g: str, order: int) -> str:
    """SQL: the n-gram without its first byte(s), so that `order` context bytes and the symbol stay."""
    return f"({g} & {(1 << (8 * (order + 1))) - 1}L)"


def levels(counts: DataFrame, order: int, keep) -> dict[int, DataFrame]:
    """g, c of each order: the highest counts occurrences, each lower one the distinct n-grams above it."""
    out = {order: keep(counts.filter("c > 0").select("g", "c"))}
    for j in range(order - 1, -1, -1):
        out[j] = keep(out[j + 1].groupBy(F.expr(suffix("g", j)).alias("g")).agg(F.count("*").alias("c")))
    return out
