"""Operator 7: byte-level BPE encoding and decoding by a shuffle of distinct words.

1. One scan splits texts into pre-tokens. Each chunk of up to 48 MB of text keeps its pre-tokens in
   order as numbers of a dictionary of its own, and that dictionary.
2. The dictionaries are dealt by the hash of the word into as many parts as there are chunks; equal
   words meet in one part, where each distinct word is encoded once, however many chunks hold it.
3. The ids go back by chunk, where the numbers are replaced by ids in order of position, and the ids
   are decoded through the table of token bytes.

What moves is each distinct word of a chunk once, in compressed bundles, and each chunk's compressed
numbers; no row per pre-token. A hot word is one entry per chunk. Every task holds one chunk's
dictionary, or one part of all dictionaries, which is of about that size.

Defined results: a null or empty text has no ids; repeated rows give repeated results; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _text as t
from tessera.llm._io import arrow_limits, id_and_text, materialise

CHUNK = 48 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def _encoding(ranks: dict[bytes, int], pattern: str):
    import tiktoken

    kept = sys.__dict__.setdefault("_tessera_bpe", {})
    key = (id(ranks), pattern)  # two rank files may be of one size; what is kept holds ranks, so that its id stays its own
    if key not in kept:
        kept.clear()
        kept[key] = ranks, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return kept[key][1]


def _code(x: np.ndarray) -> bytes:
    """Numbers as a stream of their bit lengths, and for each length the bits below the first, byte by byte.

    Common words have small numbers, and within a length the bits are near even, so that the entropy
    coder of each stream meets one distribution only.
    """
    import zstandard

    up = x.astype(np.int64) + 1
    length = (np.frexp(up.astype(np.float64))[1] - 1).astype(np.uint8)
    streams = [length.tobytes()]
    for k in range(1, int(length.max()) + 1 if len(length) else 0):
        rest = up[length == k] - (1 << k)
        streams += [(rest >> (8 * j)).astype(np.uint8).tobytes() for j in range((k + 7) // 8)]
    packed = [zstandard.ZstdCompressor(level=3).compress(s) for s in streams]
    return np.array([len(packed), *map(len, packed)], dtype="<u8").tobytes() + b"".join(packed)


def _decode(b: bytes) -> np.ndarray:
    import zstandard

    n = int(np.frombuffer(b, "<u8", 1)[0])
    ends = 8 * (n + 1) + np.cumsum(np.frombuffer(b, "<u8", n, 8).astype(np.int64))
    streams = iter([np.frombuffer(zstandard.ZstdDecompressor().decompress(b[a:e]), np.uint8) for a, e in zip([8 * (n + 1), *ends[:-1]], ends, strict=True)])
    length = next(streams)
    out = np.zeros(len(length), np.int64)
    for k in range(1, int(length.max()) + 1 if len(length) else 0):
        rest = np.int64(1 << k)
        for j in range((k + 7) // 8):
            rest = rest + (next(streams).astype(np.int64) << (8 * j))
        out[length == k] = rest - 1
    return out


def number_words(documents: DataFrame, pattern: str, chunk_bytes: int = CHUNK) -> DataFrame:
    """A row per chunk: chunk, doc_ids, counts (pre-tokens of each), numbers (compressed), words (compressed, in order of number)."""
    arrow_limits(documents.sparkSession)

    def run(batches):
        import regex
        import zstandard
        from pyspark import TaskContext

        find = regex.compile(pattern).findall
        at = TaskContext.get().partitionId() << 32

        def fresh():
            words = defaultdict()
            words.default_factory = words.__len__
            return words

        words, docs, counts, parts, size = fresh(), [], [], [], 0

        def chunk():
            numbers = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            often = np.bincount(numbers, minlength=len(words))
            rank = np.empty(len(words), dtype=np.uint32)
            order = np.argsort(-often, kind="stable")
            rank[order] = np.arange(len(words), dtype=np.uint32)
            known = list(words)
            sink = pa.BufferOutputStream()
            batch = pa.RecordBatch.from_arrays([pa.array([known[i] for i in order], pa.string())], names=["word"])
            with pa.ipc.new_stream(sink, batch.schema) as writer:
                writer.write_batch(batch)
            packed = zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([_code(rank[numbers])], pa.binary()), pa.array([packed], pa.binary())], names=["chunk", "doc_ids", "counts", "numbers", "words"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = find(text.as_py() or "")
                parts.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)))
                docs.append(doc)
                counts.append(len(found))
                size += len(text.as_buffer() or b"") if text.is_valid else 0
                if size >= chunk_bytes:
                    yield chunk()
                    words, docs, counts, parts, size, at = fresh(), [], [], [], 0, at + 1
        if docs:
            yield chunk()

    return id_and_text(documents).mapInArrow(run, "chunk long, doc_ids array<long>, counts array<long>, numbers binary, words binary")


def _bundle(numbers: np.ndarray, lengths: np.ndarray, data: bytes) -> bytes:
    """Byte strings of given lengths, one after another, each with a number."""
    import zstandard

    head = np.concatenate([numbers, lengths]).astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(len(numbers).to_bytes(8, "little") + np.ascontiguousarray(head).tobytes() + data)


def _unbundle(b: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(b)
    n = int.from_bytes(raw[:8], "little")
    head = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    return head[:n], head[n:], raw[8 + 8 * n :]


def deal_words(chunks: DataFrame, parts: int) -> DataFrame:
    """part, chunk, bundle: each chunk's distinct words with their numbers, dealt by the word's hash."""

    def run(batches):
        import zstandard

        for batch in batches:
            for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(packed.as_py())) as reader:
                    words = reader.read_all().column(0).combine_chunks()
                order = np.asarray(pc.sort_indices(words))  # neighbours alike are smaller
                data, offsets = t.utf8(words.take(pa.array(order)))
                lengths = np.diff(offsets)
                part = (t.span_hashes(data, offsets[:-1], offsets[1:]) % np.uint64(parts)).astype(np.int64)
                by = np.argsort(part, kind="stable")
                edges = np.flatnonzero(np.diff(part[by], prepend=-1))
                raw = data.tobytes()
                for a, b in zip(edges, [*edges[1:], len(by)], strict=True):
                    own = by[a:b]
                    bundle = _bundle(order[own], lengths[own], b"".join([raw[offsets[i] : offsets[i + 1]] for i in own]))
                    yield pa.RecordBatch.from_arrays([pa.array([part[own[0]]], pa.int64()), pa.array([chunk], pa.int64()), pa.array([bundle], pa.binary())], names=["part", "chunk", "bundle"])

    return chunks.select("chunk", "words").mapInArrow(run, "part long, chunk long, bundle binary")


def encode_words(dealt: DataFrame, ranks, pattern: str) -> DataFrame:
    """chunk, bundle: the ids (little-endian unsigned 32 bits) of each chunk's words; a distinct word is encoded once."""

    def run(table: pa.Table) -> pa.Table:
        encode = _encoding(ranks.value, pattern)._core_bpe.encode_single_piece
        known: dict[bytes, bytes] = {}
        chunks, out = table.column("chunk").to_pylist(), []
        for bundle in table.column("bundle"):
            numbers, lengths, data = _unbundle(bundle.as_py())
            ids, at = [], 0
            for n in lengths.tolist():
                word = data[at : at + n]
                at += n
                found = known.get(word)
                if found is None:
                    found = known[word] = np.array(encode(word), dtype="<u4").tobytes()
                ids.append(found)
            order = np.argsort(numbers, kind="stable")
            ids = [ids[i] for i in order]
            flat = np.frombuffer(b"".join(ids), np.uint8).reshape(-1, 4).T
            out.append(_bundle(numbers[order], np.array([len(x) for x in ids]), np.ascontiguousarray(flat).tobytes()))
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "bundle": pa.array(out, pa.binary())})

    return dealt.groupBy("part").applyInArrow(run, "chunk long, bundle binary")


def _words_of(bundles) -> list[bytes]:
    """Ids of the words of a chunk, by number."""
    found: dict[int, bytes] = {}
    for bundle in bundles:
        numbers, lengths, data = _unbundle(bundle.as_py())
        ids = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).tobytes()
        ends = np.cumsum(lengths).tolist()
        found.update(zip(numbers.tolist(), [ids[e - n : e] for e, n in zip(ends, lengths.tolist(), strict=True)], strict=True))
    return [found[i] for i in range(len(found))]


def encode_documents(documents: DataFrame, ranks_path: str, pattern: str, reduce, schema: str, chunk_bytes: int = CHUNK) -> DataFrame:
    """Ids of every document, handed to reduce(doc_ids, bounds, word_ids, word_of, table) -> RecordBatch.

    The rank file has a fixed size (some fifty thousand tokens); it is broadcast, and its inverse is
    the table that decoding looks tokens up in.
    """
    spark = documents.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    chunks = materialise(number_words(documents, pattern, chunk_bytes))
    ids = encode_words(deal_words(chunks, max(1, chunks.count())), ranks, pattern)

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        byte_table = [b""] * (max(ranks.value.values()) + 1)
        for token, i in ranks.value.items():
            byte_table[i] = token
        words = _words_of(right.column("bundle"))
        out = []
        for row in left.select(["doc_ids", "counts", "numbers"]).to_pylist():
            bounds = np.concatenate([[0], np.cumsum(row["counts"], dtype=np.int64)])
            out.append(reduce(row["doc_ids"], bounds, words, _decode(row["numbers"]), byte_table))
        return pa.Table.from_batches(out)

    return chunks.select("chunk", "doc_ids", "counts", "numbers").groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInArrow(assemble, schema)


def ids_of(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string: the operator's own output."""

    def reduce(docs, bounds, words, numbers, table):
        ids = [np.frombuffer(b"".join([words[i] for i in numbers[a:b]]), dtype="<u4").astype(np.int32) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        decoded = [b"".join([table[i] for i in x]).decode("utf-8", "replace") for x in ids]
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return encode_documents(documents, ranks_path, pattern, reduce, "doc_id long, ids array<int>, decoded string")


def digests_of(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def reduce(docs, bounds, words, numbers, table):
        # rendered and decoded once per word of the chunk
        shown, bytes_of, lengths = [], [], np.zeros(len(words), np.int64)
        for i, word in enumerate(words):
            ids = np.frombuffer(word, dtype="<u4").tolist()
            lengths[i] = len(ids)
            shown.append(" ".join(map(str, ids)))
            bytes_of.append(b"".join([table[x] for x in ids]))
        n, a, b = [], [], []
        for start, end in zip(bounds[:-1], bounds[1:], strict=True):
            own = numbers[start:end]
            n.append(int(lengths[own].sum()))
            own = own.tolist()
            a.append(hashlib.sha256(" ".join([shown[i] for i in own]).encode()).hexdigest())
            b.append(hashlib.sha256(b"".join([bytes_of[i] for i in own])).hexdigest())
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encode_documents(documents, ranks_path, pattern, reduce, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
