"""Operator 10: packing token sequences by first-fit decreasing.

Documents are tokenized, ended with an end id, cut at multiples of the capacity, and the pieces are
dealt at random into groups of about `group_size`; each group is packed alone, so no task grows with
the input. Within a group pieces go, longest first, into the first sequence with room; a tournament
tree over the room left in each sequence finds it in logarithmic time.

Defined results: a null or empty text is the end id alone; rows that repeat a doc_id are packed each
for itself; an empty table gives no pieces; extra columns are ignored. Ties in length go by
(doc_id, start), null ids last. Texts are tokenized whole: the tokenizer drops white space, so the words between
ASCII white space are encoded once per worker and memo, and their ids put together.
"""

from __future__ import annotations

import os
import sys
import zlib
from collections import defaultdict
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _text as t
from tessera.llm._io import arrow_limits, id_and_text, materialise

CAPACITY = 2048
END_ID = 1
GROUP_SIZE = 1 << 14
_MEMO_WORDS = 600_000
_MEMO_IDS = 4_000_000


def split_words(column) -> tuple[list[bytes], np.ndarray]:
    """Words of all texts of a column, and how many each text has.

    Texts are split at ASCII white space, and before a comma or full stop that ends a word behind an
    ASCII letter or digit, where the tokenizer splits as well. A-Z become a-z, as they do in the
    tokenizer, unless the texts hold a special token's opening, which is found before lower-casing.
    """
    data, offsets = t.utf8(column)
    n = len(offsets) - 1
    raw = data.tobytes()
    if b"<|" not in raw:
        data = t.lower_ascii(data)
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    blank = t.blank(data)
    split = (data == 44) | (data == 46)
    plain = ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 48) & (data <= 57)
    split[1:] &= plain[:-1] & ~edge[1:-1]
    split[:1] = False
    split[:-1] &= blank[1:] | edge[1:-1]
    starts, _ = t.spans(~blank, offsets)
    per = np.bincount(t.owner(starts, offsets), minlength=n) + np.bincount(t.owner(np.flatnonzero(split), offsets), minlength=n)
    spaced = np.insert(data, np.flatnonzero(split | edge[:-1]), 32)
    return spaced.tobytes().split(), per


class WordIds:
    """Ids of whole texts by way of a bounded memo of words; the memo starts anew when full."""

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; idle threads of the library would spin on the others
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.clear()

    def clear(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.starts, self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def learn(self, words: list[bytes]) -> None:
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        ids = [x.ids for x in found]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.starts = np.append(self.starts, len(self.flat) + np.cumsum(lengths) - lengths)
        self.lengths = np.append(self.lengths, lengths)
        self.flat = np.append(self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())))

    def encode(self, column, end_id: int) -> list[np.ndarray]:
        """The ids of each text of a column, with end_id last."""
        if len(self.number) > _MEMO_WORDS or len(self.flat) > _MEMO_IDS:
            self.clear()
        words, per = split_words(column)
        before = len(self.number)
        index = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if new := len(self.number) - before:
            self.learn(list(islice(reversed(self.number), new))[::-1])
        lengths = self.lengths[index]
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[index] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        ids = self.flat[at]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per)])]
        return [np.append(ids[a:b], np.uint32(end_id)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _encoder(model: str) -> WordIds:
    kept = sys.__dict__.setdefault("_tessera_words", {})
    key = zlib.crc32(model.encode())
    if key not in kept:
        kept.clear()
        kept[key] = WordIds(model)
    return kept[key]


def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids of every piece.

    tokenizer: path of a tokenizer file; the driver reads it and its fixed size travels to the workers.
    """
    spark = documents.sparkSession
    arrow_limits(spark)
    model = spark.sparkContext.broadcast(open(tokenizer, encoding="utf-8").read())
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def run(batches):
        encoder = _encoder(model.value)
        for batch in batches:
            for a, b in t.pieces(batch.column(1)):
                rows = []
                for doc, ids in zip(batch.column(0).slice(a, b - a).to_pylist(), encoder.encode(batch.column(1).slice(a, b - a), end_id), strict=True):
                    ids = ids.astype("<u4")
                    for start in range(0, len(ids), capacity):
                        piece = ids[start : start + capacity]
                        rows.append((doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), *([piece.astype(np.int32)] if with_ids else [])))
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(list(c), pa.list_(pa.int32())) for c in columns[5:]], names=names)

    return id_and_text(documents).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, given longest first. Every length is from 1 to capacity."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    whole = int(np.searchsorted(-lengths, -capacity, side="right"))  # these fill a bin each
    bins[:whole] = np.arange(whole)
    rest = lengths[whole:].tolist()
    width = 1
    while width < max(1, len(rest)):
        width *= 2
    room = [capacity] * (2 * width)  # room[i]: the most room in any bin below node i
    for k, size in enumerate(rest):
        i = 1
        while i < width:
            i *= 2
            if room[i] < size:
                i += 1
        bins[whole + k], offsets[whole + k] = whole + i - width, capacity - room[i]
        room[i] -= size
        while i > 1:
            i //= 2
            a, b = room[2 * i], room[2 * i + 1]
            room[i] = a if a > b else b
    return bins, offsets


def pack(cut: DataFrame, capacity: int = CAPACITY, group_size: int = GROUP_SIZE, seed: int = 0) -> DataFrame:
    """cut with sequence_id and offset. cut is materialised first, as its rows are counted and numbered."""
    cut = materialise(cut)
    groups = max(1, -(-cut.count() // group_size))
    # a random group for each row, also for rows that are alike
    dealt = cut.withColumn("_row", F.monotonically_increasing_id()).withColumn("_group", F.expr(f"pmod(xxhash64(doc_id, start, _row, {int(seed)}L), {groups}L)")).drop("_row")
    names = cut.columns

    def run(group: pa.Table) -> pa.Table:  # Arrow from end to end: a null beside them leaves large ids as they are
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), capacity)
        base = group["_group"][0].as_py() << 32
        return group.select(names).append_column("sequence_id", pa.array(base + bins)).append_column("offset", pa.array(offsets))

    schema = cut.schema.add("sequence_id", "long").add("offset", "long")
    return dealt.groupBy("_group").applyInArrow(run, schema)


def _default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The contract's columns for every piece of every document."""
    return pack(pieces(documents, tokenizer or _default_tokenizer(), with_ids=False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)
