import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from tokenizers import Tokenizer

from tessera.llm import packing
from tests.llm import cases


def check(got, texts, capacity=2048):
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    sequences = defaultdict(list)
    for r in got:
        ids = tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [1]
        assert r["doc_tokens"] == len(ids)
        piece = ids[r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_awkward_rows(spark):
    rng = random.Random(1)
    noise = ["".join(rng.choice("ab é'slΣ\n\t ß日1²  ,\x1c") for _ in range(rng.randrange(60))) for _ in range(60)]
    df = cases.documents(spark, cases.TEXTS + noise)
    got = packing.pack_documents(df).collect()
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    check(got, texts)
    assert sum(r["length"] for r in got) == sum(r["doc_tokens"] for r in got if r["start"] == 0)
    assert len({r["doc_id"] for r in got}) == len(texts)


def test_ids_are_the_operators_own_output(spark):
    got = packing.pieces(cases.documents(spark), P.path("word_bpe_49k.json"), capacity=16).collect()
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] <= 16 for r in got)


def test_first_fit_is_the_plain_scan():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 300):
        lengths = -np.sort(-rng.integers(1, 101, n))
        bins, offsets = packing.first_fit_decreasing(lengths, 100)
        room: list[int] = []
        for k, size in enumerate(lengths.tolist()):
            b = next((i for i, r in enumerate(room) if r >= size), len(room))
            if b == len(room):
                room.append(100)
            assert (bins[k], offsets[k]) == (b, 100 - room[b])
            room[b] -= size


def test_memo_starts_anew_without_changing_ids(monkeypatch):
    monkeypatch.setattr(packing, "_MEMO_WORDS", 3)
    words = packing.WordIds(open(P.path("word_bpe_49k.json"), encoding="utf-8").read())
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for text in ["one two three four five", "one six " + "y" * 300, "seven two", "", "<|ENDOFTEXT|> A, b.", "a, 1. é, ,. x!, 'S. it's, .", "one, two."]:
        assert words.encode(pa.array([text, None]), 1)[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [1]


def test_groups_and_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cut = packing.pieces(docs, P.path("word_bpe_49k.json"), with_ids=False)
    got = packing.pack(cut, group_size=50).collect()
    n = check(got, {r["doc_id"]: r["text"] for r in docs.collect()})
    assert n * 2048 < 1.35 * sum(r["length"] for r in got)
    assert packing.pack_documents(cases.empty(spark)).count() == 0


def test_large_ids_beside_a_null(spark):
    ids = [None, 2**53 + 1, 2**53 + 3, -(2**62) - 1, None]
    got = packing.pack_documents(spark.createDataFrame([(i, "one two three") for i in ids], "doc_id long, text string").coalesce(1)).collect()
    assert sorted(r["doc_id"] or 0 for r in got) == sorted(i or 0 for i in ids)
    assert sorted(r["offset"] for r in got) == [k * got[0]["length"] for k in range(5)]
