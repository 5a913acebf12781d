import hashlib
import random

import public_tokenizers as P
import pytest

from tests.llm import cases

tiktoken = pytest.importorskip("tiktoken")
from tessera.llm import byte_bpe  # noqa: E402

RANKS = P.path("byte_bpe_50k.tiktoken")


def expected(text):
    ids = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={}).encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_awkward_rows_match_the_library(spark):
    rng = random.Random(1)
    noise = ["".join(rng.choice("ab é'sl\n\t ß日1²  ,") for _ in range(rng.randrange(60))) for _ in range(60)]
    df = cases.documents(spark, cases.TEXTS + noise)
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    got = byte_bpe.digests_of(df, RANKS, P.PATTERN).collect()
    assert len(got) == df.count()
    for r in got:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == expected(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_small_chunks_change_nothing_and_ids_round_trip(spark):
    df = cases.documents(spark)
    whole = sorted(map(tuple, byte_bpe.digests_of(df, RANKS, P.PATTERN).collect()))
    chunked = byte_bpe.encode_documents(df, RANKS, P.PATTERN, lambda d, b, w, n, t: _counts(d, b, w, n), "doc_id long, n_tokens long", chunk_bytes=40)
    assert sorted((r[0], r[1]) for r in whole) == sorted(map(tuple, chunked.collect()))
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    for r in byte_bpe.ids_of(df, RANKS, P.PATTERN).collect():
        assert r["decoded"] == texts[r["doc_id"]]


def _counts(docs, bounds, words, numbers):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([sum(len(words[i]) // 4 for i in numbers[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], pa.int64())], names=["doc_id", "n_tokens"])


def test_empty_table(spark):
    assert byte_bpe.digests_of(cases.empty(spark), RANKS, P.PATTERN).count() == 0


def test_rank_files_of_one_size_are_told_apart(spark):
    text = "Größe und Länge, naïve façades: 日本語 words and more words"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    seen = set()
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"):
        ranks = byte_bpe.read_ranks(P.path(name))
        assert len(ranks) == 50256
        ids = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)
        r = byte_bpe.digests_of(df, P.path(name), P.PATTERN).first()
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        seen.add(r["ids_sha256"])
    assert len(seen) == 2
