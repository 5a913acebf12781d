import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tessera.llm import best_fit as bf
from tests.llm import cases


def plain_best_fit(lengths, capacity):
    """Piece by piece, longest first."""
    rooms = []
    for x in sorted(lengths, reverse=True):
        fit = min((r for r in rooms if r >= x), default=None)
        rooms.append((capacity if fit is None else rooms.pop(rooms.index(fit))) - x)
    return len(rooms)


def counted(lengths, capacity):
    return np.bincount(np.array(lengths, int), minlength=capacity + 1)


def used(patterns, capacity):
    out = Counter()
    for pattern, times in patterns:
        assert times > 0 and sum(x * n for x, n in pattern) <= capacity
        for x, n in pattern:
            out[x] += n * times
    return out


@pytest.mark.parametrize("seed", range(12))
def test_plans_use_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([7, 30, 100, 500]))
    lengths = np.minimum(capacity, rng.geometric(rng.choice([0.02, 0.1, 0.4]), rng.integers(1, 2000))).tolist()
    patterns = bf.plan(counted(lengths, capacity), capacity)
    assert used(patterns, capacity) == Counter(lengths)
    n, least = sum(t for _, t in patterns), -(-sum(lengths) // capacity)
    assert least <= n <= max(plain_best_fit(lengths, capacity), least + 1)


@pytest.mark.parametrize("seed", range(8))
def test_best_fit_by_counts_is_the_plain_one(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 41, 400).tolist()
    patterns = bf.best_fit(counted(lengths, 60), 60)
    assert used(patterns, 60) == Counter(lengths)
    assert sum(t for _, t in patterns) == plain_best_fit(lengths, 60)


def test_sums_are_found_whenever_there_are_any():
    rng = np.random.default_rng(5)
    for _ in range(60):
        own = rng.integers(1, 25, 6).tolist()
        sums = bf.Sums(counted(own, 40))
        for total in range(1, 41):
            for size, find in ((1, sums.single), (2, sums.pair), (3, sums.triple)):
                got = find(total)
                assert (got is not None) == any(sum(c) == total for c in combinations(own, size)), (own, total, size)
                if got:
                    flat = [x for x, n in got for _ in range(n)]
                    assert len(flat) == size and sum(flat) == total and not Counter(flat) - Counter(own)


def test_exact_fills_come_first():
    # 60 + 40, 50 + 30 + 20 and 45 + 25 + 20 + 10 fill a hundred; 77 is left
    lengths = [60, 40, 50, 30, 20, 45, 25, 20, 10, 77]
    patterns = bf.plan(counted(lengths, 100), 100)
    assert sum(t for p, t in patterns if sum(x * n for x, n in p) == 100) == 3 and sum(t for _, t in patterns) == 4
    assert bf.plan(counted([5] * 10**6 + [95] * 10**6, 100), 100) == [([(95, 1), (5, 1)], 10**6)]


def check(got, texts, capacity):
    """Returns how many sequences there are."""
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {i: tokenizer.encode(x or "", add_special_tokens=False).ids + [1] for i, x in texts.items()}
    sequences, seen = defaultdict(list), Counter()
    for r in got:
        own = ids[r["doc_id"]]
        assert r["start"] == r["piece"] * capacity and r["length"] == min(capacity, len(own) - r["start"]) > 0
        assert r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        seen[r["doc_id"], r["piece"]] += 1
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), seen, ids


def test_awkward_rows(spark):
    df = cases.documents(spark).unionByName(spark.createDataFrame([(2**53 + 1, "big id", *[None] * 7), (None, "no id", *[None] * 7), (None, None, *[None] * 7)], cases.SCHEMA))
    rows = df.select("doc_id", "text").collect()
    for capacity in (16, 4096):
        got = bf.pack_documents(df, capacity=capacity).collect()
        named = [r for r in got if r["doc_id"] is not None]
        seen = Counter((r["doc_id"], r["piece"]) for r in named)
        wanted = Counter()
        tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
        for r in rows:
            if r["doc_id"] is not None:
                n = len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1
                wanted.update((r["doc_id"], k) for k in range(-(-n // capacity)))
        assert seen == wanted
        assert len([r for r in got if r["doc_id"] is None]) == 2
        by = defaultdict(list)
        for r in got:
            by[r["sequence_id"]].append((r["offset"], r["length"]))
        for own in by.values():
            ends = [0]
            for offset, length in sorted(own):
                assert offset == ends[-1]
                ends.append(offset + length)
            assert ends[-1] <= capacity
        assert sorted(by) == list(range(len(by)))
    assert bf.pack_documents(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_whole_table(spark, sf_dir, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(bf, "BROADCAST_SEGMENTS", -1)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = bf.pack_documents(docs).collect()
    n, seen, ids = check(got, {r["doc_id"]: r["text"] for r in docs.collect()}, bf.CAPACITY)
    assert max(seen.values()) == 1 and sum(r["length"] for r in got) == sum(map(len, ids.values()))
    assert n <= -(-sum(map(len, ids.values())) // bf.CAPACITY) + 1
