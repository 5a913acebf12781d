import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.operators import bpe
from tessera.operators import bpe_training as bt

B = bpe.BYTES


def test_blocks_hold_words_and_merges_are_those_of_lists():
    words = ["", "aaaaa", "abab", "é日", "aaaa", "b"]
    freqs = np.array([3, 1, 2, 5, 7, 1])
    marked = bt._marked(pa.array(["zz", *words], pa.string()).slice(1))
    assert marked.tolist() == [x for w in words for x in (32, *w.encode(), bt.END)]
    merges = [("a", "a"), ("a", "b"), ("aa", "aa")]
    number = {c: i for i, c in enumerate(B)}
    now = [(number[a], number[b], number.setdefault(a + b, len(number))) for a, b in merges]
    names = list(number)
    lists = [[bpe.MARK, *(B[x] for x in w.encode())] for w in words]
    for m in merges:
        lists = [bpe.merge(x, m) for x in lists]
    got = bt.merged(marked, now)
    assert [names[i] if i >= 0 else None for i in got] == [x for w in lists for x in (*w, None)]
    expected = {}
    for w, f in zip(lists, freqs.tolist()):
        for p in zip(w, w[1:]):
            expected[p] = expected.get(p, 0) + f
    codes, sums = bt.counted(got, freqs)
    assert {(names[c >> 32], names[c & 0xFFFFFFFF]): n for c, n in zip(codes.tolist(), sums.tolist())} == expected
    some, their = bt.touched(marked, freqs, now[:2])
    assert their.tolist() == [1, 2, 7] and some.tolist() == [x for w in ("aaaaa", "abab", "aaaa") for x in (32, *w.encode(), bt.END)]


@pytest.mark.parametrize("size", [40, 1 << 20])
def test_training_over_many_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(bt, "BLOCK", size)
    monkeypatch.setattr(bt, "PENDING", 3)
    rng = random.Random(size)
    own = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))): rng.randrange(1, 6) for _ in range(80)}
    df = spark.createDataFrame(list(own.items()), "word string, freq long").repartition(3)
    assert [x[:2] for x in bt.train(df, 14)] == bpe.learn(own, 14)


def test_training_takes_no_plan_that_grows_with_the_merges(spark):
    """Words are not rewritten by a chain of replacements, which each condition on a pair would repeat."""
    df = spark.createDataFrame([("abab", 2)], "word string, freq long")
    base = bt.blocks(df)
    many = [(97, 98, 256 + k) for k in range(24)]
    size = [len(bt.pairs(base, many[:n], many[:n])._jdf.queryExecution().optimizedPlan().toString()) for n in (1, 24)]
    assert size[1] < 1.1 * size[0]
