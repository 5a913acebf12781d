import random

import pytest

from tessera.operators import bpe
from tessera.operators import bpe_training as bt


def words(seed):
    rng = random.Random(seed)
    few = {"aaaa": 5, "aaa": 2, "abab": 7, "ba": 7, "é": 3, "x\x01y": 4, "(1)": 2, "$1": 2, "日本": 1}
    return few | {"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 8))): rng.randrange(1, 6) for _ in range(60)}


@pytest.mark.parametrize(("seed", "top"), [(1, 3), (2, 512)])
def test_merges_are_those_of_one_at_a_time(spark, monkeypatch, seed, top):
    monkeypatch.setattr(bt, "TOP", top)
    monkeypatch.setattr(bt, "PENDING", 5)
    own = words(seed)
    df = spark.createDataFrame(list(own.items()), "word string, freq long").coalesce(2)
    n = 12 if top == 3 else 40
    rounds = []
    got = bt.train(df, n, rounds)
    assert [x[:2] for x in got] == bpe.learn(own, n)
    assert sum(rounds) == n and len(rounds) < n


def test_all_merges_until_none_is_left(spark):
    own = {"ab": 2, "aab": 1}
    got = bt.train(spark.createDataFrame(list(own.items()), "word string, freq long"), 99)
    assert [x[:2] for x in got] == bpe.learn(own, 99) and len(got) < 9
    assert bt.train(spark.createDataFrame([], "word string, freq long"), 5) == []


def test_a_round_ends_where_the_order_is_open():
    top = [(9, "a", "b"), (8, "c", "d"), (7, "b", "e"), (6, "f", "g")]
    assert bt.certain(top, True, set(), 9) == [("a", "b"), ("c", "d")]  # b e may lose count to a b
    assert bt.certain(top, True, set(), 1) == [("a", "b")]
    assert bt.certain([(9, "a", "a"), (8, "c", "d")], True, set(), 9) == [("a", "a")]
    assert bt.certain([(9, "a", "b"), (8, "c", "d")], True, {"ab"}, 9) == [("a", "b")]
    # x a is as frequent as c d: if every x a stands before b, x ab comes before c d
    assert bt.certain([(9, "a", "b"), (8, "c", "d"), (8, "x", "a")], True, set(), 9) == [("a", "b")]
    assert bt.certain([(9, "a", "b"), (8, "c", "d"), (8, "e", "f")], False, set(), 9) == [("a", "b")]


def test_train_beyond_the_drivers_words(spark):
    df = spark.createDataFrame([("low lower lowest newer wider " * 3,), (None,), ("",)], "text string")
    near, info = bpe.Tokenizer.train(df, 275)
    far, more = bpe.Tokenizer.train(df, 275, driver_words=0)
    assert near.merges == far.merges and info == more and far.encode("lower") == near.encode("lower")
