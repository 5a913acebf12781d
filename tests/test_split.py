import random

from tessera.operators import split


def ranks(n, seed=42):
    places = list(range(n))
    random.Random(seed).shuffle(places)
    return places


def test_seeded_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(split, "BLOCK_ROWS", 7)
    got = split.seeded(spark.range(50).toDF("i"), "i").orderBy("split_rank").collect()
    assert [r["i"] for r in got] == ranks(50)
    assert [r["split"] for r in got] == ["train"] * 40 + ["val"] * 5 + ["test"] * 5


def test_seeded_beyond_two_million_rows(spark):
    n = 2_000_003
    got = split.seeded(spark.range(n).toDF("i"), "i")
    expected = ranks(n)
    assert {r["split"]: r["count"] for r in got.groupBy("split").count().collect()} == {"train": n - 400_000, "val": 200_000, "test": 200_000}
    assert {(r["i"], r["split_rank"]) for r in got.filter("i % 100003 = 5").collect()} == {(i, k) for k, i in enumerate(expected) if i % 100003 == 5}
