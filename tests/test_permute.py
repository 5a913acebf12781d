from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.operators import permute, split


def by_hand(x, n, seed, epoch):
    for k in permute.round_keys(seed, epoch):
        partner = (k["key"] % n - x) % n
        larger = max(x, partner)
        t = (larger % permute.PRIME * k["a"] + (larger >> 31) * k["b"] + k["c"]) % permute.PRIME
        if (t * t + k["d"]) % permute.PRIME * k["e"] % permute.PRIME >> 15 & 1:
            x = partner
    return x


@pytest.mark.parametrize("n", [1, 2, 3, 7, 1000])
def test_bijection_of_any_size(spark, n):
    for seed, epoch in ((42, 0), (42, 1), (7, 0)):
        got = spark.range(n).select("id", permute.position(F.col("id"), n, seed, epoch).alias("p")).collect()
        assert sorted(r["p"] for r in got) == list(range(n))
        assert all(r["p"] == by_hand(r["id"], n, seed, epoch) for r in got) or n == 1


def test_large_domains_do_not_overflow(spark):
    for n in (2**31, 2**40 + 3, 2**61):
        ids = [0, 1, n // 2, n - 2, n - 1]
        got = spark.createDataFrame([(i,) for i in ids], "i long").select("i", permute.position(F.col("i"), n, 1).alias("p")).collect()
        assert all(r["p"] == by_hand(r["i"], n, 1, 0) and 0 <= r["p"] < n for r in got) and len({r["p"] for r in got}) == 5


def test_places_look_random(spark):
    n = 4000
    got = [r[0] for r in spark.range(n).select(permute.position(F.col("id"), n, 3)).collect()]
    cells = Counter((i * 8 // n, p * 8 // n) for i, p in enumerate(got))
    expected = n / 64
    assert sum((cells[a, b] - expected) ** 2 / expected for a in range(8) for b in range(8)) < 90  # 49 degrees of freedom: a chance of 0.0003
    up = sum(a < b for a, b in zip(got, got[1:]))
    assert abs(up - n / 2) < 4 * (n / 12) ** 0.5


def test_null_and_outside(spark):
    df = spark.createDataFrame([(None,), (3,)], "i long")
    assert [r[0] for r in df.filter("i is null").select(permute.position(F.col("i"), 3, 1)).collect()] == [None]
    with pytest.raises(PySparkException):
        df.select(permute.position(F.col("i"), 3, 1)).collect()


def test_epochs_and_readers(spark):
    df = spark.createDataFrame([(f"row{i:03d}", i, -i) for i in range(50)], "key string, index long, made long")
    rows = permute.epochs(df, "key", n_epochs=3).cache()
    assert rows.columns == ["key", "index", "made", "epoch", "position"]
    seen = {e: {r["key"]: r["position"] for r in rows.filter(F.col("epoch") == e).collect()} for e in range(3)}
    assert all(sorted(x.values()) == list(range(50)) for x in seen.values()) and seen[0] != seen[1] != seen[2]
    parts = [permute.reader(rows, 50, 8, k).count() for k in range(8)]
    assert parts == [6 * 3] * 8
    filled = [permute.reader(rows, 50, 8, k, drop_last=False).collect() for k in range(8)]
    assert [len(x) for x in filled] == [7 * 3] * 8
    again = Counter((r["epoch"], r["key"]) for x in filled for r in x)
    assert all(again[e, k] == (2 if p < 6 else 1) for e, own in seen.items() for k, p in own.items())
    few = df.limit(3)
    assert sum(permute.reader(permute.epochs(few, "key", n_epochs=1), 3, 8, k, drop_last=False).count() for k in range(8)) == 8
    assert permute.epochs(df.limit(0), "key", n_epochs=2).count() == 0
    with pytest.raises(ValueError):
        permute.reader(rows, 50, 8, 8)


def test_splits_keep_columns_of_any_name(spark):
    df = spark.createDataFrame([(i, f"h{i}", i + 1, i + 2) for i in range(40)], "k long, _hash string, _index long, index long")
    for found in (split.keyed(df, "k"), split.by_hash(df, "k"), split.seeded(df, "k")):
        assert found.columns == [*df.columns, "split_rank", "split"]
        rows = found.collect()
        assert sorted(r["split_rank"] for r in rows) == list(range(40)) and all((r["_hash"], r["_index"], r["index"]) == (f"h{r['k']}", r["k"] + 1, r["k"] + 2) for r in rows)
        assert Counter(r["split"] for r in rows) == {"train": 32, "val": 4, "test": 4}
