import random

from pyspark.sql import functions as F

from tessera.operators import near_dup


def test_signatures_agree_as_often_as_sets_overlap(spark):
    """Of 512 functions, sets of Jaccard similarity 0.6 agree in about that share; a function's least value is of the set."""
    rng = random.Random(3)
    rows = []
    for k in range(40):
        x = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(400)]
        rows.append((k, x[:320], x[80:]))
    rows.append((40, None, []))
    df = spark.createDataFrame(rows, "k int, a array<long>, b array<long>")
    got = df.select("k", near_dup.signature(F.col("a"), 512).alias("a"), near_dup.signature(F.col("b"), 512).alias("b")).collect()
    shares = [sum(x == y for x, y in zip(r["a"], r["b"])) / 512 for r in got if r["k"] < 40]
    assert all(len(r["a"]) == 512 for r in got if r["k"] < 40) and [r["a"] for r in got if r["k"] == 40] == [None]
    assert abs(sum(shares) / 40 - 0.6) < 0.02 and min(shares) > 0.45
