import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import tables
from tessera.functions import text as tx
from tessera.functions.patterns import Patterns
from tessera.operators import bloom, dedup


def test_bloom_filters_never_miss_and_seldom_err(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("h"))
    made = bloom.build(keys, 0.01)
    own = np.array([r[0] for r in keys.collect()], np.int64)
    assert made.holds(own.view(np.uint64)).all()
    rng = np.random.default_rng(1)
    assert made.holds(rng.integers(0, 2**64, 50_000, dtype=np.uint64)).mean() < 0.02
    assert not bloom.build(keys.limit(0)).holds(own[:9].view(np.uint64)).any()
    checked = keys.union(spark.sql("select cast(null as bigint)")).select(bloom.may_hold(made, F.col("h"), spark).alias("m"), "h").collect()
    assert all(r["m"] == (r["h"] is not None) for r in checked)


def test_overlap_with_a_filter_is_that_without(spark, monkeypatch):
    b = spark.createDataFrame([(i, None if i % 50 == 0 else f"text  {i % 400}", "x") for i in range(1000)], "id long, text string, h string")
    a = spark.createDataFrame([(None,), ("text 3",), ("text 3 ",), ("text 77",), ("none of these",)], "text string")
    for f in (dedup.overlap, dedup.without):
        plain = sorted(tuple(r) for r in f(a, b).collect())
        assert sorted(tuple(r) for r in f(a, b, false_hits=0.01).collect()) == plain and f(a, b, false_hits=0.01).columns == b.columns
        assert sorted(tuple(r) for r in f(a.limit(0), b, false_hits=0.01).collect()) == sorted(tuple(r) for r in f(a.limit(0), b).collect())
        monkeypatch.setattr(bloom, "MAX_BYTES", 0)
        assert sorted(tuple(r) for r in f(a, b, false_hits=0.01).collect()) == plain
        monkeypatch.undo()
    # of the large side only what may match reaches the shuffle
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = dedup.overlap(a, b, false_hits=0.001)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and found.count() == 6
        written = found._jdf.queryExecution().toRdd().count()
        assert written == 6
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_patterns_against_plain_search(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abé ") for _ in range(rng.randrange(1, n)))
    listed = list(dict.fromkeys(word(5) for _ in range(40)))
    texts = [None, "", *[word(60) for _ in range(80)], "zzz"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    p, t = Patterns(spark, listed), F.col("t")
    for r in df.select("t", p.found(t).alias("f"), p.occurrences(t).alias("n"), p.holds(t).alias("h"), p.first(t).alias("a"), p.cut(t).alias("c")).collect():
        x = r["t"]
        if x is None:
            assert list(r) == [None] * 6
            continue
        at = min((x.find(w) for w in listed if w in x), default=-1)
        assert r["f"] == [k for k, w in enumerate(listed) if w in x] and r["h"] == bool(r["f"]) and r["a"] == at
        assert r["n"] == sum(x.startswith(w, i) for w in listed for i in range(len(x))) and r["c"] == (x if at < 0 else x[:at])
    none = df.select(Patterns(spark, []).found(t).alias("f"), Patterns(spark, []).cut(t).alias("c"), "t").collect()
    assert all(r["f"] == (None if r["t"] is None else []) and r["c"] == r["t"] for r in none)
    for bad in (["a", ""], ["a", "a"]):
        with pytest.raises(ValueError):
            Patterns(spark, bad)


def test_table_functions(spark):
    tables.register(spark)
    texts = [None, "", "Short. A sentence of some length. Another one, longer!  And  http://x.y/z gone [12] here? tail of it", "a b. " * 40, "x" * 300 + ". enough words here"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    df.createOrReplaceTempView("some_texts")
    got = spark.sql("SELECT i, s.place, s.sentence FROM some_texts, LATERAL sentences_of(text) s").collect()
    want = {r["i"]: r["s"] or [] for r in df.select("i", tx.sentences(F.col("text")).alias("s")).collect()}
    assert {i: [r["sentence"] for r in sorted(got, key=lambda r: r["place"]) if r["i"] == i] for i in want} == want
    rows = [(1, 0, [1, 2, 3]), (1, 1, None), (1, 2, [4, 5]), (2, 0, [9]), (3, 0, []), (None, 0, [7, 8])]
    spark.createDataFrame(rows, "k long, at int, ids array<int>").createOrReplaceTempView("some_ids")
    got = spark.sql("SELECT * FROM chunks_of(TABLE(SELECT k, at, ids FROM some_ids) PARTITION BY k ORDER BY (at), 2)").collect()
    assert sorted((r["key"] or 0, r["chunk"], r["input_ids"]) for r in got) == [(0, 0, [7, 8]), (1, 0, [1, 2]), (1, 1, [3, 4]), (1, 2, [5]), (2, 0, [9])]
