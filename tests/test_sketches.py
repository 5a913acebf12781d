import random

import pytest

from tessera.operators import sketches


def test_merged_sketches_stay_within_their_error(spark, tmp_path):
    rng = random.Random(1)
    path = str(tmp_path / "table")
    lengths, keys, empty = [], set(), 0
    for shard in range(4):
        texts = [None, " "] + [f"w{rng.randrange(3000)} " * int(rng.paretovariate(1.2)) for _ in range(1500)]
        sketches.append(spark.createDataFrame([(f"s{shard}", t) for t in texts], "shard string, text string"), path, "shard")
        good = [t for t in texts if t and t.strip()]
        lengths += map(len, good)
        keys |= {" ".join(t.split()) for t in good}
        empty += len(texts) - len(good)
    table = sketches.read(spark, path)
    assert table.count() == 4
    r = sketches.merged(table).first()
    assert (r["documents"], r["characters"], r["empty_documents"], r["min_length"], r["max_length"]) == (len(lengths), sum(lengths), empty, min(lengths), max(lengths))
    assert abs(r["unique_texts"] / len(keys) - 1) < 4 * 0.016
    lengths.sort()
    for name, q in sketches.QUANTILES.items():
        low, high = (sum(x < r[f"{name}_length"] for x in lengths) / len(lengths), sum(x <= r[f"{name}_length"] for x in lengths) / len(lengths))
        assert low - 0.02 <= q <= high + 0.02, (name, low, q, high)
    # a shard is added from its own rows, and not twice
    with pytest.raises(ValueError, match="already"):
        sketches.append(spark.createDataFrame([("s1", "x")], "shard string, text string"), path, "shard")
    assert {r["shard"]: r["documents"] for r in sketches.merged(table, "shard").collect()} == {r["shard"]: r["documents"] for r in table.collect()}


def test_empty_and_blank_shards(spark, tmp_path):
    blank = sketches.sketch(spark.createDataFrame([("a", None), ("a", " ")], "s string, text string"), "s")
    r = sketches.merged(blank).first()
    assert (r["documents"], r["empty_documents"], r["unique_texts"], r["median_length"], r["avg_length"]) == (0, 2, 0, None, None)
    none = sketches.merged(blank.limit(0)).first()
    assert none["documents"] == 0 and none["unique_texts"] == 0
    assert sketches.read(spark, str(tmp_path / "none")) is None
