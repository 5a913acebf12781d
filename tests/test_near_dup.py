import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import dedup, near_dup


def sets(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def truth(texts, threshold):
    """The least key that links reach, by all pairs."""
    own = [sets(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(own)):
        for j in range(i):
            if own[i] and len(own[i] & own[j]) >= threshold * len(own[i] | own[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def test_clusters_are_those_of_all_pairs(spark):
    rng = random.Random(2)
    texts = [None, "", " \n", "one", "one", "two words", "two  words"]
    for _ in range(12):
        base = [rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(160)]
        for _ in range(5):  # chains: each copy is an edit of the one before
            base = list(base)
            base[rng.randrange(160)] = "edit" + str(rng.random())
            texts.append(" ".join(base))
    texts += [texts[10]] * 30  # a hot group of copies
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "id long, text string, words string, node int")
    want = truth(texts, 0.8)
    got = {r["id"]: r for r in near_dup.clusters(df, "id").collect()}
    assert len(got) == len(texts) and all(r["n_shingles"] == len(sets(texts[i])) for i, r in got.items())
    missed = sum(got[i]["cluster"] != want[i] for i in got)
    assert missed <= 0.02 * len(texts)
    assert all(want[got[i]["cluster"]] == want[i] for i in got)  # nothing is joined that should not be


def test_awkward_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (2, "x"), (3, "x"), (4, None)], "id long, text string")
    got = sorted((r["id"] or -1, r["cluster"] or -1) for r in near_dup.clusters(df, "id").collect())
    assert got == [(-1, -1), (1, 1), (2, 1), (2, 1), (3, 1), (4, 4)]  # both rows of 2 are one node
    assert near_dup.clusters(df.limit(0), "id").count() == 0
    with pytest.raises(ValueError):
        near_dup.clusters(df, "id", threshold=0)
    with pytest.raises(NotImplementedError):
        dedup.near_duplicate_clusters(df)


def test_components_of_paths_stars_and_noise(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    got = {r["node"]: r["root"] for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == root
    assert near_dup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bands_meet_the_recall_at_the_threshold():
    for threshold in (0.5, 0.8, 0.95, 1.0):
        r = near_dup.rows_per_band(128, threshold)
        assert 1 - (1 - threshold**r) ** (128 // r) >= near_dup.RECALL


def test_signatures_estimate_the_similarity(spark):
    rows = [("a", list(range(100))), ("b", list(range(20, 120)))]
    got = {r["k"]: r["s"] for r in spark.createDataFrame(rows, "k string, h array<long>").select("k", near_dup.signature(F.col("h"), 512).alias("s")).collect()}
    assert abs(sum(x == y for x, y in zip(got["a"], got["b"])) / 512 - 80 / 120) < 0.08
