import numpy as np

from tessera.llm import projection_forest as pf


def clusters(seed=1, dims=32):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((40, dims))
    rows = [rng.standard_normal(dims) for _ in range(600)]
    for k, c in enumerate(centres):
        rows += [c + rng.standard_normal(dims) * rng.choice([0.05, 0.2, 0.3]) for _ in range(3 + 4 * (k % 5))]
    rows += [centres[0] * 2] * 7
    return np.array(rows, dtype=np.float32)[rng.permutation(len(rows))]


def brute(x, similarity=0.9):
    u = pf.unit(x)
    near = u @ u.T >= similarity
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        new = np.array([min(label[i], label[near[i]].min() if near[i].any() else label[i]) for i in range(len(x))])
        if (new == label).all():
            return near.sum(1), label
        label = new


def run(spark, x, **options):
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, pf.near_duplicates(df, **options).collect()))
    return np.array([r[1] for r in got]), np.array([r[2] for r in got]), got


def test_one_leaf_is_brute_force(spark):
    x = clusters()
    links, label = brute(x)
    n, c, got = run(spark, x, leaf_rows=10**6)
    assert (n == links).all() and (c == label).all()
    assert all(r[3] == (r[0] == r[2]) for r in got)


def test_small_leaves_and_blocks_find_nearly_all_and_count_none_twice(spark):
    x = clusters()
    links, _ = brute(x)
    n, _, _ = run(spark, x, leaf_rows=40, block=16)
    assert (n <= links).all() and n.sum() >= 0.95 * links.sum()


def test_awkward_vectors(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [2.0, 0.1]), (10, [1.0, 0.0, 0.0]), (11, [-1.0, 0.0]), (7, [1.0, 0.0]), (None, [1e-30, 0.0]), (12, [3e38, 1.0])]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "vec_id long, embedding array<float>, node string")
    got = {(r[0], r[1], r[2], r[3]) for r in pf.near_duplicates(df).collect()}
    assert {(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 10, 11)} <= got
    assert {(7, 5, 7, True), (8, 5, 7, False), (9, 5, 7, False), (12, 5, 7, False), (None, 5, 7, False)} <= got
    assert pf.near_duplicates(df.limit(0)).count() == 0


def test_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = sorted((r["vec_id"], r["embedding"]) for r in table.collect())
    links, _ = brute(np.array([r[1] for r in rows], dtype=np.float32))
    assert sorted((r[0], r[1]) for r in pf.near_duplicates(table).collect()) == [(r[0], int(n)) for r, n in zip(rows, links)]


def test_double_precision(spark):
    rows = [(1, [1e300, 1e300]), (2, [2e300, 2e300]), (3, [1e-200, 0.0]), (4, [1e-200, 0.0]), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [-1.0, 0.5])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in pf.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), 3: (1, 3, True), 4: (1, 3, False), **{i: (0, i, True) for i in (5, 6, 7, 8)}}
