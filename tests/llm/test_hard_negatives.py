import math
import random

import duckdb
import numpy as np
import pytest

from tessera.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<{}>, score long, uid string, slot int, block int"


def brute(rows):
    """All pairs in Python's integers; rows are told apart by place."""
    fit = []
    for i, label, v, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        fit.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    for i, label, v in fit:
        if i % 100:
            continue
        scored = [(-min(max(sum(a * b for a, b in zip(v, w)), -(2**63)), 2**63 - 1), j, other) for j, other, w in fit if len(w) == len(v)]
        positives = sorted(x[:2] for x in scored if x[2] == label and x[1] != i)[:5]
        for p, j in positives:
            inside = sorted(x[:2] for x in scored if x[2] != label and 30 * -p <= 100 * -x[0] <= 90 * -p)[:10]
            out += [(i, j, rank, n, -p, -s) for rank, (s, n) in enumerate(inside, 1)]
    return sorted(out)


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, 1, "u", 2, 3) for r in rows], SCHEMA.format(kind)).repartition(3)


def run(spark, rows, kind="float", **more):
    part = hn.taking_part(frame(spark, rows, kind))
    return sorted(tuple(r) for r in hn.mine(part, part.filter("vec_id % 100 = 0"), **more).collect())


def random_rows(n, dim, seed, values=(-1.0, -0.5, 0.0, 0.25, 0.75, 1.0)):
    rng = random.Random(seed)
    return [(i, 3 if rng.random() < 0.4 else rng.randrange(10), [rng.choice(values) for _ in range(dim)]) for i in range(n)]


def test_ties_and_a_hot_label_against_all_pairs(spark, monkeypatch):
    rows = random_rows(420, 6, 1)  # few values: most scores are tied
    want = brute(rows)
    assert len(want) > 100 and run(spark, rows) == want
    monkeypatch.setattr(hn, "TILE", 50)
    monkeypatch.setattr(hn, "FIRST_COLUMNS", 2)
    assert run(spark, rows, block_bytes=200) == want


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = random_rows(230, 4, 2) + [(None, 1, [1.0] * 4), (300, None, [1.0] * 4), (400, 1, None), (500, 1, [1.0, None, 1.0, 1.0]), (601, 1, [nan] * 4), (602, 1, [inf, 1.0, 1.0, 1.0]), (700, 3, []), (701, 3, []), (800, 3, [1.0] * 5), (900, 2, [0.0] * 4), (-100, 3, [1.0] * 4), (-7, 3, [0.75] * 4)]
    rows += rows[:3]  # repeated rows, an anchor among them
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == [] and run(spark, [(1, 1, [1.0])]) == []


@pytest.mark.parametrize("large", [3e5, 4e6, 1e12, 1e300])
def test_products_beyond_float64_stay_exact(spark, large):
    rng = random.Random(4)
    rows = [(i, i % 2, [rng.uniform(-1, 1) * large, rng.uniform(-1, 1), rng.uniform(0, large) if i % 3 else 1.0]) for i in range(205)]
    got = run(spark, rows, "double")
    assert got == brute(rows)


def test_window_equals_its_definition():
    p = np.array([-11, -1, 0, 1, 7, 10, 11, 33, 1001, 2**62 - 1], np.int64)
    for value, low, high in zip(p.tolist(), *(x.tolist() for x in hn.window(p))):
        assert low == -(-30 * value // 100) and high == 90 * value // 100


def test_whole_table_against_sql(spark, sf_dir):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = sorted(db.sql(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({hn.oracle()})").fetchall())
    assert want and sorted(tuple(r) for r in hn.query(spark, sf_dir).collect()) == want
