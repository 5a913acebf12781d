import numpy as np
import pytest

from tessera.operators import attention


def plain(q, k, v, causal):
    s = q @ k.T / np.sqrt(q.shape[1])
    if causal:
        s = np.where(np.tri(len(q), dtype=bool), s, -np.inf)
    w = np.exp(s - s.max(axis=1, keepdims=True))
    return w @ v / w.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("causal", [True, False])
def test_blocks_give_what_the_whole_gives(spark, causal):
    rng = np.random.default_rng(1)
    n = 75
    q, k, v = rng.normal(0, 4, (n, 6)), rng.normal(0, 4, (n, 6)), rng.normal(size=(n, 3))
    k[5] *= 60  # scores far apart: exponentials need the greatest taken off
    df = spark.createDataFrame([(i, q[i].tolist(), k[i].tolist(), v[i].tolist(), "x") for i in range(n)], "pos long, a array<double>, b array<double>, c array<double>, block string").repartition(3)
    want = plain(q, k, v, causal)
    for block in (8, 100):
        got = {r["pos"]: r["out"] for r in attention.attend(df, "pos", "a", "b", "c", causal=causal, block=block).collect()}
        assert len(got) == n and all(np.allclose(got[i], want[i], atol=1e-12) for i in range(n))
    late = {r["pos"]: r["out"] for r in attention.attend(df, "pos", "a", "b", "c", causal=causal, since=60, block=8).collect()}
    assert sorted(late) == list(range(60, n)) and all(np.allclose(late[i], want[i], atol=1e-12) for i in late)
    assert attention.attend(df.limit(0), "pos", "a", "b", "c", causal=causal).count() == 0
