import random
import tracemalloc
import types

import numpy as np
import pyarrow as pa
import pyspark

from tessera.llm import _grams as gr


def scanned(monkeypatch, texts, train, chunk_bytes):
    """What the function that scan() gives to mapInArrow makes of texts, and its peak of memory in bytes."""
    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(lambda: types.SimpleNamespace(partitionId=lambda: 3)))
    frame = types.SimpleNamespace(select=lambda *_: types.SimpleNamespace(mapInArrow=lambda run, schema: run))
    run = gr.scan(frame, 4, 16, chunk_bytes=chunk_bytes)

    def batches():
        for a in range(0, len(texts), 100):
            own = texts[a : a + 100]
            yield pa.RecordBatch.from_arrays([pa.array(range(a, a + len(own)), pa.int64()), pa.array(own), pa.array(["t"] * len(own)), pa.array(train[a : a + 100])], names=["doc_id", "text", "tag", "train"])

    tracemalloc.start()
    rows = [r for batch in run(batches()) for r in batch.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return rows, peak


def test_a_chunk_is_counted_in_memory_of_its_distinct_ngrams(monkeypatch):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=1500)) for _ in range(900)]
    train = [i % 3 == 0 for i in range(len(texts))]
    rows, peak = scanned(monkeypatch, texts, train, 16 << 20)
    size = sum(map(len, texts))
    assert size > 8 << 20 and peak < 5 * size
    found = [gr.unpack(r["blob"]) for r in rows if r["kind"] == 1]
    got = dict(zip(np.concatenate([k for k, _ in found]).tolist(), np.concatenate([c for _, c in found]).tolist(), strict=True))
    grams, _ = gr.byte_grams(pa.array([x for x, own in zip(texts, train, strict=True) if own]), 4)
    k, c = np.unique(grams, return_counts=True)
    held = dict.fromkeys(np.unique(gr.byte_grams(pa.array(texts), 4)[0]).tolist(), 0) | dict(zip(k.tolist(), c.tolist(), strict=True))
    assert got == held and sum(c == 0 for c in got.values()) > 0
    assert [d for r in rows if r["kind"] == 0 for d in r["doc_ids"]] == list(range(len(texts)))
