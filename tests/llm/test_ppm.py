import math
import re
import zlib
from collections import Counter, defaultdict

from tessera.llm import ppm
from tests.llm import cases

HELD = "crc32(cast(doc_id as string)) % 5 = 1"


def padded(text, order):
    return bytes([254]) * order + (text or "").encode() + bytes([255])


class Plain:
    """The same model, symbol by symbol."""

    def __init__(self, texts, order):
        self.order = order
        self.counts = [defaultdict(Counter) for _ in range(order + 1)]
        for t in texts:
            b = padded(t, order)
            for i in range(order, len(b)):
                self.counts[order][b[i - order : i]][b[i]] += 1
        for j in range(order - 1, -1, -1):
            for context, symbols in self.counts[j + 1].items():
                for s in symbols:
                    self.counts[j][context[1:]][s] += 1

    def log10(self, text):
        b, total = padded(text, self.order), 0.0
        for i in range(self.order, len(b)):
            excluded: set = set()
            for j in range(self.order, -1, -1):
                here = self.counts[j].get(b[i - j : i])
                if not here:
                    continue
                t = sum(c for s, c in here.items() if s not in excluded)
                if b[i] in here:
                    total += math.log10((here[b[i]] - 0.5) / t)
                    break
                q = sum(s not in excluded for s in here)
                if q:
                    total += math.log10(0.5 * q / t)
                excluded = set(here)
            else:
                total -= math.log10(255 - len(excluded))
        return total


def test_scores_match_the_plain_model(spark):
    texts = cases.TEXTS[:8] + ["the cat", "zebra the", "ça va où?", "the the the", "a rat on a mat"] * 2
    df = cases.documents(spark, texts)
    rows = df.collect()
    held = lambda r: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1
    for order in (1, 3):
        model = Plain([r["text"] for r in rows if not held(r)], order)
        got = ppm.score(df, HELD, order=order, chunk_bytes=200).collect()
        text = {r["doc_id"]: r["text"] for r in rows}
        assert len(got) == len(rows) and any(r["held_out"] for r in got)
        for r in got:
            assert abs(r["score"] - model.log10(text[r["doc_id"]])) < 1e-6 * max(1, -r["score"]), text[r["doc_id"]]


def test_baseline(spark):
    df = cases.documents(spark)
    rows = df.collect()
    words = lambda x: re.findall("[^\x20\x09-\x0d]+", (x or "").translate({c: c + 32 for c in range(65, 91)})) + [None]
    count = Counter(w for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 != 1 for w in words(r["text"]))
    n, v = sum(count.values()), len(count)
    text = {r["doc_id"]: r["text"] for r in rows}
    for r in ppm.score(df, HELD, order=2).collect():
        own = words(text[r["doc_id"]])
        assert r["train_tokens"] == n and r["n_tokens"] == len(own) and r["n_known"] == sum(count[w] > 0 for w in own)
        assert abs(r["base_score"] - sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)) < 1e-6 * len(own)


def test_probabilities_add_up_to_one():
    model = Plain(["abab", "abc"], 2)
    from itertools import product

    seen = sum(10 ** model.log10("".join(p)) for n in range(4) for p in product("abc", repeat=n))
    assert 0.3 < seen <= 1 + 1e-9


def test_tables_without_rows(spark):
    assert ppm.score(cases.empty(spark), HELD).count() == 0
    alone = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    r = ppm.score(alone, "true").first()
    assert r["train_tokens"] == 0 and abs(r["score"] + 3 * math.log10(255)) < 1e-9
