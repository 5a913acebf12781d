import random

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.operators import bpe


def texts(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aab cdé日\x00") for _ in range(rng.randrange(0, 9))) for _ in range(200)] + ["a" * k for k in range(12)]
    return [None, "", " \n　", *(" ".join(rng.choice(words) for _ in range(rng.randrange(0, 30))) for _ in range(n))]


def tokenizers():
    counts = {w: i % 5 + 1 for i, w in enumerate(" ".join(x or "" for x in texts(1)).split())}
    yield bpe.Tokenizer(bpe.learn(counts, 60))
    yield bpe.Tokenizer([])
    # an earlier merge takes what a later one makes; a symbol made twice; a merge of nothing known; a pair given twice
    yield bpe.Tokenizer([("ab", "a"), ("b", "a"), ("a", "b"), ("aba", "a"), ("a", "ba"), ("zzz", "y"), ("a", "a"), ("aa", "a"), ("aa", "aa"), ("a", "b")])
    rng = random.Random(7)
    made = ["a", "b", "c", "d", bpe.MARK]
    merges = []
    for _ in range(40):
        merges.append((rng.choice(made), rng.choice(made)))
        made.append("".join(merges[-1]))
    rng.shuffle(merges)
    yield bpe.Tokenizer(merges)


def test_all_words_at_once_as_one_at_a_time():
    for tokenizer in tokenizers():
        for seed in (1, 2, 3):
            own = texts(seed)
            for bos, eos in ((False, False), (True, False), (False, True), (True, True)):
                whole = pa.array(["x y", *own], pa.string())
                for given in (pa.array(own, pa.string()), whole.slice(1), pa.array([], pa.string())):
                    assert tokenizer.encode_texts(given, bos, eos).to_pylist() == [None if x is None else tokenizer.encode(x, bos, eos) for x in given.to_pylist()]


def test_column(spark):
    tokenizer = bpe.Tokenizer([("a", "b")])
    out = spark.createDataFrame([("abab b",), (None,), ("",)], "text string").select(tokenizer.encode_column(F.col("text"), spark, add_eos=True).alias("ids"))
    assert [r["ids"] for r in out.collect()] == [tokenizer.encode("abab b", add_eos=True), None, [bpe.EOS]]
