import random
import re

from tessera.llm import components as cc
from tessera.llm import jaccard_join as j
from tests.llm import cases

WORD = re.compile("[^\x20\x09-\x0d]+")


def sets(texts):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = []
    for text in texts:
        w = WORD.findall((text or "").translate(lower))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def brute(ids, texts, percent=75):
    found = sets(texts)
    root = list(range(len(ids)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in range(len(ids)):
        for y in range(x):
            if found[x] and found[y]:
                o = len(found[x] & found[y])
                if 100 * o >= percent * (len(found[x]) + len(found[y]) - o):
                    root[top(x)] = top(y)
    least = {}
    for i in range(len(ids)):
        least[top(i)] = min(ids[i], least.get(top(i), ids[i]))
    return sorted((ids[i], len(found[i]), least[top(i)]) for i in range(len(ids)))


def compare(spark, ids, texts, **options):
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    assert sorted(map(tuple, j.near_duplicates(df, **options).collect())) == brute(ids, texts, options.get("percent", 75))


def test_random_edits(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(25):
        base = [rng.choice("abcdefgh") * rng.randrange(1, 4) + str(rng.randrange(30)) for _ in range(rng.randrange(5, 60))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                k = rng.randrange(len(copy))
                copy[k : k + 1] = rng.choice([[], ["new"], [copy[k].upper(), "x"]])
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    compare(spark, list(range(100, 100 + len(texts))), texts)
    compare(spark, list(range(100, 100 + len(texts))), texts, chunk_bytes=700, percent=60)


def test_a_chain_is_one_group_and_a_shared_passage_is_not(spark):
    words = [f"w{i}" for i in range(140)]
    chain = [" ".join(words[i * 4 : i * 4 + 60]) for i in range(12)]
    passage = " ".join(f"p{i}" for i in range(55))
    apart = [" ".join(f"q{k}x{i}" for i in range(50)) + " " + passage for k in range(12)]
    compare(spark, list(range(24)), chain + apart)


def test_awkward_rows(spark):
    df = cases.documents(spark)
    rows = df.collect()
    ids, texts = [r["doc_id"] for r in rows], [r["text"] for r in rows]
    assert sorted(map(tuple, j.near_duplicates(df).collect())) == brute(ids, texts)
    assert j.near_duplicates(cases.empty(spark)).count() == 0


def test_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    compare(spark, [r["doc_id"] for r in rows], [r["text"] for r in rows])


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = dict(map(tuple, cc.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 130))
