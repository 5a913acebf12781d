import random
import re

import corpus_pipeline as cp
from tessera.llm import kneser_ney, quality_rules

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _corpus(rng):
    """Documents of lines: own ones, lines that others share or nearly share, whole copies, null and empty texts."""
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(4, 9))) for _ in range(900)]

    def line():
        return " ".join(rng.choice(words) for _ in range(20))

    shared = [line() for _ in range(4)]
    texts = ["\n".join([line() for _ in range(rng.randrange(3, 6))] + rng.sample(shared, rng.randrange(0, 3))) for _ in range(40)]
    texts += [x.replace("a", "A") + "." for x in texts[:4]]
    near = texts[5].split("\n")
    near[0] = near[0][:-1] + ("y" if near[0][-1] == "z" else "z")
    return [*texts, "\n".join(near), texts[7], None, "", "...", texts[9] + "\n" + line()]


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _groups(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(n):
        for b in range(a + 1, n):
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(i) for i in range(n)]


def _brute_lines(rows):
    """Line dedup by all pairs of lines: the first of each group in (doc_id, line) stays."""
    lines = [(i, k, re.sub("[^a-z0]+", " ", re.sub("[0-9]+", "0", part.lower())).strip()) for i, text in rows if text is not None for k, part in enumerate(text.split("\n"))]
    lines = [x for x in lines if x[2]]
    distinct = sorted({x[2] for x in lines})

    def linked(a, b):
        x, y = distinct[a], distinct[b]
        most = max(len(x), len(y))
        apart = sum(abs(x.count(c) - y.count(c)) for c in set(x + y))
        return 10 * abs(len(x) - len(y)) <= most and 5 * apart <= most and 10 * _distance(x, y) <= most

    root = dict(zip(distinct, _groups(len(distinct), linked), strict=True))
    seen, gone = set(), set()
    for i, k, norm in sorted(lines):
        if root[norm] in seen:
            gone.add((i, k))
        seen.add(root[norm])
    return {i: text if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (i, k) not in gone) for i, text in rows}


def _brute_copies(rows):
    """Ids that stay after the Jaccard join, by all pairs of sets of shingles."""
    def shingles(text):
        w = re.findall(r"[^ \t-\r]+", (text or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(text) for _, text in rows]
    roots = _groups(len(rows), lambda a, b: bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    return {rows[k][0] for k, r in enumerate(roots) if r == k}


def test_line_dedup_join_and_packing_against_brute_force(spark, sf_dir):
    rows = list(enumerate(_corpus(random.Random(8))))
    docs = spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in rows], COLUMNS)
    stages = dict(cp.STAGES)
    got = {r["doc_id"]: r["text"] for r in stages["line dedup"](spark, docs, sf_dir).collect()}
    assert got == _brute_lines(rows)
    assert any(x == "" for i, x in got.items() if rows[i][1]) and any(got[i] != x for i, x in rows)
    for given in (rows, list(got.items())):  # the join on its own input and after line dedup
        given = sorted(given)
        df = spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in given], COLUMNS)
        joined = stages["n-gram Jaccard join"](spark, df, sf_dir)
        left = {r["doc_id"]: r["text"] for r in joined.collect()}
        assert left == {i: x for i, x in given if i in _brute_copies(given)}
    pieces = stages["packing"](spark, joined, sf_dir).collect()
    total = {}
    for r in pieces:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert set(total) == set(left) and all(total[r["doc_id"]] == r["doc_tokens"] for r in pieces)
    ends = {}
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 2048


def test_filters_take_effect_row_by_row(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r["doc_id"] for r in kneser_ney.classify(docs, labels).collect() if r["kept"]}
    out = cp.STAGES[0][1](spark, docs, sf_dir).collect()
    assert sorted(map(tuple, out), key=str) == sorted((tuple(r) for r in docs.collect() if r["doc_id"] in kept), key=str)
    kept = {r["doc_id"] for r in quality_rules.judge(docs, labels).collect() if r["kept"]}
    out = cp.STAGES[1][1](spark, docs, sf_dir).collect()
    assert sorted(map(tuple, out), key=str) == sorted((tuple(r) for r in docs.collect() if r["doc_id"] in kept), key=str)


def test_empty_tables_and_clashing_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = ("version", "_id", "_version", "key", "kept", "root")
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
    wide = spark.createDataFrame([(1, "some words of a text", "en", "s", 20, *names)], COLUMNS + "".join(f", {x} string" for x in names))
    for name, stage in cp.STAGES[:4]:
        out = stage(spark, wide, sf_dir)
        assert out.columns == wide.columns and all(tuple(r) == tuple(wide.first()) for r in out.collect()), name


def test_stages_over_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.count()
    for name, stage in cp.STAGES[:4]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        path = cp.shared_folder(spark)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        n = docs.count()
        assert 0 < n <= before and docs.select("doc_id").distinct().count() == n, name
        assert n < before or name != "quality classifier", name
        before = n
    packed = cp.STAGES[4][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == before


def test_queries_are_registered():
    import __spark_entry__ as e

    names = [*e.queries()]
    assert "pipeline" in names and {n.split("_")[0] for n in names} >= {f"op{k}" for k in range(1, 11)}
    assert set(e.oracle_sql()) <= set(names)
