from collections import Counter
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import filter_audit
from tests.llm import cases

LONG = " ".join(f"word{i % 150}" for i in range(260))
TEXTS = [*cases.TEXTS, LONG, LONG, LONG + "x", "X" + LONG[1:], "a" * 600 + "b" + "c" * 5000, "a" * 600 + "d" + "c" * 5000, None, "ÀB # " * 3, " ".join(f"w{i}" for i in range(200))]


def brute(rows, labels):
    """Every document through every order, one filter after another."""
    least = {}
    for doc, text, _ in rows:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    good, toxic = ({d for d, *v in labels if v[k] == 1 and d is not None} for k in (0, 1))
    out = Counter()
    parts = {lang or "" for _, _, lang in rows}
    fails = []
    for doc, text, lang in rows:
        t = text or ""
        words = t.encode().split()
        f = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
        f += "C" * (100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t)) + "D" * any(c in "#$%&*|" for c in t)
        fails.append((lang or "", f + "E" * (doc is not None and doc > least[t]), doc in good, doc in toxic))
    for order in map("".join, permutations("ABCDE")):
        for step, letter in enumerate(order, 1):
            for part in parts:
                out[part, order, step, "kept"] += 0
            for part, f, g, x in fails:
                earlier, here = any(c in f for c in order[: step - 1]), letter in f
                key = (part, order, step)
                out[*key, "kept"] += not earlier and not here
                out[*key, "removed"] += here and not earlier
                out[*key, "redundant"] += here and earlier
                out[*key, "unique_fails"] += f == letter
                out[*key, "good_lost"] += here and not earlier and g
                out[*key, "toxic_lost"] += here and not earlier and x
    share = Counter()
    for (part, order, step, name), n in out.items():
        if name == "removed":
            share[part, order[step - 1]] += n
    return out, share


def check(got, rows, labels):
    want, share = brute(rows, labels)
    assert len(got) == 600 * len({lang or "" for _, _, lang in rows})
    for r in got:
        for name in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"):
            assert r[name] == want[r["part"], r["filter_order"], r["step"], name], (r, name)
        assert r["shapley"] == share[r["part"], r["filter_order"][r["step"] - 1]]


def awkward(spark):
    rows = cases.rows(TEXTS) + cases.rows(TEXTS)[-3:] + [(None, LONG, "en", "s", 0, "c", 1, 0.5, "c"), (None, LONG, "", "s", 0, "c", 1, 0.5, "c")]
    labels = [(i, i % 2, (i + 1) % 3 // 2) for i in range(0, len(TEXTS), 2)] + [(0, 1, 1), (None, 1, 1), (4, None, 1)]
    return rows, labels, spark.createDataFrame(rows, cases.SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("hashed", ["hashes", "all hashes equal", "classes joined"])
def test_awkward_rows_against_every_order(spark, monkeypatch, hashed):
    if hashed == "all hashes equal":  # texts of one length can then only be told apart by comparing them
        monkeypatch.setattr(filter_audit, "block_hash", lambda block: F.lit(7).cast("long"))
    if hashed == "classes joined":
        monkeypatch.setattr(filter_audit, "BROADCAST_CLASSES", -1)
    rows, labels, docs, marks = awkward(spark)
    check(filter_audit.audit(filter_audit.facts_of(docs, marks)).collect(), [r[:3] for r in rows], labels)


def test_refinement_leaves_no_text_that_is_alone(spark):
    _, _, docs, _ = awkward(spark)
    rows = filter_audit._rows(docs)
    classes = {r[0] for r in filter_audit.refine(filter_audit._facts(rows)).collect()}
    kept = {r["text"] for r in rows.withColumn("class", filter_audit._class(filter_audit.N_BLOCKS)).collect() if r["class"] in classes}
    assert kept == {t for t, n in Counter(r["text"] for r in rows.collect()).items() if n > 1}


def test_empty_table(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.facts_of(cases.empty(spark), labels)).count() == 0


def test_whole_table_against_sql(spark, sf_dir):
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = sorted(tuple(r) for r in filter_audit.query(spark, sf_dir).select(names).collect())
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert got == sorted(db.sql(f"SELECT {', '.join(names)} FROM ({filter_audit.oracle()})").fetchall())
