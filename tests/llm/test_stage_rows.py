"""Stages of the corpus pipeline on null and repeated doc_ids: rows are judged one by one."""

import pytest

from tessera.llm import jaccard_join, kneser_ney, quality_rules

WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen".split()


@pytest.mark.parametrize("operator", [quality_rules, kneser_ney])
def test_verdicts_row_by_row(spark, sf_dir, operator):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labelled = {r[0] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id").collect()}
    rows = docs.collect()
    kept = {r["doc_id"] for r in operator.stage(spark, docs, sf_dir).collect()}
    good = next(r for r in rows if r["doc_id"] in kept and r["doc_id"] not in labelled)
    bad = next(r for r in rows if r["doc_id"] not in kept and r["text"] and r["lang"] == good["lang"])
    extra = [{**good.asDict(), "doc_id": None}, {**bad.asDict(), "doc_id": None}, {**bad.asDict(), "doc_id": good["doc_id"]}]
    all_docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    got = [(r["doc_id"], r["text"]) for r in operator.stage(spark, all_docs, sf_dir).collect()]
    expected = [(r["doc_id"], r["text"]) for r in rows if r["doc_id"] in kept] + [(None, good["text"])]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_near_duplicates_row_by_row(spark, sf_dir):
    a, b, c = (" ".join(f"{w}{k}" for w in WORDS * 3) for k in "abc")
    rows = [(1, a), (1, b), (2, a + " end"), (None, c), (None, c + " end"), (None, b), (3, ""), (3, ""), (None, None), (4, "***"), (1, a)]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = jaccard_join.stage(spark, docs, sf_dir)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    expected = [(1, a), (1, b), (3, ""), (3, ""), (None, None), (4, "***")]
    assert [x for x in got if x[1] not in (c, c + " end")] == sorted(expected, key=str)
    assert len(got) == len(expected) + 1
