"""Columns of any name and null groups come through untouched."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import clean, dedup, monitor, rowindex, stats, validate

NAMES = ("clean", "reason", "unicode_normalized", "whitespace_normalized", "control_chars_removed", "_index", "_island", "_run", "_bad", "_id", "_part", "_rows", "_key", "_rank", "_first", "made", "row", "now")


def table(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    return df.withColumns({c: F.concat(F.lit(c), "i") for c in NAMES})


def own(rows):
    return all(r[c] == f"{c}{r['i']}" for r in rows for c in NAMES)


def test_columns_with_clashing_names(spark):
    df = table(spark, ["a", "b", "a", "  b ", None])
    indexed = rowindex.with_row_index(df, "i", running={"before": "i"}).collect()
    assert own(indexed) and sorted((r["i"], r["row_index"], r["before"]) for r in indexed) == [(0, 0, 0), (1, 1, 0), (2, 2, 1), (3, 3, 3), (4, 4, 6)]
    judged = validate.with_status(df, "i").collect()
    assert own(judged) and {r["i"]: r["status"] for r in judged}[2] == "duplicates"
    for found, ids in ((dedup.first_wins(df, "i"), {0, 1, 4}), (dedup.overlap(df, df.filter("i > 2")), {3}), (dedup.without(df.filter("i = 0"), df), {1, 3}), (clean.clean(df), {0, 1, 2, 3})):
        rows = found.collect()
        assert found.columns == df.columns and own(rows) and {r["i"] for r in rows} >= ids - {4}


def test_quality_of_null_and_blank_groups(spark):
    df = spark.createDataFrame([("en", "some text"), ("en", "some  text"), (None, "no language"), ("de", "  ")], "lang string, text string")
    got = {r["lang"]: (r["documents"], r["characters"], r["empty_documents"], r["duplicates"]) for r in stats.quality(df, "lang").collect()}
    assert got == {"en": (2, 19, 0, 1), None: (1, 11, 0, 0), "de": (0, 0, 1, 0)}
    whole = stats.quality(df.union(df.limit(1)).union(spark.createDataFrame([("en", None)], df.schema))).first()
    assert (whole["documents"], whole["characters"], whole["empty_documents"], whole["duplicates"], whole["min_length"], whole["max_length"]) == (4, 39, 1, 2, 9, 11)
    none = stats.quality(df.filter("false")).first()
    assert (none["documents"], none["characters"], none["empty_documents"], none["duplicates"], none["median_length"]) == (0, 0, 0, 0, None)
    # groups under the names of columns used within
    named = stats.quality(df.withColumnsRenamed({"lang": "v"}).withColumn("k", F.lit(1)), "v", "k")
    assert {(r["v"], r["k"], r["documents"]) for r in named.collect()} == {("en", 1, 2), (None, 1, 1), ("de", 1, 0)}


def test_quality_reads_texts_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = stats.quality(docs, "lang")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Join" not in plan


def test_lines_fold_as_in_python(spark):
    texts = ["", " \n \n ", "\n\n a \n\n b \n", "a\x0bb\tc \r\n\x85 d", "x\n \n\n y z", "\x1c\n\x1c"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.fold_lines(F.col("t")).alias("f")).collect()
    for r in got:
        assert r["f"] == "\n".join(" ".join(x.split()) for x in r["t"].split("\n")).strip("\n"), repr(r["t"])


def test_byte_ids(spark):
    texts = ["", None, "  ", "a", " é  x\n", "\U0001f389 b"]
    for eos in (False, True):
        for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.byte_token_ids(F.col("t"), eos).alias("ids")).collect():
            want = None if r["t"] is None else [x for w in r["t"].split() for x in (36, *(b + 4 for b in w.encode()))] + [2] * eos
            assert r["ids"] == want


def test_names_that_would_clash_are_refused(spark):
    df = spark.createDataFrame([("a", "b", "c")], "text string, status string, clean string")
    for f in (lambda: clean.cleaned(df), lambda: validate.with_status(df, "text")):
        with pytest.raises(ValueError, match="already"):
            f()
    assert clean.report(df).first()["records_out"] == 1 and clean.clean(df).collect() == df.collect()


def test_monitors_keep_columns_of_any_name(spark):
    df = table(spark, ["x"] * 6).withColumn("v", F.expr("array(5D, 4D, 4.5D, 4.6D, 4.7D, 4.8D)[i]"))
    rows = monitor.rise_streak(df, "v", [], ["i"]).collect()
    assert own(rows) and [r["streak"] for r in sorted(rows, key=lambda r: r["i"])] == [0, 0, 1, 2, 3, 4]
    assert monitor.early_stop(df.withColumn("g", F.lit(1)), "v", ["g"], ["i"]).first()["stop"]["i"] == 4
