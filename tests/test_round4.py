"""Findings of round 4: queries against their SQL on tables that hold odd rows."""

import os

import duckdb
import pytest

_TEXTS = "[NULL, '', '   ', chr(10) || chr(9), chr(8195) || chr(160), 'a', 'Some words', 'some  words', 'Some  words ', 'zebras and documents']"


@pytest.fixture
def against_sql(spark, tmp_path):
    """Rows of a query over the tables made by the SQL given, and those of its SQL, both sorted."""
    import __spark_entry__ as entry

    def run(name: str, **tables: str) -> tuple[list, list]:
        con = duckdb.connect()
        folder = os.path.join(tmp_path, str(len(os.listdir(tmp_path))))
        os.makedirs(folder)
        for t, sql in tables.items():
            con.sql(f"COPY ({sql}) TO '{folder}/{t}.parquet'")
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        expected = con.sql(entry.oracle_sql()[name]).fetchall()
        return sorted(map(tuple, entry.queries()[name](spark, folder).collect()), key=repr), sorted(expected, key=repr)

    return run


def _documents(n: int = 10, where: str = "true") -> str:
    made = f"SELECT k AS doc_id, ({_TEXTS})[1 + (k % 10)::INT] AS text, CASE WHEN k % 10 < 3 THEN 'xx' WHEN k % 10 < 5 THEN NULL ELSE 'en' END AS lang, 'src0' AS source FROM range({n}) r(k)"
    return f"SELECT *, length(text) AS n_chars FROM ({made}) WHERE {where}"


@pytest.mark.parametrize("name", ["quality_report", "quality_by_lang"])
def test_quality_is_that_of_its_sql_with_blank_texts(against_sql, name):
    for documents in (_documents(230), _documents(10, "doc_id < 5")):
        got, expected = against_sql(name, documents=documents)
        assert repr(got) == repr(expected)  # nan equals nan


def test_shard_listing_is_that_of_its_sql_with_blank_texts(against_sql):
    """Shards of 64 with blank and null texts among others, and one of them alone."""
    got, expected = against_sql("shard_listing", documents=_documents(640, "doc_id < 100 or doc_id % 10 < 5"))
    assert got == expected and len({x[2] for x in got}) > 2 and None in {x[2] for x in got}


def test_near_duplicates_write_no_sets_of_texts_without_a_like(spark, monkeypatch):
    """What the tables of the way hold is small beside texts; sets of shingles, of eight bytes each, were written twice before."""
    import random

    from tessera.operators import near_dup

    written = []

    def materialise(df, plain=near_dup.materialise):
        made = plain(df)
        written.append(sum(os.path.getsize(x.removeprefix("file://")) for x in made.inputFiles()))
        return made

    monkeypatch.setattr(near_dup, "materialise", materialise)
    rng = random.Random(4)
    texts = [" ".join("%06x" % rng.getrandbits(24) for _ in range(2000)) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate([*texts, texts[3], texts[5] + " more"])), "doc_id long, text string")
    got = {r["doc_id"]: r["cluster"] for r in near_dup.clusters(df, "doc_id").collect()}
    assert got == {k: k for k in range(150)} | {150: 3, 151: 5}
    assert sum(written) < sum(map(len, texts)) / 4


def test_pattern_hits_are_those_of_its_sql(against_sql, monkeypatch):
    """Null and blank texts, words beyond the plane, long ones and such that begin alike; also where the filter hardly holds anything back."""
    from tessera.operators import bloom

    words = "'zebras and documents DOCUMENT ' || repeat('ab', 400) || ' ' || repeat('ab', 401) || ' ' || chr(128512) || 'smiling straßen documentation'"
    conversations = f"SELECT k AS conv_id, k AS turn, 'user' AS role, CASE WHEN k % 3 = 0 THEN NULL ELSE {words} || ' wordnumber' || k END AS text FROM range(40) r(k)"
    more = f"SELECT 1000 + k AS doc_id, ['x' || repeat('ab', 500), chr(128512) || chr(128512) || 'SMILING', 'documen', 'documentary', 'the wordnumber12x', 'straßen' || chr(0) || 'wordnumber'][1 + k::INT] AS text, 'en' AS lang, 'src0' AS source, 1 AS n_chars FROM range(6) r(k)"
    documents = f"{_documents(40)} UNION ALL BY NAME {more}"
    for limit in (bloom.MAX_BYTES, 64):
        monkeypatch.setattr(bloom, "MAX_BYTES", limit)
        got, expected = against_sql("pattern_hits", documents=documents, conversations=conversations)
        assert got == expected and sum(x[1] for x in got) > 10
    got, expected = against_sql("pattern_hits", documents=documents, conversations=f"SELECT * FROM ({conversations}) WHERE text IS NULL")
    assert got == expected
