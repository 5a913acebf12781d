import json

from tessera.operators import validate


def test_all_duplicate_hashes_are_written(spark, tmp_path):
    n = 100_003
    (tmp_path / "in.jsonl").write_text("".join(json.dumps({"text": f"text {i}"}) + "\n" for i in [*range(n), *range(n)]))
    out = str(tmp_path / "hashes")
    report = validate.validate_files(spark, [str(tmp_path / "in.jsonl")], hashes_path=out)
    assert report.duplicates == n and len(report.duplicate_hashes) == n
    assert spark.read.parquet(out).select("key").distinct().count() == n
    assert len(set(report.duplicate_hashes)) == n
    assert report.to_dict()["duplicate_hashes"] == {"path": out, "count": n}
