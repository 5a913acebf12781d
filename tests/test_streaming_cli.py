"""Streams run to their end over small folders; the command line over small files."""

import json

from pyspark.sql import functions as F

from tessera import cli, streaming
from tessera.operators import monitor


def drain(stream, spark, tmp_path, name, **options):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_texts_and_dedup(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"text": "good"}\nnot json\n{"x": 1}\n{"text": "good "}\n')
    (folder / "b.jsonl").write_text('{"text": "good2"}\n[1]\n')
    (folder / "c.txt").write_text('{"text": "other"}\n')
    texts = streaming.read_texts(spark, str(folder), files_per_trigger=1)
    assert sorted(r["text"] for r in drain(texts, spark, tmp_path, "texts")) == ["good", "good ", "good2"]
    assert len(drain(streaming.dedup(texts), spark, tmp_path, "unique")) == 2


def test_streaks_keep_state_over_batches(spark, tmp_path):
    folder = str(tmp_path / "log")
    for part in ([(1, 1.0), (2, 2.0)], [(3, 3.0), (4, 4.0), (5, 1.0)]):
        monitor.append_log(spark.createDataFrame([(s, 0.0, 0, 0.0, "", v) for s, v in part], monitor.LOG_SCHEMA).coalesce(1), folder)
    assert monitor.read_log(spark, folder).count() == 5
    rows = spark.readStream.schema(monitor.LOG_SCHEMA).json(folder).withColumn("run", F.lit("r"))
    got = sorted((r["step"], r["streak"], r["warn"]) for r in drain(streaming.streaks(rows, "run", "step", "val_loss"), spark, tmp_path, "streaks"))
    assert [g[1] for g in got] in ([0, 1, 2, 3, 0], [0, 1, 2, 3, 0]) and got[3][2]


def test_command_line(spark, tmp_path, capsys):
    path = str(tmp_path / "corpus.jsonl")
    assert cli.main(["synthetic", "--output", path, "--records", "60"], spark) == 0
    tok = str(tmp_path / "tok.json")
    cli.main(["tokenizer", "train", "--corpus", path, "--output", tok, "--vocab-size", "300"], spark)
    cli.main(["tokenizer", "info", "--tokenizer", tok])
    capsys.readouterr()
    cli.main(["tokenizer", "encode", "--tokenizer", tok, "--text", "the quiet river"])
    ids = capsys.readouterr().out.strip()
    cli.main(["tokenizer", "decode", "--tokenizer", tok, "--ids", ids])
    assert capsys.readouterr().out.strip() == "the quiet river"
    report = str(tmp_path / "report.json")
    cli.main(["data", "validate", "--input", path, "--report", report], spark)
    assert json.load(open(report))["records_scanned"] == 60
    cli.main(["data", "clean", "--input", path, "--output", str(tmp_path / "clean.jsonl")], spark)
    cli.main(["data", "dedupe", "--input", str(tmp_path / "clean.jsonl"), "--output", str(tmp_path / "unique.jsonl")], spark)
    rows = [json.loads(x) for x in open(tmp_path / "unique.jsonl")]
    assert len({r["text"] for r in rows}) == len(rows) <= 60 and rows[0]["source"] == "synthetic"
    cli.main(["data", "tokenize", "--input", path, "--tokenizer", tok], spark)
    cli.main(["data", "stats", "--input", path, "--tokenizer", tok], spark)
    cli.main(["data", "build", "--input", path, "--output", str(tmp_path / "out"), "--tokenizer", tok, "--context-length", "32", "--validation-ratio", "0.2"], spark)
    assert (tmp_path / "out" / "manifest.json").exists() and (tmp_path / "out" / "train" / "shard-00000.jsonl").exists()
