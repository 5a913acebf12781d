import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.sources import jsonl, merkle, shard_source, shards


def rows(spark, n=25):
    return spark.createDataFrame([(i, list(range(i)), f"text {i} é\n", "x") for i in range(n)], "i long, input_ids array<int>, text_preview string, _index string")


def test_round_trip_by_format(spark, tmp_path):
    folder = str(tmp_path / "out")
    names = shards.write(shards.assign(rows(spark), "i", shard_size=4), folder)
    assert names == [f"shard-{k:05d}.jsonl" for k in range(7)] and set(os.listdir(folder)) == {*names, shard_source.LISTING}
    got = sorted(shards.read(spark, folder).collect(), key=lambda r: (r["shard"], r["line"]))
    assert [(r["shard"], r["line"], r["input_ids"], r["text_preview"]) for r in got] == [(names[i // 4], i % 4, list(range(i)), f"text {i} é\n") for i in range(25)]
    listed = shard_source.listing(folder)
    assert [x["records"] for x in listed] == [4] * 6 + [1] and sum(x["tokens"] for x in listed) == sum(range(25))
    assert shards.read(spark, folder, names[:1]).count() == 4


def test_many_files_are_one_node_and_few_tasks(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"shard-{k:05d}.jsonl").write_text(json.dumps({"input_ids": [k], "text_preview": "p"}) + "\nnot json\n[1]\n" + json.dumps({"input_ids": ["a"], "text_preview": 3}) + "\n")
    got = shards.read(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan") == 1 and "Union" not in plan and got.rdd.getNumPartitions() == 1
    assert got.count() == 1200 and got.filter("input_ids is null").count() == 900
    (tmp_path / shard_source.LISTING).write_text(json.dumps({"shards": [{"name": "shard-00007.jsonl"}, {"name": "shard-09999.jsonl"}]}))
    assert [r["input_ids"] for r in shards.read(spark, str(tmp_path)).filter("line = 0").collect()] == [[7]]


def test_a_failed_task_leaves_no_shard(spark, tmp_path):
    folder = str(tmp_path / "out")
    shards.write(shards.assign(rows(spark, 8), "i", shard_size=4), folder)
    before = {x: (tmp_path / "out" / x).read_bytes() for x in os.listdir(folder)}
    bad = rows(spark).withColumn("input_ids", F.when(F.col("i") == 23, F.raise_error(F.lit("task fails")).cast("array<int>")).otherwise(F.col("input_ids")))
    shard_source.register(spark)
    numbered = bad.withColumn("shard", F.expr("i div 4")).withColumn("place", F.col("i") % 4)
    for mode in ("overwrite", "append"):
        with pytest.raises(PySparkException):
            numbered.select("shard", "place", "input_ids", "text_preview").coalesce(1).write.format("shards").mode(mode).save(folder)
        assert {x: (tmp_path / "out" / x).read_bytes() for x in os.listdir(folder)} == before


def test_append_keeps_what_is_there(spark, tmp_path):
    folder = str(tmp_path / "out")
    first = shards.assign(rows(spark, 8), "i", shard_size=4)
    assert shards.write(first, folder) == ["shard-00000.jsonl", "shard-00001.jsonl"]
    assert shards.write(first.withColumn("shard", F.col("shard") + 2), folder, mode="append") == ["shard-00002.jsonl", "shard-00003.jsonl"]
    assert shards.read(spark, folder).count() == 16
    with pytest.raises(PySparkException, match="there already"):
        shards.write(first, folder, mode="append")
    assert shards.read(spark, folder).count() == 16 and not [x for x in os.listdir(folder) if x.startswith("_staging")]
    shards.write(first.limit(0), folder)
    assert shards.read(spark, folder).count() == 0


def test_changed_shards_are_named(spark, tmp_path):
    folder = str(tmp_path / "out")
    names = shards.write(shards.assign(rows(spark), "i", shard_size=4), folder)
    assert shard_source.changed(spark, folder) == []
    path = tmp_path / "out" / names[3]
    path.write_bytes(path.read_bytes().replace(b"text 13", b"text 31"))
    assert shard_source.changed(spark, folder, only_sizes=True) == [] and shard_source.changed(spark, folder) == [names[3]]
    os.remove(tmp_path / "out" / names[5])
    assert shard_source.changed(spark, folder, only_sizes=True) == [names[5]] and shard_source.changed(spark, folder) == [names[3], names[5]]


def test_trees_differ_where_leaves_do():
    for n in range(1, 12):
        a = [merkle.leaf(f"s{i}", i, "x") for i in range(n)]
        for k in range(n):
            b = [*a[:k], merkle.leaf(f"s{k}", k, "y"), *a[k + 1 :]]
            assert merkle.differing(merkle.tree(a), merkle.tree(b)) == [k] and merkle.root(a) != merkle.root(b)
        assert merkle.differing(merkle.tree(a), merkle.tree(a)) == [] and merkle.root(a, "tokenizer 1") != merkle.root(a, "tokenizer 2")
    assert merkle.tree([])[-1] != merkle.tree([merkle.leaf("a", 1, "x")])[-1]
    with pytest.raises(ValueError):
        merkle.differing(merkle.tree(["a"]), merkle.tree(["a", "b"]))


def test_lines_of_many_files_are_one_scan(spark, tmp_path):
    paths = []
    for k, name in enumerate(["a b.jsonl", "é#%20.jsonl", "c.jsonl"] + [f"n{i}.jsonl" for i in range(40)]):
        (tmp_path / name).write_text(f"{k}-0\n{k}-1\n")
        paths.append(str(tmp_path / name))
    paths.append(paths[0])  # a file given twice is read twice
    lines = jsonl.read_lines(spark, paths)
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Union" not in plan
    got = [r["raw"] for r in lines.orderBy("file", "block", "seq").collect()]
    assert got == [f"{k}-{j}" for k in [*range(43), 0] for j in (0, 1)]
    with pytest.raises(FileNotFoundError):
        jsonl.read_lines(spark, [*paths, str(tmp_path / "none")])
    assert jsonl.read_lines(spark, [str(tmp_path / "none"), paths[2]], missing="skip").select("file").distinct().collect() == [(1,)]
    assert jsonl.read_lines(spark, [str(tmp_path / "none")], missing="skip").count() == 0


def test_manifest_seals_contents_and_tokenizer(spark, tmp_path):
    from tessera.operators import manifest

    folder = str(tmp_path)
    names = [f"{part}/{x}" for part in ("train", "val") for x in shards.write(shards.assign(rows(spark, 9), "i", shard_size=4), os.path.join(folder, part))]
    made = manifest.create(name="a", shard_files=names, tokenizer_hash="t1", n_records=18).seal(folder)
    made.save(os.path.join(folder, "manifest.json"))
    assert made.verify(folder) and made.changed(spark, folder) == []
    assert made.content_root != manifest.create(name="a", shard_files=names, tokenizer_hash="t2").seal(folder).content_root
    path = tmp_path / names[4]
    whole = path.read_bytes()
    path.write_bytes(whole.replace(b"text 5", b"text 6"))
    assert made.verify(folder) and made.changed(spark, folder) == [names[4]]
    path.write_bytes(whole[:-9])
    assert not made.verify(folder)
    path.write_bytes(whole)
    shards.write(shards.assign(rows(spark, 9), "i", shard_size=5), os.path.join(folder, "val"))
    assert not made.verify(folder)
