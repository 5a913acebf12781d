"""The corpus engine on small literal inputs."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import registry
from tessera.functions import sampling as sm
from tessera.functions import text as tx
from tessera.operators import bpe, chat, clean, dedup, generate, manifest, monitor, pack, rowindex, split, stats, validate
from tessera.plans import pipeline
from tessera.sources import jsonl, shards

ALPHABET = "ab \t\n\r\x0b\x0c\x1c\x1f\x85\xa0   　​﻿é\x00\x01\x7fİΣ😀"


def lines(tmp_path, *rows, name="in.jsonl"):
    path = tmp_path / name
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n", encoding="utf-8")
    return str(path)


def strings(n=400):
    rng = random.Random(3)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(25))) for _ in range(n)]


def test_text_rules_equal_python(spark):
    df = spark.createDataFrame([(s,) for s in strings()], "t string")
    rows = df.select("t", tx.fold_ws(F.col("t")).alias("w"), tx.fold_lines(tx.strip_control(F.col("t"))).alias("l"), tx.dedup_key(F.col("t"), "lowercase").alias("k"), tx.byte_token_ids(F.col("t"), True).alias("ids"), tx.byte_token_count(F.col("t"), True).alias("n"), clean.cleaned(df, "t").columns and F.lit(1)).collect()
    import hashlib

    tokenizer = bpe.Tokenizer([])
    for r in rows:
        t = r["t"]
        assert r["w"] == " ".join(t.split())
        kept = "".join(c for c in t if not (c < "\t" or "\x0b" <= c <= "\x0c" or "\x0e" <= c <= "\x1f" or c == "\x7f"))
        assert r["l"] == "\n".join(" ".join(x.split()) for x in kept.split("\n")).strip()
        assert r["k"] == hashlib.sha256(" ".join(t.lower().split()).encode()).hexdigest()
        assert r["ids"] == tokenizer.encode(t, add_eos=True) and r["n"] == len(r["ids"])


def test_clean_equals_one_string_form(spark):
    texts = strings() + ["café", "a\x0bb", "spam\n" * 50, "\n".join(["x"] * 5 + list("abcde")), "x\n" * 8 + "x", "\n\n a \n\n b \n"]
    got = clean.cleaned(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t").collect()
    for r in got:
        assert r["clean"] == clean.clean_text(r["t"])
    assert clean.clean_text("café") == "café" and clean.clean_text("\n\n a \n\n b \n") == "a\n\nb" and clean.clean_text("x\n" * 8 + "x") is not None
    report = clean.report(spark.createDataFrame([("a  b",), ("",), ("spam\n" * 30,)], "text string")).first()
    assert (report["records_in"], report["records_out"], report["whitespace_normalized"], report["empty_removed"], report["repetition_removed"]) == (3, 1, 1, 1, 1)


def test_loader(spark, tmp_path):
    path = lines(tmp_path, {"text": "valid"}, "not json", {"no_text": "x"}, {"text": ""}, {"text": "valid2", "k": 1})
    assert [r["text"] for r in jsonl.load(spark, path).orderBy("file", "block", "seq").collect()] == ["valid", "valid2"]
    with pytest.raises(ValueError, match="invalid record at line 2"):
        jsonl.load(spark, path, skip_invalid=False)
    with pytest.raises(FileNotFoundError):
        jsonl.load(spark, str(tmp_path / "none.jsonl"))
    assert jsonl.count_lines(spark, path) == 5 and jsonl.load(spark, path, max_records=1).count() == 1


def test_strict_json(spark, tmp_path):
    cases = {'{"text":"a",}': "malformed", "{'text':'a'}": "malformed", '{"text":"a"} x': "malformed", '{"text":"a\tb"}': "malformed", "01": "malformed", '{"text":123}': "not_text", '{"text":null}': "not_text", "[1]": "malformed", '"s"': "malformed", '{"text":"a","text":"b"}': "text", '{"text":"a","x":NaN}': "text", "  ": "blank"}
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    assert {r["raw"]: r["kind"] for r in jsonl.parse(df).collect()} == cases


def test_validator(spark, tmp_path):
    path = lines(tmp_path, {"text": "hello world"}, {"text": "second document"}, {"text": "hello   world"}, {"text": ""}, {"no_text": 1}, "not json")
    r = validate.validate_files(spark, [path, str(tmp_path / "gone.jsonl")])
    assert (r.files_scanned, r.records_scanned, r.valid, r.duplicates, r.empty, r.missing_text_field, r.malformed_json, r.final_usable) == (2, 6, 2, 1, 1, 1, 1, 1)
    assert r.invalid_total == 3 and len(r.duplicate_hashes) == 1 and r.files[1]["errors"] and "Duplicates" in r.summary()
    short = validate.validate_files(spark, lines(tmp_path, {"text": "ab"}, {"text": "x" * 200}, {"text": "abcdef"}, name="b.jsonl"), validate.ValidationConfig(min_chars=5, max_chars=100, expected_fields=["id"]))
    assert (short.too_short, short.too_long, short.metadata_inconsistencies) == (1, 1, 1)
    with pytest.raises(validate.ConfigError):
        validate.ValidationConfig(min_chars=-1)


def test_dedup_and_overlap(spark):
    df = spark.createDataFrame([(2, "hello world", "b"), (1, "hello   world", "a"), (3, "different", "c"), (4, "Hello World", "d")], "i int, text string, x string")
    assert sorted(r["x"] for r in dedup.first_wins(df, "i").collect()) == ["a", "c", "d"]
    assert sorted(r["x"] for r in dedup.first_wins(df, "i", normalization="lowercase").collect()) == ["a", "c"]
    assert dedup.read_report(df).duplicates_removed == 1
    a, b = (spark.createDataFrame([(t,) for t in x], "text string") for x in (["doc A", "shared"], ["doc C", "shared", "shared ", "doc D"]))
    assert dedup.overlap(a, b).count() == 2 and dedup.without(a, b).count() == 2
    with pytest.raises(NotImplementedError):
        dedup.near_duplicate_clusters(df)


def test_row_index_and_split(spark):
    df = spark.createDataFrame([(i, i % 7) for i in random.Random(1).sample(range(500), 500)], "i long, n long").repartition(5)
    rows = sorted(map(tuple, rowindex.with_row_index(df, "i", running={"before": "n"}).collect()))
    assert [r[2] for r in rows] == list(range(500)) and all(r[3] == sum(x % 7 for x in range(r[0])) for r in rows)
    places = [7, 3, 2, 8, 5, 6, 9, 4, 0, 1]
    got = split.seeded(df.filter("i < 10"), "i", validation_ratio=0.2, test_ratio=0.0).orderBy("split_rank").collect()
    assert [r["i"] for r in got] == places and [r["split"] for r in got] == ["train"] * 7 + ["val"] * 2 + ["test"]
    for n, v, want in ((20, 0.05, (18, 1, 1)), (30, 0.2, (23, 6, 1)), (42559, 0.05, (40431, 2127, 1)), (3, 0.5, (1, 1, 1))):
        assert split.sizes(n, v, 0.0) == want
    assert split.sizes(100, 0.1, 0.1) == (80, 10, 10)
    for bad in ((0.0, 0.1), (0.5, 1.0), (0.6, 0.4)):
        with pytest.raises(ValueError):
            split.sizes(10, *bad)
    with pytest.raises(ValueError):
        split.sizes(1, 0.5, 0.4)
    hashed = split.by_hash(df, "i", 0.1, 0.1)
    assert {r["split"]: r["count"] for r in hashed.groupBy("split").count().collect()} == {"train": 400, "val": 50, "test": 50}


def test_percentiles(spark):
    rng = random.Random(2)
    for n in (1, 2, 99, 100, 257):
        v = [rng.randrange(50) for _ in range(n)]
        s = sorted(v)
        r = stats.positional(spark.createDataFrame([(x,) for x in v], "v int"), "v").first()
        assert (r["p25"], r["p75"], r["p95"], r["p99"]) == (s[int(n * 0.25)], s[int(n * 0.75)], s[int(n * 0.95)], s[int(n * 0.99)] if n >= 100 else s[-1])
        import statistics

        assert (r["median"], r["n"], r["total"], r["min"], r["max"]) == (statistics.median(v), n, sum(v), s[0], s[-1])


def test_bpe(spark):
    sentences = ["the cat sat on the mat", "the dog ate the cat's food", "café 日本語 is here"] * 5
    df = spark.createDataFrame([(s,) for s in sentences], "text string")
    made, info = bpe.Tokenizer.train(df, 300)
    assert len(made) == 300 == info["vocab_size"] and made.merges == slow_merges(sentences, 40)
    for s in sentences[:3]:
        assert made.decode(made.encode(s, True, True)) == s
    assert made.encode("hi", True, True)[0] == 1 and made.encode("hi", True, True)[-1] == 2
    assert bpe.Tokenizer([]).encode("hi") == [36, 108, 109] and bpe.Tokenizer([]).decode([36, 108, 36, 109]) == "h i"
    with pytest.raises(ValueError):
        bpe.Tokenizer.train(df, 100)
    with pytest.raises(RuntimeError):
        bpe.Tokenizer().encode("x")
    col = df.select(made.encode_column(F.col("text"), spark).alias("ids")).select("ids", made.decode_column(F.col("ids"), spark).alias("t"))
    assert [r["t"] for r in col.collect()] == sentences


def slow_merges(texts, n):
    from collections import Counter

    words = Counter(w for t in texts for w in t.split())
    symbols = {w: [bpe.MARK, *(bpe.BYTES[b] for b in w.encode())] for w in words}
    out = []
    for _ in range(n):
        pairs = Counter()
        for w, s in symbols.items():
            for p in zip(s, s[1:]):
                pairs[p] += words[w]
        if not pairs:
            break
        best = max(pairs, key=lambda p: (pairs[p], p))
        out.append(best)
        symbols = {w: bpe.merge(s, best) for w, s in symbols.items()}
    return out


def test_packing(spark):
    df = spark.createDataFrame([(0, [36, 101]), (1, [36, 102]), (2, [])], "i int, ids array<int>")
    ids = lambda d: [r["input_ids"] for r in d.orderBy("chunk").collect()]
    assert ids(pack.packed(df.filter("i < 2"), "ids", "i", context_length=2)) == [[36, 101, 2], [36, 102, 2]]
    ended = df.filter("i < 2").withColumn("ids", F.concat("ids", F.array(F.lit(2))))
    assert ids(pack.streamed(ended, "ids", "i", context_length=2)) == [[36, 101, 2], [2, 36, 102]]
    rng = random.Random(4)
    rows = [(i, [rng.randrange(99) for _ in range(rng.choice([0, 1, 5, 70]))]) for i in range(60)]
    flat = [x for _, r in rows for x in r]
    many = spark.createDataFrame(rows, "i int, ids array<int>")
    assert ids(pack.chunks(many, "ids", "i", context_length=9)) == [flat[k : k + 10] for k in range(0, len(flat) - 9, 10)]
    assert ids(pack.chunks(many, F.col("ids"), "i", context_length=9, n=F.size("ids"))) == [flat[k : k + 10] for k in range(0, len(flat) - 9, 10)]
    assert ids(pack.chunks(df, "ids", "i", context_length=9, at_least_one=True)) == [[0] * 10]
    r = spark.sql("select array(7, 8, 2) ids").select(pack.shifted(pack.pad(F.col("ids"), 4)).alias("e")).first()["e"]
    assert (r["input_ids"], r["target_ids"]) == ([7, 8, 2, 2], [8, 2, 2, 2])


def test_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, [i, 1, 2], f"t{i}") for i in range(7)], "i int, input_ids array<int>, text_preview string")
    sharded = shards.assign(df, "i", shard_size=3)
    assert [tuple(r) for r in shards.stats(sharded).orderBy("shard").collect()] == [(0, 3, 9), (1, 3, 9), (2, 1, 3)]
    names = shards.write(sharded, str(tmp_path / "s"))
    assert names == ["shard-00000.jsonl", "shard-00001.jsonl", "shard-00002.jsonl"]
    assert (tmp_path / "s" / names[0]).read_text().splitlines()[0] == '{"input_ids":[0,1,2],"text_preview":"t0"}'
    assert shards.examples(shards.read(spark, str(tmp_path / "s")), 4).count() == 7


def test_manifest(tmp_path):
    made = manifest.create(name="a", version="1", source_files=[], processing_config={"b": 1, "a": 2}, tokenizer_path="t", tokenizer_version="v", n_records=3, n_tokens=25)
    path = str(tmp_path / "manifest.json")
    made.save(path)
    assert manifest.Manifest.load(path).identity_hash == made.identity_hash and made.verify(str(tmp_path))
    assert manifest.hash_config({"a": 2, "b": 1}) == made.processing_hash
    made.n_tokens = 26
    assert made.identity() != manifest.Manifest.load(path).identity_hash


def test_pipeline_and_preflight(spark, tmp_path):
    path = lines(tmp_path, {"text": "first text here"}, {"text": "second text here"}, {"text": "first  text here"}, {"text": ""}, "bad", {"text": "third text here"})
    bpe.Tokenizer([]).save(str(tmp_path / "tok.json"))
    config = pipeline.PipelineConfig(input_paths=[path], tokenizer_path=str(tmp_path / "tok.json"), context_length=32, validation_ratio=0.5, output_dir=str(tmp_path / "out"))
    r = pipeline.run(spark, config)
    assert (r.n_input, r.n_valid, r.n_clean, r.n_unique, r.n_train, r.n_val) == (6, 4, 4, 3, 1, 1)
    assert r.manifest.shard_files == ["train/shard-00000.jsonl", "val/shard-00000.jsonl"] and pipeline.resumable(config)
    pipeline.preflight(config.output_dir, config.tokenizer_path, 32, 260)
    for bad in ((config.output_dir, config.tokenizer_path, 64, 260), (config.output_dir, config.tokenizer_path, 32, 300), (str(tmp_path), config.tokenizer_path, 32, 260), (config.output_dir, "none", 32, 260)):
        with pytest.raises(validate.ConfigError):
            pipeline.preflight(*bad)


def test_monitors(spark):
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate([1, 2, 3, 4, 5])], "g int, step int, val_loss double")
    assert [r["streak"] for r in monitor.rise_streak(df, "val_loss", ["g"], ["step"]).orderBy("step").collect()] == [0, 1, 2, 3, 4]
    log = spark.createDataFrame([(1, float("nan"), None), (2, 5.5, 5.0), (3, 1e11, 10.0), (4, 1.0, 3.0), (5, 1.0, 8.0), (6, 1.0, 2.0)], "step int, loss double, val_loss double")
    assert {r["kind"]: r["n"] for r in monitor.warning_counts(monitor.warnings(log, cv=0.1)).collect()} == {"nan_loss": 2, "unstable_val": 1}
    assert {r["kind"] for r in monitor.warnings(df.withColumn("loss", F.lit(1.0))).collect()} == {"overfitting"}
    stop = monitor.early_stop(spark.createDataFrame([(0, i, v) for i, v in enumerate([5.0, 4.0, 4.5, 4.2, 4.1, 3.0])], "g int, step int, v double"), "v", ["g"], ["step"], 3).first()
    assert stop["stop"]["step"] == 4


def test_sampling(spark):
    df = spark.sql("select array(1D, 3D, 2D, 3D) x")
    r = df.select(sm.top_k(F.col("x"), 1).alias("k"), sm.softmax(F.col("x")).alias("s"), sm.top_p(F.col("x"), 0.5).alias("p"), sm.argmax(F.col("x")).alias("a"), sm.repetition_penalty(F.col("x"), F.array(F.lit(1)), 2.0).alias("r"), sm.categorical(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.25)), F.lit(0.6)).alias("c"), sm.cross_entropy(F.col("x"), F.lit(1)).alias("e"), sm.rope(F.col("x"), F.lit(0)).alias("o")).first()
    inf = float("-inf")
    assert r["k"] == [inf, 3, inf, 3] and abs(sum(r["s"]) - 1) < 1e-12 and r["p"] == [inf, 3, inf, inf] and r["a"] == 1 and r["r"] == [1, 1.5, 2, 3] and r["c"] == 1
    assert abs(r["e"] + math.log(r["s"][1])) < 1e-12 and r["o"] == [1, 3, 2, 3]
    steps = spark.createDataFrame([(0,), (1,), (25,), (50,), (275,), (500,)], "s int").select(sm.lr_multiplier(F.col("s")).alias("m")).collect()
    assert [round(x["m"], 9) for x in steps] == [0, 0.02, 0.5, 1.0, 0.55, 0.1]


def test_chat_generators_functions(spark):
    turns = spark.createDataFrame([(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 0, "tool", "x")], "conv_id int, turn int, role string, text string")
    assert chat.prompts(turns).first()["prompt"] == "<user> a\n<assistant> b\n<assistant>"
    rows = generate.synthetic(spark, 400, seed=5)
    assert rows.count() == 400 and 120 < rows.filter("family = 'sentence'").count() < 280
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, generate.synthetic(spark, 400, seed=5).repartition(3).collect()))
    assert generate.sums_table(spark).count() == 288 and generate.successors(spark, ["Mon", "Tue"]).count() == 2
    registry.register(spark, bpe.Tokenizer([]))
    r = spark.sql("select fold_ws(' a   b ') w, dedup_key('a  b') k, is_repetitive(repeat('x\\n', 20)) p, unicode_norm('é', 'NFC') n, bpe_decode(bpe_encode('x y')) d").first()
    assert (r["w"], r["p"], r["n"], r["d"]) == ("a b", True, "é", "x y")
    assert spark.sql("select * from chunk_tokens(array(1,2,3,4,5), 1)").count() == 2
