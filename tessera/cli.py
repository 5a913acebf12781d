"""python -m tessera.cli tokenizer|data|generate-corpus ..."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera")
    areas = top.add_subparsers(dest="area", required=True)
    tok = areas.add_parser("tokenizer").add_subparsers(dest="command", required=True)
    p = tok.add_parser("train")
    p.add_argument("--corpus", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--vocab-size", type=int, default=4096)
    p.add_argument("--text-field", default="text")
    for name, extra in (("info", None), ("encode", "--text"), ("decode", "--ids")):
        p = tok.add_parser(name)
        p.add_argument("--tokenizer", required=True)
        if extra:
            p.add_argument(extra, required=True)
    data = areas.add_parser("data").add_subparsers(dest="command", required=True)
    for name in ("validate", "clean", "dedupe", "tokenize", "stats", "build"):
        p = data.add_parser(name)
        p.add_argument("--input", required=True, nargs="+")
        p.add_argument("--text-field", default="text")
        if name in ("clean", "dedupe", "build"):
            p.add_argument("--output", required=True)
        if name in ("tokenize", "build"):
            p.add_argument("--tokenizer", required=True)
        if name in ("validate", "stats"):
            p.add_argument("--report", default="")
        if name == "validate":
            p.add_argument("--min-chars", type=int, default=1)
            p.add_argument("--max-chars", type=int, default=1_000_000)
        if name == "clean":
            p.add_argument("--unicode-norm", default="NFC", choices=["NFC", "NFKC", "NFD", "NFKD", "none"])
        if name == "dedupe":
            p.add_argument("--normalization", default="whitespace", choices=["none", "whitespace", "lowercase"])
        if name == "stats":
            p.add_argument("--tokenizer", default="")
        if name == "build":
            p.add_argument("--name", default="dataset")
            p.add_argument("--version", default="0.1.0")
            p.add_argument("--context-length", type=int, default=256)
            p.add_argument("--shard-size", type=int, default=10_000)
            p.add_argument("--validation-ratio", type=float, default=0.05)
            p.add_argument("--seed", type=int, default=42)
    p = areas.add_parser("synthetic")
    p.add_argument("--output", required=True)
    p.add_argument("--records", type=int, default=500)
    p.add_argument("--seed", type=int, default=42)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    from tessera.operators import clean, dedup, generate, stats, validate
    from tessera.operators.bpe import Tokenizer
    from tessera.plans import pipeline
    from tessera.sources import jsonl
    from tessera.sources.shared import save_json, to_json

    if args.area == "tokenizer" and args.command != "train":
        tokenizer = Tokenizer.load(args.tokenizer)
        if args.command == "info":
            print(json.dumps({"version": tokenizer.VERSION, "vocab_size": len(tokenizer), "merges": len(tokenizer.merges), "first": tokenizer.vocab[:10]}))
        elif args.command == "encode":
            print(",".join(map(str, tokenizer.encode(args.text))))
        else:
            print(tokenizer.decode([int(x) for x in args.ids.split(",") if x.strip()]))
        return 0
    spark = spark or SparkSession.builder.getOrCreate()
    order = ("file", "block", "seq")
    if args.area == "synthetic":
        jsonl.write_file(generate.synthetic(spark, args.records, args.seed).orderBy("row").select(F.to_json(F.struct("text", "source")).alias("value")), args.output)
        return 0
    if args.area == "tokenizer":
        tokenizer, made = Tokenizer.train(jsonl.load(spark, args.corpus, args.text_field), args.vocab_size)
        tokenizer.save(args.output)
        print(json.dumps(made))
    elif args.command == "validate":
        report = validate.validate_files(spark, args.input, validate.ValidationConfig(args.text_field, args.min_chars, args.max_chars), os.path.abspath(args.report) + ".duplicates" if args.report else None)
        print(report.summary())
        if args.report:
            save_json(report.to_dict(), args.report)
    elif args.command == "clean":
        rows = jsonl.load(spark, args.input, args.text_field)
        config = clean.CleaningConfig(args.unicode_norm)
        kept = clean.clean(rows, config=config).orderBy(*order)
        n = jsonl.write_file(kept.select(jsonl.with_text(F.col("raw"), F.col("text"), args.text_field).alias("value")), args.output)
        print(f"{n} records written")
    elif args.command == "dedupe":
        rows = jsonl.load(spark, args.input, args.text_field)
        jsonl.write_file(dedup.first_wins(rows, *order, normalization=args.normalization).orderBy(*order).select(F.col("raw").alias("value")), args.output)
        print(dedup.read_report(rows, normalization=args.normalization).summary())
    elif args.command == "tokenize":
        tokenizer = Tokenizer.load(args.tokenizer)
        rows = jsonl.load(spark, args.input, args.text_field).withColumn("n", F.size(tokenizer.encode_column(F.col("text"), spark)))
        print(to_json(stats.tokens(rows, "n").first().asDict()))
    elif args.command == "stats":
        rows = jsonl.load(spark, args.input, args.text_field)
        found = stats.quality(rows).first().asDict()
        if args.tokenizer:
            tokenizer = Tokenizer.load(args.tokenizer)
            found |= {f"tokens_{k}": v for k, v in stats.tokens(rows.withColumn("n", F.size(tokenizer.encode_column(F.col("text"), spark))), "n").first().asDict().items()}
        print(to_json(found))
        if args.report:
            save_json(found, args.report)
    else:
        result = pipeline.run(spark, pipeline.PipelineConfig(name=args.name, version=args.version, input_paths=args.input, text_field=args.text_field, validation_ratio=args.validation_ratio, seed=args.seed, tokenizer_path=args.tokenizer, context_length=args.context_length, shard_size=args.shard_size, output_dir=os.path.abspath(args.output)))
        print(to_json(result.to_dict()))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
