"""JSON lines in and out: strict parsing, order keys, counts, and the line stream."""

from __future__ import annotations

import json
import os
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.batches import bounded, joined, slices

#: What a parsed line can be, before any rule on its text.
KINDS = ("blank", "malformed", "not_text", "text")
_PARSED = "kind string, text string, keys array<string>"


def expand(paths: str | list[str]) -> list[str]:
    """Folders become their *.jsonl files in order of name."""
    out = []
    for path in [paths] if isinstance(paths, (str, os.PathLike)) else paths:
        path = str(path)
        out += [os.path.join(path, x) for x in sorted(os.listdir(path)) if x.endswith(".jsonl")] if os.path.isdir(path) else [path]
    return out


def read_lines(spark: SparkSession, paths: str | list[str], missing: str = "raise") -> DataFrame:
    """raw, file (ordinal), block, seq: the lines of the files; (file, block, seq) is their order.

    missing: "raise", or "skip" for files that are not there.
    """
    files = expand(paths)
    there = [(k, p) for k, p in enumerate(files) if "://" in p or os.path.isfile(p)]
    if missing == "raise" and len(there) < len(files):
        raise FileNotFoundError(next(p for p in files if "://" not in p and not os.path.isfile(p)))
    if not there:
        return spark.createDataFrame([], "raw string, file int, block long, seq long")
    # one scan of all files; which of them a line is from is joined, a row for each path given
    found = [(_qualified(spark, p), k) for k, p in there]
    ordinals = F.broadcast(spark.createDataFrame(found, "path string, file int"))
    text = spark.read.text(list(dict.fromkeys(p for _, p in there)))
    lines = text.select(F.col("value").alias("raw"), F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))
    return lines.join(ordinals, "path").select("raw", "file", "block", "seq")


def _qualified(spark: SparkSession, path: str) -> str:
    """A path as Spark names the file, local ones with one slash."""
    jvm = spark._jvm
    made = jvm.org.apache.hadoop.fs.Path(path)
    system = made.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return re.sub("^file:/+", "file:/", jvm.org.apache.spark.paths.SparkPath.fromPath(system.makeQualified(made)).urlEncoded())


def parse(lines: DataFrame, text_field: str = "text") -> DataFrame:
    """lines with kind, text and keys, as a strict JSON parser sees them.

    No built-in parser is strict in all points (quotes, trailing text, numbers for strings), so
    lines go to json.loads in Arrow batches.
    """
    bounded(lines.sparkSession)

    def run(batches):
        for batch in batches:
            parts = [parsed(part) for part in slices(batch.column(batch.schema.get_field_index("raw")))]
            made = [joined(list(x), kind) for x, kind in zip(zip(*parts) if parts else [[]] * 3, made_types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "kind", "text", "keys"])

    made_types = [pa.string(), pa.string(), pa.list_(pa.string())]

    def parsed(column):
        kinds, texts, keys = [], [], []
        for raw in column.to_pylist():
            kind, text, names = "malformed", None, []
            if not (raw or "").strip():
                kind = "blank"
            else:
                try:
                    record = json.loads(raw)
                    if isinstance(record, dict):
                        names = list(record)
                        text = record.get(text_field)
                        kind = "text" if isinstance(text, str) else "not_text"
                        text = text.encode("utf-8", "replace").decode() if kind == "text" else None
                except (ValueError, RecursionError):
                    pass
            kinds.append(kind)
            texts.append(text)
            keys.append(names)
        return [pa.array(x, kind) for x, kind in zip((kinds, texts, keys), made_types)]

    return lines.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema) + ", " + _PARSED)


def is_record(kind: Column, text: Column) -> Column:
    """The loader's rule: an object whose text field is a string that is not blank."""
    return (kind == "text") & ~tx.is_blank(text)


def load(spark: SparkSession, paths: str | list[str], text_field: str = "text", skip_invalid: bool = True, max_records: int | None = None) -> DataFrame:
    """raw, file, block, seq, text of the valid records, in order of those keys.

    With skip_invalid false the first bad line raises ValueError. Blank lines are passed over.
    """
    parsed = parse(read_lines(spark, paths), text_field).filter("kind <> 'blank'")
    if not skip_invalid:
        bad = parsed.filter(~is_record(F.col("kind"), F.col("text"))).orderBy("file", "block", "seq").select("raw", "file", "block", "seq").first()
        if bad is not None:
            before = read_lines(spark, paths).filter((F.col("file") == bad["file"]) & ((F.col("block") < bad["block"]) | (F.col("block") == bad["block"]) & (F.col("seq") <= bad["seq"]))).count()
            raise ValueError(f"invalid record at line {before}: {(bad['raw'] or '')[:80]!r}")
    good = parsed.filter(is_record(F.col("kind"), F.col("text"))).select("raw", "file", "block", "seq", "text")
    return good if max_records is None else good.orderBy("file", "block", "seq").limit(max_records)


def with_text(raw: Column, text: Column, text_field: str = "text") -> Column:
    """The record with its text replaced and its other fields as they were."""
    bounded()

    @F.pandas_udf("string")
    def put(raws, texts):
        import pandas as pd

        return pd.Series([json.dumps({**json.loads(r), text_field: x}, ensure_ascii=False) for r, x in zip(raws, texts, strict=True)])

    return put(raw, text)


def write(df: DataFrame, path: str) -> None:
    """Every column as a JSON object per line; nulls are written."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def write_file(df: DataFrame, path: str, column: str = "value") -> int:
    """One file with the lines of `column` in df's order; rows stream through the driver, none is held."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    n = 0
    with open(path, "w", encoding="utf-8") as file:
        for row in df.select(column).toLocalIterator():
            file.write(row[0] + "\n")
            n += 1
    return n


def stream_texts(spark: SparkSession, path: str, text_field: str = "text") -> DataFrame:
    """Non-empty texts of a path's lines as one column, batch by batch; white space alone counts as text."""
    return parse(read_lines(spark, path), text_field).filter("kind = 'text' and text <> ''").orderBy("file", "block", "seq").select("text")


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()
