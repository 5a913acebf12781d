"""Validation: each row gets the first status that applies; reports count statuses."""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.sources import jsonl
from tessera.sources.shared import shared_folder

STATUSES = ("empty", "malformed_json", "missing_text_field", "too_short", "too_long", "invalid_unicode", "metadata_inconsistencies", "duplicates", "valid")


class ConfigError(ValueError):
    """A setting that cannot be right: which, its value, and what to do."""

    def __init__(self, message: str, field: str = "", value=None, hint: str = ""):
        super().__init__(message + (f" [{field}={value!r}]" if field else "") + (f" ({hint})" if hint else ""))
        self.field, self.value, self.hint = field, value, hint


@dataclass
class ValidationConfig:
    text_field: str = "text"
    min_chars: int = 1
    max_chars: int = 1_000_000
    check_duplicates: bool = True
    dedup_normalization: str = "whitespace"
    expected_fields: list[str] = field(default_factory=list)

    def __post_init__(self):
        if self.min_chars < 0:
            raise ConfigError("min_chars must be >= 0", "min_chars", self.min_chars)
        if self.max_chars < 0 or 0 < self.max_chars < self.min_chars:
            raise ConfigError("max_chars must be 0 or at least min_chars", "max_chars", self.max_chars)
        if self.dedup_normalization not in tx.NORMALIZATIONS:
            raise ConfigError("unknown normalization", "dedup_normalization", self.dedup_normalization)


@dataclass(frozen=True)
class Hashes:
    """The keys of duplicates as a table (file, block, seq, key) in the order of the input; only path and count are held."""

    path: str = ""
    count: int = 0

    def __len__(self) -> int:
        return self.count

    def __iter__(self):
        if self.count:
            rows = SparkSession.getActiveSession().read.parquet(self.path).orderBy("file", "block", "seq").select("key")
            yield from (r["key"] for r in rows.toLocalIterator())


@dataclass
class ValidationReport:
    files_scanned: int = 0
    records_scanned: int = 0
    valid: int = 0
    empty: int = 0
    missing_text_field: int = 0
    malformed_json: int = 0
    invalid_unicode: int = 0
    too_short: int = 0
    too_long: int = 0
    duplicates: int = 0
    metadata_inconsistencies: int = 0
    final_usable: int = 0
    files: list[dict] = field(default_factory=list)
    duplicate_hashes: Hashes = field(default_factory=Hashes)

    @property
    def invalid_total(self) -> int:
        return self.empty + self.missing_text_field + self.malformed_json + self.invalid_unicode + self.too_short + self.too_long

    def to_dict(self) -> dict:
        return asdict(self)

    def summary(self) -> str:
        shown = [("Files scanned", self.files_scanned), ("Records scanned", self.records_scanned), ("Valid", self.valid), ("Empty", self.empty), ("Missing text", self.missing_text_field), ("Malformed JSON", self.malformed_json), ("Invalid Unicode", self.invalid_unicode), ("Too short", self.too_short), ("Too long", self.too_long), ("Duplicates", self.duplicates), ("Metadata issues", self.metadata_inconsistencies), ("Final usable", self.final_usable)]
        return "DATA VALIDATION\n" + "\n".join(f"{k + ':':<18}{v:,}" for k, v in shown)


def text_status(text: Column, config: ValidationConfig, kind: Column | None = None, keys: Column | None = None) -> Column:
    """The first status of a row that applies, before duplicates; null: none."""
    status = F.when(text.isNull(), "missing_text_field") if kind is None else F.when(kind == "blank", "empty").when(kind == "malformed", "malformed_json").when(kind == "not_text", "missing_text_field")
    status = status.when(tx.is_blank(text), "empty")
    if config.min_chars > 0:
        status = status.when(F.length(text) < config.min_chars, "too_short")
    if config.max_chars > 0:
        status = status.when(F.length(text) > config.max_chars, "too_long")
    status = status.when(~F.is_valid_utf8(text), "invalid_unicode")
    if keys is not None and config.expected_fields:
        status = status.when(~F.forall(F.array(*[F.lit(f) for f in config.expected_fields]), lambda f: F.array_contains(keys, f)), "metadata_inconsistencies")
    return status


def with_status(df: DataFrame, *order: str, text: str = "text", config: ValidationConfig | None = None, kind: str | None = None, keys: str | None = None) -> DataFrame:
    """df with status (ValueError if there is one); a text seen before among rows without another fault is a duplicate.

    The window runs over a key that is null for faulty rows, and these have a key of their own each so
    that they do not meet in one partition.
    """
    config = config or ValidationConfig()
    if "status" in df.columns:
        raise ValueError("the table has a column status already")
    fault, key = uuid.uuid4().hex, uuid.uuid4().hex  # names that no column of df has
    first = df.withColumn(fault, text_status(F.col(text), config, None if kind is None else F.col(kind), None if keys is None else F.col(keys)))
    if not config.check_duplicates:
        return first.withColumn("status", F.coalesce(fault, F.lit("valid"))).drop(fault)
    faulty = F.concat_ws("-", F.lit("x"), *[F.col(c).cast("string") for c in order])
    keyed = first.withColumn(key, F.when(F.col(fault).isNull(), tx.dedup_key(F.col(text), config.dedup_normalization)).otherwise(faulty))
    rank = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return keyed.withColumn("status", F.coalesce(fault, F.when(rank > 1, "duplicates").otherwise("valid"))).drop(fault, key)


def counts(statuses: DataFrame) -> DataFrame:
    """One row: records_scanned, a column per status, invalid_total and final_usable."""
    found = statuses.agg(F.count("*").alias("records_scanned"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    invalid = sum((F.col(s) for s in STATUSES[1:6]), F.col("empty"))
    return found.withColumn("invalid_total", invalid).withColumn("final_usable", F.col("valid") - F.col("duplicates"))


def validate_files(spark: SparkSession, paths: str | list[str], config: ValidationConfig | None = None, hashes_path: str | None = None) -> ValidationReport:
    """The report over JSON lines files; files that are missing are listed with an error.

    The hashes of all duplicates are written as a table to hashes_path, or else to the shared folder.
    """
    import os

    config = config or ValidationConfig()
    files = jsonl.expand(paths)
    lines = jsonl.read_lines(spark, files, missing="skip")
    # a line that is no UTF-8 is a fault of its own; the rest of its file is still read
    valid = F.is_valid_utf8("raw")
    parsed = jsonl.parse(lines.withColumn("ok", valid).withColumn("raw", F.when(valid, F.col("raw")).otherwise("{}")), config.text_field)
    found = with_status(parsed, "file", "block", "seq", config=config, kind="kind", keys="keys").withColumn("status", F.when(~F.col("ok"), "invalid_unicode").otherwise(F.col("status")))
    found = found.select("file", "block", "seq", "status", tx.dedup_key(F.col("text"), config.dedup_normalization).alias("key")).persist()
    try:
        row = counts(found).drop("invalid_total").first().asDict()
        per = {r["file"]: r for r in found.groupBy("file").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "valid").alias("valid")).collect()}
        hashes = Hashes(hashes_path or shared_folder(spark), row["duplicates"])
        found.filter("status = 'duplicates'").select("file", "block", "seq", "key").write.mode("overwrite").parquet(hashes.path)
    finally:
        found.unpersist()
    listed = [{"path": p, "exists": os.path.exists(p), "records": per[i]["n"] if i in per else 0, "valid": per[i]["valid"] if i in per else 0, "errors": [] if os.path.isfile(p) else ["file not found" if not os.path.exists(p) else "not a regular file"]} for i, p in enumerate(files)]
    return ValidationReport(files_scanned=len(files), files=listed, duplicate_hashes=hashes, **row)
