"""Cleaning: Unicode form, control characters, white space, empty and repetitive texts."""

from __future__ import annotations

import re
import unicodedata
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.validate import ConfigError


@dataclass
class CleaningConfig:
    unicode_normalization: str = "NFC"
    normalize_whitespace: bool = True
    remove_control_chars: bool = True
    remove_empty: bool = True
    remove_excessive_repetition: bool = True
    repetition_threshold: float = 0.5
    repetition_min_lines: int = 10

    def __post_init__(self):
        if self.unicode_normalization not in tx.UNICODE_FORMS:
            raise ConfigError("unknown Unicode form", "unicode_normalization", self.unicode_normalization)
        if not 0 < self.repetition_threshold <= 1:
            raise ConfigError("must be within (0, 1]", "repetition_threshold", self.repetition_threshold)
        if self.repetition_min_lines < 1:
            raise ConfigError("must be at least 1", "repetition_min_lines", self.repetition_min_lines)


@dataclass
class CleaningReport:
    records_in: int = 0
    records_out: int = 0
    unicode_normalized: int = 0
    whitespace_normalized: int = 0
    control_chars_removed: int = 0
    empty_removed: int = 0
    repetition_removed: int = 0
    malformed_removed: int = 0
    chars_in: int = 0
    chars_out: int = 0

    def to_dict(self) -> dict:
        return asdict(self)

    def summary(self) -> str:
        return "DATA CLEANING\n" + "\n".join(f"{k.replace('_', ' ').capitalize() + ':':<24}{v:,}" for k, v in asdict(self).items())


def steps(text: Column, config: CleaningConfig) -> list[tuple[str, Column]]:
    """The text after each step that is switched on, by name."""
    out, now = [], text
    if config.unicode_normalization != "none":
        out.append(("unicode_normalized", now := tx.unicode_norm(now, config.unicode_normalization)))
    if config.remove_control_chars:
        out.append(("control_chars_removed", now := tx.strip_control(now)))
    if config.normalize_whitespace:
        out.append(("whitespace_normalized", now := tx.fold_lines(now)))
    return out


def _judged(df: DataFrame, text: str, config: CleaningConfig) -> DataFrame:
    """row (a struct of df's columns, whatever their names), what each step that is on changed, reason and clean."""
    step = {"unicode_normalized": lambda c: tx.unicode_norm(c, config.unicode_normalization), "control_chars_removed": tx.strip_control, "whitespace_normalized": tx.fold_lines}
    own = uuid.uuid4().hex  # a name that no column of df has

    def once(rows: DataFrame, *made: Column) -> DataFrame:
        """rows with a struct of columns that are worked out once, whatever reads or filters them later."""
        return rows.withColumn("made", F.explode(F.array(F.struct(*made))))

    rows, now, changed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(text).alias("now")), F.col("now"), []
    for name, _ in steps(F.lit(""), config):
        made = F.col(f"made.{own}")
        rows = once(rows, step[name](now).alias(own)).select("row", *changed, made.alias("now"), (made != now).alias(name))
        changed.append(name)
    reason = F.lit(None).cast("string")
    if config.remove_excessive_repetition:
        reason = F.when(tx.is_repetitive(now, config.repetition_threshold, config.repetition_min_lines), "repetition_removed")
    if config.remove_empty:
        reason = F.when(tx.is_blank(now), "empty_removed").otherwise(reason)
    rows = once(rows, reason.alias("reason"))
    return rows.select("row", *changed, F.col("made.reason").alias("reason"), F.when(F.col("made.reason").isNull(), now).alias("clean"))


def cleaned(df: DataFrame, text: str = "text", config: CleaningConfig | None = None) -> DataFrame:
    """df with clean (null: removed), reason, and what each step changed; ValueError if df has a column of such a name."""
    config = config or CleaningConfig()
    names = [*[name for name, _ in steps(F.lit(""), config)], "reason", "clean"]
    if clash := [c for c in df.columns if c in names]:
        raise ValueError(f"the table has columns {clash} already")
    return _judged(df, text, config).select(*[F.col("row").getField(c).alias(c) for c in df.columns], *names)


def clean(df: DataFrame, text: str = "text", config: CleaningConfig | None = None) -> DataFrame:
    """The rows that stay, with their text cleaned and all other columns, of whatever name, as they were."""
    found = _judged(df, text, config or CleaningConfig()).filter(F.col("clean").isNotNull())
    return found.select(*[F.col("clean").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in df.columns])


def report(df: DataFrame, text: str = "text", config: CleaningConfig | None = None) -> DataFrame:
    """One row of counters; what steps changed is counted on rows that stay, removals by reason as well."""
    found = _judged(df, text, config or CleaningConfig())
    stays = F.col("clean").isNotNull()
    flag = lambda c: F.count_if(stays & F.col(c)) if c in found.columns else F.lit(0).cast("long")
    return found.agg(
        F.count("*").alias("records_in"),
        F.count_if(stays).alias("records_out"),
        *[flag(c).alias(c) for c in ("unicode_normalized", "whitespace_normalized", "control_chars_removed")],
        *[F.count_if(F.col("reason") == c).alias(c) for c in ("empty_removed", "repetition_removed")],
        F.coalesce(F.sum(F.length(F.col("row").getField(text))), F.lit(0)).cast("long").alias("chars_in"),
        F.coalesce(F.sum(F.length("clean")), F.lit(0)).cast("long").alias("chars_out"),
    )


def clean_text(text: str, config: CleaningConfig | None = None) -> str | None:
    """The same rules for one string on the driver."""
    config = config or CleaningConfig()
    if config.unicode_normalization != "none":
        text = unicodedata.normalize(config.unicode_normalization, text)
    if config.remove_control_chars:
        text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", text)
    if config.normalize_whitespace:
        text = "\n".join(" ".join(x.split()) for x in text.split("\n")).strip()
    if config.remove_empty and not text.strip():
        return None
    lines = sorted(text.split("\n"))
    if config.remove_excessive_repetition and len(lines) >= config.repetition_min_lines:
        most = run = 1
        for a, b in zip(lines, lines[1:]):
            run = run + 1 if a == b else 1
            most = max(most, run)
        if most / len(lines) >= config.repetition_threshold:
            return None
    return text
