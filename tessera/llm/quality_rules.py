"""Operator 4: quality rules whose cutoffs carry a guarantee on wrongly rejected documents.

Each rule compares one statistic of a text with a cutoff. Cutoffs are learned per stratum
(language): going from the most lenient cutoff of a fixed grid to stricter ones, each step is
tested on labelled good documents with the exact (Clopper-Pearson) upper bound on the share that
would be rejected; the walk ends at the first step whose bound exceeds the rule's share of the
allowed false rejection. Within a rule the walk is a fixed sequence, which costs no level; across
rules and strata the level is divided (Bonferroni), so that with probability 1 - delta no stratum
loses more than `max_false_rejection` of its good documents to all learned rules together. A
stratum with too few labels to certify even the most lenient step keeps everything.

Defined results: a null or empty text has no words, so base_failed is true; a null language is a
stratum of its own; documents without labels are judged but teach nothing; repeated doc_ids are
judged row by row, and labels that repeat an id count once, good only if every row says so; with no
labels at all no cutoff is learned. Extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _text as t
from tessera.llm._io import arrow_limits, materialise, rows_of

STATISTICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", dtype=np.uint8))

#: Rule: the statistic as a SQL expression (never null, larger is worse), and its cutoffs from lenient to strict.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols_per_word": ("n_symbols / greatest(n_words, 1)", tuple(round(3.0 * 0.93**k, 6) for k in range(48))),
    "duplicate_lines": ("n_dup_lines / greatest(n_lines, 1)", tuple(round(1.0 - 0.015 * k, 6) for k in range(48))),
    "repeated_words": ("n_repeat_words / greatest(n_words, 1)", tuple(round(0.5 - 0.01 * k, 6) for k in range(48))),
    "long_words": ("word_chars / greatest(n_words, 1)", tuple(round(40.0 * 0.96**k, 6) for k in range(48))),
    "short_words": ("-word_chars / greatest(n_words, 1)", tuple(round(-1.0 - 0.06 * k, 6) for k in range(48))),
}


@dataclass(frozen=True)
class Risk:
    max_false_rejection: float = 0.02
    delta: float = 0.05


def statistics(column) -> dict[str, np.ndarray]:
    """The statistics of every text of an Arrow column."""
    data, offsets = t.utf8(column)
    n = len(offsets) - 1
    starts, ends = t.spans(~t.blank(data), offsets)
    texts = t.owner(starts, offsets)
    n_words = np.bincount(texts, minlength=n)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    word_chars = np.bincount(texts, weights=points[ends] - points[starts], minlength=n).astype(np.int64)
    signs = np.concatenate([[0], np.cumsum(_SYMBOLS[data])])
    n_symbols = signs[offsets[1:]] - signs[offsets[:-1]]
    # lines that hold a word and equal an earlier one of the same text
    begin, end = t.spans(data != 10, offsets)
    of = t.owner(begin, offsets)
    worded = np.searchsorted(starts, end, side="left") > np.searchsorted(starts, begin, side="left")
    begin, end, of = begin[worded], end[worded], of[worded]
    n_lines = np.bincount(of, minlength=n)
    seen = t.span_hashes(data, begin, end)
    order = np.lexsort((seen, of))
    again = (seen[order][1:] == seen[order][:-1]) & (of[order][1:] == of[order][:-1])
    n_dup = np.bincount(of[order][1:][again], minlength=n)
    # words in three-word windows that occur twice or more
    triples = t.joined(t.span_hashes(data, starts, ends), 3)
    inside = texts[2:] == texts[:-2]
    where, keys, of = np.flatnonzero(inside), triples[inside], texts[: len(triples)][inside]
    order = np.lexsort((keys, of))
    same = (keys[order][1:] == keys[order][:-1]) & (of[order][1:] == of[order][:-1])
    twice = np.zeros(len(keys), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    marked = np.zeros(len(starts) + 2, dtype=bool)
    hit = where[order[twice]]
    for k in range(3):
        marked[hit + k] = True
    n_repeat = np.bincount(texts[marked[: len(texts)]], minlength=n)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat, "n_lines": n_lines}


def with_statistics(documents: DataFrame, id_col: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, version (hash of the text) and the statistics of each row; only three columns are read."""
    arrow_limits(documents.sparkSession)

    def run(batches):
        for batch in batches:
            for a, b in t.pieces(batch.column(2)):
                part = batch.slice(a, b - a)
                found = statistics(part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), *(pa.array(v.astype(np.int64)) for v in found.values())], names=["doc_id", "stratum", "version", *found])

    narrow = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(stratum).cast("string").alias("stratum"), F.col(text).cast("string").alias("text")).withColumn("version", F.xxhash64("text"))
    return narrow.mapInArrow(run, f"doc_id long, stratum string, version long, {STATISTICS}")


def upper_bound(k: int, n: int, level: float) -> float:
    """Clopper-Pearson: the largest share whose chance of at most k among n is still `level`."""
    if n == 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    i = np.arange(k + 1)
    coefficient = math.lgamma(n + 1) - np.array([math.lgamma(x + 1) + math.lgamma(n - x + 1) for x in i])
    for _ in range(60):
        p = (low + high) / 2
        logs = coefficient + i * math.log(p) + (n - i) * math.log1p(-p) if 0 < p < 1 else np.array([-np.inf])
        top = logs.max()
        chance = math.exp(top) * np.exp(logs - top).sum() if np.isfinite(top) else 0.0
        low, high = (p, high) if chance > level else (low, p)
    return high


def walk(rejected: list[int], n: int, share: float, level: float) -> int:
    """How many cutoffs of the sequence are certified; rejected: good documents that each rejects."""
    for step, k in enumerate(rejected):
        if upper_bound(k, n, level) > share:
            return step
    return len(rejected)


def _at_least(value):
    return lambda cutoff: cutoff >= value


def learn(measured: DataFrame, labels: DataFrame, risk: Risk = Risk(), good: str = "quality = 1") -> DataFrame:
    """A row per stratum: stratum, n_good, and the certified cutoff of each rule (null: none).

    Only labelled good rows that pass the base rule count. What reaches one task is a table of at
    most rules x (grid + 1) counts per stratum.
    """
    told = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.coalesce(F.expr(f"cast(({good}) as int)"), F.lit(0))).alias("good")).filter("good = 1")
    held = measured.filter("not base_failed").join(told.select("doc_id"), "doc_id", "left_semi")
    steps = []
    for name, (value, grid) in RULES.items():
        cut = F.array(*[F.lit(float(x)) for x in grid])
        # the first cutoff that rejects the row; all stricter ones reject it too
        first = F.size(F.filter(cut, _at_least(F.expr(value).cast("double"))))
        steps.append(F.struct(F.lit(name).alias("rule"), first.cast("int").alias("first")))
    counts = held.select("stratum", F.explode(F.array(*steps)).alias("s")).groupBy("stratum", "s.rule", "s.first").count()
    strata = max(1, int(held.agg(F.count_distinct(F.struct(F.col("stratum").isNull(), F.coalesce("stratum", F.lit(""))))).first()[0] or 0))
    share, level = risk.max_false_rejection / len(RULES), risk.delta / (len(RULES) * strata)
    grids = {k: v[1] for k, v in RULES.items()}

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict = {"stratum": pdf["stratum"].iloc[0], "n_good": 0}
        for name, grid in grids.items():
            own = pdf[pdf["rule"] == name]
            n = int(own["count"].sum())
            rejected = [int(own.loc[own["first"] <= k, "count"].sum()) for k in range(len(grid))]
            passed = walk(rejected, n, share, level)
            out |= {"n_good": n, name: float(grid[passed - 1]) if passed else None}
        return pd.DataFrame([out])

    return counts.groupBy("stratum").applyInPandas(fit, "stratum string, n_good long, " + ", ".join(f"{k} double" for k in RULES))


def judge(documents: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """Per row of documents: the statistics, base_failed, kept, and the rules that rejected it."""
    base = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words").alias("base_failed")
    measured = materialise(with_statistics(documents).select("*", base))
    cutoffs = materialise(learn(measured, labels, risk))
    if cutoffs.count() <= 4096:  # a row of a few numbers each
        cutoffs = F.broadcast(cutoffs)
    joined = measured.alias("m").join(cutoffs.alias("c"), F.col("m.stratum").eqNullSafe(F.col("c.stratum")), "left")
    failed = F.array_compact(F.array(*[F.when(F.expr(value).cast("double") > F.col(f"c.{name}"), F.lit(name)) for name, (value, _) in RULES.items()]))
    return joined.select("m.*", failed.alias("rejected_by")).withColumn("kept", F.expr("not base_failed and size(rejected_by) = 0"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns; null and repeated doc_ids are judged row by row."""
    verdicts = judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("kept").select("doc_id", "version", F.col("stratum").alias("lang"))
    return rows_of(docs, verdicts.distinct())
