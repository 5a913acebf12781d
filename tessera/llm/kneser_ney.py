"""Operator 5: a quality classifier by perplexity under an interpolated modified Kneser-Ney model.

The model is over bytes (five-grams by default), trained on trusted text: labelled rows of quality 1
that are not toxic, all of them. Their ids are broadcast if counted to be at most `max_broadcast`, and joined
by a shuffle otherwise; the model and the thresholds are the same either way. Counts are sharded and joined (see _grams): the highest
order discounts occurrences, lower orders continuation counts, with three discounts per order from
the counts of counts. Each distinct n-gram's probability is worked out once and goes back to the
texts, which gives each row's perplexity per byte.

One trusted row in FOLDS is not trained on. A row is kept if its perplexity is at most its language's
threshold: the given quantile of those held-out rows in that language, times a margin. Languages with
fewer than `min_trusted` of them, and null, use the quantile over all held-out rows (over the trained
ones if none is held out); with no trusted rows at all every row is kept.

Defined results: a null or empty text is the end symbol alone; repeated rows are judged row by row;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _grams as gr
from tessera.llm._io import CHUNK_BYTES, arrow_limits, materialise, rows_of, text_bytes

ORDER = 4
#: Trusted ids up to which they are broadcast.
MAX_BROADCAST = 1 << 20
MIN_TRUSTED = 50
FOLDS = 5
QUANTILE = 0.99
MARGIN = 1.1
TRUSTED = "quality = 1 and toxic = 0"


def discounts(table: DataFrame) -> tuple[float, float, float]:
    """D1, D2, D3+ from how many n-grams have counts 1 to 4."""
    n1, n2, n3, n4 = (int(x) for x in table.agg(*[F.count_if(F.col("c") == k) for k in (1, 2, 3, 4)]).first())
    if not (n1 and n2):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n3 else 1.0, 3 - 4 * y * n4 / n3 if n3 and n4 else 1.5)
    return tuple(min(max(d, 0.1), k - 0.05) for k, d in enumerate(found, 1))


def log_probabilities(counts: DataFrame, order: int) -> DataFrame:
    """part, g, value: natural log of the interpolated probability of each n-gram's last byte."""
    tables = gr.levels(counts, order, materialise)
    asked = {order: counts.select("g")}
    for j in range(order - 1, -1, -1):
        asked[j] = materialise(asked[j + 1].select(F.expr(gr.suffix("g", j)).alias("g")).distinct())
    lower = None
    for j in range(order + 1):
        d1, d2, d3 = discounts(tables[j])
        taken = f"case c when 1 then {d1!r}D when 2 then {d2!r}D else {d3!r}D end"
        context = "shiftright(g, 8)"
        nodes = tables[j].groupBy(F.expr(context).alias("x")).agg(F.sum("c").alias("t"), F.sum(F.expr(taken)).alias("left"))
        rows = asked[j].join(tables[j].select("g", "c"), "g", "left").withColumn("x", F.expr(context)).join(nodes, "x", "left")
        if lower is None:
            rows = rows.withColumn("p", F.lit(1 / 255))
        else:
            rows = rows.withColumn("low", F.expr(gr.suffix("g", j - 1))).join(lower.select(F.col("g").alias("low"), F.col("p")), "low")
        p = F.expr(f"case when t is null then p else (coalesce(c - {taken}, 0.0D) + left * p) / t end")
        lower = materialise(rows.select("g", p.alias("p")))
    return counts.select("part", "g").join(lower, "g").select("part", "g", F.log("p").alias("value"))


def trusted_ids(labels: DataFrame, trusted: str = TRUSTED) -> DataFrame:
    """doc_id, train: all trusted rows; one in FOLDS is not trained on, for the thresholds."""
    ids = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.coalesce(F.expr(f"cast(({trusted}) as int)"), F.lit(0))).alias("ok")).filter("ok = 1 and doc_id is not null")
    return ids.select("doc_id", F.expr(f"pmod(xxhash64(doc_id, 1), {FOLDS}) > 0").alias("train"))


def _sent(ids: DataFrame, max_broadcast: int) -> DataFrame:
    """ids, written, to be broadcast if they are few."""
    ids = materialise(ids)
    return F.broadcast(ids) if ids.count() <= max_broadcast else ids


def perplexities(documents: DataFrame, labels: DataFrame, order: int = ORDER, max_broadcast: int = MAX_BROADCAST, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, lang, version (hash of the text), trained, n_symbols, perplexity of every row."""
    arrow_limits(documents.sparkSession)
    parts = gr.parts_for(text_bytes(documents), chunk_bytes)
    trusted = _sent(trusted_ids(labels).filter("train"), max_broadcast)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.expr("concat(lpad(hex(xxhash64(cast(text as string))), 16, '0'), coalesce(concat(' ', cast(lang as string)), ''))").alias("tag")).join(trusted, "doc_id", "left").withColumn("train", F.coalesce("train", F.lit(False)))
    scanned = materialise(gr.scan(rows, order, parts, chunk_bytes=chunk_bytes), "kind")
    grams = scanned.filter("kind = 1")
    values = log_probabilities(materialise(gr.totals(grams)), order)

    def finish(docs, tags, train, sums, symbols, column, tables):
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(tags, pa.string()), pa.array(train, pa.bool_()), pa.array(symbols, pa.int64()), pa.array(sums, pa.float64())], names=["doc_id", "tag", "trained", "n_symbols", "log_p"])

    found = gr.score(scanned, gr.deliver(grams, values, "<f4"), order, finish, "doc_id long, tag string, trained boolean, n_symbols long, log_p double", "<f4")
    return found.select("doc_id", F.expr("if(length(tag) > 16, substring(tag, 18), null)").alias("lang"), F.substring("tag", 1, 16).alias("version"), "trained", "n_symbols", F.exp(-F.col("log_p") / F.col("n_symbols")).alias("perplexity"))


def _classified(documents: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, min_trusted: int = MIN_TRUSTED, max_broadcast: int = MAX_BROADCAST, **options) -> DataFrame:
    """perplexities() with threshold and kept."""
    scores = materialise(perplexities(documents, labels, max_broadcast=max_broadcast, **options))
    held = _sent(trusted_ids(labels).filter("not train"), max_broadcast)
    trusted = scores.join(held.select("doc_id"), "doc_id", "left_semi")
    cut = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10000)) * F.lit(margin)
    overall = trusted.agg(cut.alias("threshold")).first()[0]
    if overall is None:  # too few to hold any out
        overall = scores.filter("trained").agg(cut.alias("threshold")).first()[0]
    by_lang = materialise(trusted.filter("lang is not null").groupBy("lang").agg(cut.alias("threshold"), F.count("*").alias("n")).filter(F.col("n") >= min_trusted).select("lang", "threshold"))
    if by_lang.count() <= 4096:  # a language and a number each
        by_lang = F.broadcast(by_lang)
    cut = F.coalesce("threshold", F.lit(float(overall) if overall is not None else float("inf")))
    return scores.join(by_lang, "lang", "left").withColumn("threshold", cut).select("doc_id", "lang", "version", "trained", "n_symbols", "perplexity", "threshold", F.expr("perplexity <= threshold").alias("kept"))


def classify(documents: DataFrame, labels: DataFrame, *args, **options) -> DataFrame:
    """doc_id, lang, trained, n_symbols, perplexity, threshold and kept of every row; parameters as _classified() has them."""
    return _classified(documents, labels, *args, **options).drop("version")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs whose perplexity stays within their language's threshold, with all their columns; null and repeated doc_ids are judged row by row."""
    kept = _classified(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("kept")
    return rows_of(docs, kept.select("doc_id", F.expr("cast(conv(version, 16, -10) as bigint)").alias("version"), "lang").distinct())
