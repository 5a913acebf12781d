"""Operator 3: prediction by partial matching over bytes.

The trie of byte contexts is held as tables, one per order. The highest order counts occurrences in
the training texts; a lower order counts the longer contexts a symbol was seen in, which is what
updating with exclusion leaves there. A symbol is coded at the longest context that knows it, by
(c - 1/2) / T; not being known costs the escape q / 2T (q: distinct symbols there, method D) and,
one order down, the symbols already seen above are excluded from T and q. Below order 0 all symbols
not seen at order 0 are alike. The code length of an n-gram depends on the n-gram alone, so it is
worked out once for each distinct one by joins, and goes back to the texts (see _grams).

Texts are whole, and end with an end symbol, so the probabilities of all texts add up to one. The
baseline counts words as the contract says.

Defined results: a null or empty text is the end alone; a null doc_id is trained on; repeated rows
count as often as they stand; with no training text every symbol has probability 1/255; extra
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _grams as gr
from tessera.llm._io import CHUNK_BYTES, arrow_limits, materialise, text_bytes

ORDER = 5
SYMBOLS = 255  # the bytes of UTF-8 and the end


def code_lengths(counts: DataFrame, order: int) -> DataFrame:
    """part, g, value: log10 of the probability of each n-gram's last byte after the others."""
    tables = gr.levels(counts, order, materialise)
    nodes = {}
    for j in range(order, -1, -1):
        grams = tables[j].select("g", "c", F.expr("shiftright(g, 8)").alias("x"))
        if j:
            below = tables[j - 1].select(F.col("g").alias("low"), F.col("c").alias("cl"))
            grams = grams.withColumn("low", F.expr(gr.suffix("g", j - 1))).join(below, "low", "left")
        else:
            grams = grams.withColumn("cl", F.lit(0))
        # total, distinct symbols, and what the symbols seen here count one order down
        nodes[j] = materialise(grams.groupBy("x").agg(F.sum("c").alias("t"), F.count("*").alias("q"), F.sum("cl").alias("s")))
    known = counts.filter("c > 0").withColumn("x", F.expr("shiftright(g, 8)")).join(nodes[order], "x").select("part", "g", F.expr("log10((c - 0.5D) / t)").alias("value"))

    # the others escape from order to order; s and q carry what is excluded
    found = counts.filter("c = 0").select("part", "g", F.lit(0.0).alias("value"), F.lit(False).alias("done"), F.lit(0).cast("long").alias("es"), F.lit(0).cast("long").alias("eq"))
    for j in range(order, -1, -1):
        gram, context = gr.suffix("g", j), f"shiftright({gr.suffix('g', j)}, 8)"
        found = found.withColumn("gj", F.expr(gram)).join(tables[j].select(F.col("g").alias("gj"), "c"), "gj", "left")
        found = found.withColumn("x", F.expr(context)).join(nodes[j], "x", "left")
        total, distinct = "(coalesce(t, 0) - es)", "(coalesce(q, 0) - eq)"
        here = F.expr(f"case when done or t is null then 0.0 when c is not null then log10((c - 0.5D) / {total}) when {distinct} > 0 then log10(0.5D * {distinct} / {total}) else 0.0 end")
        found = found.select("part", "g", (F.col("value") + here).alias("value"), F.expr("done or c is not null").alias("done"), F.expr("coalesce(s, 0)").alias("es"), F.expr("coalesce(q, 0)").alias("eq"))
    last = F.when(F.col("done"), F.col("value")).otherwise(F.col("value") - F.log10(F.greatest(F.lit(SYMBOLS) - F.col("eq"), F.lit(1))))
    return known.unionByName(found.select("part", "g", last.alias("value")))


def score(documents: DataFrame, held_out: str, order: int = ORDER, chunk_bytes: int = CHUNK_BYTES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's log10 probability under the model and the word baseline, learned from rows not held_out (SQL)."""
    arrow_limits(documents.sparkSession)
    parts = gr.parts_for(text_bytes(documents, text), chunk_bytes)
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.lit(None).cast("string").alias("tag"), F.expr(f"not coalesce({held_out}, false)").alias("train"))
    scanned = materialise(gr.scan(rows, order, parts, words=True, chunk_bytes=chunk_bytes), "kind")
    grams, words = scanned.filter("kind = 1"), scanned.filter("kind = 2")
    lengths = code_lengths(materialise(gr.totals(grams)), order)
    n, v = gr.totals(words).agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    brought = gr.deliver(grams, lengths).unionByName(gr.shared_totals(words))
    floor = math.log10(n + 0.5 * (v + 1))

    def finish(docs, tags, train, sums, symbols, column, tables):
        keys, bounds = gr.word_keys(column)
        known, counts = tables[2]
        c = counts[np.searchsorted(known, keys)]
        base = np.concatenate([[0.0], np.cumsum(np.log10(c + 0.5) - floor)])
        seen = np.concatenate([[0], np.cumsum(c > 0)])
        a, b = bounds[:-1], bounds[1:]
        size = len(docs)
        columns = [pa.array(docs, pa.int64()), pa.array([not x for x in train], pa.bool_()), pa.array(b - a, pa.int64()), pa.array(seen[b] - seen[a], pa.int64()), pa.array(np.full(size, n), pa.int64()), pa.array(base[b] - base[a], pa.float64()), pa.array(sums, pa.float64()), pa.array(symbols, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_symbols"])

    return gr.score(scanned, brought, order, finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_symbols long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), "crc32(cast(doc_id as string)) % 5 = 1")
