"""Operator 11: what each filter of a chain removes, in every order of the filters.

A row of facts says by a bit for each filter which ones a document fails; the counts of all orders
follow from the counts of each combination of bits, so nothing is filtered twice. The last filter,
identity with the text of a smaller doc_id, is found by partition refinement: rows are split by
length in code points, then by the hash of one block of the text after another (each block GROWTH
times as long as the one before), and rows that are alone in their class go after every split. The
texts of what is left are compared in full; those who are not the least doc_id of their text fail.

Block hashes of a row are made in the one pass that reads its text, so that refining moves numbers
only. Texts are compared by an aggregate whose first half runs where the texts lie: a group of copies
leaves one row per task. Should a class hold two texts all the same, its rows are told apart by text.

Defined results: a null text is an empty one, a null language part ''; rows without doc_id are counted,
have no labels and never fail E (null is not larger than any id); rows that repeat a doc_id are counted
each, and are not copies of each other; labels that repeat an id say yes if any of them does; an empty
table has no parts and gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._io import arrow_limits, drop, materialise

LETTERS = "ABCDE"
MIN_WORDS = 200
#: Code points of the first block, and how many times longer each next one is.
FIRST_BLOCK, GROWTH = 512, 8
#: Blocks that reach the longest text a column can hold (2^31 bytes).
N_BLOCKS = 8
#: Classes whose keys, of 8 bytes, are broadcast.
BROADCAST_CLASSES = 1 << 20

_UPPER, _SIGNS, _INNER = bytes(range(65, 91)), b"#$%&*|", bytes(range(128, 192))


def failed(text: bytes) -> int:
    """Bits of the filters A to D that a text fails, A lowest."""
    words = text.split()  # at the six ASCII white spaces
    points = len(text.translate(None, _INNER))
    upper, signs = (len(text) - len(text.translate(None, x)) for x in (_UPPER, _SIGNS))
    return (len(words) < MIN_WORDS) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * upper > 3 * points) << 2 | (signs > 0) << 3


def block_hash(block: Column) -> Column:
    return F.xxhash64(block)


def blocks(text: Column) -> Column:
    """Hashes of the blocks that a text reaches; null beyond its end."""
    at, size, out = 0, FIRST_BLOCK, []
    for _ in range(N_BLOCKS):
        out.append(F.when(F.length(text) > at, block_hash(F.substr(text, F.lit(at + 1), F.lit(size)))))
        at, size = at + size, size * GROWTH
    return F.array(*out)


def _rows(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    return named.select("*", F.length("text").alias("points"), blocks(F.col("text")).alias("blocks"))


def _class(n: int) -> Column:
    """The class after the split by length and by n blocks."""
    key = F.xxhash64("points")
    for k in range(n):
        key = F.when(F.col("blocks")[k].isNull(), key).otherwise(F.xxhash64(key, F.col("blocks")[k]))
    return key


def _facts(rows: DataFrame, *more: str) -> DataFrame:
    """doc_id, part, fails (A to D), points, blocks, and the columns of longs named in more."""
    arrow_limits(rows.sparkSession)
    names = ["doc_id", "part", "fails", "points", "blocks", *more]

    def run(batches):
        for batch in batches:
            texts = batch.column(0).cast(pa.large_binary())
            fails = pa.array([failed(x.as_buffer().to_pybytes()) for x in texts], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), fails, *batch.columns[3:]], names=names)

    schema = "doc_id long, part string, fails int, points int, blocks array<long>" + "".join(f", {c} long" for c in more)
    return rows.select("text", "doc_id", "part", "points", "blocks", *more).mapInArrow(run, schema)


def _shared(rows: DataFrame) -> DataFrame:
    """The rows whose class has another row."""
    many = rows.groupBy("class").agg(F.count("*").alias("n")).filter("n > 1").select("class")
    return rows.join(many, "class", "left_semi")


def refine(facts: DataFrame) -> DataFrame:
    """class: those left when rows are split by length and then by each block, singletons dropped each time."""
    alive = materialise(_shared(facts.select("blocks", "points").withColumn("class", _class(0))))
    reach = alive.agg(F.max(F.size(F.filter("blocks", lambda x: x.isNotNull())))).first()[0] or 0
    for k in range(reach):
        split = materialise(_shared(alive.select("blocks", "points").withColumn("class", _class(k + 1))))
        drop(alive)
        alive = split
    return alive.select(_class(N_BLOCKS).alias("class")).distinct()  # the same class: no text reaches further


def copies(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """facts with first: the least doc_id of the same text, where other rows share the class."""
    classes = materialise(refine(facts))
    n = classes.count()
    if n <= BROADCAST_CLASSES:
        classes = F.broadcast(classes)
    texts = rows.withColumn("class", _class(N_BLOCKS)).join(classes, "class", "left_semi")
    same = texts.groupBy("class", "text").agg(F.min("doc_id").alias("first"))
    found = materialise(same.groupBy("class").agg(F.count("*").alias("n_texts"), F.min("first").alias("first")))
    keyed = facts.withColumn("class", _class(N_BLOCKS))
    out = keyed.join(found.filter("n_texts = 1").select("class", "first"), "class", "left")
    doubtful = found.filter("n_texts > 1").select("class")
    if doubtful.isEmpty():
        return out.drop("class")
    # texts that differ and agree in length and all hashes
    own = texts.join(doubtful, "class", "left_semi")
    least = own.groupBy("class", "text").agg(F.min("doc_id").alias("first"))
    apart = _facts(own.join(least, ["class", "text"]).drop("class"), "first")
    return out.join(doubtful, "class", "left_anti").drop("class").unionByName(apart)


def facts_of(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (a bit for each filter), good, toxic for every document."""
    rows = _rows(documents)
    found = copies(rows, materialise(_facts(rows)))
    last = F.when(F.col("doc_id") > F.col("first"), 1 << 4).otherwise(0)
    yes = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").groupBy("doc_id").agg(yes("quality"), yes("toxic"))
    marks = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))]
    return found.join(named, "doc_id", "left").select("part", (F.col("fails").bitwiseOR(last)).alias("fails"), *marks)


def audit(facts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Counts for each part, order of the filters and step; facts as facts_of() makes them, bit k for letters[k].

    A part is one row of at most 2 ** len(letters) combinations before its orders are spelt out. A filter
    comes first among the m that a document fails in one order of m.
    """
    bit = {x: 1 << k for k, x in enumerate(letters)}
    orders = [
        {"filter_order": "".join(o), "step": k + 1, "bit": bit[o[k]], "before": sum(bit[x] for x in o[:k])}
        for o in permutations(letters)
        for k in range(len(o))
    ]
    table = F.from_json(F.lit(json.dumps(orders)), "array<struct<filter_order: string, step: int, bit: int, before: int>>")
    per = facts.groupBy("part", "fails").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    cells = per.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("cells"))
    steps = cells.select("part", "cells", F.explode(table).alias("o")).select("part", "cells", "o.*")

    def total(name: str, where: str, what: str = "c.n") -> Column:
        return F.expr(f"aggregate(filter(cells, c -> {where}), 0L, (s, c) -> s + {what})").alias(name)

    here = "c.fails & bit <> 0 and c.fails & before = 0"
    return steps.select(
        "part",
        "filter_order",
        "step",
        total("kept", "c.fails & (before | bit) = 0"),
        total("removed", here),
        total("redundant", "c.fails & bit <> 0 and c.fails & before <> 0"),
        total("unique_fails", "c.fails = bit"),
        total("good_lost", here, "c.good"),
        total("toxic_lost", here, "c.toxic"),
        total("shapley", "c.fails & bit <> 0", f"c.n * ({factorial(len(letters))}L div bit_count(c.fails))"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(facts_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")))


def oracle() -> str:
    """The same by joining every document's verdicts with every step of every order."""
    word, signs = r"[^\x20\x09-\x0D]+", "[#$%&*|]"
    return f"""WITH l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5])::INTEGER AS step FROM o),
q AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
f AS (SELECT d.doc_id, part, coalesce(good, 0) AS good, coalesce(q.toxic, 0) AS toxic,
  CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(t, '{signs}') THEN 'D' ELSE '' END
  || CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN q ON d.doc_id = q.doc_id),
x AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, f.good, f.toxic, fails,
  contains(fails, substr(filter_order, step, 1)) AS here,
  length(translate(fails, substr(filter_order, 1, step - 1), '')) < length(fails) AS earlier FROM f, s),
r AS (SELECT part, filter_order, step, letter, count(*) FILTER (NOT here AND NOT earlier) AS kept, count(*) FILTER (here AND NOT earlier) AS removed,
  count(*) FILTER (here AND earlier) AS redundant, count(*) FILTER (fails = letter) AS unique_fails,
  count(*) FILTER (here AND NOT earlier AND good = 1) AS good_lost, count(*) FILTER (here AND NOT earlier AND toxic = 1) AS toxic_lost
  FROM x GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM r"""
