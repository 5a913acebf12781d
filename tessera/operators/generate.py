"""Seeded text generators: template families, weighted mixtures, fact tables.

Every row draws from its own random numbers, hashed from seed, row and use, so a row does not depend on
the others or on partitions. Word lists and templates are parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Family = Callable[["Draw"], Column]


class Draw:
    """Random numbers of a row."""

    def __init__(self, row: Column, seed: int):
        self.row, self.seed, self.uses = row, seed, 0

    def uniform(self) -> Column:
        """In [0, 1)."""
        self.uses += 1
        return F.pmod(F.xxhash64(self.row, F.lit(self.seed), F.lit(self.uses)), F.lit(1 << 53)) / float(1 << 53)

    def integer(self, low: int, high: int) -> Column:
        """From low to high, both included."""
        return (F.floor(self.uniform() * (high - low + 1)) + low).cast("int")

    def choice(self, values: list[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), self.integer(1, len(values)))

    def sample(self, values: list[str], k: int) -> Column:
        """k different ones, in random order."""
        keys = F.array(*[F.struct(self.uniform().alias("u"), F.lit(v).alias("v")) for v in values])
        return F.transform(F.slice(F.array_sort(keys), 1, k), lambda s: s["v"])


def mixture(spark: SparkSession, n: int, families: list[tuple[str, float, Family]], seed: int = 42, rows: DataFrame | None = None) -> DataFrame:
    """n rows of row, family, text, or one for each of rows (its one column names them); a draw beyond the sum of the weights gives no row."""
    draw = Draw(F.col("row"), seed)
    r, bound = draw.uniform(), 0.0
    kind = text = None
    for name, weight, family in families:
        bound += weight
        value = family(Draw(F.col("row"), seed * 1_000_003 + len(name) + int(bound * 1e6)))
        kind = F.when(F.col("_r") < bound, name) if kind is None else kind.when(F.col("_r") < bound, name)
        text = F.when(F.col("_r") < bound, value) if text is None else text.when(F.col("_r") < bound, value)
    named = (spark.range(n) if rows is None else rows).toDF("row").withColumn("_r", r)
    return named.select("row", kind.alias("family"), text.alias("text")).filter("family is not null")


def counting(longest: int = 8, prefix: str = "count: ") -> Family:
    def make(d: Draw) -> Column:
        start = d.integer(1, 10)
        return F.concat(F.lit(prefix), F.array_join(F.transform(F.sequence(start, start + d.integer(3, longest) - 1), lambda x: x.cast("string")), ", "), F.lit("."))

    return make


def repeated(phrases: list[str]) -> Family:
    return lambda d: F.array_join(F.array_repeat(d.choice(phrases), d.integer(2, 4)), " ")


def template(pattern: str, *slots: list[str]) -> Family:
    """printf-style pattern with a choice for each %s: stories, definitions, questions, dialogue, instructions ..."""
    return lambda d: F.format_string(pattern, *[d.choice(s) for s in slots])


def any_of(*families: Family) -> Family:
    def make(d: Draw) -> Column:
        at = d.integer(1, len(families))
        out = F.lit(None).cast("string")
        for k, f in enumerate(families, 1):
            out = F.when(at == k, f(d)).otherwise(out)
        return out

    return make


def arithmetic(low: int = 0, high: int = 20, signed: bool = True) -> Family:
    def make(d: Draw) -> Column:
        a, b, plus = d.integer(low, high), d.integer(low, high), d.uniform() < 0.5
        if not signed:
            a, b = F.greatest(a, b), F.least(a, b)
        return F.when(plus, F.format_string("%d + %d = %d.", a, b, a + b)).otherwise(F.format_string("%d - %d = %d.", a, b, a - b))

    return make


def synthetic(spark: SparkSession, n: int = 500, seed: int = 42, mix: tuple[float, float, float] = (0.5, 0.25, 0.25), words: tuple[list[str], list[str], list[str], list[str]] | None = None, phrases: list[str] | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Sentences, counting and repeated phrases, with source "synthetic": n of them, or one for each of rows."""
    subjects, verbs, adjectives, objects = words or (["the teacher", "a river", "our garden"], ["sees", "follows", "paints"], ["quiet", "bright", "old"], ["houses", "birds", "letters"])
    sentence = template("%s %s %s %s.", subjects, verbs, adjectives, objects)
    made = mixture(spark, n, [("sentence", mix[0], sentence), ("counting", mix[1], counting()), ("repeated", mix[2], repeated(phrases or ["one step at a time", "rain on the roof"]))], seed, rows)
    return made.withColumn("source", F.lit("synthetic"))


def facts(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, text: the sum and the product of each distinct pair of numbers, as sentences; pairs with a null say nothing."""
    known = pairs.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a is not null and b is not null").distinct()
    return known.select("a", "b", F.explode(F.array(F.format_string("%d + %d = %d", "a", "b", F.col("a") + F.col("b")), F.format_string("%d x %d = %d", "a", "b", F.col("a") * F.col("b")))).alias("text"))


def sums_table(spark: SparkSession, n: int = 12) -> DataFrame:
    """All sums and products of 1 to n, as sentences."""
    numbers = F.sequence(F.lit(1), F.lit(n))
    return facts(spark.range(1, n + 1).select("id", F.explode(numbers).alias("other")), "id", "other")


def successors(spark: SparkSession, names: list[str], pattern: str = "After %s comes %s.") -> DataFrame:
    """A sentence for each of a cycle of names and its successor: weekdays, months."""
    rows = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    following = rows.select(F.pmod(F.col("i") - 1, F.lit(len(names))).alias("i"), F.col("name").alias("following"))
    return rows.join(following, "i").select("i", F.format_string(pattern, "name", "following").alias("text"))


def distinct_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()
