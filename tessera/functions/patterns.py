"""Many fixed strings looked for at once: one pass over a text, however many there are (an Aho-Corasick automaton).

The list travels as a broadcast, and each task builds the automaton from it once. Patterns are compared as they are;
for P14 and the like both sides are lower-cased before.

Defined results: a null text gives null; the empty pattern and repeats of a pattern are not allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tessera.functions.batches import bounded, joined, slices


class Patterns:
    def __init__(self, spark: SparkSession, patterns: list[str]):
        if "" in patterns or len(set(patterns)) < len(patterns):
            raise ValueError("patterns must be distinct and not empty")
        self.n = len(patterns)
        self.sent = spark.sparkContext.broadcast(list(patterns))

    def _column(self, kind: str, arrow: pa.DataType, of, nothing, text: Column) -> Column:
        """of(matches) for each text; matches: (place of the last character, (number, length)) in order of place."""
        sent = self.sent
        bounded()

        @F.arrow_udf(kind)
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for k, pattern in enumerate(sent.value):
                automaton.add_word(pattern, (k, len(pattern)))
            automaton.make_automaton()
            for batch in batches:
                found = [pa.array([None if x is None else nothing if not sent.value else of(automaton.iter(x)) for x in part.to_pylist()], arrow) for part in slices(batch)]
                yield joined(found, arrow)

        return run(text)

    def found(self, text: Column) -> Column:
        """The numbers of the patterns that a text holds, ascending."""
        return self._column("array<int>", pa.list_(pa.int32()), lambda hits: sorted({k for _, (k, _) in hits}), [], text)

    def occurrences(self, text: Column) -> Column:
        """How often patterns stand in a text, overlaps included."""
        return self._column("long", pa.int64(), lambda hits: sum(1 for _ in hits), 0, text)

    def holds(self, text: Column) -> Column:
        """Whether a text holds any pattern; the search ends at the first."""
        return self._column("boolean", pa.bool_(), lambda hits: next(iter(hits), None) is not None, False, text)

    def first(self, text: Column) -> Column:
        """Where the first pattern begins, in characters from 0; -1 if there is none."""
        return self._column("int", pa.int32(), lambda hits: min((end - size + 1 for end, (_, size) in hits), default=-1), -1, text)

    def cut(self, text: Column) -> Column:
        """A text up to where the first pattern begins."""
        at = self.first(text)
        return F.when(at >= 0, F.substr(text, F.lit(1), at)).otherwise(text)
