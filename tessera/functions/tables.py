"""Table functions for SQL: rows out of a text, and chunks out of a group's token ids.

    SELECT d.doc_id, s.* FROM documents d, LATERAL sentences_of(d.text) s
    SELECT * FROM chunks_of(TABLE(SELECT doc_id, at, ids FROM rows) PARTITION BY doc_id ORDER BY (at), 128)
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx

_SPACE = tx.WS
_SHORTEST, _LONGEST = 10, 200


@F.udtf(returnType="place int, sentence string", useArrow=True)
class SentencesOf:
    """The sentences of a text in order, as functions.text.sentences has them."""

    def eval(self, text: str):
        if text is None:
            return
        plain = re.sub("http[^" + _SPACE[1:-1] + "]+", "", re.sub(r"\[\d+\]", "", text))
        folded = re.sub(_SPACE + "+", " ", plain).strip(" ")
        place = 0
        for part in re.split("(?<=[.!?]) +", folded):
            if _SHORTEST <= len(part) <= _LONGEST:
                yield place, part
                place += 1


@F.udtf(returnType="key long, chunk int, input_ids array<int>")
class ChunksOf:
    """The ids of a partition's rows (key, order, ids), one after another, in chunks of `size`; the last may be shorter.

    A task holds one row and less than a chunk, however many rows a partition has.
    """

    def __init__(self):
        self.held: list[int] = []
        self.key, self.chunk, self.size = None, 0, 0

    def eval(self, row, size: int):
        self.key, self.size = row[0], size
        if size < 1:
            raise ValueError("size must be positive")
        self.held += row[2] or []
        whole = len(self.held) // size * size
        for at in range(0, whole, size):
            yield self.key, self.chunk, self.held[at : at + size]
            self.chunk += 1
        self.held = self.held[whole:]

    def terminate(self):
        if self.held:
            yield self.key, self.chunk, self.held


def register(spark: SparkSession) -> list[str]:
    spark.udtf.register("sentences_of", SentencesOf)
    spark.udtf.register("chunks_of", ChunksOf)
    return ["sentences_of", "chunks_of"]
