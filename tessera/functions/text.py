"""Text rules as column expressions, equal to Python's str methods over all of Unicode.

Java's \\s is ASCII, so white space is spelled out: WS is what str.split() and str.strip() take.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.batches import bounded

WS = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
UNICODE_FORMS = ("NFC", "NFKC", "NFD", "NFKD", "none")
NORMALIZATIONS = ("none", "whitespace", "lowercase")


def fold_ws(text: Column) -> Column:
    """" ".join(text.split())"""
    return F.trim(F.regexp_replace(text, WS + "+", " "))


def is_blank(text: Column) -> Column:
    return F.length(fold_ws(text)) == 0


def strip_control(text: Column) -> Column:
    """Without control characters; tab, line feed and carriage return stay."""
    return F.regexp_replace(text, CONTROL, "")


def fold_lines(text: Column) -> Column:
    """Each line folded, blank lines kept within the text, none at its ends."""
    return F.btrim(F.regexp_replace(F.regexp_replace(text, WS.replace(r"\x09-\x0D", r"\x09\x0B-\x0D") + "+", " "), " ?\n ?", "\n"), F.lit(" \n"))


def dedup_key(text: Column, normalization: str = "whitespace") -> Column:
    """SHA-256 of the text after `normalization`: none, whitespace, or lowercase (then white space)."""
    if normalization not in NORMALIZATIONS:
        raise ValueError(f"normalization must be one of {NORMALIZATIONS}, not {normalization!r}")
    plain = text if normalization == "none" else fold_ws(F.lower(text) if normalization == "lowercase" else text)
    return F.sha2(F.encode(plain, "UTF-8"), 256)


def unicode_norm(text: Column, form: str = "NFC") -> Column:
    """Unicode normalization; Spark has none, so texts go to Python in Arrow batches, and ASCII ones come straight back."""
    if form == "none":
        return text
    bounded()

    @F.pandas_udf("string")
    def normalize(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize(form, x))

    return normalize(text)


def is_repetitive(text: Column, threshold: float = 0.5, min_lines: int = 10) -> Column:
    """Whether one line makes up at least `threshold` of min_lines lines or more; blank lines count.

    The lines are sorted once and the longest run of equal neighbours is carried through, so the cost
    is that of a sort, not of all pairs of lines.
    """
    lines = F.sort_array(F.split(text, "\n"))
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(a["last"] == x, a["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(a["most"], run).alias("most"))

    return (F.size(lines) >= min_lines) & (F.aggregate(lines, start, step, lambda a: a["most"]) / F.size(lines) >= threshold)


def preview(text: Column, n: int = 50) -> Column:
    return F.substring(text, 1, n)


def sentences(text: Column, shortest: int = 10, longest: int = 200) -> Column:
    """Sentences after removal of [1]-like citations and of addresses, of a length within bounds."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\[\p{Nd}+\]", ""), "http[^" + WS[1:-1] + "]+", "")
    parts = F.split(fold_ws(plain), r"(?<=[.!?])" + WS + "+")
    return F.filter(F.transform(parts, fold_ws), lambda s: F.length(s).between(shortest, longest))


def keywords(text: Column, stopwords: tuple[str, ...] = (), longer_than: int = 2) -> Column:
    words = F.split(fold_ws(F.lower(text)), " ")
    return F.filter(words, lambda w: (F.length(w) > longer_than) & ~w.isin(*stopwords)) if stopwords else F.filter(words, lambda w: F.length(w) > longer_than)


def answers(answer: Column, expected: Column) -> Column:
    return F.contains(F.lower(answer), F.lower(expected))


def byte_token_count(text: Column, eos: bool = False) -> Column:
    """Tokens under a tokenizer without merges: a mark and the bytes of each word."""
    # each space of the folded text stands for a mark, and so does its start
    n = F.octet_length(fold_ws(text))
    return (n + F.signum(n) + int(eos)).cast("long")


def byte_token_ids(text: Column, eos: bool = False) -> Column:
    """Those tokens' ids: 36 marks a word, 4 + b is byte b, 2 is the end."""
    bounded()

    @F.arrow_udf("array<int>")
    def encode(column: pa.Array) -> pa.Array:
        # one pass over the bytes of a whole batch: each text gets a space in front, and a space is a word's mark
        text = pc.cast(column, pa.large_binary())
        sizes = np.asarray(pc.fill_null(pc.binary_length(text), 0))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(b"".join(x for x in text.to_pylist() if x), np.uint8)
        ids = np.where(data == 32, 36, data.astype(np.int32) + 4)
        filled = np.flatnonzero(sizes)
        ids = np.insert(ids, starts[filled], 36)
        bounds = np.concatenate([[0], np.cumsum(sizes + (sizes > 0))])
        if eos:
            ids = np.insert(ids, bounds[1:], 2)
            bounds = bounds + np.arange(len(bounds))
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()), mask=pc.is_null(column) if column.null_count else None)

    return encode(fold_ws(text))


def parse_ids(text: Column) -> Column:
    """"1, 2,,3" as [1, 2, 3]"""
    return F.transform(F.filter(F.transform(F.split(text, ","), fold_ws), lambda x: x != ""), lambda x: x.cast("int"))
