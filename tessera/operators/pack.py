"""Token sequences to fixed-length examples: stream chunks, packing, padding, shifting."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.batches import bounded
from tessera.operators.rowindex import with_row_index

EOS = 2


def _pieces(size: int, kind: str):
    """A function of id lists and their offsets: each list's pieces (chunk, part), cut where a chunk of size ids ends.

    A batch's ids stay as they lie; only the bounds of the pieces are new, so that a list of any length costs its length
    once (slice() in a lambda copies the whole list for every piece).
    """
    bounded()

    @F.arrow_udf(f"array<struct<chunk:bigint,part:array<{kind}>>>")
    def cut(ids: pa.Array, at: pa.Array) -> pa.Array:
        n = np.asarray(pc.fill_null(pc.list_value_length(ids), 0), np.int64)
        start = np.asarray(pc.fill_null(at, 0), np.int64)
        first = start // size
        many = np.where(n > 0, (start + n - 1) // size - first + 1, 0)
        bounds = np.concatenate([[0], np.cumsum(many)])
        row = np.repeat(np.arange(len(n)), many)
        chunk = first[row] + np.arange(bounds[-1]) - bounds[:-1][row]
        length = np.minimum((chunk + 1) * size, (start + n)[row]) - np.maximum(chunk * size, start[row])
        parts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), ids.flatten())
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(chunk, pa.int64()), parts], ["chunk", "part"]))

    return cut


def chunks(df: DataFrame, ids: str | Column, *order: str, context_length: int, keep_full_last: bool = True, at_least_one: bool = False, n: Column | None = None) -> DataFrame:
    """chunk, input_ids: the concatenation of all id lists in order, cut every context_length + 1 ids; the rest is dropped.

    keep_full_last false drops a last chunk that is exactly full, as cutting (total - 1) // size does.
    at_least_one: a total short of one chunk gives one chunk of zeros. Each row is cut at the chunk
    bounds it crosses, so what is grouped is a few slices per chunk, not a row per id.

    ids may be an expression over df, with n its number of ids: then df's own columns are sorted and written while
    offsets are found, and ids, which are larger than their texts, are made where they are cut.
    """
    size = context_length + 1
    if n is None:
        placed, count = df.select(*order, (F.col(ids) if isinstance(ids, str) else ids).alias("_ids")), F.size("_ids")
    else:
        placed, count = df, n
    # no ids (null has size -1 or null) leave the offsets as they are
    rows = with_row_index(placed, *order, running={"_at": "_n"}, made={"_n": F.greatest(F.coalesce(count, F.lit(0)), F.lit(0)).cast("long")})
    late = rows if n is None else rows.select("_at", "_n", (F.col(ids) if isinstance(ids, str) else ids).alias("_ids"))
    total = int(rows.agg(F.coalesce(F.max(F.col("_at") + F.col("_n")), F.lit(0))).first()[0])
    n_full = (total if keep_full_last else total - 1) // size if total else 0

    kind = late.schema["_ids"].dataType.elementType.simpleString()
    pieces = _pieces(size, kind)(F.col("_ids"), F.col("_at"))
    cut = late.select("_at", F.explode(pieces).alias("piece")).filter(F.col("piece.chunk") < n_full)
    cut = cut.select(F.col("piece.chunk").alias("chunk"), F.struct("_at", F.col("piece.part").alias("part")).alias("s"))
    out = cut.groupBy("chunk").agg(F.flatten(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["part"])).alias("input_ids"))
    if at_least_one and n_full == 0:
        return df.sparkSession.range(1).select(F.col("id").alias("chunk"), F.array_repeat(F.lit(0), size).alias("input_ids"))
    return out


def _marked(df: DataFrame, ids: str | Column, n: Column | None) -> tuple[DataFrame, str | Column, Column | None]:
    """df, ids and n with an end mark more."""
    if isinstance(ids, str):
        return df.withColumn(ids, F.concat(F.col(ids), F.array(F.lit(EOS)))), ids, None if n is None else n + 1
    return df, F.concat(ids, F.array(F.lit(EOS))), None if n is None else n + 1


def streamed(df: DataFrame, ids: str | Column, *order: str, context_length: int, n: Column | None = None) -> DataFrame:
    """As the streaming reader cuts: ids end with one end mark already, another follows, a full last chunk goes."""
    twice, ids, n = _marked(df, ids, n)
    return chunks(twice, ids, *order, context_length=context_length, keep_full_last=False, n=n)


def packed(df: DataFrame, ids: str | Column, *order: str, context_length: int, add_eos: bool = True, n: Column | None = None) -> DataFrame:
    """As the packer cuts: ids without end mark get one."""
    marked, ids, n = _marked(df, ids, n) if add_eos else (df, ids, n)
    return chunks(marked, ids, *order, context_length=context_length, n=n)


def truncate(ids: Column, context_length: int) -> Column:
    return F.slice(ids, 1, context_length + 1)


def pad(ids: Column, context_length: int, pad_id: int = EOS) -> Column:
    """Cut or filled on the right to context_length + 1."""
    cut = truncate(ids, context_length)
    return F.concat(cut, F.array_repeat(F.lit(pad_id), (F.lit(context_length + 1) - F.size(cut)).cast("int")))


def shifted(ids: Column) -> Column:
    """input_ids without the last id, target_ids without the first."""
    n = F.size(ids) - 1
    return F.struct(F.slice(ids, 1, n).alias("input_ids"), F.slice(ids, 2, n).alias("target_ids"))


def n_tokens(chunks_: DataFrame, context_length: int) -> DataFrame:
    return chunks_.agg((F.count("*") * (context_length + 1)).alias("n_tokens"))
