"""Arrow batches bounded by bytes, and work on slices of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of an Arrow batch handed to Python, and of the texts or lists that are Python objects at a time.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 2000
SLICE_BYTES = 1 << 20


def bounded(spark: SparkSession | None = None) -> None:
    """Batches that go to Python are bounded by bytes as well as rows. A plan reads these settings of its session when it runs."""
    spark = spark or SparkSession.getActiveSession()
    if spark is not None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def slices(column: pa.Array, width: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """column in pieces of about limit bytes, a row at least; width: bytes of an element."""
    length = pc.list_value_length(column) if pa.types.is_list(column.type) or pa.types.is_large_list(column.type) else pc.binary_length(column)
    sizes = np.asarray(pc.fill_null(length, 0), np.int64) * width
    of = (np.cumsum(sizes) - sizes) // limit
    bounds = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(column)] if len(column) else [0]
    for start, end in zip(bounds, bounds[1:]):
        yield column.slice(start, end - start)


def joined(pieces: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(pieces) if pieces else pa.array([], kind)
