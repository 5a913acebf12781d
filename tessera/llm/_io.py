"""Shared folders, Arrow batches and chunk counts for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text in one chunk, the unit whose dictionary is joined with a global table.
CHUNK_BYTES = 16 << 20
#: Bytes of an Arrow batch handed to Python.
BATCH_BYTES = 4 << 20
#: Spark's setting by which the shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def arrow_limits(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that long texts do not fill a worker.

    The session keeps these two settings: a plan reads them only when it runs.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path below spark.checkpoint.dir, which driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tessera/{uuid.uuid4().hex}"


def materialise(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(documents: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: one aggregate over one column."""
    return int(documents.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0])


def n_chunks(total_bytes: int, chunk_bytes: int = CHUNK_BYTES) -> int:
    return max(1, -(-total_bytes // chunk_bytes))


def id_and_text(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns an operator works on; extra columns of whatever name stay out of the way."""
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def rows_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id, hash of the text (version) and, if kept has it, lang are in kept; nulls are equal."""
    key, version, lang = (uuid.uuid4().hex for _ in range(3))  # no column of docs has such a name
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(F.col("text").cast("string")) == F.col(version))
    named = kept.withColumnsRenamed({"doc_id": key, "version": version, "lang": lang})
    if "lang" in kept.columns:
        same &= F.col("lang").cast("string").eqNullSafe(F.col(lang))
    return docs.join(named, same, "left_semi")


def drop(df: DataFrame) -> None:
    """Delete a table that materialise() wrote, once nothing will read it again."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for root in {f.rsplit("/", 1)[0].split("/kind=")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(conf).delete(path, True)
