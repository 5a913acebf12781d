"""Tables in the folder that driver and executors share, and reports as JSON."""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import asdict, is_dataclass

from pyspark.sql import DataFrame, SparkSession


#: Spark's setting by which the shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tessera/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: rows keep their places, and lost executors cost nothing."""
    spark = df.sparkSession
    path = shared_folder(spark)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete a table that materialise() wrote, once nothing will read it again."""
    conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(conf).delete(path, True)


def to_json(value) -> str:
    return json.dumps(asdict(value) if is_dataclass(value) else value, indent=2, default=str, ensure_ascii=False)


def save_json(value, path: str) -> None:
    """Written beside the target and moved over it."""
    import os

    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path + ".tmp", "w", encoding="utf-8") as file:
        file.write(to_json(value))
    os.replace(path + ".tmp", path)
