"""Records of training runs: one JSON file each, rewritten whole, with its metric rows."""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import __version__
from tessera.sources.shared import save_json

SCHEMA = "run_name string, status string, started_at string, finished_at string, error string, engine_version string, best_val_loss double, config map<string,string>, metrics array<struct<step:long,loss:double,val_loss:double,tokens_seen:long,lr:double>>"


class Experiment:
    def __init__(self, folder: str, run_name: str, config: dict | None = None):
        self.path = os.path.join(folder, f"{run_name}.json")
        self.record = {"run_name": run_name, "status": "running", "started_at": _now(), "finished_at": None, "error": None, "engine_version": __version__, "best_val_loss": None, "config": {k: str(v) for k, v in (config or {}).items()}, "metrics": []}
        save_json(self.record, self.path)

    @classmethod
    def load(cls, path: str) -> Experiment:
        found = cls.__new__(cls)
        found.path = path
        with open(path, encoding="utf-8") as file:
            found.record = json.load(file)
        return found

    def log(self, step: int, loss: float, val_loss: float | None = None, tokens_seen: int = 0, lr: float = 0.0) -> None:
        self.record["metrics"].append({"step": step, "loss": round(loss, 6), "val_loss": None if val_loss is None else round(val_loss, 6), "tokens_seen": tokens_seen, "lr": lr})
        if val_loss is not None and (self.record["best_val_loss"] is None or val_loss < self.record["best_val_loss"]):
            self.record["best_val_loss"] = round(val_loss, 6)
        save_json(self.record, self.path)

    def finish(self, error: str | None = None) -> None:
        self.record |= {"status": "failed" if error else "finished", "finished_at": _now(), "error": error}
        save_json(self.record, self.path)


def _now() -> str:
    return datetime.now(UTC).isoformat()


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row per run."""
    return spark.read.schema(SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)


def metrics(runs: DataFrame) -> DataFrame:
    return runs.select("run_name", F.explode("metrics").alias("m")).select("run_name", "m.*")
