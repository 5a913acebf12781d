"""Time series of training metrics: windows, streaks, warnings, early stopping."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LOG_SCHEMA = "step long, loss double, tokens_seen long, lr double, timestamp string, val_loss double"


def _over(by: list[str], order: list[str]):
    return W.partitionBy(*by).orderBy(*order)


def moving_average(df: DataFrame, value: str, by: list[str], order: list[str], k: int) -> DataFrame:
    """avg of the last k values; the first rows use what there is."""
    return df.withColumn("moving_avg", F.avg(value).over(_over(by, order).rowsBetween(-(k - 1), 0)))


def rise_streak(df: DataFrame, value: str, by: list[str], order: list[str], delta: float = 0.01) -> DataFrame:
    """streak: how many values in a row each rose by more than delta."""
    w, island = _over(by, order), uuid.uuid4().hex  # a name that no column of df has
    rise = F.coalesce(F.col(value) > F.lag(value).over(w) + delta, F.lit(False))
    marked = df.withColumn("rise", rise).withColumn(island, F.sum((~F.col("rise")).cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.withColumn("streak", F.sum(F.col("rise").cast("long")).over(_over([*by, island], order).rowsBetween(W.unboundedPreceding, 0))).drop(island)


def instability(df: DataFrame, value: str, by: list[str], order: list[str], window: int = 5, threshold: float = 0.5) -> DataFrame:
    """cv of the last `window` values once there are as many and their mean is positive; unstable if above threshold."""
    w = _over(by, order).rowsBetween(-(window - 1), 0)
    full = (F.count(value).over(w) == window) & (F.avg(value).over(w) > 0)
    return df.withColumn("cv", F.when(full, F.stddev_pop(value).over(w) / F.avg(value).over(w))).withColumn("unstable", F.coalesce(F.col("cv") > threshold, F.lit(False)))


def running_best(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    w = _over(by, order)
    before = F.min(value).over(w.rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("best", F.min(value).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("new_best", before.isNull() | (F.col(value) < before))


def cumulative(df: DataFrame, value: str, by: list[str], order: list[str], name: str = "cumulative") -> DataFrame:
    return df.withColumn(name, F.sum(value).over(_over(by, order).rowsBetween(W.unboundedPreceding, 0)))


def early_stop(df: DataFrame, value: str, by: list[str], order: list[str], patience: int = 3) -> DataFrame:
    """Per group the first row (its order columns) after `patience` values without a new best; null: none."""
    best = running_best(df, value, by, order)
    w = _over(by, order)
    run, bad = uuid.uuid4().hex, uuid.uuid4().hex  # names that no column of df has
    since = best.withColumn(run, F.sum(F.col("new_best").cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    since = since.withColumn(bad, F.row_number().over(_over([*by, run], order)) - 1)
    return since.groupBy(*by).agg(F.min(F.when(F.col(bad) >= patience, F.struct(*order))).alias("stop"))


def loss_flag(loss: Column, threshold: float = 1e10) -> Column:
    return F.when(F.isnan(loss) | (F.abs(loss) == float("inf")), "nan").when(F.abs(loss) > threshold, "large")


def grad_flag(norm: Column, threshold: float = 1000.0) -> Column:
    return F.when(F.isnan(norm) | (F.abs(norm) == float("inf")), "nan").when(norm > threshold, "exploding")


def warnings(df: DataFrame, step: str = "step", loss: str = "loss", val_loss: str = "val_loss", grad_norm: str | None = None, patience: int = 3, delta: float = 0.01, nan_threshold: float = 1e10, grad_threshold: float = 1000.0, window: int = 5, cv: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """step, kind, message, detail (and the columns of by) of all warnings on a log.

    Without by the log is one series, and its windows run in one task; a log of many runs needs by.
    """
    by = by or []
    cols = [F.col(c) for c in by]
    series = df.filter(F.col(val_loss).isNotNull())
    rises = rise_streak(series, val_loss, by, [step], delta).filter(F.col("streak") >= patience)
    shaky = instability(series, val_loss, by, [step], window, cv).filter("unstable")

    def rows(found: DataFrame, kind: str, message: Column, **detail: Column) -> DataFrame:
        pairs = [x for k, v in detail.items() for x in (F.lit(k), v.cast("string"))]
        return found.select(*cols, F.col(step).cast("long").alias("step"), F.lit(kind).alias("kind"), message.alias("message"), F.create_map(*pairs).alias("detail"))

    out = rows(df.filter(loss_flag(F.col(loss), nan_threshold).isNotNull()), "nan_loss", F.when(loss_flag(F.col(loss), nan_threshold) == "nan", F.format_string("loss is NaN or infinite at step %s", F.col(step))).otherwise(F.format_string("loss is abnormally large at step %s", F.col(step))), loss=F.col(loss))
    out = out.unionByName(rows(rises, "overfitting", F.format_string("validation loss rose %s times in a row", F.col("streak")), consecutive=F.col("streak"), curr_val_loss=F.col(val_loss)))
    out = out.unionByName(rows(shaky, "unstable_val", F.format_string("validation loss varies by %.2f of its mean", F.col("cv")), cv=F.col("cv")))
    if grad_norm:
        out = out.unionByName(rows(df.filter(grad_flag(F.col(grad_norm), grad_threshold).isNotNull()), "exploding_gradients", F.format_string("gradient norm %s at step %s", F.col(grad_norm), F.col(step)), grad_norm=F.col(grad_norm)))
    return out


def warning_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("kind").agg(F.count("*").alias("n"))


def last_warnings(found: DataFrame, n: int = 5) -> DataFrame:
    return found.orderBy(F.desc("step"), F.desc("kind")).limit(n)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a log, without lines that are no JSON; missing numbers are 0, val_loss stays null."""
    parsed = F.from_json("value", LOG_SCHEMA + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    log = spark.read.text(path).filter("trim(value) <> ''").select(parsed.alias("r")).select("r.*")
    return log.filter("_corrupt is null").drop("_corrupt").fillna({"step": 0, "loss": 0.0, "tokens_seen": 0, "lr": 0.0, "timestamp": ""})


def performance(df: DataFrame, step: str = "step", tokens: str = "tokens", elapsed: str = "elapsed", loss: str = "loss", memory: str | None = None) -> DataFrame:
    """One row: totals, rates, first and last loss, most memory."""
    t = F.sum(elapsed)
    rate = lambda x: F.when(t > 0, x / t).otherwise(F.lit(0.0))
    out = [F.count("*").alias("steps"), F.sum(tokens).alias("total_tokens"), t.alias("total_elapsed"), rate(F.sum(tokens)).alias("tokens_per_sec"), rate(F.count("*")).alias("steps_per_sec"), F.min_by(loss, step).alias("first_loss"), F.max_by(loss, step).alias("last_loss")]
    return df.agg(*out, *([F.max(memory).alias("max_memory")] if memory else []))


def loss_reduction(df: DataFrame, step: str, loss: str) -> DataFrame:
    return df.agg(F.min_by(loss, step).alias("a"), F.max_by(loss, step).alias("b")).select(((1 - F.col("b") / F.col("a")) * 100).alias("reduction_percent"))


def latency(df: DataFrame, elapsed: str, n_out: str) -> DataFrame:
    """Mean milliseconds per token over outputs with tokens; 0 without any."""
    return df.agg(F.coalesce(F.avg(F.when(F.col(n_out) > 0, F.col(elapsed) / F.col(n_out))) * 1000, F.lit(0.0)).alias("ms_per_token"))


def step_of(path: Column) -> Column:
    """The number of a folder named step-123; null for other names."""
    found = F.regexp_extract(path, r"(?:^|/)step-(\d+)/?$", 1)
    return F.when(found != "", found.cast("long"))


def stale_checkpoints(df: DataFrame, path: str, keep: int, latest: str | None = None) -> DataFrame:
    """Checkpoint folders beyond the last `keep`, without the one that is latest."""
    steps = df.withColumn("step", step_of(F.col(path))).filter("step is not null")
    newest = steps.select("step").distinct().orderBy(F.desc("step")).limit(keep)
    old = steps.join(F.broadcast(newest), "step", "left_anti")  # `keep` numbers
    return old if latest is None else old.filter(F.col(path) != latest)


def latest_checkpoint(df: DataFrame, path: str) -> DataFrame:
    """The row of the checkpoint folder with the highest step; of equal steps the greatest path."""
    return df.withColumn("step", step_of(F.col(path))).filter("step is not null").orderBy(F.desc("step"), F.desc(path)).limit(1)


def best_checkpoint(df: DataFrame, path: str, metric: str, smallest: bool = True) -> DataFrame:
    """The row with the best metric, of equals the latest step; rows without a metric or that are no checkpoints do not count."""
    own = df.withColumn("step", step_of(F.col(path))).filter(F.col("step").isNotNull() & F.col(metric).isNotNull() & ~F.isnan(metric))
    return own.orderBy(F.asc(metric) if smallest else F.desc(metric), F.desc("step"), F.desc(path)).limit(1)


def qa_score(df: DataFrame, answer: str, expected: str) -> DataFrame:
    hit = F.contains(F.lower(answer), F.lower(expected))
    return df.agg(F.count("*").alias("total"), F.count_if(hit).alias("correct"), (F.count_if(hit) / F.count("*") * 100).alias("score"))
