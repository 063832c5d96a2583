"""Which series, rows and models take part, and in what order."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.calendar import HORIZON
from .backtest import MIN_HISTORY, contexts


def head(df: DataFrame, k: int, *keys: str) -> DataFrame:
    """The first k rows of each key by date, numbered step = 1 .. k."""
    return df.withColumn("step", F.row_number().over(Window.partitionBy(*keys).orderBy("date"))).where(F.col("step") <= k)


def futures(df: DataFrame, cutoffs: list[date]) -> DataFrame:
    """Each row once for every cutoff that it comes after."""
    dates = F.array(*(F.lit(c) for c in cutoffs))
    return df.withColumn("cutoff", F.explode(F.filter(dates, lambda c: c < F.col("date"))))


def complete_horizon(df: DataFrame, cutoffs: list[date], value: str, horizon: int = HORIZON, min_history: int = MIN_HISTORY, key: str = "key") -> DataFrame:
    """(cutoff, key) with enough known months up to the cutoff and a whole horizon of them after it."""
    known = df.where(F.col(value).isNotNull()).select(key, "date")
    before = contexts(known, cutoffs).groupBy("cutoff", key).agg(F.count("*").alias("n_history"))
    after = futures(known, cutoffs).groupBy("cutoff", key).agg(F.least(F.count("*"), F.lit(horizon)).alias("n_future"))
    return before.join(after, ["cutoff", key]).where((F.col("n_history") >= min_history) & (F.col("n_future") == horizon))


def impute_last(df: DataFrame, value: str, key: str = "key") -> DataFrame:
    """A missing value becomes its key's last known one."""
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.col("date"))).over(Window.partitionBy(key))
    return df.withColumn(value, F.coalesce(value, last))


def available_metrics(rows: DataFrame, by: str = "model") -> DataFrame:
    """The errors of each model, and the interval's coverage where its rows have the columns of one, else null."""
    found = [M.wape("y_true", "y_pred").alias("wape"), M.smape("y_true", "y_pred").alias("smape"), M.rmse("y_true", "y_pred").alias("rmse"), M.cum_error_pct("y_true", "y_pred").alias("cum_err_pct")]
    if {"q10", "q90"} <= set(rows.columns):
        inside = F.when(F.col("y_true").between(F.col("q10"), F.col("q90")), 1.0).otherwise(0.0)
        found.append(F.avg(F.when(F.col("q10").isNotNull() & F.col("q90").isNotNull(), inside)).alias("coverage_80"))
    else:
        found.append(F.lit(None).cast("double").alias("coverage_80"))
    return M.observed(rows).groupBy(by).agg(*found)


def winner_rows(rows: DataFrame, scores: DataFrame, by: str = "model", score: str = "wape") -> DataFrame:
    """The rows of the model of least score, ties by its name."""
    best = scores.where(F.col(score).isNotNull()).orderBy(F.round(score, 12), by).limit(1).select(by)
    return rows.join(F.broadcast(best), by, "left_semi")


def in_order(column: str, order: list[str]) -> Column:
    """A value's place in a given order; those that it leaves out come last."""
    at = F.array_position(F.array(*(F.lit(x) for x in order)), F.col(column))
    return F.when(at > 0, at).otherwise(len(order) + 1)


def mask(pairs: DataFrame, condition: Column, columns: list[str], row: str = "key", column: str = "inj") -> DataFrame:
    """A wide 0/1 matrix of the pairs that meet the condition; pairs that aren't there are 0."""
    hit = pairs.withColumn("_hit", F.when(condition, 1).otherwise(0))
    return hit.groupBy(row).pivot(column, columns).agg(F.max("_hit")).na.fill(0, columns)
