"""Rolling-origin backtests: contexts end at a cutoff, forecasts start the month after.

Cutoffs are a parameter, a handful of dates. Rows are matched with them by array filters or per-cutoff
aggregates, never by an inequality join, and forecasts meet the truth by an equi-join on (key, date)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import HORIZON, expand_horizon

MIN_HISTORY, EPS = 12, 1e-6


def own_cutoffs(df: DataFrame, windows: int, step: int, horizon: int = HORIZON, key: str = "key") -> DataFrame:
    """(key, cutoffs): the origins of each series' own windows, counted back from its last month, the latest first.

    The latest leaves the last ``horizon`` months to be forecast, each other one begins ``step`` months earlier; series may
    end in different months. An array a key, so nothing grows with the number of different origins."""
    back = F.sequence(F.lit(0), F.lit(windows - 1))
    return df.groupBy(key).agg(F.max("date").alias("_last")).select(key, F.transform(back, lambda w: F.add_months("_last", -(horizon + step * w))).alias("cutoffs"))


def contexts(df: DataFrame, cutoffs: list[date] | DataFrame, key: str = "key") -> DataFrame:
    """Each row once for every cutoff that it is known at: of a common list, or of its series' own (key, cutoffs)."""
    if isinstance(cutoffs, DataFrame):
        met, dates = df.join(cutoffs.withColumnRenamed("cutoffs", "_cutoffs"), key), F.col("_cutoffs")
    else:
        met, dates = df, F.array(*(F.lit(c) for c in cutoffs))
    return met.withColumn("cutoff", F.explode(F.filter(dates, lambda c: c >= F.col("date")))).drop("_cutoffs")


def context_tail(df: DataFrame, cutoffs: list[date] | DataFrame, k: int, value: str, min_history: int = MIN_HISTORY, key: str = "key") -> DataFrame:
    """The last k known values at each cutoff, numbered t = 0 .. n - 1, of keys with enough history."""
    rows = contexts(df.where(F.col(value).isNotNull()), cutoffs, key)
    w = Window.partitionBy("cutoff", key)
    ranked = rows.withColumn("_r", F.row_number().over(w.orderBy(F.desc("date")))).withColumn("_all", F.count(F.lit(1)).over(w))
    n = F.least(F.col("_all"), F.lit(k))
    return ranked.where((F.col("_r") <= k) & (F.col("_all") >= min_history)).withColumn("n", n).withColumn("t", n - F.col("_r")).drop("_r", "_all")


def naive(df: DataFrame, cutoffs: list[date], value: str, horizon: int = HORIZON, min_history: int = MIN_HISTORY, key: str = "key") -> DataFrame:
    """The last known value, repeated: one pass over the rows, whatever the number of cutoffs."""
    known = [F.struct(F.lit(c).alias("cutoff"), F.max_by(value, F.when(F.col("date") <= F.lit(c), F.col("date"))).alias("last"), F.count(F.when(F.col("date") <= F.lit(c), 1)).alias("n")) for c in cutoffs]
    at = df.where(F.col(value).isNotNull()).groupBy(key).agg(F.array(*known).alias("at")).select(key, F.explode("at").alias("c"))
    at = at.where(F.col("c.n") >= min_history).select(key, "c.cutoff", F.greatest(F.col("c.last"), F.lit(0.0)).alias("y_pred"))
    return expand_horizon(at, horizon)


def exponential(df: DataFrame, cutoffs: list[date] | DataFrame, value: str, k: int = 24, horizon: int = HORIZON, key: str = "key") -> DataFrame:
    """A straight line through the logarithms of the last k values, carried on."""
    rows = context_tail(df, cutoffs, k, value, key=key).withColumn("ly", F.log(F.greatest(F.col(value), F.lit(EPS))))
    fit = rows.groupBy("cutoff", key).agg(F.regr_slope("ly", "t").alias("b1"), F.regr_intercept("ly", "t").alias("b0"), F.max("n").alias("n"))
    out = expand_horizon(fit, horizon)
    return out.select("cutoff", key, "step", "date", F.exp(F.col("b0") + F.col("b1") * (F.col("n") - 1 + F.col("step"))).alias("y_pred"))


def pointwise(df: DataFrame, cutoffs: list[date] | DataFrame, value: str, forecaster: Callable, k: int = 10_000, horizon: int = HORIZON, key: str = "key") -> DataFrame:
    """Any ``forecaster(values, horizon) -> values``, run per (cutoff, key) on its last k values.

    A group is one key's months up to a cutoff, k rows at most."""
    import pandas as pd

    rows = context_tail(df, cutoffs, k, value, key=key).select("cutoff", key, "t", F.col(value).alias("v"))

    def run(names: tuple, part: pd.DataFrame) -> pd.DataFrame:
        pred = forecaster(part.sort_values("t")["v"].to_numpy(), horizon)
        return pd.DataFrame({"cutoff": names[0], key: names[1], "step": range(1, horizon + 1), "y_pred": pred})

    made = rows.groupBy("cutoff", key).applyInPandas(run, f"cutoff date, `{key}` string, step int, y_pred double")
    return made.withColumn("date", F.add_months("cutoff", F.col("step"))).withColumn("y_pred", F.greatest(F.col("y_pred"), F.lit(0.0)))


def attach_truth(forecast: DataFrame, df: DataFrame, value: str, key: str = "key") -> DataFrame:
    return forecast.join(df.select(key, "date", F.col(value).alias("y_true")), [key, "date"], "left")


def model_matrix(forecasts: DataFrame, models: list[str], keys: tuple[str, ...] = ("cutoff", "key", "step", "date")) -> DataFrame:
    """One column per model, rows that all models have: a single pivot in place of a fold of joins."""
    wide = forecasts.groupBy(*keys).pivot("model", models).agg(F.first("y_pred"))
    return wide.na.drop(subset=models)


def splice(series: DataFrame, value: str = "v", key: str = "key") -> DataFrame:
    """At each month the value of the earliest cutoff whose series covers it: a leak-free past."""
    return series.groupBy(key, "date").agg(F.min_by(value, "cutoff").alias(value))


def loo(column: Column, *keys: str) -> Column:
    """A sum over all cutoffs but the row's own: totals less own."""
    return F.sum(column).over(Window.partitionBy(*keys)) - column
