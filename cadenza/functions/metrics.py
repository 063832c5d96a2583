"""Forecast errors as aggregate expressions.

Rows without a truth are to be filtered by the caller (:func:`observed`); a metric whose denominator
isn't positive is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def observed(df: DataFrame, y: str = "y_true") -> DataFrame:
    return df.where(F.col(y).isNotNull() & ~F.isnan(y))


def wape(y: Column | str, p: Column | str) -> Column:
    total = F.sum(F.abs(_c(y)))
    return F.when(total > 0, F.sum(F.abs(_c(y) - _c(p))) / total)


def smape(y: Column | str, p: Column | str) -> Column:
    half = (F.abs(_c(y)) + F.abs(_c(p))) / 2
    return F.avg(F.when(half > 0, F.abs(_c(y) - _c(p)) / half))


def rmse(y: Column | str, p: Column | str) -> Column:
    return F.sqrt(F.avg((_c(y) - _c(p)) * (_c(y) - _c(p))))


def mae(y: Column | str, p: Column | str) -> Column:
    return F.avg(F.abs(_c(y) - _c(p)))


def cum_error_pct(y: Column | str, p: Column | str) -> Column:
    return F.when(F.sum(_c(y)) > 0, (F.sum(_c(p)) - F.sum(_c(y))) / F.sum(_c(y)) * 100)


def coverage(y: Column | str, low: Column | str, high: Column | str) -> Column:
    """Share of rows within the interval; a null end counts as a miss."""
    return F.avg(F.when(_c(y).between(_c(low), _c(high)), 1.0).otherwise(0.0))


def relative_width(y: Column | str, low: Column | str, high: Column | str) -> Column:
    return F.avg(_c(high) - _c(low)) / F.nullif(F.avg(_c(y)), F.lit(0.0))


def pinball(df: DataFrame, quantiles: dict[str, float], y: str = "y_true") -> DataFrame:
    """Mean pinball loss over rows and the quantile columns."""
    rows = F.explode(F.array(*(F.struct(F.lit(t).alias("tau"), (F.col(y) - F.col(c)).alias("d")) for c, t in quantiles.items())))
    return df.select(rows.alias("r")).agg(F.avg(F.greatest(F.col("r.tau") * F.col("r.d"), (F.col("r.tau") - 1) * F.col("r.d"))).alias("pinball"))


def mase(forecast: DataFrame, history: DataFrame, key: str = "key", value: str = "value", at: str = "date") -> DataFrame:
    """Mean absolute error per key over the mean absolute change in its history."""
    step = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(at)))
    scale = history.select(key, step.alias("d")).groupBy(key).agg(F.avg("d").alias("scale"))
    errors = observed(forecast).groupBy(key).agg(mae("y_true", "y_pred").alias("mae"))
    return errors.join(scale, key).select(key, F.when(F.col("scale") > 0, F.col("mae") / F.col("scale")).alias("mase"))


def summarize(forecast: DataFrame, by: str = "cutoff", key: str = "key") -> DataFrame:
    """One row per cutoff and one for all ('ALL'): the pooled errors, and the median of the keys' WAPE.

    Sums are taken once per (cutoff, key); both levels are rolled up from those rows."""
    y, p = F.col("y_true"), F.col("y_pred")
    half = (F.abs(y) + F.abs(p)) / 2
    cells = observed(forecast).groupBy(by, key).agg(
        F.count("*").alias("n"), F.sum(F.abs(y - p)).alias("ae"), F.sum(F.abs(y)).alias("ay"), F.sum((y - p) * (y - p)).alias("se"), F.sum(y).alias("sy"), F.sum(p).alias("sp"),
        F.sum(F.when(half > 0, F.abs(y - p) / half)).alias("sm"), F.count(F.when(half > 0, 1)).alias("ns"),
    )
    sums = [F.sum(c).alias(c) for c in ("n", "ae", "ay", "se", "sy", "sp", "sm", "ns")]
    levels = cells.groupingSets([[F.col(by), F.col(key)], [F.col(key)]], by, key).agg(F.grouping(by).alias("every"), *sums)
    out = levels.groupBy("every", by).agg(*sums, F.median(F.col("ae") / F.nullif(F.col("ay"), F.lit(0.0))).alias("wape_med_key"))
    return out.select(
        F.when(F.col("every") == 1, F.lit("ALL")).otherwise(F.col(by).cast("string")).alias(by),
        F.when(F.col("ay") > 0, F.col("ae") / F.col("ay")).alias("wape"),
        (F.col("sm") / F.nullif(F.col("ns"), F.lit(0))).alias("smape"),
        F.sqrt(F.col("se") / F.col("n")).alias("rmse"),
        F.when(F.col("sy") > 0, (F.col("sp") - F.col("sy")) / F.col("sy") * 100).alias("cum_err_pct"),
        "wape_med_key",
    )
