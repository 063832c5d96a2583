"""Prediction intervals calibrated on cutoffs whose horizons don't overlap the test's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import month_number
from ..functions.stats import order_statistic, upper_rank

EPS, CAP, MIN_BIN, BETA, GAP = 1e-9, 1e6, 30, 0.05, 6


def distance_ratio(y: str = "y_true", mid: str = "q50", low: str = "q10", high: str = "q90") -> Column:
    """How far the truth lies from the median, in half-widths of the interval."""
    up = (F.col(y) - F.col(mid)) / F.greatest(F.col(high) - F.col(mid), F.lit(EPS))
    down = (F.col(mid) - F.col(y)) / F.greatest(F.col(mid) - F.col(low), F.lit(EPS))
    return F.least(F.when(F.col(y) >= F.col(mid), up).otherwise(down), F.lit(CAP))


def folds(rows: DataFrame, gap: int = GAP) -> DataFrame:
    """Each row once for every fold (cutoff) at least ``gap`` months away: an array filter, not a theta join."""
    every = rows.select("cutoff").distinct().agg(F.sort_array(F.collect_set("cutoff")).alias("folds"))  # the cutoffs are few
    far = F.filter("folds", lambda c: F.abs(month_number(c) - month_number(F.col("cutoff"))) >= gap)
    return rows.crossJoin(F.broadcast(every)).withColumn("fold", F.explode(far)).drop("folds")


def multiplicative(rows: DataFrame) -> DataFrame:
    """(fold, step, n_calib, scale): the upper 0.8-quantile of the ratios at each step."""
    ratio = folds(rows.withColumn("r", distance_ratio()))
    return order_statistic(ratio, ["fold", "step"], "r", upper_rank(8, 10), 0.8, out="scale").withColumnRenamed("n", "n_calib")


def multiplicative_coverage(rows: DataFrame) -> DataFrame:
    """(fold, n_calib, coverage_before, coverage_after) of each fold's own rows."""
    scales = multiplicative(rows)
    own = rows.withColumn("r", distance_ratio()).join(scales, (F.col("cutoff") == F.col("fold")) & (rows["step"] == scales["step"]))
    return own.groupBy("fold").agg(F.min("n_calib").alias("n_calib"), F.avg(F.when(F.col("y_true").between(F.col("q10"), F.col("q90")), 1.0).otherwise(0.0)).alias("coverage_before"), F.avg(F.when(F.col("r") <= F.col("scale"), 1.0).otherwise(0.0)).alias("coverage_after"))


def _bins(calib: DataFrame, method: str) -> DataFrame:
    """The bin of each row; blocks with a bin of fewer than MIN_BIN rows at some step share 'other'."""
    if method in ("split", "norm_pred"):
        return calib.withColumn("bin", F.lit("all"))
    if method in ("mond_step", "norm_x_step"):
        return calib.withColumn("bin", F.col("step").cast("string"))
    sizes = calib.groupBy("fold", "step", "block").agg(F.count("*").alias("_n")).groupBy("fold", "block").agg(F.min("_n").alias("_m"))
    pooled = calib.join(sizes, ["fold", "block"])
    return pooled.withColumn("bin", F.concat_ws("|", F.col("step").cast("string"), F.when(F.col("_m") >= MIN_BIN, F.col("block")).otherwise("other"))).drop("_m")


METHODS = ("split", "mond_step", "mond_sxb", "norm_pred", "norm_x_step")


def conformal(rows: DataFrame, method: str) -> DataFrame:
    """``rows`` with q10 and q90: y_pred plus and minus an order statistic of the residuals of the row's bin.

    The rank is ceil((n + 1) * 0.8) in whole numbers; with too few rows the interval is unbounded above.
    Normalised methods divide residuals by |y_pred| + BETA * mean |y_pred| of the fold's calibration rows."""
    calib = _bins(folds(rows), method)
    scaled = method.startswith("norm")
    means = calib.groupBy("fold").agg(F.avg(F.abs("y_pred")).alias("_mean"))
    sigma = F.abs("y_pred") + BETA * F.col("_mean") if scaled else F.lit(1.0)
    residuals = calib.join(means, "fold").select("fold", "bin", (F.abs(F.col("y_true") - F.col("y_pred")) / sigma).alias("a"))
    half = order_statistic(residuals, ["fold", "bin"], "a", lambda n: F.floor(((n + 1) * 8 + 9) / 10), 0.8, out="half")
    half = half.select(F.col("fold").alias("_f"), F.col("bin").alias("_b"), "half")
    shift = means.select(F.col("fold").alias("_f2"), "_mean")
    if method == "mond_sxb":
        kept = calib.select(F.col("fold").alias("_fold"), F.col("step").alias("_step"), F.col("block").alias("_block"), "bin").distinct()
        own = rows.join(kept, (F.col("cutoff") == F.col("_fold")) & (F.col("step") == F.col("_step")) & (F.col("block") == F.col("_block")), "left").select(*rows.columns, "bin")
    else:
        own = rows.withColumn("bin", F.lit("all") if method in ("split", "norm_pred") else F.col("step").cast("string"))
    out = own.join(half, (F.col("cutoff") == F.col("_f")) & (F.col("bin") == F.col("_b")), "left").join(shift, F.col("cutoff") == F.col("_f2"), "left")
    wide = F.col("half") * (F.abs("y_pred") + BETA * F.col("_mean") if scaled else F.lit(1.0))
    return out.select(*(F.col(c) for c in rows.columns), F.greatest(F.col("y_pred") - wide, F.lit(0.0)).alias("q10"), (F.col("y_pred") + wide).alias("q90"))


def pick(scores: DataFrame, target: float = 0.8, tolerance: float = 0.02) -> DataFrame:
    """The method of least (width, |coverage - target|) among those within the tolerance; else of most coverage."""
    ok = F.col("coverage") >= target - tolerance
    order = [F.when(ok, 0).otherwise(1), F.when(ok, F.col("width")).otherwise(-F.col("coverage")), F.abs(F.col("coverage") - target), F.col("method")]
    return scores.orderBy(*order).limit(1)
