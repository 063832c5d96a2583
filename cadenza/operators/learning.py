"""Learned forecasters on Spark's own gradient-boosted trees, and stacking.

Training and prediction are Spark ML jobs over long feature rows; the recursion over the horizon keeps each
series' last values in an array column, so that no series leaves the executors."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import date

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendar import HORIZON
from ..sources.shared import stored
from .ensemble import bags, blend, weights_nnls
from .panel import lags

LAGS, MEANS = (1, 2, 3, 4, 5, 6, 12), (3, 6)
FEATURES = [*(f"lag{k}" for k in LAGS), *(f"mean{k}" for k in MEANS)]
#: What a known column holds where it is null: less than all its values, so that a split can set it apart.
MISSING = -1.0


def _vector(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df)


def _trees(seed: int, trees: int, step: float, depth: int, loss: str = "squared") -> GBTRegressor:
    return GBTRegressor(labelCol="y", maxIter=trees, maxDepth=depth, stepSize=step, minInstancesPerNode=20, subsamplingRate=0.9, lossType=loss, seed=seed)


def forecaster() -> GBTRegressor:
    """Depth 5 holds the 31 leaves of the surveyed model."""
    return _trees(0, 600, 0.03, 5)


def stacker() -> GBTRegressor:
    """Depth 4 holds the 15 leaves of the surveyed model."""
    return _trees(42, 300, 0.05, 4, "absolute")


#: Models that are trained at the same time.
PARALLEL = 8


def fits(spark: SparkSession, cutoffs: list[date], fit: Callable[[date], GBTRegressionModel]) -> dict[date, GBTRegressionModel]:
    """A model for each cutoff. Boosting is a chain of small jobs, so the cutoffs' chains run side by side."""
    with ThreadPoolExecutor(PARALLEL) as pool:
        return dict(zip(cutoffs, pool.map(inheritable_thread_target(spark)(fit), cutoffs), strict=True))


def _known(names: list[str]) -> list[Column]:
    return [F.coalesce(F.col(c).cast("double"), F.lit(MISSING)).alias(c) for c in names]


def train(panel: DataFrame, value: str, cutoffs: list[date], known: list[str] = (), key: str = "key") -> dict[date, GBTRegressionModel]:
    """Trees over the lags of all series up to each date, and over columns ``known`` ahead: one model for the field.

    The lags are made once. A known column that is null is MISSING, so it must not be negative otherwise."""
    rows = lags(panel, value, LAGS, MEANS, key).withColumn("y", F.col(value)).na.drop(subset=["y", *FEATURES])
    made = stored(rows.select("date", "y", *FEATURES, *_known(known)), "gbt-lags")
    vectors = _vector(made, [*FEATURES, *known])
    return fits(panel.sparkSession, cutoffs, lambda c: forecaster().fit(vectors.where(F.col("date") <= F.lit(c)).select("features", "y")))


def backtest(panel: DataFrame, value: str, models: dict[date, GBTRegressionModel], known: list[str] = (), horizon: int = HORIZON, key: str = "key") -> DataFrame:
    """(cutoff, key, step, date, y_pred): a model of :func:`train` for each cutoff, each step fed with the ones before.

    Of the months after a cutoff only the ``known`` columns are read."""
    parts = []
    for c, model in models.items():
        values = F.transform(F.sort_array(F.collect_list(F.struct("date", value))), lambda x: x[value])
        state = panel.where((F.col("date") <= F.lit(c)) & (F.col("date") > F.add_months(F.lit(c), -max(LAGS))) & F.col(value).isNotNull()).groupBy(key).agg(values.alias("h")).where(F.size("h") == max(LAGS))
        preds = state.withColumn("out", F.expr("cast(array() as array<double>)"))
        if known:
            ahead = panel.where((F.col("date") > F.lit(c)) & (F.col("date") <= F.add_months(F.lit(c), horizon)))
            month = F.date_format("date", "yyyy-MM-dd")
            preds = preds.join(ahead.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(month, F.struct(*known)))).alias("ahead")), key, "left")
        else:
            preds = preds.withColumn("ahead", F.lit(None))

        def mean(k: int) -> Column:
            return F.aggregate(F.slice("h", -k, k), F.lit(0.0), lambda s, x: s + x) / k

        for i in range(1, horizon + 1):
            month = F.date_format(F.add_months(F.lit(c), i), "yyyy-MM-dd")
            then = [F.coalesce(F.try_element_at("ahead", month)[n].cast("double"), F.lit(MISSING)).alias(n) for n in known]
            made = preds.select(key, "h", "out", "ahead", *(F.element_at("h", -k).alias(f"lag{k}") for k in LAGS), *(mean(k).alias(f"mean{k}") for k in MEANS), *then)
            p = F.greatest(F.col("prediction"), F.lit(0.0))
            preds = model.transform(_vector(made, [*FEATURES, *known])).select(key, "ahead", F.concat(F.slice("h", 2, max(LAGS)), F.array(p)).alias("h"), F.concat("out", F.array(p)).alias("out"))
        parts.append(preds.select(F.lit(c).alias("cutoff"), key, F.posexplode("out").alias("i", "y_pred")).select("cutoff", key, (F.col("i") + 1).alias("step"), F.add_months("cutoff", F.col("i") + 1).alias("date"), "y_pred"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def importance(model: GBTRegressionModel, features: list[str] = FEATURES, top: int = 12) -> list[tuple[str, float]]:
    """The features of most gain, as shares; there are as many as features."""
    gains = model.featureImportances.toArray()
    total = float(gains.sum()) or 1.0
    return sorted(((f, float(g) / total) for f, g in zip(features, gains, strict=True)), key=lambda x: (-x[1], x[0]))[:top]


def meta(matrix: DataFrame, models: list[str], features: DataFrame, cutoffs: list[date]) -> DataFrame:
    """Stacking by trees with absolute loss over the models' forecasts, the step and the series' state;
    a cutoff is predicted by trees that never saw it."""
    names = [*models, "step", "wct_last", "age_m", "block_code"]
    rows = matrix.join(features, ["cutoff", "key"]).withColumn("y", F.col("y_true")).na.drop(subset=[*names, "y"])
    held_rows = stored(rows.select("cutoff", "key", "date", "y_true", "y", *names), "gbt-stack")
    vectors = _vector(held_rows, names).select("cutoff", "key", "step", "date", "y_true", "y", "features")
    made = fits(matrix.sparkSession, cutoffs, lambda c: stacker().fit(vectors.where(F.col("cutoff") != F.lit(c)).select("features", "y")))
    parts = []
    for c, model in made.items():
        parts.append(model.transform(vectors.where(F.col("cutoff") == F.lit(c))).select("cutoff", "key", "step", "date", "y_true", F.greatest("prediction", F.lit(0.0)).alias("y_pred")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def greedy_step(matrix: DataFrame, models: list[str], key: str = "key") -> DataFrame:
    """Greedy bags per key over the models and one more: their non-negative blend per step.

    The blend of a training row leaves out the row's own cutoff, and the test's as well: the Gram sums of
    each cutoff are taken once, and a pair of cutoffs is totals less two."""
    import numpy as np

    from ..functions.solvers import nnls, unit_sum

    k = len(models)
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i:]] + [(a, "y_true") for a in models]
    sums = matrix.groupBy("cutoff", "step").agg(F.array(*(F.sum(F.col(a) * F.col(b)) for a, b in pairs)).alias("g"))
    every = Window.partitionBy("step")
    totals = sums.withColumn("all", F.array(*(F.sum(F.col("g")[i]).over(every) for i in range(len(pairs)))))
    other = totals.select(F.col("cutoff").alias("test"), "step", F.col("g").alias("gt"))
    less = totals.join(other, "step").withColumn("same", F.col("cutoff") == F.col("test"))
    left = F.transform("all", lambda x, i: x - F.get("g", i) - F.when(F.col("same"), F.lit(0.0)).otherwise(F.get("gt", i)))
    grams = less.select("test", "cutoff", "step", left.alias("g"))

    def solve(batches):
        upper = np.triu_indices(k)
        for part in batches:
            out = []
            for g in part["g"]:
                gram = np.zeros((k, k))
                gram[upper] = g[: len(upper[0])]
                gram = gram + np.triu(gram, 1).T
                out.append(unit_sum(nnls(gram, np.asarray(g[len(upper[0]) :], float))).tolist())
            yield part[["test", "cutoff", "step"]].assign(w=out)

    weights = grams.mapInPandas(solve, "test date, cutoff date, step int, w array<double>")
    preds = F.array(*models)
    blended = F.greatest(F.aggregate(F.zip_with(preds, F.col("w"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x), F.lit(0.0))
    rows = matrix.withColumn("step", F.col("step").cast("int")).join(weights, ["cutoff", "step"]).withColumn("nnls_step", blended)
    names = [*models, "nnls_step"]
    # A bag is filled from one key's forecast rows with the blends for one test cutoff: cutoffs x steps of them.
    found = bags(rows.where("cutoff <> test"), names, ["test", key]).where("n >= 12").select(F.col("test").alias("_test"), F.col(key).alias("_key"), "weights")
    own = rows.where("cutoff = test").join(found, (F.col("test") == F.col("_test")) & (F.col(key) == F.col("_key")), "left")
    bagged = F.aggregate(F.zip_with(F.array(*names), F.col("weights"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    y = F.greatest(F.coalesce(bagged, F.col("nnls_step")), F.lit(0.0))
    return own.select("cutoff", key, "step", "date", "y_true", y.alias("y_pred"))


__all__ = ["backtest", "blend", "fits", "greedy_step", "importance", "meta", "train", "weights_nnls"]
