"""Fractional flow by a power law: ln WOR = ln alpha + beta ln W on the last valid months."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import backtest

K, MIN_POINTS, EPS = 48, 6, 1e-9
WCT = (0.01, 0.999)
#: The grid of shrinkage weights; None stands for infinity. Fixed values.
LAMBDAS = (0.0, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 4.0, 16.0, 64.0, 256.0, 1024.0, 4096.0, 16384.0, 65536.0, None)


def valid(df: DataFrame) -> DataFrame:
    """Rows of (key, date, liq, wct, w_cum) that the fit may use, with its coordinates."""
    ok = (F.col("liq") > 0) & (F.col("wct") > WCT[0]) & (F.col("wct") < WCT[1]) & (F.col("w_cum") > 0)
    return df.where(ok).withColumn("lw", F.log("w_cum")).withColumn("lwor", F.log(F.col("wct") / (1 - F.col("wct"))))


def fit(df: DataFrame, cutoffs: list[date], k: int = K, key: str = "key") -> DataFrame:
    """(cutoff, key, n, ln_alpha, beta, fo_const): below MIN_POINTS only the last oil share, zero at least."""
    rows = backtest.context_tail(valid(df), cutoffs, k, "lwor", min_history=0, key=key)
    few = F.count("*") < MIN_POINTS
    made = rows.groupBy("cutoff", key).agg(
        F.count("*").alias("n"),
        F.when(~few, F.regr_intercept("lwor", "lw")).alias("ln_alpha"),
        F.when(~few, F.regr_slope("lwor", "lw")).alias("beta"),
    )
    last = backtest.contexts(df.where("liq > 0"), cutoffs).groupBy("cutoff", key).agg(F.greatest(F.max_by(1 - F.col("wct"), "date"), F.lit(0.0)).alias("fo_const"))
    return last.join(made, ["cutoff", key], "left").select("cutoff", key, F.coalesce("n", F.lit(0)).alias("n"), "ln_alpha", "beta", F.when(F.coalesce("n", F.lit(0)) < MIN_POINTS, F.col("fo_const")).alias("fo_const"))


def oil_share(w_cum: Column) -> Column:
    curve = 1 / (1 + F.exp(F.col("ln_alpha") + F.col("beta") * F.log(F.greatest(w_cum, F.lit(EPS)))))
    return F.coalesce(curve, F.col("fo_const"))


def hierarchical(df: DataFrame, cutoffs: list[date], k: int = K, min_keys: int = 3, floor: float = 1e-3, key: str = "key") -> DataFrame:
    """(cutoff, key, mode, lam_order, lam, a, b, centre): each key's line, drawn to its field's or block's mean.

    ln W is centred by the cutoff's mean. theta solves (X'X + lam D) theta = X'y + lam D mu with D the
    inverse variances; an infinite lam gives mu. The sums are taken once per key; the grid only repeats a
    2 x 2 solution in closed form."""
    rows = backtest.context_tail(valid(df), cutoffs, k, "lwor", min_history=MIN_POINTS, key=key)
    centres = rows.groupBy("cutoff").agg(F.avg("lw").alias("centre"))  # a row for each cutoff, which are a parameter
    centred = rows.join(F.broadcast(centres), "cutoff").withColumn("x", F.col("lw") - F.col("centre"))
    sums = centred.groupBy("cutoff", "block", key).agg(
        F.count("*").cast("double").alias("n"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum("lwor").alias("sy"), F.sum(F.col("x") * F.col("lwor")).alias("sxy"), F.first("centre").alias("centre"),
        F.regr_intercept("lwor", "x").alias("a0"), F.regr_slope("lwor", "x").alias("b0"),
    )

    def spread(w, c: str) -> tuple[Column, Column]:
        return F.avg(c).over(w), F.greatest(F.var_samp(c).over(w), F.lit(floor))

    field, block = Window.partitionBy("cutoff"), Window.partitionBy("cutoff", "block")
    enough = F.count(F.lit(1)).over(block) >= min_keys
    modes = []
    for name in ("global", "block"):
        parts = {}
        for c in ("a0", "b0"):
            (m, v), (bm, bv) = spread(field, c), spread(block, c)
            parts[c] = (m, v) if name == "global" else (F.when(enough, bm).otherwise(m), F.when(enough, bv).otherwise(v))
        modes.append(F.struct(F.lit(name).alias("mode"), parts["a0"][0].alias("ma"), parts["a0"][1].alias("va"), parts["b0"][0].alias("mb"), parts["b0"][1].alias("vb")))
    each = sums.withColumn("m", F.array(*modes)).withColumn("m", F.explode("m")).select("*", "m.*").drop("m")
    grid = F.array(*(F.struct(F.lit(i).alias("lam_order"), F.lit(v).cast("double").alias("lam")) for i, v in enumerate(LAMBDAS)))
    each = each.withColumn("g", F.explode(grid)).select("*", "g.*").drop("g")
    lam = F.coalesce("lam", F.lit(0.0))
    p, q, r = F.col("n") + lam / F.col("va"), F.col("sx"), F.col("sxx") + lam / F.col("vb")
    u, v = F.col("sy") + lam * F.col("ma") / F.col("va"), F.col("sxy") + lam * F.col("mb") / F.col("vb")
    det = p * r - q * q
    a = F.when(F.col("lam").isNull(), F.col("ma")).otherwise((u * r - v * q) / det)
    b = F.when(F.col("lam").isNull(), F.col("mb")).otherwise((p * v - q * u) / det)
    return each.select("cutoff", key, "mode", "lam_order", "lam", a.alias("a"), b.alias("b"), "centre")


def select_configuration(errors: DataFrame) -> DataFrame:
    """(cutoff, mode, lam_order): the configuration with the least WAPE on the other cutoffs, the first of equals.

    ``errors`` has cutoff, mode, lam_order, ae and ay, the sums of one cutoff."""
    other = errors.withColumn("w", backtest.loo(F.col("ae"), "mode", "lam_order") / backtest.loo(F.col("ay"), "mode", "lam_order"))
    order = F.struct(F.round("w", 12).alias("w"), F.when(F.col("mode") == "global", 0).otherwise(1).alias("m"), "lam_order")
    return other.groupBy("cutoff").agg(F.min_by(F.struct("mode", "lam_order"), order).alias("best")).select("cutoff", "best.*")
