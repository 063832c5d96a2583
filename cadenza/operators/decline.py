"""Hyperbolic decline of single series: q(t) = q0 (1 + b d t) ** (-1 / b), by variable projection in an array fold.

At given shape (ln d, b) the best level is a quotient of two sums, so only the two shape parameters are searched: by damped
Gauss-Newton steps on what the level leaves, its Jacobian's columns made orthogonal to the curve (Kaufman's form). A step needs nine sums over
the values; a worse loss turns it down and raises the damping, and a parameter at a bound that the gradient pushes on is
held. The fold runs a fixed number of steps, which is one expression over a series' array of values: a fit stays in
the JVM, in the task that holds the array.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import HORIZON, expand_horizon
from .backtest import context_tail

#: Values that the fit sees, and the least value; the start and bounds of ln d and of b. Fixed values.
TAIL, EPS = 36, 1e-6
START, LOG_D, B = (-3.912023005428146, 0.5), (-11.512925464970229, 0.0), (0.01, 2.0)
#: Steps of the fold, and the longest of ln d and of b; the first damping, and what it is divided and multiplied by.
STEPS, LONGEST = 25, (1.0, 0.5)
DAMPING, EASE, RAISE = 1e-3, 3.0, 4.0
#: The share of the sum of squares by which a step must better the loss: less is rounding.
GAIN = 1e-12


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` made once, even where the body uses it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def curve(log_d: Column, b: Column, t: Column) -> Column:
    """The decline from a level of one."""
    return F.exp(-F.log(1 + b * F.exp(log_d) * t) / b)


def _sum(values: Column, names: tuple[str, ...], of: Callable[[Column], tuple[Column, ...]]) -> Column:
    zero = F.struct(*(F.lit(0.0).alias(n) for n in names))
    return F.aggregate(values, zero, lambda s, x: F.struct(*((s[n] + v).alias(n) for n, v in zip(names, of(x), strict=True))))


def fit(values: Column) -> Column:
    """(level, log_d, b) of an array of values, as a struct; the level is at most ten times the largest value."""
    most, top = F.array_max(values), F.aggregate(values, F.lit(0.0), lambda s, v: s + v * v)

    def normal(log_d: Column, b: Column) -> Column:
        """The loss, the level, and the normal equations at a shape: a share of the sum of squares, aa, ab and bb, ga and gb."""

        def point(v: Column, t: Column) -> Column:
            drop = F.exp(log_d) * t
            logs = F.log(1 + b * drop)
            f = F.exp(-logs / b)
            by_d, by_b = -f * drop / (1 + b * drop), f * (logs / b - drop / (1 + b * drop)) / b
            return F.struct(v.alias("v"), f.alias("f"), by_d.alias("d"), by_b.alias("b"))

        points = F.transform(values, lambda v, i: point(v, i.cast("double")))
        names = ("vf", "ff", "fd", "fb", "dd", "db", "bb", "vd", "vb")
        sums = _sum(points, names, lambda x: tuple(x[n[0]] * x[n[1]] for n in names))

        def levelled(s: Column, q: Column) -> Column:
            return F.struct(
                ((top - 2 * q * s["vf"] + q * q * s["ff"]) / top).alias("loss"),
                q.alias("level"),
                (q * q * (s["dd"] - s["fd"] * s["fd"] / s["ff"])).alias("aa"),
                (q * q * (s["db"] - s["fd"] * s["fb"] / s["ff"])).alias("ab"),
                (q * q * (s["bb"] - s["fb"] * s["fb"] / s["ff"])).alias("bb"),
                (q * (s["vd"] - s["vf"] * s["fd"] / s["ff"])).alias("ga"),
                (q * (s["vb"] - s["vf"] * s["fb"] / s["ff"])).alias("gb"),
            )

        return once(sums, lambda s: once(F.least(F.greatest(s["vf"] / s["ff"], F.lit(EPS)), 10 * most), lambda q: levelled(s, q)))

    def clip(x: Column, ends: tuple[float, float]) -> Column:
        return F.least(F.greatest(x, F.lit(ends[0])), F.lit(ends[1]))

    def moved(s: Column) -> Column:
        """The shape that a damped step leads to."""
        n = s["n"]
        free_d = ~(((s["log_d"] <= LOG_D[0]) & (n["ga"] < 0)) | ((s["log_d"] >= LOG_D[1]) & (n["ga"] > 0)))
        free_b = ~(((s["b"] <= B[0]) & (n["gb"] < 0)) | ((s["b"] >= B[1]) & (n["gb"] > 0)))
        system = F.struct(
            F.when(free_d, n["aa"] * (1 + s["damping"])).otherwise(1.0).alias("aa"),
            F.when(free_b, n["bb"] * (1 + s["damping"])).otherwise(1.0).alias("bb"),
            F.when(free_d & free_b, n["ab"]).otherwise(0.0).alias("ab"),
            F.when(free_d, n["ga"]).otherwise(0.0).alias("ga"),
            F.when(free_b, n["gb"]).otherwise(0.0).alias("gb"),
        )

        def solved(m: Column) -> Column:
            det = m["aa"] * m["bb"] - m["ab"] * m["ab"]
            by_d = F.when(det > 0, (m["ga"] * m["bb"] - m["gb"] * m["ab"]) / det).otherwise(0.0)
            by_b = F.when(det > 0, (m["gb"] * m["aa"] - m["ga"] * m["ab"]) / det).otherwise(0.0)
            log_d = clip(s["log_d"] + clip(by_d, (-LONGEST[0], LONGEST[0])), LOG_D)
            return F.struct(log_d.alias("log_d"), clip(s["b"] + clip(by_b, (-LONGEST[1], LONGEST[1])), B).alias("b"))

        return once(system, solved)

    def step(s: Column, _: Column) -> Column:
        def judged(p: Column, n: Column) -> Column:
            better = n["loss"] < s["n"]["loss"] - GAIN
            taken = F.struct(p["log_d"].alias("log_d"), p["b"].alias("b"), (s["damping"] / EASE).alias("damping"), n.alias("n"))
            kept = F.struct(s["log_d"].alias("log_d"), s["b"].alias("b"), (s["damping"] * RAISE).alias("damping"), s["n"].alias("n"))
            return F.when(better, taken).otherwise(kept)

        return once(moved(s), lambda p: once(normal(p["log_d"], p["b"]), lambda n: judged(p, n)))

    first = F.struct(F.lit(START[0]).alias("log_d"), F.lit(START[1]).alias("b"), F.lit(DAMPING).alias("damping"), normal(F.lit(START[0]), F.lit(START[1])).alias("n"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), first, step, lambda s: F.struct(s["n"]["level"].alias("level"), s["log_d"].alias("log_d"), s["b"].alias("b")))


def arps(df: DataFrame, cutoffs: list[date] | DataFrame, value: str, k: int = TAIL, horizon: int = HORIZON, key: str = "key") -> DataFrame:
    """(cutoff, key, step, date, y_pred): the decline of the last k values of each series, carried on."""
    rows = context_tail(df, cutoffs, k, value, key=key).select("cutoff", key, "t", F.greatest(F.col(value).cast("double"), F.lit(EPS)).alias("v"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda x: x["v"])
    fitted = rows.groupBy("cutoff", key).agg(listed.alias("values")).select("cutoff", key, F.size("values").alias("n"), fit(F.col("values")).alias("f"))
    out = expand_horizon(fitted, horizon)
    return out.select("cutoff", key, "step", "date", (F.col("f.level") * curve(F.col("f.log_d"), F.col("f.b"), (F.col("n") - 1 + F.col("step")).cast("double"))).alias("y_pred"))
