"""Dependence between series: ranks, tests, joint coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import average_rank, averaged_rank, normal_cdf, probit, quantiles, running_ranks


def relative_error(y: str = "y_true", p: str = "y_pred") -> Column:
    return (F.col(y) - F.col(p)) / F.greatest(F.abs(p), F.lit(1e-9))


def ends(df: DataFrame, columns: tuple[str, ...], low: float, high: float) -> DataFrame:
    """One row with an array of the two quantiles of each column, by its name after an underscore."""
    each = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("_of"), F.col(c).cast("double").alias("_x")) for c in columns))))
    found = quantiles(each, ["_of"], "_x", [low, high])
    return found.agg(*(F.max(F.when(F.col("_of") == c, F.col("q"))).alias(f"_{c}") for c in columns))


def winsorised(df: DataFrame, *columns: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    both = df.crossJoin(F.broadcast(ends(df, columns, low, high)))  # one row
    return both.withColumns({c: F.least(F.greatest(F.col(c), F.col(f"_{c}")[0]), F.col(f"_{c}")[1]) for c in columns}).drop(*(f"_{c}" for c in columns))


def spearman(df: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    ranked = df.withColumn("_ra", average_rank(a, *keys)).withColumn("_rb", average_rank(b, *keys))
    return ranked.groupBy(*keys).agg(F.corr("_ra", "_rb").alias("rho"), F.count("*").alias("n"))


def normal_scores(df: DataFrame, value: str, *keys: str, out: str = "z") -> DataFrame:
    """Normal scores of the ranks within the keys, or over all rows; a null among the latter has none and doesn't count."""
    if keys:
        n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        return df.withColumn(out, probit(average_rank(value, *keys) / (n + 1)))
    n = df.agg(F.count(value).alias("_n"))  # one row
    return averaged_rank(df, value, "_rank").crossJoin(F.broadcast(n)).withColumn(out, probit(F.col("_rank") / (F.col("_n") + 1))).drop("_rank", "_n")


def mann_whitney(df: DataFrame, value: str, flag: str) -> DataFrame:
    """U of the flagged rows against the others, and its one-sided p by the normal approximation with ties.

    Equal values are counted first, and the running rank goes over the distinct values, range by range."""
    counts = running_ranks(df.where(F.col(value).isNotNull()), value, F.count(F.when(F.col(flag), 1)).alias("a"))
    t, n1, n = F.col("t").cast("double"), F.sum("a").cast("double"), F.sum("t").cast("double")
    sums = counts.agg(F.sum(F.col("a") * F.col("rank")).alias("r1"), n1.alias("n1"), n.alias("n"), F.sum(t * t * t - t).alias("ties"))
    u, n1, n = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1"), F.col("n")
    n2 = n - n1
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    return sums.select(n1.cast("long").alias("n1"), n2.cast("long").alias("n2"), u.alias("u"), (1 - normal_cdf((u - n1 * n2 / 2 - 0.5) / sd)).alias("p"))


def joint_coverage(df: DataFrame, a: str, b: str) -> DataFrame:
    """Share of rows within the marginal 10..90 % ranges: of each, of both, and the product of the two."""
    both = df.crossJoin(F.broadcast(ends(df, (a, b), 0.1, 0.9)))  # one row
    ia, ib = (F.when(F.col(c).between(F.col(f"_{c}")[0], F.col(f"_{c}")[1]), 1.0).otherwise(0.0) for c in (a, b))
    return both.agg(F.avg(ia).alias("cov_a"), F.avg(ib).alias("cov_b"), F.avg(ia * ib).alias("cov_joint"), (F.avg(ia) * F.avg(ib)).alias("cov_independent"))


def rectangle(rho: Column, z: float = 1.2815515655446004, nodes: int = 200) -> Column:
    """P(|X| < z, |Y| < z) of a standard bivariate normal: Plackett's integral over the correlation."""
    # d/dr of the rectangle is a difference of densities at its corners; Simpson's rule over 0 .. rho.
    base = 0.8 * 0.8

    def density(r: Column) -> Column:
        s = 1 - r * r
        return (2 * F.exp(-(z * z) / (1 + r)) - 2 * F.exp(-(z * z) / (1 - r))) / (2 * 3.141592653589793 * F.sqrt(s))

    steps = F.sequence(F.lit(0), F.lit(nodes))
    weight = lambda i: F.when((i == 0) | (i == nodes), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
    total = F.aggregate(steps, F.lit(0.0), lambda s, i: s + weight(i) * density(rho * i / float(nodes)))
    return base + rho / nodes / 3 * total
