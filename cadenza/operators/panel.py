"""Panel operators: long rows (key, date, values), one row per key and month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import days_in_month
from ..functions.stats import places

MIN_HOURS = 24


def by_date(key: str = "key"):
    return Window.partitionBy(key).orderBy("date")


def upto(key: str = "key"):
    return by_date(key).rowsBetween(Window.unboundedPreceding, 0)


def nan_to_null(df: DataFrame, *columns: str) -> DataFrame:
    """NaN means missing at the border only; inside, missing is null."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """Fails where two rows share the keys, as a pivot would silently merge them."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    checked = df.withColumn("_n", n)
    return checked.where(F.coalesce(F.assert_true(F.col("_n") == 1, F.lit("duplicate rows for " + ", ".join(keys))).cast("boolean"), F.lit(True))).drop("_n")


def watercut(liq: Column | str = "liq_t", oil: Column | str = "oil_t") -> Column:
    liq, oil = (F.col(c) if isinstance(c, str) else c for c in (liq, oil))
    return F.when(liq > 0, 1 - oil / liq)


def rates(df: DataFrame) -> DataFrame:
    """Per-day rates of the monthly totals, and the watercut."""
    days = days_in_month("date")
    return df.withColumn("days", days).withColumn("liq_tpd", F.col("liq_t") / days).withColumn("oil_tpd", F.col("oil_t") / days).withColumn("wct", watercut())


def uptime(df: DataFrame, volume: str = "liq_t", hours: str = "hours") -> DataFrame:
    """Share of the month on stream, and the rate per operating day; null below MIN_HOURS."""
    on = F.col(hours)
    return df.withColumn("uptime", on / (24 * days_in_month("date"))).withColumn("eff_rate", F.when(on >= MIN_HOURS, F.col(volume) / (on / 24)))


def complete(df: DataFrame, keys: DataFrame | None = None, key: str = "key") -> DataFrame:
    """Every key in every month between the panel's first and last; absent values are null.

    The months are a sequence of the two ends, one row each; the keys are few against the rows."""
    keys = df.select(key, *(["block"] if "block" in df.columns else [])).distinct() if keys is None else keys
    ends = df.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    months = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("date"))
    grid = keys.crossJoin(months)  # the grid itself is the result: keys x months
    return grid.join(df.drop("block") if "block" in keys.columns else df, [key, "date"], "left")


def started(df: DataFrame, *values: str, weight: str = "weff", key: str = "key") -> DataFrame:
    """Values before a key's first effective month are null, not zero."""
    on = F.sum(F.coalesce(F.col(weight), F.lit(0))).over(upto(key)) > 0
    return df.withColumns({v: F.when(on, F.col(v)) for v in values})


def cumulative(df: DataFrame, value: str, key: str = "key", out: str = "cum", exclusive: bool = False) -> DataFrame:
    w = by_date(key).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0.0)))


def age(df: DataFrame, value: str, key: str = "key") -> DataFrame:
    return df.withColumn("age_m", F.count(value).over(upto(key)))


def fill(df: DataFrame, value: str, backward: bool = False, key: str = "key", out: str = "filled") -> DataFrame:
    """The last known value; before the first one the next, if ``backward``."""
    last = F.last(value, ignorenulls=True).over(upto(key))
    ahead = F.first(value, ignorenulls=True).over(by_date(key).rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(out, F.coalesce(last, ahead) if backward else last)


def interpolate(df: DataFrame, value: str, key: str = "key", out: str = "filled") -> DataFrame:
    """Linear between known months by their number; the nearest known value outside."""
    n = F.row_number().over(by_date(key))
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_n").alias("n"), F.col(value).alias("v")))
    before = F.last(known, ignorenulls=True).over(upto(key))
    after = F.first(known, ignorenulls=True).over(by_date(key).rowsBetween(0, Window.unboundedFollowing))
    both = df.withColumn("_n", n).withColumn("_a", before).withColumn("_b", after)
    a, b = F.col("_a"), F.col("_b")
    between = a["v"] + (b["v"] - a["v"]) * (F.col("_n") - a["n"]) / F.nullif(b["n"] - a["n"], F.lit(0))
    return both.withColumn(out, F.coalesce(F.col(value), between, a["v"], b["v"])).drop("_n", "_a", "_b")


def lags(df: DataFrame, value: str, steps: tuple[int, ...] = (1, 2, 3, 4, 5, 6, 12), means: tuple[int, ...] = (3, 6), key: str = "key") -> DataFrame:
    """Lags on a complete grid, and rolling means of the months before, null until they are whole."""
    out = {f"lag{k}": F.lag(value, k).over(by_date(key)) for k in steps}
    for k in means:
        w = by_date(key).rowsBetween(-k, -1)
        out[f"mean{k}"] = F.when(F.count(value).over(w) == k, F.avg(value).over(w))
    return df.withColumns(out)


def recency(df: DataFrame, half_life: float = 24.0, key: str = "key") -> DataFrame:
    n = F.row_number().over(by_date(key))
    total = F.count(F.lit(1)).over(Window.partitionBy(key))
    return df.withColumn("weight", F.pow(F.lit(0.5), (total - n) / half_life))


def tail(df: DataFrame, k: int, *keys: str) -> DataFrame:
    """The last k rows of each key, numbered t = 0, 1, .. upwards in time."""
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("date")))).where(F.col("_r") <= k)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return ranked.withColumn("n", n).withColumn("t", F.col("n") - F.col("_r")).drop("_r")


def pivot(df: DataFrame, value: str, keys: list[str], key: str = "key") -> DataFrame:
    return df.groupBy("date").pivot(key, keys).agg(F.first(value))


def unpivot(wide: DataFrame, keys: list[str], key: str = "key", value: str = "value") -> DataFrame:
    return wide.unpivot(["date"], keys, key, value)


def detrend(df: DataFrame, value: str, key: str = "key", out: str = "detrended") -> DataFrame:
    """What a straight line over the row numbers leaves."""
    n = df.withColumn("_t", F.row_number().over(by_date(key)) - 1)
    fit = n.where(F.col(value).isNotNull()).groupBy(key).agg(F.regr_slope(value, "_t").alias("_s"), F.regr_intercept(value, "_t").alias("_i"))
    return n.join(fit, key, "left").withColumn(out, F.col(value) - F.col("_i") - F.col("_s") * F.col("_t")).drop("_t", "_s", "_i")


def carry_forward(df: DataFrame, value: str, horizon: int, last, key: str = "key") -> DataFrame:
    """A plan that repeats each key's value of its last month ``horizon`` times."""
    held = df.where(F.col("date") <= F.lit(last)).groupBy(key).agg(F.max_by(value, "date").alias(value))
    return held.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("date", F.add_months(F.lit(last), F.col("step")))


def impute_group_mean(df: DataFrame, value: str, group: str) -> DataFrame:
    return df.withColumn(value, F.coalesce(F.col(value), F.avg(value).over(Window.partitionBy(group))))


def category_codes(df: DataFrame, column: str, out: str = "code") -> DataFrame:
    """0-based codes in sorted order of the distinct values, joined back, however many there are; null has none."""
    codes = places(df.select(column).where(F.col(column).isNotNull()).distinct(), column, out=out)
    kept = df.drop(out)
    return kept.join(codes, column, "left").select(*kept.columns, out)
