"""Statistics that Spark has no function for, as expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Rows of a group whose order statistic is looked for among all of them; of more, only among those near the quantile.
SMALL_GROUP = 10_000
#: Half the width of that neighbourhood, and the accuracy of the approximate quantiles that bound it.
MARGIN, ACCURACY = 0.01, 10_000
#: Parts into which an interval is cut to look for an order statistic.
CUTS = 32
#: Ranges into which values are dealt for a rank over all rows.
RANGES = 64


def upper_rank(q_num: int, q_den: int) -> Callable[[Column], Column]:
    """The place of the q-quantile that is a member of the sample, the upper one where two qualify, of n rows.

    It is found in whole numbers, ``ceil((n - 1) * q) + 1``, so no product is off by a rounding."""
    return lambda n: F.floor(((n - 1) * q_num + q_den - 1) / q_den) + 1


def order_statistic(rows: DataFrame, by: list[str], value: str, rank: Callable[[Column], Column], share: float, out: str = "value", small: int = SMALL_GROUP) -> DataFrame:
    """(by..., n, out): the value at place ``rank(n)`` of each group, or null where n is less; it lies near the share-quantile.

    Approximate quantiles, whose error is bounded, enclose it in a large group, so that only the rows between them
    are sorted and those below are counted: a group may hold most of all rows."""
    low, high = max(0.0, share - MARGIN), min(1.0, share + MARGIN)
    ends = rows.groupBy(*by).agg(F.count(value).alias("n"), F.percentile_approx(value, [low, high], ACCURACY).alias("_ends"))
    placed = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v")).join(ends, by)
    large = F.col("n") > small
    below, above = large & (F.col("_v") < F.col("_ends")[0]), large & (F.col("_v") > F.col("_ends")[1])
    counted = placed.groupBy(*by).agg(F.count_if(below).alias("_below"), F.first("n").alias("n"))
    at = F.row_number().over(Window.partitionBy(*by).orderBy("_v"))
    found = placed.where(~below & ~above).select(*by, "_v", at.alias("_at"))
    return counted.withColumn("_at", (rank(F.col("n")) - F.col("_below")).cast("int")).join(found, [*by, "_at"], "left").select(*by, "n", F.col("_v").alias(out))


def quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float], out: str = "q", small: int = SMALL_GROUP) -> DataFrame:
    """(by..., n, out): the values at ``shares`` of each group as an array, linear between neighbours; nulls and NaN don't count.

    Groups of up to ``small`` rows are sorted. In larger ones the two neighbours of each share are looked for by refinement: approximate
    quantiles cut the interval that holds one, the rows of each part are counted, and the part that holds it is cut
    again, until it has ``small`` rows or one value. What is sent is a count for each part, so one group may hold all
    rows; each round leaves about a thirtieth, so three rounds take 10**9 rows to fewer than 10**5."""
    keys = [*by, "_one"]
    rows = rows.select(*by, F.lit(1).alias("_one"), F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    sizes = stored(rows.groupBy(*keys).agg(F.count("*").alias("n")), "quantile-sizes")
    large = sizes.where(F.col("n") > small)
    if not by:
        sizes, large = F.broadcast(sizes), F.broadcast(large)  # one row
    whole = rows.join(sizes.where(F.col("n") <= small), keys).groupBy(*keys).agg(F.first("n").alias("n"), F.percentile("_v", shares).alias(out))
    if large.isEmpty():
        return whole.select(*by, "n", out)
    at = [F.lit(q) * (F.col("n") - 1) for q in shares]
    ends = F.array(*(F.struct(F.lit(2 * k + up).alias("_k"), f(x).cast("long").alias("_place")) for k, x in enumerate(at) for up, f in ((0, F.floor), (1, F.ceil))))
    # What is looked for: the value at a place among the ``held`` rows between low and high.
    sought = large.select(*keys, F.col("n").alias("_held"), F.inline(ends)).withColumns({"_low": F.lit(float("-inf")), "_high": F.lit(float("inf"))})
    sought = stored(sought, "quantile-places")
    while not sought.where((F.col("_held") > small) & (F.col("_low") < F.col("_high"))).isEmpty():
        open_ = sought.where((F.col("_held") > small) & (F.col("_low") < F.col("_high")))
        inside = rows.join(open_, keys).where(F.col("_v").between(F.col("_low"), F.col("_high")))
        cuts = inside.groupBy(*keys, "_k").agg(F.percentile_approx("_v", [i / CUTS for i in range(1, CUTS)], ACCURACY).alias("_cuts"))
        # A value that is a cut has a part of its own, so ties can't hold a part together.
        part = F.size(F.filter("_cuts", lambda c: c < F.col("_v"))) + F.size(F.filter("_cuts", lambda c: c <= F.col("_v")))
        counted = inside.join(cuts, [*keys, "_k"]).groupBy(*keys, "_k", part.alias("_part")).agg(F.first("_place").alias("_place"), F.count("*").alias("_held"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        upto = F.sum("_held").over(Window.partitionBy(*keys, "_k").orderBy("_part"))
        found = counted.withColumn("_upto", upto).where((F.col("_place") < F.col("_upto")) & (F.col("_place") >= F.col("_upto") - F.col("_held")))
        found = found.withColumn("_place", F.col("_place") - F.col("_upto") + F.col("_held")).select(*keys, "_held", "_k", "_place", "_low", "_high")
        sought = stored(sought.join(open_.select(*keys, "_k"), [*keys, "_k"], "left_anti").select(*found.columns).unionByName(found), "quantile-places")
    few = rows.join(sought.where("_low < _high"), keys).where(F.col("_v").between(F.col("_low"), F.col("_high")))
    few = few.groupBy(*keys, "_k").agg(F.element_at(F.sort_array(F.collect_list("_v")), (F.first("_place") + 1).cast("int")).alias("v"))
    values = few.unionByName(sought.where("_low = _high").select(*keys, "_k", F.col("_low").alias("v")))
    pairs = values.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_k", "v"))).alias("_v")).join(large, keys)
    low, high = ([F.element_at("_v", F.lit(2 * k + up)) for k in range(len(shares))] for up in (0, 1))
    between = F.array(*(a + (b - a) * (x - F.floor(x)) for a, b, x in zip(low, high, at, strict=True)))
    return whole.unionByName(pairs.select(*keys, "n", between.alias(out))).select(*by, "n", out)


def running_ranks(rows: DataFrame, value: str, *more: Column) -> DataFrame:
    """(value, t, rank, more...): of each distinct value its rows, its rank over all rows with ties averaged, and more sums.

    Distinct values are counted first and dealt into RANGES by approximate quantiles; the ranks run within a range
    and start from the rows of the ranges before it, so that no task holds all values."""
    counts = rows.groupBy(value).agg(F.count(F.lit(1)).alias("t"), *more)
    cuts = counts.agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], ACCURACY)).first()[0] or []
    of = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)).cast("array<double>"), lambda c: c < F.col(value)))
    dealt = counts.withColumn("_range", of)
    starts = dealt.groupBy("_range").agg(F.sum("t").alias("_rows"))  # RANGES rows at most
    starts = starts.select("_range", (F.sum("_rows").over(Window.orderBy("_range")) - F.col("_rows")).alias("_start"))
    before = F.sum("t").over(Window.partitionBy("_range").orderBy(value)) - F.col("t")
    ranked = dealt.withColumn("_before", before).join(F.broadcast(starts), "_range")
    return ranked.withColumn("rank", F.col("_start") + F.col("_before") + (F.col("t") + 1) / 2.0).drop("_range", "_start", "_before")


def averaged_rank(rows: DataFrame, value: str, out: str) -> DataFrame:
    """``rows`` with the rank of a value that isn't null over all rows, ties averaged."""
    ranks = running_ranks(rows.where(F.col(value).isNotNull()).select(value), value).select(value, F.col("rank").alias(out))
    return rows.join(ranks, value, "left")


def places(rows: DataFrame, *order: str, out: str) -> DataFrame:
    """``rows`` with their place in the given order, 0 for the first, by a sort in ranges.

    Rows are sorted within partitions that are ranges of the order; those of the partitions before are added from a table of a
    row a partition. The sorted rows are stored. Rows alike in all of the order have some place of theirs each."""
    by = [F.col(c) for c in order]
    sorted_rows = stored(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "places")
    # The id is the partition's number above 33 bits of the place in it.
    dealt = sorted_rows.withColumn("_part", F.shiftright("_at", 33))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_rows"))  # a row for each partition of the sort
    before = F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")
    starts = F.broadcast(sizes.select("_part", before.alias("_before")))
    return dealt.join(starts, "_part").withColumn(out, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_at", "_before")


def average_rank(by: str, *keys: str) -> Column:
    """Rank among the rows of the keys, with ties averaged."""
    w = Window.partitionBy(*keys)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, by))
    return F.rank().over(w.orderBy(by)) + (ties - 1) / 2.0


#: Coefficients of Acklam's rational approximation of the normal quantile: middle and tails, above and below. Fixed values.
PROBIT = (
    (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
    (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0),
    (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00),
    (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0),
)
PROBIT_TAIL = 0.02425


def probit(p: Column) -> Column:
    """The standard normal quantile, by Acklam's rational approximation (relative error below 1.2e-9)."""

    def poly(k: tuple[float, ...], x: Column) -> Column:
        out = F.lit(k[0])
        for v in k[1:]:
            out = out * x + v
        return out

    a, b, c, d = PROBIT
    low, high = F.sqrt(-2 * F.log(p)), F.sqrt(-2 * F.log(1 - p))
    q = p - 0.5
    middle = poly(a, q * q) * q / poly(b, q * q)
    return F.when((p <= 0) | (p >= 1), None).when(p < PROBIT_TAIL, poly(c, low) / poly(d, low)).when(p > 1 - PROBIT_TAIL, -poly(c, high) / poly(d, high)).otherwise(middle)


def normal_cdf(z: Column) -> Column:
    """Phi(z), by the series of Abramowitz and Stegun 26.2.17 (error below 7.5e-8)."""
    # Fixed values.
    k = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * (t * (k[0] + t * (k[1] + t * (k[2] + t * (k[3] + t * k[4])))))
    return F.when(z >= 0, 1 - tail).otherwise(tail)
