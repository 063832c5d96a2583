"""Month arithmetic as column expressions, and the calendar tables of a rolling-origin backtest."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HORIZON = 6


def month(at: Column | str) -> Column:
    """The first of the month; month-end calendars and timestamps land on the same key."""
    return F.trunc(at, "MM")


def days_in_month(at: Column | str) -> Column:
    return F.day(F.last_day(at))


def month_number(at: Column | str) -> Column:
    return F.year(at) * 12 + F.month(at)


def month_distance(a: Column | str, b: Column | str) -> Column:
    return F.abs(month_number(a) - month_number(b))


def cutoff_table(spark: SparkSession, cutoffs: list[date]) -> DataFrame:
    """One row per cutoff: a parameter, a handful of rows."""
    return spark.createDataFrame([(c,) for c in cutoffs], "cutoff date")


def every(spark: SparkSession, first: date, last: date, step: int) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last), F.expr(f"interval {step} month"))).alias("cutoff"))


def expand_horizon(df: DataFrame, horizon: int = HORIZON, cutoff: str = "cutoff") -> DataFrame:
    """Rows of ``df`` for each step 1 .. horizon, with the month forecast; replaces a range join by equality."""
    return df.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("date", F.add_months(cutoff, F.col("step")))


def time_axis(df: DataFrame, key: str = "key", at: str = "date") -> DataFrame:
    """Days since each key's first month, counting that month's days."""
    from pyspark.sql import Window

    first = F.min(at).over(Window.partitionBy(key))
    return df.withColumn("t_days", F.datediff(at, first) + days_in_month(first))
