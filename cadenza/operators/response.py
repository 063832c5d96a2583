"""The response of a producer to its allocated injection, with a given time constant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recursion(rows: DataFrame, tau: float, value: str = "alloc", key: str = "key") -> DataFrame:
    """(key, date, q): the recursion with a given time constant, as a fold over each key's months, from q = 0."""
    months = F.sort_array(F.collect_list(F.struct("date", F.day(F.last_day("date")).alias("days"), F.coalesce(value, F.lit(0.0)).alias("i"))))

    def add(state: Column, m: Column) -> Column:
        last = F.coalesce(F.try_element_at(state, F.lit(-1))["q"], F.lit(0.0))
        a = F.exp(-m["days"] / F.lit(tau))
        return F.concat(state, F.array(F.struct(m["date"].alias("date"), (last * a + (1 - a) * m["i"]).alias("q"))))

    folded = rows.groupBy(key).agg(F.aggregate(months, F.expr("cast(array() as array<struct<date: date, q: double>>)"), add).alias("s"))
    return folded.select(key, F.explode("s").alias("s")).select(key, "s.date", "s.q")
