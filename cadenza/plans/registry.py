"""Registration of queries: a DataFrame function, the same in SQL, and the columns that both return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Common table expressions by name, in order of dependence; a query names the last ones that it needs.
FRAGMENTS: dict[str, str] = {}

#: Columns of dates, returned as text (YYYY-MM-DD) on both sides.
DATES = {"date", "cutoff", "cutoff_b", "ds", "fold", "first_date", "last_date", "start", "day"}


def _needed(names: list[str]) -> list[str]:
    """The named fragments and those that they mention, in order of definition."""
    found, stack = set(), list(names)
    while stack:
        n = stack.pop()
        if n not in found:
            found.add(n)
            words = set(FRAGMENTS[n].replace("(", " ").replace(")", " ").replace(",", " ").split())
            stack += [m for m in FRAGMENTS if m in words and m != n]
    return [n for n in FRAGMENTS if n in found]


def _column(spec: str) -> tuple[str, str]:
    name, _, kind = spec.partition(":")
    return name, kind


def rounded(number: Column, digits: int) -> Column:
    """The number rounded as the SQL's ``round`` does it: scaled, to the next whole number with halves away from zero, and back.

    Spark's own goes by the decimal text instead, so a mean one bit off a half, as of 8 or 16 amounts of cents, came out one digit apart."""
    x, scale = number.cast("double"), 10.0**digits
    return F.when(F.abs(x * scale) < float("inf"), F.round(x * scale) / scale).otherwise(x)


def query(columns: str, sql: str | None = None, uses: str = "") -> Callable:
    """Registers a query. A column is a name, ``name:i`` for a whole number, or ``name:d`` rounded to d digits.

    Floating sums depend on their order in the last bits, so both sides round, and by the same arithmetic (``rounded``)."""
    specs = [_column(c) for c in columns.split()]

    def wrap(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            return out.select(*(F.col(n).cast("long").alias(n) if k == "i" else rounded(F.col(n), int(k)).alias(n) if k else F.col(n).cast("string").alias(n) if n in DATES else F.col(n) for n, k in specs))

        QUERIES[f.__name__] = run
        if sql:
            parts = [f"{n} AS ({FRAGMENTS[n].strip()})" for n in _needed(uses.split())]
            shown = ", ".join(f"CAST({n} AS BIGINT) AS {n}" if k == "i" else f"round(CAST({n} AS DOUBLE), {k}) AS {n}" if k else f"CAST({n} AS VARCHAR) AS {n}" if n in DATES else n for n, k in specs)
            SQL[f.__name__] = f"WITH {', '.join([*parts, f'result_ AS ({sql.strip()})'])} SELECT {shown} FROM result_"
        return run

    return wrap
