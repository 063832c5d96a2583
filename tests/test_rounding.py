"""Rounded columns are the SQL's to the last digit, also one bit off a half."""

import datetime
import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from cadenza.plans import registry


def near_halves(digits, count=400):
    """Doubles on and one bit beside a half of the last digit kept, of both signs, and what has no half."""
    halves = [(2 * k + 1) / (2 * 10.0**digits) for k in range(7, 7 + 6007 * count, 6007)]
    near = [x for h in halves for x in (h, math.nextafter(h, 0), math.nextafter(h, math.inf))]
    return [*near, *(-x for x in near), 0.0, -0.0, 1e16, 1e305, -1e305, 5e-324, math.inf, -math.inf, math.nan, None]


@pytest.mark.parametrize("digits", [2, 4, 6, 8])
def test_rounded_is_the_sql_s_round(spark, digits):
    values = near_halves(digits)
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    found = [r.y for r in rows.select("i", registry.rounded(rows.x, digits).alias("y")).orderBy("i").collect()]
    con = duckdb.connect()
    want = [con.execute(f"SELECT round(CAST(? AS DOUBLE), {digits})", [x]).fetchone()[0] for x in values]
    assert [(x, repr(a)) for x, a, b in zip(values, found, want, strict=True) if a != b and not (a != a and b != b)] == []


def test_prefix_state_is_its_sql_to_the_last_digit(spark, tmp_path):
    """One event a user, so that a mean is the value itself and no sum's order matters; the last event closes their day."""
    start = datetime.datetime(2024, 1, 1, 6)
    halves = [20 + k / 1e3 + 5e-5 for k in range(0, 180_000, 450)]
    events = [(start, k, math.nextafter(h, (0, math.inf)[k % 2])) for k, h in enumerate(halves)]
    events.append((start + datetime.timedelta(days=9), -1, 1.0))
    pd.DataFrame(events, columns=["ts", "user_id", "value"]).astype({"ts": "datetime64[us]"}).to_parquet(f"{tmp_path}/events.parquet")
    made = __spark_entry__.queries()["events_prefix_state"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()["events_prefix_state"]).fetchall()
    found = [(r.user_id, r.day, r.n, r.mean, r.since, r.jump, r.frozen) for r in made.collect()]
    assert len(found) == 2 * len(halves)
    assert sorted(found) == sorted((u, str(d), *rest) for u, d, *rest in want)
