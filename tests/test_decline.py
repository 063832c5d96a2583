"""Declines by the fold against a bounded least-squares solver, and windows of each series' own."""

from datetime import date

import numpy as np
import pytest

from cadenza.functions import solvers
from cadenza.operators import backtest, decline


def months(n, last=(2004, 12)):
    end = last[0] * 12 + last[1] - 1
    return [date((end - i) // 12, (end - i) % 12 + 1, 1) for i in range(n)][::-1]


def curve(x, t):
    return x[0] * np.exp(-np.log1p(x[2] * x[1] * t) / x[2])


def test_declines_are_recovered_and_fit_as_well_as_a_solver_s(spark):
    rng = np.random.default_rng(5)
    t = np.arange(36.0)
    shapes = {"a": (900, 0.05, 0.7), "b": (50, 0.3, 1.8), "c": (1e5, 0.002, 0.05), "d": (7, 1.0, 0.01)}
    series = {k: curve(x, t) for k, x in shapes.items()}
    series |= {f"noisy{k}": curve(x, t) * np.exp(0.2 * rng.normal(size=36)) for k, x in shapes.items()}
    series |= {"rising": np.linspace(1, 50, 36), "zero": np.zeros(36), "short": curve(shapes["a"], t[:12]), "flat": np.full(36, 4.0)}
    rows = [(k, d, float(v)) for k, y in series.items() for d, v in zip(months(len(y)), y)] + [("a", date(1990, 1, 1), None)]
    df = spark.createDataFrame(rows, "key string, date date, v double")
    made = decline.arps(df, [date(2004, 12, 1)], "v")
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString()
    got = {k: np.array([r.y_pred for r in sorted(made.where(f"key = '{k}'").collect(), key=lambda r: r.step)]) for k in series}
    for k, x in shapes.items():
        assert got[k] == pytest.approx(curve(x, np.arange(36.0, 42.0)), rel=0.01), k
    assert got["short"] == pytest.approx(curve(shapes["a"], np.arange(12.0, 18.0)), rel=0.02)
    assert np.allclose(got["flat"], 4, rtol=1e-3) and np.all(got["zero"] < 1e-5)
    from pyspark.sql import functions as F

    fits = {r.key: r.f for r in df.where("v is not null").groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("date", F.greatest("v", F.lit(1e-6)).alias("v")))), lambda x: x["v"]).alias("vs")).select("key", decline.fit(F.col("vs")).alias("f")).collect()}
    for k, y in series.items():
        y, u = np.maximum(y, 1e-6), np.arange(float(len(y)))
        x = solvers.bounded_lsq(lambda x: curve(x, u) - y, np.array([y[0], 0.02, 0.5]), np.array([1e-6, 1e-5, 0.01]), np.array([10 * y.max(), 1.0, 2.0]), evals=2000)
        own = ((curve((fits[k].level, np.exp(fits[k].log_d), fits[k].b), u) - y) ** 2).sum()
        assert own <= ((curve(x, u) - y) ** 2).sum() * 1.001 + 1e-6 * (y * y).sum(), k


def test_windows_of_series_that_end_in_different_months(spark):
    ends = {"a": (2004, 12), "b": (2003, 5), "c": (2004, 2)}
    rows = [(k, d, float(i + 1)) for k, e in ends.items() for i, d in enumerate(months(30, e))]
    df = spark.createDataFrame(rows, "key string, date date, v double")
    own = {r.key: r.cutoffs for r in backtest.own_cutoffs(df, windows=3, step=2).collect()}
    assert own["b"] == [date(2002, 11, 1), date(2002, 9, 1), date(2002, 7, 1)] and own["c"][0] == date(2003, 8, 1)
    made = backtest.exponential(df, backtest.own_cutoffs(df, windows=3, step=2), "v", k=24).collect()
    assert {(r.key, r.cutoff) for r in made} == {(k, c) for k, cs in own.items() for c in cs} and len(made) == 54
    for r in made:
        y = np.array([v for k, d, v in rows if k == r.key and d <= r.cutoff])[-24:]
        slope, level = np.polyfit(np.arange(len(y)), np.log(y), 1)
        assert r.y_pred == pytest.approx(np.exp(level + slope * (len(y) - 1 + r.step)))
