"""Dominance counts, the jumper's prefix scan and order statistics, against plain Python and numpy."""

import datetime
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions.stats import places, quantiles
from cadenza.operators import exchange


def brute(rows, rate=0.01):
    """model -> (n, log10 of the greatest and of the last capital)."""
    made = {}
    for model in {r[0] for r in rows}:
        own = []
        for _, cutoff, key, step, resid in (r for r in rows if r[0] == model and r[4] is not None):
            own.append((cutoff, hashlib.md5(f"{key}|{step}|{cutoff}".encode()).hexdigest(), key, step, round(abs(resid), 6)))
        seen, capital, logs, scale = [], [1 / 3] * 3, [], 0.0
        for _, h, _, _, a in sorted(own):
            u = int(h[:8], 16) / 4294967296
            p = (sum(x > a for x in seen) + u * (sum(x == a for x in seen) + 1)) / (len(seen) + 1)
            seen.append(a)
            total = sum(capital)
            capital = [((1 - rate) * c + rate * total / 3) * (1 + e * (p - 0.5)) for c, e in zip(capital, (-1, 0, 1))]
            total = sum(capital)
            scale += math.log10(total)
            capital = [c / total for c in capital]
            logs.append(scale)
        if own:
            made[model] = len(own), max(logs), logs[-1]
    return made


@pytest.mark.parametrize(("chunk", "drift"), [(4, 0.0), (512, 1.0)])
def test_martingale_of_rows_most_of_which_are_one_model(spark, chunk, drift):
    rng = np.random.default_rng(3)
    rows = []
    for model, n in (("most", 900), ("few", 30), ("one", 1), ("ties", 60)):
        for i in range(n):
            v = 1.0 if model == "ties" else float(rng.choice([rng.normal(), 0.5])) * (1 + drift * i / n)
            rows.append((model, datetime.date(2000, 1 + i * 12 // n, 1), f"k{i % 7}", i, None if i % 50 == 49 else v))
    df = spark.createDataFrame(rows, "model string, cutoff date, key string, step int, resid double").repartition(6)
    got = {r.model: (r.n, r.log10_max, r.log10_last) for r in exchange.exchangeability(df, "model", chunk=chunk).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for m, (n, high, last) in want.items():
        assert got[m][0] == n and got[m][1:] == pytest.approx((high, last), abs=1e-9), m
    assert exchange.exchangeability(df.limit(0), "model").count() == 0


@pytest.mark.parametrize(("leaf", "span"), [(0, 2), (2, 3), (6, 16)])
def test_dominance_counts(spark, leaf, span):
    rng = np.random.default_rng(1)
    rows, want = [], set()
    for group, n in (("a", 300), ("b", 1), ("c", 17)):
        v = rng.permutation(n)
        rows += [(group, t, int(v[t])) for t in range(n)]
        want |= {(group, t, int((v[:t] > v[t]).sum())) for t in range(n)}
    df = spark.createDataFrame(rows, "g string, t long, v long").repartition(5)
    got = exchange.larger_before(df, "g", 300, leaf, span)
    assert {tuple(r) for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_places_over_partitions(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("a"), F.xxhash64("id").alias("b")).repartition(13)
    got = places(df, "a", "b", out="at").orderBy("at").collect()
    assert [r["at"] for r in got] == list(range(5000))
    assert [(r.a, r.b) for r in got] == sorted((r.a, r.b) for r in got)


def test_quantiles_with_most_rows_in_one_group(spark):
    rng = np.random.default_rng(2)
    parts = {"hot": np.concatenate([rng.lognormal(0, 3, 30_000), np.full(9000, 1.5)]), "small": rng.normal(size=40), "two": np.array([3.0, 1.0]), "one": np.array([7.0]), "same": np.full(4000, -2.0), "signs": rng.normal(size=5000) * 10.0 ** rng.integers(-30, 30, 5000)}
    rows = [(k, float(x)) for k, v in parts.items() for x in v] + [("hot", None), ("none", None), ("hot", float("nan"))]
    df = spark.createDataFrame(rows, "k string, x double").repartition(8)
    shares = [0.0, 0.1, 0.5, 0.77, 0.9, 1.0]
    for small in (1000, 100, 1_000_000):
        got = {r.k: r for r in quantiles(df, ["k"], "x", shares, small=small).collect()}
        assert got.keys() == parts.keys()
        for k, v in parts.items():
            assert got[k].n == len(v) and list(got[k].q) == pytest.approx(np.quantile(v, shares).tolist(), rel=1e-12), (small, k)
    all_ = quantiles(df, [], "x", shares, small=500).collect()
    assert list(all_[0].q) == pytest.approx(np.quantile(np.concatenate(list(parts.values())), shares).tolist(), rel=1e-12)
    assert quantiles(df.limit(0), ["k"], "x", shares).count() == 0
