from datetime import date

import numpy as np
import pandas as pd
import pytest

from cadenza.functions.calendar import HORIZON
from cadenza.operators import learning

CUTOFFS = [date(2002, 6, 1), date(2002, 12, 1)]


def panel(spark, after=0.0):
    """Three series of 48 months; ``after`` is added to all that the first cutoff can't know."""
    months = pd.date_range("2000-01-01", periods=48, freq="MS")
    rows = [(k, m.date(), 50.0 + 10 * i + 5 * (t % 12) + (after if m.date() > CUTOFFS[0] else 0.0)) for i, k in enumerate("abc") for t, m in enumerate(months)]
    return spark.createDataFrame(rows, "key string, date date, y0 double")


@pytest.fixture
def few(monkeypatch):
    monkeypatch.setattr(learning, "forecaster", lambda: learning._trees(0, 4, 0.5, 3))
    monkeypatch.setattr(learning, "stacker", lambda: learning._trees(42, 4, 0.5, 3, "absolute"))


def test_each_cutoff_has_its_model_and_every_step(spark, few):
    p = panel(spark)
    models = learning.train(p, "y0", CUTOFFS)
    assert list(models) == CUTOFFS and all(m.getNumTrees == 4 for m in models.values())
    found = learning.backtest(p, "y0", models).toPandas()
    assert found.groupby(["cutoff", "key"])["step"].apply(sorted).map(lambda s: s == list(range(1, HORIZON + 1))).all()
    assert len(found) == len(CUTOFFS) * 3 * HORIZON and (found["y_pred"] >= 0).all()


def test_a_model_knows_nothing_after_its_cutoff(spark, few):
    a, b = (learning.backtest(p, "y0", learning.train(p, "y0", CUTOFFS)).toPandas() for p in (panel(spark), panel(spark, 1000.0)))
    a, b = (x.sort_values(["cutoff", "key", "step"]).reset_index(drop=True) for x in (a, b))
    first = a["cutoff"] == CUTOFFS[0]
    assert (a.loc[first, "y_pred"] - b.loc[first, "y_pred"]).abs().max() < 1e-9
    assert (a.loc[~first, "y_pred"] - b.loc[~first, "y_pred"]).abs().max() > 1.0


def test_columns_known_ahead_reach_the_horizon(spark, few):
    """A series that is ten times its driver: the forecast follows the driver's months after the cutoff, and knows a missing one."""
    months = pd.date_range("2000-01-01", periods=48, freq="MS")
    level = {k: np.random.default_rng(i).integers(0, 4, 48).astype(float) for i, k in enumerate("abcdefgh")}
    rows = [(k, m.date(), 10 * float(x), float(x) if m != months[40] else None) for k in level for m, x in zip(months, level[k], strict=True)]
    p = spark.createDataFrame(rows, "key string, date date, y0 double, driver double")
    models = learning.train(p, "y0", CUTOFFS, ["driver"])
    found = learning.backtest(p, "y0", models, ["driver"]).toPandas()
    at = found[found["cutoff"] == CUTOFFS[0]].sort_values(["key", "step"])
    truth = [10 * level[k][29 + s] for k, s in zip(at["key"], at["step"], strict=True)]
    assert len(at) == 8 * HORIZON and (at["y_pred"] - truth).abs().max() < 8
    share = dict(learning.importance(models[CUTOFFS[0]], [*learning.FEATURES, "driver"]))
    assert share["driver"] > 0.5
    assert len(found) == 2 * 8 * HORIZON and found["y_pred"].notna().all()


def test_importances_are_shares_by_size(spark, few):
    shares = [s for _, s in learning.importance(learning.train(panel(spark), "y0", CUTOFFS[-1:])[CUTOFFS[-1]])]
    assert abs(sum(shares) - 1) < 1e-9 and shares == sorted(shares, reverse=True)


def test_stacking_leaves_the_predicted_cutoff_out(spark, few):
    """Where one cutoff's truth is ten times that of the others, its forecasts stay at the others' level."""
    cutoffs = [date(2002, m, 1) for m in (1, 2, 3)]
    rows = [(c, f"k{k}", s, c, float(100 + k), float(100 + k), (1000.0 if c == cutoffs[0] else 100.0) + k) for c in cutoffs for k in range(30) for s in (1, 2)]
    matrix = spark.createDataFrame(rows, "cutoff date, key string, step int, date date, m1 double, m2 double, y_true double")
    features = spark.createDataFrame([(c, f"k{k}", 0.5, 12.0, 1.0) for c in cutoffs for k in range(30)], "cutoff date, key string, wct_last double, age_m double, block_code double")
    found = learning.meta(matrix, ["m1", "m2"], features, cutoffs).toPandas()
    assert len(found) == len(rows)
    assert found.loc[found["cutoff"] == cutoffs[0], "y_pred"].max() < 200
