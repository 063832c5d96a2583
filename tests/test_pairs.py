import collections
import datetime
import math

import numpy as np
import pytest

from cadenza.operators import pairs


@pytest.mark.parametrize(("block", "part"), [(256, 4096), (3, 5), (1, 1)])
def test_pairs_with_gaps_nulls_and_constants(spark, block, part):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(11):
        for m in range(30):
            if rng.random() < 0.7 and not (k == 9 and m >= 15) and not (k == 10 and m < 15):
                v = 5.0 if k == 3 else 1e6 + k + float(rng.normal())
                rows.append((f"k{k}", datetime.date(2000 + m // 12, 1 + m % 12, 1), None if rng.random() < 0.1 else v))
    df = spark.createDataFrame(rows, "key string, date date, v double")
    by = collections.defaultdict(dict)
    for k, d, v in rows:
        by[k][d] = v
    got = {(r.a, r.b): (r.n, r.r) for r in pairs.pair_correlations(df, "v", block=block, part=part).collect()}
    want = {}
    for a in sorted(by):
        for b in sorted(by):
            common = by[a].keys() & by[b].keys()
            if a < b and common:
                x, y = np.array([(by[a][d], by[b][d]) for d in common if by[a][d] is not None and by[b][d] is not None]).reshape(-1, 2).T
                want[a, b] = len(common), float(np.corrcoef(x, y)[0, 1]) if len(x) > 1 and x.std() > 1e-9 and y.std() > 1e-9 else None
    assert got.keys() == want.keys() and ("k10", "k9") not in want
    for p, (n, r) in want.items():
        assert got[p][0] == n and (got[p][1] is None) == (r is None), p
        assert r is None or math.isclose(got[p][1], r, abs_tol=1e-8), p


def test_values_are_sent_once_for_each_block(spark):
    """The rows that are shuffled to the products are values times blocks, of 100 keys 5, not values times keys."""
    df = spark.range(100 * 20).selectExpr("concat('k', id % 100) AS key", "add_months(date'2000-01-01', cast(id / 100 AS int)) AS date", "rand(3) AS v")
    made = pairs.pair_correlations(df, "v", block=20)
    assert made.count() == 100 * 99 / 2
    assert "Range (0" in made._jdf.queryExecution().executedPlan().toString() and pairs.pair_correlations(df.limit(0), "v").count() == 0
