import numpy as np

from cadenza.functions.solvers import bounded_lsq


def test_a_fit_of_many_parameters_converges_within_its_evaluations():
    """25 gains and 25 time constants, as a field has: a column of the Jacobian is no evaluation."""
    rng = np.random.default_rng(3)
    n, months = 25, 200
    t = np.arange(months)
    signals = rng.uniform(0.5, 1.5, (months, n))

    def curve(x):
        return (signals * np.exp(-t[:, None] / 10 ** x[n:] / 40)) @ x[:n]

    truth = np.concatenate([rng.uniform(0.2, 0.8, n), rng.uniform(0.5, 1.0, n)])
    y = curve(truth)
    taken = []

    def residuals(x):
        taken.append(0)
        return curve(x) - y

    start = np.concatenate([np.full(n, 0.5), np.full(n, 0.8)])
    found = bounded_lsq(residuals, start, np.zeros(2 * n), np.full(2 * n, 4.0), evals=60)
    left, at_start = np.abs(curve(found) - y).max(), np.abs(curve(start) - y).max()
    assert left < 1e-3 * at_start
    assert len(taken) <= 60 * (2 * n + 1)
