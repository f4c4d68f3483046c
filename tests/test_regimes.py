"""Smoothed regimes against forward-backward in one sweep."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from gristmill.operators import regimes as G

STATES = G.States(("rv", "moved"), np.array([[0.1, 1.0], [0.3, 2.0], [0.6, 4.0]]), np.array([np.diag([0.01, 0.3]), np.diag([0.02, 0.4]), np.diag([0.03, 0.9])]), np.array([0.5, 0.3, 0.2]), np.array([[0.9, 0.08, 0.02], [0.05, 0.9, 0.05], [0.01, 0.09, 0.9]]), -100.0, 50)


def features(spark, n=70):
    rnd = np.random.default_rng(1)
    rows = []
    for s, m in (("a", n), ("b", 1), ("c", 13)):
        state = 0
        for i in range(m):
            state = int(rnd.choice(3, p=STATES.moves[state]))
            rv, moved = rnd.multivariate_normal(STATES.means[state], STATES.covariances[state])
            rows.append((s, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(rv), float(moved)))
    return rows, spark.createDataFrame([*rows, ("d", dt.date(2020, 1, 1), None, 1.0)], "symbol string, d date, rv double, moved double")


def one_sweep(x: np.ndarray) -> np.ndarray:
    """The textbook recursion, densities as they are."""
    k = len(STATES.means)
    dens = np.array([[np.exp(-0.5 * (r - m) @ np.linalg.inv(c) @ (r - m)) / np.sqrt((2 * np.pi) ** 2 * np.linalg.det(c)) for m, c in zip(STATES.means, STATES.covariances, strict=True)] for r in x])
    alpha, beta = np.empty((len(x), k)), np.empty((len(x), k))
    alpha[0] = STATES.start * dens[0]
    for t in range(1, len(x)):
        alpha[t] = [dens[t, j] * sum(alpha[t - 1, i] * STATES.moves[i, j] for i in range(k)) for j in range(k)]
        alpha[t] /= alpha[t].sum()
    beta[-1] = 1
    for t in range(len(x) - 2, -1, -1):
        beta[t] = [sum(STATES.moves[i, j] * dens[t + 1, j] * beta[t + 1, j] for j in range(k)) for i in range(k)]
        beta[t] /= beta[t].sum()
    p = alpha * beta
    return p / p.sum(1, keepdims=True)


@pytest.mark.parametrize("block", [1, 7, 256])
def test_blocks_give_what_one_sweep_gives(spark, block):
    rows, df = features(spark)
    got = {}
    for r in G.smoothed(df, STATES, block).orderBy("symbol", "d").collect():
        got.setdefault(r.symbol, []).append(r)
    assert set(got) == {"a", "b", "c"}
    for s, found in got.items():
        want = one_sweep(np.array([(rv, moved) for key, _, rv, moved in rows if key == s]))
        np.testing.assert_allclose([r.probabilities for r in found], want, atol=1e-9)
        assert [r.state for r in found] == want.argmax(1).tolist()
        run = 0
        for i, r in enumerate(found):
            run = run + 1 if i and found[i - 1].state == r.state else 1
            assert r.duration == run


def test_fitted_states_are_ordered_and_measured(spark):
    _, df = features(spark, 400)
    two, three = (G.fit_states(df, ("rv", "moved"), k) for k in (2, 3))
    assert (np.diff(three.means[:, 0]) > 0).all() and np.allclose(three.moves.sum(1), 1) and np.isclose(three.start.sum(), 1)
    assert three.n == 414 and three.parameters == 6 + 6 + 9 and three.aic == 2 * 21 - 2 * three.log_likelihood
    assert three.bic == 21 * np.log(414) - 2 * three.log_likelihood
    assert three.log_likelihood > two.log_likelihood and min(three.moves[0, 0], three.moves[2, 2]) > 0.5
    now = {r.symbol: r for r in G.regimes_now(G.smoothed(df, three)).collect()}
    assert set(now) == {"a", "b", "c"} and all(r.regime in G.NAMES and 1 / 3 <= r.confidence <= 1 for r in now.values())
    assert all(abs(r.p_low_vol + r.p_mid_vol + r.p_high_vol - 1) < 1e-5 for r in now.values())
    x = np.array([(r.rv, r.moved) for r in df.dropna().collect()])
    dens, top = G.densities(x, three.means, three.covariances)
    assert three.log_likelihood > np.log(dens.max(1) / 3).sum() + top.sum() - 414


def test_no_rows(spark):
    _, df = features(spark)
    assert G.smoothed(df.limit(0), STATES).count() == 0
