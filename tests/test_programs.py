"""Programs with inequalities, corners and ratios against optimality conditions, other solvers and brute force."""

import itertools

import numpy as np
import pytest

from tidemark.functions import programs, solvers
from tidemark.operators import factors, optimize


def case(seed, n):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, n + 2))
    return rng, rng.normal(0.05, 0.1, n), a @ a.T / n


@pytest.mark.parametrize("seed", range(60))
def test_programs_meet_the_optimality_conditions(seed):
    n = 2 + seed % 9
    rng, mu, sigma = case(seed, n)
    below = rng.normal(size=(seed % 7, n)), rng.normal(0.3, 0.4, seed % 7)
    equal = (np.ones((1, n)), np.ones(1)) if seed % 3 else (np.vstack([np.ones(n), np.ones(n) * 2, mu]), np.array([1.0, 2.0, mu.mean()]))
    low, high = np.full(n, 0.0 if seed % 2 else -np.inf), np.full(n, 0.6 if seed % 4 else np.inf)
    got = programs.program(sigma, -mu, equal, below, low, high)
    if got.x is not None:
        assert programs.residual(got, sigma, -mu, equal, below, low, high) < 1e-7
        return
    # no point: the multipliers combine the limits to 0 <= a number below zero
    finite = lambda x: np.where(np.isfinite(x), x, 0.0)
    row = equal[0].T @ got.equal + below[0].T @ got.below - got.low + got.high
    row_alt = -equal[0].T @ got.equal + below[0].T @ got.below - got.low + got.high
    sign = 1 if np.abs(row).max() < np.abs(row_alt).max() else -1
    value = sign * equal[1] @ got.equal + below[1] @ got.below - finite(low) @ got.low + finite(high) @ got.high
    assert min(np.abs(row).max(), np.abs(row_alt).max()) < 1e-7 and value < -1e-9
    assert min(got.below.min(initial=0), got.low.min(), got.high.min()) >= 0


def test_both_outcomes_occur():
    seen = set()
    for seed in range(60):
        n = 2 + seed % 9
        rng, mu, sigma = case(seed, n)
        below = rng.normal(size=(seed % 7, n)), rng.normal(0.3, 0.4, seed % 7)
        seen.add(programs.program(sigma, -mu, (np.ones((1, n)), np.ones(1)), below, np.zeros(n), np.ones(n)).x is None)
    assert seen == {True, False}


@pytest.mark.parametrize("seed", range(10))
def test_without_inequalities_the_active_set_method_agrees(seed):
    _, mu, sigma = case(seed, 6)
    low, high = np.full(6, 0.02), np.full(6, 0.5)
    got = programs.program(sigma, -0.3 * mu, (np.ones((1, 6)), np.ones(1)), None, low, high).x
    assert got == pytest.approx(solvers.quadratic(sigma, -0.3 * mu, np.ones((1, 6)), np.ones(1), low, high), abs=1e-8)
    assert programs.linear(-mu, (np.ones((1, 6)), np.ones(1)), None, low, high) == pytest.approx(solvers.linear_max(mu, 0.02, 0.5), abs=1e-6)


@pytest.mark.parametrize("seed", range(20))
def test_frontier_between_corners(seed):
    n = 3 + seed % 6
    _, mu, sigma = case(seed, n)
    low, high = ((0.0, 1.0), (0.05, 0.4), (0.0, 0.35))[seed % 3]
    found = programs.corners(mu, sigma, *solvers.box(n, low, high))
    if n * high < 1:
        assert found == []
        return
    prices = [c.price for c in found]
    assert prices == sorted(prices, reverse=True) and prices[-1] == 0
    assert found[0].weights @ mu == pytest.approx(solvers.linear_max(mu, low, high) @ mu, abs=1e-6)
    assert found[-1].weights == pytest.approx(solvers.min_variance(sigma, low, high), abs=1e-8)
    for target in np.linspace(found[-1].weights @ mu, found[0].weights @ mu, 9)[1:-1]:
        want = solvers.min_variance(sigma, low, high, (mu[None, :], np.array([target])))
        assert programs.at_mean(found, mu, target) == pytest.approx(want, abs=1e-7)
    assert programs.at_mean(found, mu, found[0].weights @ mu + 0.1) is None
    for c in found:  # a corner is optimal for its own price of mean
        gap = sigma @ c.weights - c.price * mu
        cheapest = np.full(n, low)
        for i in np.argsort(gap):
            cheapest[i] += min(high - low, 1 - cheapest.sum())
        assert gap @ c.weights <= gap @ cheapest + 1e-8


def test_corners_of_equal_means_and_one_asset():
    sigma = np.diag([1.0, 2.0, 3.0])
    found = programs.corners(np.full(3, 0.1), sigma, np.zeros(3), np.ones(3))
    assert found[-1].weights == pytest.approx(np.array([6, 3, 2]) / 11)
    assert programs.corners(np.array([0.1]), np.eye(1), np.zeros(1), np.ones(1))[-1].weights == pytest.approx([1.0])


@pytest.mark.parametrize("seed", range(12))
def test_ratio_with_limits(seed):
    rng, mu, sigma = case(seed, 5)
    mu[0] = abs(mu[0]) + 0.1
    limits = optimize.Limits([({"a": 1.0, "b": 1.0}, 0.4), ({"c": -1.0}, -0.1)], ({k: 0.2 for k in "abcde"}, 0.8), {"e": (0.0, 0.3)})
    w = optimize.within(list("abcde"), mu, sigma, "sharpe", limits, rf=0.0)
    fits = lambda x: x[:, :2].sum(1) <= 0.4 + 1e-9, lambda x: (x[:, 2] >= 0.1 - 1e-9) & (x[:, 4] <= 0.3 + 1e-9) & (np.abs(x - 0.2).sum(1) <= 0.8 + 1e-9)
    assert w.sum() == pytest.approx(1) and all(f(w[None, :])[0] for f in fits) and w.min() > -1e-9
    others = rng.dirichlet(np.ones(5), 40000)
    others = 0.3 * others + 0.7 * w  # near it, where most fit
    others = others[fits[0](others) & fits[1](others)]
    ratio = lambda x: x @ mu / np.sqrt(np.einsum("ij,jk,ik->i", x, sigma, x))
    assert len(others) > 10 and ratio(w[None, :])[0] >= ratio(others).max() - 1e-9


def test_turnover_is_kept_and_used():
    _, mu, sigma = case(3, 6)
    names = list("abcdef")
    held = dict.fromkeys(names, 1 / 6)
    for most in (0.0, 0.1, 0.5, 2.0):
        w = optimize.within(names, mu, sigma, "min_variance", optimize.Limits(turnover=(held, most)))
        moved = np.abs(w - 1 / 6).sum()
        free = solvers.min_variance(sigma)
        assert moved == pytest.approx(min(most, np.abs(free - 1 / 6).sum()), abs=1e-7)
    assert optimize.within(names, mu, sigma, "max_return", optimize.Limits([({"a": 1.0}, -0.1)])) is None


@pytest.mark.parametrize("seed", range(15))
def test_best_vertex_where_no_asset_beats_cash(seed):
    _, mu, sigma = case(seed, 5)
    mu = -np.abs(mu) - 0.01
    low, high = ((0.0, 1.0), (0.05, 0.4), (0.1, 0.3))[seed % 3]
    w, value, bound = programs.best_vertex(mu, sigma, 0.02, *solvers.box(5, low, high))
    vertices = []
    for i in range(5):
        for rest in itertools.product((low, high), repeat=4):
            last = 1 - sum(rest)
            if low - 1e-12 <= last <= high + 1e-12:
                vertices.append(np.insert(np.array(rest), i, last))
    best = max((v @ mu - 0.02) / np.sqrt(v @ sigma @ v) for v in vertices)
    assert value == pytest.approx(best, rel=1e-9) and bound == pytest.approx(best, rel=1e-9)
    assert (w @ mu - 0.02) / np.sqrt(w @ sigma @ w) == pytest.approx(best, rel=1e-9)


def test_factor_portfolio_within_limits(spark):
    names = list("abcde")
    _, mu, sigma = case(1, 5)
    model = factors.Exposures(names, ["const"], mu[:, None] / 252, np.ones(1), np.zeros((1, 1)), np.diag(sigma) / 252)
    frame = spark.createDataFrame([("a",)], "asset string")
    limits = optimize.Limits([({"a": 1.0, "b": 1.0}, 0.25)], bounds={"c": (0.0, 0.2)})
    got = {r["asset"]: r["weight"] for r in factors.optimise(frame, model, "min_variance", limits=limits, low=0.01, high=0.6).collect()}
    assert got["a"] + got["b"] <= 0.25 + 1e-9 and got["c"] <= 0.2 + 1e-9 and sum(got.values()) == pytest.approx(1)
    assert factors.optimise(frame, model, "utility", limits=optimize.Limits([(dict.fromkeys(names, 1.0), 0.5)])).count() == 0
