"""Small programs against optimality conditions and brute force, and regressions and tests against plain renderings."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from tidemark.functions import solvers
from tidemark.operators import backtest, black_litterman, factors, optimize, simulate, stationarity, validation

SIGMA = np.array([[4, 2, 1, 0], [2, 5, 0, 1], [1, 0, 6, -1], [0, 1, -1, 8]]) * 1e-4
MU = np.array([5, 4, 6, 8]) * 1e-4


def random_case(seed, n):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, n + 2))
    return rng.normal(0.05, 0.1, n), a @ a.T / n


def brute_min_variance(sigma, low, high, rows=None, values=None):
    """The best point over all choices of which weights stand at a bound."""
    n = len(sigma)
    a = np.ones((1, n)) if rows is None else np.vstack([np.ones(n), rows])
    b = np.ones(1) if rows is None else np.append(1.0, values)
    best = None
    for where in itertools.product((-1, 0, 1), repeat=n):
        free = [i for i in range(n) if where[i] == 0]
        x = np.array([low if k == -1 else high if k == 1 else 0.0 for k in where])
        if free:
            kkt = np.block([[sigma[np.ix_(free, free)], a[:, free].T], [a[:, free], np.zeros((len(a), len(a)))]])
            right = np.concatenate([-sigma[np.ix_(free, range(n))] @ x, b - a @ x])
            x[free] = np.linalg.lstsq(kkt, right, rcond=None)[0][: len(free)]
        if np.abs(a @ x - b).max() < 1e-8 and (x > low - 1e-8).all() and (x < high + 1e-8).all():
            value = x @ sigma @ x
            best = value if best is None else min(best, value)
    return best


@pytest.mark.parametrize("seed", range(12))
def test_min_variance_is_the_least(seed):
    mu, sigma = random_case(seed, 5)
    for low, high in ((0.0, 1.0), (0.05, 0.4)):
        w = solvers.min_variance(sigma, low, high)
        assert abs(w.sum() - 1) < 1e-8 and (w >= low - 1e-9).all() and (w <= high + 1e-9).all()
        assert w @ sigma @ w == pytest.approx(brute_min_variance(sigma, low, high), rel=1e-6)
    target = (mu.min() + mu.max()) / 2
    w = solvers.min_variance(sigma, extra=(mu[None, :], np.array([target])))
    assert w @ mu == pytest.approx(target, abs=1e-8)
    assert w @ sigma @ w == pytest.approx(brute_min_variance(sigma, 0, 1, mu[None, :], [target]), rel=1e-6)


@pytest.mark.parametrize("seed", range(8))
def test_max_sharpe_beats_random_portfolios(seed):
    mu, sigma = random_case(seed, 5)
    mu[0] = abs(mu[0]) + 0.1
    w = solvers.max_sharpe(mu, sigma, 0.01)
    own = (w @ mu - 0.01) / math.sqrt(w @ sigma @ w)
    many = np.random.default_rng(seed).dirichlet(np.full(5, 0.5), 20_000)
    others = (many @ mu - 0.01) / np.sqrt(np.einsum("ij,jk,ik->i", many, sigma, many))
    assert abs(w.sum() - 1) < 1e-8 and own >= others.max() - 1e-6


def test_infeasible_programs_have_no_weights():
    assert solvers.min_variance(np.eye(2), 0.0, 0.4) is None
    assert solvers.min_variance(SIGMA, extra=(MU[None, :], np.array([1.0]))) is None


def test_linear_max_fills_the_best_first():
    assert solvers.linear_max(np.array([1.0, 3.0, 2.0, 0.5]), 0.01, 0.4) == pytest.approx([0.19, 0.4, 0.4, 0.01], abs=1e-6)


def test_risk_parity_shares():
    w = solvers.risk_parity(SIGMA)
    assert solvers.risk_shares(w, SIGMA) == pytest.approx(np.full(4, 0.25), abs=1e-9)
    w = solvers.risk_parity(SIGMA, np.array([0.4, 0.3, 0.2, 0.1]))
    assert solvers.risk_shares(w, SIGMA) == pytest.approx([0.4, 0.3, 0.2, 0.1], abs=1e-9)


def test_posterior_of_one_view_has_its_closed_form():
    pi, p, q = np.array([0.02, 0.03, 0.01, 0.04]), np.array([1.0, -1, 0, 0]), 0.05
    view = black_litterman.View.relative("a", "b", q, 0.6)
    rows, qs, omega = black_litterman.prepared([view, black_litterman.View.absolute("unknown", 1.0, 0.5)], list("abcd"), SIGMA)
    assert len(rows) == 1
    mean, _ = black_litterman.posterior_arrays(pi, SIGMA, rows, qs, omega, 0.025)
    want = pi + 0.025 * SIGMA @ p * (q - p @ pi) / (0.025 * p @ SIGMA @ p + omega[0])
    assert mean == pytest.approx(want, abs=1e-14)


@pytest.fixture(scope="module")
def returns(spark):
    rng = np.random.default_rng(42)
    values = rng.multivariate_normal(MU, SIGMA, 300)
    dates = pd.bdate_range("2020-01-01", periods=300).date
    rows = [(d, a, float(v)) for d, row in zip(dates, values, strict=True) for a, v in zip(("AAA", "BBB", "BONDS", "GOLD"), row, strict=True)]
    return spark.createDataFrame(rows, "date date, asset string, ret double").cache()


def test_frontier_properties(returns):
    frontier = optimize.random_frontier(returns, 100).cache()  # one evaluation, as sums hang on the order of rows
    rows = frontier.collect()
    best = {r["kind"]: r for r in optimize.best_of(frontier).collect()}
    assert len(rows) == 100
    assert best["min_volatility"]["volatility"] == min(r["volatility"] for r in rows)
    assert best["max_sharpe"]["sharpe"] == max(r["sharpe"] for r in rows)
    assert optimize.target_return(returns, 99.0).count() == 0


def test_regression_equals_least_squares(returns):
    own = factors.factor_returns(returns)
    model = factors.estimate(returns, own)
    wide = own.toPandas().pivot(index="date", columns="factor", values="value").sort_index()
    y = returns.toPandas().pivot(index="date", columns="asset", values="ret").sort_index()
    x = np.column_stack([np.ones(len(wide)), wide[model.factors[1:]].to_numpy()])
    beta = np.linalg.pinv(x) @ y[model.assets].to_numpy()
    assert model.beta.T == pytest.approx(beta, abs=1e-8)
    rank = np.linalg.matrix_rank(x)
    assert rank < x.shape[1]
    residual = ((y[model.assets].to_numpy() - x @ beta) ** 2).sum(0) / (len(x) - rank)
    assert model.residual == pytest.approx(residual, rel=1e-6)
    assert factors.tilted(returns, model, {"SMB": 50.0})[1] == "infeasible"


def plain_adf(x):
    """By regressions on whole columns of lagged changes."""
    n, dx = len(x), np.diff(x)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)

    def fit(lags, skip):
        rows = np.arange(skip, len(dx))
        design = np.column_stack([x[rows], *(dx[rows - j] for j in range(1, lags + 1)), np.ones(len(rows))])
        beta, *_ = np.linalg.lstsq(design, dx[rows], rcond=None)
        ssr = ((dx[rows] - design @ beta) ** 2).sum()
        spread = ssr / (len(rows) - design.shape[1]) * np.linalg.pinv(design.T @ design)[0, 0]
        return beta[0] / math.sqrt(spread), len(rows) * (math.log(2 * math.pi) + math.log(ssr / len(rows)) + 1) + 2 * design.shape[1]

    best = min(range(most + 1), key=lambda lags: fit(lags, most)[1])
    return fit(best, best)[0]


def test_adf_equals_regressions_on_columns(spark):
    rng = np.random.default_rng(1)
    noise = rng.normal(size=400)
    cases = {"noise": noise, "walk": np.cumsum(noise), "short": noise[:11], "twelve": noise[:30], "long": np.convolve(rng.normal(size=3000), [1, 0.5, 0.3, -0.4]), "level": 0.001 * noise + 5}
    start = pd.Timestamp("2000-01-01")
    rows = [((start + pd.Timedelta(days=i)).date(), k, float(v)) for k, x in cases.items() for i, v in enumerate(x)]
    rows += [(start.date(), "tiny", 0.1), (start.date(), "null", None), *(((start + pd.Timedelta(days=i)).date(), "flat", 0.1) for i in range(40))]
    got = {r["asset"]: r for r in validation.adf(spark.createDataFrame(rows, "date date, asset string, ret double")).collect()}
    for k, x in cases.items():
        assert got[k]["adf_stat"] == pytest.approx(plain_adf(x), rel=1e-6)
        assert got[k]["p_value"] == pytest.approx(stationarity.adf_p(plain_adf(x)), abs=1e-6)
    assert [tuple(got[k])[1:] for k in ("tiny", "flat")] == [(0.0, 1.0, False)] * 2 and "null" not in got
    assert got["noise"]["p_value"] < 0.01 and got["walk"]["p_value"] > 0.05
    assert stationarity.adf_p(-2.86) == pytest.approx(0.05, abs=0.002) and stationarity.adf_p(-3.43) == pytest.approx(0.01, abs=0.001)


def test_as_of_over_many_buckets(spark):
    rng = np.random.default_rng(5)
    day = lambda k: (pd.Timestamp("2020-01-01") + pd.Timedelta(days=int(k))).date()
    right = [(key, day(k), None if rng.random() < 0.2 else float(k)) for key in "ab" for k in sorted(rng.choice(900, 25, replace=False))]
    left = [(key, day(k)) for key in "abc" for k in range(0, 900, 3)]
    want = [(key, d, next((v for q, at, v in reversed(right) if q == key and at <= d and v is not None), None)) for key, d in left]
    frames = spark.createDataFrame(left, "strategy string, date date"), spark.createDataFrame(right, "strategy string, date date, weight double")
    for days in (7, 30, 10_000):
        assert sorted(map(tuple, backtest.as_of(*frames, days=days).collect()), key=repr) == sorted(want, key=repr)


def test_stress_goldens(spark):
    rows = {r["scenario"]: r for r in simulate.stress(simulate.scenario_frame(spark, simulate.SCENARIOS)).collect()}
    assert rows["bearish"]["final_value"] == pytest.approx(46622.56101978211) and rows["bearish"]["days"] == 25
    assert rows["bearish"]["max_drawdown"] == pytest.approx(-0.5242595814307948)
    assert rows["volatile"]["final_value"] == pytest.approx(115307.8287366609) and rows["volatile"]["days"] == 45
    assert rows["volatile"]["max_drawdown"] == pytest.approx(-0.26257587310507163)


def test_rebalancing_equals_a_loop(spark):
    rng = np.random.default_rng(9)
    dates = pd.bdate_range("2021-01-01", periods=90).date
    prices = 100 * np.cumprod(1 + rng.normal(0, 0.02, (90, 3)), axis=0)
    frame = spark.createDataFrame([(d, a, float(v)) for d, row in zip(dates, prices, strict=True) for a, v in zip("xyz", row, strict=True)], "date date, asset string, price double")
    weights = spark.createDataFrame([("s", "x", 0.5), ("s", "y", 0.3), ("s", "z", 0.2)], "strategy string, asset string, weight double")
    flags = {r["date"] for r in backtest.month_end_dates(frame).collect()}
    w, value, units, want = np.array([0.5, 0.3, 0.2]), 1000.0, None, []
    for d, row in zip(dates, prices, strict=True):
        units = value * w / row if units is None else units
        value = float(units @ row)
        want.append(value)
        if d in flags:
            units = value * w / row
    got = backtest.rebalanced(frame, weights, backtest.month_end_dates(frame), 1000.0).orderBy("date").collect()
    assert flags and [r["value"] for r in got] == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("seed", range(10))
def test_max_sharpe_where_nothing_earns_more_than_cash(seed):
    """With every excess return negative, random portfolios and single assets do no better."""
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(4, 4))
    mu, sigma = -np.abs(rng.normal(0.1, 0.1, 4)), a @ a.T / 4 + 0.05 * np.eye(4)
    w = solvers.max_sharpe(mu, sigma, 0.03)
    ratio = lambda x: (x @ mu - 0.03) / math.sqrt(x @ sigma @ x)
    assert abs(w.sum() - 1) < 1e-8 and (w >= -1e-9).all()
    others = [*rng.dirichlet(np.full(4, 0.4), 4000), *np.eye(4)]
    assert ratio(w) >= max(map(ratio, others)) - 1e-6


def test_a_ruined_strategy_stays_at_nothing_across_blocks_and_rebalances(spark, monkeypatch):
    """Prices that fall to nearly nothing and rise again, with rebalances on the first date, on an unknown date and on the
    last one, against a loop; in short blocks and in a long one, the ruin at several places of a block, at a rebalance, and
    never."""
    dates = [d.date() for d in pd.date_range("2020-02-24", periods=30)]
    for days, fall in ((4, 9), (4, 10), (4, 12), (365, 12), (4, 99)):
        monkeypatch.setattr(backtest, "BLOCK_DAYS", days)
        prices = [100.0 + k if k < fall else (0.2 if k < fall + 3 else 90.0 + k) for k in range(30)]
        frame = spark.createDataFrame([(d, a, v * times) for d, v in zip(dates, prices, strict=True) for a, times in (("x", 1.0), ("y", 2.0))], "date date, asset string, price double")
        weights = spark.createDataFrame([("s", "x", 0.25), ("s", "y", 0.75)], "strategy string, asset string, weight double")
        flags = spark.createDataFrame([(dates[0],), (dates[12],), (dates[20],), (dates[29],), (pd.Timestamp("2021-05-05").date(),)], "date date")
        value, want = 1000.0, []
        for k, p in enumerate(prices):
            now = 0.0 if any(v <= 10.0 for v, _ in want) else 1000.0 * p / prices[0]
            want.append((now, now / value - 1 if value > 0 else 0.0))
            value = now
        got = backtest.rebalanced(frame, weights, flags, 1000.0).orderBy("date").collect()
        assert [r["date"] for r in got] == dates
        assert [(r["value"], r["ret"]) for r in got] == [pytest.approx(w, rel=1e-9, abs=1e-12) for w in want]
        level = np.cumprod([1 + r for _, r in want])
        found = backtest.backtest_metrics(backtest.rebalanced(frame, weights, flags, 1000.0)).first()
        assert found["max_drawdown"] == pytest.approx(min(level / np.maximum.accumulate(level) - 1), rel=1e-9, abs=1e-12)
        assert found["annual_vol"] == pytest.approx(np.std([r for _, r in want], ddof=1) * 252**0.5, rel=1e-9)
