"""Portfolios within inequalities, frontier corners, tilts, changes by views and whole runs, as numbers that SQL finds its
own way: by closed forms, by filling assets in order, by trying every set of free assets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import black_litterman as B
from ..operators import cleaning as C
from ..operators import factors as X
from ..operators import optimize as O
from ..operators import suites as S
from ..sources import panels as P
from .portfolio_queries import BETAS, MOMENTS, TWO, _model, _views
from .registry import ORACLE_SQL, query, r
from .strategy_queries import BT, STATIC, VALUES, _macro_holed, days, rules, strategies
from .validation_queries import weekly_returns


def _names(spark: SparkSession, d: str) -> list[str]:
    return sorted(x["asset"] for x in weekly_returns(spark, d).select("asset").distinct().collect())  # a name an asset


def _limits(names: list[str]) -> O.Limits:
    """A third at most in the first two assets, a tenth at least in the last, half a turnover from equal parts."""
    return O.Limits([({names[0]: 1.0, names[1]: 1.0}, 0.3), ({names[-1]: -1.0}, -0.1)], ({k: 1 / len(names) for k in names}, 0.5))


def _limited(objective: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return O.limited(weekly_returns(spark, d), objective, _limits(_names(spark, d)))

    run.__name__ = f"portfolio_limits_{objective}"
    return run


for _objective in ("min_variance", "utility", "sharpe"):
    query()(_limited(_objective))


@query()
def factor_optimise_limits(spark: SparkSession, d: str) -> DataFrame:
    returns, m = _model(spark, d)
    return X.optimise(returns, m, "min_variance", limits=_limits(m.assets))


@query(
    f"""WITH {MOMENTS}, {TWO}, c AS (SELECT x, y, (SELECT cov FROM s WHERE asset_i = x AND asset_j = x) AS xx, (SELECT cov FROM s WHERE asset_i = y AND asset_j = y) AS yy, (SELECT cov FROM s WHERE asset_i = x AND asset_j = y) AS xy FROM a),
w AS (SELECT x, y, least(greatest((yy - xy) / (xx + yy - 2 * xy), 0.4), 0.55) AS wx FROM c)
SELECT 'limited_min_variance' AS portfolio, x AS asset, {r('wx', 'weight')} FROM w UNION ALL SELECT 'limited_min_variance', y, {r('1 - wx', 'weight')} FROM w"""
)
def portfolio_limits_pair(spark: SparkSession, d: str) -> DataFrame:
    """Of the first and last asset: at most 0.55 in the first, a fifth of turnover from halves."""
    returns, names = weekly_returns(spark, d), _names(spark, d)
    limits = O.Limits([({names[0]: 1.0}, 0.55)], ({names[0]: 0.5, names[-1]: 0.5}, 0.2))
    return O.limited(returns.filter(F.col("asset").isin(names[0], names[-1])), "min_variance", limits)


_ADD = "least(0.4, room, CASE WHEN grouped THEN cap ELSE 1 END)"


@query(
    f"""WITH RECURSIVE {MOMENTS}, o AS (SELECT asset, row_number() OVER (ORDER BY mu DESC, asset) AS k, row_number() OVER (ORDER BY asset) <= 3 AS grouped FROM mu),
filled AS (SELECT 0::BIGINT AS k, '' AS asset, 0.0::DOUBLE AS weight, 1.0::DOUBLE AS room, 0.5::DOUBLE AS cap
  UNION ALL SELECT o.k, o.asset, {_ADD}, room - {_ADD}, cap - CASE WHEN grouped THEN {_ADD} ELSE 0 END FROM filled JOIN o ON o.k = filled.k + 1)
SELECT 'limited_max_return' AS portfolio, asset, {r('weight', 'weight')} FROM filled WHERE k > 0"""
)
def portfolio_limits_max_return(spark: SparkSession, d: str) -> DataFrame:
    """At most half in the first three assets and 0.4 in each; SQL fills the assets of the greatest means first."""
    limits = O.Limits([(dict.fromkeys(_names(spark, d)[:3], 1.0), 0.5)])
    return O.limited(weekly_returns(spark, d), "max_return", limits, 0.0, 0.4)


@query()
def portfolio_frontier_corners(spark: SparkSession, d: str) -> DataFrame:
    return O.frontier_corners(weekly_returns(spark, d))


_single = " UNION ALL ".join(f"SELECT {i + 1}, {', '.join(f'1 / s{i}{i}' if k == i else '0' for k in range(3))}, {', '.join(f'u{i} / s{i}{i}' if k == i else '0' for k in range(3))} FROM t" for i in range(3))
_pair = []
for _n, (_i, _j) in enumerate(((0, 1), (0, 2), (1, 2))):
    _det = f"(s{_i}{_i} * s{_j}{_j} - s{_i}{_j} * s{_i}{_j})"
    _one = {_i: f"(s{_j}{_j} - s{_i}{_j}) / {_det}", _j: f"(s{_i}{_i} - s{_i}{_j}) / {_det}"}
    _mean = {_i: f"(s{_j}{_j} * u{_i} - s{_i}{_j} * u{_j}) / {_det}", _j: f"(s{_i}{_i} * u{_j} - s{_i}{_j} * u{_i}) / {_det}"}
    _pair.append(f"SELECT {_n + 4}, {', '.join(_one.get(k, '0') for k in range(3))}, {', '.join(_mean.get(k, '0') for k in range(3))} FROM t")
_inverse = {
    (0, 0): "s11 * s22 - s12 * s12", (0, 1): "s02 * s12 - s01 * s22", (0, 2): "s01 * s12 - s02 * s11", (1, 1): "s00 * s22 - s02 * s02", (1, 2): "s01 * s02 - s00 * s12", (2, 2): "s00 * s11 - s01 * s01",
}
_cell = lambda i, k: f"({_inverse[min(i, k), max(i, k)]})"
_det = f"(s00 * {_cell(0, 0)} + s01 * {_cell(0, 1)} + s02 * {_cell(0, 2)})"
_triple = f"SELECT 7, {', '.join('(' + ' + '.join(_cell(i, k) for k in range(3)) + f') / {_det}' for i in range(3))}, {', '.join('(' + ' + '.join(f'{_cell(i, k)} * u{k}' for k in range(3)) + f') / {_det}' for i in range(3))} FROM t"
_slope = lambda v, i: f"(s{min(0, i)}{max(0, i)} * {v}0 + s{min(1, i)}{max(1, i)} * {v}1 + s{min(2, i)}{max(2, i)} * {v}2)"
_conditions = " UNION ALL ".join(f"SELECT part, {i} AS i, CASE WHEN y{i} <> 0 THEN p{i} ELSE {_slope('p', i)} - 1 / one END AS a, CASE WHEN y{i} <> 0 THEN q{i} ELSE {_slope('q', i)} - u{i} + mean / one END AS b FROM line" for i in range(3))


@query(
    f"""WITH {MOMENTS}, n3 AS (SELECT asset, row_number() OVER (ORDER BY asset) - 1 AS i FROM mu QUALIFY i < 3),
t AS (SELECT {', '.join(f"max(mu) FILTER (i = {i}) AS u{i}" for i in range(3))}, {', '.join(f"(SELECT cov FROM s WHERE asset_i = (SELECT asset FROM n3 WHERE i = {i}) AND asset_j = (SELECT asset FROM n3 WHERE i = {j})) AS s{i}{j}" for i in range(3) for j in range(i, 3))} FROM n3 JOIN mu USING (asset)),
sets(part, y0, y1, y2, z0, z1, z2) AS ({_single} UNION ALL {' UNION ALL '.join(_pair)} UNION ALL {_triple}),
sums AS (SELECT *, y0 + y1 + y2 AS one, z0 + z1 + z2 AS mean FROM sets CROSS JOIN t),
line AS (SELECT *, {', '.join(f'y{i} / one AS p{i}, z{i} - mean / one * y{i} AS q{i}' for i in range(3))} FROM sums),
conditions AS ({_conditions}),
spans AS (SELECT part, greatest(max(CASE WHEN b > 1e-12 THEN -a / b END), 0) AS low, coalesce(min(CASE WHEN b < -1e-12 THEN -a / b END), 'infinity'::DOUBLE) AS high, min(CASE WHEN abs(b) <= 1e-12 THEN a END) AS flat FROM conditions GROUP BY part),
held AS (SELECT part, coalesce(low, 0) AS low, high FROM spans WHERE coalesce(low, 0) < high - 1e-9 AND coalesce(flat, 0) >= -1e-12),
prices AS (SELECT part, high AS price FROM held WHERE high < 'infinity'::DOUBLE UNION ALL SELECT part, 0 FROM held WHERE low = 0),
corners AS (SELECT row_number() OVER (ORDER BY price DESC) - 1 AS corner, price, {', '.join(f'p{i} + price * q{i} AS w{i}, u{i}' for i in range(3))}, {', '.join(f's{i}{j}' for i in range(3) for j in range(i, 3))} FROM prices JOIN line USING (part)),
valued AS (SELECT *, w0 * u0 + w1 * u1 + w2 * u2 AS m, sqrt(w0 * w0 * s00 + w1 * w1 * s11 + w2 * w2 * s22 + 2 * (w0 * w1 * s01 + w0 * w2 * s02 + w1 * w2 * s12)) AS v FROM corners)
SELECT CAST(corner AS INTEGER) AS corner, asset, {r('CASE i WHEN 0 THEN w0 WHEN 1 THEN w1 ELSE w2 END', 'weight')}, {r('m', 'expected_return')}, {r('v', 'volatility')}, {r('price', 'price')} FROM valued CROSS JOIN n3"""
)
def portfolio_frontier_corners_three(spark: SparkSession, d: str) -> DataFrame:
    """Of the first three assets; SQL tries every set of assets that may be held, and takes the ends of the prices at
    which it is the best one."""
    return O.frontier_corners(weekly_returns(spark, d).filter(F.col("asset").isin(_names(spark, d)[:3])))


@query(f"WITH {BETAS}, k AS (SELECT unnest(['tilt_min_tracking_error', 'tilt_max_return', 'tilt_min_variance']) AS portfolio) SELECT portfolio, factor, {r('avg(beta)', 'exposure')}, 'optimal' AS status FROM k CROSS JOIN lo WHERE factor = 'SMB' GROUP BY portfolio, factor")
def factor_tilt_reached(spark: SparkSession, d: str) -> DataFrame:
    """The exposure that tilted weights have, from the weights and the loadings: the target, the assets' mean."""
    returns, m = _model(spark, d)
    middle = float(m.beta[:, m.factors.index("SMB")].mean())
    found = None
    for objective in ("min_tracking_error", "max_return", "min_variance"):
        weights, status = X.tilted(returns, m, {"SMB": middle}, objective)
        own = X.portfolio_exposures(returns, weights, m).filter("factor = 'SMB'").withColumn("status", F.lit(status))
        found = own if found is None else found.unionByName(own)
    return found


_ONE = ORACLE_SQL["bl_posterior_one_view"]
_BEFORE = _ONE[: _ONE.rindex("SELECT asset,")]
_MOVES = "row_number() OVER (ORDER BY posterior - prior {}, asset)"


@query(
    f"{_BEFORE}, d AS (SELECT 'increase' AS direction, {_MOVES.format('DESC')} AS place, * FROM q UNION ALL SELECT 'decrease', {_MOVES.format('ASC')}, * FROM q) "
    f"SELECT direction, CAST(place AS INTEGER) AS place, asset, {r('prior', 'prior')}, {r('posterior', 'posterior')}, {r('posterior - prior', 'difference')}, {r('(posterior - prior) / nullif(abs(prior), 0) * 100', 'difference_pct', 4)} FROM d WHERE place <= 5"
)
def bl_moves(spark: SparkSession, d: str) -> DataFrame:
    mu, cov = O.moments(weekly_returns(spark, d))
    found = B.moves(B.compared(mu, cov, _views(_names(spark, d))))
    return found.withColumn("difference_pct", F.round(F.col("difference_pct") + 3e-8, 4))


@query(
    f"""{_BEFORE}, c AS (SELECT s.asset_i, s.asset_j, s.cov AS prior, 0.025 * s.cov - 0.025 * 0.025 * a.cov * b.cov / (0.025 * vv + omega) AS posterior
  FROM s CROSS JOIN o JOIN s a ON a.asset_i = s.asset_i AND a.asset_j = o.v JOIN s b ON b.asset_i = s.asset_j AND b.asset_j = o.v),
cc AS (SELECT x.asset_j AS asset_i, y.asset_j, corr(x.prior, y.prior) AS before, corr(x.posterior, y.posterior) AS after FROM c x JOIN c y ON x.asset_i = y.asset_i GROUP BY 1, 2)
SELECT asset_i, asset_j, {r('prior', 'prior')}, {r('posterior', 'posterior')}, {r('before', 'prior_correlation')}, {r('after', 'posterior_correlation')}, {r('after - before', 'correlation_change')} FROM c JOIN cc USING (asset_i, asset_j)"""
)
def bl_covariance_change(spark: SparkSession, d: str) -> DataFrame:
    mu, cov = O.moments(weekly_returns(spark, d))
    return B.covariance_change(mu, cov, _views(_names(spark, d)))


_METRICS = f"SELECT strategy, {r('total_return', 'total_return')}, {r('annual_return', 'annual_return')}, {r('annual_vol', 'annual_vol')}, {r('sharpe', 'sharpe')}, {r('max_drawdown', 'max_drawdown')}, {r('final_value / 100000', 'final_value')} FROM bm"
_RUNS = [f"WITH {STATIC}, {BT} {_METRICS}", *(f"{ORACLE_SQL[k].removesuffix(VALUES)}, {BT} {_METRICS}" for k in ("backtest_dynamic", "backtest_macro"))]


@query(" UNION ALL ".join(f"SELECT * FROM ({x})" for x in _RUNS))
def suite_backtests(spark: SparkSession, d: str) -> DataFrame:
    """Static strategies, momentum and the macro rules in one run."""
    prices = days(spark, d)
    assets = sorted(x["asset"] for x in P.weekly_prices(spark, d).select("asset").distinct().collect())  # a name an asset
    found = S.backtests(prices, C.simple_returns(prices), strategies(prices), _macro_holed(spark, d), rules(spark, ("1-URGENT", "2-HIGH"), assets))
    return found.withColumn("final_value", F.col("final_value") / 100_000)
