"""Moments, frontiers, optimal portfolios, views and factors.

Weights of small programs aren't said in SQL; optimality_queries has what they must satisfy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import black_litterman as B
from ..operators import factors as X
from ..operators import optimize as O
from .registry import WEEKLY_RETURNS, query, r
from .validation_queries import PAIRS, weekly_returns

MOMENTS = f"{WEEKLY_RETURNS}, {PAIRS}, mu AS (SELECT asset, avg(ret) * 252 AS mu FROM r GROUP BY asset), s AS (SELECT asset_i, asset_j, cov * 252 AS cov FROM pairs)"
UNIFORM = "CAST('0x' || substr(md5('{seed}-' || {key}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"
RF = 0.035
FRONTIER = f"""{MOMENTS}, u AS (SELECT p.range AS portfolio, asset, {UNIFORM.format(seed="frontier", key="p.range::VARCHAR || '-' || asset")} AS u FROM range(100) p CROSS JOIN mu),
w AS (SELECT portfolio, asset, u / sum(u) OVER (PARTITION BY portfolio) AS weight FROM u),
m AS (SELECT portfolio, sum(weight * mu) AS expected_return FROM w JOIN mu USING (asset) GROUP BY 1),
v AS (SELECT a.portfolio, sqrt(sum(a.weight * b.weight * cov)) AS volatility FROM w a JOIN w b USING (portfolio) JOIN s ON asset_i = a.asset AND asset_j = b.asset GROUP BY 1),
f AS (SELECT portfolio, expected_return, volatility, (expected_return - {RF}) / nullif(volatility, 0) AS sharpe FROM m JOIN v USING (portfolio))"""
F_COLUMNS = f"{r('expected_return', 'expected_return')}, {r('volatility', 'volatility')}, {r('sharpe', 'sharpe')}"


@query(f"WITH {MOMENTS} SELECT asset_i, asset_j, {r('cov', 'cov')} FROM s")
def portfolio_covariance(spark: SparkSession, d: str) -> DataFrame:
    return O.moments(weekly_returns(spark, d))[1]


@query(f"WITH {MOMENTS} SELECT asset, {r('mu', 'mu')} FROM mu")
def portfolio_means(spark: SparkSession, d: str) -> DataFrame:
    return O.moments(weekly_returns(spark, d))[0]


@query(f"WITH {FRONTIER} SELECT portfolio, {F_COLUMNS} FROM f")
def portfolio_random_frontier(spark: SparkSession, d: str) -> DataFrame:
    return O.random_frontier(weekly_returns(spark, d))


@query(f"WITH {FRONTIER} SELECT 'min_volatility' AS kind, portfolio, {F_COLUMNS} FROM (SELECT * FROM f ORDER BY volatility, portfolio LIMIT 1) UNION ALL SELECT 'max_sharpe', portfolio, {F_COLUMNS} FROM (SELECT * FROM f ORDER BY sharpe DESC, portfolio LIMIT 1)")
def portfolio_best_random(spark: SparkSession, d: str) -> DataFrame:
    return O.best_of(O.random_frontier(weekly_returns(spark, d)))


@query(f"WITH {FRONTIER}, b AS (SELECT * FROM f ORDER BY sharpe DESC, portfolio LIMIT 1), h AS (SELECT max(volatility) AS h FROM f) SELECT {r('range * 1.2 * h / 99', 'x')}, {r(f'{RF} + (expected_return - {RF}) / volatility * (range * 1.2 * h / 99)', 'y')} FROM range(100) CROSS JOIN b CROSS JOIN h")
def portfolio_market_line(spark: SparkSession, d: str) -> DataFrame:
    frontier = O.random_frontier(weekly_returns(spark, d))
    best = O.best_of(frontier).filter("kind = 'max_sharpe'")
    return O.capital_market_line(best, frontier.agg(F.max("volatility")).first()[0])


@query()
def portfolio_max_sharpe(spark: SparkSession, d: str) -> DataFrame:
    return O.max_sharpe(weekly_returns(spark, d))


@query()
def portfolio_min_volatility(spark: SparkSession, d: str) -> DataFrame:
    return O.min_volatility(weekly_returns(spark, d))


TWO = "a AS (SELECT min(asset) AS x, max(asset) AS y FROM r)"


@query(
    f"""WITH {MOMENTS}, {TWO}, c AS (SELECT x, y, (SELECT cov FROM s WHERE asset_i = x AND asset_j = x) AS xx, (SELECT cov FROM s WHERE asset_i = y AND asset_j = y) AS yy, (SELECT cov FROM s WHERE asset_i = x AND asset_j = y) AS xy FROM a),
w AS (SELECT x, y, least(greatest((yy - xy) / (xx + yy - 2 * xy), 0), 1) AS wx FROM c)
SELECT 'min_volatility' AS portfolio, x AS asset, {r('wx', 'weight')} FROM w UNION ALL SELECT 'min_volatility', y, {r('1 - wx', 'weight')} FROM w"""
)
def portfolio_min_volatility_pair(spark: SparkSession, d: str) -> DataFrame:
    """Of the first and last asset, which has a closed form."""
    returns = weekly_returns(spark, d)
    ends = returns.agg(F.min("asset").alias("x"), F.max("asset").alias("y"))
    return O.min_volatility(returns.crossJoin(F.broadcast(ends)).filter("asset IN (x, y)").drop("x", "y"))  # one row


@query()
def portfolio_target_return(spark: SparkSession, d: str) -> DataFrame:
    returns = weekly_returns(spark, d)
    middle = O.moments(returns)[0].agg((F.min("mu") + F.max("mu")) / 2).first()[0]
    return O.target_return(returns, middle)


@query()
def portfolio_frontier_curve(spark: SparkSession, d: str) -> DataFrame:
    return O.frontier_curve(weekly_returns(spark, d))


@query()
def portfolio_risk_parity(spark: SparkSession, d: str) -> DataFrame:
    return O.risk_parity(weekly_returns(spark, d))


@query(
    f"""WITH {MOMENTS}, {TWO}, v AS (SELECT asset_i AS asset, sqrt(cov) AS sd FROM s, a WHERE asset_i = asset_j AND asset_i IN (x, y))
SELECT 'risk_parity' AS portfolio, asset, {r('(1 / sd) / sum(1 / sd) OVER ()', 'weight')}, {r('0.5', 'risk_share')} FROM v"""
)
def portfolio_risk_parity_pair(spark: SparkSession, d: str) -> DataFrame:
    """Of two assets parts go by the inverse of volatility, whatever their correlation."""
    returns = weekly_returns(spark, d)
    ends = returns.agg(F.min("asset").alias("x"), F.max("asset").alias("y"))
    return O.risk_parity(returns.crossJoin(F.broadcast(ends)).filter("asset IN (x, y)").drop("x", "y"))  # one row


@query(f"WITH {MOMENTS}, n AS (SELECT count(*) AS n FROM mu) SELECT asset_i AS asset, {r('2.5 * sum(cov / n)', 'implied')} FROM s CROSS JOIN n GROUP BY 1")
def bl_equilibrium(spark: SparkSession, d: str) -> DataFrame:
    mu, cov = O.moments(weekly_returns(spark, d))
    return B.equilibrium(cov, B.market_weights(mu))


def _views(names: list[str]) -> list[B.View]:
    return [B.View.absolute(names[0], 0.15, 0.7)]


@query(
    f"""WITH {MOMENTS}, n AS (SELECT count(*) AS n, min(asset) AS v FROM mu), pi AS (SELECT asset_i AS asset, 2.5 * sum(cov / n) AS prior FROM s CROSS JOIN n GROUP BY 1),
k AS (SELECT v, (SELECT cov FROM s WHERE asset_i = v AND asset_j = v) AS vv, (SELECT prior FROM pi WHERE asset = v) AS pv FROM n),
o AS (SELECT *, greatest((1 / 0.7::DOUBLE - 1) * 0.1 * vv, 1e-8) AS omega FROM k),
q AS (SELECT pi.asset, prior, prior + 0.025 * cov * (0.15 - pv) / (0.025 * vv + omega) AS posterior FROM pi CROSS JOIN o JOIN s ON s.asset_i = pi.asset AND s.asset_j = o.v)
SELECT asset, {r('prior', 'prior')}, {r('posterior', 'posterior')}, {r('posterior - prior', 'difference')}, {r('(posterior - prior) / nullif(abs(prior), 0) * 100', 'difference_pct', 4)} FROM q"""
)
def bl_posterior_one_view(spark: SparkSession, d: str) -> DataFrame:
    mu, cov = O.moments(weekly_returns(spark, d))
    names = sorted(x["asset"] for x in mu.select("asset").collect())
    return B.compared(mu, cov, _views(names)).withColumn("difference_pct", F.round(F.col("difference_pct") + 3e-8, 4))


@query(
    f"""WITH {MOMENTS}, n AS (SELECT count(*) AS n FROM mu), pi AS (SELECT asset_i AS asset, 2.5 * sum(cov / n) AS prior FROM s CROSS JOIN n GROUP BY 1),
nm AS (SELECT asset, row_number() OVER (ORDER BY asset) AS i FROM mu), sn AS (SELECT a.i AS i, b.i AS j, cov FROM s JOIN nm a ON a.asset = asset_i JOIN nm b ON b.asset = asset_j),
cl AS (SELECT i, sum(cov) FILTER (j = 1) AS c0, sum(CASE j WHEN 2 THEN cov WHEN 3 THEN -cov END) AS c1 FROM sn GROUP BY 1),
vv AS (SELECT max(c0) FILTER (i = 1) AS v00, max(c1) FILTER (i = 1) AS v01, max(c1) FILTER (i = 2) - max(c1) FILTER (i = 3) AS v11 FROM cl),
pv AS (SELECT max(prior) FILTER (i = 1) AS p0, max(prior) FILTER (i = 2) - max(prior) FILTER (i = 3) AS p1 FROM pi JOIN nm USING (asset)),
mm AS (SELECT 0.025 * v00 + greatest((1 / 0.7::DOUBLE - 1) * 0.1 * v00, 1e-8) AS m00, 0.025 * v01 AS m01, 0.025 * v11 + greatest((1 / 0.6::DOUBLE - 1) * 0.1 * v11, 1e-8) AS m11, 0.15 - p0 AS d0, 0.03 - p1 AS d1 FROM vv CROSS JOIN pv),
xx AS (SELECT (m11 * d0 - m01 * d1) / (m00 * m11 - m01 * m01) AS x0, (m00 * d1 - m01 * d0) / (m00 * m11 - m01 * m01) AS x1 FROM mm),
q AS (SELECT asset, prior, prior + 0.025 * (c0 * x0 + c1 * x1) AS posterior FROM pi JOIN nm USING (asset) JOIN cl USING (i) CROSS JOIN xx)
SELECT asset, {r('prior', 'prior')}, {r('posterior', 'posterior')}, {r('posterior - prior', 'difference')}, {r('(posterior - prior) / nullif(abs(prior), 0) * 100', 'difference_pct', 4)} FROM q"""
)
def bl_posterior_views(spark: SparkSession, d: str) -> DataFrame:
    """An absolute and a relative view, which SQL solves as two equations."""
    mu, cov = O.moments(weekly_returns(spark, d))
    names = sorted(x["asset"] for x in mu.select("asset").collect())
    found = B.compared(mu, cov, [*_views(names), B.View.relative(names[1], names[2], 0.03, 0.6)])
    return found.withColumn("difference_pct", F.round(F.col("difference_pct") + 3e-8, 4))


def _optimised(objective: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        mu, cov = O.moments(weekly_returns(spark, d))
        names = sorted(x["asset"] for x in mu.select("asset").collect())
        return B.optimise(mu, cov, _views(names), objective)

    run.__name__ = f"bl_optimise_{objective}"
    return run


for _objective in ("sharpe", "min_variance", "utility"):
    query()(_optimised(_objective))

SIDES = """sc AS (SELECT asset, stddev_samp(ret) AS score FROM r GROUP BY 1),
sd AS (SELECT asset, CASE WHEN row_number() OVER (ORDER BY score DESC, asset) <= floor(0.3 * count(*) OVER ()) THEN 1 WHEN row_number() OVER (ORDER BY score, asset) <= floor(0.3 * count(*) OVER ()) THEN -1 END AS side FROM sc),
nb AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date DESC) AS back, count(*) OVER (PARTITION BY asset) AS n FROM r),
mc AS (SELECT asset, avg(ret) AS score FROM nb WHERE back <= least(252, floor(n / 2)) GROUP BY 1),
md AS (SELECT asset, CASE WHEN row_number() OVER (ORDER BY score DESC, asset) <= floor(0.3 * count(*) OVER ()) THEN 1 WHEN row_number() OVER (ORDER BY score, asset) <= floor(0.3 * count(*) OVER ()) THEN -1 END AS side FROM mc),
fac AS (SELECT date, 'MKT' AS factor, avg(ret) AS value FROM r GROUP BY 1
  UNION ALL SELECT date, 'SMB', avg(ret) FILTER (side = 1) - avg(ret) FILTER (side = -1) FROM r JOIN sd USING (asset) WHERE side IS NOT NULL GROUP BY 1
  UNION ALL SELECT date, 'VOL', avg(ret) FILTER (side = -1) - avg(ret) FILTER (side = 1) FROM r JOIN sd USING (asset) WHERE side IS NOT NULL GROUP BY 1
  UNION ALL SELECT date, 'MOM', avg(ret) FILTER (side = 1) - avg(ret) FILTER (side = -1) FROM r JOIN md USING (asset) WHERE side IS NOT NULL GROUP BY 1)"""


@query(f"WITH {WEEKLY_RETURNS}, {SIDES} SELECT date, factor, {r('value', 'value')} FROM fac")
def factor_returns(spark: SparkSession, d: str) -> DataFrame:
    return X.factor_returns(weekly_returns(spark, d))


@query(f"WITH {WEEKLY_RETURNS}, {SIDES} SELECT asset, {r('regr_slope(ret, value)', 'beta')}, {r('regr_intercept(ret, value)', 'alpha')} FROM r JOIN fac USING (date) WHERE factor = 'MKT' GROUP BY asset")
def factor_market_model(spark: SparkSession, d: str) -> DataFrame:
    """The regression on one factor, which SQL has too."""
    returns = weekly_returns(spark, d)
    model = X.estimate(returns, X.factor_returns(returns).filter("factor = 'MKT'"))
    rows = [(k, float(b[1]), float(b[0])) for k, b in zip(model.assets, model.beta, strict=True)]
    return spark.createDataFrame(rows, "asset string, beta double, alpha double")


def _model(spark: SparkSession, d: str) -> tuple[DataFrame, X.Exposures]:
    returns = weekly_returns(spark, d)
    return returns, X.estimate(returns, X.factor_returns(returns))


#: Regressions on three factors by determinants; VOL is SMB turned round, and of the least norm each takes half.
BETAS = f"""{WEEKLY_RETURNS}, {SIDES}, fw AS (SELECT * FROM (SELECT date, max(value) FILTER (factor = 'MKT') AS f1, max(value) FILTER (factor = 'MOM') AS f2, max(value) FILTER (factor = 'SMB') AS f3 FROM fac GROUP BY 1) WHERE f1 + f2 + f3 IS NOT NULL),
mo AS (SELECT asset, count(*) AS n, avg(ret) AS my, avg(f1) AS m1, avg(f2) AS m2, avg(f3) AS m3, covar_pop(f1, f1) AS a, covar_pop(f1, f2) AS b, covar_pop(f1, f3) AS c, covar_pop(f2, f2) AS d, covar_pop(f2, f3) AS e, covar_pop(f3, f3) AS g,
  covar_pop(f1, ret) AS y1, covar_pop(f2, ret) AS y2, covar_pop(f3, ret) AS y3 FROM r JOIN fw USING (date) GROUP BY 1),
dt AS (SELECT *, a * (d * g - e * e) - b * (b * g - e * c) + c * (b * e - d * c) AS t FROM mo),
be AS (SELECT *, (y1 * (d * g - e * e) - b * (y2 * g - e * y3) + c * (y2 * e - d * y3)) / t AS b1, (a * (y2 * g - e * y3) - y1 * (b * g - e * c) + c * (b * y3 - y2 * c)) / t AS b2, (a * (d * y3 - y2 * e) - b * (b * y3 - y2 * c) + y1 * (b * e - d * c)) / t AS b3 FROM dt),
bt AS (SELECT *, my - b1 * m1 - b2 * m2 - b3 * m3 AS b0 FROM be),
lo AS (SELECT asset, unnest(['const', 'MKT', 'MOM', 'SMB', 'VOL']) AS factor, unnest([b0, b1, b2, b3 / 2, -b3 / 2]) AS beta FROM bt)"""


@query(f"WITH {BETAS} SELECT asset, factor, {r('beta', 'beta')} FROM lo")
def factor_exposures(spark: SparkSession, d: str) -> DataFrame:
    _, m = _model(spark, d)
    rows = [(k, f, float(m.beta[i, j])) for i, k in enumerate(m.assets) for j, f in enumerate(m.factors)]
    return spark.createDataFrame(rows, "asset string, factor string, beta double")


@query(f"WITH {MOMENTS} SELECT asset, {r('mu', 'expected_return')} FROM mu")
def factor_expected_returns(spark: SparkSession, d: str) -> DataFrame:
    """With a constant, the regression passes through the means: the sample means come out."""
    _, m = _model(spark, d)
    return spark.createDataFrame([(k, float(x)) for k, x in zip(m.assets, m.expected(), strict=True)], "asset string, expected_return double")


@query(
    f"""WITH {BETAS}, ft AS (SELECT asset, date, b0 + b1 * f1 + b2 * f2 + b3 * f3 AS fit FROM bt CROSS JOIN fw), rs AS (SELECT asset, sum((ret - fit) * (ret - fit)) / (count(*) - 4) AS v FROM r JOIN ft USING (date, asset) GROUP BY 1),
sy AS (SELECT x.asset AS asset_i, y.asset AS asset_j, covar_samp(x.fit, y.fit) AS cov FROM ft x JOIN ft y USING (date) GROUP BY 1, 2)
SELECT asset_i, asset_j, {r('252 * (cov + CASE WHEN asset_i = asset_j THEN v ELSE 0 END)', 'cov')} FROM sy JOIN rs ON rs.asset = asset_i"""
)
def factor_covariance(spark: SparkSession, d: str) -> DataFrame:
    _, m = _model(spark, d)
    s = m.covariance()
    return spark.createDataFrame([(a, b, float(s[i, j])) for i, a in enumerate(m.assets) for j, b in enumerate(m.assets)], "asset_i string, asset_j string, cov double")


def _factor_optimised(objective: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        returns, m = _model(spark, d)
        return X.optimise(returns, m, objective, target=float(m.expected().mean()))

    run.__name__ = f"factor_optimise_{objective}"
    return run


for _objective in ("sharpe", "min_variance", "utility", "efficient_return"):
    query()(_factor_optimised(_objective))


def _tilted(objective: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        returns, m = _model(spark, d)
        middle = float(m.beta[:, m.factors.index("SMB")].mean())
        frame, status = X.tilted(returns, m, {"SMB": middle}, objective)
        return frame.withColumn("status", F.lit(status))

    run.__name__ = f"factor_tilt_{objective}"
    return run


for _objective in ("min_tracking_error", "max_return", "min_variance"):
    query()(_tilted(_objective))


@query(f"WITH {BETAS} SELECT 'equal' AS portfolio, factor, {r('avg(beta)', 'exposure')} FROM lo GROUP BY factor")
def factor_portfolio_exposures(spark: SparkSession, d: str) -> DataFrame:
    returns, m = _model(spark, d)
    equal = returns.select("asset").distinct().select(F.lit("equal").alias("portfolio"), "asset", F.lit(1.0).alias("weight"))
    return X.portfolio_exposures(returns, equal, m)
