"""The registered simulations of full size against SQL over the same draws: 1000 paths of 1260 days."""

import os

import duckdb
import numpy as np
import pytest

from tidemark.operators.simulate import PERCENTILES, TARGETS
from tidemark.plans import strategy_queries as S
from tidemark.plans.catalog import QUERIES

SF = "/root/testdata/sf0.01"
PATHS, HORIZON, INITIAL = 1000, 1260, 100_000
GRID = f"g AS (SELECT a.range AS path, CAST(b.range AS INTEGER) AS day FROM range({PATHS}) a CROSS JOIN range(1, {HORIZON + 1}) b)"


@pytest.fixture(scope="module")
def values():
    """By method the values in SQL, a row a path, a column a day."""
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    sql = "WITH {}, {}, {}, {} SELECT value FROM pv ORDER BY path, day"
    found = {m: connection.sql(sql.format(S.HISTORY, GRID, draws, S.PATH_VALUES)).fetchnumpy()["value"] for m, draws in S.DRAWS.items()}
    return {m: v.reshape(PATHS, HORIZON) for m, v in found.items()}


def rows(spark, name):
    return QUERIES[name](spark, SF).toArrow().to_pydict()


def close(got, want):
    return np.allclose(np.array(got, float), want, rtol=1e-8, atol=1e-5)


@pytest.mark.parametrize("method", list(S.DRAWS))
def test_paths(spark, values, method):
    got = QUERIES[f"simulate_full_{method}"](spark, SF).toArrow()
    path, day, value = (got.column(c).to_numpy() for c in ("path", "day", "value"))
    order = np.lexsort((day, path))
    assert len(value) == PATHS * HORIZON
    assert (path[order] == np.repeat(np.arange(PATHS), HORIZON)).all() and (day[order] == np.tile(np.arange(1, HORIZON + 1), PATHS)).all()
    assert close(value[order].reshape(PATHS, HORIZON), values[method])


def test_final_stats_and_targets(spark, values):
    last = values["parametric"][:, -1]
    got = {k: v[0] for k, v in rows(spark, "simulate_full_final_stats").items()}
    shares = [(last >= INITIAL * (1 + t)).mean() for t in TARGETS]
    want = [last.mean(), np.median(last), last.min(), last.max(), last.std(), (last.mean() / INITIAL) ** (252 / HORIZON) - 1, *np.percentile(last, PERCENTILES), *shares]
    assert close(list(got.values()), want)
    targets = rows(spark, "simulate_full_targets")
    assert dict(zip(targets["target"], targets["probability"], strict=True)) == pytest.approx(dict(zip(TARGETS, shares, strict=True)), abs=1e-6)


def test_bands_and_sample(spark, values):
    want = np.percentile(values["parametric"], (5, 50, 95), axis=0)
    got = rows(spark, "simulate_full_bands")
    order = np.argsort(got["day"])
    assert len(order) == HORIZON
    assert close([np.array(got[c])[order] for c in ("p5", "p50", "p95")], want)
    sample = rows(spark, "simulate_full_sample")
    path, day = np.array(sample["path"]), np.array(sample["day"])
    assert len(np.unique(path)) == 100 and len(path) == 100 * HORIZON
    assert close(sample["value"], values["parametric"][path, day - 1])
