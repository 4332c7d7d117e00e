"""The augmented Dickey-Fuller test from sums of lagged products.

Every regression of the test, for every number of lags and either sample, is made of sums of products of a series' changes
at two lags. Those are autocovariances but for products at the two ends, so Spark computes one sum a lag and hands over the
first and last values of each series; matrices of any number of lags follow from them, a row an asset."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: MacKinnon's published response surface for the p-value of the test with a constant, one series:
#: bounds, and polynomials in the statistic below and above the middle one.
ADF_STAR, ADF_MIN, ADF_MAX = -1.61, -18.83, 2.74
ADF_SMALL, ADF_LARGE = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)


def adf_p(stat: float) -> float:
    if stat > ADF_MAX:
        return 1.0
    if stat < ADF_MIN:
        return 0.0
    terms = ADF_SMALL if stat <= ADF_STAR else ADF_LARGE
    return 0.5 * math.erfc(-sum(c * stat**k for k, c in enumerate(terms)) / math.sqrt(2))


def most_lags(n: int) -> int:
    return min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)


class Products:
    """Sums over a series' rows from its lagged products (by lag: of changes, and of levels with changes), its totals
    (changes, levels, squared levels), and its values at both ends by place."""

    def __init__(self, n: int, change: np.ndarray, level: np.ndarray, totals: tuple[float, float, float], ends: dict[int, float]):
        self.rows, self.change, self.level, self.totals, self.ends = n - 1, change, level, totals, ends

    def _d(self, t: int) -> float:
        return self.ends[t + 1] - self.ends[t]

    def matrix(self, lags: int, skip: int) -> np.ndarray:
        """Products of change, level, lagged changes and one with each other, over the rows from skip on."""
        first = np.array([self._d(t) for t in range(skip)])
        levels = np.array([self.ends[t] for t in range(skip)])
        size = lags + 1
        own = np.zeros((size, size))  # of changes at lags 0 to lags
        for k in range(size):
            own[0, k] = own[k, 0] = self.change[k] - first[k:] @ first[: len(first) - k] if k < len(first) else self.change[k]
        for i in range(1, size):
            for j in range(i, size):
                moved = self._d(skip - i) * self._d(skip - j) - self._d(self.rows - i) * self._d(self.rows - j)
                own[i, j] = own[j, i] = own[i - 1, j - 1] + moved
        out = np.zeros((size + 2, size + 2))
        at = [0, *range(2, size + 1)]
        out[np.ix_(at, at)] = own
        for k in range(size):
            cross = self.level[k] - (levels[k:] @ first[: len(first) - k] if k < len(first) else 0.0)
            total = self.totals[0] - first[: skip - k].sum() - sum(self._d(self.rows - i) for i in range(1, k + 1))
            out[1, at[k]] = out[at[k], 1] = cross
            out[-1, at[k]] = out[at[k], -1] = total
        out[1, 1] = self.totals[2] - levels @ levels
        out[1, -1] = out[-1, 1] = self.totals[1] - levels.sum()
        out[-1, -1] = self.rows - skip
        return out

    def regress(self, lags: int, skip: int, whole: np.ndarray | None = None) -> tuple[float, float]:
        """The t-value of the level and the information criterion of Akaike."""
        found = self.matrix(lags, skip) if whole is None else whole[np.ix_(keep := [*range(lags + 2), -1], keep)]
        n, k = self.rows - skip, lags + 2
        xx, xy = found[1:, 1:], found[0, 1:]
        inverse = np.linalg.pinv(xx, rcond=1e-13, hermitian=True)
        beta = inverse @ xy
        ssr = max(float(found[0, 0] - beta @ xy), 0.0)
        spread = ssr / (n - k) * inverse[0, 0]
        return float(beta[0] / math.sqrt(spread)) if spread > 0 else 0.0, n * (math.log(2 * math.pi) + math.log(max(ssr, 1e-300) / n) + 1) + 2 * k

    def statistic(self) -> float:
        """With the lag of the least criterion over one sample, refitted on all rows that it allows."""
        most = most_lags(self.rows + 1)
        whole = self.matrix(most, most)
        best = min(range(most + 1), key=lambda lags: self.regress(lags, most, whole)[1])
        return self.regress(best, best)[0]


def adf(returns: DataFrame, level: float = 0.05, least: int = 11) -> DataFrame:
    """asset, adf_stat, p_value, stationary; a series of under least values, or one that doesn't move, gives 0, 1, false.
    Lags go up to 12 (n/100)^(1/4); null returns are left out."""
    known = returns.filter("ret IS NOT NULL").select("date", "asset", "ret")
    longest = known.groupBy("asset").count().agg(F.max("count")).first()[0] or 0
    lags = max(most_lags(longest), 0)
    own, every = W.partitionBy("asset").orderBy("date"), W.partitionBy("asset")
    placed = known.select("asset", "date", (F.col("ret") - F.avg("ret").over(every)).alias("x"), (F.row_number().over(own) - 1).alias("i"), F.count("*").over(every).alias("n"), (F.max("ret").over(every) > F.min("ret").over(every)).alias("moves"))
    changed = placed.withColumn("d", F.lead("x").over(own) - F.col("x"))
    level_x = F.when(F.col("d").isNotNull(), F.col("x"))
    past = [F.col("d"), *(F.lag("d", k).over(own) for k in range(1, lags + 1))]
    wide = changed.select("asset", "i", "n", "moves", "x", level_x.alias("l"), *(c.alias(f"d{k}") for k, c in enumerate(past)))
    ends = F.collect_list(F.when((F.col("i") <= lags + 1) | (F.col("i") >= F.col("n") - lags - 2), F.struct("i", "x")))
    sums = wide.groupBy("asset").agg(
        F.first("n").alias("n"), F.first("moves").alias("moves"), ends.alias("ends"),
        F.array(*(F.coalesce(F.sum(F.col("d0") * F.col(f"d{k}")), F.lit(0.0)) for k in range(lags + 1))).alias("change"),
        F.array(*(F.coalesce(F.sum(F.col("l") * F.col(f"d{k}")), F.lit(0.0)) for k in range(lags + 1))).alias("level"),
        F.array(*(F.coalesce(F.sum(c), F.lit(0.0)) for c in (F.col("d0"), F.col("l"), F.col("l") * F.col("l")))).alias("totals"),
    )

    def test(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            out = []
            for r in pdf.itertuples(index=False):
                stat, p = 0.0, 1.0
                if r.n >= least and r.moves:
                    held = {int(e["i"]): float(e["x"]) for e in r.ends}
                    stat = Products(int(r.n), np.asarray(r.change), np.asarray(r.level), tuple(r.totals), held).statistic()
                    p = adf_p(stat)
                out.append((r.asset, stat, p, p < level))
            yield pd.DataFrame(out, columns=["asset", "adf_stat", "p_value", "stationary"])

    return sums.mapInPandas(test, "asset string, adf_stat double, p_value double, stationary boolean")
