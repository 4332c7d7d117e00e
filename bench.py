"""Runs headline queries on one machine and prints one line of JSON."""

import json
import os
import time

from pyspark.sql import SparkSession

QUERIES = [
    "clean_prices_pipeline", "clean_interpolate_time", "validate_return_stats", "validate_correlation", "validate_adf", "risk_all_metrics", "risk_portfolio_metrics",
    "portfolio_random_frontier", "portfolio_max_sharpe", "portfolio_min_volatility", "portfolio_risk_parity", "portfolio_frontier_curve", "bl_posterior_one_view", "factor_returns", "factor_exposures",
    "simulate_parametric", "simulate_historical", "simulate_block_bootstrap", "stress_scenarios", "backtest_comparison", "backtest_dynamic", "backtest_macro",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tidemark.plans.catalog import QUERIES as registered

    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # the session's start isn't a query's
    seconds = {}
    for name in QUERIES:
        began = time.time()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
        spark.catalog.clearCache()
    # simulations at full size: 1000 paths of 1260 days
    from tidemark.operators import simulate
    from tidemark.plans.strategy_queries import history

    own = history(spark, sf_dir).cache()
    for method in ("parametric", "historical", "block_bootstrap"):
        began = time.time()
        simulate.final_stats(getattr(simulate, method)(own)).write.format("noop").mode("overwrite").save()
        seconds[f"full_{method}"] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
