"""Signals -> portfolio -> metrics -> significance as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.operators import performance, portfolio, stattests
from undertow.session import cut_lineage


def run_backtest(
    net: DataFrame, sentiment: DataFrame, prices: DataFrame, benchmark: DataFrame, *, cost: float = 0.001, slippage: float = 0.0, literal: bool = False
) -> DataFrame:
    """Long (part, metric, value): performance against the benchmark and test statistics."""
    weights = portfolio.target_weights(portfolio.transmission_signal(net, sentiment), prices)
    engine = portfolio.backtest_literal if literal else portfolio.backtest_compounding
    path = engine(weights, cost=cost, slippage=slippage)
    bench = portfolio.benchmark_returns(benchmark, path.select("ts"))
    daily = cut_lineage(
        path.join(bench, "ts").filter("bench is not null").select(F.lit("portfolio").alias("series"), "ts", F.col("daily_return").alias("ret"), "bench")
    )
    report = performance.performance_report(daily, key="series", bench="bench")
    tests = [
        ("jarque_bera", stattests.jarque_bera(daily, keys=["series"], value="ret")),
        ("ljung_box", stattests.ljung_box(daily, keys=["series"], ts="ts", value="ret")),
        ("unit_root", stattests.adf_test(daily, keys=["series"], ts="ts", value="ret", criterion="aic")),
        ("paired_t", stattests.paired_t(daily, keys=["series"], a="ret", b="bench")),
        ("wilcoxon", stattests.wilcoxon_signed_rank(daily, keys=["series"], a="ret", b="bench")),
    ]
    out = report.select(F.lit("performance").alias("part"), "metric", "value")
    for name, result in tests:
        both = result.select(
            F.inline(
                F.array(
                    F.struct(F.lit(f"{name}_statistic").alias("metric"), F.col("statistic").cast("double").alias("value")),
                    F.struct(F.lit(f"{name}_p").alias("metric"), F.col("p_value").alias("value")),
                )
            )
        )
        out = out.unionByName(both.select(F.lit("tests").alias("part"), "metric", "value"))
    return out
