"""Signals, position limits and backtests on daily bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undertow.operators import features, joins


def transmission_signal(
    net: DataFrame, sentiment: DataFrame, *, lookback: int = 5, scale_window: int = 252, max_position: float = 0.2
) -> DataFrame:
    """Signal per (ts, series) from net effects (ts, series, net) and sentiment (ts, series, value).

    Mean net effect x mean sentiment over ``lookback`` rows, divided by twice
    its rolling std, clipped to [-1, 1]; series without effects get 0; then the
    position limits.
    """
    w = Window.partitionBy("series").orderBy("ts")
    short = w.rowsBetween(-(lookback - 1), 0)
    effect = net.withColumn("_net", features.full(F.avg("net").over(short), "net", short, lookback)).select("series", "ts", "_net")
    mood = sentiment.withColumn("_mood", features.full(F.avg("value").over(short), "value", short, lookback)).select("series", "ts", "_mood")
    both = joins.asof_join_backward(mood, effect, on="ts", values=["_net"], by=["series"])
    both = both.withColumn("_raw", F.col("_net") * F.col("_mood"))
    long = w.rowsBetween(-(scale_window - 1), 0)
    spread = features.full(F.stddev_samp("_raw").over(long), "_raw", long, scale_window)
    scaled = both.withColumn("_s", F.col("_raw") / F.nullif(2 * spread, F.lit(0.0)))
    clipped = F.greatest(F.least(F.col("_s"), F.lit(1.0)), F.lit(-1.0))
    filled = F.last(F.when(F.col("_s").isNotNull(), clipped), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    signal = scaled.select("ts", "series", F.coalesce(filled, F.lit(0.0)).alias("signal"))
    return position_limits(signal, max_position=max_position)


def position_limits(signal: DataFrame, *, max_position: float = 0.2) -> DataFrame:
    """Clip each signal, then scale a date down to total leverage 1."""
    clipped = signal.withColumn("signal", F.greatest(F.least(F.col("signal"), F.lit(max_position)), F.lit(-max_position)))
    total = F.sum(F.abs("signal")).over(Window.partitionBy("ts"))
    return clipped.withColumn("_t", total).withColumn(
        "signal", F.coalesce(F.col("signal") * F.least(F.lit(1.0), 1 / F.nullif("_t", F.lit(0.0))), F.lit(0.0))
    ).drop("_t")


def target_weights(signal: DataFrame, prices: DataFrame) -> DataFrame:
    """(ts, series, price, weight): absolute weights sum to 1; dates without a price for every series are skipped."""
    n_series = signal.agg(F.countDistinct("series")).scalar()
    joined = signal.join(prices.select("ts", "series", "price").filter("price is not null"), ["ts", "series"])
    w = Window.partitionBy("ts")
    return (
        joined.withColumns({"_t": F.sum(F.abs("signal")).over(w), "_c": F.count(F.lit(1)).over(w)})
        .filter(F.col("_c") == n_series)
        .select("ts", "series", "price", F.when(F.col("_t") > 0, F.col("signal") / F.col("_t")).otherwise(0.0).alias("weight"))
    )


def backtest_literal(weights: DataFrame, *, capital: float = 100_000.0, cost: float = 0.001, slippage: float = 0.0) -> DataFrame:
    """The fixed-capital accounting: cash restarts at the capital on every date."""
    w = Window.partitionBy("series").orderBy("ts")
    held = weights.withColumn("position", F.col("weight") * capital / F.col("price"))
    held = held.withColumn("before", F.coalesce(F.lag("position").over(w), F.lit(0.0)))
    trade = F.abs(F.col("position") - F.col("before"))
    day = held.groupBy("ts").agg(
        F.sum(F.col("before") * F.col("price")).alias("_carried"),
        F.sum(F.col("position") * F.col("price")).alias("positions_value"),
        F.sum(trade * F.col("price") * (cost + slippage)).alias("costs"),
    )
    line = Window.orderBy("ts")  # one row per trading date
    day = day.withColumn("total_value", capital + F.col("_carried") - F.col("costs"))
    return day.select(
        "ts", "positions_value", "costs", "total_value",
        F.coalesce(F.col("total_value") / F.lag("total_value").over(line) - 1, F.lit(0.0)).alias("daily_return"),
        (F.col("total_value") / capital - 1).alias("cumulative_return"),
    )


def _factors(weights: DataFrame, cost: float) -> DataFrame:
    """Per date: growth of the held portfolio and turnover against drifted weights."""
    w = Window.partitionBy("series").orderBy("ts")
    held = weights.withColumns(
        {"_w0": F.coalesce(F.lag("weight").over(w), F.lit(0.0)), "_r": F.coalesce(F.col("price") / F.lag("price").over(w) - 1, F.lit(0.0))}
    )
    growth = held.groupBy("ts").agg((1 + F.sum(F.col("_w0") * F.col("_r"))).alias("growth"))
    drift = held.join(growth, "ts").withColumn("_drifted", F.col("_w0") * (1 + F.col("_r")) / F.col("growth"))
    turnover = drift.groupBy("ts", "growth").agg(F.sum(F.abs(F.col("weight") - F.col("_drifted"))).alias("turnover"))
    return turnover.withColumn("factor", F.col("growth") * (1 - cost * F.col("turnover")))


def backtest_compounding(weights: DataFrame, *, capital: float = 100_000.0, cost: float = 0.001, slippage: float = 0.0) -> DataFrame:
    """Value = capital x running product of daily factors; a path that reaches 0 stays bankrupt."""
    f = _factors(weights, cost + slippage)
    line = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)  # one row per trading date
    alive = F.min("factor").over(line) > 0
    value = F.when(alive, capital * F.exp(F.sum(F.log(F.when(F.col("factor") > 0, F.col("factor")))).over(line))).otherwise(0.0)
    return f.select(
        "ts", "turnover", value.alias("total_value"), F.when(alive, F.col("factor") - 1).otherwise(0.0).alias("daily_return"),
        (~alive).cast("int").alias("bankrupt"),
    ).withColumn("cumulative_return", F.col("total_value") / capital - 1)


def position_history(weights: DataFrame, path: DataFrame) -> DataFrame:
    """Shares held and weight per asset and date."""
    return weights.join(path.select("ts", "total_value"), "ts").select(
        "ts", "series", "weight", (F.col("weight") * F.col("total_value") / F.col("price")).alias("position")
    )


def threshold_strategy(df: DataFrame, *, high: float = 0.6, low: float = 0.4) -> DataFrame:
    """+1 above, -1 below; earns the previous signal times the price change (columns series, ts, value, price)."""
    w = Window.partitionBy("series").orderBy("ts")
    s = df.withColumn("signal", F.when(F.col("value") > high, 1).when(F.col("value") < low, -1).otherwise(0))
    change = F.col("price") / F.lag("price").over(w) - 1
    return s.select("series", "ts", "signal", (F.lag("signal").over(w) * change).alias("strategy_return"))


def threshold_summary(strategy: DataFrame, *, periods: int = 252) -> DataFrame:
    """Totals per series; the drawdown is taken on the cumulative sum."""
    w = Window.partitionBy("series").orderBy("ts")
    r = strategy.filter("strategy_return is not null")
    path = r.withColumn("_c", F.sum("strategy_return").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    path = path.withColumn("_d", F.col("_c") - F.max("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    turns = strategy.withColumn("_t", F.abs(F.col("signal") - F.lag("signal").over(w)))
    trades = turns.groupBy("series").agg((F.sum("_t") / 2).alias("trades"))
    x = F.col("strategy_return")
    g = path.groupBy("series").agg(
        F.sum(x).alias("total_return"), (F.avg(x) * periods).alias("annual_return"), F.avg((x > 0).cast("int")).alias("win_rate"),
        (F.avg(x) / F.nullif(F.stddev_samp(x), F.lit(0.0)) * periods**0.5).alias("sharpe"), F.min("_d").alias("max_drawdown"),
    )
    return g.join(trades, "series").withColumn("per_trade", F.col("total_return") / F.nullif("trades", F.lit(0.0)))


def benchmark_returns(prices: DataFrame, index: DataFrame) -> DataFrame:
    """Returns of a benchmark price table (ts, price) carried onto another index (ts)."""
    r = prices.withColumn("bench", F.col("price") / F.lag("price").over(Window.orderBy("ts")) - 1).select("ts", "bench")
    return joins.asof_join_backward(index.select("ts"), r, on="ts", values=["bench"])


def constant_signal(net: DataFrame, index: DataFrame) -> DataFrame:
    """The static net effect of each series repeated for every date."""
    table = net.agg(F.collect_list(F.struct("series", "net")).alias("_all"))  # one entry per series
    return index.select("ts").distinct().withColumn("_all", table.scalar()).select("ts", F.inline("_all"))
