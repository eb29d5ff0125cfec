"""Performance metrics of return series (keys, ts, ret)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.operators import blocks, features


def annual_metrics(df: DataFrame, *, keys: Sequence[str], ret: str = "ret", periods: int = 252, risk_free: float = 0.02) -> DataFrame:
    """Annual return, volatility and Sharpe ratio."""
    g = df.groupBy(*keys).agg(
        F.count(ret).alias("n"), (F.avg(ret) * periods).alias("annual_return"), (F.stddev_samp(ret) * periods**0.5).alias("annual_vol")
    )
    return g.withColumn("sharpe", (F.col("annual_return") - risk_free) / F.nullif("annual_vol", F.lit(0.0)))


def sortino(df: DataFrame, *, keys: Sequence[str], ret: str = "ret", periods: int = 252, risk_free: float = 0.02) -> DataFrame:
    """Excess return over the sample std of the negative returns."""
    g = df.groupBy(*keys).agg(
        (F.avg(ret) * periods).alias("_a"), (F.stddev_samp(F.when(F.col(ret) < 0, F.col(ret))) * periods**0.5).alias("downside")
    )
    return g.select(*keys, "downside", ((F.col("_a") - risk_free) / F.nullif("downside", F.lit(0.0))).alias("sortino"))


def var_cvar(df: DataFrame, *, keys: Sequence[str], ret: str = "ret", level: float = 0.05) -> DataFrame:
    """Quantile of the returns and the mean at or below it."""
    cut = blocks.quantiles(df, keys, ret, {"var_95": level})
    return df.join(cut, list(keys)).groupBy(*keys, "var_95").agg(F.avg(F.when(F.col(ret) <= F.col("var_95"), F.col(ret))).alias("cvar_95"))


def drawdown_metrics(df: DataFrame, *, keys: Sequence[str], ts: str = "ts", ret: str = "ret", periods: int = 252) -> DataFrame:
    """Largest drawdown and the annual return per unit of it."""
    path = features.cumulative_return(df, ret, keys=keys, order=ts)
    g = path.groupBy(*keys).agg(F.min("drawdown").alias("max_drawdown"), (F.avg(ret) * periods).alias("_a"))
    return g.select(*keys, "max_drawdown", (F.col("_a") / F.nullif(F.abs("max_drawdown"), F.lit(0.0))).alias("calmar"))


def hit_counts(df: DataFrame, *, keys: Sequence[str], ret: str = "ret") -> DataFrame:
    x = F.col(ret)
    return df.groupBy(*keys).agg(
        F.count(ret).alias("periods"), F.count_if(x > 0).alias("positive"), F.count_if(x < 0).alias("negative"), F.avg((x > 0).cast("int")).alias("hit_rate")
    )


def tracking(df: DataFrame, *, keys: Sequence[str], ret: str = "ret", bench: str = "bench", periods: int = 252) -> DataFrame:
    """Active return, tracking error and information ratio."""
    d = F.col(ret) - F.col(bench)
    g = df.groupBy(*keys).agg((F.avg(d) * periods).alias("active_return"), (F.stddev_samp(d) * periods**0.5).alias("tracking_error"))
    return g.withColumn("information_ratio", F.col("active_return") / F.nullif("tracking_error", F.lit(0.0)))


def beta_alpha(
    df: DataFrame, *, keys: Sequence[str], ret: str = "ret", bench: str = "bench", periods: int = 252, risk_free: float = 0.02, mixed_ddof: bool = False
) -> DataFrame:
    """Market beta and annual alpha; ``mixed_ddof`` divides by the population variance."""
    spread = F.var_pop(bench) if mixed_ddof else F.var_samp(bench)
    both = df.filter(F.col(ret).isNotNull() & F.col(bench).isNotNull())
    g = both.groupBy(*keys).agg(
        (F.covar_samp(ret, bench) / F.nullif(spread, F.lit(0.0))).alias("beta"), (F.avg(ret) * periods).alias("_a"), (F.avg(bench) * periods).alias("_b")
    )
    return g.select(*keys, "beta", (F.col("_a") - (risk_free + F.col("beta") * (F.col("_b") - risk_free))).alias("alpha"))


def performance_report(df: DataFrame, *, key: str, ts: str = "ts", ret: str = "ret", bench: str | None = None) -> DataFrame:
    """Every metric as long rows (key, metric, value)."""
    keys = [key]
    wide = annual_metrics(df, keys=keys, ret=ret)
    for part in (sortino(df, keys=keys, ret=ret), var_cvar(df, keys=keys, ret=ret), drawdown_metrics(df, keys=keys, ts=ts, ret=ret), hit_counts(df, keys=keys, ret=ret)):
        wide = wide.join(part, key)
    if bench is not None:
        wide = wide.join(tracking(df, keys=keys, ret=ret, bench=bench), key).join(beta_alpha(df, keys=keys, ret=ret, bench=bench), key)
    names = [c for c in wide.columns if c != key]
    return wide.select(key, *[F.col(c).cast("double").alias(c) for c in names]).unpivot([key], names, "metric", "value")
