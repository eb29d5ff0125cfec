"""Regular time grid: resampling, limited fills, pivots, differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undertow.operators import blocks
from undertow.session import attach, cut_lineage

MINUTES_15, HOUR, DAY = 900, 3600, 86400


def bin_start(ts: str, step: int) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / step) * step)


def resample_mean(df: DataFrame, *, series: str, ts: str, value: str, step: int) -> DataFrame:
    """Mean per bin on the full grid series x bins; empty bins are NULL.

    The grid grows with the calendar and the number of series, not with the rows.
    """
    binned = cut_lineage(df.groupBy(series, bin_start(ts, step).alias(ts)).agg(F.avg(value).alias(value)))  # bars: read three times
    span = binned.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    steps = F.sequence(F.unix_seconds("lo"), F.unix_seconds("hi"), F.lit(step).cast("long"))
    names = binned.select(series).distinct()
    bins = span.select(F.when(F.col("lo").isNotNull(), steps).alias("bins"))
    grid = names.withColumn("_bin", F.explode(bins.scalar())).select(series, F.timestamp_seconds("_bin").alias(ts))
    return grid.join(binned, [series, ts], "left")


def infer_frequency(df: DataFrame, *, ts: str) -> DataFrame:
    """Median gap between distinct times -> grid step in seconds."""
    times = df.select(ts).distinct()
    gaps = blocks.previous(times, [], [ts], {"_before": ts}).select((F.unix_seconds(ts) - F.unix_seconds("_before")).alias("gap"))
    median = blocks.quantiles(gaps, [], "gap", {"median_gap": 0.5})
    return median.withColumn(
        "step", F.when(F.col("median_gap") > 3600, DAY).when(F.col("median_gap") > 900, HOUR).otherwise(MINUTES_15)
    )


def ffill_limited(df: DataFrame, *, keys: Sequence[str], ts: str, value: str, limit: int = 3) -> DataFrame:
    """Forward fill over at most ``limit`` empty grid steps."""
    w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(-limit, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))


def bfill_limited(df: DataFrame, *, keys: Sequence[str], ts: str, value: str, limit: int = 3) -> DataFrame:
    """Backward fill over at most ``limit`` empty grid steps."""
    w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(0, limit)
    return df.withColumn(value, F.first(value, ignorenulls=True).over(w))


def drop_sparse_series(df: DataFrame, *, series: str, value: str, max_missing: float = 0.3, keys: Sequence[str] = ()) -> DataFrame:
    """Keep series whose share of empty grid cells is at most ``max_missing``."""
    kept = df.groupBy(*keys, series).agg(F.avg(F.col(value).isNull().cast("int")).alias("_missing")).filter(
        F.col("_missing") <= max_missing
    )
    return attach(df, kept.select(*keys, series), [*keys, series], "left_semi")


def complete_rows(df: DataFrame, *, ts: str, value: str, keys: Sequence[str] = (), how: str = "all") -> DataFrame:
    """Times at which all (or any) series of the grid have a value."""
    w = Window.partitionBy(*keys, ts)
    known, wanted = F.count(value).over(w), F.count(F.lit(1)).over(w)
    marked = df.withColumns({"_known": known, "_wanted": wanted})
    return marked.filter(F.col("_known") >= (F.col("_wanted") if how == "all" else F.lit(1))).drop("_known", "_wanted")


def min_obs_filter(df: DataFrame, *, series: str, value: str, more_than: int = 100) -> DataFrame:
    kept = df.groupBy(series).agg(F.count(value).alias("_n")).filter(F.col("_n") > more_than)
    return attach(df, kept.select(series), [series], "left_semi")


def pivot_wide(df: DataFrame, *, ts: str, series: str, value: str, names: Sequence[str], fill: float | None = None) -> DataFrame:
    """Mean pivot to one column per listed series."""
    wide = df.groupBy(ts).pivot(series, list(names)).agg(F.avg(value))
    return wide if fill is None else wide.na.fill(fill)


def pivot_two_level(df: DataFrame, *, ts: str, outer: str, inner: str, names: Sequence[str]) -> DataFrame:
    """Counts per (outer, inner) pair as columns ``outer_inner``, missing 0."""
    pairs = df.select(ts, F.concat_ws("_", outer, inner).alias("pair"))
    return pairs.groupBy(ts).pivot("pair", list(names)).count().na.fill(0)


def _ordered(keys: Sequence[str], ts: str):
    return Window.partitionBy(*keys).orderBy(ts)


def first_difference(df: DataFrame, *, keys: Sequence[str], ts: str, value: str, name: str = "diff") -> DataFrame:
    return df.withColumn(name, F.col(value) - F.lag(value).over(_ordered(keys, ts)))


def log_difference(df: DataFrame, *, keys: Sequence[str], ts: str, value: str, name: str = "log_diff") -> DataFrame:
    """Difference of logs where the whole series is positive, else plain difference."""
    positive = F.min(value).over(Window.partitionBy(*keys)) > 0
    logs = F.log(F.when(F.col(value) > 0, F.col(value)))
    d = df.withColumn("_log", logs)
    w = _ordered(keys, ts)
    return d.withColumn(
        name, F.when(positive, F.col("_log") - F.lag("_log").over(w)).otherwise(F.col(value) - F.lag(value).over(w))
    ).drop("_log")


def standardize(df: DataFrame, *, keys: Sequence[str], value: str, name: str = "z") -> DataFrame:
    """(x - mean) / sample std per series; the statistics are aggregated and joined back."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return attach(df, stats, keys).withColumn(name, (F.col(value) - F.col("_m")) / F.nullif("_s", F.lit(0.0))).drop("_m", "_s")
