"""Panel features: lags, rolling statistics, targets, cumulative paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undertow.operators import blocks
from undertow.session import attach


def by_series(keys: Sequence[str], order: str):
    """Ordered window over bars: at most one row per series and calendar step."""
    return Window.partitionBy(*keys).orderBy(order)


def lag_lead(df: DataFrame, value: str, *, keys: Sequence[str], order: str) -> DataFrame:
    w = by_series(keys, order)
    return df.withColumns({f"prev_{value}": F.lag(value).over(w), f"next_{value}": F.lead(value).over(w)})


def price_direction_change(df: DataFrame, *, price: str = "price", keys: Sequence[str] = ("symbol",), order: str = "day") -> DataFrame:
    """Sign of the next move (0 at the end) and change against the previous price."""
    d = lag_lead(df, price, keys=keys, order=order)
    p, prev, nxt = F.col(price), F.col(f"prev_{price}"), F.col(f"next_{price}")
    return d.withColumns(
        {
            "price_direction": F.when(nxt > p, 1).when(nxt < p, -1).otherwise(0),
            "price_change": F.when(prev > 0, (p - prev) / prev).otherwise(0.0),
        }
    )


def full(expression: Column, value: str, frame, n: int) -> Column:
    """The expression once the frame holds ``n`` values, else NULL."""
    return F.when(F.count(value).over(frame) >= n, expression)


def corrected_skew(value: str, frame) -> Column:
    """Bias-corrected skewness, NULL below three values or without spread."""
    n = F.count(value).over(frame).cast("double")
    g = F.skewness(value).over(frame)
    spread = F.max(value).over(frame) > F.min(value).over(frame)
    return F.when((n >= 3) & spread, g * F.sqrt(n * (n - 1)) / (n - 2))


def excess_kurtosis(value: str, frame) -> Column:
    n = F.count(value).over(frame)
    spread = F.max(value).over(frame) > F.min(value).over(frame)
    return F.when((n > 3) & spread, F.kurtosis(value).over(frame))


def _moments(value: str, frame, tag: str) -> dict[str, Column]:
    return {
        f"mean_{tag}": F.avg(value).over(frame),
        f"std_{tag}": F.when(F.count(value).over(frame) > 1, F.stddev_samp(value).over(frame)),
        f"skew_{tag}": corrected_skew(value, frame),
        f"kurt_{tag}": excess_kurtosis(value, frame),
    }


def rolling_stats_rows(
    df: DataFrame, value: str, *, keys: Sequence[str], order: Sequence[str], block: Column | None = None, widths: Sequence[int] = (1, 6, 24)
) -> DataFrame:
    """Mean, std, corrected skew and excess kurtosis over the last w rows, for any series length."""

    def columns(frame):
        made = {}
        for w in widths:
            made.update(_moments(value, frame(-(w - 1), 0), f"{w}"))
        return made

    return blocks.over_rows(df, keys, order, columns, block=block, back=max(widths) - 1)


def rolling_stats_time(
    df: DataFrame, value: str, *, keys: Sequence[str], ts: str, hours: Sequence[int] = (1, 6, 24), block=None
) -> DataFrame:
    """The same over true time frames of any width: a frame that holds a billion rows costs no more than one of ten."""
    tags = {f"{h}h": h * 3600 for h in hours}
    frames = blocks.time_moments(df, keys, ts, value, tags, block)
    made = {}
    for tag in tags:
        n, mean, m2, m3, m4, low, high = (F.col(f"{name}_{tag}") for name in ("n", "mean", "m2", "m3", "m4", "low", "high"))
        m2 = F.greatest(m2, F.lit(0.0))
        spread = (high > low) & (m2 > 0)
        made[f"mean_{tag}"] = F.when(n > 0, mean)
        made[f"std_{tag}"] = F.when(n > 1, F.sqrt(m2 / (n - 1)) * F.when(high > low, 1.0).otherwise(0.0))
        made[f"skew_{tag}"] = F.when((n >= 3) & spread, (m3 / n) / F.pow(m2 / n, 1.5) * F.sqrt(n * (n - 1)) / (n - 2))
        made[f"kurt_{tag}"] = F.when((n > 3) & spread, n * m4 / (m2 * m2) - 3)
    return frames.select(*df.columns, *[c.alias(name) for name, c in made.items()])


def rolling_vwap(
    df: DataFrame, value: str, weight: str, *, keys: Sequence[str], order: Sequence[str], block: Column | None = None, widths: Sequence[int] = (1, 6, 24)
) -> DataFrame:
    """Weighted rolling mean; 0 while no weight is known."""

    def columns(frame):
        made = {}
        for w in widths:
            f = frame(-(w - 1), 0)
            total = F.sum(F.when(F.col(value).isNotNull(), F.col(weight))).over(f)
            made[f"vw_{w}"] = F.coalesce(F.sum(F.col(value) * F.col(weight)).over(f) / F.nullif(total.cast("double"), F.lit(0.0)), F.lit(0.0))
        return made

    return blocks.over_rows(df, keys, order, columns, block=block, back=max(widths) - 1)


def rolling_counts(df: DataFrame, *, keys: Sequence[str], order: Sequence[str], block: Column | None = None, widths: Sequence[int] = (1, 6, 24)) -> DataFrame:
    """Rows in the last w rows, and rows so far."""
    return blocks.over_rows(
        df, keys, order, lambda frame: {f"count_{w}": F.count(F.lit(1)).over(frame(-(w - 1), 0)) for w in widths},
        block=block, back=max(widths) - 1, keep_position=True,
    ).withColumnRenamed("pos", "count_all")


def rolling_ratio(
    df: DataFrame, flags: Sequence[str], *, keys: Sequence[str], order: Sequence[str], block: Column | None = None, width: int = 24
) -> DataFrame:
    """Rolling share of each flag."""
    return blocks.over_rows(
        df, keys, order,
        lambda frame: {f"{f}_ratio": F.avg(F.col(f).cast("int")).over(frame(-(width - 1), 0)) for f in flags},
        block=block, back=width - 1,
    )


def moving_average(df: DataFrame, value: str, *, keys: Sequence[str], order: str, widths: Sequence[int] = (3, 7)) -> DataFrame:
    """Moving averages that need a full window."""
    w = by_series(keys, order)
    return df.withColumns(
        {f"ma_{n}": full(F.avg(value).over(w.rowsBetween(-(n - 1), 0)), value, w.rowsBetween(-(n - 1), 0), n) for n in widths}
    )


def pct_change(df: DataFrame, value: str, *, keys: Sequence[str], order: str, name: str = "pct") -> DataFrame:
    return df.withColumn(name, F.col(value) / F.lag(value).over(by_series(keys, order)) - 1)


def rolling_volatility(df: DataFrame, value: str, *, keys: Sequence[str], order: str, width: int = 5) -> DataFrame:
    f = by_series(keys, order).rowsBetween(-(width - 1), 0)
    return df.withColumn(f"vol_{width}", full(F.stddev_samp(value).over(f), value, f, width))


def volume_share_weight(df: DataFrame, value: str, volume: str, *, keys: Sequence[str], name: str = "weighted") -> DataFrame:
    """Value times the row's share in its community's volume; totals are joined, not windowed."""
    totals = df.groupBy(*keys).agg(F.sum(volume).alias("_total"))
    return attach(df, totals, keys).withColumn(name, F.col(value) * F.col(volume) / F.col("_total")).drop("_total")


def cross_section_mean_corr(df: DataFrame, value: str, *, key: str, ts: str) -> DataFrame:
    """Correlation of every series with the mean over all series at the same time."""
    means = df.groupBy(ts).agg(F.avg(value).alias("_mean"))
    return df.join(means, ts).groupBy(key).agg(F.corr(value, "_mean").alias("corr_with_mean"))


def targets_next(df: DataFrame, value: str, *, keys: Sequence[str], order: str) -> DataFrame:
    nxt = F.lead(value).over(by_series(keys, order))
    return df.withColumns({"next_value": nxt, "next_change": nxt - F.col(value)})


def targets_return(df: DataFrame, price: str, *, keys: Sequence[str], order: str, threshold: float = 0.001) -> DataFrame:
    """Next-period return inside the symbol and its direction (0 at the end)."""
    ret = F.lead(price).over(by_series(keys, order)) / F.col(price) - 1
    d = df.withColumn("next_return", ret)
    return d.withColumn(
        "next_direction",
        F.when(F.col("next_return") > threshold, 1).when(F.col("next_return") < -threshold, -1).otherwise(0),
    )


def sequence_windows(
    df: DataFrame, features: Sequence[str], target: str, *, keys: Sequence[str], order: str, length: int, horizon: int
) -> DataFrame:
    """Sliding windows of ``length`` feature rows and the next ``horizon`` targets.

    NULL becomes 0.  A series too short for one window gives one partial window.
    The frames are bounded, so a row never holds more than length + horizon rows.
    """
    w = by_series(keys, order)
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    row = F.array(*[zero(f) for f in features])
    made = df.select(
        *keys,
        F.col(order),
        F.collect_list(row).over(w.rowsBetween(-(length - 1), 0)).alias("window"),
        F.collect_list(zero(target)).over(w.rowsBetween(1, horizon)).alias("targets"),
        F.row_number().over(w).alias("_pos"),
        F.lead(F.lit(1), 1).over(w).isNull().alias("_end"),
    )
    whole = (F.size("window") == length) & (F.size("targets") == horizon)
    partial = F.col("_end") & (F.col("_pos") < length + horizon)
    return made.filter(whole | partial).select(
        *keys, F.col(order).alias("window_end"), "window", "targets"
    )


def cumulative_return(df: DataFrame, ret: str, *, keys: Sequence[str], order: str) -> DataFrame:
    """Growth of 1, its running maximum and the drawdown from it."""
    w = by_series(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("growth", F.exp(F.sum(F.log1p(ret)).over(w)))
    d = d.withColumn("peak", F.max("growth").over(w))
    return d.withColumn("drawdown", (F.col("growth") - F.col("peak")) / F.col("peak"))


def rolling_performance(df: DataFrame, ret: str, *, keys: Sequence[str], order: str, window: int = 252, periods: int = 252) -> DataFrame:
    """Rolling Sharpe, volatility and mean return, annualised; full windows only."""
    f = by_series(keys, order).rowsBetween(-(window - 1), 0)
    mean, std = F.avg(ret).over(f), F.stddev_samp(ret).over(f)
    root = float(periods) ** 0.5
    return df.withColumns(
        {
            "roll_sharpe": full(mean / F.nullif(std, F.lit(0.0)) * root, ret, f, window),
            "roll_vol": full(std * root, ret, f, window),
            "roll_return": full(mean * periods, ret, f, window),
        }
    )


def cross_section_dispersion(df: DataFrame, value: str, *, ts: str) -> DataFrame:
    return df.groupBy(ts).agg(F.stddev_samp(value).alias("dispersion"), F.avg(value).alias("level"))


def autocorr_lag1(df: DataFrame, value: str, *, keys: Sequence[str], order: str, limit: float = 0.3) -> DataFrame:
    lagged = df.withColumn("_lag", F.lag(value).over(by_series(keys, order)))
    return lagged.groupBy(*keys).agg(F.corr(value, "_lag").alias("autocorr")).withColumn(
        "autocorrelated", (F.abs("autocorr") > limit).cast("int")
    )
