"""Lead/lag networks between series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undertow.functions.tails import f_tail, t_tail
from undertow.operators import moments
from undertow.operators.joins import all_ordered_pairs
from undertow.session import attach, cut_lineage


def paired_bars(bars: DataFrame, *, series: str, ts: str, value: str, max_series: int = 2000) -> DataFrame:
    """Bars of every ordered pair of series at common times: (src, dst, ts, x, y).

    Works on bars (one row per series and step): the size is the size of the
    result, pairs x calendar, and the number of series is checked.
    """
    known = cut_lineage(bars.filter(F.col(value).isNotNull()).select(series, ts, value))  # small, and read three times
    pairs = all_ordered_pairs(known, key=series, max_series=max_series)
    x = known.select(F.col(series).alias("src"), F.col(ts).alias("ts"), F.col(value).alias("x"))
    y = known.select(F.col(series).alias("dst"), F.col(ts).alias("ts"), F.col(value).alias("y"))
    return pairs.join(x, "src").join(y, ["dst", "ts"])


def granger_pairwise(
    bars: DataFrame, *, series: str = "community", ts: str = "ts", value: str = "value", lag: int = 1, max_lags: int = 5
) -> DataFrame:
    """F test that ``lag`` lags of src improve the autoregression of dst, for every ordered pair.

    Pairs with fewer than 3 * max_lags common bars report F = 0, p = 1; pairs without a statistic (singular
    regression, or nothing left to explain) report NULL.
    """
    pairs = paired_bars(bars, series=series, ts=ts, value=value)
    design = moments.lag_design(pairs, keys=["src", "dst"], ts="ts", values=["x", "y"], lags=lag)
    lagged = [f"{v}_l{i}" for v in ("y", "x") for i in range(1, lag + 1)]
    vector = design.select("src", "dst", F.array(F.lit(1.0), *[F.col(c) for c in [*lagged, "y"]]).alias("v"))
    packed = moments.gram_packed(vector, keys=["src", "dst"], vector="v")
    last = 2 * lag + 1
    both = _residual_sums(packed, {"rss_r": range(0, 1 + lag), "rss_u": range(0, 1 + 2 * lag)}, last)
    free = F.col("n") - 2 * lag - 1
    sample = F.col("n") + lag
    short, solved = sample < 3 * max_lags, (free > 0) & (F.col("rss_u") > 0)
    f = ((F.col("rss_r") - F.col("rss_u")) / lag) / (F.col("rss_u") / free)
    out = both.select("src", "dst", F.lit(lag).alias("lag"), sample.alias("n"), F.when(short, 0.0).when(solved, f).alias("f_stat"), free.alias("_free"))
    p = F.when(F.col("f_stat") > 0, f_tail(F.col("f_stat"), F.lit(lag), F.col("_free"))).when(F.col("f_stat").isNotNull(), 1.0)
    return out.withColumn("p_value", p).drop("_free")


def _residual_sums(packed: DataFrame, designs: dict[str, range], y: int) -> DataFrame:
    """Residual sum of squares of column y on each named set of columns; NULL when singular."""

    def rss(row, xs):
        try:
            return float(moments.ols((row.n, np.asarray(row.means), moments.unpack(row.cells, y + 1)), xs, [y])[1][0, 0])
        except np.linalg.LinAlgError:
            return np.nan

    def solve(batches):
        for batch in batches:
            sums = {name: [rss(row, xs) for row in batch.itertuples(index=False)] for name, xs in designs.items()}
            yield pd.DataFrame({"src": batch["src"], "dst": batch["dst"], "n": batch["n"], **sums})

    out = packed.mapInPandas(solve, "src string, dst string, n long, " + ", ".join(f"{name} double" for name in designs))
    return out.withColumns({name: F.when(~F.isnan(name), F.col(name)) for name in designs})


def granger_edges(tests: DataFrame, *, alpha: float = 0.05) -> DataFrame:
    """Significant pairs; weight = F / (1 + p)."""
    return tests.filter(F.col("p_value") < alpha).withColumn("weight", F.col("f_stat") / (1 + F.col("p_value")))


TILE = 64  # series whose sums with 64 others make one matrix


def pair_correlations(bars: DataFrame, *, series: str, ts: str, value: str, lags: Sequence[int]) -> DataFrame:
    """Correlation of src at t - lag with dst at t for every ordered pair: (src, dst, lag, n, corr).

    Lags are steps of the calendar (all times at which any series has a bar), and every pair uses all the times that it
    has in common. Series are laid out in tiles; one row per time and tile holds whether each value is known, the value about
    its series' mean, and its square, so one moment matrix per lag and pair of tiles gives the sums of all their pairs:
    calendar times series^2 / 11 numbers instead of a table of pairs and times, for any number of series. Several bars of one
    series and time count as their mean; bars without a series or time are left out; a pair without spread in common, or
    without common times (n = 0), has a NULL coefficient.
    """
    bars = cut_lineage(bars.filter(F.col(series).isNotNull() & F.col(ts).isNotNull()).groupBy(series, ts).agg(F.avg(value).alias("_v")))
    means = bars.groupBy(series).agg(F.avg("_v").alias("_mean"))
    names = cut_lineage(means.withColumn("_at", F.row_number().over(Window.orderBy(series)) - 1))  # one row per series
    k = names.count()
    width = min(TILE, max(k, 1))
    steps = bars.select(ts).distinct().withColumn("_step", F.row_number().over(Window.orderBy(ts)))  # the calendar, not the data
    known = attach(attach(bars, names, [series]), steps, [ts]).select(
        "_step", F.floor(F.col("_at") / width).cast("int").alias("_tile"), (F.col("_at") % width).alias("_slot"), (F.col("_v") - F.col("_mean")).alias("_d")
    )
    rows = known.groupBy("_step", "_tile").agg(F.map_from_entries(F.collect_list(F.struct("_slot", "_d"))).alias("_cells"))
    cells = rows.select("_step", "_tile", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.element_at("_cells", i)).alias("_d"))
    parts = [lambda c: c.isNotNull().cast("double"), lambda c: F.coalesce(c, F.lit(0.0)), lambda c: F.coalesce(c * c, F.lit(0.0))]
    base = cut_lineage(cells.select("_step", "_tile", F.concat(*[F.transform("_d", part) for part in parts]).alias("_w")))
    y = base.select("_step", F.col("_tile").alias("_dst"), F.col("_w").alias("_y"))
    x = base.withColumn("lag", F.explode(F.array(*[F.lit(i) for i in lags]))).select(
        (F.col("_step") + F.col("lag")).alias("_step"), "lag", F.col("_tile").alias("_src"), F.col("_w").alias("_x")
    )
    met = x.join(y, "_step").select("lag", "_src", "_dst", F.concat("_x", "_y").alias("_w"))
    # a row of zeros for every pair of tiles, so that pairs that never meet have a result
    tiles = names.agg(F.array_sort(F.collect_set(F.floor(F.col("_at") / width).cast("int"))).alias("_tiles"))
    none = tiles.select("_tiles", F.explode("_tiles").alias("_src")).withColumn("_dst", F.explode("_tiles")).withColumn("lag", F.explode(F.array(*[F.lit(i) for i in lags])))
    none = none.select("lag", "_src", "_dst", F.array_repeat(F.lit(0.0), 6 * width).alias("_w"))
    packed = moments.gram_packed(met.unionByName(none), keys=["lag", "_src", "_dst"], vector="_w")

    def solve(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield _correlations(row, row[1], row[2], k, width)

    corr = packed.select("lag", F.col("_src").alias("src"), F.col("_dst").alias("dst"), "n", "means", "cells").mapInPandas(solve, "_src int, _dst int, lag int, n long, corr double")
    corr = corr.withColumn("corr", F.when(~F.isnan("corr"), F.col("corr")))
    for side, at in (("src", "_src"), ("dst", "_dst")):
        corr = attach(corr, names.select(F.col("_at").alias(at), F.col(series).alias(side)), [at])
    return corr.select("src", "dst", "lag", "n", "corr")


def _correlations(row, src: int, dst: int, k: int, width: int) -> pd.DataFrame:
    """Correlations of two tiles from sums over the times that both series have: (known, value, square) of x, then of y."""
    size = 3 * width
    sums = moments.products(row.n, np.asarray(row.means), moments.unpack(row.cells, 2 * size))
    g = sums[:size, size:].reshape(3, width, 3, width)
    # squares of each series over all times: rounding is relative to them
    all_x, all_y = (np.diag(sums[i : i + width, i + 2 * width : i + size]) for i in (0, size))
    n, y, yy = (g[0, :, p, :] for p in range(3))
    x, xy, xx = g[1, :, 0, :], g[1, :, 1, :], g[2, :, 0, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        vx, vy = xx - x * x / n, yy - y * y / n
        c = (xy - x * y / n) / np.sqrt(vx * vy)
        c[(n < 1.5) | (vx <= 1e-13 * all_x[:, None]) | (vy <= 1e-13 * all_y[None, :])] = np.nan
    a, b = np.meshgrid(src * width + np.arange(width), dst * width + np.arange(width), indexing="ij")
    here = (a < k) & (b < k) & (a != b)
    return pd.DataFrame({"_src": a[here], "_dst": b[here], "lag": row.lag, "n": n[here].round().astype("int64"), "corr": np.clip(c[here], -1, 1)})


def lagged_corr(bars: DataFrame, *, series: str, ts: str, value: str, max_lags: int = 5) -> DataFrame:
    """corr(src at t-l, dst at t) for every ordered pair and lag (see :func:`pair_correlations`), with its two-sided p."""
    corr = pair_correlations(bars, series=series, ts=ts, value=value, lags=range(1, max_lags + 1))
    free = F.col("n") - 2
    t = F.col("corr") * F.sqrt(free / F.nullif(1 - F.col("corr") * F.col("corr"), F.lit(0.0)))
    return corr.withColumn("p_value", F.when(free > 0, t_tail(t, free)))


def lagged_corr_score(correlations: DataFrame, *, alpha: float = 0.1) -> DataFrame:
    """Largest significant |corr| over the lags of each ordered pair; 0 when none is."""
    hit = F.when((F.col("p_value") < alpha), F.abs("corr"))
    return correlations.groupBy("src", "dst").agg(F.coalesce(F.max(hit), F.lit(0.0)).alias("score"))


def lagged_corr_network(scores: DataFrame, *, above: float = 0.1) -> DataFrame:
    return scores.filter(F.col("score") > above).withColumnRenamed("score", "weight")


def activity_nodes(filled: DataFrame, *, series: str, value: str) -> DataFrame:
    """Total and mean activity per node on the filled grid."""
    return filled.groupBy(series).agg(F.sum(value).cast("long").alias("total_posts"), F.avg(value).alias("avg_activity"))


def correlation_network(bars: DataFrame, *, series: str, ts: str, value: str, above: float = 0.3) -> DataFrame:
    """Edges in both directions where |corr| of two series over their common times exceeds the level."""
    both = pair_correlations(bars, series=series, ts=ts, value=value, lags=[0])
    return both.filter(F.abs("corr") > above).select("src", "dst", "corr", F.abs("corr").alias("weight"))


def causality_matrix(edges: DataFrame, nodes: DataFrame, *, key: str) -> DataFrame:
    """Every ordered pair of nodes with its weight, 0 where there is no edge."""
    return all_ordered_pairs(nodes, key=key).join(edges.select("src", "dst", "weight"), ["src", "dst"], "left").select(
        "src", "dst", F.coalesce("weight", F.lit(0.0)).alias("weight")
    )
