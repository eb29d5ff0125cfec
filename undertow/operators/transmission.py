"""Vector autoregressions and variance-decomposition tables, for many windows at once.

Everything is keyed by ``window_id``: the static analysis is one window, the
rolling analysis many.  Rows are lagged and multiplied out inside Spark; one
packed moment matrix per window and sample edge is all that is solved in NumPy.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undertow.functions import varmath
from undertow.operators import blocks, grid, moments, panes, stattests
from undertow.session import cut_lineage

SEPARATOR = "\u0001"  # between series names while they serve as a key
MAX_DIMENSION = 2000  # k * p: a matrix of 128 MB in one task; beyond it a window reports the reason


def var_panel(df: DataFrame, *, series: str, ts: str, value: str, step: int) -> DataFrame:
    """Mean pivot to the grid, limited fills, sparse series dropped, complete times only: long (ts, series, value)."""
    g = grid.resample_mean(df, series=series, ts=ts, value=value, step=step)
    g = grid.ffill_limited(g, keys=[series], ts=ts, value=value, limit=3)
    g = grid.bfill_limited(g, keys=[series], ts=ts, value=value, limit=3)
    g = grid.drop_sparse_series(g, series=series, value=value)
    return grid.complete_rows(g, ts=ts, value=value).select(
        F.col(ts).alias("ts"), F.col(series).alias("series"), F.col(value).alias("value")
    )


def var_panel_adaptive(df: DataFrame, *, series: str, ts: str, value: str) -> DataFrame:
    """Grid step from the median gap, fill of 5, times where any series is known."""
    step = grid.infer_frequency(df, ts=ts).first()["step"]
    g = grid.resample_mean(df, series=series, ts=ts, value=value, step=step)
    g = grid.ffill_limited(g, keys=[series], ts=ts, value=value, limit=5)
    return grid.complete_rows(g, ts=ts, value=value, how="any").select(
        F.col(ts).alias("ts"), F.col(series).alias("series"), F.col(value).alias("value")
    )


def whole_window(panel: DataFrame) -> DataFrame:
    """The panel as a single window."""
    return panel.withColumn("window_id", F.lit(0).cast("long"))


def rolling_windows(panel: DataFrame, *, window: int = 252, step: int = 21) -> DataFrame:
    """Window membership by row position: window w holds positions w*step+1 .. w*step+window.

    A window exists while w*step + window < n, and only if n >= window + 50.
    Each row is copied into at most ceil(window/step) windows.
    """
    times = panel.select("ts").distinct()
    numbered = blocks.positions(times, [], ["ts"], name="_pos").select("ts", (F.col("_pos") - 1).alias("_at"))
    total = times.agg(F.count(F.lit(1))).scalar()
    tagged = numbered.withColumn("_n", total)
    first = F.greatest(F.lit(0), F.ceil((F.col("_at") - (window - 1)) / step))
    last = F.least(F.floor(F.col("_at") / step), F.floor((F.col("_n") - window - 1) / step))
    members = (
        tagged.filter((F.col("_n") >= window + 50))
        .withColumn("_first", first)
        .withColumn("_last", last)
        .filter("_last >= _first")
        .select("ts", F.explode(F.sequence("_first", "_last")).alias("window_id"))
        .select("ts", F.col("window_id").cast("long"))
    )
    return panel.join(members, "ts")


def lag_cap(n: Column, k: Column, max_lags: int) -> Column:
    """1 for short or wide panels, else what the sample allows."""
    fit = F.least(F.lit(max_lags), F.greatest(F.lit(1), F.floor((n - 20) / (5 * k))))
    return F.when((n < 100) | (k > 10), 1).otherwise(fit).cast("int")


def var_lag_cap(windows: DataFrame, *, max_lags: int = 10) -> DataFrame:
    size = windows.groupBy("window_id").agg(F.countDistinct("ts").alias("n"), F.countDistinct("series").alias("k"))
    return size.withColumn("p_max", lag_cap(F.col("n"), F.col("k"), max_lags))


def make_stationary(windows: DataFrame, decision: DataFrame | None = None, *, method: str = "first_difference") -> DataFrame:
    """Transform every series that was not judged stationary, then keep complete times."""
    keys = ["window_id", "series"]
    if decision is None:
        windows = cut_lineage(windows)
        decision = stattests.stationarity_decision(windows, keys=keys, ts="ts", value="value")
    judged = windows.join(decision.select(*keys, "decision"), keys)
    if method == "first_difference":
        changed = grid.first_difference(judged, keys=keys, ts="ts", value="value", name="_x")
    elif method == "log_difference":
        changed = grid.log_difference(judged, keys=keys, ts="ts", value="value", name="_x")
    elif method == "standardize":
        changed = grid.standardize(judged, keys=keys, value="value", name="_x")
    else:
        raise ValueError(f"unknown transformation {method}")
    chosen = changed.select(
        "window_id", "series", "ts", F.when(F.col("decision") == "stationary", F.col("value")).otherwise(F.col("_x")).alias("value")
    )
    return grid.complete_rows(chosen, ts="ts", value="value", keys=["window_id"])


def var_moments(windows: DataFrame, *, max_lags: int) -> DataFrame:
    """Packed moments of [1, lags, y] per window and sample edge.

    ``edge`` = min(position, p_max + 1): the rows that only shorter orders may
    use keep matrices of their own, so every order gets its exact sample.
    """
    w = Window.partitionBy("window_id").orderBy("ts")
    rows = windows.groupBy("window_id", "ts").agg(F.array_sort(F.collect_list(F.struct("series", "value"))).alias("_c"))
    base = rows.select(
        "window_id", "ts", F.transform("_c", lambda c: c["value"]).alias("y"), F.transform("_c", lambda c: c["series"]).alias("names")
    )
    sized = base.withColumns({"pos": F.row_number().over(w), "n_rows": F.count(F.lit(1)).over(Window.partitionBy("window_id")), "k": F.size("y")})
    capped = sized.withColumn("p_max", lag_cap(F.col("n_rows"), F.col("k"), max_lags))
    zero = F.transform("y", lambda x: F.lit(0.0))
    lags = [F.coalesce(F.lag("y", i).over(w), zero) for i in range(1, max_lags + 1)]
    design = capped.withColumn("_lags", F.array(*lags)).select(
        "window_id", F.array_join("names", SEPARATOR).alias("names"), "n_rows", "k", "p_max",
        F.least("pos", F.col("p_max") + 1).alias("edge"),
        F.concat(F.array(F.lit(1.0)), F.flatten(F.slice("_lags", 1, F.col("p_max"))), "y").alias("v"),
    )
    packed = moments.gram_packed(design, keys=["window_id", "names", "n_rows", "k", "p_max", "edge"], vector="v")
    return (
        packed.groupBy("window_id", "names", "n_rows", "k", "p_max")
        .agg(F.array_sort(F.collect_list(F.struct("edge", "n", "means", "cells"))).alias("edges"))  # at most p_max + 1 entries
        .withColumn("names", F.split("names", SEPARATOR))
    )


FIT = (
    "window_id long, names array<string>, n_rows long, p_max int, p int, reason string, intercept array<double>, "
    "lags array<double>, sigma array<double>, radius double, theta array<double>, horizon int"
)


def var_fit(
    moments_df: DataFrame, *, criterion: str = "bic", horizon: int = 10, method: str = "cholesky", order: int | None = None
) -> DataFrame:
    """One fitted model per window; a window that cannot be fitted carries a reason."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(
                [_fit_window(r, criterion, horizon, method, order) for r in batch.itertuples(index=False)],
                columns=[c.split()[0] for c in FIT.split(", ")],
            )

    return moments_df.mapInPandas(solve, FIT)


def _fit_window(row, criterion: str, horizon: int, method: str, order: int | None):
    k, p_max = int(row.k), int(row.p_max)
    d = 1 + k * p_max + k
    edges = [(e["edge"], (e["n"], np.asarray(e["means"]), moments.unpack(e["cells"], d))) for e in row.edges] if k * p_max <= MAX_DIMENSION else []

    def sample(p):
        return moments.merge([part for e, part in edges if e >= p + 1])

    return fit_sample((row.window_id, list(row.names), row.n_rows, p_max), k, sample, criterion, horizon, method, order)


def fit_sample(head: tuple, k: int, sample, criterion: str, horizon: int, method: str, order: int | None = None) -> tuple:
    """A row of ``FIT`` from ``sample(p)``: moments of [1, lags 1..p_max, y] over the rows that order p allows."""
    _, _, n_rows, p_max = head
    empty = (None, None, None, None, None, horizon)
    if k < 2:
        return (*head, 0, "needs two series", *empty)
    if k * p_max > MAX_DIMENSION:
        return (*head, 0, "too many series times lags", *empty)
    if n_rows < 5:
        return (*head, 0, "too few rows", *empty)
    p, reason = order or 1, None
    try:
        if order is None and n_rows >= 30:
            p = varmath.select_order(sample(p_max), k, p_max, criterion)
            if p == 0:
                p, reason = 1, "order 0 raised to 1"
        intercept, lags, sigma = varmath.fit(sample(p), k, p, p_max)
        theta = varmath.decompose(varmath.moving_average(lags, horizon), sigma, method)
        radius = varmath.companion_radius(lags)
    except np.linalg.LinAlgError as error:
        return (*head, p, f"singular: {error}", *empty)
    return (*head, p, reason, intercept.tolist(), lags.ravel().tolist(), sigma.ravel().tolist(), radius, theta.ravel().tolist(), horizon)


def analyse(windows: DataFrame, *, max_lags: int = 10, horizon: int = 10, method: str = "cholesky", criterion: str = "bic") -> DataFrame:
    """Stationarity, order, fit and decomposition of every window."""
    return var_fit(var_moments(make_stationary(windows), max_lags=max_lags), horizon=horizon, method=method, criterion=criterion)


def theta_table(fits: DataFrame) -> DataFrame:
    """Long shares (window_id, h, to_series, from_series, theta); h = 1..horizon."""
    k = F.size("names")
    long = fits.filter("theta is not null").select("window_id", "names", F.posexplode("theta").alias("i", "theta"), k.alias("k"))
    cell = F.col("i") % (F.col("k") * F.col("k"))
    return long.select(
        "window_id",
        (F.floor(F.col("i") / (F.col("k") * F.col("k"))) + 1).cast("int").alias("h"),
        F.get("names", F.floor(cell / F.col("k")).cast("int")).alias("to_series"),
        F.get("names", (cell % F.col("k")).cast("int")).alias("from_series"),
        "theta",
    )


def last_horizon(theta: DataFrame) -> DataFrame:
    top = theta.groupBy("window_id").agg(F.max("h").alias("h"))
    return theta.join(top, ["window_id", "h"], "left_semi")


def spill_total(theta: DataFrame) -> DataFrame:
    """100 x off-diagonal share of one horizon's table."""
    off = F.sum(F.when(F.col("to_series") != F.col("from_series"), F.col("theta")))
    return theta.groupBy("window_id").agg((100 * off / F.sum("theta")).alias("total"))


def spill_directional(theta: DataFrame) -> DataFrame:
    """Per series: sent to others (column sum) and received from others (row sum), in percent of the table."""
    size = theta.groupBy("window_id").agg(F.sum("theta").alias("_all"))
    off = F.when(F.col("to_series") != F.col("from_series"), F.col("theta")).otherwise(0.0)
    sent = theta.groupBy("window_id", F.col("from_series").alias("series")).agg(F.sum(off).alias("_s"))
    received = theta.groupBy("window_id", F.col("to_series").alias("series")).agg(F.sum(off).alias("_r"))
    return sent.join(received, ["window_id", "series"]).join(size, "window_id").select(
        "window_id", "series", (100 * F.col("_s") / F.col("_all")).alias("sent"), (100 * F.col("_r") / F.col("_all")).alias("received")
    )


def spill_net(theta: DataFrame) -> DataFrame:
    return spill_directional(theta).withColumn("net", F.col("sent") - F.col("received"))


def spill_pairwise(theta: DataFrame) -> DataFrame:
    """Net effect of src on dst: (theta[dst, src] - theta[src, dst]) / sum * 100."""
    size = theta.groupBy("window_id").agg(F.sum("theta").alias("_all"))
    out = theta.select("window_id", F.col("from_series").alias("src"), F.col("to_series").alias("dst"), F.col("theta").alias("_out"))
    back = theta.select("window_id", F.col("to_series").alias("src"), F.col("from_series").alias("dst"), F.col("theta").alias("_in"))
    return out.join(back, ["window_id", "src", "dst"]).join(size, "window_id").select(
        "window_id", "src", "dst", ((F.col("_out") - F.col("_in")) / F.col("_all") * 100).alias("net")
    )


def spill_table(theta: DataFrame) -> DataFrame:
    """Long table: shares in percent, FROM_others column, TO_others and Net rows."""
    net = spill_net(theta)
    cells = theta.select("window_id", F.col("to_series").alias("row"), F.col("from_series").alias("col"), (100 * F.col("theta")).alias("value"))
    return (
        cells.unionByName(net.select("window_id", F.col("series").alias("row"), F.lit("FROM_others").alias("col"), F.col("received").alias("value")))
        .unionByName(net.select("window_id", F.lit("TO_others").alias("row"), F.col("series").alias("col"), F.col("sent").alias("value")))
        .unionByName(
            spill_total(theta).select("window_id", F.lit("TO_others").alias("row"), F.lit("FROM_others").alias("col"), F.col("total").alias("value"))
        )
        .unionByName(net.select("window_id", F.lit("Net").alias("row"), F.col("series").alias("col"), F.col("net").alias("value")))
    )


def rolling_spillover(panel: DataFrame, *, window: int = 252, step: int = 21, horizon: int = 10, method: str = "cholesky") -> DataFrame:
    """Per window: end date, total and net effects; a failed window keeps its reason.

    Windows share the moments of their panes (:mod:`undertow.operators.panes`); a row is copied into two blocks at most.
    """
    fit = partial(fit_sample, criterion="bic", horizon=horizon, method=method)
    fits = cut_lineage(panes.rolling_fits(panel, window=window, step=step, max_lags=min(10, window // 20), fit=fit, schema=FIT))
    theta = last_horizon(theta_table(fits))
    net = spill_net(theta).groupBy("window_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("series", "net")))).alias("net"))
    return (
        fits.select("window_id", "date", "p", "reason", "radius")
        .join(spill_total(theta), "window_id", "left")
        .join(net, "window_id", "left")
    )


def param_sweep(bars: DataFrame, *, series: str, ts: str, value: str, windows: list[int]) -> DataFrame:
    """Per window size: mean over windows of the mean cross-sectional spread, and strength / (1 + std)."""
    level = bars.groupBy(ts).agg(F.stddev_samp(value).alias("d"))
    at = Window.orderBy(ts)  # one row per time
    numbered = level.withColumn("_at", F.row_number().over(at))
    made = numbered.select(
        "_at",
        *[F.avg("d").over(at.rowsBetween(-w, -1)).alias(f"w{w}") for w in windows],
    )
    long = made.unpivot(["_at"], [f"w{w}" for w in windows], "name", "strength").withColumn(
        "window", F.substring("name", 2, 10).cast("int")
    )
    return (
        long.filter(F.col("_at") > F.col("window"))
        .groupBy("window")
        .agg(F.avg("strength").alias("strength"), F.stddev_pop("strength").alias("spread"))
        .withColumn("objective", F.col("strength") / (1 + F.col("spread")))
    )


def ma_table(fits: DataFrame) -> DataFrame:
    """Moving-average matrices of two-series, one-lag fits as columns f11..f22 per horizon."""
    cell = F.concat(F.lit("f"), (F.col("i") + 1).cast("string"), (F.col("j") + 1).cast("string"))
    return ma_long(fits).withColumn("cell", cell).groupBy("h").pivot("cell", ["f11", "f12", "f21", "f22"]).agg(F.max("phi"))


def ma_long(fits: DataFrame) -> DataFrame:
    """Phi_h[i, j] of every fitted window: (window_id, h, i, j, phi)."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                k = len(r.names)
                phi = varmath.moving_average(np.asarray(r.lags).reshape(-1, k, k), r.horizon)
                rows += [(r.window_id, h, i, j, phi[h, i, j]) for h in range(r.horizon) for i in range(k) for j in range(k)]
            yield pd.DataFrame(rows, columns=["window_id", "h", "i", "j", "phi"])

    fitted = fits.filter("lags is not null").select("window_id", "names", "lags", "horizon")
    return fitted.mapInPandas(solve, "window_id long, h int, i int, j int, phi double")


def residuals(stationary: DataFrame, fits: DataFrame) -> DataFrame:
    """Residuals of every equation: (window_id, series, ts, residual).

    The fit is one row per window; predictions are array expressions on the
    lagged rows, so no Python runs over the data.
    """
    w = Window.partitionBy("window_id").orderBy("ts")
    rows = stationary.groupBy("window_id", "ts").agg(F.array_sort(F.collect_list(F.struct("series", "value"))).alias("_c"))
    base = rows.select("window_id", "ts", F.transform("_c", lambda c: c["value"]).alias("y"))
    most = fits.agg(F.max("p")).first()[0] or 1
    lagged = base.select("*", F.array(*[F.lag("y", i).over(w) for i in range(1, most + 1)]).alias("_lags"))
    joined = lagged.join(fits.filter("lags is not null").select("window_id", "names", "p", "intercept", "lags"), "window_id")
    x = F.flatten(F.slice("_lags", 1, F.col("p")))
    k = F.size("names")
    known = joined.withColumns({"_x": x, "_k": k}).filter(F.col("_x").isNotNull())

    def predicted(j):
        # Row j of each lag matrix, in lag order: lags are stored as (p, k, k).
        row = F.flatten(F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda i: F.slice("lags", (i * F.col("_k") * F.col("_k") + j * F.col("_k") + 1).cast("int"), F.col("_k"))))
        return F.get("intercept", j) + F.aggregate(F.zip_with(row, "_x", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

    each = known.select(
        "window_id", "ts",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda j: F.struct(F.get("names", j).alias("series"), (F.get("y", j) - predicted(j)).alias("residual")))).alias("r"),
    )
    return each.select("window_id", "r.series", "ts", "r.residual")


def residual_tests(windows: DataFrame, *, max_lags: int = 10, criterion: str = "aic") -> DataFrame:
    """Autocorrelation test of every residual series beside the stability of its model."""
    stationary = cut_lineage(make_stationary(windows))
    fits = cut_lineage(var_fit(var_moments(stationary, max_lags=max_lags), criterion=criterion))
    tested = stattests.ljung_box(residuals(stationary, fits), keys=["window_id", "series"], ts="ts", value="residual")
    stable = fits.select("window_id", "p", F.when(F.col("radius") < 1, "PASS").otherwise("WARNING").alias("stability"))
    return tested.join(stable, "window_id")
