"""Rolling autoregressions from pane moments.

Overlapping windows are unions of *panes*, the rows between two window starts.  The moments of a pane - of levels, first
differences and their lags, lags reaching back into the pane before - are computed once and merged into every window that
holds the pane; only the first pane of a window is summed anew, without the rows whose lags would lie outside.  The
unit-root regressions of a window come from panes in the same way, and because levels and differences stand in one matrix, a
window picks the columns its own stationarity decisions ask for.

Spark cuts the positions of the panel into blocks of as many windows as a window has panes: a row is copied into two blocks at
most, a task sees two windows' worth of rows at a time whatever the length of the panel, and blocks are independent.
"""

from __future__ import annotations

from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.functions.tails import adf_p_value, kpss_p_value
from undertow.operators import blocks
from undertow.operators.moments import merge
from undertow.operators.stattests import unit_root

ADF_LAGS, MIN_OBS, ALPHA = 12, 50, 0.05


class Panes:
    """Moments of the rows of a matrix over any window that starts at a pane's edge; rows with NaN lie outside of every sample."""

    def __init__(self, rows: np.ndarray, width: int):
        self.rows, self.width, self.made = rows, width, {}

    def part(self, start: int, stop: int):
        v = self.rows[start:stop]
        mean = v.mean(axis=0)
        return len(v), mean, (v - mean).T @ (v - mean)

    def moments(self, start: int, stop: int, skip: int):
        """Moments of rows start + skip .. stop - 1."""
        first = start + skip
        edge = min(stop, -(-first // self.width) * self.width)
        parts = [self.part(first, edge)] if edge > first else []
        for k in range(edge // self.width, -(-stop // self.width)):
            a, b = k * self.width, min(stop, (k + 1) * self.width)
            if b - a < self.width:
                parts.append(self.part(a, b))
            else:
                if k not in self.made:
                    self.made[k] = self.part(a, b)
                parts.append(self.made[k])
        return merge(parts) if parts else None


def lagged(x: np.ndarray, lag: int) -> np.ndarray:
    out = np.full_like(x, np.nan)
    out[lag:] = x[: len(x) - lag]
    return out


def kpss_statistic(y: np.ndarray) -> float:
    """Level stationarity with the automatic lag, as :func:`undertow.operators.stattests.kpss_test`."""
    n, e = len(y), y - y.mean()
    s = np.cumsum(e)
    short = [float(e[i:] @ e[:-i]) for i in range(1, int(n ** (2 / 9)) + 1)]
    base = e @ e / n + sum(short) / (n / 2)
    if base == 0:
        return np.nan
    ratio = sum(i * r for i, r in enumerate(short, 1)) / (n / 2) / base
    lags = min(int(np.floor(1.1447 * (ratio * ratio) ** (1 / 3) * n ** (1 / 3))), n - 1)
    wide = np.r_[np.zeros(lags + 1), s, np.full(lags, s[-1])]  # differences of l + 1 steps, the ends included
    d = wide[lags + 1 :] - wide[: len(wide) - lags - 1]
    variance = d @ d / (n * (lags + 1))
    return float(s @ s / (n * n) / variance) if variance else np.nan


def solve_block(x: np.ndarray, names: list[str], first: int, ids: list[int], *, window: int, step: int, max_lags: int, fit) -> list[tuple]:
    """``fit(head, k, sample)`` of each window in ``ids``; ``x`` holds the panel from position ``first`` on."""
    k, width = x.shape[1], gcd(window, step)
    move = np.full_like(x, np.nan)
    move[1:] = np.diff(x, axis=0)
    roots = []
    for j in range(k):
        d = move[:, j]
        roots.append(Panes(np.column_stack([np.ones(len(x)), lagged(x[:, j], 1), *[lagged(d, i) for i in range(1, ADF_LAGS + 1)], d]), width))
    # [1, then for each lag 0..max_lags all levels and all differences]
    whole = Panes(np.column_stack([np.ones(len(x)), *[c for i in range(max_lags + 1) for c in (lagged(x, i), lagged(move, i))]]), width)
    out = []
    for w in ids:
        start = w * step - first
        stop = start + window
        changed = []
        for j in range(k):
            keeps = False
            if window >= MIN_OBS:
                tau = unit_root(lambda p, j=j: roots[j].moments(start, stop, p + 1), ADF_LAGS)[2]
                keeps = adf_p_value(tau) < ALPHA and kpss_p_value(kpss_statistic(x[start:stop, j])) > ALPHA
            changed.append(not keeps)
        lost = int(any(changed))
        n_rows = window - lost
        p_max = 1 if n_rows < 100 or k > 10 else min(max_lags, max(1, (n_rows - 20) // (5 * k)))
        at = lambda i: [1 + 2 * k * i + k * c + j for j, c in enumerate(changed)]
        columns = [0, *[c for i in range(1, p_max + 1) for c in at(i)], *at(0)]

        def sample(p):
            part = whole.moments(start, stop, p + lost)
            if part is None:
                raise np.linalg.LinAlgError("too few rows for the order")
            return part[0], part[1][columns], part[2][np.ix_(columns, columns)]

        out.append(fit((w, names, n_rows, p_max), k, sample))
    return out


def rolling_fits(panel: DataFrame, *, window: int, step: int, max_lags: int, fit, schema: str) -> DataFrame:
    """One fitted model (a row of ``schema``) and its end date per window of the complete panel (ts, series, value).

    Window w holds positions w * step .. w * step + window - 1; it exists while w * step + window < n, and only if n >= window + 50.
    """
    rows = panel.groupBy("ts").agg(F.array_sort(F.collect_list(F.struct("series", F.col("value").cast("double").alias("value")))).alias("_c"))
    numbered = blocks.positions(rows, [], ["ts"], name="_pos").withColumn("_at", F.col("_pos") - 1)
    total = rows.agg(F.count(F.lit(1))).scalar()
    size = -(-window // step)  # windows of a block
    windows = F.floor((F.col("_n") - window - 1) / step) + 1
    last = F.least(F.floor(F.col("_at") / step), windows - 1)
    first = F.greatest(F.lit(0), F.ceil((F.col("_at") - (window - 1)) / step))
    here = numbered.withColumn("_n", total).filter(F.col("_n") >= window + 50).withColumns({"_first": first, "_last": last}).filter("_last >= _first")
    block = F.explode(F.sequence(F.floor(F.col("_first") / size).cast("long"), F.floor(F.col("_last") / size).cast("long")))
    spread = here.select(
        block.alias("block"), "_at", "ts", windows.cast("long").alias("windows"), F.transform("_c", lambda c: c["series"]).alias("names"), F.transform("_c", lambda c: c["value"]).alias("y")
    )

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_at")
        b, n, start = int(group["block"].iloc[0]), int(group["windows"].iloc[0]), int(group["_at"].iloc[0])
        ids = list(range(b * size, min(n, (b + 1) * size)))
        made = solve_block(np.vstack(group["y"].to_numpy()), list(group["names"].iloc[0]), start, ids, window=window, step=step, max_lags=max_lags, fit=fit)
        ts = group["ts"].to_numpy()
        out = pd.DataFrame(made, columns=[c.split()[0] for c in schema.split(", ")])
        return out.assign(date=[ts[w * step + window - 1 - start] for w in ids])

    return spread.groupBy("block").applyInPandas(solve, f"{schema}, date {dict(panel.dtypes)['ts']}")
