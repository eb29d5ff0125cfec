"""Statistical tests per group, as rows of results.

Series here are bars or daily returns (one row per series and calendar step).
Sums run over all rows in Spark; pandas functions see one small summary row per
group, and p-values are taken over the result rows only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from hashlib import md5
from math import ceil, exp
from operator import and_
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undertow.functions import tails
from undertow.functions.tails import t_two_sided
from undertow.operators import blocks, moments
from undertow.session import attach, configured, cut_lineage, match, stash


def _ordered(keys: Sequence[str], ts: str):
    return Window.partitionBy(*keys).orderBy(ts)


def verdict(passed: Column) -> Column:
    return F.when(passed, "PASS").when(~passed, "FAIL")


# --- unit roots and stationarity -------------------------------------------


def adf_test(
    df: DataFrame, *, keys: Sequence[str], ts: str, value: str, max_lag: int = 12, criterion: str | None = "bic", alpha: float = 0.05
) -> DataFrame:
    """Unit-root regression of the difference on 1, the level and lagged differences.

    ``criterion`` picks the lag on the common sample and the regression is then
    refitted on every row that lag allows; None uses ``max_lag`` itself.
    """
    keys = list(keys)
    w = _ordered(keys, ts)
    known = df.filter(F.col(value).isNotNull())
    diff = known.select(
        *keys, ts, F.row_number().over(w).alias("_pos"), F.lag(value).over(w).alias("_y1"), (F.col(value) - F.lag(value).over(w)).alias("_d")
    )
    lags = [F.coalesce(F.lag("_d", i).over(w), F.lit(0.0)) for i in range(1, max_lag + 1)]
    design = diff.select(
        *keys,
        F.least("_pos", F.lit(max_lag + 2)).alias("edge"),
        F.array(F.lit(1.0), F.coalesce("_y1", F.lit(0.0)), *lags, F.coalesce("_d", F.lit(0.0))).alias("v"),
    ).filter("edge >= 2")
    packed = moments.gram_packed(design, keys=[*keys, "edge"], vector="v")
    grouped = packed.groupBy(*keys).agg(F.collect_list(F.struct("edge", "n", "means", "cells")).alias("edges"))  # at most max_lag + 1
    schema = T.StructType(
        [df.schema[k] for k in keys]
        + [T.StructField("lags", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("statistic", T.DoubleType())]
    )

    def solve(batches):
        for batch in batches:
            rows = [(*(getattr(r, k) for k in keys), *_unit_root(r.edges, max_lag, criterion)) for r in batch.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=[f.name for f in schema.fields]).astype({"statistic": float})

    out = grouped.mapInPandas(solve, schema)
    out = out.withColumn("statistic", F.when(~F.isnan("statistic"), F.col("statistic")))
    out = out.withColumn("p_value", tails.adf_p(F.col("statistic")))
    return out.withColumn("result", verdict(F.col("p_value") < alpha))


def _unit_root(edges, max_lag: int, criterion: str | None):
    d = max_lag + 3
    parts = [(e["edge"], (e["n"], np.asarray(e["means"]), moments.unpack(e["cells"], d))) for e in edges]

    def sample(p):
        used = [part for e, part in parts if e >= p + 2]
        return moments.merge(used) if used else None

    lag, n, tau = unit_root(sample, max_lag, criterion)
    return lag, sum(part[0] for _, part in parts) if n is None else n, tau


def unit_root(sample, max_lag: int, criterion: str | None = "bic"):
    """Lag, rows and tau from ``sample(p)``: moments of [1, level, lagged differences, difference] over the rows that lag p allows."""

    def regress(p, at):
        part = sample(at)
        if part is None or part[0] <= p + 2:
            raise np.linalg.LinAlgError("short")
        beta, rest = moments.ols(part, range(p + 2), [max_lag + 2])
        return part[0], beta, max(float(rest[0, 0]), 0.0), part[2][1 : p + 2, 1 : p + 2]

    try:
        chosen = max_lag
        if criterion is not None:
            best = np.inf
            for p in range(max_lag + 1):
                n, _, rss, _ = regress(p, max_lag)
                cost = np.log(n) if criterion == "bic" else 2.0
                score = n * np.log(rss / n) + cost * (p + 2) if rss > 0 else -np.inf
                if score < best:
                    best, chosen = score, p
        n, beta, rss, xx = regress(chosen, chosen)
        variance = rss / (n - chosen - 2) * np.linalg.inv(xx)[0, 0]
        return chosen, n, float(beta[1, 0] / np.sqrt(variance)) if variance > 0 else np.nan
    except np.linalg.LinAlgError:
        return None, None, np.nan


def kpss_test(
    df: DataFrame, *, keys: Sequence[str], ts: str, value: str, lags: int | None = None, alpha: float = 0.05
) -> DataFrame:
    """Level stationarity: partial sums against the Bartlett long-run variance.

    The Bartlett sum over l lags equals the sum of squared (l + 1)-step
    differences of the partial sums, so each row meets one other position
    instead of l of them.
    """
    keys = list(keys)
    w, whole = _ordered(keys, ts), Window.partitionBy(*keys)
    most = 0
    if lags is None:  # the longest series says how many short lags are summed: n^(2/9), 24 for 1.6 million bars
        most = int((df.groupBy(*keys).agg(F.count(value).alias("n")).agg(F.max("n")).first()[0] or 0) ** (2.0 / 9.0) + 1e-9)
    known = df.filter(F.col(value).isNotNull()).select(
        *keys, ts, (F.col(value) - F.avg(value).over(whole)).alias("_e"), F.count(F.lit(1)).over(whole).alias("n")
    )
    e = known.select(
        *keys, "n", "_e", F.row_number().over(w).alias("_pos"), F.sum("_e").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_s"),
        *[F.lag("_e", i).over(w).alias(f"_e{i}") for i in range(1, most + 1)],
    )
    sums = {"ee": F.sum(F.col("_e") * F.col("_e")), "ss": F.sum(F.col("_s") * F.col("_s"))}
    if lags is None:
        c = F.floor(F.pow(F.col("n"), 2.0 / 9.0))
        within = [F.when(c >= i, F.col("_e") * F.col(f"_e{i}")).otherwise(0.0) for i in range(1, most + 1)]
        sums["r"] = F.sum(sum((F.coalesce(x, F.lit(0.0)) for x in within), F.lit(0.0)))
        sums["ir"] = F.sum(sum((i * F.coalesce(x, F.lit(0.0)) for i, x in enumerate(within, 1)), F.lit(0.0)))
    base = e.groupBy(*keys, "n").agg(*[x.alias(name) for name, x in sums.items()])
    if lags is None:
        n, half = F.col("n"), F.col("n") / 2
        ratio = F.col("ir") / half / F.nullif(F.col("ee") / n + F.col("r") / half, F.lit(0.0))
        auto = F.floor(1.1447 * F.pow(ratio * ratio, 1.0 / 3.0) * F.pow(n, 1.0 / 3.0))
        base = base.withColumn("lags", F.least(auto, n - 1).cast("int")).drop("r", "ir")
    else:
        base = base.withColumn("lags", F.lit(lags))
    steps = e.select(*keys, "_pos", "_s").join(base.select(*keys, "lags"), keys).select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.col("_pos").alias("at"), F.col("_s").alias("d")), F.struct((F.col("_pos") + F.col("lags") + 1).alias("at"), (-F.col("_s")).alias("d"))
            )
        ),
    )
    spread = steps.groupBy(*keys, "at").agg(F.sum("d").alias("d")).groupBy(*keys).agg(F.sum(F.col("d") * F.col("d")).alias("dd"))
    n = F.col("n")
    variance = F.col("dd") / (n * (F.col("lags") + 1))
    out = base.join(spread, keys).select(
        *keys, "lags", "n", (F.col("ss") / (n * n) / F.nullif(variance, F.lit(0.0))).alias("statistic")
    ).withColumn("p_value", tails.kpss_p(F.col("statistic")))
    return out.withColumn("result", verdict(F.col("p_value") > alpha))


def stationarity_decision(
    df: DataFrame, *, keys: Sequence[str], ts: str, value: str, max_lag: int = 12, min_obs: int = 50, alpha: float = 0.05
) -> DataFrame:
    """stationary / non_stationary / unclear / insufficient_data per group."""
    keys = list(keys)
    size = df.groupBy(*keys).agg(F.count(value).alias("n_obs"))
    long = df.join(size.filter(F.col("n_obs") >= min_obs), keys, "left_semi")
    a = adf_test(long, keys=keys, ts=ts, value=value, max_lag=max_lag).select(
        *keys, F.col("statistic").alias("adf_stat"), F.col("p_value").alias("adf_p")
    )
    k = kpss_test(long, keys=keys, ts=ts, value=value).select(
        *keys, F.col("statistic").alias("kpss_stat"), F.col("p_value").alias("kpss_p")
    )
    adf_ok, kpss_ok = F.col("adf_p") < alpha, F.col("kpss_p") > alpha
    return size.join(a, keys, "left").join(k, keys, "left").withColumn(
        "decision",
        F.when(F.col("n_obs") < min_obs, "insufficient_data")
        .when(F.col("adf_p").isNull() | F.col("kpss_p").isNull(), "test_failed")
        .when(adf_ok & kpss_ok, "stationary")
        .when(~adf_ok & ~kpss_ok, "non_stationary")
        .otherwise("unclear"),
    )


# --- normality --------------------------------------------------------------


def jarque_bera(df: DataFrame, *, keys: Sequence[str], value: str, alpha: float = 0.05) -> DataFrame:
    s, k = F.col("_s"), F.col("_k")
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.skewness(value).alias("_s"), F.kurtosis(value).alias("_k"))
    out = out.select(*keys, "n", (F.col("n") / 6 * (s * s + k * k / 4)).alias("statistic"))
    out = out.withColumn("p_value", F.exp(-F.col("statistic") / 2))
    return out.withColumn("result", verdict(F.col("p_value") > alpha))


@F.pandas_udf(T.DoubleType())
def _normal_score(p: pd.Series) -> pd.Series:
    quantile = NormalDist().inv_cdf
    return p.map(quantile)


def _ranked(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Position in value order inside each group, over value blocks (ties in any order)."""
    known = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("x"))
    size = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.stddev_samp("x").alias("sd"), F.var_pop("x").alias("v")
    )
    counted = cut_lineage(known.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("c")))
    cum = blocks.running(counted, keys, ["x"], {"cum": F.col("c")}, blocks.value_block(counted, "x"))
    each = cum.withColumn("i", F.explode(F.sequence(F.col("cum") - F.col("c") + 1, F.col("cum"))))
    return attach(each.drop("c", "cum"), size, keys)


# Published polynomial coefficients of the normality weights and of the p-value.
LAST_WEIGHT = (0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
NEXT_WEIGHT = (0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
W_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
W_SCALE = (-0.4803, -0.082676, 0.0030302)


def _poly(x: Column, coefficients: Sequence[float], start: int = 0) -> Column:
    total, power = F.lit(0.0), F.pow(x, F.lit(float(start)))
    for c in coefficients:
        total, power = total + power * c, power * x
    return total


def shapiro_wilk(df: DataFrame, *, keys: Sequence[str], value: str, alpha: float = 0.05, most: int = 5000) -> DataFrame:
    """W from ordered values and normal scores, for groups of 12 to ``most`` values; other groups give their reason as result."""
    keys = list(keys)
    sizes = cut_lineage(df.groupBy(*keys).agg(F.count(value).alias("n")))
    fit = sizes.filter(F.col("n").between(12, most))
    r = _ranked(match(df, fit, keys, "left_semi"), keys, value)
    scored = r.withColumn("s", _normal_score((F.col("i") - 0.375) / (F.col("n") + 0.25)))
    i, n, x, s = (F.col(c) for c in "i n x s".split())
    inner = (i > 2) & (i < n - 1)
    g = scored.groupBy(*keys, "n", "v").agg(
        F.sum(s * s).alias("ss"),
        F.sum(F.when(inner, s * x)).alias("sx"),
        F.max(F.when(i == n, s)).alias("s1"), F.max(F.when(i == n - 1, s)).alias("s2"),
        F.max(F.when(i == n, x)).alias("x1"), F.max(F.when(i == n - 1, x)).alias("x2"),
        F.max(F.when(i == 1, x)).alias("y1"), F.max(F.when(i == 2, x)).alias("y2"),
    )
    u = 1 / F.sqrt("n")
    root = F.sqrt("ss")
    g = g.withColumns({"a1": F.col("s1") / root + _poly(u, LAST_WEIGHT, 1), "a2": F.col("s2") / root + _poly(u, NEXT_WEIGHT, 1)})
    a1, a2 = F.col("a1"), F.col("a2")
    phi = (F.col("ss") - 2 * F.col("s1") ** 2 - 2 * F.col("s2") ** 2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)
    top = F.col("sx") / F.sqrt(phi) + a1 * (F.col("x1") - F.col("y1")) + a2 * (F.col("x2") - F.col("y2"))
    g = g.withColumn("statistic", top * top / F.nullif(F.col("v") * F.col("n"), F.lit(0.0)))
    log_n = F.log("n")
    z = (F.log(1 - F.col("statistic")) - _poly(log_n, W_MEAN)) / F.exp(_poly(log_n, W_SCALE))
    out = g.select(*keys, "n", "statistic", (1 - tails.normal(z)).alias("p_value"))
    out = out.withColumn("result", verdict(F.col("p_value") > alpha))
    none = F.lit(None).cast("double")
    reason = F.when(F.col("n") < 12, "too few values").otherwise("too many values")
    return out.unionByName(sizes.filter(~F.col("n").between(12, most)).select(*keys, "n", none.alias("statistic"), none.alias("p_value"), reason.alias("result")))


def anderson_darling(df: DataFrame, *, keys: Sequence[str], value: str) -> DataFrame:
    """A^2 against its 5 % critical value (mean and spread estimated)."""
    r = _ranked(df, keys, value).withColumn("f", tails.normal((F.col("x") - F.col("m")) / F.col("sd")))
    i, n = F.col("i"), F.col("n")
    part = (2 * i - 1) * F.log("f") + (2 * (n - i) + 1) * F.log(1 - F.col("f"))
    out = r.groupBy(*keys, "n").agg(F.sum(part).alias("_p")).select(*keys, "n", (-F.col("n") - F.col("_p") / F.col("n")).alias("statistic"))
    out = out.withColumn("critical", 0.787 / (1 + 4 / F.col("n") - 25 / (F.col("n") * F.col("n"))))
    return out.withColumn("result", verdict(F.col("statistic") < F.col("critical")))


# --- autocorrelation --------------------------------------------------------


def ljung_box(df: DataFrame, *, keys: Sequence[str], ts: str, value: str, lags: int = 10, alpha: float = 0.05) -> DataFrame:
    """Q over ``lags`` (even) autocorrelations."""
    keys = list(keys)
    known = df.filter(F.col(value).isNotNull())
    means = known.groupBy(*keys).agg(F.avg(value).alias("_m"))
    e = attach(known, means, keys).select(*keys, ts, (F.col(value) - F.col("_m")).alias("e"))
    w = _ordered(keys, ts)
    wide = e.select(*keys, "e", *[F.lag("e", k).over(w).alias(f"e{k}") for k in range(1, lags + 1)])
    g = wide.groupBy(*keys).agg(
        F.count("e").alias("n"), F.sum(F.col("e") * F.col("e")).alias("ee"), *[F.sum(F.col("e") * F.col(f"e{k}")).alias(f"p{k}") for k in range(1, lags + 1)]
    )
    n = F.col("n")
    q = sum((F.pow(F.col(f"p{k}") / F.col("ee"), 2) / (n - k) for k in range(2, lags + 1)), F.pow(F.col("p1") / F.col("ee"), 2) / (n - 1))
    out = g.filter(n > lags).select(*keys, "n", (n * (n + 2) * q).alias("statistic"))
    out = out.withColumn("p_value", tails.chi2_even(F.col("statistic"), lags))
    return out.withColumn("result", verdict(F.col("p_value") > alpha))


# --- comparisons ------------------------------------------------------------


def paired_t(df: DataFrame, *, keys: Sequence[str], a: str, b: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    g = df.groupBy(*keys).agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("_s"))
    out = g.withColumn("statistic", F.col("mean_diff") / F.nullif(F.col("_s") / F.sqrt("n"), F.lit(0.0))).drop("_s")
    return out.withColumn("p_value", tails.t_tail(F.col("statistic"), F.col("n") - 1))


def wilcoxon_signed_rank(df: DataFrame, *, keys: Sequence[str], a: str, b: str, digits: int = 12) -> DataFrame:
    """Signed ranks of |a-b|, ties averaged, zeros dropped, normal approximation."""
    keys = list(keys)
    d = F.round(F.col(a) - F.col(b), digits)
    diff = df.select(*keys, d.alias("d")).filter("d <> 0")
    tied = cut_lineage(diff.groupBy(*keys, F.abs("d").alias("x")).agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("d") > 0).alias("up")))
    cum = blocks.running(tied, keys, ["x"], {"cum": F.col("c")}, blocks.value_block(tied, "x"))
    rank = F.col("cum") - (F.col("c") - 1) / 2
    c = F.col("c").cast("double")
    g = cum.groupBy(*keys).agg(
        F.sum("c").alias("n"), F.sum(rank * F.col("up")).alias("w_up"), F.sum(rank * (F.col("c") - F.col("up"))).alias("w_down"),
        F.sum(c * c * c - c).alias("_ties"),
    )
    n = F.col("n").cast("double")
    se = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48)
    g = g.withColumns({"statistic": F.least("w_up", "w_down"), "z": (F.least("w_up", "w_down") - n * (n + 1) / 4) / se})
    return g.withColumn("p_value", F.least(F.lit(1.0), 2 * tails.normal(-F.abs("z")))).drop("_ties")


def diebold_mariano(df: DataFrame, *, keys: Sequence[str], ts: str, e1: str, e2: str) -> DataFrame:
    """Mean squared-error differential over its Newey-West standard error, lag min(5, n // 4)."""
    keys = list(keys)
    d = df.select(*keys, ts, (F.col(e1) * F.col(e1) - F.col(e2) * F.col(e2)).alias("d")).filter("d is not null")
    size = d.groupBy(*keys).agg(F.avg("d").alias("mean_diff"), F.count(F.lit(1)).alias("n"), F.var_samp("d").alias("_var"))
    w = _ordered(keys, ts)
    e = d.join(size, keys).withColumn("e", F.col("d") - F.col("mean_diff"))
    wide = e.select(*keys, "mean_diff", "n", "_var", "e", *[F.lag("e", k).over(w).alias(f"e{k}") for k in range(1, 6)])
    g = wide.groupBy(*keys, "mean_diff", "n", "_var").agg(
        F.sum(F.col("e") * F.col("e")).alias("g0"), *[F.sum(F.col("e") * F.col(f"e{k}")).alias(f"g{k}") for k in range(1, 6)]
    )
    n = F.col("n")
    most = F.least(F.lit(5), F.floor(n / 4))
    lrv = F.col("g0") / n
    for k in range(1, 6):
        lrv = lrv + F.when(most >= k, 2 * (1 - k / (most + 1)) * F.col(f"g{k}") / n).otherwise(0.0)
    variance = F.when(n > 20, lrv).otherwise(F.col("_var"))
    out = g.filter(n >= 10).select(*keys, "n", "mean_diff", (F.col("mean_diff") / F.sqrt(F.nullif(variance, F.lit(0.0)) / n)).alias("statistic"))
    return out.withColumn("p_value", 2 * tails.normal(-F.abs("statistic")))


def one_sample_t(df: DataFrame, *, keys: Sequence[str], value: str) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("_s"))
    se = F.col("_s") / F.sqrt("n")
    out = g.withColumn("std_error", se).withColumn("statistic", F.col("mean") / F.nullif("std_error", F.lit(0.0))).drop("_s")
    return out.withColumn("p_value", tails.t_tail(F.col("statistic"), F.col("n") - 1))


@F.pandas_udf(T.DoubleType())
def _t_quantile(df: pd.Series) -> pd.Series:
    def solve(nu):
        lo, hi = 0.0, 1e3
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if t_two_sided(mid, nu) > 0.05 else (lo, mid)
        return (lo + hi) / 2

    return df.map(solve)


def confidence_bounds(tested: DataFrame) -> DataFrame:
    """95 % bounds of the mean of :func:`one_sample_t`."""
    q = _t_quantile((F.col("n") - 1).cast("double")) * F.col("std_error")
    return tested.withColumns({"ci_low": F.col("mean") - q, "ci_high": F.col("mean") + q})


def sharpe_t(metrics: DataFrame, *, sharpe: str = "sharpe", n: str = "n") -> DataFrame:
    s = F.col(sharpe)
    out = metrics.withColumn("std_error", F.sqrt((1 + s * s / 2) / F.col(n))).withColumn("statistic", s / F.col("std_error"))
    return out.withColumn("p_value", tails.t_tail(F.col("statistic"), F.col(n) - 1))


def anova_oneway(df: DataFrame, *, group: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """F across groups from one row of sums per group."""
    keys = list(keys)
    x = F.col(value).cast("double")
    g = df.groupBy(*keys, group).agg(F.count(x).alias("c"), F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    t = g.groupBy(*keys).agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("groups"), (F.sum(F.col("c") * F.col("m")) / F.sum("c")).alias("_all"),
        F.sum(F.col("c") * F.col("v")).alias("_within"), F.sum(F.col("c") * F.col("m") * F.col("m")).alias("_raw"),
    )
    between = F.col("_raw") - F.col("n") * F.col("_all") * F.col("_all")
    d1, d2 = F.col("groups") - 1, F.col("n") - F.col("groups")
    out = t.filter((F.col("groups") > 1) & (F.col("n") > F.col("groups"))).select(
        *keys, "n", "groups", (between / d1 / F.nullif(F.col("_within") / d2, F.lit(0.0))).alias("statistic")
    )
    return out.withColumn("p_value", tails.f_tail(F.col("statistic"), F.col("groups") - 1, F.col("n") - F.col("groups")))


# --- resampling -------------------------------------------------------------


def hash_number(*parts: Column) -> Column:
    """Reproducible number in [0, 2^32) from the text of the parts."""
    text = F.concat_ws("-", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _numbered(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    known = df.filter(F.col(value).isNotNull())
    w = _ordered(keys, ts)
    return known.select(
        *keys, ts, F.col(value).alias("x"), F.row_number().over(w).cast("long").alias("pos"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("n")
    )


def _redraw(numbered: DataFrame, keys: Sequence[str], draws: int, tag: Column) -> DataFrame:
    """``draws`` samples with replacement of every group: (keys, b, pos, n, x)."""
    keys = list(keys)
    slots = numbered.select(*keys, "pos", "n", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("b"))
    picks = slots.withColumn("_pick", hash_number(tag, F.col("b"), F.col("pos")) % F.col("n") + 1)
    return picks.join(numbered.select(*keys, F.col("pos").alias("_pick"), "x"), [*keys, "_pick"])


def _variance_shift(first: Column, second: Column) -> Column:
    return F.when(first + second > 0, F.abs(first - second) / F.sqrt(first + second)).otherwise(0.0)


PRIME = 2**31 - 1  # numbers of rows and draws live below it, so their products fit into 64 bits


def draw_number(tag: str, b: int) -> int:
    """Number of a draw in [0, PRIME), from md5 like :func:`hash_number`."""
    return int(md5(f"{tag}-{b}".encode()).hexdigest()[:8], 16) % PRIME


def draw_lines(tag: str, draws: int, start: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Per draw a factor and an offset: (factor * seed + offset) % PRIME spreads the rows' seeds, pairwise independently."""
    span = range(start, draws + 1)
    return np.array([1 + draw_number(f"{tag}a", b) % (PRIME - 1) for b in span]), np.array([draw_number(f"{tag}c", b) for b in span])


def poisson_steps(rate: float) -> np.ndarray:
    """Numbers below PRIME at which a Poisson count rises by one."""
    steps, term, below, k = [], exp(-rate), 0.0, 0
    while True:
        below += term
        step = int(below * PRIME)
        if step >= PRIME - 1:
            return np.array(steps)
        steps.append(step)
        k += 1
        term *= rate / k


def variance_break_bootstrap(df: DataFrame, *, key: str, ts: str, value: str, draws: int = 200) -> DataFrame:
    """Change of variance between the two halves of a series against resampled series: (key, n, statistic, p_value).

    Every row enters each half of draw b with a Poisson count of mean 1/2 that depends on its place and on b alone, so no row
    is copied: a task sums its rows' weights and weighted moments about the series' mean for all draws at once, and
    only those sums are shuffled. Draws that leave a half empty do not count. Rows with a NULL value are left out.
    """
    numbered = _numbered(df, [key], ts, value)
    early = F.col("pos") <= F.floor(F.col("n") / 2)
    seen = numbered.groupBy(key).agg(
        F.max("n").alias("n"), F.var_pop(F.when(early, F.col("x"))).alias("v1"), F.var_pop(F.when(~early, F.col("x"))).alias("v2"), F.avg("x").alias("_mean")
    )
    seen = cut_lineage(seen.select(key, "n", _variance_shift(F.col("v1"), F.col("v2")).alias("statistic"), "_mean"))
    seeds = attach(numbered, seen.select(key, "_mean"), [key]).select(
        key, (hash_number(F.col(key), F.col("pos")) % PRIME).alias("seed"), (F.col("x") - F.col("_mean")).cast("double").alias("d")
    )
    sums = [f"{side}{power}" for side in "el" for power in range(3)]
    fields = [T.StructField("b", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in sums]]
    schema = T.StructType([seeds.schema[key], *fields])
    lines, steps = [draw_lines(side, draws) for side in "el"], poisson_steps(0.5)

    def weigh(batches):
        held = {}

        def made():
            for name, total in held.items():
                yield pd.DataFrame({key: [name] * draws, "b": range(1, draws + 1), **dict(zip(sums, total))}).astype({key: object})

        for batch in batches:
            for name, rows in batch.groupby(key, sort=False, dropna=False):
                seed, d = rows["seed"].to_numpy()[:, None], rows["d"].to_numpy()
                powers = np.stack([np.ones(len(d)), d, d * d])
                counts = [np.searchsorted(steps, (a * seed + c) % PRIME, side="right").astype(float) for a, c in lines]
                part = np.concatenate([powers @ w for w in counts])
                name = None if pd.isna(name) else name
                held[name] = held[name] + part if name in held else part
            if len(held) > moments.MOST_HELD:
                yield from made()
                held.clear()
        yield from made()

    drawn = seeds.mapInPandas(weigh, schema).groupBy(key, "b").agg(*[F.sum(c).alias(c) for c in sums])
    half = lambda side: F.col(f"{side}2") / F.col(f"{side}0") - (F.col(f"{side}1") / F.col(f"{side}0")) ** 2
    drawn = drawn.filter("e0 > 0 and l0 > 0").select(key, _variance_shift(F.greatest(half("e"), F.lit(0.0)), F.greatest(half("l"), F.lit(0.0))).alias("_d"))
    joined = match(seen.drop("_mean"), drawn, [key], "left")
    return joined.groupBy(key, "n", "statistic").agg(F.avg((F.col("_d") >= F.col("statistic")).cast("int")).alias("p_value"))


def event_window_bootstrap(df: DataFrame, events: DataFrame, *, key: str, ts: str, value: str, draws: int = 200) -> DataFrame:
    """Mean shift around each event (``events``: one column ``event`` of times), per series.

    The window holds min(20, n // 4) rows on each side; fewer than 5 on a side
    gives statistic 0 and p 1.
    """
    numbered = _numbered(df, [key], ts, value)
    width = F.least(F.lit(20), F.floor(F.col("n") / 4))
    at = numbered.join(events, F.col(ts) == F.col("event")).filter(width > 0).select(key, "event", F.col("pos").alias("_at"), width.cast("long").alias("_w"))
    # every event names its few positions, so no row meets an event that is not near
    places = at.select(key, "event", "_at", F.explode(F.sequence(F.col("_at") - F.col("_w"), F.col("_at") + F.col("_w") - 1)).alias("pos"))
    near = match(numbered, places, [key, "pos"])
    keys = [key, "event"]
    w = Window.partitionBy(*keys)
    local = near.select(
        *keys, "x", (F.col("pos") < F.col("_at")).alias("before"),
        F.row_number().over(w.orderBy("pos")).cast("long").alias("pos"), F.count(F.lit(1)).over(w).alias("n"),
    ).withColumn("n_before", F.count_if("before").over(w))

    def shift(d, by):
        early = F.col("pos") <= F.col("n_before")
        return d.groupBy(*by).agg(F.max("n").alias("n"), F.max("n_before").alias("n_before"), F.abs(F.avg(F.when(early, F.col("x"))) - F.avg(F.when(~early, F.col("x")))).alias("d"))

    enough = (F.col("n_before") >= 5) & (F.col("n") - F.col("n_before") >= 5)
    seen = shift(local, keys).select(*keys, enough.alias("ok"), "d")
    sides = local.groupBy(*keys).agg(F.max("n_before").alias("n_before"))
    drawn = shift(_redraw(local, keys, draws, F.concat_ws("-", F.col(key), F.col("event").cast("string"))).join(sides, keys), [*keys, "b"])
    joined = seen.join(drawn.select(*keys, F.col("d").alias("_d")), keys)
    out = joined.groupBy(*keys, "ok", "d").agg(F.avg((F.col("_d") >= F.col("d")).cast("int")).alias("p"))
    return out.select(
        *keys, F.when(F.col("ok"), F.col("d")).otherwise(0.0).alias("statistic"), F.when(F.col("ok"), F.col("p")).otherwise(1.0).alias("p_value")
    )


def spill_significance(df: DataFrame, events: DataFrame, *, key: str, ts: str, value: str, draws: int = 200, alpha: float = 0.05) -> DataFrame:
    """Variance-break test of every series with enough rows and event tests, as result rows."""
    size = df.groupBy(key).agg(F.count(value).alias("_n")).filter(F.col("_n") >= 50)
    long = df.join(size, key, "left_semi")
    breaks = variance_break_bootstrap(long, key=key, ts=ts, value=value, draws=draws).select(
        F.col(key).alias("series"), F.lit("bootstrap").alias("test"), "statistic", "p_value"
    )
    shifts = event_window_bootstrap(long, events, key=key, ts=ts, value=value, draws=draws).select(
        F.col(key).alias("series"), F.concat(F.lit("event_"), F.col("event").cast("date").cast("string")).alias("test"), "statistic", "p_value"
    )
    return breaks.unionByName(shifts).select(
        F.lit("spillover_significance").alias("category"), "series", "test", "statistic", "p_value", verdict(F.col("p_value") < alpha).alias("result")
    )


def _order(h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Row numbers by hash, equal ones by id (NULL first)."""
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(np.diff(h[order]) == 0)
    for run in np.split(same, np.flatnonzero(np.diff(same) > 1) + 1) if len(same) else []:
        here = slice(run[0], run[-1] + 2)
        order[here] = sorted(order[here], key=lambda i: (not pd.isna(ids[i]), ids[i]))
    return order


PERMUTED_ROWS = 65_536  # rows of a range of hashes, which one task holds for the draws of a round
RANGES_A_TASK = 8  # ranges whose rows one task reads and copies: what it sorts for the shuffle stays in memory
DRAWS_AT_ONCE = 5  # draws of a round; its shuffle is removed before the next


def permutation_test(df: DataFrame, *, id: str, features: Sequence[str], target: str, draws: int = 20, rows: int = PERMUTED_ROWS) -> DataFrame:
    """In-sample R^2 of a linear model against label permutations: (draw, n, r2), draw 0 = the data.

    Every draw permutes the targets of the whole table: the target at place k in the order of the draw's hash meets the
    features at place k in the order of the rows' hash (ties by id, NULL first; a number that grows with the id stands for it).
    Hashes are even, so one range of them holds about ``rows`` rows in every draw; counts per (draw, range) tell the places
    it covers, and the features go to the few ranges that cover theirs.  One shuffle per round of ``DRAWS_AT_ONCE`` draws
    brings a range together, and each range hands on one matrix of moments per draw.
    Rows with a NULL feature or target are left out. r2 is NULL where the target or a feature does not vary.
    """
    xs, d = [f"x{i}" for i in range(len(features))], len(features) + 2
    known = df.select(F.col(id).alias("id"), *[F.col(f).cast("double").alias(x) for f, x in zip(features, xs)], F.col(target).cast("double").alias("y"))
    known = known.filter(reduce(and_, [F.col(c).isNotNull() for c in [*xs, "y"]]))

    def permuted(x, y):  # one range of hashes
        x = x.sort_values("pos")
        first, v = int(x["pos"].iloc[0]), x[xs].to_numpy()
        out = []
        for b, drawn in y.groupby("b"):
            drawn = drawn.take(_order(drawn["h"].to_numpy(), drawn["r"].to_numpy()))
            k = int(drawn["start"].iloc[0]) - first
            w = np.column_stack([np.ones(len(drawn)), v[k : k + len(drawn)], drawn["y"].to_numpy()])
            mean = w.mean(axis=0)
            w = w - mean
            out.append((b, int(drawn["block"].iloc[0]) // moments.FAN, len(w), mean, (w.T @ w)[np.triu_indices(d)]))
        return pd.DataFrame(out, columns=["b", "_salt", "n", "means", "cells"])

    spark = df.sparkSession
    ranges = max(1, ceil(known.count() / rows))
    width = ceil(2**32 / ranges)
    files = max(spark.sparkContext.defaultParallelism, ceil(ranges / RANGES_A_TASK))
    # shuffle files go when their query ends, not when the driver collects garbage; scans have as many tasks as there are files
    conf = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.files.minPartitionNum": str(files)}
    with configured(spark, conf):
        numbered = known.repartitionByRange(files, "id").sortWithinPartitions("id").withColumn("r", F.monotonically_increasing_id())
        ranked = stash(numbered, "ranked")

        def copies(some: range, *columns: str) -> DataFrame:
            """A row per draw; draw 0 has the order of the features."""
            hashes = [hash_number(F.lit(b) if b else F.lit("row"), F.col("id")) for b in some]
            made = ranked.select(*columns, F.posexplode(F.array(*hashes)).alias("b", "h")).withColumn("b", F.col("b") + some.start)
            return made.withColumn("block", F.floor(F.col("h") / width).cast("int"))

        sizes = cut_lineage(copies(range(draws + 1)).groupBy("b", "block").agg(F.count(F.lit(1)).alias("n")))
        every = sizes.select("b").distinct().crossJoin(sizes.select("block").distinct()).join(sizes, ["b", "block"], "left").fillna(0, ["n"])
        line = Window.partitionBy("b").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per draw and range
        starts = cut_lineage(every.select("b", "block", "n", F.coalesce(F.sum("n").over(line), F.lit(0)).alias("start")))
        place = F.col("start") + F.row_number().over(Window.partitionBy("block").orderBy("h", "r")) - 1
        home = copies(range(1), "r", *xs).repartition(files, "block").join(F.broadcast(starts.filter("b = 0").select("block", "start")), "block")
        home = stash(home.select(place.alias("pos"), *xs), "places").withColumn("_piece", F.floor(F.col("pos") / rows))
        scored = []
        for b in range(1, draws + 1, DRAWS_AT_ONCE):
            some = range(b, min(b + DRAWS_AT_ONCE, draws + 1))
            here = starts.filter(F.col("b").between(some.start, some.stop - 1))
            span = here.groupBy("block").agg(F.min("start").alias("_first"), F.max(F.col("start") + F.col("n")).alias("_end"))
            span = span.withColumn("_piece", F.explode(F.sequence(F.floor(F.col("_first") / rows), F.floor((F.col("_end") - 1) / rows))))
            near = home.join(F.broadcast(span), "_piece").filter("pos >= _first and pos < _end").select("block", "pos", *xs)
            # as many partitions as ranges: what a task sorts stays in memory, however many rows there are
            away = copies(some, "r", "y").repartition(ranges, "block").join(F.broadcast(here.drop("n")), ["b", "block"])
            pairs = near.repartition(ranges, "block").groupBy("block").cogroup(away.groupBy("block"))
            parts = pairs.applyInPandas(permuted, "b int, _salt int, n long, means array<double>, cells array<double>")
            scored.append(cut_lineage(moments.merge_packed(parts, keys=["b"])))

    data = ranked.select(F.lit(0).alias("b"), F.array(F.lit(1.0), *xs, "y").alias("v"))
    packed = reduce(DataFrame.unionByName, scored, moments.gram_packed(data, keys=["b"], vector="v"))

    def score(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                part = (r.n, np.asarray(r.means), moments.unpack(r.cells, d))
                try:
                    total = part[2][d - 1, d - 1]
                    r2 = 1 - moments.ols(part, range(d - 1), [d - 1])[1][0, 0] / total if total > 0 else None
                except np.linalg.LinAlgError:
                    r2 = None
                out.append((r.b, r.n, r2))
            yield pd.DataFrame(out, columns=["draw", "n", "r2"]).astype({"r2": float})

    return packed.mapInPandas(score, "draw int, n long, r2 double")


def permutation_p(scores: DataFrame) -> DataFrame:
    seen = F.max(F.when(F.col("draw") == 0, F.col("r2"))).over(Window.partitionBy())
    marked = scores.withColumn("_seen", seen)
    return marked.groupBy("n").agg(
        F.max("_seen").alias("score"),
        ((F.count_if((F.col("draw") > 0) & (F.col("r2") >= F.col("_seen"))) + 1) / F.count(F.lit(1))).alias("p_value"),
    )


def corrected_resampled_t(scores: DataFrame, *, model: str, split: str, score: str, test_share: float) -> DataFrame:
    """Every pair of models on common splits; variance inflated by n_test / n_train."""
    a = scores.select(F.col(model).alias("model_a"), F.col(split).alias("_s"), F.col(score).alias("_x"))
    b = scores.select(F.col(model).alias("model_b"), F.col(split).alias("_s"), F.col(score).alias("_y"))
    d = F.col("_x") - F.col("_y")
    g = a.join(b, "_s").filter("model_a < model_b").groupBy("model_a", "model_b").agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_diff"), F.var_samp(d).alias("_v")
    )
    variance = F.col("_v") * (1 / F.col("n") + test_share / (1 - test_share))
    out = g.withColumn("statistic", F.when(variance > 0, F.col("mean_diff") / F.sqrt(variance)).otherwise(0.0)).drop("_v")
    return out.withColumn("p_value", F.coalesce(tails.t_tail(F.col("statistic"), F.col("n") - 1), F.lit(1.0)))


def bonferroni(results: DataFrame, *, p: str = "p_value") -> DataFrame:
    """p times the number of tests, at most 1 (over the few result rows)."""
    return results.withColumn("p_corrected", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col(p) * F.count(F.lit(1)).over(Window.partitionBy()))))


def f_regression_screen(df: DataFrame, *, features: Sequence[str], target: str, alpha: float = 0.05) -> DataFrame:
    """F = r^2 / (1 - r^2) * (n - 2) per feature, in one pass."""
    row = df.agg(*[F.struct(F.corr(f, target).alias("r"), F.count(F.col(f) + F.col(target)).alias("n")).alias(f) for f in features])
    long = row.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{f}.r").alias("r"), F.col(f"{f}.n").alias("n")) for f in features])))
    r2 = F.col("r") * F.col("r")
    out = long.select("feature", "n", (r2 / F.nullif(1 - r2, F.lit(0.0)) * (F.col("n") - 2)).alias("statistic"))
    out = out.withColumn("p_value", tails.f_tail(F.col("statistic"), F.lit(1), F.col("n") - 2))
    return out.withColumn("significant", (F.col("p_value") < alpha).cast("int"))


# --- result tables ----------------------------------------------------------

RESULT = ["category", "series", "test", "statistic", "p_value", "result"]


def stat_suite(df: DataFrame, *, key: str, ts: str, value: str, min_tests: int = 20, min_unit: int = 50, category: str = "var_assumptions") -> DataFrame:
    """Unit root, stationarity, normality and autocorrelation tests of every series, behind size gates."""
    size = df.groupBy(key).agg(F.count(value).alias("_n"))
    some = match(df, size.filter(F.col("_n") > min_tests), [key], "left_semi")
    many = match(df, size.filter(F.col("_n") > min_unit), [key], "left_semi")
    tests = [
        ("adf_stationarity", adf_test(many, keys=[key], ts=ts, value=value, criterion="aic")),
        ("kpss_stationarity", kpss_test(many, keys=[key], ts=ts, value=value)),
        ("jarque_bera_normality", jarque_bera(some, keys=[key], value=value)),
        ("shapiro_normality", shapiro_wilk(some, keys=[key], value=value)),
        ("anderson_normality", anderson_darling(some, keys=[key], value=value).withColumn("p_value", F.lit(None).cast("double"))),
        ("ljung_box", ljung_box(some, keys=[key], ts=ts, value=value)),
    ]
    rows = [
        t.select(F.lit(category).alias("category"), F.col(key).alias("series"), F.lit(name).alias("test"), "statistic", "p_value", "result")
        for name, t in tests
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def test_summary(results: DataFrame) -> DataFrame:
    counts = {s.lower(): F.count_if(F.col("result") == s) for s in ("PASS", "FAIL", "WARNING")}
    g = results.groupBy("category").agg(
        F.count(F.lit(1)).alias("total"), counts["pass"].alias("passed"), counts["fail"].alias("failed"), counts["warning"].alias("warning")
    )
    return g.withColumn("pass_rate", F.col("passed") / F.col("total"))


test_summary.__test__ = False


def validity_grade(results: DataFrame) -> DataFrame:
    """One row: counts, grade by pass rate, and which assumptions hold."""
    name, failed, passed = F.col("test"), F.col("result") == "FAIL", F.col("result") == "PASS"
    g = results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(passed).alias("passed"),
        (~F.bool_or(name.contains("stationarity") & failed)).cast("int").alias("var_model_valid"),
        F.bool_or((F.col("category") == "spillover_significance") & passed).cast("int").alias("spillover_significant"),
        F.count_if(name.contains("normality") & failed).alias("normality_failures"),
    )
    rate = F.col("passed") / F.greatest(F.col("total"), F.lit(1))
    return g.withColumn("pass_rate", rate).withColumn(
        "validity", F.when(F.col("pass_rate") >= 0.8, "HIGH").when(F.col("pass_rate") >= 0.6, "MEDIUM").otherwise("LOW")
    )


def reliability_score(grade: DataFrame, *, ml_reliable: Column | None = None) -> DataFrame:
    """Pass rate minus fixed penalties for broken assumptions, at least 0."""
    ml = F.lit(1) if ml_reliable is None else ml_reliable
    penalty = (
        F.when(F.col("var_model_valid") == 1, 0.0).otherwise(0.2)
        + F.when(F.col("spillover_significant") == 1, 0.0).otherwise(0.1)
        + F.when(ml == 1, 0.0).otherwise(0.2)
    )
    return grade.withColumn("reliability", F.greatest(F.lit(0.0), F.col("pass_rate") - penalty))


def results_to_metrics(results: DataFrame) -> DataFrame:
    """Flat (metric, value) rows per test plus summary rows."""
    tag = F.concat_ws("_", "category", "series", "test")
    rows = results.select(
        F.inline(
            F.array(
                F.struct(F.concat(F.lit("pvalue_"), tag).alias("metric"), F.col("p_value").alias("value")),
                F.struct(F.concat(F.lit("statistic_"), tag).alias("metric"), F.col("statistic").alias("value")),
                F.struct(F.concat(F.lit("passed_"), tag).alias("metric"), (F.col("result") == "PASS").cast("double").alias("value")),
            )
        )
    )
    total = results.agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("result") == "PASS").alias("p"))
    summary = total.select(
        F.inline(
            F.array(
                F.struct(F.lit("total_tests").alias("metric"), F.col("t").cast("double").alias("value")),
                F.struct(F.lit("validation_pass_rate").alias("metric"), (F.col("p") / F.greatest(F.lit(1), F.col("t"))).alias("value")),
            )
        )
    )
    return rows.unionByName(summary)


def metric_category(metrics: DataFrame) -> DataFrame:
    m = F.col("metric")
    return metrics.withColumn(
        "kind",
        F.when(m.contains("pvalue"), "P-values")
        .when(m.contains("statistic"), "Test Statistics")
        .when(m.contains("result"), "Results")
        .when(m.contains("pass_rate") | m.contains("passed"), "Pass Rates")
        .when(m.contains("validation") | m.contains("reliable"), "Validation Scores")
        .otherwise("Other"),
    )


def metric_category_counts(metrics: DataFrame, *, alpha: float = 0.05) -> DataFrame:
    hit = F.col("metric").contains("pvalue") & (F.col("value") < alpha)
    return metric_category(metrics).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("significant"))


def spill_test_counts(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count_if(F.col("test").contains("bootstrap")).alias("bootstrap_tests"),
        F.count_if(F.col("test").contains("event")).alias("event_tests"),
        F.count_if(F.col("result") == "PASS").alias("significant"),
    )


def significance_label(df: DataFrame, *, p: str = "p_value", t: str = "statistic") -> DataFrame:
    x = F.col(p)
    return df.withColumns(
        {
            "significance": F.when(x < 0.001, "highly significant").when(x < 0.01, "very significant").when(x < 0.05, "significant").otherwise("not significant"),
            "sign": F.when(F.col(t) > 0, "positive").otherwise("negative"),
        }
    )


def ir_grade(df: DataFrame, *, ratio: str = "information_ratio") -> DataFrame:
    x = F.abs(ratio)
    return df.withColumn("ir_grade", F.when(x > 1, "excellent").when(x > 0.5, "good").otherwise("limited"))


def overall_flags(df: DataFrame) -> DataFrame:
    """Four yes/no conclusions over rows with spill_p, sharpe, sharpe_p, effect_p, alpha_p, information_ratio."""
    return df.agg(
        F.bool_or(F.col("spill_p") < 0.05).cast("int").alias("transmission"),
        F.bool_or((F.col("sharpe_p") < 0.05) & (F.col("sharpe") > 0)).cast("int").alias("performance"),
        F.bool_or(F.col("effect_p") < 0.05).cast("int").alias("sensitivity"),
        F.bool_or((F.col("alpha_p") < 0.05) | (F.abs("information_ratio") > 0.5)).cast("int").alias("economic"),
    )
