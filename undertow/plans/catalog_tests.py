"""Statistical tests and result tables as checked queries."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from undertow.operators import performance, stattests, transmission
from undertow.plans.catalog_grid import NAIVE, naive_forecasts
from undertow.plans.catalog_portfolio import BENCHED, benched
from undertow.plans.catalog_series import SHARE, panel, region_shares
from undertow.plans.registry import R, query, r, rounded
from undertow.plans.sqlparts import f_tail_even, normal_cdf, t_tail
from undertow.sources.tables import BARS, COMMENTS, PRICES, RETURNS

PRICE_SERIES = PRICES + ", ps AS (SELECT symbol AS series, day AS ts, price AS x FROM prices)"
ADF1 = PRICE_SERIES + """, dd AS (SELECT series, ts, x - lag(x) OVER w AS d, lag(x) OVER w AS y1 FROM ps WINDOW w AS (PARTITION BY series ORDER BY ts)),
  dl AS (SELECT * FROM (SELECT series, d, y1, lag(d) OVER (PARTITION BY series ORDER BY ts) AS d1 FROM dd) WHERE d1 IS NOT NULL),
  mm AS (SELECT series, count(*) AS n, var_pop(y1) AS v1, var_pop(d1) AS v2, covar_pop(y1, d1) AS c12, covar_pop(d, y1) AS c1, covar_pop(d, d1) AS c2, var_pop(d) AS vy FROM dl GROUP BY 1),
  bb AS (SELECT *, v1 * v2 - c12 * c12 AS det, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM mm),
  ad AS (SELECT series, n, b1 / sqrt(n * (vy - b1 * c1 - b2 * c2) / (n - 3) * v2 / det / n) AS tau FROM bb)"""


def price_series(t):
    return t.prices.select(F.col("symbol").alias("series"), F.col("day").alias("ts"), F.col("price").alias("x"))


@query("adf_test", f"WITH {ADF1} SELECT series, 1 AS lags, n::BIGINT AS n, {R('tau', 5)} AS statistic, 'PASS' AS result FROM ad WHERE tau < -18.83 UNION ALL SELECT series, 1, n, {R('tau', 5)}, 'PASS' FROM ad WHERE tau BETWEEN -18.83 AND -2.87")
def _(t):
    a = stattests.adf_test(price_series(t), keys=["series"], ts="ts", value="x", max_lag=1, criterion=None)
    return rounded(a.select("series", "lags", "n", "statistic", "result"), 5)


@query("adf_test_auto")
def _(t):
    return rounded(stattests.adf_test(price_series(t), keys=["series"], ts="ts", value="x", criterion="bic"))


KPSS = BARS + """, e AS (SELECT community AS series, ts, value - avg(value) OVER (PARTITION BY community) AS e, count(*) OVER (PARTITION BY community) AS n FROM bars),
  s AS (SELECT *, sum(e) OVER w AS s, """ + ", ".join(f"lag(e, {i}) OVER w AS e{i}" for i in range(1, 6)) + """ FROM e WINDOW w AS (PARTITION BY series ORDER BY ts)),
  k AS (SELECT series, max(n) AS n, sum(s * s) AS ss, sum(e * e)""" + "".join(f" + 2 * {1 - i / 6} * sum(e * e{i})" for i in range(1, 6)) + """ AS lrv FROM s GROUP BY 1),
  kp AS (SELECT series, n, ss / n / lrv AS stat FROM k)"""
KPSS_P = "CASE WHEN stat <= 0.347 THEN 0.1 WHEN stat >= 0.739 THEN 0.01 WHEN stat <= 0.463 THEN 0.1 - 0.05 * (stat - 0.347) / 0.116 WHEN stat <= 0.574 THEN 0.05 - 0.025 * (stat - 0.463) / 0.111 ELSE 0.025 - 0.015 * (stat - 0.574) / 0.165 END"


@query("kpss_test", f"WITH {KPSS} SELECT series, 5 AS lags, n::BIGINT AS n, {R('stat')} AS statistic, {R(KPSS_P)} AS p_value, CASE WHEN {KPSS_P} > 0.05 THEN 'PASS' ELSE 'FAIL' END AS result FROM kp")
def _(t):
    b = t.bars.withColumnRenamed("community", "series")
    return rounded(stattests.kpss_test(b, keys=["series"], ts="ts", value="value", lags=5).select("series", "lags", "n", "statistic", "p_value", "result"))


JB = """jbm AS (SELECT series, count(ret) AS n, skewness(ret) * (count(ret) - 2) / sqrt(count(ret)::DOUBLE * (count(ret) - 1)) AS s, kurtosis_pop(ret) AS k FROM returns GROUP BY 1),
  jb AS (SELECT series, n, n / 6.0 * (s * s + k * k / 4) AS stat FROM jbm)"""


@query("jarque_bera", f"WITH {RETURNS}, {JB} SELECT series, n::BIGINT AS n, {R('stat', 3)} AS statistic, {R('exp(-stat / 2)')} AS p_value, CASE WHEN exp(-stat / 2) > 0.05 THEN 'PASS' ELSE 'FAIL' END AS result FROM jb")
def _(t):
    j = stattests.jarque_bera(t.returns, keys=["series"], value="ret")
    return j.select("series", "n", r("statistic", 3).alias("statistic"), r("p_value").alias("p_value"), "result")


@query("shapiro_wilk")
def _(t):
    return rounded(stattests.shapiro_wilk(t.returns, keys=["series"], value="ret"))


AD = """z AS (SELECT series, ret, (ret - avg(ret) OVER (PARTITION BY series)) / stddev_samp(ret) OVER (PARTITION BY series) AS z, row_number() OVER (PARTITION BY series ORDER BY ret) AS i, count(*) OVER (PARTITION BY series) AS n FROM small),
  f AS (SELECT series, i, n, {cdf} AS f FROM z), a2 AS (SELECT series, max(n) AS n, -max(n) - sum((2 * i - 1) * ln(f) + (2 * (n - i) + 1) * ln(1 - f)) / max(n) AS a FROM f GROUP BY 1)"""


@query(
    "anderson_darling",
    f"""WITH {RETURNS}, small AS (SELECT series, ln(1 + ret) AS ret FROM returns), {AD.format(cdf=normal_cdf('z', 1000))}
    SELECT series, n::BIGINT AS n, {R('a', 5)} AS statistic, {R('0.787 / (1 + 4.0 / n - 25.0 / (n * n))')} AS critical, CASE WHEN a < 0.787 / (1 + 4.0 / n - 25.0 / (n * n)) THEN 'PASS' ELSE 'FAIL' END AS result FROM a2""",
)
def _(t):
    logs = t.returns.select("series", F.log1p("ret").alias("ret"))
    a = stattests.anderson_darling(logs, keys=["series"], value="ret")
    return a.select("series", "n", r("statistic", 5).alias("statistic"), r("critical").alias("critical"), "result")


def ljung_sql(source, name="lb"):
    lags = ", ".join(f"lag(e, {k}) OVER w AS e{k}" for k in range(1, 11))
    q = " + ".join(f"pow(sum(e * e{k}) / sum(e * e), 2) / (count(*) - {k})" for k in range(1, 11))
    return f"""{name}e AS (SELECT series, ts, x - avg(x) OVER (PARTITION BY series) AS e FROM {source}), {name}l AS (SELECT series, e, {lags} FROM {name}e WINDOW w AS (PARTITION BY series ORDER BY ts)),
    {name} AS (SELECT series, count(*) AS n, count(*)::DOUBLE * (count(*) + 2) * ({q}) AS stat FROM {name}l GROUP BY 1)"""


CHI10 = "exp(-stat / 2) * (1 + stat / 2 + pow(stat / 2, 2) / 2 + pow(stat / 2, 3) / 6 + pow(stat / 2, 4) / 24)"


@query(
    "ljung_box",
    f"WITH {RETURNS}, rx AS (SELECT series, ts, ret AS x FROM returns), {ljung_sql('rx')} SELECT series, n::BIGINT AS n, {R('stat')} AS statistic, {R(CHI10)} AS p_value, CASE WHEN {CHI10} > 0.05 THEN 'PASS' ELSE 'FAIL' END AS result FROM lb",
)
def _(t):
    return rounded(stattests.ljung_box(t.returns, keys=["series"], ts="ts", value="ret"))


@query("var_residual_tests")
def _(t):
    return rounded(transmission.residual_tests(transmission.whole_window(panel(t)), criterion="aic"))


# --- comparisons ------------------------------------------------------------


@query(
    "paired_t",
    f"""WITH {BENCHED}, s AS (SELECT series, count(*) AS n, avg(ret - bench) AS m, avg(ret - bench) / (stddev_samp(ret - bench) / sqrt(count(*))) AS stat FROM benched GROUP BY 1)
    SELECT series, n::BIGINT AS n, {R('m')} AS mean_diff, {R('stat')} AS statistic, {R(t_tail('stat', '(n - 1)'))} AS p_value FROM s""",
)
def _(t):
    return rounded(stattests.paired_t(benched(t), keys=["series"], a="ret", b="bench"))


WILCOXON = """d AS (SELECT series, round(ret - bench, 12) AS d FROM benched WHERE round(ret - bench, 12) <> 0), rk AS (SELECT series, d, rank() OVER w + (count(*) OVER (PARTITION BY series, abs(d)) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY series, abs(d)) AS c FROM d WINDOW w AS (PARTITION BY series ORDER BY abs(d))),
  ws AS (SELECT series, count(*) AS n, coalesce(sum(rk) FILTER (d > 0), 0)::DOUBLE AS up, coalesce(sum(rk) FILTER (d < 0), 0)::DOUBLE AS down, sum(c * c - 1)::DOUBLE AS ties FROM rk GROUP BY 1),
  wz AS (SELECT *, (least(up, down) - n * (n + 1) / 4) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM ws)"""


@query(
    "wilcoxon_signed_rank",
    f"WITH {BENCHED}, {WILCOXON} SELECT series, n::BIGINT AS n, {R('up', 2)} AS w_up, {R('down', 2)} AS w_down, {R('least(up, down)', 2)} AS statistic, {R('z', 5)} AS z, {R('least(1, 2 * ' + normal_cdf('(-abs(z))') + ')', 5)} AS p_value FROM wz",
)
def _(t):
    w = stattests.wilcoxon_signed_rank(benched(t), keys=["series"], a="ret", b="bench")
    return w.select("series", "n", *[r(c, 2).alias(c) for c in ("w_up", "w_down", "statistic")], r("z", 5).alias("z"), r("p_value", 5).alias("p_value"))


DM = NAIVE.rsplit(", s AS", 1)[0].replace("f AS (SELECT symbol,", "f AS (SELECT day, symbol,") + """, ls AS (SELECT symbol AS series, day AS ts, (price - last) ** 2 - (price - mean5) ** 2 AS d FROM f WHERE last IS NOT NULL),
  le AS (SELECT series, ts, d - avg(d) OVER (PARTITION BY series) AS e, avg(d) OVER (PARTITION BY series) AS m FROM ls), ll AS (SELECT series, m, e, """ + ", ".join(f"lag(e, {k}) OVER w AS e{k}" for k in range(1, 6)) + """ FROM le WINDOW w AS (PARTITION BY series ORDER BY ts)),
  dm AS (SELECT series, count(*) AS n, any_value(m) AS m, any_value(m) / sqrt((sum(e * e)""" + "".join(f" + 2 * {1 - k / 6} * sum(e * e{k})" for k in range(1, 6)) + """) / count(*) / count(*)) AS stat FROM ll GROUP BY 1)"""


@query(
    "diebold_mariano",
    f"WITH {DM} SELECT series, n::BIGINT AS n, {R('stat', 5)} AS statistic, {R('2 * ' + normal_cdf('(-abs(stat))'), 5)} AS p_value FROM dm",
)
def _(t):
    f = naive_forecasts(t).filter("last is not null").select(
        F.col("symbol").alias("series"), F.col("day").alias("ts"), (F.col("price") - F.col("last")).alias("e1"), (F.col("price") - F.col("mean5")).alias("e2")
    )
    return rounded(stattests.diebold_mariano(f, keys=["series"], ts="ts", e1="e1", e2="e2").select("series", "n", "statistic", "p_value"), 5)


@query(
    "one_sample_t",
    f"""WITH {SHARE}, o AS (SELECT count(*) AS n, avg(theta) AS m, stddev_samp(theta) / sqrt(count(*)) AS se FROM theta WHERE to_series <> from_series)
    SELECT 0::BIGINT AS window_id, n::BIGINT AS n, {R('m')} AS mean, {R('se')} AS std_error, {R('m / se', 4)} AS statistic, {R(t_tail('(m / se)', '(n - 1)'))} AS p_value, {R('m - 2.0930240544 * se')} AS ci_low, {R('m + 2.0930240544 * se')} AS ci_high FROM o""",
)
def _(t):
    off = region_shares(t).filter("to_series <> from_series")
    c = stattests.confidence_bounds(stattests.one_sample_t(off, keys=["window_id"], value="theta"))
    return c.select("window_id", "n", r("statistic", 4).alias("statistic"), *[r(x).alias(x) for x in ("mean", "std_error", "p_value", "ci_low", "ci_high")])


SHARPE = "sh AS (SELECT series, count(ret) AS n, (avg(ret) * 252 - 0.02) / (stddev_samp(ret) * sqrt(252)) AS s FROM returns GROUP BY 1), st AS (SELECT *, s / sqrt((1 + s * s / 2) / n) AS stat FROM sh)"


@query(
    "sharpe_t",
    f"WITH {RETURNS}, {SHARPE} SELECT series, n::BIGINT AS n, {R('s')} AS sharpe, {R('sqrt((1 + s * s / 2) / n)')} AS std_error, {R('stat', 4)} AS statistic, {R(t_tail('stat', '(n - 1)'))} AS p_value FROM st",
)
def _(t):
    s = stattests.sharpe_t(performance.annual_metrics(t.returns, keys=["series"]))
    return s.select("series", "n", r("sharpe").alias("sharpe"), r("std_error").alias("std_error"), r("statistic", 4).alias("statistic"), r("p_value").alias("p_value"))


def anova_sql(table, group, value):
    return f"""gm AS (SELECT {group} AS g, count({value}) AS c, avg({value}) AS m, var_pop({value}) AS v FROM {table} GROUP BY 1),
    an AS (SELECT sum(c) AS n, count(*) AS k, sum(c * v) AS sw, sum(c * pow(m - (SELECT avg({value}) FROM {table}), 2)) AS sb FROM gm), fs AS (SELECT n, k, sb / (k - 1) / (sw / (n - k)) AS stat FROM an)"""


@query(
    "anova_oneway",
    f"WITH {anova_sql('lineitem', 'l_returnflag', 'l_extendedprice')} SELECT n::BIGINT AS n, k::BIGINT AS groups, {R('stat')} AS statistic, {R(f_tail_even('stat', 2, '(n - k)'))} AS p_value FROM fs",
)
def _(t):
    return rounded(stattests.anova_oneway(t.raw("lineitem"), group="l_returnflag", value="l_extendedprice"))


# --- resampling -------------------------------------------------------------

DRAWS = 60


def draw(*parts):
    return f"(('0x' || substr(md5(concat_ws('-', {', '.join(parts)})), 1, 8))::UBIGINT::BIGINT)"


def lines(tag):
    p = stattests.PRIME
    return f"1 + {draw(repr(tag + 'a'), 'b')} % {p} % {p - 1} AS {tag}a, {draw(repr(tag + 'c'), 'b')} % {p} AS {tag}c"


def spread(tag):
    return f"(({tag}a * seed + {tag}c) % {stattests.PRIME})"


def poisson(tag, rate=0.5):
    """Count of the Poisson distribution whose share the number has passed."""
    below = [sum(math.exp(-rate) * rate**i / math.factorial(i) for i in range(k + 1)) for k in range(12)]
    steps = [int(x * stattests.PRIME) for x in below]
    return "(" + " + ".join(f"({spread(tag)} >= {x})::INT" for x in steps if x < stattests.PRIME - 1) + ")"


BREAK = RETURNS + f""", nb AS (SELECT series, ts, ret AS x, row_number() OVER (PARTITION BY series ORDER BY ts) AS pos, count(*) OVER (PARTITION BY series) AS n FROM returns),
  hv AS (SELECT series, n, var_pop(x) FILTER (pos <= n // 2) AS v1, var_pop(x) FILTER (pos > n // 2) AS v2 FROM nb GROUP BY 1, 2), seen AS (SELECT series, n, abs(v1 - v2) / sqrt(v1 + v2) AS stat FROM hv),
  dn AS (SELECT b, {lines('e')}, {lines('l')} FROM range(1, {DRAWS + 1}) g(b)), sd AS (SELECT series, n, x, {draw('series', 'pos')} % {stattests.PRIME} AS seed FROM nb),
  wt AS (SELECT series, b, x, {poisson('e')} AS we, {poisson('l')} AS wl FROM sd, dn),
  mv AS (SELECT series, b, sum(we) AS e0, sum(wl) AS l0, sum(we * x) AS e1, sum(wl * x) AS l1, sum(we * x * x) AS e2, sum(wl * x * x) AS l2 FROM wt GROUP BY 1, 2),
  bv AS (SELECT series, b, e2 / e0 - (e1 / e0) ** 2 AS v1, l2 / l0 - (l1 / l0) ** 2 AS v2 FROM mv WHERE e0 > 0 AND l0 > 0),
  brk AS (SELECT series, n, stat, avg((abs(v1 - v2) / sqrt(v1 + v2) >= stat)::INT) AS p FROM bv JOIN seen USING (series) GROUP BY 1, 2, 3)"""


@query("variance_break_bootstrap", f"WITH {BREAK} SELECT series, n::BIGINT AS n, {R('stat')} AS statistic, {R('p')} AS p_value FROM brk")
def _(t):
    return rounded(stattests.variance_break_bootstrap(t.returns, key="series", ts="ts", value="ret", draws=DRAWS))


EVENT_DAYS = ["2024-01-03", "2025-03-03", "2026-06-01", "2028-02-29"]
EVENT = f"""ev AS (SELECT unnest([{', '.join(f"DATE '{d}'" for d in EVENT_DAYS)}]) AS event), hit AS (SELECT series, event, pos AS at_, n AS n0, least(20, n // 4) AS wd FROM nb JOIN ev ON ts = event),
  near AS (SELECT hit.series, event, x, pos < at_ AS before, row_number() OVER w AS pos, count(*) OVER (PARTITION BY hit.series, event) AS n FROM hit JOIN nb ON nb.series = hit.series AND pos >= at_ - wd AND pos < at_ + wd WINDOW w AS (PARTITION BY hit.series, event ORDER BY pos)),
  side AS (SELECT series, event, max(n) AS n, count(*) FILTER (before) AS nb_, abs(avg(x) FILTER (before) - avg(x) FILTER (NOT before)) AS d FROM near GROUP BY 1, 2),
  epick AS (SELECT series, event, n, b, pos, {draw("concat_ws('-', series, event::DATE::VARCHAR)", "b", "pos")} % n + 1 AS k FROM near, range(1, {DRAWS + 1}) g(b)),
  edraw AS (SELECT e.series, e.event, b, e.pos, x FROM epick e JOIN near ON near.series = e.series AND near.event = e.event AND near.pos = k),
  ed AS (SELECT q.series, q.event, b, abs(avg(x) FILTER (pos <= nb_) - avg(x) FILTER (pos > nb_)) AS dd FROM edraw q JOIN side ON side.series = q.series AND side.event = q.event GROUP BY 1, 2, 3),
  ep AS (SELECT side.series, side.event, CASE WHEN nb_ >= 5 AND n - nb_ >= 5 THEN d ELSE 0 END AS stat, CASE WHEN nb_ >= 5 AND n - nb_ >= 5 THEN avg((dd >= d)::INT) ELSE 1 END AS p FROM side JOIN ed USING (series, event) GROUP BY 1, 2, 3, nb_, n)"""


def event_days(t):
    days = F.array(*[F.lit(d).cast("date") for d in EVENT_DAYS])
    return t.prices.groupBy().agg(F.lit(1)).select(F.explode(days).alias("event"))


@query("event_window_bootstrap", f"WITH {BREAK}, {EVENT} SELECT series, event, {R('stat')} AS statistic, {R('p')} AS p_value FROM ep")
def _(t):
    return rounded(stattests.event_window_bootstrap(t.returns, event_days(t), key="series", ts="ts", value="ret", draws=DRAWS))


SPILL_SIG = f"""{BREAK}, {EVENT}, sig AS (SELECT 'spillover_significance' AS category, series, 'bootstrap' AS test, stat AS statistic, p AS p_value FROM brk UNION ALL SELECT 'spillover_significance', series, 'event_' || event::DATE::VARCHAR, stat, p FROM ep)"""


@query("spill_significance", f"WITH {SPILL_SIG} SELECT category, series, test, {R('statistic')} AS statistic, {R('p_value')} AS p_value, CASE WHEN p_value < 0.05 THEN 'PASS' ELSE 'FAIL' END AS result FROM sig")
def _(t):
    return rounded(spill_results(t))


def spill_results(t):
    return stattests.spill_significance(t.returns, event_days(t), key="series", ts="ts", value="ret", draws=DRAWS)


def mixed(tag):
    return f"(('0x' || substr(md5(concat_ws('-', {tag}, id)), 1, 8))::UBIGINT::BIGINT)"


PERMUTED = f"""li AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_quantity AS q, l_discount AS d, l_extendedprice AS y FROM lineitem),
  px AS (SELECT q, d, row_number() OVER (ORDER BY {mixed(chr(39) + 'row' + chr(39))}, id) AS pos FROM li),
  py AS (SELECT b, y, row_number() OVER (PARTITION BY b ORDER BY CASE WHEN b = 0 THEN {mixed(chr(39) + 'row' + chr(39))} ELSE {mixed('b')} END, id) AS pos FROM li, range(0, 11) g(b)),
  pm AS (SELECT b, count(*) AS n, var_pop(q) AS v1, var_pop(d) AS v2, covar_pop(q, d) AS c12, covar_pop(y, q) AS c1, covar_pop(y, d) AS c2, var_pop(y) AS vy FROM py JOIN px USING (pos) GROUP BY 1),
  pr AS (SELECT b, n, ((c1 * v2 - c2 * c12) * c1 + (c2 * v1 - c1 * c12) * c2) / (v1 * v2 - c12 * c12) / vy AS r2 FROM pm), ps AS (SELECT r2 AS seen FROM pr WHERE b = 0)"""


@query(
    "permutation_test",
    f"WITH {PERMUTED} SELECT n::BIGINT AS n, {R('max(seen)')} AS score, {R('(count(*) FILTER (b > 0 AND r2 >= seen) + 1) / count(*)')} AS p_value FROM pr, ps GROUP BY 1",
)
def _(t):
    li = t.raw("lineitem").withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    scores = stattests.permutation_test(li, id="id", features=["l_quantity", "l_discount"], target="l_extendedprice", draws=10)
    return rounded(stattests.permutation_p(scores))


FOLDS = NAIVE.rsplit(", s AS", 1)[0] + """, sc AS (SELECT symbol AS split, avg((price - last) ** 2) / 1e8 AS last, avg((price - mean5) ** 2) / 1e8 AS mean5, avg((price - mean20) ** 2) / 1e8 AS mean20 FROM f GROUP BY 1),
  long AS (SELECT split, 'last' AS model, last AS score FROM sc UNION ALL SELECT split, 'mean5', mean5 FROM sc UNION ALL SELECT split, 'mean20', mean20 FROM sc)"""
NB = FOLDS + """, nbt AS (SELECT a.model AS model_a, b.model AS model_b, count(*) AS n, avg(a.score - b.score) AS m, var_samp(a.score - b.score) * (1.0 / count(*) + 0.25) AS v FROM long a JOIN long b ON a.split = b.split AND a.model < b.model GROUP BY 1, 2),
  nbs AS (SELECT *, m / sqrt(v) AS stat FROM nbt)"""


def model_scores(t):
    f = naive_forecasts(t)
    names = ["last", "mean5", "mean20"]
    row = f.groupBy(F.col("symbol").alias("split")).agg(*[(F.avg((F.col("price") - F.col(m)) ** 2) / 1e8).alias(m) for m in names])
    return row.unpivot(["split"], names, "model", "score")


@query(
    "corrected_resampled_t",
    f"WITH {NB} SELECT model_a, model_b, n::BIGINT AS n, {R('m')} AS mean_diff, {R('stat', 5)} AS statistic, {R(t_tail('stat', '(n - 1)'), 5)} AS p_value FROM nbs",
)
def _(t):
    c = stattests.corrected_resampled_t(model_scores(t), model="model", split="split", score="score", test_share=0.2)
    return c.select("model_a", "model_b", "n", r("mean_diff").alias("mean_diff"), r("statistic", 5).alias("statistic"), r("p_value", 5).alias("p_value"))


@query(
    "bonferroni",
    f"WITH {RETURNS}, {SHARPE}, pv AS (SELECT series, {t_tail('stat', '(n - 1)')} AS p FROM st) SELECT series, {R('p')} AS p_value, {R('least(1, p * count(*) OVER ())')} AS p_corrected FROM pv",
)
def _(t):
    s = stattests.sharpe_t(performance.annual_metrics(t.returns, keys=["series"]))
    return rounded(stattests.bonferroni(s).select("series", "p_value", "p_corrected"))


SCREEN = ["l_discount", "l_tax", "l_linenumber"]


@query(
    "f_regression_screen",
    "WITH " + "s AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, count(*) AS n, pow(corr({f}, l_quantity), 2) / (1 - pow(corr({f}, l_quantity), 2)) * (count(*) - 2) AS stat FROM lineitem" for f in SCREEN)
    + f") SELECT feature, n::BIGINT AS n, {R('stat', 5)} AS statistic, {R(t_tail('sqrt(stat)', '(n - 2)', 20000), 5)} AS p_value, ({t_tail('sqrt(stat)', '(n - 2)', 20000)} < 0.05)::INT AS significant FROM s",
)
def _(t):
    return rounded(stattests.f_regression_screen(t.raw("lineitem"), features=SCREEN, target="l_quantity"), 5)


# --- result tables ----------------------------------------------------------


@query("stat_suite")
def _(t):
    return rounded(stattests.stat_suite(t.returns, key="series", ts="ts", value="ret"))


RESULTS = f"""{BREAK}, {EVENT}, rx AS (SELECT series, ts, ret AS x FROM returns), {ljung_sql('rx')}, {JB},
  results AS (SELECT 'var_assumptions' AS category, series, 'ljung_box' AS test, stat AS statistic, {CHI10} AS p_value, CASE WHEN {CHI10} > 0.05 THEN 'PASS' ELSE 'FAIL' END AS result FROM lb
  UNION ALL SELECT 'var_assumptions', series, 'jarque_bera_normality', stat, exp(-stat / 2), CASE WHEN exp(-stat / 2) > 0.05 THEN 'PASS' ELSE 'FAIL' END FROM jb
  UNION ALL SELECT 'spillover_significance', series, 'bootstrap', stat, p, CASE WHEN p < 0.05 THEN 'PASS' ELSE 'FAIL' END FROM brk
  UNION ALL SELECT 'spillover_significance', series, 'event_' || event::DATE::VARCHAR, stat, p, CASE WHEN p < 0.05 THEN 'PASS' ELSE 'FAIL' END FROM ep)"""


def results(t):
    def rows(df, name):
        return df.select(F.lit("var_assumptions").alias("category"), "series", F.lit(name).alias("test"), "statistic", "p_value", "result")

    lb = rows(stattests.ljung_box(t.returns, keys=["series"], ts="ts", value="ret"), "ljung_box")
    jb = rows(stattests.jarque_bera(t.returns, keys=["series"], value="ret"), "jarque_bera_normality")
    return lb.unionByName(jb).unionByName(spill_results(t))


@query(
    "test_summary",
    f"""WITH {RESULTS} SELECT category, count(*)::BIGINT AS total, count(*) FILTER (result = 'PASS')::BIGINT AS passed, count(*) FILTER (result = 'FAIL')::BIGINT AS failed,
    count(*) FILTER (result = 'WARNING')::BIGINT AS warning, {R("count(*) FILTER (result = 'PASS') / count(*)")} AS pass_rate FROM results GROUP BY 1""",
)
def _(t):
    return rounded(stattests.test_summary(results(t)))


GRADE = RESULTS + """, gr AS (SELECT count(*) AS total, count(*) FILTER (result = 'PASS') AS passed, (NOT bool_or(contains(test, 'stationarity') AND result = 'FAIL'))::INT AS var_model_valid,
  bool_or(category = 'spillover_significance' AND result = 'PASS')::INT AS spillover_significant, count(*) FILTER (contains(test, 'normality') AND result = 'FAIL') AS normality_failures FROM results),
  grade AS (SELECT *, passed / total AS pass_rate FROM gr)"""


@query(
    "validity_grade",
    f"WITH {GRADE} SELECT total::BIGINT AS total, passed::BIGINT AS passed, var_model_valid, spillover_significant, normality_failures::BIGINT AS normality_failures, {R('pass_rate')} AS pass_rate, CASE WHEN pass_rate >= 0.8 THEN 'HIGH' WHEN pass_rate >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS validity FROM grade",
)
def _(t):
    return rounded(stattests.validity_grade(results(t)))


@query(
    "reliability_score",
    f"WITH {GRADE} SELECT {R('pass_rate')} AS pass_rate, {R('greatest(0, pass_rate - CASE WHEN var_model_valid = 1 THEN 0 ELSE 0.2 END - CASE WHEN spillover_significant = 1 THEN 0 ELSE 0.1 END)')} AS reliability FROM grade",
)
def _(t):
    return rounded(stattests.reliability_score(stattests.validity_grade(results(t))).select("pass_rate", "reliability"))


METRICS = RESULTS + """, metrics AS (SELECT 'pvalue_' || category || '_' || series || '_' || test AS metric, p_value AS value FROM results UNION ALL SELECT 'statistic_' || category || '_' || series || '_' || test, statistic FROM results
  UNION ALL SELECT 'passed_' || category || '_' || series || '_' || test, (result = 'PASS')::INT::DOUBLE FROM results UNION ALL SELECT 'total_tests', count(*)::DOUBLE FROM results
  UNION ALL SELECT 'validation_pass_rate', count(*) FILTER (result = 'PASS') / count(*) FROM results)"""


@query("results_to_metrics", f"WITH {METRICS} SELECT metric, {R('value', 4)} AS value FROM metrics")
def _(t):
    return rounded(stattests.results_to_metrics(results(t)), 4)


@query(
    "metric_category_counts",
    f"""WITH {METRICS} SELECT CASE WHEN contains(metric, 'pvalue') THEN 'P-values' WHEN contains(metric, 'statistic') THEN 'Test Statistics' WHEN contains(metric, 'result') THEN 'Results'
    WHEN contains(metric, 'pass_rate') OR contains(metric, 'passed') THEN 'Pass Rates' WHEN contains(metric, 'validation') OR contains(metric, 'reliable') THEN 'Validation Scores' ELSE 'Other' END AS kind,
    count(*)::BIGINT AS n, count(*) FILTER (contains(metric, 'pvalue') AND value < 0.05)::BIGINT AS significant FROM metrics GROUP BY 1""",
)
def _(t):
    return stattests.metric_category_counts(stattests.results_to_metrics(results(t)))


@query(
    "spill_test_counts",
    f"WITH {SPILL_SIG} SELECT count(*) FILTER (contains(test, 'bootstrap'))::BIGINT AS bootstrap_tests, count(*) FILTER (contains(test, 'event'))::BIGINT AS event_tests, count(*) FILTER (p_value < 0.05)::BIGINT AS significant FROM sig",
)
def _(t):
    return stattests.spill_test_counts(spill_results(t))


@query(
    "significance_label",
    f"""WITH {RETURNS}, {SHARPE}, pv AS (SELECT series, stat, {t_tail('stat', '(n - 1)')} AS p FROM st) SELECT series, {R('p')} AS p_value,
    CASE WHEN p < 0.001 THEN 'highly significant' WHEN p < 0.01 THEN 'very significant' WHEN p < 0.05 THEN 'significant' ELSE 'not significant' END AS significance, CASE WHEN stat > 0 THEN 'positive' ELSE 'negative' END AS sign FROM pv""",
)
def _(t):
    s = stattests.sharpe_t(performance.annual_metrics(t.returns, keys=["series"]))
    return rounded(stattests.significance_label(s).select("series", "p_value", "significance", "sign"))


IR = BENCHED + ", ir AS (SELECT series, avg(ret - bench) * 252 / (stddev_samp(ret - bench) * sqrt(252)) AS x FROM benched GROUP BY 1)"


@query("ir_grade", f"WITH {IR} SELECT series, {R('x')} AS information_ratio, CASE WHEN abs(x) > 1 THEN 'excellent' WHEN abs(x) > 0.5 THEN 'good' ELSE 'limited' END AS ir_grade FROM ir")
def _(t):
    g = stattests.ir_grade(performance.tracking(benched(t), keys=["series"]))
    return rounded(g.select("series", "information_ratio", "ir_grade"))


@query(
    "overall_flags",
    f"""WITH {IR}, {SHARPE}, pv AS (SELECT series, s, {t_tail('stat', '(n - 1)')} AS p FROM st)
    SELECT bool_or(p < 0.05)::INT AS transmission, bool_or(p < 0.05 AND s > 0)::INT AS performance, bool_or(p < 0.05)::INT AS sensitivity, bool_or(p < 0.05 OR abs(x) > 0.5)::INT AS economic FROM pv JOIN ir USING (series)""",
)
def _(t):
    s = stattests.sharpe_t(performance.annual_metrics(t.returns, keys=["series"])).select("series", "sharpe", F.col("p_value").alias("sharpe_p"))
    d = s.join(performance.tracking(benched(t), keys=["series"]), "series")
    return stattests.overall_flags(d.withColumns({"spill_p": F.col("sharpe_p"), "effect_p": F.col("sharpe_p"), "alpha_p": F.col("sharpe_p")}))
