"""Moments, causality and variance decomposition as checked queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from undertow.operators import aggregate, causality, grid, moments, stattests, transmission
from undertow.plans.catalog_aggregates import ACTIVITY, activity_rows, hourly_sql
from undertow.plans.catalog_grid import BFILL, GRID, PANEL, SERIES
from undertow.plans.registry import R, query, r, rounded
from undertow.plans.sqlparts import t_tail
from undertow.session import cut_lineage
from undertow.sources.tables import BARS, COMMENTS, RETURNS

# --- moments ----------------------------------------------------------------

LAGGED = RETURNS + ", d AS (SELECT * FROM (SELECT series, ret AS y, lag(ret, 1) OVER w AS l1, lag(ret, 2) OVER w AS l2 FROM returns WINDOW w AS (PARTITION BY series ORDER BY ts)) WHERE l2 IS NOT NULL)"


@query(
    "lag_design",
    f"WITH {RETURNS} SELECT * FROM (SELECT series, ts, {R('lag(ret, 1) OVER w')} AS ret_l1, {R('lag(ret, 2) OVER w')} AS ret_l2, (row_number() OVER w)::INT AS pos FROM returns WINDOW w AS (PARTITION BY series ORDER BY ts)) WHERE pos > 2",
)
def _(t):
    return rounded(moments.lag_design(t.returns, keys=["series"], ts="ts", values=["ret"], lags=2).select("series", "ts", "ret_l1", "ret_l2", "pos"))


CELLS = [("one", "one"), ("one", "ret_l1"), ("one", "ret_l2"), ("one", "ret"), ("ret_l1", "ret_l1"), ("ret_l1", "ret_l2"), ("ret_l1", "ret"), ("ret_l2", "ret_l2"), ("ret_l2", "ret"), ("ret", "ret")]
SQLNAME = {"one": "1.0", "ret_l1": "l1", "ret_l2": "l2", "ret": "y"}


@query(
    "gram_matrix",
    f"WITH {LAGGED} " + " UNION ALL ".join(f"SELECT series, '{a}' AS a, '{b}' AS b, {R(f'sum({SQLNAME[a]} * {SQLNAME[b]})')} AS s, count(*)::BIGINT AS n FROM d GROUP BY 1" for a, b in CELLS),
)
def _(t):
    d = moments.lag_design(t.returns, keys=["series"], ts="ts", values=["ret"], lags=2).withColumn("one", F.lit(1.0))
    return rounded(moments.gram_cells(d, keys=["series"], columns=["one", "ret_l1", "ret_l2", "ret"]))


OLS2 = """o AS (SELECT *, v1 * v2 - c12 * c12 AS det FROM (SELECT series, count(*) AS n, var_pop(l1) AS v1, var_pop(l2) AS v2, covar_pop(l1, l2) AS c12, covar_pop(y, l1) AS c1, covar_pop(y, l2) AS c2,
  var_pop(y) AS vy, avg(y) AS my, avg(l1) AS m1, avg(l2) AS m2 FROM d GROUP BY 1)),
  b AS (SELECT *, (c1 * v2 - c2 * c12) / det AS b1, (c2 * v1 - c1 * c12) / det AS b2 FROM o),
  f AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0, n * (vy - b1 * c1 - b2 * c2) AS rss FROM b)"""


@query(
    "ols_from_gram",
    f"WITH {LAGGED}, {OLS2} " + " UNION ALL ".join(
        f"SELECT series, n::BIGINT AS n, {R('rss')} AS rss, {R('rss / (n - 3)')} AS sigma2, '{name}' AS term, {R(b)} AS beta, NULL::VARCHAR AS reason FROM f"
        for name, b in (("intercept", "b0"), ("lag1", "b1"), ("lag2", "b2"))
    ),
)
def _(t):
    d = moments.lag_design(t.returns, keys=["series"], ts="ts", values=["ret"], lags=2)
    v = d.select("series", F.array(F.lit(1.0), "ret_l1", "ret_l2", "ret").alias("v"))
    packed = moments.gram_packed(v, keys=["series"], vector="v")
    return rounded(moments.ols_from_gram(packed, keys=["series"], names=["intercept", "lag1", "lag2", "y"]))


# --- causality --------------------------------------------------------------

GRANGER = BARS + f""", pair AS (SELECT a.community AS src, b.community AS dst, a.ts, a.value AS x, b.value AS y FROM bars a JOIN bars b ON a.ts = b.ts AND a.community <> b.community),
  d AS (SELECT * FROM (SELECT src, dst, y, lag(y) OVER w AS y1, lag(x) OVER w AS x1 FROM pair WINDOW w AS (PARTITION BY src, dst ORDER BY ts)) WHERE y1 IS NOT NULL),
  m AS (SELECT src, dst, count(*) AS n, var_pop(y1) AS v1, var_pop(x1) AS v2, covar_pop(y1, x1) AS c12, covar_pop(y, y1) AS c1, covar_pop(y, x1) AS c2, var_pop(y) AS vy FROM d GROUP BY 1, 2),
  s AS (SELECT *, n * (vy - c1 * c1 / v1) AS rr, n * (vy - ((c1 * v2 - c2 * c12) * c1 + (c2 * v1 - c1 * c12) * c2) / (v1 * v2 - c12 * c12)) AS ru FROM m),
  g AS (SELECT src, dst, n + 1 AS n, (rr - ru) / (ru / (n - 3)) AS f_stat, n - 3 AS free FROM s),
  tests AS (SELECT src, dst, 1 AS lag, n::BIGINT AS n, f_stat, CASE WHEN f_stat > 0 THEN {t_tail('sqrt(f_stat)', 'free')} ELSE 1.0 END AS p_value FROM g)"""


@query("granger_pairwise", f"WITH {GRANGER} SELECT src, dst, lag, n, {R('f_stat', 5)} AS f_stat, {R('p_value', 5)} AS p_value FROM tests")
def _(t):
    return rounded(causality.granger_pairwise(t.bars), 5)


@query("granger_pairwise_lag3")
def _(t):
    return rounded(causality.granger_pairwise(t.bars, lag=3), 5)


# Wide significance level: the stored series hardly lead each other.
@query(
    "granger_edges",
    f"WITH {GRANGER} SELECT src, dst, {R('f_stat', 5)} AS f_stat, {R('p_value', 5)} AS p_value, {R('f_stat / (1 + p_value)', 5)} AS weight FROM tests WHERE p_value < 0.3",
)
def _(t):
    e = causality.granger_edges(causality.granger_pairwise(t.bars), alpha=0.3)
    return rounded(e.select("src", "dst", "f_stat", "p_value", "weight"), 5)


HOURLY = f"""{ACTIVITY}, h AS (SELECT community, date_trunc('hour', ts) AS ts, sum(score)::DOUBLE AS value FROM activity GROUP BY 1, 2),
  u AS (SELECT DISTINCT ts FROM h), z AS (SELECT c.community, u.ts, coalesce(h.value, 0) AS value FROM (SELECT DISTINCT community FROM h) c CROSS JOIN u LEFT JOIN h ON h.community = c.community AND h.ts = u.ts)"""
LAGCORR = HOURLY + ", " + """l AS (SELECT community, ts, value, """ + ", ".join(f"lag(value, {i}) OVER w AS v{i}" for i in range(1, 6)) + """ FROM z WINDOW w AS (PARTITION BY community ORDER BY ts)),
  c AS (""" + " UNION ALL ".join(
    f"SELECT a.community AS src, b.community AS dst, {i} AS lag, count(a.v{i}) AS n, corr(a.v{i}, b.value) AS corr FROM l a JOIN l b ON a.ts = b.ts AND a.community <> b.community GROUP BY 1, 2" for i in range(1, 6)
) + f"""), p AS (SELECT *, {t_tail('corr * sqrt((n - 2) / (1 - corr * corr))', '(n - 2)')} AS p_value FROM c),
  scores AS (SELECT src, dst, coalesce(max(abs(corr)) FILTER (p_value < 0.1), 0) AS score FROM p GROUP BY 1, 2)"""


def hourly_filled(t):
    """Hourly score totals, missing community-hours 0."""
    h = aggregate.hourly_activity(activity_rows(t)).select("community", F.col("hour").alias("ts"), F.col("total_score").cast("double").alias("value"))
    cells = h.select("ts").distinct().withColumn("_names", h.agg(F.array_sort(F.collect_set("community"))).scalar())
    cells = cells.select("ts", F.explode("_names").alias("community"))
    return cells.join(h, ["community", "ts"], "left").na.fill(0.0, ["value"])


@query("lagged_corr_score", f"WITH {LAGCORR} SELECT src, dst, {R('score')} AS score FROM scores")
def _(t):
    c = causality.lagged_corr(hourly_filled(t), series="community", ts="ts", value="value")
    return rounded(causality.lagged_corr_score(c))


@query("lagged_corr_network", f"WITH {LAGCORR} SELECT src, dst, {R('score')} AS weight FROM scores WHERE score > 0.05")
def _(t):
    c = causality.lagged_corr(hourly_filled(t), series="community", ts="ts", value="value")
    return rounded(causality.lagged_corr_network(causality.lagged_corr_score(c), above=0.05))


@query("lagged_corr_nodes", f"WITH {HOURLY} SELECT community, sum(value)::BIGINT AS total_posts, {R('avg(value)')} AS avg_activity FROM z GROUP BY 1")
def _(t):
    return rounded(causality.activity_nodes(hourly_filled(t), series="community", value="value"))


CORRNET = BARS + """, half AS (SELECT a.community AS src, b.community AS dst, corr(a.value, b.value) AS corr FROM bars a JOIN bars b ON a.ts = b.ts AND a.community < b.community GROUP BY 1, 2),
  net AS (SELECT src, dst, corr FROM half WHERE abs(corr) > 0.02 UNION ALL SELECT dst, src, corr FROM half WHERE abs(corr) > 0.02)"""


@query("correlation_network", f"WITH {CORRNET} SELECT src, dst, {R('corr')} AS corr, {R('abs(corr)')} AS weight FROM net")
def _(t):
    return rounded(causality.correlation_network(t.bars, series="community", ts="ts", value="value", above=0.02))


@query(
    "causality_matrix",
    f"""WITH {CORRNET}, n AS (SELECT DISTINCT community FROM bars) SELECT a.community AS src, b.community AS dst, {R('coalesce(abs(corr), 0)')} AS weight
    FROM n a JOIN n b ON a.community <> b.community LEFT JOIN net ON src = a.community AND dst = b.community""",
)
def _(t):
    e = causality.correlation_network(t.bars, series="community", ts="ts", value="value", above=0.02)
    return rounded(causality.causality_matrix(e, t.bars, key="community"))


# --- panels and windows -----------------------------------------------------


def panel(t, step=grid.HOUR):
    return cut_lineage(transmission.var_panel(t.comments, series="community", ts="ts", value="score", step=step))


@query("var_panel", f"WITH {PANEL} SELECT ts, series, {R('value', 10)} AS value FROM panel")
def _(t):
    return rounded(panel(t), 10)


@query(
    "var_panel_adaptive",
    f"""WITH {GRID}, f AS (SELECT community AS series, ts, last_value(value IGNORE NULLS) OVER (PARTITION BY community ORDER BY ts ROWS 5 PRECEDING) AS value FROM grid)
    SELECT ts, series, {R('value', 10)} AS value FROM f QUALIFY count(value) OVER (PARTITION BY ts) >= 1""",
)
def _(t):
    return rounded(transmission.var_panel_adaptive(t.bars, series="community", ts="ts", value="value"), 10)


@query("stationarity_decision")
def _(t):
    return rounded(stattests.stationarity_decision(transmission.whole_window(panel(t)), keys=["window_id", "series"], ts="ts", value="value"))


@query("make_stationary")
def _(t):
    return rounded(transmission.make_stationary(transmission.whole_window(panel(t))))


WINDOWS = PANEL + """, times AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM panel)),
  members AS (SELECT ts, w AS window_id FROM times, range(0, 1000) g(w) WHERE n >= 302 AND w * 21 <= i AND i < w * 21 + 252 AND w * 21 + 252 < n)"""


@query("rolling_window_membership", f"WITH {WINDOWS} SELECT window_id::BIGINT AS window_id, count(*)::BIGINT AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM members GROUP BY 1")
def _(t):
    w = transmission.rolling_windows(panel(t))
    return w.groupBy("window_id").agg(F.countDistinct("ts").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(
    "var_lag_cap",
    f"WITH {WINDOWS}, s AS (SELECT window_id, count(DISTINCT ts) AS n, count(DISTINCT series) AS k FROM members JOIN panel USING (ts) GROUP BY 1) SELECT window_id::BIGINT AS window_id, n::BIGINT AS n, k::BIGINT AS k, CASE WHEN n < 100 OR k > 10 THEN 1 ELSE least(10, greatest(1, (n - 20) // (5 * k))) END::INT AS p_max FROM s",
)
def _(t):
    return transmission.var_lag_cap(transmission.rolling_windows(panel(t)))


@query("var_order_select")
def _(t):
    fits = transmission.analyse(transmission.whole_window(panel(t)))
    return fits.select("window_id", "n_rows", "p_max", "p", "reason")


# Two series and one lag have a closed form, so SQL can follow the whole chain: one community beside the mean of all others.
TWO = BARS + """, w AS (SELECT ts, avg(value) FILTER (community <> 'view') AS a, avg(value) FILTER (community = 'view') AS b FROM bars GROUP BY 1 HAVING count(DISTINCT community = 'view') = 2),
  l AS (SELECT a, b, lag(a) OVER (ORDER BY ts) AS a1, lag(b) OVER (ORDER BY ts) AS b1 FROM w),
  m AS (SELECT count(*) AS n, var_pop(a1) AS v1, var_pop(b1) AS v2, covar_pop(a1, b1) AS c12, covar_pop(a, a1) AS aa, covar_pop(a, b1) AS ab, covar_pop(b, a1) AS ba, covar_pop(b, b1) AS bb,
    var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS vab, avg(a) AS ma, avg(b) AS mb, avg(a1) AS m1, avg(b1) AS m2 FROM l WHERE a1 IS NOT NULL),
  q AS (SELECT *, v1 * v2 - c12 * c12 AS det FROM m),
  c AS (SELECT *, (aa * v2 - ab * c12) / det AS a11, (ab * v1 - aa * c12) / det AS a12, (ba * v2 - bb * c12) / det AS a21, (bb * v1 - ba * c12) / det AS a22 FROM q),
  fit AS (SELECT *, ma - a11 * m1 - a12 * m2 AS k1, mb - a21 * m1 - a22 * m2 AS k2, n * (va - a11 * aa - a12 * ab) / (n - 3) AS s11, n * (vab - a11 * ba - a12 * bb) / (n - 3) AS s12,
    n * (vb - a21 * ba - a22 * bb) / (n - 3) AS s22 FROM c)"""
MA = f"""RECURSIVE {TWO}, phi(h, f11, f12, f21, f22) AS (SELECT 0, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL SELECT h + 1, a11 * f11 + a12 * f21, a11 * f12 + a12 * f22, a21 * f11 + a22 * f21, a21 * f12 + a22 * f22 FROM phi, fit WHERE h < 9)"""
CHOL = MA + """, ch AS (SELECT sqrt(s11) AS p11, s12 / sqrt(s11) AS p21, sqrt(s22 - s12 * s12 / s11) AS p22 FROM fit),
  e AS (SELECT h, f11 * p11 + f12 * p21 AS e11, f12 * p22 AS e12, f21 * p11 + f22 * p21 AS e21, f22 * p22 AS e22 FROM phi, ch)"""
GIRF = MA + """, e AS (SELECT h, (f11 * s11 + f12 * s12) / sqrt(s11) AS e11, (f11 * s12 + f12 * s22) / sqrt(s22) AS e12, (f21 * s11 + f22 * s12) / sqrt(s11) AS e21, (f21 * s12 + f22 * s22) / sqrt(s22) AS e22 FROM phi, fit)"""
SHARES = """, part AS (SELECT h + 1 AS h, sum(e11 * e11) OVER w AS q11, sum(e12 * e12) OVER w AS q12, sum(e21 * e21) OVER w AS q21, sum(e22 * e22) OVER w AS q22 FROM e WINDOW w AS (ORDER BY h)),
  theta AS (SELECT h, 'others' AS to_series, 'others' AS from_series, q11 / (q11 + q12) AS theta FROM part UNION ALL SELECT h, 'others', 'view', q12 / (q11 + q12) FROM part
  UNION ALL SELECT h, 'view', 'others', q21 / (q21 + q22) FROM part UNION ALL SELECT h, 'view', 'view', q22 / (q21 + q22) FROM part)"""


def two_series(t):
    side = F.when(F.col("community") == "view", "view").otherwise("others")
    b = t.bars.groupBy("ts", side.alias("series")).agg(F.avg("value").alias("value"))
    n = b.groupBy("ts").agg(F.count(F.lit(1)).alias("c")).filter("c = 2")
    return transmission.whole_window(b.join(n, "ts", "left_semi"))


def two_fit(t, method="cholesky"):
    return transmission.var_fit(transmission.var_moments(two_series(t), max_lags=1), order=1, method=method)


@query(
    "var_fit",
    f"WITH {TWO} " + " UNION ALL ".join(f"SELECT '{name}' AS cell, {R(e, 8)} AS value FROM fit" for name, e in (
        ("intercept_0", "k1"), ("intercept_1", "k2"), ("lags_0", "a11"), ("lags_1", "a12"), ("lags_2", "a21"), ("lags_3", "a22"),
        ("sigma_0", "s11"), ("sigma_1", "s12"), ("sigma_2", "s12"), ("sigma_3", "s22"))),
)
def _(t):
    f = two_fit(t)
    out = None
    for name in ("intercept", "lags", "sigma"):
        part = f.select(F.posexplode(name).alias("i", "value")).select(F.concat(F.lit(f"{name}_"), F.col("i").cast("string")).alias("cell"), "value")
        out = part if out is None else out.unionByName(part)
    return rounded(out, 8)


@query(
    "var_stability",
    f"""WITH {TWO}, e AS (SELECT (a11 + a22) / 2 AS h, (a11 + a22) * (a11 + a22) / 4 - (a11 * a22 - a12 * a21) AS d FROM fit)
    SELECT 0::BIGINT AS window_id, {R('CASE WHEN d >= 0 THEN greatest(abs(h + sqrt(abs(d))), abs(h - sqrt(abs(d)))) ELSE sqrt(h * h - d) END', 8)} AS radius,
    (CASE WHEN d >= 0 THEN greatest(abs(h + sqrt(abs(d))), abs(h - sqrt(abs(d)))) ELSE sqrt(h * h - d) END < 1)::INT AS stable FROM e""",
)
def _(t):
    return rounded(two_fit(t).select("window_id", "radius", (F.col("radius") < 1).cast("int").alias("stable")), 8)


@query(
    "ma_representation",
    f"WITH {MA} SELECT h, {R('f11', 9)} AS f11, {R('f12', 9)} AS f12, {R('f21', 9)} AS f21, {R('f22', 9)} AS f22 FROM phi",
)
def _(t):
    return rounded(transmission.ma_table(two_fit(t)), 9)


THETA = "SELECT 0::BIGINT AS window_id, h, to_series, from_series, {theta} AS theta FROM theta"


@query("fevd", f"WITH {CHOL}{SHARES} " + THETA.format(theta=R("theta", 8)))
def _(t):
    return rounded(transmission.theta_table(two_fit(t)), 8)


@query("fevd_generalized", f"WITH {GIRF}{SHARES} " + THETA.format(theta=R("theta", 8)))
def _(t):
    return rounded(transmission.theta_table(two_fit(t, "generalized")), 8)


# All communities with the order that the criterion chooses have no closed form; tests hold them against least squares.
def panel_fit(t, method="cholesky"):
    return transmission.var_fit(transmission.var_moments(transmission.whole_window(panel(t)), max_lags=10), method=method)


@query("var_fit_panel")
def _(t):
    f = panel_fit(t)
    parts = [f.select(F.lit(c).alias("part"), F.posexplode(c).alias("i", "value")) for c in ("intercept", "lags", "sigma")]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), 8)


@query("var_stability_panel")
def _(t):
    return rounded(panel_fit(t).select("window_id", "n_rows", "p_max", "p", "reason", "radius", (F.col("radius") < 1).alias("stable")), 8)


@query("ma_representation_panel")
def _(t):
    return rounded(transmission.ma_long(panel_fit(t)), 9)


@query("fevd_panel")
def _(t):
    return rounded(transmission.theta_table(panel_fit(t)), 8)


@query("fevd_generalized_panel")
def _(t):
    return rounded(transmission.theta_table(panel_fit(t, "generalized")), 8)


# --- tables of shares -------------------------------------------------------
# A row-normalised table of shares from stored rows: what each region's customers buy from each region.
SHARE = """raw AS (SELECT a.r_name AS to_series, b.r_name AS from_series, sum(l_extendedprice) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation na ON c_nationkey = na.n_nationkey JOIN region a ON na.n_regionkey = a.r_regionkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation nb ON s_nationkey = nb.n_nationkey
  JOIN region b ON nb.n_regionkey = b.r_regionkey GROUP BY 1, 2), theta AS (SELECT 0::BIGINT AS window_id, to_series, from_series, w / sum(w) OVER (PARTITION BY to_series) AS theta FROM raw),
  allof AS (SELECT sum(theta) AS s FROM theta),
  sent AS (SELECT from_series AS series, sum(theta) FILTER (to_series <> from_series) * 100 / any_value(s) AS sent FROM theta, allof GROUP BY 1),
  received AS (SELECT to_series AS series, sum(theta) FILTER (to_series <> from_series) * 100 / any_value(s) AS received FROM theta, allof GROUP BY 1),
  dir AS (SELECT series, sent, received, sent - received AS net FROM sent JOIN received USING (series)),
  pairwise AS (SELECT a.from_series AS src, a.to_series AS dst, (a.theta - b.theta) / s * 100 AS net FROM theta a JOIN theta b ON a.from_series = b.to_series AND a.to_series = b.from_series, allof)"""


def region_shares(t):
    nation, region = t.raw("nation"), t.raw("region")
    place = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    to = t.raw("customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("r_name").alias("to_series"))
    by = t.raw("supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r_name").alias("from_series"))
    li = t.raw("lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    w = (
        li.join(t.raw("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(to, F.col("o_custkey") == F.col("c_custkey")).join(by, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("to_series", "from_series").agg(F.sum("l_extendedprice").alias("w"))
    )
    total = w.groupBy("to_series").agg(F.sum("w").alias("_t"))
    return w.join(total, "to_series").select(F.lit(0).cast("long").alias("window_id"), "to_series", "from_series", (F.col("w") / F.col("_t")).alias("theta"))


@query("spill_total", f"WITH {SHARE} SELECT 0::BIGINT AS window_id, {R('100 * sum(theta) FILTER (to_series <> from_series) / sum(theta)')} AS total FROM theta")
def _(t):
    return rounded(transmission.spill_total(region_shares(t)))


@query("spill_directional", f"WITH {SHARE} SELECT 0::BIGINT AS window_id, series, {R('sent')} AS sent, {R('received')} AS received FROM dir")
def _(t):
    return rounded(transmission.spill_directional(region_shares(t)))


@query("spill_net", f"WITH {SHARE} SELECT 0::BIGINT AS window_id, series, {R('sent')} AS sent, {R('received')} AS received, {R('net')} AS net FROM dir")
def _(t):
    return rounded(transmission.spill_net(region_shares(t)))


@query("spill_pairwise", f"WITH {SHARE} SELECT 0::BIGINT AS window_id, src, dst, {R('net')} AS net FROM pairwise")
def _(t):
    return rounded(transmission.spill_pairwise(region_shares(t)))


@query(
    "spill_table",
    f"""WITH {SHARE} SELECT 0::BIGINT AS window_id, to_series AS "row", from_series AS col, {R('100 * theta')} AS value FROM theta
    UNION ALL SELECT 0, series, 'FROM_others', {R('received')} FROM dir UNION ALL SELECT 0, 'TO_others', series, {R('sent')} FROM dir UNION ALL SELECT 0, 'Net', series, {R('net')} FROM dir
    UNION ALL SELECT 0, 'TO_others', 'FROM_others', {R('100 * sum(theta) FILTER (to_series <> from_series) / sum(theta)')} FROM theta""",
)
def _(t):
    return rounded(transmission.spill_table(region_shares(t)))


@query("rolling_spillover")
def _(t):
    r_ = transmission.rolling_spillover(panel(t))
    return r_.select("window_id", "date", "p", "reason", r("radius").alias("radius"), r("total").alias("total"), F.to_json("net").alias("net"))


@query(
    "spill_param_sweep",
    f"""WITH {BARS}, d AS (SELECT ts, stddev_samp(value) AS d, row_number() OVER (ORDER BY ts) AS i FROM bars GROUP BY 1),
    s AS ({' UNION ALL '.join(f'SELECT {w} AS w, i, avg(d) OVER (ORDER BY ts ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) AS x FROM d' for w in (50, 100, 200))})
    SELECT w AS "window", {R('avg(x)', 8)} AS strength, {R('stddev_pop(x)', 8)} AS spread, {R('avg(x) / (1 + stddev_pop(x))', 8)} AS objective FROM s WHERE i > w GROUP BY 1""",
)
def _(t):
    return rounded(transmission.param_sweep(t.bars, series="community", ts="ts", value="value", windows=[50, 100, 200]), 8)
