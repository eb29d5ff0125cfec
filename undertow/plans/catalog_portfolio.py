"""Signals, backtests and performance metrics as checked queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from undertow.operators import performance, portfolio
from undertow.plans import backtest
from undertow.plans.registry import R, query, r, rounded
from undertow.sources.tables import PRICE_DAY_SHIFT, RETURNS

MARKET = f"""day AS (SELECT o_orderpriority AS series, o_orderdate::DATE + {PRICE_DAY_SHIFT} AS ts, avg(o_totalprice) AS price, count(*)::DOUBLE AS volume,
    avg(CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN -1.0 ELSE 0.0 END::DOUBLE) AS value FROM orders GROUP BY 1, 2),
  market AS (SELECT *, volume - avg(volume) OVER (PARTITION BY ts) AS net FROM day)"""


def market(t):
    """Per symbol and day: price, mood of the orders in [-1, 1], and volume against the day's mean."""
    status = F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", -1.0).otherwise(0.0)
    day = t.raw("orders").groupBy(
        F.col("o_orderpriority").alias("series"), F.date_add(F.to_date("o_orderdate"), PRICE_DAY_SHIFT).alias("ts")
    ).agg(F.avg("o_totalprice").alias("price"), F.count(F.lit(1)).cast("double").alias("volume"), F.avg(status).alias("value"))
    return day.withColumn("net", F.col("volume") - F.avg("volume").over(Window.partitionBy("ts")))


SIGNAL = MARKET + """, s1 AS (SELECT *, CASE WHEN count(net) OVER w >= 5 THEN avg(net) OVER w END * CASE WHEN count(value) OVER w >= 5 THEN avg(value) OVER w END AS raw FROM market WINDOW w AS (PARTITION BY series ORDER BY ts ROWS 4 PRECEDING)),
  s2 AS (SELECT *, CASE WHEN count(raw) OVER w >= 252 THEN stddev_samp(raw) OVER w END AS sd FROM s1 WINDOW w AS (PARTITION BY series ORDER BY ts ROWS 251 PRECEDING)),
  s3 AS (SELECT *, CASE WHEN raw / nullif(2 * sd, 0) IS NOT NULL THEN greatest(least(raw / nullif(2 * sd, 0), 1), -1) END AS z FROM s2),
  s4 AS (SELECT ts, series, coalesce(last_value(z IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts), 0) AS signal FROM s3),
  s5 AS (SELECT ts, series, greatest(least(signal, 0.2), -0.2) AS c FROM s4),
  sig AS (SELECT ts, series, coalesce(c * least(1, 1 / nullif(sum(abs(c)) OVER (PARTITION BY ts), 0)), 0) AS signal FROM s5)"""
WEIGHTS = SIGNAL + """, w1 AS (SELECT sig.ts, sig.series, price, signal, sum(abs(signal)) OVER (PARTITION BY sig.ts) AS t, count(*) OVER (PARTITION BY sig.ts) AS c FROM sig JOIN day ON day.ts = sig.ts AND day.series = sig.series),
  wts AS (SELECT ts, series, price, CASE WHEN t > 0 THEN signal / t ELSE 0 END AS weight FROM w1 WHERE c = (SELECT count(DISTINCT series) FROM sig))"""
LITERAL = WEIGHTS + """, pos AS (SELECT *, weight * 100000 / price AS position FROM wts), pre AS (SELECT *, coalesce(lag(position) OVER (PARTITION BY series ORDER BY ts), 0) AS b FROM pos),
  lit AS (SELECT ts, sum(position * price) AS positions_value, sum(abs(position - b) * price * 0.001) AS costs, 100000 + sum(b * price) - sum(abs(position - b) * price * 0.001) AS total_value FROM pre GROUP BY 1)"""
COMPOUND = WEIGHTS + """, h AS (SELECT *, coalesce(lag(weight) OVER w, 0) AS w0, coalesce(price / lag(price) OVER w - 1, 0) AS rr FROM wts WINDOW w AS (PARTITION BY series ORDER BY ts)),
  g AS (SELECT ts, 1 + sum(w0 * rr) AS growth FROM h GROUP BY 1), tv AS (SELECT ts, growth, sum(abs(weight - w0 * (1 + rr) / growth)) AS turnover FROM h JOIN g USING (ts) GROUP BY 1, 2),
  fac AS (SELECT ts, turnover, growth * (1 - 0.001 * turnover) AS factor FROM tv), path AS (SELECT *, min(factor) OVER (ORDER BY ts) > 0 AS alive, product(factor) OVER (ORDER BY ts) AS p FROM fac),
  comp AS (SELECT ts, turnover, CASE WHEN alive THEN 100000 * p ELSE 0 END AS total_value, CASE WHEN alive THEN factor - 1 ELSE 0 END AS daily_return, (NOT alive)::INT AS bankrupt FROM path)"""


def signal(t):
    m = market(t)
    return portfolio.transmission_signal(m.select("ts", "series", "net"), m.select("ts", "series", "value"))


def weights(t):
    return portfolio.target_weights(signal(t), market(t))


@query("transmission_signal", f"WITH {SIGNAL} SELECT ts, series, {R('signal')} AS signal FROM sig")
def _(t):
    return rounded(signal(t))


@query(
    "position_limits",
    f"""WITH {MARKET}, c AS (SELECT ts, series, greatest(least(value, 0.3), -0.3) AS c FROM market)
    SELECT ts, series, {R('coalesce(c * least(1, 1 / nullif(sum(abs(c)) OVER (PARTITION BY ts), 0)), 0)')} AS signal FROM c""",
)
def _(t):
    return rounded(portfolio.position_limits(market(t).select("ts", "series", F.col("value").alias("signal")), max_position=0.3))


@query("target_weights", f"WITH {WEIGHTS} SELECT ts, series, {R('price')} AS price, {R('weight')} AS weight FROM wts")
def _(t):
    return rounded(weights(t))


@query(
    "backtest_literal",
    f"""WITH {LITERAL} SELECT ts, {R('positions_value', 3)} AS positions_value, {R('costs', 3)} AS costs, {R('total_value', 3)} AS total_value,
    {R('coalesce(total_value / lag(total_value) OVER (ORDER BY ts) - 1, 0)')} AS daily_return, {R('total_value / 100000 - 1')} AS cumulative_return FROM lit""",
)
def _(t):
    b = portfolio.backtest_literal(weights(t))
    return b.select("ts", *[r(c, 3).alias(c) for c in ("positions_value", "costs", "total_value")], *[r(c).alias(c) for c in ("daily_return", "cumulative_return")])


@query(
    "backtest_compounding",
    f"""WITH {COMPOUND} SELECT ts, {R('turnover')} AS turnover, {R('total_value', 3)} AS total_value, {R('daily_return')} AS daily_return, bankrupt, {R('total_value / 100000 - 1')} AS cumulative_return FROM comp""",
)
def _(t):
    b = portfolio.backtest_compounding(weights(t))
    return b.select("ts", "bankrupt", r("total_value", 3).alias("total_value"), *[r(c).alias(c) for c in ("turnover", "daily_return", "cumulative_return")])


@query(
    "position_weight_history",
    f"WITH {COMPOUND} SELECT ts, series, {R('weight')} AS weight, {R('weight * total_value / price')} AS position FROM wts JOIN comp USING (ts)",
)
def _(t):
    w = weights(t)
    return rounded(portfolio.position_history(w, portfolio.backtest_compounding(w)))


STRATEGY = MARKET + """, sg AS (SELECT series, ts, CASE WHEN value > 0.6 THEN 1 WHEN value < 0.4 THEN -1 ELSE 0 END AS signal, price FROM market),
  st AS (SELECT series, ts, signal, lag(signal) OVER w * (price / lag(price) OVER w - 1) AS sr, abs(signal - lag(signal) OVER w) AS turn FROM sg WINDOW w AS (PARTITION BY series ORDER BY ts))"""


@query("threshold_strategy", f"WITH {STRATEGY} SELECT series, ts, signal, {R('sr')} AS strategy_return FROM st")
def _(t):
    return rounded(portfolio.threshold_strategy(market(t)))


@query(
    "threshold_strategy_summary",
    f"""WITH {STRATEGY}, c AS (SELECT *, sum(sr) OVER (PARTITION BY series ORDER BY ts) AS c FROM st WHERE sr IS NOT NULL), d AS (SELECT *, c - max(c) OVER (PARTITION BY series ORDER BY ts) AS d FROM c),
    g AS (SELECT series, sum(sr) AS total, avg(sr) * 252 AS ann, avg((sr > 0)::INT) AS win, avg(sr) / nullif(stddev_samp(sr), 0) * sqrt(252) AS sh, min(d) AS dd FROM d GROUP BY 1), tr AS (SELECT series, sum(turn) / 2 AS trades FROM st GROUP BY 1)
    SELECT series, {R('total', 5)} AS total_return, {R('ann', 5)} AS annual_return, {R('win', 5)} AS win_rate, {R('sh', 5)} AS sharpe, {R('dd', 5)} AS max_drawdown, {R('trades', 5)} AS trades, {R('total / nullif(trades, 0)', 5)} AS per_trade FROM g JOIN tr USING (series)""",
)
def _(t):
    return rounded(portfolio.threshold_summary(portfolio.threshold_strategy(market(t))), 5)


@query(
    "benchmark_returns",
    f"""WITH {MARKET}, p AS (SELECT ts, avg(price) AS price FROM market GROUP BY 1), b AS (SELECT ts, price / lag(price) OVER (ORDER BY ts) - 1 AS bench FROM p), i AS (SELECT ts FROM market)
    SELECT i.ts, {R('bench')} AS bench FROM i ASOF LEFT JOIN (SELECT * FROM b WHERE bench IS NOT NULL) b ON i.ts >= b.ts""",
)
def _(t):
    m = market(t)
    p = m.groupBy("ts").agg(F.avg("price").alias("price"))
    return rounded(portfolio.benchmark_returns(p, m))


@query(
    "constant_signal",
    f"WITH {MARKET}, n AS (SELECT series, avg(net) AS net FROM market GROUP BY 1), d AS (SELECT DISTINCT ts FROM market) SELECT ts, series, {R('net', 8)} AS net FROM d CROSS JOIN n",
)
def _(t):
    m = market(t)
    return rounded(portfolio.constant_signal(m.groupBy("series").agg(F.avg("net").alias("net")), m), 8)


BENCHED = RETURNS + ", benched AS (SELECT *, avg(ret) OVER (PARTITION BY ts) AS bench FROM returns)"


def benched(t):
    return t.returns.withColumn("bench", F.avg("ret").over(Window.partitionBy("ts")))


# M: names -> SQL over the group
ANN = {"annual_return": "avg(ret) * 252", "annual_vol": "stddev_samp(ret) * sqrt(252)", "sharpe": "(avg(ret) * 252 - 0.02) / (stddev_samp(ret) * sqrt(252))"}
DOWN = {"downside": "stddev_samp(ret) FILTER (ret < 0) * sqrt(252)", "sortino": "(avg(ret) * 252 - 0.02) / (stddev_samp(ret) FILTER (ret < 0) * sqrt(252))"}
TRACK = {"active_return": "avg(ret - bench) * 252", "tracking_error": "stddev_samp(ret - bench) * sqrt(252)", "information_ratio": "avg(ret - bench) * 252 / (stddev_samp(ret - bench) * sqrt(252))"}
BETA = {"beta": "covar_samp(ret, bench) / var_samp(bench)", "alpha": "avg(ret) * 252 - (0.02 + covar_samp(ret, bench) / var_samp(bench) * (avg(bench) * 252 - 0.02))"}


def cells(table):
    return ", ".join(f"{R(e)} AS {n}" for n, e in table.items())


@query("annual_return_vol_sharpe", f"WITH {RETURNS} SELECT series, count(ret)::BIGINT AS n, {cells(ANN)} FROM returns GROUP BY 1")
def _(t):
    return rounded(performance.annual_metrics(t.returns, keys=["series"]))


@query("sortino", f"WITH {RETURNS} SELECT series, {cells(DOWN)} FROM returns GROUP BY 1")
def _(t):
    return rounded(performance.sortino(t.returns, keys=["series"]))


VAR = "q AS (SELECT series, quantile_cont(ret, 0.05) AS v FROM returns GROUP BY 1), tail AS (SELECT series, v AS var_95, avg(ret) FILTER (ret <= v) AS cvar_95 FROM returns JOIN q USING (series) GROUP BY 1, 2)"


@query("var_cvar_95", f"WITH {RETURNS}, {VAR} SELECT series, {R('var_95')} AS var_95, {R('cvar_95')} AS cvar_95 FROM tail")
def _(t):
    return rounded(performance.var_cvar(t.returns, keys=["series"]))


DRAW = """growth AS (SELECT *, product(1 + ret) OVER (PARTITION BY series ORDER BY ts) AS g FROM returns), pk AS (SELECT *, max(g) OVER (PARTITION BY series ORDER BY ts) AS p FROM growth),
  dd AS (SELECT series, min((g - p) / p) AS max_drawdown, avg(ret) * 252 / abs(min((g - p) / p)) AS calmar FROM pk GROUP BY 1)"""


@query("max_drawdown_calmar", f"WITH {RETURNS}, {DRAW} SELECT series, {R('max_drawdown')} AS max_drawdown, {R('calmar')} AS calmar FROM dd")
def _(t):
    return rounded(performance.drawdown_metrics(t.returns, keys=["series"]))


HIT = {"periods": "count(ret)::BIGINT", "positive": "count(*) FILTER (ret > 0)::BIGINT", "negative": "count(*) FILTER (ret < 0)::BIGINT"}


@query(
    "hit_rate_counts",
    f"WITH {RETURNS} SELECT series, {', '.join(f'{e} AS {n}' for n, e in HIT.items())}, {R('avg((ret > 0)::INT)')} AS hit_rate FROM returns GROUP BY 1",
)
def _(t):
    return rounded(performance.hit_counts(t.returns, keys=["series"]))


@query("tracking_info_ratio", f"WITH {BENCHED} SELECT series, {cells(TRACK)} FROM benched GROUP BY 1")
def _(t):
    return rounded(performance.tracking(benched(t), keys=["series"]))


@query("beta_alpha", f"WITH {BENCHED} SELECT series, {cells(BETA)} FROM benched GROUP BY 1")
def _(t):
    return rounded(performance.beta_alpha(benched(t), keys=["series"]))


ALL = {**ANN, **DOWN, **{k: e for k, e in HIT.items()}, "n": "count(ret)", "hit_rate": "avg((ret > 0)::INT)", **TRACK, **BETA}


@query(
    "performance_report",
    f"WITH {BENCHED}, {VAR}, {DRAW} "
    + " UNION ALL ".join(
        [f"SELECT series, '{n}' AS metric, {R(e)} AS value FROM benched GROUP BY 1" for n, e in ALL.items()]
        + [f"SELECT series, '{n}', {R(n)} FROM tail" for n in ("var_95", "cvar_95")]
        + [f"SELECT series, '{n}', {R(n)} FROM dd" for n in ("max_drawdown", "calmar")]
    ),
)
def _(t):
    return rounded(performance.performance_report(benched(t), key="series", bench="bench"))


@query("run_backtest")
def _(t):
    m = market(t)
    bench = m.groupBy("ts").agg(F.avg("price").alias("price"))
    return rounded(backtest.run_backtest(m.select("ts", "series", "net"), m.select("ts", "series", "value"), m, bench))
