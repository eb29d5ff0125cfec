"""Joins, panel features, grid operators and set operations as checked queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from undertow.functions import scalars
from undertow.operators import aggregate, features, joins
from undertow.plans.registry import R, query, r, rounded
from undertow.sources.tables import BARS, COMMENTS, FLOWS, POSTS, PRICES, RETURNS

FIRST, LAST = "2024-01-05", "2024-01-20"
DIRECTION = "CASE WHEN nxt > price THEN 1 WHEN nxt < price THEN -1 ELSE 0 END"
CHANGE = "CASE WHEN prev > 0 THEN (price - prev) / prev ELSE 0 END"
MOVES = PRICES + ", moves AS (SELECT *, lag(price) OVER w AS prev, lead(price) OVER w AS nxt FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY day))"


@query(
    "sentiment_price_join",
    f"""WITH {COMMENTS}, {MOVES}, d AS (SELECT community, day, count(*) AS comments, avg(score) FILTER (label = 'positive') AS p FROM comments GROUP BY 1, 2)
    SELECT community, symbol, day, comments::BIGINT AS comments, {R('p', 10)} AS avg_pos_score, {R('price')} AS price, {DIRECTION} AS price_direction, {R(CHANGE, 10)} AS price_change
    FROM d JOIN moves USING (day) WHERE day BETWEEN DATE '{FIRST}' AND DATE '{LAST}'""",
)
def _(t):
    j = joins.sentiment_price_join(aggregate.daily_sentiment(t.comments_in(FIRST, LAST)), t.prices, first=FIRST, last=LAST)
    return j.select(
        "community", "symbol", "day", "comments", r("avg_pos_score", 10).alias("avg_pos_score"), r("price").alias("price"),
        "price_direction", r("price_change", 10).alias("price_change"),
    )


NEAR = """SELECT v.comment_id, b.buy_id FROM (SELECT * FROM comments WHERE community = 'view') v LEFT JOIN LATERAL (
  SELECT p.comment_id AS buy_id FROM comments p WHERE p.community = 'purchase' AND abs(epoch_us(p.ts) - epoch_us(v.ts)) <= 3600000000 {by}
  ORDER BY abs(epoch_us(p.ts) - epoch_us(v.ts)), p.ts, p.comment_id LIMIT 1) b ON true"""


def views_and_buys(t):
    return (
        t.comments.filter("community = 'view'").select("post_id", "ts", "comment_id"),
        t.comments.filter("community = 'purchase'").select("post_id", "ts", F.col("comment_id").alias("buy_id")),
    )


@query("asof_join_nearest", f"WITH {COMMENTS} " + NEAR.format(by=""))
def _(t):
    views, buys = views_and_buys(t)
    return joins.asof_join_nearest(views, buys, on="ts", left_id="comment_id", right_id="buy_id", tolerance=3600)


@query("asof_join_nearest_by", f"WITH {COMMENTS} " + NEAR.format(by="AND p.post_id = v.post_id"))
def _(t):
    views, buys = views_and_buys(t)
    return joins.asof_join_nearest(
        views, buys, on="ts", left_id="comment_id", right_id="buy_id", tolerance=3600, by=["post_id"]
    ).select("comment_id", "buy_id")


@query(
    "asof_join_backward",
    f"""WITH {COMMENTS}, b AS (SELECT ts, comment_id AS buy_id FROM comments WHERE community = 'purchase')
    SELECT v.comment_id, b.buy_id FROM comments v ASOF LEFT JOIN b ON v.ts >= b.ts WHERE v.community = 'view'""",
)
def _(t):
    views, buys = views_and_buys(t)
    return joins.asof_join_backward(views, buys.drop("post_id"), on="ts", values=["buy_id"]).select("comment_id", "buy_id")


PAIRING = {"click": "1-URGENT", "view": "2-HIGH", "purchase": "5-LOW"}


@query(
    "community_symbol_join",
    f"""WITH {COMMENTS}, {PRICES}, d AS (SELECT community, day, count(*)::BIGINT AS n, CASE community WHEN 'click' THEN '1-URGENT' WHEN 'view' THEN '2-HIGH' WHEN 'purchase' THEN '5-LOW' ELSE '3-MEDIUM' END AS symbol FROM comments GROUP BY 1, 2)
    SELECT community, day, symbol, n, {R('price')} AS price, total_volume::BIGINT AS total_volume FROM d JOIN prices USING (symbol, day)""",
)
def _(t):
    d = aggregate.daily_post_counts(t.comments)
    j = joins.community_symbol_join(d, t.prices, symbols=PAIRING, default="3-MEDIUM", values=["price", "total_volume"])
    return rounded(j.select("community", "day", "symbol", "n", "price", "total_volume"))


@query(
    "align_inner",
    f"""WITH {BARS} SELECT a.ts, {R('a.value', 10)} AS a, {R('b.value', 10)} AS b FROM (SELECT ts, avg(value) AS value FROM bars WHERE community <> 'view' GROUP BY 1) a JOIN bars b ON a.ts = b.ts WHERE b.community = 'view'""",
)
def _(t):
    """One community beside the mean of all others."""
    a = t.bars.filter("community <> 'view'").groupBy("ts").agg(F.avg("value").alias("a"))
    b = t.bars.filter("community = 'view'").select("ts", F.col("value").alias("b"))
    return rounded(joins.align_inner(a, b, on="ts"), 10)


@query("all_ordered_pairs", "SELECT a.n_name AS src, b.n_name AS dst FROM nation a JOIN nation b ON a.n_name <> b.n_name")
def _(t):
    return joins.all_ordered_pairs(t.raw("nation"), key="n_name")


DEGREES = FLOWS + ", deg AS (SELECT src AS node, sum(weight) AS out_w, count(*) AS out_n FROM edges GROUP BY 1)"


@query(
    "node_feature_join",
    f"""WITH {DEGREES} SELECT c_custkey, n_name AS node, {R('coalesce(out_w, 0)', 2)} AS out_w, coalesce(out_n, 0)::BIGINT AS out_n
    FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN deg ON node = n_name""",
)
def _(t):
    deg = t.flows.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("out_w"), F.count("*").alias("out_n"))
    c = t.raw("customer").join(t.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("node"))
    return rounded(joins.node_feature_join(c, deg, key="node", features=["out_w", "out_n"], keep_all=True), 2)


# Nations whose suppliers hold more than the mean of all suppliers.
PRESENT = "present AS (SELECT n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 HAVING avg(s_acctbal) > (SELECT avg(s_acctbal) FROM supplier))"


def present_nations(t):
    s = t.raw("supplier")
    held = s.join(t.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.avg("s_acctbal").alias("_held"))
    return held.filter(F.col("_held") > s.agg(F.avg("s_acctbal")).scalar()).select("n_name")


@query(
    "edge_membership_filter",
    f"""WITH {FLOWS}, {PRESENT}, code AS (SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS code FROM present)
    SELECT src, dst, a.code::BIGINT AS src_code, b.code::BIGINT AS dst_code, {R('weight', 2)} AS weight FROM edges JOIN code a ON src = a.n_name JOIN code b ON dst = b.n_name""",
)
def _(t):
    e = joins.edge_membership_filter(t.flows, present_nations(t), key="n_name")
    return e.select("src", "dst", "src_code", "dst_code", r("weight", 2).alias("weight"))


@query(
    "fallback_complete_graph",
    f"""WITH {PRESENT} SELECT a.n_name AS src, b.n_name AS dst, 1.0::DOUBLE AS weight FROM present a JOIN present b ON a.n_name <> b.n_name""",
)
def _(t):
    """Flows between regions have no end among the nations, so every pair of these is returned."""
    place = t.raw("nation").join(t.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    ends = [place.select(F.col("n_name").alias(c), F.col("r_name").alias(f"_{c}")) for c in ("src", "dst")]
    flows = t.flows.join(ends[0], "src").join(ends[1], "dst").groupBy(F.col("_src").alias("src"), F.col("_dst").alias("dst")).agg(F.sum("weight").alias("weight"))
    return joins.fallback_complete_graph(flows, present_nations(t), key="n_name")


@query(
    "coverage_anti_join",
    f"""WITH {FLOWS}, {PRESENT}, g AS (SELECT src AS n_name FROM edges UNION SELECT dst FROM edges)
    SELECT n_name, 'data_only' AS side FROM present WHERE n_name NOT IN (SELECT n_name FROM g)
    UNION ALL SELECT n_name, 'graph_only' FROM g WHERE n_name NOT IN (SELECT n_name FROM present)
    UNION ALL SELECT n_name, 'common' FROM g WHERE n_name IN (SELECT n_name FROM present)""",
)
def _(t):
    g = t.flows.select(F.col("src").alias("n_name")).union(t.flows.select("dst"))
    return joins.coverage_anti_join(present_nations(t), g, key="n_name")


# --- panel features -------------------------------------------------------


@query(
    "lag_lead_price",
    f"WITH {MOVES} SELECT symbol, day, {R('price')} AS price, {R('prev')} AS prev_price, {R('nxt')} AS next_price FROM moves",
)
def _(t):
    return rounded(features.lag_lead(t.prices, "price", keys=["symbol"], order="day").select("symbol", "day", "price", "prev_price", "next_price"))


@query(
    "price_direction_change",
    f"WITH {MOVES} SELECT symbol, day, {DIRECTION} AS price_direction, {R(CHANGE, 10)} AS price_change FROM moves",
)
def _(t):
    return rounded(features.price_direction_change(t.prices).select("symbol", "day", "price_direction", "price_change"), 10)


def moments_sql(tag, frame):
    w = f"(PARTITION BY community ORDER BY {frame})"
    spread = f"max(score) OVER {w} > min(score) OVER {w}"
    return ", ".join(
        [
            R(f"avg(score) OVER {w}", 10) + f" AS mean_{tag}",
            R(f"stddev_samp(score) OVER {w}") + f" AS std_{tag}",
            R(f"CASE WHEN count(score) OVER {w} >= 3 AND {spread} THEN skewness(score) OVER {w} END", 4) + f" AS skew_{tag}",
            R(f"CASE WHEN count(score) OVER {w} > 3 AND {spread} THEN kurtosis_pop(score) OVER {w} END", 4) + f" AS kurt_{tag}",
        ]
    )


def round_moments(df):
    def digits(c):
        return 10 if c.startswith("mean") else 6 if c.startswith("std") else 4

    return df.select("comment_id", *[r(c, digits(c)).alias(c) for c in df.columns if c.split("_")[0] in ("mean", "std", "skew", "kurt")])


@query(
    "rolling_stats_rows",
    f"WITH {COMMENTS} SELECT comment_id, "
    + ", ".join(moments_sql(w, f"ts, comment_id ROWS {w - 1} PRECEDING") for w in (1, 6, 24))
    + " FROM comments",
)
def _(t):
    c = t.comments.select("community", "ts", "comment_id", "score")
    return round_moments(
        features.rolling_stats_rows(c, "score", keys=["community"], order=["ts", "comment_id"])
    )


@query(
    "rolling_stats_time",
    f"WITH {COMMENTS} SELECT comment_id, "
    + ", ".join(moments_sql(f"{h}h", f"ts RANGE INTERVAL {h} HOURS PRECEDING") for h in (1, 6, 24))
    + " FROM comments",
)
def _(t):
    c = t.comments.select("community", "ts", "comment_id", "score")
    return round_moments(features.rolling_stats_time(c, "score", keys=["community"], ts="ts"))


def rows_back(w):
    return f"(PARTITION BY community ORDER BY ts, comment_id ROWS {w - 1} PRECEDING)"


@query(
    "rolling_vwap_sentiment",
    f"WITH {COMMENTS} SELECT comment_id, "
    + ", ".join(R(f"coalesce(sum(score * comment_score) OVER {rows_back(w)} / nullif(sum(comment_score) OVER {rows_back(w)}, 0), 0)", 12) + f" AS vw_{w}" for w in (6, 24))
    + " FROM comments",
)
def _(t):
    c = t.comments.select("community", "ts", "comment_id", "score", "comment_score")
    v = features.rolling_vwap(c, "score", "comment_score", keys=["community"], order=["ts", "comment_id"], widths=[6, 24])
    return rounded(v.select("comment_id", "vw_6", "vw_24"), 12)


@query(
    "rolling_post_count",
    f"WITH {COMMENTS} SELECT comment_id, (count(*) OVER {rows_back(6)})::BIGINT AS count_6, (count(*) OVER {rows_back(24)})::BIGINT AS count_24, (row_number() OVER (PARTITION BY community ORDER BY ts, comment_id))::BIGINT AS count_all FROM comments",
)
def _(t):
    c = t.comments.select("community", "ts", "comment_id")
    n = features.rolling_counts(c, keys=["community"], order=["ts", "comment_id"], widths=[6, 24])
    return n.select("comment_id", "count_6", "count_24", "count_all")


SIGN = "CASE label WHEN 'positive' THEN 1 WHEN 'neutral' THEN 0 ELSE -1 END"


@query(
    "rolling_emotion_ratio",
    f"""WITH {COMMENTS}, e AS (SELECT *, ({SIGN} = -1 AND score > 0.8)::INT AS fear, ({SIGN} = 1 AND score > 0.8)::INT AS greed, ({SIGN} = 1 AND score < 0.7)::INT AS fomo FROM comments)
    SELECT comment_id, """
    + ", ".join(R(f"avg({e}) OVER {rows_back(24)}", 10) + f" AS {e}_ratio" for e in ("fear", "greed", "fomo"))
    + " FROM e",
)
def _(t):
    e = scalars.emotion_scores_fallback(scalars.compound_sentiment(t.comments))
    e = features.rolling_ratio(
        e, ["fear", "greed", "fomo"], keys=["community"], order=["ts", "comment_id"], width=24
    )
    return rounded(e.select("comment_id", "fear_ratio", "greed_ratio", "fomo_ratio"), 10)


def bar_frame(n):
    return f"(PARTITION BY community ORDER BY ts ROWS {n - 1} PRECEDING)"


def full_sql(f, n):
    return f"CASE WHEN count(value) OVER {bar_frame(n)} >= {n} THEN {f}(value) OVER {bar_frame(n)} END"


@query(
    "moving_average",
    f"WITH {BARS} SELECT community, ts, {R(full_sql('avg', 3), 10)} AS ma_3, {R(full_sql('avg', 7), 10)} AS ma_7 FROM bars",
)
def _(t):
    return rounded(features.moving_average(t.bars, "value", keys=["community"], order="ts").select("community", "ts", "ma_3", "ma_7"), 10)


@query(
    "pct_momentum",
    f"WITH {BARS} SELECT community, ts, {R('value / lag(value) OVER (PARTITION BY community ORDER BY ts) - 1')} AS pct FROM bars",
)
def _(t):
    return rounded(features.pct_change(t.bars, "value", keys=["community"], order="ts").select("community", "ts", "pct"))


@query("rolling_volatility", f"WITH {BARS} SELECT community, ts, {R(full_sql('stddev_samp', 5))} AS vol_5 FROM bars")
def _(t):
    return rounded(features.rolling_volatility(t.bars, "value", keys=["community"], order="ts").select("community", "ts", "vol_5"))


@query(
    "volume_share_weight",
    f"WITH {COMMENTS} SELECT comment_id, {R('score * comment_score / sum(comment_score) OVER (PARTITION BY community)', 9)} AS weighted FROM comments",
)
def _(t):
    return rounded(features.volume_share_weight(t.comments, "score", "comment_score", keys=["community"]).select("comment_id", "weighted"), 9)


@query(
    "cross_section_mean_corr",
    f"WITH {BARS}, m AS (SELECT *, avg(value) OVER (PARTITION BY ts) AS mean FROM bars) SELECT community, {R('corr(value, mean)')} AS corr_with_mean FROM m GROUP BY 1",
)
def _(t):
    return rounded(features.cross_section_mean_corr(t.bars, "value", key="community", ts="ts"))


LEAD = "lead(value) OVER (PARTITION BY community ORDER BY ts)"


@query("targets_next", f"WITH {BARS} SELECT community, ts, {R(LEAD, 10)} AS next_value, {R(LEAD + ' - value', 10)} AS next_change FROM bars")
def _(t):
    return rounded(features.targets_next(t.bars, "value", keys=["community"], order="ts").select("community", "ts", "next_value", "next_change"), 10)


@query(
    "targets_return",
    f"""WITH {MOVES}, n AS (SELECT symbol, day, nxt / price - 1 AS x FROM moves)
    SELECT symbol, day, {R('x')} AS next_return, CASE WHEN x > 0.001 THEN 1 WHEN x < -0.001 THEN -1 ELSE 0 END AS next_direction FROM n""",
)
def _(t):
    return rounded(features.targets_return(t.prices, "price", keys=["symbol"], order="day").select("symbol", "day", "next_return", "next_direction"))


@query(
    "sequence_windows",
    f"""WITH {BARS}, w AS (SELECT community, ts AS window_end,
      list([round(value, 6) + 0.0::DOUBLE, n::DOUBLE]) OVER (PARTITION BY community ORDER BY ts ROWS 11 PRECEDING) AS "window",
      list(round(value, 6) + 0.0::DOUBLE) OVER (PARTITION BY community ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS targets FROM bars)
    SELECT * FROM w WHERE len("window") = 12 AND len(targets) = 3""",
)
def _(t):
    b = t.bars.withColumn("value", r("value"))
    return features.sequence_windows(b, ["value", "n"], "value", keys=["community"], order="ts", length=12, horizon=3)


PATHS = RETURNS + """, growth AS (SELECT *, product(1 + ret) OVER (PARTITION BY series ORDER BY ts) AS growth FROM returns),
  paths AS (SELECT *, max(growth) OVER (PARTITION BY series ORDER BY ts) AS peak FROM growth)"""


@query(
    "cumulative_return",
    f"WITH {PATHS} SELECT series, ts, {R('growth')} AS growth, {R('peak')} AS peak, {R('(growth - peak) / peak')} AS drawdown FROM paths",
)
def _(t):
    return rounded(features.cumulative_return(t.returns, "ret", keys=["series"], order="ts").select("series", "ts", "growth", "peak", "drawdown"))


F252 = "(PARTITION BY series ORDER BY ts ROWS 251 PRECEDING)"


@query(
    "rolling_performance",
    f"""WITH {RETURNS}, p AS (SELECT series, ts, count(*) OVER {F252} AS c, avg(ret) OVER {F252} AS m, stddev_samp(ret) OVER {F252} AS s FROM returns)
    SELECT series, ts, {R('CASE WHEN c >= 252 THEN m / s * sqrt(252) END')} AS roll_sharpe, {R('CASE WHEN c >= 252 THEN s * sqrt(252) END')} AS roll_vol, {R('CASE WHEN c >= 252 THEN m * 252 END')} AS roll_return FROM p""",
)
def _(t):
    return rounded(features.rolling_performance(t.returns, "ret", keys=["series"], order="ts").select("series", "ts", "roll_sharpe", "roll_vol", "roll_return"))


@query(
    "cross_section_dispersion",
    f"WITH {BARS} SELECT ts, {R('stddev_samp(value)')} AS dispersion, {R('avg(value)', 10)} AS level FROM bars GROUP BY 1",
)
def _(t):
    d = features.cross_section_dispersion(t.bars, "value", ts="ts")
    return d.select("ts", r("dispersion").alias("dispersion"), r("level", 10).alias("level"))


@query(
    "autocorr_lag1",
    f"""WITH {BARS}, l AS (SELECT community, value, lag(value) OVER (PARTITION BY community ORDER BY ts) AS b FROM bars)
    SELECT community, {R('corr(value, b)')} AS autocorr, (abs(corr(value, b)) > 0.3)::INT AS autocorrelated FROM l GROUP BY 1""",
)
def _(t):
    return rounded(features.autocorr_lag1(t.bars, "value", keys=["community"], order="ts"))
