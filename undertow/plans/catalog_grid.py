"""Time grid and set operations as checked queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from undertow.operators import features, grid, setops
from undertow.plans.registry import R, query, r, rounded
from undertow.sources.tables import BARS, COMMENTS, FLOWS, PRICES

SERIES = ["click", "error", "purchase", "signup", "view"]
GRID = BARS + """, grid AS (
  SELECT c.community, g.ts, b.value FROM (SELECT DISTINCT community FROM bars) c
  CROSS JOIN (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM bars) g
  LEFT JOIN bars b ON b.community = c.community AND b.ts = g.ts)"""
FFILL = GRID + """, ffilled AS (SELECT community, ts, last_value(value IGNORE NULLS) OVER (PARTITION BY community ORDER BY ts ROWS 3 PRECEDING) AS value FROM grid)"""
BFILL = FFILL + """, filled AS (SELECT community, ts, first_value(value IGNORE NULLS) OVER (PARTITION BY community ORDER BY ts ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS value FROM ffilled)"""
PANEL = BFILL + """, kept AS (SELECT * FROM filled WHERE community IN (SELECT community FROM filled GROUP BY 1 HAVING avg((value IS NULL)::INT) <= 0.3)),
  panel AS (SELECT ts, community AS series, value FROM kept QUALIFY count(value) OVER (PARTITION BY ts) = count(*) OVER (PARTITION BY ts))"""


def gridded(t, step=grid.HOUR):
    return grid.resample_mean(t.comments, series="community", ts="ts", value="score", step=step).withColumnRenamed("score", "value")


@query("resample_mean", f"WITH {GRID} SELECT community, ts, {R('value', 10)} AS value FROM grid")
def _(t):
    return rounded(gridded(t), 10)


def resample_sql(step, bin):
    return f"""WITH {COMMENTS}, b AS (SELECT community, {bin} AS ts, avg(score) AS value FROM comments GROUP BY 1, 2)
    SELECT c.community, g.ts, {R('b.value', 10)} AS value FROM (SELECT DISTINCT community FROM b) c CROSS JOIN (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL {step})) AS ts FROM b) g
    LEFT JOIN b ON b.community = c.community AND b.ts = g.ts"""


@query("resample_mean_15min", resample_sql("15 MINUTES", "time_bucket(INTERVAL 15 MINUTES, ts)"))
def _(t):
    return rounded(gridded(t, grid.MINUTES_15), 10)


@query("resample_mean_daily", resample_sql("1 DAY", "date_trunc('day', ts)"))
def _(t):
    return rounded(gridded(t, grid.DAY), 10)


@query(
    "infer_frequency",
    f"""WITH {BARS}, u AS (SELECT DISTINCT ts FROM bars), g AS (SELECT epoch(ts - lag(ts) OVER (ORDER BY ts)) AS gap FROM u)
    SELECT quantile_cont(gap, 0.5)::DOUBLE AS median_gap, CASE WHEN quantile_cont(gap, 0.5) > 3600 THEN 86400 WHEN quantile_cont(gap, 0.5) > 900 THEN 3600 ELSE 900 END AS step FROM g""",
)
def _(t):
    return grid.infer_frequency(t.bars, ts="ts")


@query("ffill_limited", f"WITH {FFILL} SELECT community, ts, {R('value', 10)} AS value FROM ffilled")
def _(t):
    return rounded(grid.ffill_limited(gridded(t), keys=["community"], ts="ts", value="value"), 10)


@query("bfill_limited", f"WITH {BFILL} SELECT community, ts, {R('value', 10)} AS value FROM filled")
def _(t):
    g = grid.ffill_limited(gridded(t), keys=["community"], ts="ts", value="value")
    return rounded(grid.bfill_limited(g, keys=["community"], ts="ts", value="value"), 10)


FINE = f"""{COMMENTS}, b AS (SELECT community, time_bucket(INTERVAL 15 MINUTES, ts) AS ts, avg(score) AS value FROM comments GROUP BY 1, 2),
  fine AS (SELECT c.community, g.ts, b.value FROM (SELECT DISTINCT community FROM b) c CROSS JOIN (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 15 MINUTES)) AS ts FROM b) g
  LEFT JOIN b ON b.community = c.community AND b.ts = g.ts)"""


@query(
    "drop_sparse_series",
    f"WITH {FINE} SELECT community, ts, {R('value', 10)} AS value FROM fine WHERE community IN (SELECT community FROM fine GROUP BY 1 HAVING avg((value IS NULL)::INT) <= 0.5)",
)
def _(t):
    return rounded(grid.drop_sparse_series(gridded(t, grid.MINUTES_15), series="community", value="value", max_missing=0.5), 10)


@query(
    "complete_rows",
    f"WITH {GRID} SELECT community, ts, {R('value', 10)} AS value FROM grid QUALIFY count(value) OVER (PARTITION BY ts) = count(*) OVER (PARTITION BY ts)",
)
def _(t):
    return rounded(grid.complete_rows(gridded(t), ts="ts", value="value"), 10)


@query(
    "complete_rows_any",
    f"WITH {GRID} SELECT community, ts, {R('value', 10)} AS value FROM grid QUALIFY count(value) OVER (PARTITION BY ts) >= 1",
)
def _(t):
    return rounded(grid.complete_rows(gridded(t), ts="ts", value="value", how="any"), 10)


@query(
    "min_obs_filter",
    "SELECT user_id, event_id, value FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(value) > 67)",
)
def _(t):
    return grid.min_obs_filter(t.raw("events").select("user_id", "event_id", "value"), series="user_id", value="value", more_than=67)


@query(
    "pivot_wide",
    f"WITH {BARS} SELECT ts, " + ", ".join(R(f"coalesce(avg(value) FILTER (community = '{s}'), 0)", 10) + f' AS "{s}"' for s in SERIES) + " FROM bars GROUP BY 1",
)
def _(t):
    return rounded(grid.pivot_wide(t.bars, ts="ts", series="community", value="value", names=SERIES, fill=0.0), 10)


LABELS = ["positive", "neutral", "negative"]


@query(
    "pivot_two_level",
    f"WITH {COMMENTS} SELECT day, " + ", ".join(f"count(*) FILTER (community = '{s}' AND label = '{x}')::BIGINT AS {s}_{x}" for s in SERIES for x in LABELS) + " FROM comments GROUP BY 1",
)
def _(t):
    return grid.pivot_two_level(t.comments, ts="day", outer="community", inner="label", names=[f"{s}_{x}" for s in SERIES for x in LABELS])


LAG = "lag(value) OVER (PARTITION BY community ORDER BY ts)"


@query("first_difference", f"WITH {BARS} SELECT community, ts, {R('value - ' + LAG, 10)} AS diff FROM bars")
def _(t):
    return rounded(grid.first_difference(t.bars, keys=["community"], ts="ts", value="value").select("community", "ts", "diff"), 10)


@query(
    "log_difference",
    f"""WITH {BARS}, x AS (SELECT community, ts, CASE WHEN community IN ('click', 'view') THEN value ELSE value - 0.3 END AS value FROM bars)
    SELECT community, ts, {R(f"CASE WHEN min(value) OVER (PARTITION BY community) > 0 THEN ln(CASE WHEN value > 0 THEN value END) - ln(CASE WHEN {LAG} > 0 THEN {LAG} END) ELSE value - {LAG} END", 8)} AS log_diff FROM x""",
)
def _(t):
    x = t.bars.withColumn("value", F.when(F.col("community").isin("click", "view"), F.col("value")).otherwise(F.col("value") - 0.3))
    return rounded(grid.log_difference(x, keys=["community"], ts="ts", value="value").select("community", "ts", "log_diff"), 8)


@query(
    "standardize",
    f"WITH {BARS} SELECT community, ts, {R('(value - avg(value) OVER w) / stddev_samp(value) OVER w', 8)} AS z FROM bars WINDOW w AS (PARTITION BY community)",
)
def _(t):
    return rounded(grid.standardize(t.bars, keys=["community"], value="value").select("community", "ts", "z"), 8)


# --- sorting and sets -------------------------------------------------------


@query("order_by_keys", f"WITH {PRICES} SELECT symbol, day, {R('price')} AS price FROM prices ORDER BY symbol, day DESC")
def _(t):
    return setops.order_by_keys(rounded(t.prices.select("symbol", "day", "price")), "symbol", F.desc("day"))


SPREAD = "SELECT i AS feature, var_pop(x) AS importance FROM (SELECT unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1"


@query("topk_importance", f"SELECT feature::INT AS feature, {R('importance', 9)} AS importance FROM ({SPREAD}) ORDER BY importance DESC, feature LIMIT 15")
def _(t):
    e = t.raw("embeddings").select(F.posexplode("embedding").alias("feature", "x"))
    imp = e.groupBy("feature").agg(F.var_pop(F.col("x").cast("double")).alias("importance"))
    return rounded(setops.topk(imp, by="importance", k=15, ties="feature"), 9)


@query("topk_communities", "SELECT user_id, count(*)::BIGINT AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def _(t):
    return setops.topk_communities(t.raw("events"), key="user_id", k=10)


NET = FLOWS + ", net AS (SELECT node, sum(w) AS net FROM (SELECT src AS node, weight AS w FROM edges UNION ALL SELECT dst, -weight FROM edges) GROUP BY 1)"


@query(
    "sorted_net_transmitters",
    f"WITH {NET} SELECT node, {R('net', 2)} AS net, CASE WHEN net > 0 THEN 'transmitter' WHEN net < 0 THEN 'receiver' ELSE 'neutral' END AS role FROM net ORDER BY net",
)
def _(t):
    e = t.flows
    net = e.select(F.col("src").alias("node"), F.col("weight").alias("w")).union(e.select("dst", -F.col("weight"))).groupBy("node").agg(F.sum("w").alias("net"))
    return setops.sorted_net_transmitters(net).select("node", r("net", 2).alias("net"), "role")


@query(
    "union_files",
    "SELECT event_id AS id, event_type AS community, NULL::BIGINT AS n_chars FROM events UNION ALL SELECT doc_id, source, n_chars FROM documents",
)
def _(t):
    a = t.raw("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("community"))
    b = t.raw("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("community"), "n_chars")
    return setops.union_all([a, b])


@query("common_index", f"WITH {COMMENTS}, {PRICES} SELECT day FROM comments INTERSECT SELECT day FROM prices")
def _(t):
    return setops.common_index(t.comments.select("day"), t.prices.select("day"))


@query("missing_sets", f"WITH {COMMENTS}, {PRICES} SELECT day FROM prices EXCEPT SELECT day FROM comments")
def _(t):
    return setops.missing_sets(t.prices.select("day"), t.comments.select("day"))


NAIVE = f"""{PRICES}, f AS (SELECT symbol, price, lag(price) OVER w AS last, avg(price) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS mean5,
  avg(price) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS mean20 FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY day)),
  s AS (SELECT 'last' AS model, avg((price - last) ** 2) AS mse FROM f UNION ALL SELECT 'mean5', avg((price - mean5) ** 2) FROM f UNION ALL SELECT 'mean20', avg((price - mean20) ** 2) FROM f)"""


def naive_forecasts(t):
    w = features.by_series(["symbol"], "day")
    return t.prices.select(
        "symbol", "day", "price", F.lag("price").over(w).alias("last"), F.avg("price").over(w.rowsBetween(-5, -1)).alias("mean5"),
        F.avg("price").over(w.rowsBetween(-20, -1)).alias("mean20"),
    )


@query("rank_models", f"WITH {NAIVE} SELECT model, {R('mse', 1)} AS mse, row_number() OVER (ORDER BY mse, model)::INT AS rank, (row_number() OVER (ORDER BY mse, model) = 1)::INT AS best FROM s")
def _(t):
    f = naive_forecasts(t)
    names = ["last", "mean5", "mean20"]
    row = f.agg(*[F.avg((F.col("price") - F.col(m)) ** 2).alias(m) for m in names])
    ranked = setops.rank_models(row.unpivot([], names, "model", "mse"))
    return rounded(ranked, 1)
