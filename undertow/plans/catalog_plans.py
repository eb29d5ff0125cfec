"""End-to-end plans and the streaming aggregate as checked queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from undertow.plans import panels
from undertow.plans.catalog_aggregates import ACTIVITY, DOWN, UP, activity_rows, hourly_sql, round_hourly
from undertow.plans.catalog_joins import PAIRING
from undertow.plans.catalog_series import panel
from undertow.plans.registry import R, query, r, rounded
from undertow.session import shared_folder
from undertow.sources.tables import PRICES
from undertow.streaming import hourly

SYMBOL = "CASE community WHEN 'click' THEN '1-URGENT' WHEN 'view' THEN '2-HIGH' WHEN 'purchase' THEN '5-LOW' ELSE '3-MEDIUM' END"
MOVES = PRICES + ", mv AS (SELECT symbol, day, price, x, CASE WHEN x > 0.001 THEN 1 WHEN x < -0.001 THEN -1 ELSE 0 END AS next_direction FROM (SELECT *, lead(price) OVER (PARTITION BY symbol ORDER BY day) / price - 1 AS x FROM prices))"


@query(
    "flagship_panel",
    f"""WITH {ACTIVITY}, h AS (SELECT community, date_trunc('hour', ts) AS hour, count(score) AS post_count, avg(sentiment_score) AS m FROM activity GROUP BY 1, 2), {MOVES},
    rolled AS (SELECT community, hour, hour::DATE AS day, {SYMBOL} AS symbol, post_count, m, avg(m) OVER a AS m6, avg(m) OVER b AS m24, stddev_samp(m) OVER a AS s6, stddev_samp(m) OVER b AS s24 FROM h
      WINDOW a AS (PARTITION BY community ORDER BY hour ROWS 5 PRECEDING), b AS (PARTITION BY community ORDER BY hour ROWS 23 PRECEDING))
    SELECT community, hour, day, symbol, post_count::BIGINT AS post_count, {R('m', 8)} AS sentiment_score_mean, {R('m6', 8)} AS mean_6, {R('m24', 8)} AS mean_24, {R('s6')} AS std_6, {R('s24')} AS std_24,
    {R('price')} AS price, {R('x')} AS next_return, next_direction FROM rolled JOIN mv USING (symbol, day)""",
)
def _(t):
    p = panels.hourly_panel(t.posts, t.prices, symbols=PAIRING, default="3-MEDIUM", bullish=UP, bearish=DOWN)
    return p.select(
        "community", "hour", "day", "symbol", "post_count", *[r(c, 8).alias(c) for c in ("sentiment_score_mean", "mean_6", "mean_24")],
        *[r(c).alias(c) for c in ("std_6", "std_24", "price", "next_return")], "next_direction",
    )


@query(
    "local_daily",
    f"""WITH {ACTIVITY}, h AS ({hourly_sql(digits=12)}), {PRICES}, d AS (SELECT community, hour::DATE AS day, {SYMBOL} AS symbol, sum(post_count) AS post_count, sum(total_score) AS total_score, avg(avg_score) AS a, avg(sentiment_score_mean) AS s,
      sum(num_comments_sum) AS nc, avg(engagement_score_mean) AS e, sum(sentiment_polarity_sum) AS sp FROM h GROUP BY 1, 2)
    SELECT community, day, symbol, post_count::BIGINT AS post_count, total_score::BIGINT AS total_score, {R('a')} AS avg_score, {R('s')} AS sentiment_score_mean, nc::BIGINT AS num_comments_sum, {R('e')} AS engagement_score_mean,
    sp::BIGINT AS sentiment_polarity_sum, {R('price')} AS price, {R('market_cap')} AS market_cap, total_volume::BIGINT AS total_volume FROM d JOIN prices USING (symbol, day)""",
)
def _(t):
    return rounded(panels.local_daily(t.posts, t.prices, symbols=PAIRING, default="3-MEDIUM", bullish=UP, bearish=DOWN))


@query("daily_features")
def _(t):
    return rounded(panels.daily_features(t.comments, t.prices, alpha=0.3), 5)


@query("spill_dynamics")
def _(t):
    return rounded(panels.spill_dynamics(panel(t)), 5)


def streamed(t, **options):
    """Run the stream over the stored posts until its windows are closed, and read the table it wrote."""
    folder = f"{shared_folder(t.spark)}/undertow-stream-{uuid.uuid4().hex}"
    source, out = f"{folder}/in", f"{folder}/out"
    rows = activity_rows(t)
    # A final row one day later moves the watermark past the last window.
    end = rows.agg(F.max(F.struct("ts", *[c for c in rows.columns if c != "ts"])).alias("m")).select("m.*").select(
        *[(F.col("ts") + F.expr("INTERVAL 3 DAYS")).alias("ts") if c == "ts" else F.lit(-1).cast("long").alias("id") if c == "id" else F.col(c) for c in rows.columns]
    )
    rows.write.parquet(f"{source}/1")
    end.write.parquet(f"{source}/2")
    stream = t.spark.readStream.schema(rows.schema).parquet(f"{source}/*")
    hourly.write_hourly(hourly.stream_hourly_activity(stream, **options), out, f"{folder}/state").awaitTermination()
    return t.spark.read.parquet(out)


@query("stream_hourly_activity", f"WITH {ACTIVITY} " + hourly_sql())
def _(t):
    return round_hourly(streamed(t))
