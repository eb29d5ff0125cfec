"""Canonical tables derived from the stored tables.

``comments``  one row per discussion record
``posts``     one row per timed post, with scores but little text
``articles``  one row per post with a long text
``prices``    one row per symbol and day
``bars``      ``comments`` per community and hour: the panel of the series operators

Two SQL fragments per table keep the same rules for checking.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.session import cut_lineage

# Orders start on 1995-01-01 and events on 2024-01-01: prices are moved onto the event calendar.
PRICE_DAY_SHIFT = 10592


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def comments(self) -> DataFrame:
        return self.comments_in()

    def comments_in(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """Comments of a day range; the bounds are set on the stored time, so they reach the file scan."""
        value, raw = F.col("value"), self.raw("events")
        kind = raw.schema["ts"].dataType
        if first is not None:
            raw = raw.filter(F.col("ts") >= F.lit(first).cast(kind))
        if last is not None:
            raw = raw.filter(F.col("ts") < F.date_add(F.lit(last).cast("date"), 1).cast(kind))
        return raw.select(
            F.col("event_type").alias("community"),
            F.col("user_id").alias("post_id"),
            F.col("event_id").alias("comment_id"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.to_date("ts").alias("day"),
            F.least(value / 100, F.lit(1.0)).alias("score"),
            F.when(value < 20, "negative").when(value > 60, "positive").otherwise("neutral").alias("label"),
            F.get_json_object("props", "$.k").cast("long").alias("comment_score"),
            F.floor(value).cast("long").alias("post_score"),
        )

    @cached_property
    def posts(self) -> DataFrame:
        value, k = F.col("value"), F.get_json_object("props", "$.k").cast("long")
        return self.raw("events").select(
            F.col("event_type").alias("community"),
            F.col("event_id").alias("id"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.col("event_type").alias("title"),
            F.col("props").alias("body"),
            (F.floor(value).cast("long") - 20).alias("score"),
            k.alias("num_comments"),
            F.least(value / 100, F.lit(1.0)).alias("upvote_ratio"),
            (value > 100).cast("long").alias("gilded"),
            (k % 5).alias("total_awards_received"),
        )

    @cached_property
    def articles(self) -> DataFrame:
        return self.raw("documents").select(
            F.col("source").alias("community"),
            F.col("doc_id").alias("id"),
            F.lit("").alias("title"),
            F.col("text").alias("body"),
            (F.col("n_chars") % 101 - 20).alias("score"),
            (F.col("n_chars") % 37).alias("num_comments"),
        )

    @cached_property
    def prices(self) -> DataFrame:
        return (
            self.raw("orders")
            .groupBy(
                F.col("o_orderpriority").alias("symbol"),
                F.date_add(F.to_date("o_orderdate"), PRICE_DAY_SHIFT).alias("day"),
            )
            .agg(
                F.avg("o_totalprice").alias("price"),
                F.sum("o_totalprice").alias("market_cap"),
                F.count(F.lit(1)).alias("total_volume"),
            )
        )

    @cached_property
    def bars(self) -> DataFrame:
        return self.comments.groupBy("community", F.date_trunc("hour", "ts").alias("ts")).agg(
            F.avg("score").alias("value"),
            F.count(F.lit(1)).alias("n"),
            F.sum("comment_score").alias("volume"),
        )

    @cached_property
    def flows(self) -> DataFrame:
        """Trade between nations above the average flow: edges (src, dst, weight)."""
        return self.flows_above(0.0)

    @cached_property
    def strong_flows(self) -> DataFrame:
        """The same, at least 1.5 sample deviations above the average."""
        return self.flows_above(1.5)

    def flows_above(self, deviations: float) -> DataFrame:
        nation = self.raw("nation")
        customer = self.raw("customer").select("c_custkey", F.col("c_nationkey").alias("_src"))
        supplier = self.raw("supplier").select("s_suppkey", F.col("s_nationkey").alias("_dst"))
        sold = self.raw("lineitem").select("l_orderkey", "l_suppkey", F.col("l_extendedprice").alias("w"))
        flow = (
            sold.join(self.raw("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy("_src", "_dst")
            .agg(F.sum("w").alias("w"))
            .filter("_src <> _dst")
        )
        flow = cut_lineage(flow)  # one row per pair of nations: every reader would join the tables again
        level = flow.agg(F.avg("w") + deviations * F.stddev_samp("w")).scalar()
        names = [nation.select(F.col("n_nationkey").alias(f"_{c}"), F.col("n_name").alias(c)) for c in ("src", "dst")]
        return (
            flow.filter(F.col("w") > level)
            .join(names[0], "_src")
            .join(names[1], "_dst")
            .select("src", "dst", F.col("w").alias("weight"))
        )

    @cached_property
    def returns(self) -> DataFrame:
        from undertow.operators.features import pct_change

        return pct_change(self.prices, "price", keys=["symbol"], order="day", name="ret").filter("ret is not null").select(
            F.col("symbol").alias("series"), F.col("day").alias("ts"), "ret"
        )


COMMENTS = """comments AS (
  SELECT event_type AS community, user_id AS post_id, event_id AS comment_id, ts, ts::DATE AS day,
         least(value / 100, 1.0::DOUBLE) AS score,
         CASE WHEN value < 20 THEN 'negative' WHEN value > 60 THEN 'positive' ELSE 'neutral' END AS label,
         regexp_extract(props, '[0-9]+')::BIGINT AS comment_score, floor(value)::BIGINT AS post_score
  FROM events)"""
POSTS = """posts AS (
  SELECT event_type AS community, event_id AS id, ts, event_type AS title, props AS body,
         floor(value)::BIGINT - 20 AS score, regexp_extract(props, '[0-9]+')::BIGINT AS num_comments,
         least(value / 100, 1.0::DOUBLE) AS upvote_ratio, (value > 100)::BIGINT AS gilded,
         regexp_extract(props, '[0-9]+')::BIGINT % 5 AS total_awards_received
  FROM events)"""
ARTICLES = """articles AS (
  SELECT source AS community, doc_id AS id, '' AS title, text AS body,
         n_chars % 101 - 20 AS score, n_chars % 37 AS num_comments
  FROM documents)"""
PRICES = f"""prices AS (
  SELECT o_orderpriority AS symbol, o_orderdate::DATE + {PRICE_DAY_SHIFT} AS day, avg(o_totalprice) AS price,
         sum(o_totalprice) AS market_cap, count(*) AS total_volume
  FROM orders GROUP BY 1, 2)"""
BARS = COMMENTS + """, bars AS (
  SELECT community, date_trunc('hour', ts) AS ts, avg(score) AS value, count(*) AS n, sum(comment_score)::BIGINT AS volume
  FROM comments GROUP BY 1, 2)"""
RETURNS = PRICES + """, returns AS (
  SELECT * FROM (SELECT symbol AS series, day AS ts, price / lag(price) OVER (PARTITION BY symbol ORDER BY day) - 1 AS ret
  FROM prices) WHERE ret IS NOT NULL)"""
FLOWS = """flow AS (
  SELECT a.n_name AS src, b.n_name AS dst, sum(l_extendedprice) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON s_nationkey = b.n_nationkey
  WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
edges AS (SELECT src, dst, w AS weight FROM flow WHERE w > (SELECT avg(w) FROM flow)),
strong AS (SELECT src, dst, w AS weight FROM flow WHERE w > (SELECT avg(w) + 1.5 * stddev_samp(w) FROM flow))"""
