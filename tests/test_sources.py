"""Files in and out, and the streaming aggregate."""

import json

from pyspark.sql import functions as F

from undertow import schemas
from undertow.operators import aggregate
from undertow.plans import panels
from undertow.sources import readers, sinks
from undertow.streaming import hourly


def test_nested_posts(spark, tmp_path):
    posts = [
        {"subreddit": "Bitcoin", "id": "p1", "title": "t", "score": 3, "created_utc": 1704067200, "num_comments": 2,
         "comments": [{"id": "c1", "body": "x", "score": 1, "created_utc": 1704067300, "sentiment": {"label": "positive", "score": 0.9}}, {"id": "c2", "body": "y"}]},
        {"subreddit": "Bitcoin", "id": "p2", "title": "none", "comments": []},
    ]
    (tmp_path / "batch_1.json").write_text(json.dumps(posts))
    raw = readers.scan_nested_posts(spark, str(tmp_path))
    assert {r["batch_file"] for r in raw.collect()} == {"batch_1.json"}
    flat = readers.explode_comments(raw)
    assert len(flat.columns) == 18 and {"post_created_at", "comment_created_at", "batch_file"} <= set(flat.columns)
    rows = {(r["post_id"], r["comment_id"]): r for r in readers.explode_comments(raw).collect()}
    assert set(rows) == {("p1", "c1"), ("p1", "c2"), ("p2", None)}
    assert rows[("p1", "c1")]["sentiment_label"] == "positive" and rows[("p1", "c2")]["sentiment_score"] is None


def test_flat_posts(spark, tmp_path):
    (tmp_path / "BitcoinMarkets_batch_1.json").write_text(json.dumps([{"id": "a", "created_utc": 1704067200, "title": "hi", "score": 5}, {"id": "b", "title": "no time"}]))
    (tmp_path / "Bad_batch_2.json").write_text("{not json")
    bad = readers.unreadable_files(readers.scan_arrays(spark, str(tmp_path), schemas.FLAT_POST)).collect()
    assert [(r["file"], r["n_chars"]) for r in bad] == [("Bad_batch_2.json", 9)]
    rows = readers.scan_flat_posts(spark, str(tmp_path)).collect()
    assert rows[0]["is_original_content"] is False and rows[0]["all_awardings_count"] == 0
    assert [(r["community"], r["id"], r["upvote_ratio"], r["num_comments"]) for r in rows] == [("BitcoinMarkets", "a", 0.5, 0)]


def test_price_files(spark, tmp_path):
    (tmp_path / "btc-usd-max.csv").write_text("snapped_at,price,market_cap,total_volume\n2021-05-01 00:00:00 UTC,10.5,,7\n2020-01-01 00:00:00 UTC,1,1,1\n")
    (tmp_path / "zzz-usd-max.csv").write_text("snapped_at,price,market_cap,total_volume\n2021-05-01 00:00:00 UTC,1,1,1\n")
    raw = readers.scan_prices_csv(spark, str(tmp_path)).withColumn("key", F.lower("symbol"))
    assert {r["symbol"] for r in raw.collect()} == {"BTC", "ZZZ"}
    n = readers.normalize_prices(raw, symbols=schemas.PRICE_SYMBOLS, names=schemas.PRICE_NAMES, key="key", first="2021-01-01", last="2024-12-31").collect()
    assert [(r["symbol"], r["name"], r["price"], r["market_cap"]) for r in n] == [("BTC", "Bitcoin", 10.5, 0.0)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test")], "x int, split string")
    sinks.sink_split_csv(df, str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s/data")).count() == 2
    assert [r["feature"] for r in spark.read.json(str(tmp_path / "s/features")).collect()] == ["x"]
    sinks.sink_results_tables({"a": df, "b": df}, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r/b")).count() == 2
    sinks.sink_network(df, df, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g/edges")).count() == 2


def test_head_per_file_keeps_the_first_rows(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise("cold").alias("file"), "id")
    got = readers.sample_head_per_file(df, "file", "id", 5).collect()
    assert sorted(r["id"] for r in got) == [0, 1, 2, 3, 4, 900, 901, 902, 903, 904]


def measured(spark, rows):
    base = spark.createDataFrame(rows, "community string, id long, ts string, score long, num_comments long").withColumn("ts", F.to_timestamp("ts"))
    return panels.activity(
        base.select("*", F.lit("t").alias("title"), F.lit("moon").alias("body"), F.lit(0.5).alias("upvote_ratio"), F.lit(0).cast("long").alias("gilded"), F.lit(0).cast("long").alias("total_awards_received"))
    )


def test_stream_equals_batch_and_drops_repeats(spark, tmp_path):
    rows = [("a", i, f"2024-01-01 {i // 4:02d}:{i % 4 * 10:02d}:00", i - 3, i) for i in range(20)]
    late_end = ("a", 99, "2024-01-09 00:00:00", 1, 1)
    batch = measured(spark, rows)
    batch.write.parquet(str(tmp_path / "in/1"))
    measured(spark, [rows[3], rows[7]]).write.parquet(str(tmp_path / "in/2"))  # delivered twice
    measured(spark, [late_end]).write.parquet(str(tmp_path / "in/3"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in/*"))
    hourly.write_hourly(hourly.stream_hourly_activity(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r["hour"]: (r["post_count"], r["total_score"], r["bullish_mentions_sum"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["hour"]: (r["post_count"], r["total_score"], r["bullish_mentions_sum"]) for r in aggregate.hourly_activity(batch).collect()}
    assert got == want
    slides = hourly.stream_hourly_activity(stream, width="6 hours", slide="1 hour")
    assert slides.isStreaming
