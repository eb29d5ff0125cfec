"""Hourly activity as a stream: the batch aggregate of ``hourly_activity``, kept up to date.

Late rows are accepted within the watermark; rows delivered twice count once.
The state holds one row per open (window, community) plus the recent ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.operators.aggregate import hourly_measures


def stream_hourly_activity(
    posts: DataFrame, *, ts: str = "ts", id: str = "id", late: str = "2 hours", width: str = "1 hour", slide: str | None = None
) -> DataFrame:
    """Tumbling (or sliding) windows per community over a stream of measured posts."""
    once = posts.withWatermark(ts, late).dropDuplicatesWithinWatermark([id])
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    bars = once.groupBy(window.alias("w"), "community").agg(*hourly_measures())
    return bars.select(
        "community", F.col("w.start").alias("hour"), *[c for c in bars.columns if c not in ("w", "community", "score_volatility")],
        F.coalesce("score_volatility", F.lit(0.0)).alias("score_volatility"),
    )


def write_hourly(stream: DataFrame, path: str, checkpoint: str):
    """Append closed windows to a table; stops when the available input is used up."""
    return (
        stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
