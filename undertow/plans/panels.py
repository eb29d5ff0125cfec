"""End-to-end plans: records and prices in, feature panels and transmission results out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undertow import schemas
from undertow.functions import scalars
from undertow.operators import aggregate, causality, features, graph, grid, joins, transmission
from undertow.session import cut_lineage


def activity(posts: DataFrame, *, bullish: Sequence[str] = schemas.BULLISH_WORDS, bearish: Sequence[str] = schemas.BEARISH_WORDS) -> DataFrame:
    """Row-wise measures of a post, as the hourly bars need them."""
    measured = scalars.signed_log_score(scalars.engagement_features(scalars.text_length(posts)))
    return scalars.mention_counts(measured, bullish=bullish, bearish=bearish)


def hourly_panel(
    posts: DataFrame, prices: DataFrame, *, symbols: Mapping[str, str], default: str, widths: Sequence[int] = (6, 24), **words
) -> DataFrame:
    """Hourly activity with rolling sentiment, the community's price of the day and the next move."""
    bars = aggregate.hourly_activity(activity(posts, **words))
    w = features.by_series(["community"], "hour")
    rolled = bars.select(
        "community", "hour", F.to_date("hour").alias("day"), "post_count", "sentiment_score_mean",
        *[F.avg("sentiment_score_mean").over(w.rowsBetween(-(n - 1), 0)).alias(f"mean_{n}") for n in widths],
        *[F.stddev_samp("sentiment_score_mean").over(w.rowsBetween(-(n - 1), 0)).alias(f"std_{n}") for n in widths],
    )
    moves = features.targets_return(prices, "price", keys=["symbol"], order="day")
    return joins.community_symbol_join(rolled, moves, symbols=symbols, default=default, values=["price", "next_return", "next_direction"])


def local_daily(posts: DataFrame, prices: DataFrame, *, symbols: Mapping[str, str] = schemas.COMMUNITY_COIN, default: str = schemas.DEFAULT_COIN, **words) -> DataFrame:
    """Posts -> hourly bars -> days -> price of the community's symbol."""
    daily = aggregate.daily_rollup(aggregate.hourly_activity(activity(posts, **words)))
    return joins.community_symbol_join(daily, prices, symbols=symbols, default=default, values=["price", "market_cap", "total_volume"])


def daily_features(comments: DataFrame, prices: DataFrame, *, alpha: float = 0.05, min_obs: int = 20) -> DataFrame:
    """Daily sentiment, compound score, rolling features, network position of the community, price and targets."""
    daily = cut_lineage(aggregate.daily_sentiment(comments))
    scored = scalars.compound_from_aggregate(daily, pos="avg_pos_score", neg="avg_neg_score")
    scored = features.targets_next(scored.withColumnRenamed("compound", "value"), "value", keys=["community"], order="day")
    w = features.by_series(["community"], "day")
    for n in (6, 24):
        frame = w.rowsBetween(-(n - 1), 0)
        scored = scored.withColumns({f"mean_{n}": F.avg("value").over(frame), f"std_{n}": F.when(F.count("value").over(frame) > 1, F.stddev_samp("value").over(frame))})
    series = grid.min_obs_filter(scored.select("community", F.col("day").alias("ts"), "value"), series="community", value="value", more_than=min_obs)
    edges = cut_lineage(causality.granger_edges(causality.granger_pairwise(series), alpha=alpha).select("src", "dst", "weight"))
    nodes = scored.select(F.col("community").alias("node")).distinct()
    metrics = graph.weighted_degree(edges, nodes).join(graph.pagerank(edges, nodes), "node").join(graph.weighted_clustering(edges, nodes), "node", "left")
    joined = joins.node_feature_join(
        scored, metrics.withColumnRenamed("node", "community"), key="community", features=["in_weight", "out_weight", "net_weight", "rank", "clustering"], keep_all=True
    )
    return joined.join(features.targets_return(prices, "price", keys=["symbol"], order="day").select("symbol", "day", "price", "next_return", "next_direction"), "day")


def spill_dynamics(panel: DataFrame, *, window: int = 252, step: int = 21, min_rolling: int = 500, horizon: int = 10) -> DataFrame:
    """Static effects, the transmission network, and - for long panels - rolling effects: (part, name, ts, value, reason).

    Nothing is invented when a step fails: a failed fit is a row with a reason.
    """
    panel = cut_lineage(panel)
    fits = cut_lineage(transmission.analyse(transmission.whole_window(panel), horizon=horizon))
    theta = cut_lineage(transmission.last_horizon(transmission.theta_table(fits)))
    edges = graph.spill_edges(transmission.spill_pairwise(theta))
    none = F.lit(None)

    def row(df, part, name, value, ts=None, reason=None):
        return df.select(
            F.lit(part).alias("part"), name.alias("name"), (none.cast("timestamp") if ts is None else ts.cast("timestamp")).alias("ts"),
            value.cast("double").alias("value"), (none.cast("string") if reason is None else reason).alias("reason"),
        )

    parts = [
        row(fits, "order", F.lit("p"), F.col("p"), reason=F.col("reason")),
        row(transmission.spill_total(theta), "static", F.lit("total"), F.col("total")),
        row(transmission.spill_net(theta), "net", F.col("series"), F.col("net")),
        row(edges, "edge", F.concat_ws(" -> ", "src", "dst"), F.col("weight")),
    ]
    if panel.select("ts").distinct().count() >= min_rolling:
        rolling = transmission.rolling_spillover(panel, window=window, step=step, horizon=horizon)
        parts.append(row(rolling, "rolling", F.lit("total"), F.col("total"), ts=F.col("date"), reason=F.col("reason")))
    else:
        one = panel.sparkSession.range(1)
        parts.append(row(one, "rolling", F.lit("total"), none, reason=F.lit(f"fewer than {min_rolling} times")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
