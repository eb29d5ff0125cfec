"""Equi joins, as-of joins, dimension pairs and membership joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undertow.functions.scalars import map_value
from undertow.operators import blocks
from undertow.session import attach, ceiling, match


def sentiment_price_join(sentiment: DataFrame, prices: DataFrame, *, first: str | None = None, last: str | None = None) -> DataFrame:
    """Communities x symbols of the same day, with the neighbouring prices.

    A filter cannot pass the window over prices, so the price side is cut by
    hand: the range itself and, per symbol, the last row before and the first
    row after it.
    """
    kept = prices
    if first is not None:
        start = F.lit(first).cast("date")
        kept = kept.filter(F.col("day") >= start).unionByName(_edge(prices.filter(F.col("day") < start), F.max_by))
        sentiment = sentiment.filter(F.col("day") >= start)
    if last is not None:
        stop = F.lit(last).cast("date")
        kept = kept.filter(F.col("day") <= stop).unionByName(_edge(prices.filter(F.col("day") > stop), F.min_by))
        sentiment = sentiment.filter(F.col("day") <= stop)
    by_symbol = Window.partitionBy("symbol").orderBy("day")
    moves = kept.withColumns({"prev_price": F.lag("price").over(by_symbol), "next_price": F.lead("price").over(by_symbol)})
    return sentiment.join(moves, "day").withColumns(
        {
            "price_direction": F.when(F.col("next_price") > F.col("price"), 1).when(F.col("next_price") < F.col("price"), -1).otherwise(0),
            "price_change": F.when(F.col("prev_price") > 0, (F.col("price") - F.col("prev_price")) / F.col("prev_price")).otherwise(0.0),
        }
    )


def _edge(prices: DataFrame, pick) -> DataFrame:
    """The nearest row outside the range, per symbol."""
    row = F.struct(*[F.col(c) for c in prices.columns])
    return prices.groupBy("symbol").agg(pick(row, "day").alias("_r")).select("_r.*")


def asof_join_nearest(
    left: DataFrame,
    right: DataFrame,
    *,
    on: str,
    left_id: str,
    right_id: str,
    tolerance: int,
    by: Sequence[str] = (),
    rows: int | None = None,
) -> DataFrame:
    """Nearest right row within ``tolerance`` seconds of every left row, else NULL.

    Both sides become one stream in time order, cut into even blocks; inside a
    block one scan looks back and one ahead, and block summaries hand the nearest
    right row over the edges.  No left/right pair is ever formed, so a hot key
    or a crowded hour costs its own rows only.  Equal distances: the earlier
    right row wins, then the smaller key (``right_id`` is a number).
    """
    by = list(by)
    us = F.unix_micros(F.col(on).cast("timestamp"))
    number = right.schema[right_id].dataType
    l = left.select(*by, us.alias("_us"), F.col(left_id).alias("_lid"), F.lit(None).cast(number).alias("_rid"), F.xxhash64(left_id).alias("_tie"))
    r = right.select(*by, us.alias("_us"), F.lit(None).cast(left.schema[left_id].dataType).alias("_lid"), F.col(right_id).alias("_rid"), F.xxhash64(right_id).alias("_tie"))
    stream = l.unionByName(r)
    block = blocks.even_block(stream, ["_us", "_tie"], rows)
    stream = stream.withColumn("_block", F.lit(0) if block is None else block)
    known = F.col("_rid").isNotNull()
    back = F.when(known, F.struct(F.col("_us").alias("t"), (-F.col("_rid")).alias("k")))
    forth = F.when(known, F.struct(F.col("_us").alias("t"), F.col("_rid").alias("k")))
    inside = Window.partitionBy(*by, "_block")
    # Looking ahead is a running minimum from the far end: linear, unlike a frame that is open to the future.
    past = inside.orderBy("_us", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    coming = inside.orderBy(F.desc("_us"), F.desc("_tie")).rowsBetween(Window.unboundedPreceding, 0)
    scanned = stream.select(*by, "_block", "_us", "_lid", F.max(back).over(past).alias("_b"), F.min(forth).over(coming).alias("_a"))
    if block is not None:
        edges = stream.groupBy(*by, "_block").agg(F.max(back).alias("_b"), F.min(forth).alias("_a"))
        along = Window.partitionBy(*by)
        earlier = along.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        later = along.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
        edges = edges.select(*by, "_block", F.max("_b").over(earlier).alias("_eb"), F.min("_a").over(later).alias("_ea"))
        scanned = match(scanned, edges, [*by, "_block"])
        scanned = scanned.withColumns({"_b": F.coalesce("_b", "_eb"), "_a": F.coalesce("_a", "_ea")})
    wanted = scanned.filter(F.col("_lid").isNotNull())
    limit = tolerance * 1_000_000
    gap_back, gap_forth = F.col("_us") - F.col("_b.t"), F.col("_a.t") - F.col("_us")
    near_back, near_forth = -F.col("_b.k"), F.col("_a.k")
    near = (
        F.when((gap_back == 0) & (gap_forth == 0), F.least(near_back, near_forth))
        .when((gap_back <= limit) & (gap_forth.isNull() | (gap_back <= gap_forth)), near_back)
        .when(gap_forth <= limit, near_forth)
    )
    return wanted.select(*by, F.col("_lid").alias(left_id), near.alias(right_id))


def asof_join_backward(
    left: DataFrame, right: DataFrame, *, on: str, values: Sequence[str], by: Sequence[str] = (), block: Column | None = None
) -> DataFrame:
    """The latest right values at or before each left time (forward fill onto another index).

    Among right rows of one time a hash of their values decides, so reruns agree.
    """
    by = list(by)
    l = left.select("*", F.lit(1).alias("_side"), F.xxhash64(*[c for c, kind in left.dtypes if "map<" not in kind]).alias("_tie"))
    r = right.select(*by, on, F.lit(0).alias("_side"), F.xxhash64(*values).alias("_tie"), *[F.col(v).alias(f"_r_{v}") for v in values])
    stream = l.unionByName(r, allowMissingColumns=True)
    carried = blocks.carry(stream, by, [on, "_side", "_tie"], {f"_c_{v}": f"_r_{v}" for v in values}, block)
    return carried.filter("_side = 1").select(*left.columns, *[F.col(f"_c_{v}").alias(v) for v in values])


def community_symbol_join(
    daily: DataFrame, prices: DataFrame, *, symbols: Mapping[str, str], default: str, values: Sequence[str]
) -> DataFrame:
    """Community -> symbol by dictionary, then the first price row of (symbol, day)."""
    one = prices.groupBy("symbol", "day").agg(F.min_by(F.struct(*values), F.struct(*values)).alias("p")).select("symbol", "day", "p.*")
    tagged = daily.withColumn("symbol", F.coalesce(map_value(F.col("community"), symbols), F.lit(default)))
    return tagged.join(one, ["symbol", "day"])


def align_inner(a: DataFrame, b: DataFrame, *, on: str) -> DataFrame:
    return a.join(b, on).na.drop()


def all_ordered_pairs(df: DataFrame, *, key: str, max_series: int = 2000) -> DataFrame:
    """Every ordered pair of distinct series, from the series dimension only.

    The dimension is one row of at most ``max_series`` names; beyond that the
    job fails instead of growing quadratically.
    """
    # One name beyond the bound is enough to know that it is broken, so the guard itself stays small.
    names = df.select(key).distinct().limit(max_series + 1).agg(F.array_sort(F.collect_set(key)).alias("_all"))
    checked = names.select(ceiling(max_series, "series")(F.col("_all")).alias("_all"))
    return (
        checked.select(F.explode("_all").alias("src"), "_all")
        .select("src", F.explode("_all").alias("dst"))
        .filter("src <> dst")
    )


def node_feature_join(df: DataFrame, nodes: DataFrame, *, key: str, features: Sequence[str], keep_all: bool = False) -> DataFrame:
    """Node metrics on every row; rows of unknown nodes are dropped, or kept with zeros."""
    joined = attach(df, nodes.select(key, *features), [key], "left" if keep_all else "inner")
    return joined.na.fill(0, list(features)) if keep_all else joined


def edge_membership_filter(edges: DataFrame, present: DataFrame, *, key: str) -> DataFrame:
    """Edges whose two ends have data, with ends coded 0..n-1 in name order."""
    names = present.select(key).distinct()
    code = blocks.positions(names, [], [key], name="_p").select(F.col(key), (F.col("_p") - 1).alias("code"))
    return (
        edges.join(code.select(F.col(key).alias("src"), F.col("code").alias("src_code")), "src")
        .join(code.select(F.col(key).alias("dst"), F.col("code").alias("dst_code")), "dst")
    )


def fallback_complete_graph(edges: DataFrame, present: DataFrame, *, key: str) -> DataFrame:
    """The valid edges, or - when there is none - every ordered pair with weight 1."""
    names = present.select(key).distinct()
    valid = edges.join(names.select(F.col(key).alias("src")), "src", "left_semi").join(
        names.select(F.col(key).alias("dst")), "dst", "left_semi"
    ).select("src", "dst", F.col("weight").cast("double").alias("weight"))
    n_valid = valid.agg(F.count(F.lit(1))).scalar()
    complete = all_ordered_pairs(names, key=key).filter(n_valid == 0).withColumn("weight", F.lit(1.0))
    return valid.unionByName(complete)


def coverage_anti_join(data: DataFrame, graph: DataFrame, *, key: str) -> DataFrame:
    """Names only in the data, only in the graph, and common: (side, name)."""
    a, b = data.select(key).distinct(), graph.select(key).distinct()
    return (
        a.join(b, key, "left_anti").withColumn("side", F.lit("data_only"))
        .unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("graph_only")))
        .unionByName(a.join(b, key, "left_semi").withColumn("side", F.lit("common")))
    )
