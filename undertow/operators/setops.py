"""Sorting, top-k, unions and set comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def order_by_keys(df: DataFrame, *keys) -> DataFrame:
    return df.orderBy(*keys)


def topk(df: DataFrame, *, by: str, k: int, ties: str) -> DataFrame:
    """The k largest rows (take-ordered, no full sort), ties broken by name."""
    return df.orderBy(F.desc(by), F.asc(ties)).limit(k)


def topk_communities(df: DataFrame, *, key: str, k: int) -> DataFrame:
    return topk(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")), by="n", k=k, ties=key)


def sorted_net_transmitters(net: DataFrame, *, value: str = "net") -> DataFrame:
    """Net effects in ascending order with their sign class."""
    x = F.col(value)
    return net.withColumn(
        "role", F.when(x > 0, "transmitter").when(x < 0, "receiver").otherwise("neutral")
    ).orderBy(value)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Concatenate frames whose columns may differ."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def common_index(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def missing_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that ``b`` lacks."""
    return a.distinct().join(b, a.columns, "left_anti")


def rank_models(scores: DataFrame, *, model: str = "model", mse: str = "mse") -> DataFrame:
    """Rank by error over the few model rows; best flagged."""
    ranked = scores.withColumn("rank", F.row_number().over(Window.orderBy(mse, model)))
    return ranked.withColumn("best", (F.col("rank") == 1).cast("int"))
