"""Sinks: every result is a folder of files; nothing passes through the driver."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sink_append(df: DataFrame, path: str, day: str | None = None) -> None:
    """Append rows; new columns are allowed (read back with :func:`read_merged`)."""
    writer = df.write.mode("append")
    (writer.partitionBy(day) if day else writer).parquet(path)


def sink_truncate(df: DataFrame, path: str, day: str | None = None) -> None:
    """Replace the table."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(day) if day else writer).parquet(path)


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """Read a table whose files may differ in columns."""
    return spark.read.option("mergeSchema", True).parquet(path)


def sink_feature_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def sink_split_csv(df: DataFrame, path: str, split: str = "split") -> None:
    """Train / validation / test CSV folders in one pass, and the feature list beside them."""
    df.write.mode("overwrite").partitionBy(split).option("header", True).csv(f"{path}/data")
    names = [(c,) for c in df.columns if c != split]
    df.sparkSession.createDataFrame(names, "feature string").coalesce(1).write.mode("overwrite").json(f"{path}/features")


def sink_network(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def sink_results_tables(results: Mapping[str, DataFrame], path: str) -> None:
    """One folder per named result."""
    for name, df in results.items():
        df.withColumn("result", F.lit(name)).write.mode("overwrite").parquet(f"{path}/{name}")
