"""Session defaults, lineage cutting and stored steps."""

from __future__ import annotations

import sys
import tempfile
import uuid
from contextlib import contextmanager
from functools import reduce
from operator import and_

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The workers' functions travel with their code: no executor needs the package installed or on its path.
cloudpickle.register_pickle_by_value(sys.modules["undertow"])


def build_session(app: str = "undertow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (UTC, AQE, skew join)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a ``local`` session without that setting gets a folder of its own; on a
    cluster a missing setting is an error, because a machine-local folder would
    be lost together with its executor.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stash(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, lineage cut, safe from lost executors."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/undertow-{label}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


@contextmanager
def configured(spark: SparkSession, conf: dict[str, str]):
    """Settings that hold for queries made and run inside."""
    before = {key: spark.conf.get(key, None) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def ceiling(limit: int, what: str):
    """``array -> array`` guard: fail the job when a dimension outgrows its bound."""

    def check(column):
        message = F.concat(F.lit(f"too many {what}: "), F.size(column).cast("string"), F.lit(f" > {limit}"))
        return F.when(F.size(column) <= limit, column).otherwise(F.raise_error(message))

    return check


def match(df: DataFrame, other: DataFrame, keys, how: str = "inner", *, small: bool = False) -> DataFrame:
    """Join on ``keys`` where NULL equals NULL, so that rows without a key keep their group; ``small`` broadcasts ``other``."""
    names = {k: f"_on_{i}" for i, k in enumerate(keys)}
    side = other.withColumnsRenamed(names)
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(v)) for k, v in names.items()], F.lit(True))
    return df.join(F.broadcast(side) if small else side, on, how).drop(*names.values())


def attach(df: DataFrame, summary: DataFrame, keys, how: str = "inner", limit: int = 1_000_000) -> DataFrame:
    """Join a per-group summary to the rows it came from, NULL keys included.

    The summary is computed once and counted: up to ``limit`` groups it is
    broadcast, so the rows stay where they are and a hot key costs nothing;
    beyond it the join shuffles (and adaptive execution splits skewed keys).
    """
    made = cut_lineage(summary)
    return match(df, made, list(keys), how, small=made.count() <= limit)
