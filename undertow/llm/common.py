"""Small helpers of the operators in this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertow.session import stash  # noqa: F401

SPACE = r"[\x20\x09-\x0D]+"  # fixed value: the white space of the contracts
BATCH_ROWS = 512  # rows handed to Python at once: bounds a worker's memory by text, not by table


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that no column of ``df`` has (names differ in more than case)."""
    taken = {c.lower() for c in df.columns}
    names = []
    for stem in stems:
        while stem.lower() in taken:
            stem = "_" + stem
        taken.add(stem.lower())
        names.append(stem)
    return names


def q(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def word_list(text: Column) -> Column:
    """Words between white space; none for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts`` (a NULL key counts as the empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts


def attach_summary(rows: DataFrame, summary: DataFrame, *keys: str, limit: int = 1_000_000, **sides: Column) -> DataFrame:
    """``rows`` (alias d) joined to a stored summary (alias g), NULL keys included.

    Up to ``limit`` rows the summary is broadcast, so that a hot key moves no row; beyond it the join shuffles
    and adaptive execution splits what is skewed.  ``sides`` gives the key on the side of the rows.
    """
    on = [F.col(f"d.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys] + [c.eqNullSafe(F.col(f"g.{k}")) for k, c in sides.items()]
    g = F.broadcast(summary.alias("g")) if summary.count() <= limit else summary.alias("g")
    whole = on[0]
    for part in on[1:]:
        whole = whole & part
    return rows.alias("d").join(g, whole)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over batches of at most ``BATCH_ROWS`` rows."""

    def run(batches):
        for batch in batches:
            for start in range(0, max(1, batch.num_rows), BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                if part.num_rows:
                    yield part

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # mapInArrow would read a dot in a name as a path
    return plain.mapInArrow(lambda batches: fn(run(batches)), schema)


def texts_of(batch: pa.RecordBatch, at: int) -> list[bytes]:
    """UTF-8 of a string column; empty for NULL."""
    return [b or b"" for b in batch.column(at).cast(pa.binary()).to_pylist()]
