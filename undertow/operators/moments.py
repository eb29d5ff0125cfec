"""Moment matrices: sums of products over all rows, solved as small matrices.

Rows never leave their partition: each task turns its rows into packed partial
matrices, and only those (a few hundred numbers per group) are shuffled.  All
matrices are centred and merged with their means, so an offset of the data costs
no digits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAN = 64  # tasks whose matrices are merged at once
MOST_HELD = 2000  # groups whose matrices a task holds before it hands them on, if they fit into
HELD_BYTES = 1 << 28


def lag_design(df: DataFrame, *, keys: Sequence[str], ts: str, values: Sequence[str], lags: int, trim: bool = True) -> DataFrame:
    """Columns ``<value>_l1..p`` inside each group of bars, and the row position."""
    w = Window.partitionBy(*keys).orderBy(ts)
    made = {f"{v}_l{i}": F.lag(v, i).over(w) for v in values for i in range(1, lags + 1)}
    out = df.withColumns({**made, "pos": F.row_number().over(w)})
    return out.filter(F.col("pos") > lags) if trim else out


def gram_cells(df: DataFrame, *, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Sum of products of every column pair, JVM-side: (keys, a, b, s, n) for few columns."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(a).cast("double") * F.col(b)).alias(f"{a}|{b}") for a, b in pairs]
    )
    long = row.unpivot([*keys, "n"], [f"`{a}|{b}`" for a, b in pairs], "pair", "s")
    parts = F.split("pair", r"\|")
    return long.select(*keys, parts[0].alias("a"), parts[1].alias("b"), "s", "n")


def merge(parts: Sequence[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, means and centred moment matrix of several parts, merged pair by pair: no digits of an offset enter the sums."""
    n, mean, m = parts[0]
    for k, other, more in parts[1:]:
        if not k:
            continue
        d = other - mean
        mean = mean + d * (k / (n + k))
        m = m + more + np.outer(d, d) * (n * k / (n + k))
        n += k
    return n, mean, m


def _packed_row(key, salt, part):
    n, mean, m = part
    return (*key, salt, n, mean, m[np.triu_indices(len(mean))])


def gram_packed(df: DataFrame, *, keys: Sequence[str], vector: str) -> DataFrame:
    """Moments of a vector column per group: (keys, n, means array<double>, cells array<double>).

    ``cells`` is the packed upper triangle of the sum of (v - mean)(v - mean)'.  Each task merges its batches into one
    row per group, and those rows are merged in two steps of at most ``FAN`` tasks each.
    """
    keys = list(keys)
    fields = [df.schema[k] for k in keys]
    made = [T.StructField("n", T.LongType()), T.StructField("means", T.ArrayType(T.DoubleType())), T.StructField("cells", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([*fields, T.StructField("_salt", T.IntegerType()), *made])
    names = [f.name for f in schema.fields]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        salt, held = TaskContext.get().partitionId() // FAN, {}
        for batch in batches:
            if not len(batch):
                continue
            for key, rows in batch.groupby(keys, sort=False, dropna=False) if keys else [((), batch)]:
                v = np.vstack(rows[vector].to_numpy())
                mean = v.mean(axis=0)
                part = (len(v), mean, (v - mean).T @ (v - mean))
                name = tuple(None if pd.isna(x) else x for x in (key if isinstance(key, tuple) else (key,)))
                held[name] = merge([held[name], part]) if name in held else part
            if len(held) > min(MOST_HELD, HELD_BYTES // (8 * mean.size**2)):
                yield pd.DataFrame([_packed_row(k, salt, p) for k, p in held.items()], columns=names)
                held = {}
        if held:
            yield pd.DataFrame([_packed_row(k, salt, p) for k, p in held.items()], columns=names)

    return merge_packed(df.select(*keys, vector).mapInPandas(partial, schema), keys=keys)


def merge_packed(partials: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """One row of moments per group from partial rows (keys, _salt, n, means, cells): first per salt, then over the salts."""
    keys, schema = list(keys), partials.schema
    names = [f.name for f in schema.fields]

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows in the order of their keys -> one row per group."""
        now, part = None, None
        for batch in batches:
            out = []
            heads = batch[[*keys, "_salt"]].astype(object).where(batch[[*keys, "_salt"]].notna(), None)
            for head, n, mean, cells in zip(heads.itertuples(index=False, name=None), batch["n"], batch["means"], batch["cells"]):
                more = (int(n), np.asarray(mean), unpack(cells, len(mean)))
                if head == now:
                    part = merge([part, more])
                    continue
                if part is not None:
                    out.append(_packed_row(now[:-1], now[-1], part))
                now, part = head, more
            yield pd.DataFrame(out, columns=names)
        if part is not None:
            yield pd.DataFrame([_packed_row(now[:-1], now[-1], part)], columns=names)

    some = partials.repartition(*keys, "_salt").sortWithinPartitions(*keys, "_salt").mapInPandas(joined, schema)
    some = some.withColumn("_salt", F.lit(0))
    placed = some.repartition(*keys).sortWithinPartitions(*keys) if keys else some.repartition(1)
    return placed.mapInPandas(joined, schema).drop("_salt")


def unpack(cells, d: int) -> np.ndarray:
    """Symmetric matrix from its packed upper triangle."""
    m = np.zeros((d, d))
    m[np.triu_indices(d)] = cells
    return m + np.triu(m, 1).T


def products(n: int, mean: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Sums of plain products."""
    return m + n * np.outer(mean, mean)


def ols(part: tuple[int, np.ndarray, np.ndarray], xs: Sequence[int], ys: Sequence[int]):
    """Coefficients and residual cross-products of ys on xs; with a constant among xs, from centred moments alone."""
    n, mean, m = part
    xs, ys = list(xs), list(ys)
    constant = [i for i, x in enumerate(xs) if m[x, x] == 0 and mean[x] != 0]
    if not constant:
        m = products(n, mean, m)
    elif len(constant) > 1:
        raise np.linalg.LinAlgError("several constants")
    moving = [x for i, x in enumerate(xs) if i not in constant]
    scale = np.sqrt(np.diag(m)[moving])
    if not (scale > 0).all():
        raise np.linalg.LinAlgError("a column without variation")
    xy = m[np.ix_(moving, ys)] / scale[:, None]
    slope = np.linalg.solve(m[np.ix_(moving, moving)] / np.outer(scale, scale), xy) if moving else np.zeros((0, len(ys)))
    rest = m[np.ix_(ys, ys)] - xy.T @ slope
    slope = slope / scale[:, None]
    if constant:
        at = constant[0]
        slope = np.insert(slope, at, (mean[ys] - mean[moving] @ slope) / mean[xs[at]], axis=0)
    return slope, rest


def ols_from_gram(packed: DataFrame, *, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Least squares of the last column on the others: (keys, n, rss, sigma2, term, beta).

    A singular moment matrix gives NULL coefficients and a reason, never a guess.
    """
    keys, names = list(keys), list(names)
    d = len(names)
    schema = T.StructType(
        [packed.schema[k] for k in keys]
        + [
            T.StructField("n", T.LongType()),
            T.StructField("rss", T.DoubleType()),
            T.StructField("sigma2", T.DoubleType()),
            T.StructField("term", T.StringType()),
            T.StructField("beta", T.DoubleType()),
            T.StructField("reason", T.StringType()),
        ]
    )

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                head = [getattr(row, k) for k in keys]
                beta, rss, reason = [None] * (d - 1), None, None
                try:
                    b, rest = ols((row.n, np.asarray(row.means), unpack(row.cells, d)), range(d - 1), [d - 1])
                    beta, rss = b[:, 0].tolist(), float(rest[0, 0])
                except np.linalg.LinAlgError:
                    reason = "singular"
                free = row.n - (d - 1)
                sigma2 = rss / free if rss is not None and free > 0 else None
                out += [(*head, row.n, rss, sigma2, term, value, reason) for term, value in zip(names, beta)]
            yield pd.DataFrame(out, columns=[f.name for f in schema.fields]).astype({"rss": float, "sigma2": float, "beta": float})

    return packed.mapInPandas(solve, schema)
