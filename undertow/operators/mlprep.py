"""Splits, folds, scaling and evaluation for classical models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undertow.operators import blocks, stattests
from undertow.operators.stattests import hash_number
from undertow.session import attach, cut_lineage

SPACE = float(1 << 32)


def stratified_split(df: DataFrame, *, id: Sequence[str], seed: int = 42, test: float = 0.2, validation: float = 0.25) -> DataFrame:
    """test / val / train by two independent hash fractions per row.

    No shuffle: label shares hold in expectation whatever their distribution.
    """
    parts = [F.col(c) for c in id]
    h1 = hash_number(F.lit(seed), F.lit("test"), *parts) / SPACE
    h2 = hash_number(F.lit(seed), F.lit("val"), *parts) / SPACE
    return df.withColumn("split", F.when(h1 < test, "test").when(h2 < validation, "val").otherwise("train"))


def exact_stratified_split(
    df: DataFrame, *, id: Sequence[str], label: str, seed: int = 42, test: float = 0.2, validation: float = 0.25
) -> DataFrame:
    """Exact shares per label: position in hash order inside the label, counted over hash blocks."""
    hashed = df.withColumn("_h", hash_number(F.lit(seed), *[F.col(c) for c in id]))
    placed = blocks.positions(hashed, [label], ["_h", *id], name="_pos")
    size = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    cut = attach(placed, size, [label]).withColumns({"_t": F.ceil(F.col("_n") * test)})
    cut = cut.withColumn("_v", F.ceil((F.col("_n") - F.col("_t")) * validation))
    return cut.withColumn(
        "split", F.when(F.col("_pos") <= F.col("_t"), "test").when(F.col("_pos") <= F.col("_t") + F.col("_v"), "val").otherwise("train")
    ).drop("_h", "_pos", "_n", "_t", "_v")


def time_position(df: DataFrame, *, ts: str, id: Sequence[str], block: Column | None = None) -> DataFrame:
    """Global 0-based time position and row count, over time blocks (no single-task sort)."""
    placed = blocks.positions(df, [], [ts, *id], block, "_pos")
    return placed.withColumn("pos", F.col("_pos") - 1).withColumn("n", df.agg(F.count(F.lit(1))).scalar()).drop("_pos")


def time_split(df: DataFrame, *, ts: str, id: Sequence[str], shares: Mapping[str, float], block: Column | None = None) -> DataFrame:
    """Cut the time order by position, e.g. {"train": .7, "val": .15, "test": .15}."""
    names, n = list(shares), df.count()
    edges, edge = {}, 0.0
    for name in names[:-1]:
        edge = round(edge + shares[name], 12)
        edges[name] = floor(n * edge)
    rows, first = blocks.first_rows(df, [ts, *id], set(edges.values()), block)
    split = None
    for name, count in edges.items():
        split = F.when(first[count], name) if split is None else split.when(first[count], name)
    return rows.select(*df.columns, split.otherwise(names[-1]).alias("split"))


def timeseries_folds(df: DataFrame, *, ts: str, id: Sequence[str], folds: int | None = None, block: Column | None = None) -> DataFrame:
    """Expanding-window folds: each row with (fold, role); 3 folds up to 50 rows, else 5."""
    n = df.count()
    k = folds or (3 if n <= 50 else 5)
    size = n // (k + 1)
    edges = [n - fold * size for fold in range(k, -1, -1)]  # a fold's test rows end where those of the next begin
    rows, first = blocks.first_rows(df, [ts, *id], set(edges), block)
    part = F.lit(k)
    for number in range(k - 1, -1, -1):
        part = F.when(first[edges[number]], number).otherwise(part)
    each = rows.withColumn("_part", part).withColumn("fold", F.explode(F.sequence(F.greatest("_part", F.lit(1)), F.lit(k))))
    return each.select(*df.columns, "fold", F.when(F.col("fold") == F.col("_part"), "test").otherwise("train").alias("role"))


def kfold_repeated(df: DataFrame, *, id: Sequence[str], folds: int = 5, repeats: int = 2, seed: int = 42) -> DataFrame:
    """Fold of every row in every repeat, from a hash of the row and the repeat."""
    each = df.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    return each.withColumn("fold", (hash_number(F.lit(seed), F.col("repeat"), *[F.col(c) for c in id]) % folds).cast("int"))


def standard_scale(df: DataFrame, *, columns: Sequence[str], split: str = "split", train: str = "train") -> DataFrame:
    """z-scores with mean and population std of the training rows only (one summary row as scalars)."""
    fitted = df.filter(F.col(split) == train).agg(
        F.struct(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    ).scalar()
    d = df.withColumn("_fit", fitted)
    return d.withColumns(
        {c: (F.col(c) - F.col(f"_fit.m_{c}")) / F.when(F.col(f"_fit.s_{c}") == 0, 1.0).otherwise(F.col(f"_fit.s_{c}")) for c in columns}
    ).drop("_fit")


def select_k_best(df: DataFrame, *, features: Sequence[str], label: str, k: int) -> DataFrame:
    """Features with the largest one-way F across labels: one pass over all features."""
    long = df.select(F.col(label).alias("_l"), F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])))
    return stattests.anova_oneway(long, group="_l", value="x", keys=["feature"]).orderBy(F.desc("statistic"), "feature").limit(k)


def balanced_sample(df: DataFrame, *, key: str, order: Sequence[str], per_batch: int, block: Column | None = None) -> DataFrame:
    """Batch number per row so that every batch takes an equal share of each community."""
    placed = blocks.positions(df, [key], order, block, "_pos")
    return placed.withColumn("batch", F.ceil(F.col("_pos") / per_batch)).drop("_pos")


# --- evaluation -------------------------------------------------------------


def confusion(df: DataFrame, *, y: str, p: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, *, y: str, p: str, classes: Sequence) -> DataFrame:
    """One row per true class, one column per predicted class."""
    return df.groupBy(F.col(y).alias("y")).pivot(p, list(classes)).count().na.fill(0)


def class_report(df: DataFrame, *, y: str, p: str) -> DataFrame:
    """Precision, recall, F1 and support per class, from the confusion counts."""
    c = confusion(df, y=y, p=p)
    sides = c.select(
        F.inline(
            F.array(
                F.struct(F.col("y").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
                F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called"), F.lit(0).cast("long").alias("hit")),
            )
        )
    )
    g = sides.groupBy("class").agg(F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("hit").alias("hit"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    g = g.withColumns({"precision": share("hit", "called"), "recall": share("hit", "support")})
    s = F.col("precision") + F.col("recall")
    return g.select("class", "support", "precision", "recall", F.when(s > 0, 2 * F.col("precision") * F.col("recall") / s).otherwise(0.0).alias("f1"))


def classification_metrics(df: DataFrame, *, y: str, p: str) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1."""
    g = class_report(df, y=y, p=p)
    n = F.sum("support")
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / n
    return g.agg(weighted("recall").alias("accuracy"), weighted("precision").alias("precision"), weighted("recall").alias("recall"), weighted("f1").alias("f1"))


def binary_auc(df: DataFrame, *, y: str, score: str) -> DataFrame:
    """Rank-sum area with ties averaged, from counts per score."""
    c = cut_lineage(df.groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")))
    r = blocks.running(c, [], ["s"], {"below": F.col("neg")}, blocks.value_block(c, "s"))
    wins = F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2))
    return r.agg((wins / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))


def regression_metrics(df: DataFrame, *, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    e = F.col(y) - F.col(p)
    return df.groupBy(*keys).agg(
        F.count(e).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
        (1 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))).alias("r2"),
    )


def overfit_gap(metrics: DataFrame, *, split: str = "split") -> DataFrame:
    pick = lambda s: F.max(F.when(F.col(split) == s, F.col("r2")))
    return metrics.agg(pick("train").alias("train_r2"), pick("test").alias("test_r2"), (pick("train") - pick("test")).alias("gap"))


def prediction_distribution(df: DataFrame, *, y: str, p: str) -> DataFrame:
    a = df.groupBy(F.col(y).alias("class")).agg(F.count(F.lit(1)).alias("n_true"))
    b = df.groupBy(F.col(p).alias("class")).agg(F.count(F.lit(1)).alias("n_predicted"))
    return a.join(b, "class", "full").na.fill(0)


def confidence_interval_scores(scores: DataFrame, *, keys: Sequence[str], score: str) -> DataFrame:
    """2.5 / 97.5 percentiles, mean and population std of fold scores (a handful per model)."""
    return scores.groupBy(*keys).agg(
        F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("std_score"),
        F.percentile(score, 0.025).alias("ci_low"), F.percentile(score, 0.975).alias("ci_high"),
    )
