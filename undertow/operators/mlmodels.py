"""Distributed training: MLlib classifiers and regressors, and linear models from moments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undertow.operators import mlprep, moments
from undertow.session import attach, cut_lineage

CLASSIFIERS = {
    "random_forest": lambda **p: RandomForestClassifier(**{"numTrees": 20, "maxDepth": 5, "seed": 42, **p}),
    "logistic": lambda **p: LogisticRegression(**{"maxIter": 50, **p}),
}
REGRESSORS = {
    "random_forest": lambda **p: RandomForestRegressor(**{"numTrees": 20, "maxDepth": 5, "seed": 42, **p}),
    "gradient_boosting": lambda **p: GBTRegressor(**{"maxIter": 10, "maxDepth": 3, "seed": 42, **p}),
    "ridge": lambda **p: LinearRegression(**{"regParam": 0.1, "elasticNetParam": 0.0, **p}),
    "linear": lambda **p: LinearRegression(**p),
}


def balanced_weights(df: DataFrame, *, label: str) -> DataFrame:
    """Weight n / (classes * count) per row."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    n, k = counts.agg(F.sum("_c")).scalar(), counts.agg(F.count(F.lit(1))).scalar()
    return attach(df, counts.withColumn("class_weight", n / (k * F.col("_c"))).drop("_c"), [label])


def train_classifier(df: DataFrame, *, features: Sequence[str], label: str, kind: str, balanced: bool = False, **params):
    """A fitted pipeline: labels indexed, features assembled, model trained."""
    data = balanced_weights(df, label=label) if balanced else df
    model = CLASSIFIERS[kind](**params).setFeaturesCol("_x").setLabelCol("_y")
    if balanced:
        model = model.setWeightCol("class_weight")
    stages = [
        StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc"),
        VectorAssembler(inputCols=list(features), outputCol="_x"),
        model,
    ]
    return Pipeline(stages=stages).fit(data)


def prediction_table(model, df: DataFrame, *, id: Sequence[str], label: str) -> DataFrame:
    """Truth, prediction and class probabilities."""
    names = model.stages[0].labels
    scored = model.transform(df)
    probability = vector_to_array("probability")
    return scored.select(
        *id, F.col(label).alias("y"), F.get(F.array(*[F.lit(n) for n in names]), F.col("prediction").cast("int")).alias("p"),
        *[probability[i].alias(f"prob_{n}") for i, n in enumerate(names)],
    )


def train_regressor(df: DataFrame, *, features: Sequence[str], target: str, kind: str, **params):
    model = REGRESSORS[kind](**params).setFeaturesCol("_x").setLabelCol(target)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x"), model]).fit(df)


def linear_from_moments(df: DataFrame, *, features: Sequence[str], target: str, keys: Sequence[str] = ()) -> DataFrame:
    """Ordinary least squares in one pass: (keys, n, rss, sigma2, term, beta)."""
    vector = df.select(*keys, F.array(F.lit(1.0), *[F.col(f).cast("double") for f in features], F.col(target).cast("double")).alias("v"))
    packed = moments.gram_packed(vector, keys=keys, vector="v")
    return moments.ols_from_gram(packed, keys=keys, names=["intercept", *features, target])


FEW = 6  # columns whose moments (21 pairs) fit into one aggregate
FOLD_SCORES = "model string, fold int, beta array<double>, n long, mse double, r2 double"


def fold_moments(folded: DataFrame, *, features: Sequence[str], target: str) -> DataFrame:
    """Moments of (features, target) per (fold, role) in one pass; rows with a NULL among them count for no model."""
    columns = [F.col(c).cast("double") for c in [*features, target]]
    known = folded.select(F.col("fold").cast("int").alias("fold"), "role", *[c.alias(f"_x{i}") for i, c in enumerate(columns)])
    known = known.filter(reduce(and_, [F.col(f"_x{i}").isNotNull() for i in range(len(columns))]))
    x = [F.col(f"_x{i}") for i in range(len(columns))]
    if len(x) > FEW:
        return moments.gram_packed(known.select("fold", "role", F.array(*x).alias("v")), keys=["fold", "role"], vector="v")
    # Spark's own covariances are merged pair by pair, too, and the rows stay out of Python; the mean of all comes off first
    middle = [F.lit(m or 0.0) for m in known.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)]).first()]
    x = [c - m for c, m in zip(x, middle)]
    spread = [F.covar_pop(x[i], x[j]) * F.count(F.lit(1)) for i in range(len(x)) for j in range(i, len(x))]
    means = [m + F.avg(c) for c, m in zip(x, middle)]
    return known.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.array(*means).alias("means"), F.array(*spread).alias("cells"))


def ridge(part, penalty: float) -> np.ndarray:
    """Intercept and slopes from moments, minimising RSS / 2n + penalty / 2 * |slopes|^2 over features and target of unit deviation.

    The target's deviation divides the penalty, as in Spark's LinearRegression. Columns without variation get
    slope 0; among equally good solutions the shortest one counts.
    """
    n, mean, m = part
    spread = np.sqrt(np.diag(m) / n)
    x, y = slice(0, len(mean) - 1), len(mean) - 1
    slope = np.zeros(y)
    moving = np.flatnonzero(spread[x] > 0)
    if len(moving) and spread[y] > 0:
        scale = spread[moving]
        gram = m[np.ix_(moving, moving)] / np.outer(scale, scale) / n + np.eye(len(moving)) * (penalty / spread[y])
        slope[moving] = np.linalg.lstsq(gram, m[moving, y] / scale / n, rcond=None)[0] / scale
    return np.concatenate([[mean[y] - mean[x] @ slope], slope])


def moment_scores(packed: DataFrame, models: Mapping[str, float]) -> DataFrame:
    """Every linear model (name -> penalty) of every fold, solved and scored from :func:`fold_moments`: (model, fold, beta, n, mse, r2).

    A fold without training rows gives a row of NULLs, one without test rows n = 0; r2 is NULL where the target does not vary.
    """
    models = dict(models)

    def score(_, table):
        parts = {r.role: (r.n, np.asarray(r.means), moments.unpack(r.cells, len(r.means))) for r in table.itertuples(index=False)}
        train, test, out = parts.get("train"), parts.get("test"), []
        for name, penalty in models.items():
            beta = None if train is None else ridge(train, penalty)
            mse = r2 = None
            if beta is not None and test is not None:
                n, mean, m = test
                weights = np.append(-beta[1:], 1.0)
                rss = weights @ m @ weights + n * (mean @ weights - beta[0]) ** 2
                mse, r2 = rss / n, 1 - rss / m[-1, -1] if m[-1, -1] > 0 else None
            out.append((name, table["fold"].iloc[0], beta, 0 if test is None else test[0], mse, r2))
        made = pd.DataFrame(out, columns=["model", "fold", "beta", "n", "mse", "r2"])
        return made.astype({"mse": float, "r2": float})

    return packed.groupBy("fold").applyInPandas(score, FOLD_SCORES)


def _penalty(kind: str, params: Mapping) -> float | None:
    """Penalty of a model that moments solve, None for every other model."""
    start = {"linear": 0.0, "ridge": 0.1}
    return float(params.get("regParam", start[kind])) if kind in start and set(params) <= {"regParam"} else None


def _absolute_errors(folded: DataFrame, scores: DataFrame, *, features: Sequence[str], target: str) -> DataFrame:
    """Mean absolute error of every (model, fold): one pass over the test rows, all models of a fold beside each row."""
    models = scores.groupBy("fold").agg(F.collect_list(F.struct("model", "beta")).alias("_models"))
    test = folded.filter("role = 'test'").select(F.col("fold").cast("int").alias("fold"), *[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*features, target])])
    each = attach(test.dropna(), models, ["fold"]).select("fold", *[c for c in test.columns if c != "fold"], F.inline("_models"))
    guess = sum((F.get("beta", F.lit(i + 1)) * F.col(f) for i, f in enumerate(features)), F.get("beta", F.lit(0)))
    return each.groupBy("model", "fold").agg(F.avg(F.abs(F.col(target) - guess)).alias("mae"))


def cv_scores(folded: DataFrame, *, features: Sequence[str], target: str, kinds: Sequence[str], params: Mapping | None = None) -> DataFrame:
    """R^2, MSE and MAE per model and fold; ``folded`` carries (fold, role).

    Linear and ridge models of all folds come from one pass over the data (moments per fold and role) and their
    absolute errors from one more over the test rows; other kinds are trained fold by fold.
    """
    params = params or {}
    linear = {k: p for k in kinds if (p := _penalty(k, params.get(k, {}))) is not None}
    out = None
    if linear:
        scores = cut_lineage(moment_scores(fold_moments(folded, features=features, target=target), linear))
        errors = _absolute_errors(folded, scores, features=features, target=target)
        out = scores.join(errors, ["model", "fold"], "left").select("model", "fold", "n", "mse", "mae", "r2")
    others = [k for k in kinds if k not in linear]
    numbers = [r["fold"] for r in folded.select("fold").distinct().orderBy("fold").collect()] if others else []
    for kind in others:
        for fold in numbers:
            part = folded.filter(F.col("fold") == fold)
            model = train_regressor(part.filter("role = 'train'"), features=features, target=target, kind=kind, **params.get(kind, {}))
            scored = model.transform(part.filter("role = 'test'"))
            row = mlprep.regression_metrics(scored, y=target, p="prediction").select(
                F.lit(kind).alias("model"), F.lit(fold).cast("int").alias("fold"), "n", "mse", "mae", "r2"
            )
            out = row if out is None else out.unionByName(row)
    return out


def grid_search(folded: DataFrame, *, features: Sequence[str], target: str, kind: str, grid: Mapping[str, Sequence]) -> DataFrame:
    """Mean fold error of every parameter combination, best first; a grid of penalties needs one pass for all of them."""
    combos = [{}]
    for name, values in grid.items():
        combos = [{**c, name: v} for c in combos for v in values]
    means = [F.avg("mse").alias("mse"), F.avg("r2").alias("r2")]
    penalties = {str(c): _penalty(kind, c) for c in combos}
    if None not in penalties.values():
        scores = moment_scores(fold_moments(folded, features=features, target=target), penalties)
        out = scores.groupBy(F.col("model").alias("params")).agg(*means)
    else:
        out = None
        for c in combos:
            scores = cv_scores(folded, features=features, target=target, kinds=[kind], params={kind: c})
            row = scores.agg(*means).select(F.lit(str(c)).alias("params"), "mse", "r2")
            out = row if out is None else out.unionByName(row)
    return out.withColumn("rank", F.row_number().over(Window.orderBy("mse", "params")))


def feature_importance(model, features: Sequence[str], spark) -> DataFrame:
    """Importances of a tree model as rows, largest first."""
    values = [float(v) for v in model.stages[-1].featureImportances.toArray()]
    return spark.createDataFrame(list(zip(features, values)), "feature string, importance double").orderBy(F.desc("importance"))
