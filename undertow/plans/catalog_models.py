"""Splits, folds, training and evaluation as checked queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from undertow.operators import mlmodels, mlprep
from undertow.plans.catalog_grid import NAIVE, naive_forecasts
from undertow.plans.catalog_tests import FOLDS, anova_sql, model_scores
from undertow.plans.registry import R, query, r, rounded
from undertow.plans.sqlparts import f_tail_even
from undertow.session import cut_lineage


def share(*parts):
    return f"(('0x' || substr(md5(concat_ws('-', {', '.join(parts)})), 1, 8))::UBIGINT::BIGINT)"


SPLIT = f"CASE WHEN {share('42', chr(39) + 'test' + chr(39), 'o_orderkey')} / 4294967296.0 < 0.2 THEN 'test' WHEN {share('42', chr(39) + 'val' + chr(39), 'o_orderkey')} / 4294967296.0 < 0.25 THEN 'val' ELSE 'train' END"


@query("stratified_split", f"SELECT o_orderkey, o_orderstatus, {SPLIT} AS split FROM orders")
def _(t):
    return mlprep.stratified_split(t.raw("orders").select("o_orderkey", "o_orderstatus"), id=["o_orderkey"])


@query(
    "stratified_split_exact",
    f"""WITH h AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {share('42', 'o_orderkey')}, o_orderkey) AS pos, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders),
    c AS (SELECT *, ceil(n * 0.2) AS t FROM h) SELECT o_orderkey, o_orderstatus, CASE WHEN pos <= t THEN 'test' WHEN pos <= t + ceil((n - t) * 0.25) THEN 'val' ELSE 'train' END AS split FROM c""",
)
def _(t):
    return mlprep.exact_stratified_split(t.raw("orders").select("o_orderkey", "o_orderstatus"), id=["o_orderkey"], label="o_orderstatus")


PLACED = "p AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM events)"


def time_sql(cuts):
    cases = " ".join(f"WHEN pos < floor(n * {edge}) THEN '{name}'" for name, edge in cuts[:-1])
    return f"WITH {PLACED} SELECT event_id, CASE {cases} ELSE '{cuts[-1][0]}' END AS split FROM p"


@query("time_split_70_15_15", time_sql([("train", 0.7), ("val", 0.85), ("test", 1)]))
def _(t):
    return mlprep.time_split(t.comments.select(F.col("comment_id").alias("event_id"), "ts"), ts="ts", id=["event_id"], shares={"train": 0.7, "val": 0.15, "test": 0.15}).select("event_id", "split")


@query("time_split_80_20", time_sql([("train", 0.8), ("test", 1)]))
def _(t):
    return mlprep.time_split(t.comments.select(F.col("comment_id").alias("event_id"), "ts"), ts="ts", id=["event_id"], shares={"train": 0.8, "test": 0.2}).select("event_id", "split")


@query(
    "timeseries_folds",
    f"""WITH {PLACED}, f AS (SELECT event_id, pos, n, fold, n // 6 AS size, n - (5 - fold + 1) * (n // 6) AS start FROM p, range(1, 6) g(fold))
    SELECT event_id, fold::INT AS fold, CASE WHEN pos < start THEN 'train' ELSE 'test' END AS role FROM f WHERE pos < start + size""",
)
def _(t):
    c = t.comments.select(F.col("comment_id").alias("event_id"), "ts")
    return mlprep.timeseries_folds(c, ts="ts", id=["event_id"]).select("event_id", F.col("fold").cast("int").alias("fold"), "role")


@query("kfold_repeated", f"SELECT o_orderkey, rep::INT AS repeat, ({share('42', 'rep', 'o_orderkey')} % 5)::INT AS fold FROM orders, range(1, 3) g(rep)")
def _(t):
    return mlprep.kfold_repeated(t.raw("orders").select("o_orderkey"), id=["o_orderkey"]).select("o_orderkey", F.col("repeat").cast("int").alias("repeat"), "fold")


@query(
    "standard_scale",
    f"""WITH s AS (SELECT o_orderkey, o_totalprice AS x, {SPLIT} AS split FROM orders), m AS (SELECT avg(x) AS m, stddev_pop(x) AS sd FROM s WHERE split = 'train')
    SELECT o_orderkey, split, {R('(x - m) / sd')} AS o_totalprice FROM s, m""",
)
def _(t):
    s = mlprep.stratified_split(t.raw("orders").select("o_orderkey", "o_totalprice"), id=["o_orderkey"])
    return rounded(mlprep.standard_scale(s, columns=["o_totalprice"]))


FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "select_k_best",
    "SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT * FROM (WITH {anova_sql('lineitem', 'l_returnflag', f)} SELECT '{f}' AS feature, n::BIGINT AS n, k::BIGINT AS groups, {R('stat', 5)} AS statistic, {R(f_tail_even('stat', 2, '(n - k)'), 5)} AS p_value FROM fs)" for f in FEATURES)
    + ") ORDER BY statistic DESC, feature LIMIT 2",
)
def _(t):
    return rounded(mlprep.select_k_best(t.raw("lineitem"), features=FEATURES, label="l_returnflag", k=2), 5)


ITEM = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def items(t):
    li = t.raw("lineitem").select(*ITEM, *FEATURES, "l_returnflag", "l_shipdate")
    return mlprep.stratified_split(li, id=ITEM)


def classified(t, kind, **params):
    d = items(t)
    model = mlmodels.train_classifier(d.filter("split = 'train'"), features=FEATURES, label="l_returnflag", kind=kind, **params)
    return model, mlmodels.prediction_table(model, d.filter("split = 'test'"), id=ITEM, label="l_returnflag")


@query("train_classifier_logistic")
def _(t):
    _, scored = classified(t, "logistic", balanced=True)
    return rounded(mlprep.classification_metrics(scored, y="y", p="p"), 4)


@query("train_classifier_forest")
def _(t):
    _, scored = classified(t, "random_forest", numTrees=10, maxDepth=4)
    return rounded(mlprep.classification_metrics(scored, y="y", p="p"), 4)


@query("prediction_table")
def _(t):
    _, scored = classified(t, "logistic")
    return rounded(scored, 4)


@query("feature_importance")
def _(t):
    model, _ = classified(t, "random_forest", numTrees=10, maxDepth=4)
    return rounded(mlmodels.feature_importance(model, FEATURES, t.spark), 4)


LINEAR = """m AS (SELECT count(*) AS n, var_pop(l_quantity) AS v1, var_pop(l_discount) AS v2, covar_pop(l_quantity, l_discount) AS c12, covar_pop(l_extendedprice, l_quantity) AS c1, covar_pop(l_extendedprice, l_discount) AS c2,
  var_pop(l_extendedprice) AS vy, avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_discount) AS m2 FROM lineitem),
  b AS (SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM m), f AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0, n * (vy - b1 * c1 - b2 * c2) AS rss FROM b)"""


@query(
    "train_regressor_linear",
    f"WITH {LINEAR} " + " UNION ALL ".join(f"SELECT '{name}' AS term, n::BIGINT AS n, {R(b, 3)} AS beta, {R('rss / (n - 3)', 0)} AS sigma2 FROM f" for name, b in (("intercept", "b0"), ("l_quantity", "b1"), ("l_discount", "b2"))),
)
def _(t):
    o = mlmodels.linear_from_moments(t.raw("lineitem"), features=["l_quantity", "l_discount"], target="l_extendedprice")
    return o.select("term", "n", r("beta", 3).alias("beta"), r("sigma2", 0).alias("sigma2"))


def regression_rows(t):
    d = items(t)
    return d.withColumn("_at", F.col("l_shipdate").cast("timestamp"))


@query("train_regressor")
def _(t):
    # every model reads its rows several times: they are hashed once (a checkpoint keeps partitions and order, so forests draw the same rows)
    d = cut_lineage(items(t).filter("split <> 'val'").select("l_quantity", "l_discount", "l_tax", "l_extendedprice", "split"))
    out = None
    for kind in ("random_forest", "gradient_boosting", "ridge"):
        model = mlmodels.train_regressor(d.filter("split = 'train'"), features=["l_quantity", "l_discount", "l_tax"], target="l_extendedprice", kind=kind)
        scored = mlprep.regression_metrics(model.transform(d.filter("split = 'test'")), y="l_extendedprice", p="prediction").withColumn("model", F.lit(kind))
        out = scored if out is None else out.unionByName(scored)
    return rounded(out, 3)


def folded(t):
    d = regression_rows(t)
    return mlprep.timeseries_folds(d, ts="_at", id=ITEM, folds=3)


@query("cv_scores")
def _(t):
    scores = mlmodels.cv_scores(folded(t), features=["l_quantity", "l_discount", "l_tax"], target="l_extendedprice", kinds=["linear", "ridge"])
    return rounded(scores, 3)


RIDGE_FOLDS = """p AS (SELECT l_quantity AS a, l_discount AS b, l_extendedprice AS y, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS pos, count(*) OVER () AS n FROM lineitem),
  f AS (SELECT a, b, y, fold, pos < n - (3 - fold + 1) * (n // 4) AS train FROM p, range(1, 4) g(fold) WHERE pos < n - (3 - fold + 1) * (n // 4) + n // 4),
  m AS (SELECT fold, l, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, stddev_pop(a) AS sa, stddev_pop(b) AS sb, l / stddev_pop(y) AS pen, corr(a, b) AS c12, covar_pop(a, y) / stddev_pop(a) AS c1, covar_pop(b, y) / stddev_pop(b) AS c2
    FROM f, (SELECT unnest([0.01, 1.0]) AS l) WHERE train GROUP BY 1, 2),
  w AS (SELECT *, ((1 + pen) * c1 - c12 * c2) / ((1 + pen) * (1 + pen) - c12 * c12) / sa AS wa, ((1 + pen) * c2 - c12 * c1) / ((1 + pen) * (1 + pen) - c12 * c12) / sb AS wb FROM m),
  e AS (SELECT w.fold, l, y, y - my - wa * (a - ma) - wb * (b - mb) AS err FROM f JOIN w ON w.fold = f.fold WHERE NOT train),
  s AS (SELECT fold, l, avg(err * err) AS mse, 1 - avg(err * err) / var_pop(y) AS r2 FROM e GROUP BY 1, 2), o AS (SELECT l, avg(mse) AS mse, avg(r2) AS r2 FROM s GROUP BY 1)"""


@query("grid_search", f"WITH {RIDGE_FOLDS} SELECT '{{''regParam'': ' || l::DOUBLE || '}}' AS params, {R('mse', 2)} AS mse, {R('r2')} AS r2, row_number() OVER (ORDER BY mse)::INT AS rank FROM o")
def _(t):
    g = mlmodels.grid_search(folded(t), features=["l_quantity", "l_discount"], target="l_extendedprice", kind="ridge", grid={"regParam": [0.01, 1.0]})
    return g.select("params", r("mse", 2).alias("mse"), r("r2").alias("r2"), "rank")


GUESS = "CASE WHEN l_discount < 0.03 THEN 'A' WHEN l_discount < 0.07 THEN 'N' ELSE 'R' END"
CLASSES = f"c AS (SELECT l_returnflag AS y, {GUESS} AS p FROM lineitem)"
REPORT = CLASSES + """, cl AS (SELECT y AS class FROM c UNION SELECT p FROM c), q AS (SELECT class, (SELECT count(*) FROM c WHERE y = class) AS support, (SELECT count(*) FROM c WHERE p = class) AS called, (SELECT count(*) FROM c WHERE y = class AND p = class) AS hit FROM cl),
  rep AS (SELECT class, support, CASE WHEN called > 0 THEN hit / called ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall FROM q),
  rp AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM rep)"""


def guesses(t):
    d = F.col("l_discount")
    return t.raw("lineitem").select(F.col("l_returnflag").alias("y"), F.when(d < 0.03, "A").when(d < 0.07, "N").otherwise("R").alias("p"))


@query(
    "classification_metrics",
    f"WITH {REPORT} SELECT {R('sum(recall * support) / sum(support)')} AS accuracy, {R('sum(precision * support) / sum(support)')} AS precision, {R('sum(recall * support) / sum(support)')} AS recall, {R('sum(f1 * support) / sum(support)')} AS f1 FROM rp",
)
def _(t):
    return rounded(mlprep.classification_metrics(guesses(t), y="y", p="p"))


@query("confusion_matrix", f"WITH {CLASSES} SELECT y, " + ", ".join(f"count(*) FILTER (p = '{k}')::BIGINT AS \"{k}\"" for k in "ANR") + " FROM c GROUP BY 1")
def _(t):
    return mlprep.confusion_matrix(guesses(t), y="y", p="p", classes=["A", "N", "R"])


@query("class_report", f"WITH {REPORT} SELECT class, support::BIGINT AS support, {R('precision')} AS precision, {R('recall')} AS recall, {R('f1')} AS f1 FROM rp")
def _(t):
    return rounded(mlprep.class_report(guesses(t), y="y", p="p"))


@query(
    "binary_auc",
    f"""WITH d AS (SELECT quality AS y, n_chars AS s FROM documents JOIN labels USING (doc_id)), k AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM d)
    SELECT {R('(sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0))')} AS auc FROM k""",
)
def _(t):
    d = t.raw("documents").select("doc_id", "n_chars").join(t.raw("labels"), "doc_id")
    return rounded(mlprep.binary_auc(d, y="quality", score="n_chars"))


REG = NAIVE.rsplit(", s AS", 1)[0] + ", e AS (SELECT symbol, price AS y, mean5 AS p FROM f WHERE mean5 IS NOT NULL)"


@query(
    "regression_metrics",
    f"WITH {REG} SELECT symbol, count(*)::BIGINT AS n, {R('avg((y - p) ** 2)', 1)} AS mse, {R('avg(abs(y - p))', 3)} AS mae, {R('1 - sum((y - p) ** 2) / (var_pop(y) * count(*))')} AS r2 FROM e GROUP BY 1",
)
def _(t):
    f = naive_forecasts(t).filter("mean5 is not null")
    m = mlprep.regression_metrics(f, y="price", p="mean5", keys=["symbol"])
    return m.select("symbol", "n", r("mse", 1).alias("mse"), r("mae", 3).alias("mae"), r("r2").alias("r2"))


@query(
    "overfit_gap",
    f"""WITH {LINEAR}, s AS (SELECT l.*, b0 + b1 * l_quantity + b2 * l_discount AS p, CASE WHEN l_linestatus = 'O' THEN 'train' ELSE 'test' END AS split FROM lineitem l, f),
    g AS (SELECT split, 1 - sum((l_extendedprice - p) ** 2) / (var_pop(l_extendedprice) * count(*)) AS r2 FROM s GROUP BY 1)
    SELECT {R("max(r2) FILTER (split = 'train')")} AS train_r2, {R("max(r2) FILTER (split = 'test')")} AS test_r2, {R("max(r2) FILTER (split = 'train') - max(r2) FILTER (split = 'test')")} AS gap FROM g""",
)
def _(t):
    li = t.raw("lineitem")
    beta = mlmodels.linear_from_moments(li, features=["l_quantity", "l_discount"], target="l_extendedprice")
    row = beta.agg(F.map_from_entries(F.collect_list(F.struct("term", "beta")))).scalar()
    s = li.withColumn("_b", row).withColumn("p", F.col("_b")["intercept"] + F.col("_b")["l_quantity"] * F.col("l_quantity") + F.col("_b")["l_discount"] * F.col("l_discount"))
    s = s.withColumn("split", F.when(F.col("l_linestatus") == "O", "train").otherwise("test"))
    return rounded(mlprep.overfit_gap(mlprep.regression_metrics(s, y="l_extendedprice", p="p", keys=["split"])))


@query(
    "prediction_distribution",
    f"WITH {CLASSES}, cl AS (SELECT y AS class FROM c UNION SELECT p FROM c) SELECT class, (SELECT count(*) FROM c WHERE y = class)::BIGINT AS n_true, (SELECT count(*) FROM c WHERE p = class)::BIGINT AS n_predicted FROM cl",
)
def _(t):
    return mlprep.prediction_distribution(guesses(t), y="y", p="p")


@query("balanced_sample", "SELECT event_id, ceil(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) / 16)::BIGINT AS batch FROM events")
def _(t):
    c = t.comments.select(F.col("comment_id").alias("event_id"), "community", "ts")
    return mlprep.balanced_sample(c, key="community", order=["ts", "event_id"], per_batch=16).select("event_id", "batch")


@query(
    "confidence_interval_scores",
    f"WITH {FOLDS} SELECT model, {R('avg(score)')} AS mean_score, {R('stddev_pop(score)')} AS std_score, {R('quantile_cont(score, 0.025)')} AS ci_low, {R('quantile_cont(score, 0.975)')} AS ci_high FROM long GROUP BY 1",
)
def _(t):
    return rounded(mlprep.confidence_interval_scores(model_scores(t), keys=["model"], score="score"))
