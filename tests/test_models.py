"""Vector autoregressions, unit-root tests and graph metrics against direct computation."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from undertow.operators import causality, graph, stattests, transmission
from undertow.operators.panes import kpss_statistic


def simulate(n, seed=0, a=((0.5, 0.0), (0.4, 0.3))):
    rng, a = np.random.default_rng(seed), np.array(a)
    y = np.zeros((n, len(a)))
    for t in range(1, n):
        y[t] = a @ y[t - 1] + rng.normal(size=len(a))
    return y


def long(spark, y, names=None):
    names = names or [f"s{j}" for j in range(y.shape[1])]
    rows = [(int(t), names[j], float(y[t, j])) for t in range(len(y)) for j in range(y.shape[1])]
    df = spark.createDataFrame(rows, "ts int, series string, value double")
    return df.withColumn("ts", F.timestamp_seconds(F.col("ts") * 3600))


@pytest.fixture(scope="module")
def one_way(spark):
    return long(spark, simulate(600)).cache()


def test_fit_equals_least_squares(spark, one_way):
    y = simulate(600)
    fit = transmission.var_fit(transmission.var_moments(transmission.whole_window(one_way), max_lags=3), order=2).first()
    x = np.column_stack([np.ones(598), y[1:-1], y[:-2]])
    beta, *_ = np.linalg.lstsq(x, y[2:], rcond=None)
    e = y[2:] - x @ beta
    np.testing.assert_allclose(fit["intercept"], beta[0], atol=1e-9)
    np.testing.assert_allclose(np.reshape(fit["lags"], (2, 2, 2)), [beta[1:3].T, beta[3:5].T], atol=1e-9)
    np.testing.assert_allclose(np.reshape(fit["sigma"], (2, 2)), e.T @ e / (598 - 5), atol=1e-9)


def test_residuals_equal_least_squares(spark, one_way):
    y = simulate(600)
    w = transmission.whole_window(one_way)
    fits = transmission.var_fit(transmission.var_moments(w, max_lags=3), order=2)
    got = transmission.residuals(w, fits).orderBy("ts", "series").toPandas()["residual"].to_numpy().reshape(-1, 2)
    x = np.column_stack([np.ones(598), y[1:-1], y[:-2]])
    np.testing.assert_allclose(got, y[2:] - x @ np.linalg.lstsq(x, y[2:], rcond=None)[0], atol=1e-9)


def test_one_way_transmission(spark, one_way):
    fits = transmission.analyse(transmission.whole_window(one_way)).cache()
    row = fits.first()
    assert row["reason"] is None and row["p"] == 1 and row["radius"] < 1
    theta = transmission.theta_table(fits)
    sums = [r["s"] for r in theta.groupBy("h", "to_series").agg(F.sum("theta").alias("s")).collect()]
    np.testing.assert_allclose(sums, 1)
    net = {r["series"]: r["net"] for r in transmission.spill_net(transmission.last_horizon(theta)).collect()}
    assert net["s0"] > 5 and net["s0"] == pytest.approx(-net["s1"])


def test_order_selection_finds_two_lags(spark):
    rng = np.random.default_rng(5)
    y = np.zeros((800, 2))
    for t in range(2, 800):
        y[t] = 0.5 * y[t - 2] + rng.normal(size=2)
    fit = transmission.var_fit(transmission.var_moments(transmission.whole_window(long(spark, y)), max_lags=5)).first()
    assert fit["p"] == 2


def test_failures_are_rows_with_a_reason(spark):
    y = simulate(120)[:, [0]]
    one = transmission.var_fit(transmission.var_moments(transmission.whole_window(long(spark, y)), max_lags=2)).first()
    assert one["reason"] == "needs two series" and one["theta"] is None
    same = transmission.var_fit(transmission.var_moments(transmission.whole_window(long(spark, np.repeat(np.arange(120.0)[:, None], 3, axis=1))), max_lags=2)).first()
    assert same["theta"] is None and same["reason"]


def several(n, k=3, seed=11):
    rng = np.random.default_rng(seed)
    y = np.zeros((n, k))
    for t in range(1, n):
        y[t] = 0.4 * y[t - 1] + 0.2 * np.roll(y[t - 1], 1) + rng.normal(size=k)
    y[:, 0] = np.cumsum(y[:, 0])  # one series with a unit root
    return y


def test_rolling_windows_equal_fits_of_each_window(spark):
    """Pane moments against a fit of each window's own rows, and against least squares."""
    y = several(470)
    panel = long(spark, y).cache()
    got = {r["window_id"]: r for r in transmission.rolling_spillover(panel, window=100, step=20).collect()}
    windows = transmission.rolling_windows(panel, window=100, step=20)
    fits = transmission.analyse(windows, max_lags=5).cache()
    want = {r["window_id"]: r for r in fits.join(transmission.spill_total(transmission.last_horizon(transmission.theta_table(fits))), "window_id").collect()}
    ends = {r["window_id"]: r["d"] for r in windows.groupBy("window_id").agg(F.max("ts").alias("d")).collect()}
    assert got.keys() == want.keys() == set(range(19))
    for w, r in got.items():
        assert (r["p"], r["reason"], r["date"]) == (want[w]["p"], want[w]["reason"], ends[w])
        assert r["radius"] == pytest.approx(want[w]["radius"], abs=1e-9) and r["total"] == pytest.approx(want[w]["total"], abs=1e-8)
    assert transmission.rolling_spillover(panel.filter("false")).count() == 0
    short = transmission.rolling_spillover(panel, window=430, step=20)  # fewer than window + 50 times
    assert short.count() == 0


def test_panel_fit_equals_least_squares(spark):
    y = several(500, k=5)
    w = transmission.whole_window(long(spark, y))
    fit = transmission.var_fit(transmission.var_moments(w, max_lags=6)).first()
    p, n = fit["p"], len(y)
    x = np.column_stack([np.ones(n - p), *[y[p - i : n - i] for i in range(1, p + 1)]])
    beta, *_ = np.linalg.lstsq(x, y[p:], rcond=None)
    e = y[p:] - x @ beta
    sigma = e.T @ e / (n - p - 5 * p - 1)
    lags = np.stack([beta[1 + 5 * i : 6 + 5 * i].T for i in range(p)])
    np.testing.assert_allclose(np.reshape(fit["lags"], (p, 5, 5)), lags, atol=1e-9)
    np.testing.assert_allclose(np.reshape(fit["sigma"], (5, 5)), sigma, atol=1e-9)
    phi = [np.eye(5)]
    for h in range(1, 10):
        phi.append(sum(lags[i] @ phi[h - 1 - i] for i in range(min(p, h))))
    hit = np.cumsum(np.stack([m @ np.linalg.cholesky(sigma) for m in phi]) ** 2, axis=0)
    np.testing.assert_allclose(np.reshape(fit["theta"], (10, 5, 5)), hit / hit.sum(axis=2, keepdims=True), atol=1e-9)
    made = {(r["h"], r["i"], r["j"]): r["phi"] for r in transmission.ma_long(transmission.var_fit(transmission.var_moments(w, max_lags=6))).collect()}
    assert all(made[h, i, j] == pytest.approx(phi[h][i, j], abs=1e-9) for h in range(10) for i in range(5) for j in range(5))


def test_level_stationarity_has_no_longest_series(spark):
    """The automatic lag of two million bars, beside a short series; against sums over arrays."""
    n = 2_000_000
    value = F.sin(F.col("id") * 0.37) + F.pmod(F.hash("id"), F.lit(1000)) / 500
    df = spark.range(n).select(F.when(F.col("id") % 20_000 == 0, "short").otherwise("long").alias("k"), "id", value.alias("value"))
    got = {r["k"]: (r["n"], r["statistic"]) for r in stattests.kpss_test(df, keys=["k"], ts="id", value="value").collect()}
    for k, rows in df.toPandas().groupby("k"):
        assert got[k][0] == len(rows) and got[k][1] == pytest.approx(kpss_statistic(rows.sort_values("id")["value"].to_numpy()), rel=1e-6)


def test_offsets_cost_no_digits(spark):
    y = simulate(400)
    fits = [transmission.var_fit(transmission.var_moments(transmission.whole_window(long(spark, y + c)), max_lags=3), order=2).first() for c in (0.0, 2.0**26)]
    np.testing.assert_allclose(fits[0]["lags"], fits[1]["lags"], atol=1e-8)
    np.testing.assert_allclose(fits[0]["sigma"], fits[1]["sigma"], atol=1e-8)
    walk = np.cumsum(y[:, 0])
    stats = []
    for c in (0.0, 2.0**26):
        df = spark.createDataFrame([("a", int(t), float(v + c)) for t, v in enumerate(walk)], "k string, ts int, value double")
        stats.append(stattests.adf_test(df, keys=["k"], ts="ts", value="value").first()["statistic"])
    assert stats[0] == pytest.approx(stats[1], abs=1e-6)


def test_wide_panels_are_solved(spark):
    """k * p = 600: more than any table of the stored data asks for."""
    rng = np.random.default_rng(2)
    n = 1300  # more rows than coefficients and series together
    y = rng.normal(size=(n, 600))
    flat = pd.DataFrame({"ts": np.repeat(np.arange(n), 600), "series": [f"s{j}" for j in range(600)] * n, "value": y.ravel()})
    panel = spark.createDataFrame(flat).withColumn("ts", F.timestamp_seconds(F.col("ts") * 3600))
    fit = transmission.var_fit(transmission.var_moments(transmission.whole_window(panel), max_lags=1), order=1, horizon=2).first()
    assert fit["reason"] is None
    x = np.column_stack([np.ones(n - 1), y[:-1]])
    beta, *_ = np.linalg.lstsq(x, y[1:], rcond=None)
    order = sorted(range(600), key=lambda j: f"s{j}")  # series come in the order of their names
    np.testing.assert_allclose(np.reshape(fit["lags"], (600, 600)), beta[1:].T[np.ix_(order, order)], atol=1e-6)


def test_extreme_scales(spark):
    y = simulate(300) * np.array([1e6, 1e-6])
    total = transmission.spill_total(transmission.last_horizon(transmission.theta_table(transmission.analyse(transmission.whole_window(long(spark, y)))))).first()["total"]
    assert 0 <= total <= 100


def test_rolling_windows(spark, one_way):
    got = transmission.rolling_spillover(one_way, window=252, step=60).toPandas().sort_values("window_id")
    assert len(got) == len([s for s in range(0, 600, 60) if s + 252 < 600])
    assert got.total.between(0, 100).all()
    assert all(abs(sum(m.values())) < 1e-9 for m in got.net)
    assert transmission.rolling_windows(one_way.filter("ts < timestamp'1970-01-11'"), window=252).count() == 0


def test_granger_direction(spark, one_way):
    bars = one_way.withColumnRenamed("series", "community")
    p = {(r["src"], r["dst"]): r["p_value"] for r in causality.granger_pairwise(bars).collect()}
    assert p[("s0", "s1")] < 1e-6 < p[("s1", "s0")]
    short = {r["f_stat"] for r in causality.granger_pairwise(bars.filter("ts < timestamp'1970-01-01 10:00:00'")).collect()}
    assert short == {0.0}


def adf(y, p):
    d = np.diff(y)
    rows = range(p + 1, len(y))
    x = np.array([[1, y[t - 1], *[d[t - 1 - i] for i in range(1, p + 1)]] for t in rows])
    z = np.array([d[t - 1] for t in rows])
    b, *_ = np.linalg.lstsq(x, z, rcond=None)
    e = z - x @ b
    return b[1] / np.sqrt(e @ e / (len(z) - p - 2) * np.linalg.inv(x.T @ x)[1, 1])


def test_unit_root(spark):
    rng = np.random.default_rng(2)
    walk, calm = np.cumsum(0.3 + rng.normal(size=200)), simulate(200)[:, 0]
    df = long(spark, np.column_stack([walk, calm]), ["walk", "calm"])
    for p in (0, 3):
        got = {r["series"]: r["statistic"] for r in stattests.adf_test(df, keys=["series"], ts="ts", value="value", max_lag=p, criterion=None).collect()}
        assert got["walk"] == pytest.approx(adf(walk, p), abs=1e-6) and got["calm"] == pytest.approx(adf(calm, p), abs=1e-6)
    auto = {r["series"]: r for r in stattests.adf_test(df, keys=["series"], ts="ts", value="value").collect()}
    assert auto["calm"]["statistic"] == pytest.approx(adf(calm, auto["calm"]["lags"]), abs=1e-6)
    decided = {r["series"]: r["decision"] for r in stattests.stationarity_decision(df, keys=["series"], ts="ts", value="value").collect()}
    assert decided == {"walk": "non_stationary", "calm": "stationary"}
    few = stattests.stationarity_decision(df.filter("ts < timestamp'1970-01-02'"), keys=["series"], ts="ts", value="value")
    assert {r["decision"] for r in few.collect()} == {"insufficient_data"}


def test_level_stationarity(spark):
    y = simulate(300, seed=4)[:, 0]
    n, e = len(y), y - y.mean()
    c = int(n ** (2 / 9))
    r = [e[i:] @ e[: n - i] / (n / 2) for i in range(1, c + 1)]
    s0, s1 = e @ e / n + sum(r), sum(i * x for i, x in enumerate(r, 1))
    l = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    lrv = (e @ e + 2 * sum((1 - i / (l + 1)) * (e[i:] @ e[: n - i]) for i in range(1, l + 1))) / n
    got = stattests.kpss_test(long(spark, y[:, None]), keys=["series"], ts="ts", value="value").first()
    assert got["lags"] == l and got["statistic"] == pytest.approx((np.cumsum(e) ** 2).sum() / n**2 / lrv)


def test_normality_tests(spark):
    rng = np.random.default_rng(8)
    y = np.column_stack([rng.normal(size=400), rng.exponential(size=400)])
    df = long(spark, y, ["normal", "skewed"])
    for test in (stattests.jarque_bera, stattests.shapiro_wilk, stattests.anderson_darling):
        got = {r["series"]: r["result"] for r in test(df, keys=["series"], value="value").collect()}
        assert got == {"normal": "PASS", "skewed": "FAIL"}, test.__name__
    w = {r["series"]: r["statistic"] for r in stattests.shapiro_wilk(df, keys=["series"], value="value").collect()}
    assert 0.99 < w["normal"] <= 1


def test_event_gates(spark):
    df = long(spark, simulate(100)[:, [0]])
    events = spark.sql("select explode(array(timestamp'1970-01-01 00:00:00', timestamp'1970-01-03 00:00:00')) event")
    got = {str(r["event"]): r for r in stattests.event_window_bootstrap(df, events, key="series", ts="ts", value="value", draws=20).collect()}
    assert (got["1970-01-01 00:00:00"]["statistic"], got["1970-01-01 00:00:00"]["p_value"]) == (0.0, 1.0)
    assert got["1970-01-03 00:00:00"]["statistic"] > 0


# --- graphs -----------------------------------------------------------------


@pytest.fixture(scope="module")
def edges(spark):
    rng = np.random.default_rng(11)
    nodes = [f"n{i}" for i in range(9)]
    rows = [(a, b, float(rng.integers(1, 4))) for a in nodes for b in nodes if a != b and rng.random() < 0.3]
    return spark.createDataFrame(rows, "src string, dst string, weight double").cache()


def shortest(rows, nodes):
    length = {(r.src, r.dst): 1 / r.weight for r in rows}
    score = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.permutations(nodes, 2):
        best, paths = np.inf, []

        def walk(path, d):
            nonlocal best, paths
            if d > best + 1e-12:
                return
            if path[-1] == t:
                if d < best - 1e-12:
                    best, paths = d, []
                paths.append(path)
                return
            for v in nodes:
                if v not in path and (path[-1], v) in length:
                    walk([*path, v], d + length[(path[-1], v)])

        walk([s], 0.0)
        for p in paths:
            for v in p[1:-1]:
                score[v] += 1 / len(paths)
    k = len(nodes)
    return {v: x / ((k - 1) * (k - 2)) for v, x in score.items()}


def test_betweenness_brute_force(edges):
    # Weights 1 and 2 keep sums of lengths exact, so equal paths tie exactly.
    exact = edges.withColumn("weight", F.when(F.col("weight") == 3, 2.0).otherwise(F.col("weight")))
    nodes = sorted(r["node"] for r in graph.nodes_of(exact).collect())
    got = {r["node"]: r["betweenness"] for r in graph.betweenness(exact).collect()}
    want = shortest(exact.collect(), nodes)
    assert got == pytest.approx(want)
    batched = {r["node"]: r["betweenness"] for r in graph.betweenness(exact, state=2 * len(nodes)).collect()}  # two sources at a time
    assert batched == pytest.approx(want)
    with pytest.raises(Exception, match="positive lengths"):
        graph.betweenness(exact.withColumn("weight", F.when(F.col("src") == nodes[0], 0.0).otherwise(F.col("weight"))), weight_is_distance=True).collect()


def test_pagerank_fixpoint(edges):
    got = {r["node"]: r["rank"] for r in graph.pagerank(edges).collect()}
    assert sum(got.values()) == pytest.approx(1)
    pdf = edges.toPandas()
    nodes = sorted(got)
    w = np.zeros((len(nodes), len(nodes)))
    for r in pdf.itertuples():
        w[nodes.index(r.src), nodes.index(r.dst)] += r.weight
    out = w.sum(1)
    p = np.divide(w, out[:, None], where=out[:, None] > 0, out=np.full_like(w, 1 / len(nodes)))
    x = np.full(len(nodes), 1 / len(nodes))
    for _ in range(300):
        x = 0.85 * p.T @ x + 0.15 / len(nodes)
    np.testing.assert_allclose([got[v] for v in nodes], x, atol=1e-5)


def test_clustering_of_a_triangle(spark):
    e = spark.createDataFrame([("a", "b", 2.0), ("b", "c", 2.0), ("c", "a", 2.0), ("a", "d", 1.0)], "src string, dst string, weight double")
    got = {r["node"]: r["clustering"] for r in graph.weighted_clustering(e).collect()}
    assert got == pytest.approx({"a": 1 / 3, "b": 1.0, "c": 1.0, "d": 0.0})


def test_components_of_a_long_chain(spark):
    chain = spark.range(40).select(F.format_string("v%03d", F.col("id")).alias("src"), F.format_string("v%03d", F.col("id") + 1).alias("dst"), F.lit(1.0).alias("weight"))
    assert [(r["label"], r["size"]) for r in graph.weak_components(chain).collect()] == [("v000", 41)]


def test_fold_models_equal_training(spark):
    """Moments give what Spark's own training gives, whatever the offset, with constant and NULL columns."""
    from undertow.operators import mlmodels

    rng = np.random.default_rng(12)
    x = rng.normal(size=(400, 2))
    y = 3 * x[:, 0] - x[:, 1] + rng.normal(size=400)
    fold = np.arange(400) % 2
    rows = [(int(fold[i]), "test" if i % 5 == 0 else "train", float(x[i, 0]), float(x[i, 1] + 1e6), 7.0, float(y[i])) for i in range(400)]
    df = spark.createDataFrame(rows, "fold int, role string, a double, b double, c double, y double").cache()
    dirty = df.unionByName(df.limit(5).withColumn("a", F.lit(None).cast("double")))
    got = {(r["model"], r["fold"]): r for r in mlmodels.cv_scores(dirty, features=["a", "b", "c"], target="y", kinds=["linear", "ridge"]).collect()}
    assert len(got) == 4
    for (kind, number), row in got.items():
        part = df.filter(F.col("fold") == number).withColumn("b", F.col("b") - 1e6)  # the offset is taken off for the training
        model = mlmodels.train_regressor(part.filter("role = 'train'"), features=["a", "b", "c"], target="y", kind=kind)
        e = np.array([r["y"] - r["prediction"] for r in model.transform(part.filter("role = 'test'")).collect()])
        truth = np.array([r["y"] for r in part.filter("role = 'test'").collect()])
        assert row["n"] == len(e)
        np.testing.assert_allclose([row["mse"], row["mae"], row["r2"]], [np.mean(e**2), np.mean(abs(e)), 1 - np.mean(e**2) / truth.var()], rtol=1e-6)


def test_folds_without_rows(spark):
    from undertow.operators import mlmodels

    df = spark.createDataFrame([(1, "train", 1.0, 2.0), (1, "train", 2.0, 2.0), (2, "test", 1.0, 1.0)], "fold int, role string, a double, y double")
    got = {r["fold"]: r for r in mlmodels.cv_scores(df, features=["a"], target="y", kinds=["linear"]).collect()}
    assert (got[1]["n"], got[1]["mse"], got[2]["n"], got[2]["mse"], got[2]["r2"]) == (0, None, 1, None, None)
    assert mlmodels.cv_scores(df.limit(0), features=["a"], target="y", kinds=["linear", "ridge"]).count() == 0


def test_break_by_counts(spark):
    """p-values agree with resampling of rows, wherever the values lie; series without a key, short and empty ones have a result."""
    rng = np.random.default_rng(3)
    y = np.column_stack([rng.normal(size=600), rng.normal(size=600) * np.repeat([1.0, 1.12], 300), rng.normal(size=600) * np.repeat([1.0, 3.0], 300)])
    df = long(spark, y, ["flat", "slight", "jump"])
    lost = df.filter("series = 'jump'").withColumn("series", F.lit(None).cast("string"))
    short = df.filter("series = 'flat'").orderBy("ts").limit(1).withColumn("series", F.lit("one"))
    rows = df.unionByName(lost).unionByName(short)
    run = lambda d, **kw: {r["series"]: r for r in stattests.variance_break_bootstrap(d, key="series", ts="ts", value="value", **kw).collect()}
    got = run(rows, draws=300)
    for j, name in enumerate(["flat", "slight", "jump"]):
        shift = lambda z: abs(z[:300].var() - z[300:].var()) / np.sqrt(z[:300].var() + z[300:].var())
        p = np.mean([shift(rng.choice(y[:, j], 600)) >= shift(y[:, j]) for _ in range(2000)])
        assert abs(got[name]["statistic"] - shift(y[:, j])) < 1e-9 and abs(got[name]["p_value"] - p) < 0.09, (name, p)
    assert got[None]["statistic"] == got["jump"]["statistic"] and got[None]["p_value"] < 0.05
    assert got["one"]["n"] == 1 and got["one"]["statistic"] == 0
    moved = run(df.withColumn("value", F.col("value") + 1e8), draws=300)
    assert moved["slight"]["p_value"] == pytest.approx(got["slight"]["p_value"], abs=0.02)
    assert run(df.limit(0)) == {}


def test_permutations_in_blocks(spark):
    """Small blocks give the p-value of whole permutations; a target that follows its feature stands out."""
    rng = np.random.default_rng(4)
    x, e = rng.normal(size=2000), rng.normal(size=2000)
    rows = [(i, float(x[i]), float(e[i]), float(e[i] + 0.2 * x[i] + 1e7)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, x double, y double, z double")
    df = df.unionByName(df.limit(3).withColumn("x", F.lit(None).cast("double")))
    for size in (100, 10_000):
        for target, clear in (("y", False), ("z", True)):
            s = stattests.permutation_test(df, id="id", features=["x"], target=target, draws=40, rows=size).collect()
            r2 = {r["draw"]: r["r2"] for r in s}
            assert len(r2) == 41 and {r["n"] for r in s} == {2000}
            assert r2[0] == pytest.approx(np.corrcoef(x, e if target == "y" else e + 0.2 * x)[0, 1] ** 2, rel=1e-6)
            assert 0 <= max(v for b, v in r2.items() if b) < 0.02 and len(set(r2.values())) == 41
            assert (r2[0] > max(v for b, v in r2.items() if b)) == clear or not clear
    still = stattests.permutation_test(df.withColumn("y", F.lit(1.0)), id="id", features=["x"], target="y", draws=2).collect()
    assert [r["r2"] for r in still] == [None] * 3
    assert stattests.permutation_test(df.limit(0), id="id", features=["x"], target="y", draws=2).count() == 0


def test_tiled_correlations(spark):
    """More series than a tile, with gaps: every pair as numpy has it, for each lag; pairs that never meet are NULL."""
    rng = np.random.default_rng(6)
    y = rng.normal(size=(30, 70)).cumsum(axis=0) + 1e4
    y[rng.random(y.shape) < 0.2] = np.nan
    y[:, 0], y[3:, 1], y[:10, 69], y[:, 68] = np.nan, np.nan, np.nan, 5.0
    y[0, 0] = 1.0
    rows = [(t, f"s{j:02d}", float(y[t, j])) for t in range(30) for j in range(70) if not np.isnan(y[t, j])] + [(3, None, 1.0)]
    df = spark.createDataFrame(rows, "ts int, series string, value double")
    got = {(r["src"], r["dst"], r["lag"]): r for r in causality.pair_correlations(df, series="series", ts="ts", value="value", lags=[0, 2]).collect()}
    assert len(got) == 2 * 70 * 69
    for (a, b, lag), r in got.items():
        u, v = y[: 30 - lag, int(a[1:])], y[lag:, int(b[1:])]
        both = ~np.isnan(u) & ~np.isnan(v)
        assert r["n"] == both.sum()
        if r["n"] < 2 or np.ptp(u[both]) == 0 or np.ptp(v[both]) == 0:
            assert r["corr"] is None
        else:
            assert r["corr"] == pytest.approx(np.corrcoef(u[both], v[both])[0, 1], abs=1e-8)
    assert causality.pair_correlations(df.limit(0), series="series", ts="ts", value="value", lags=[1]).count() == 0
