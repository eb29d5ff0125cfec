"""Hand-computed values and published table values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from undertow import schemas
from undertow.functions import scalars, tails, varmath
from undertow.operators import aggregate, causality, features, graph, grid, mlprep, portfolio, stattests, transmission


def test_tail_tables():
    assert tails.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=2e-4)
    assert tails.t_two_sided(1.96, 1e6) == pytest.approx(0.05, abs=1e-4)
    assert tails.f_upper(4.96, 1, 10) == pytest.approx(0.05, abs=2e-4)
    assert tails.f_upper(3.33, 5, 10) == pytest.approx(0.05, abs=5e-4)
    assert tails.normal_cdf(1.959964) == pytest.approx(0.975, abs=1e-6)
    assert tails.f_upper(0.0, 2, 9) == pytest.approx(1.0)


def test_closed_tails(spark):
    row = spark.range(1).select(
        tails.chi2_even(F.lit(5.991), 2).alias("jb"), tails.chi2_even(F.lit(18.307), 10).alias("lb"),
        tails.adf_p(F.lit(-2.86)).alias("adf"), tails.kpss_p(F.lit(0.463)).alias("kpss"), tails.adf_p(F.lit(3.0)).alias("top"),
    ).first()
    assert row["jb"] == pytest.approx(0.05, abs=1e-4)
    assert row["lb"] == pytest.approx(0.05, abs=1e-4)
    assert row["adf"] == pytest.approx(0.05, abs=2e-3)
    assert row["kpss"] == pytest.approx(0.05)
    assert row["top"] == 1.0


def test_gini_of_stored_counts(spark):
    counts = [266, 249, 247, 227, 202, 199, 196, 192, 172, 172, 161, 143, 121, 110, 107, 105, 72, 58, 57, 51]
    df = spark.createDataFrame([(c,) for c in counts], "x long")
    assert aggregate.gini(df, value="x").first()["gini"] == pytest.approx(0.2437882201480528, abs=1e-12)


def test_density(spark):
    nodes = spark.range(20).select(F.col("id").cast("string").alias("node"))
    edges = spark.createDataFrame([("0", "1", 1.0), ("2", "3", 1.0), ("4", "5", 1.0), ("6", "7", 1.0)], "src string, dst string, weight double")
    row = graph.graph_counts(edges, nodes).first()
    assert row["density"] == pytest.approx(0.010526315789473684)
    assert graph.weak_components(edges, nodes).count() == 16


@pytest.fixture(scope="module")
def theta(spark):
    rows = [(0, "1", "1", 0.8), (0, "1", "2", 0.2), (0, "2", "1", 0.4), (0, "2", "2", 0.6)]
    return spark.createDataFrame(rows, "window_id long, to_series string, from_series string, theta double")


def test_share_table(theta):
    assert transmission.spill_total(theta).first()["total"] == pytest.approx(30)
    net = {r["series"]: r for r in transmission.spill_net(theta).collect()}
    assert (net["1"]["sent"], net["1"]["received"], net["1"]["net"]) == pytest.approx((20, 10, 10))
    assert net["2"]["net"] == pytest.approx(-10)
    pair = {(r["src"], r["dst"]): r["net"] for r in transmission.spill_pairwise(theta).collect()}
    assert pair[("1", "2")] == pytest.approx(10) and pair[("2", "1")] == pytest.approx(-10) and pair[("1", "1")] == 0
    table = {(r["row"], r["col"]): r["value"] for r in transmission.spill_table(theta).collect()}
    assert table[("TO_others", "FROM_others")] == pytest.approx(30) and table[("Net", "1")] == pytest.approx(10)


def test_closed_form_decomposition():
    lags, sigma = np.array([[[0.5, 0.0], [0.4, 0.3]]]), np.eye(2)
    for method in ("cholesky", "generalized"):
        share = varmath.decompose(varmath.moving_average(lags, 10), sigma, method)[-1]
        np.testing.assert_allclose(share, [[1, 0], [0.22397777, 0.77602223]], atol=1e-8)
    assert varmath.companion_radius(lags) == pytest.approx(0.5)
    zero = varmath.decompose(varmath.moving_average(np.zeros((1, 2, 2)), 10), np.diag([1.0, 4.0]))[-1]
    np.testing.assert_allclose(zero, np.eye(2))


def test_limited_fill(spark):
    rows = [("s", i, v) for i, v in enumerate([1.0, None, None, None, None, 2.0])]
    df = spark.createDataFrame(rows, "k string, ts int, v double")
    got = [r["v"] for r in grid.ffill_limited(df, keys=["k"], ts="ts", value="v").orderBy("ts").collect()]
    assert got == [1.0, 1.0, 1.0, 1.0, None, 2.0]


def test_small_frames(spark):
    df = spark.createDataFrame([("s", 1, 1.0), ("s", 2, 3.0), ("s", 3, 7.0)], "k string, ts int, v double")
    rows = features.rolling_stats_rows(df, "v", keys=["k"], order=["ts"], block=F.lit(0), widths=(1, 6)).orderBy("ts").collect()
    assert rows[0]["std_6"] is None and rows[1]["skew_6"] is None and rows[2]["skew_6"] is not None and rows[2]["kurt_6"] is None
    assert all(r["std_1"] is None for r in rows)


def test_bonferroni(spark):
    df = spark.createDataFrame([(0.01,), (0.02,), (0.5,), (None,)], "p_value double").filter("p_value is not null")
    got = sorted(r["p_corrected"] for r in stattests.bonferroni(df).collect())
    assert got == pytest.approx([0.03, 0.06, 1.0])


def test_backtest_two_prices(spark):
    w = spark.createDataFrame([(1, "s", 10.0, 1.0), (2, "s", 11.0, 1.0)], "ts int, series string, price double, weight double")
    literal = [r["total_value"] for r in portfolio.backtest_literal(w, capital=100, cost=0.0).orderBy("ts").collect()]
    compound = [r["total_value"] for r in portfolio.backtest_compounding(w, capital=100, cost=0.0).orderBy("ts").collect()]
    assert literal == pytest.approx([100, 210]) and compound == pytest.approx([100, 110])


def test_backtest_equals_loop(spark):
    rng = np.random.default_rng(1)
    prices = 10 * np.exp(np.cumsum(rng.normal(0, 0.02, (30, 2)), axis=0))
    weights = rng.uniform(-0.5, 0.5, (30, 2))
    rows = [(t, f"s{j}", float(prices[t, j]), float(weights[t, j])) for t in range(30) for j in range(2)]
    df = spark.createDataFrame(rows, "ts int, series string, price double, weight double")
    got = [r["total_value"] for r in portfolio.backtest_compounding(df, capital=1000, cost=0.001, slippage=0.0005).orderBy("ts").collect()]
    value, held, want = 1000.0, np.zeros(2), []
    for t in range(30):
        if t:
            value_before = value
            gain = held * value_before * (prices[t] / prices[t - 1] - 1)
            value = value_before + gain.sum()
            drift = (held * value_before + gain) / value
        else:
            drift = held
        value *= 1 - 0.0015 * np.abs(weights[t] - drift).sum()
        held = weights[t]
        want.append(value)
    np.testing.assert_allclose(got, want, rtol=1e-10)


def test_bankrupt_path_stays_at_zero(spark):
    w = spark.createDataFrame([(1, "s", 10.0, -1.0), (2, "s", 25.0, -1.0), (3, "s", 20.0, -1.0)], "ts int, series string, price double, weight double")
    got = [(r["total_value"], r["bankrupt"]) for r in portfolio.backtest_compounding(w, capital=100, cost=0.0).orderBy("ts").collect()]
    assert got[1:] == [(0.0, 1), (0.0, 1)]


def test_compound_of_unknown_label_is_null(spark):
    df = spark.createDataFrame([("positive", 2.0), ("negative", 0.5), (None, 0.9), ("odd", 0.9)], "label string, score double")
    assert [r["compound"] for r in scalars.compound_sentiment(df).collect()] == [1.0, -0.5, None, None]


def test_default_words_match_inside_words(spark):
    df = spark.createDataFrame([("Support", "to the MOON moon"), (None, None)], "title string, body string")
    m = scalars.mention_counts(df).collect()
    assert (m[0]["bullish_mentions"], m[0]["bearish_mentions"]) == (3, 0) and m[1]["sentiment_polarity"] == 0
    l = scalars.lexicon_sentiment(df).collect()
    assert l[0]["lexicon_label"] == "positive" and l[0]["lexicon_score"] == pytest.approx(0.2) and l[1]["lexicon_label"] == "neutral"
    assert scalars.keyword_flags(df, text="body").collect()[1]["has_fear"] is False


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1)], "y int, s double")
    assert mlprep.binary_auc(df, y="y", score="s").first()["auc"] == pytest.approx((0.5 + 1 + 0 + 1) / 4)


def test_numeric_guards(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("inf"), "b"), (float("nan"), "c"), (None, "d")], "x double, s string")
    assert [r["s"] for r in scalars.finite_filter(df, ["x"]).collect()] == ["a"]
    assert [r["x"] for r in scalars.inf_to_null(df, ["x"]).collect()] == [1.0, None, None, None]
    assert [r["column_name"] for r in scalars.numeric_columns(df).collect()] == ["x"]
    assert schemas.COMMUNITY_COIN["xrp"] == "ripple"


def test_lagged_correlations_use_the_times_each_pair_has(spark):
    rng = np.random.default_rng(3)
    full = {name: rng.normal(size=60) + 1e6 for name in "abc"}
    full["b"][1:] = 0.7 * (full["a"][:-1] - 1e6) + full["b"][1:]
    rows = [(name, i * 3600, float(v)) for name, x in full.items() for i, v in enumerate(x)]
    frame = "series string, t long, value double"
    shape = lambda data: spark.createDataFrame(data, frame).withColumn("ts", F.timestamp_seconds("t"))
    found = lambda data: {(r.src, r.dst, r.lag): r for r in causality.lagged_corr(shape(data), series="series", ts="ts", value="value", max_lags=3).collect()}
    plain = found(rows)
    for (src, dst, lag), r in plain.items():
        assert r.n == 60 - lag
        assert r.corr == pytest.approx(np.corrcoef(full[src][:-lag], full[dst][lag:])[0, 1], abs=1e-6)
    assert plain["a", "b", 1].p_value < 0.01
    # one bar of a new series, one value missing, one series with half its bars
    other = [(n, t, None if (n, t) == ("c", 36000) else v) for n, t, v in rows if n != "c" or t < 30 * 3600] + [("d", 7200, 5.0), ("e", None, 1.0), (None, 3600, 1.0)]
    sparse = found(other)
    for lag in (1, 2, 3):
        for pair in (("a", "b"), ("b", "a")):
            assert sparse[*pair, lag].n == 60 - lag and sparse[*pair, lag].corr == pytest.approx(plain[*pair, lag].corr, abs=1e-9)
        assert sparse["d", "a", lag].n == 1 and sparse["d", "a", lag].corr is None and sparse["d", "a", lag].p_value is None
        at = np.array([i for i in range(30) if i != 10])  # c at i meets a at i + lag
        assert sparse["c", "a", lag].n == 29
        assert sparse["c", "a", lag].corr == pytest.approx(np.corrcoef(full["c"][at], full["a"][at + lag])[0, 1], abs=1e-6)


def test_distinct_sketches_roll_up_without_the_ids(spark):
    rows = spark.range(40_000).selectExpr("id % 3 AS k", "id % 10 AS day", "CASE WHEN id % 7 > 0 THEN id % 9000 END AS v")
    rows = rows.unionByName(spark.createDataFrame([(9, 1, None)], "k long, day long, v long"))
    stored = aggregate.distinct_sketches(rows, value="v", by=["k", "day"])
    exact = {r["k"]: r["n_distinct"] for r in aggregate.count_distinct(rows, value="v", by=["k"]).collect()}
    got = {r["k"]: r["n_estimated"] for r in aggregate.rolled_distinct(stored, ["k"]).collect()}
    assert got.keys() == exact.keys() and got[9] == 0
    assert all(got[k] == pytest.approx(n, rel=0.04) for k, n in exact.items())
    assert aggregate.rolled_distinct(stored).first()["n_estimated"] == pytest.approx(9000, rel=0.04)
    small = aggregate.distinct_sketches(rows.limit(0), value="v", by=["k"])
    assert aggregate.rolled_distinct(small, ["k"]).count() == 0
