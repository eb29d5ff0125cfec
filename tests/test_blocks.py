"""Blocked ordered computations against plain pandas, with one series holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from undertow.operators import blocks, features, joins, mlprep, stattests


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(7)
    n = 900
    series = rng.choice(["hot", "a", "b"], n, p=[0.8, 0.1, 0.1])
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 4 * 86400, n), unit="s")
    x = np.where(rng.random(n) < 0.15, np.nan, rng.normal(size=n).round(3))
    return pd.DataFrame({"series": series, "ts": ts, "id": np.arange(n), "x": x}).sort_values(["series", "ts", "id"]).reset_index(drop=True)


@pytest.fixture(scope="module")
def data(spark, frame):
    return spark.createDataFrame(frame.astype({"x": object}).where(frame.notna(), None), "series string, ts timestamp, id long, x double").repartition(5)


def block():
    return blocks.time_block("ts", 6 * 3600)


def ordered(df):
    return df.toPandas().sort_values(["series", "ts", "id"]).reset_index(drop=True)


def test_positions_and_running(data, frame):
    got = ordered(blocks.running(data, ["series"], ["ts", "id"], {"pos": F.lit(1), "total": F.coalesce("x", F.lit(0.0))}, block()))
    assert (got["pos"] == frame.groupby("series").cumcount() + 1).all()
    np.testing.assert_allclose(got["total"].astype(float), frame["x"].fillna(0).groupby(frame["series"]).cumsum(), atol=1e-9)


def test_over_rows_crosses_block_edges(data, frame):
    got = ordered(
        blocks.over_rows(
            data, ["series"], ["ts", "id"],
            lambda f: {"m": F.avg("x").over(f(-6, 0)), "nxt": F.lead("id", 2).over(f.ordered)},
            block=block(), back=6, ahead=2, rows=10,
        )
    )
    want = frame.groupby("series")["x"].rolling(7, min_periods=1).mean().reset_index(drop=True)
    np.testing.assert_allclose(got["m"].astype(float), want, atol=1e-9)
    nxt = frame.groupby("series")["id"].shift(-2)
    assert (got["nxt"].fillna(-1) == nxt.fillna(-1)).all()


def test_over_rows_frame_wider_than_block(data, frame):
    got = ordered(blocks.over_rows(data, ["series"], ["ts", "id"], lambda f: {"c": F.count("*").over(f(-99, 0))}, block=block(), back=99, rows=3))
    assert (got["c"] == np.minimum(frame.groupby("series").cumcount() + 1, 100)).all()


def test_time_sums_match_brute_force(data, frame):
    got = ordered(
        blocks.time_sums(
            data, ["series"], "ts", {"n": F.lit(1.0), "s": F.coalesce("x", F.lit(0.0))}, {"h": 3600, "d": 86400}, lambda us: F.floor(F.col(us) / 18_000_000_000)
        )
    )
    for tag, span in (("h", 3600), ("d", 86400)):
        for i, row in frame.iterrows():
            mine = frame[(frame.series == row.series) & (frame.ts <= row.ts) & (frame.ts >= row.ts - pd.Timedelta(seconds=span))]
            assert got.loc[i, f"n_{tag}"] == len(mine)
            assert abs(got.loc[i, f"s_{tag}"] - mine.x.fillna(0).sum()) < 1e-9


def test_rolling_time_statistics_match_frames(data, frame):
    clean = data.filter("x is not null")
    got = features.rolling_stats_time(clean, "x", keys=["series"], ts="ts", hours=(6,)).toPandas().set_index("id")
    for row in frame.dropna().itertuples():
        mine = frame.dropna()
        mine = mine[(mine.series == row.series) & (mine.ts <= row.ts) & (mine.ts >= row.ts - pd.Timedelta(hours=6))].x
        assert got.loc[row.id, "mean_6h"] == pytest.approx(mine.mean(), abs=1e-9)
        if len(mine) > 3:
            assert got.loc[row.id, "std_6h"] == pytest.approx(mine.std(), abs=1e-7)
            assert got.loc[row.id, "skew_6h"] == pytest.approx(mine.skew(), abs=1e-5)


@pytest.mark.parametrize("rows", [50, 2_000_000])
def test_rolling_time_statistics_keep_their_digits(spark, monkeypatch, rows):
    # An outlier long gone, small units, a large offset, a constant stretch and rows without a key.
    monkeypatch.setattr(blocks, "ROWS_PER_BLOCK", rows)
    rng = np.random.default_rng(5)
    t = np.sort(rng.integers(0, 400 * 600, 400))
    wave = np.sin(t / 5000) + rng.normal(size=400) * 0.1
    wave[150:200] = 0.5
    shapes = {"outlier": np.where(np.arange(400) == 10, 1e6, wave), "small": wave * 1e-7, "far": wave + 1e9, None: wave}
    frame = pd.concat([pd.DataFrame({"k": k, "t": t, "i": np.arange(400), "x": x}) for k, x in shapes.items()])
    df = spark.createDataFrame(frame.astype({"k": object}), "k string, t long, i long, x double").withColumn("ts", F.timestamp_seconds("t"))
    got = features.rolling_stats_time(df, "x", keys=["k"], ts="ts", hours=(1, 6)).toPandas()
    assert len(got) == len(frame)
    for k, x in shapes.items():
        mine = got[got.k.isna() if k is None else got.k == k].sort_values("i")
        for hours in (1, 6):
            for i, row in enumerate(mine.itertuples()):
                if k == "outlier" and t[i] - hours * 3600 <= t[10]:
                    continue
                part = x[(t >= t[i] - hours * 3600) & (t <= t[i])]
                z = part - part[0] - (part - part[0]).mean()  # a mean near 1e9 would itself be off by 1e-7
                n, m2 = len(z), (z**2).mean()
                assert getattr(row, f"mean_{hours}h") == pytest.approx(part.mean(), rel=1e-12)
                if n > 3 and part.max() == part.min():
                    assert pd.isna(getattr(row, f"skew_{hours}h")) and pd.isna(getattr(row, f"kurt_{hours}h")) and getattr(row, f"std_{hours}h") == 0
                elif n > 3:
                    assert getattr(row, f"std_{hours}h") == pytest.approx(np.sqrt(m2 * n / (n - 1)), rel=1e-6)
                    assert getattr(row, f"skew_{hours}h") == pytest.approx((z**3).mean() / m2**1.5 * np.sqrt(n * (n - 1)) / (n - 2), rel=1e-6, abs=1e-6)
                    assert getattr(row, f"kurt_{hours}h") == pytest.approx((z**4).mean() / m2**2 - 3, rel=1e-6, abs=1e-6)


def test_rolling_time_statistics_cut_blocks_before_any_window(data, monkeypatch):
    # Cut points are looked for once, in stored instants: not in totals that would be worked out again for them.
    seen, cut = [], blocks.even_block

    def noted(df, *rest):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df, *rest)

    monkeypatch.setattr(blocks, "ROWS_PER_BLOCK", 20)
    monkeypatch.setattr(blocks, "even_block", noted)
    got = ordered(features.rolling_stats_time(data, "x", keys=["series"], ts="ts", hours=(1, 6)))
    monkeypatch.setattr(blocks, "ROWS_PER_BLOCK", 2_000_000)
    want = ordered(features.rolling_stats_time(data, "x", keys=["series"], ts="ts", hours=(1, 6)))
    assert len(seen) == 2 and not any("Window" in plan for plan in seen)
    made = [c for c in want.columns if c.split("_")[0] in ("mean", "std", "skew", "kurt")]
    assert len(made) == 8 and np.allclose(got[made].astype(float), want[made].astype(float), rtol=1e-9, atol=1e-9, equal_nan=True)


def test_even_blocks_bound_every_group(spark, monkeypatch):
    # Half of all rows share one instant and one series; the id still splits them.
    df = spark.range(4000).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise("cold").alias("k"),
        F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id")).alias("t"), "id",
    )
    sizes = df.withColumn("b", blocks.even_block(df, ["t", "id"], rows=200)).groupBy("b").count().toPandas()
    assert len(sizes) >= 15 and sizes["count"].max() < 800
    order = df.withColumn("b", blocks.even_block(df, ["t", "id"], rows=200)).orderBy("t", "id").toPandas()
    assert order.b.is_monotonic_increasing
    monkeypatch.setattr(blocks, "ROWS_PER_BLOCK", 200)
    pos = blocks.positions(df, ["k"], ["t", "id"]).toPandas().sort_values(["k", "t", "id"])
    assert (pos.pos.to_numpy() == pos.groupby("k").cumcount().to_numpy() + 1).all()


def test_operators_agree_across_block_sizes(data, monkeypatch):
    def results():
        before = ordered(blocks.previous(data, ["series"], ["ts", "id"], {"b": "id"}))
        last = ordered(blocks.carry(data, ["series"], ["ts", "id"], {"c": "x"}))
        sums = ordered(blocks.time_sums(data, ["series"], "ts", {"n": F.lit(1.0)}, {"d": 86400}))
        return before.b.fillna(-1).tolist(), last.c.astype(float).fillna(-9).tolist(), sums.n_d.tolist()

    whole = results()
    monkeypatch.setattr(blocks, "ROWS_PER_BLOCK", 70)
    assert results() == whole


def test_carry_and_previous(data, frame):
    got = ordered(blocks.carry(data, ["series"], ["ts", "id"], {"last_x": "x"}, block()))
    want = frame.groupby("series")["x"].ffill()
    np.testing.assert_allclose(got["last_x"].astype(float), want)
    before = ordered(blocks.previous(data, ["series"], ["ts", "id"], {"b": "id"}, block()))
    assert (before["b"].fillna(-1) == frame.groupby("series")["id"].shift(1).fillna(-1)).all()


def test_quantiles_are_exact(data, frame):
    got = blocks.quantiles(data, ["series"], "x", {"lo": 0.05, "mid": 0.5, "hi": 0.9}, blocks=8).toPandas().set_index("series")
    for name, p in (("lo", 0.05), ("mid", 0.5), ("hi", 0.9)):
        want = frame.dropna().groupby("series")["x"].quantile(p)
        np.testing.assert_allclose(got[name], want.loc[got.index], atol=1e-12)


def test_quantiles_with_copies(spark):
    df = spark.range(999).select(F.when(F.col("id") < 600, 5.0).otherwise(F.col("id").cast("double")).alias("x"))
    assert blocks.quantiles(df, [], "x", {"m": 0.5}).first()["m"] == 5.0


@pytest.mark.parametrize("rows", [None, 60])
@pytest.mark.parametrize("by", [[], ["series"]])
def test_asof_nearest_brute_force(data, frame, by, rows):
    left, right = data.filter("id % 3 = 0"), data.filter("id % 3 = 1").withColumnRenamed("id", "rid")
    got = joins.asof_join_nearest(left, right, on="ts", left_id="id", right_id="rid", tolerance=600, by=by, rows=rows).toPandas().set_index("id")["rid"]
    lf, rf = frame[frame.id % 3 == 0], frame[frame.id % 3 == 1]
    for row in lf.itertuples():
        c = rf if not by else rf[rf.series == row.series]
        gap = (c.ts - row.ts).abs().dt.total_seconds()
        c = c[gap <= 600].assign(gap=gap[gap <= 600]).sort_values(["gap", "ts", "id"])
        want = c.id.iloc[0] if len(c) else None
        assert (pd.isna(got[row.id]) and want is None) or got[row.id] == want


def test_asof_nearest_ties(spark):
    left = spark.sql("select 1L id, timestamp'2024-01-01 00:10:00' ts")
    right = spark.sql("select * from values (5L, timestamp'2024-01-01 00:12:00'), (7L, timestamp'2024-01-01 00:08:00'), (6L, timestamp'2024-01-01 00:08:00') t(rid, ts)")
    assert joins.asof_join_nearest(left, right, on="ts", left_id="id", right_id="rid", tolerance=600).first()["rid"] == 6


def test_asof_backward(spark, data, frame):
    right = data.filter("id % 4 = 0").select("series", "ts", F.col("id").alias("seen"))
    got = joins.asof_join_backward(data.filter("id % 4 = 1"), right, on="ts", values=["seen"], by=["series"], block=blocks.time_block("ts", 7200)).toPandas()
    rf = frame[frame.id % 4 == 0]
    for row in got.itertuples():
        c = rf[(rf.series == row.series) & (rf.ts <= row.ts)].sort_values("ts")
        if len(c):
            assert frame.loc[frame.id == row.seen, "ts"].iloc[0] == c.ts.iloc[-1]
        else:
            assert pd.isna(row.seen)


def test_rows_without_a_key_survive_every_block_size(data, monkeypatch):
    some = data.withColumn("series", F.when(F.col("id") % 9 > 0, F.col("series"))).withColumn("label", F.when(F.col("id") % 7 > 0, F.col("id") % 2))

    def results():
        made = [
            blocks.positions(some, ["series"], ["ts", "id"]),
            blocks.previous(some, ["series"], ["ts", "id"], {"b": "id"}),
            blocks.carry(some, ["series"], ["ts", "id"], {"c": "x"}),
            blocks.time_sums(some, ["series"], "ts", {"n": F.lit(1.0)}, {"d": 86400}),
            mlprep.exact_stratified_split(some, id=["id"], label="label"),
            joins.asof_join_nearest(some.filter("id % 2 = 0"), some.filter("id % 2 = 1").withColumnRenamed("id", "rid"), on="ts", left_id="id", right_id="rid", tolerance=900, by=["series"]),
        ]
        return [sorted(map(str, df.collect())) for df in made]

    whole = results()
    assert [len(rows) for rows in whole] == [900] * 5 + [450]
    for size in (50, 300):
        monkeypatch.setattr(blocks, "ROWS_PER_BLOCK", size)
        assert results() == whole


def test_groups_without_a_key_are_ranked_and_sizes_get_a_reason(data):
    some = data.filter("x is not null").withColumn("series", F.when(F.col("series") != "a", F.col("series")))
    for test in (stattests.anderson_darling, stattests.jarque_bera, stattests.shapiro_wilk):
        assert {r["series"] for r in test(some, keys=["series"], value="x").collect()} == {"hot", "b", None}
    assert blocks.quantiles(some, ["series"], "x", {"m": 0.5}).filter("series is null and m is not null").count() == 1
    rows = {r["series"]: r for r in stattests.shapiro_wilk(some, keys=["series"], value="x", most=200).collect()}
    assert rows["hot"]["result"] == "too many values" and rows["hot"]["p_value"] is None and rows["b"]["p_value"] is not None
