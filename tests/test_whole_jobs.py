"""Queries on tables that the stored ones do not show: constant moods, lists of every scheme, permutations over the whole table."""

import datetime as dt
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from undertow.plans import catalog


def beside_sql(spark, folder, name, tables, **rows):
    """Rows of a query and of its SQL over DataFrames written to ``folder``."""
    duck = duckdb.connect()
    for t, df in rows.items():
        df.write.parquet(f"{folder}/{t}.parquet")
        duck.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    queries, oracles = tables
    got = queries[name](spark, str(folder))
    cursor = duck.execute(oracles[name])
    names = [c[0] for c in cursor.description]
    want = [tuple(row[names.index(c)] for c in got.columns) for row in cursor.fetchall()]
    return sorted(map(repr, map(tuple, got.collect()))), sorted(map(repr, want))


def test_strategy_without_trades(spark, tmp_path):
    """A mood that never crosses a limit trades never: no result per trade, on both sides; nor a ratio without spread."""
    day = dt.datetime(1995, 1, 1)
    rows = [(d, "O", 100.0 + 7 * d % 13, day + dt.timedelta(days=d), "down") for d in range(30)]
    rows += [(100 + d, "F", 100.0 * 2**d, day + dt.timedelta(days=d), "doubles") for d in range(10)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string")
    got, want = beside_sql(spark, tmp_path, "threshold_strategy_summary", (catalog.QUERIES, catalog.ORACLES), orders=orders)
    assert got == want and len(got) == 2
    assert "inf" not in str(got)


def test_list_of_every_scheme(spark, tmp_path):
    """Pages of reported hosts are on the list whatever their scheme; so are their other forms."""
    pytest.importorskip("undertow.llm.queries")
    from undertow.llm import queries

    urls = ["https://spam-farm.org/a", "ftp://www.spam-farm.org:80/a/?utm_x=1", "HTTP://x.cheap-pills.com/b?q=1", "https://fine.org/a", "spam-farm.org/a", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got, want = beside_sql(spark, tmp_path, "op9_bloom_urls", (queries.QUERIES, queries.ORACLES), pages=pages)
    assert got == want
    listed = {r["page_id"]: r["listed"] for r in queries.QUERIES["op9_bloom_urls"](spark, str(tmp_path)).collect()}
    assert listed == {0: True, 1: True, 2: True, 3: False, 4: False, 5: False}


def test_permutations_of_the_whole_table(spark):
    """Targets leave their block: every draw pairs places of whole orders, as worked out row by row."""
    import hashlib

    import numpy as np

    from undertow.operators import stattests

    rng = np.random.default_rng(8)
    x, y = rng.normal(size=900), rng.normal(size=900)
    ids = [f"r{i}" for i in range(900)]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, a, b in zip(ids, x, y)], "id string, x double, y double")
    number = lambda tag, i: int(hashlib.md5(f"{tag}-{i}".encode()).hexdigest()[:8], 16)
    order = lambda tag: sorted(range(900), key=lambda k: (number(tag, ids[k]), ids[k]))
    got = {r["draw"]: r["r2"] for r in stattests.permutation_test(df, id="id", features=["x"], target="y", draws=3, rows=50).collect()}
    for b in range(4):
        want = np.corrcoef(x[order("row")], y[order("row" if b == 0 else b)])[0, 1] ** 2
        assert got[b] == pytest.approx(want, rel=1e-9), b
    assert list(stattests._order(np.array([5, 2, 5, 2]), np.array(["b", "d", "a", None], dtype=object))) == [3, 1, 2, 0]


@pytest.mark.parametrize("rows", [20, 10_000])
def test_folds_without_ordering_the_table(spark, rows, monkeypatch):
    """Folds by comparison with a few keys are those by position; equal and missing times keep exact sizes; moments match."""
    import numpy as np

    from undertow.operators import blocks, mlmodels, mlprep, moments

    monkeypatch.setattr(blocks, "ROWS_PER_BLOCK", rows)
    rng = np.random.default_rng(2)
    times = [None if i % 50 == 0 else dt.datetime(2024, 1, 1) + dt.timedelta(minutes=int(rng.integers(40))) for i in range(203)]
    df = spark.createDataFrame([(t, i, float(i % 7), 1e8 + float(i % 11)) for i, t in enumerate(times)], "ts timestamp, id int, a double, y double")
    made = mlprep.timeseries_folds(df, ts="ts", id=["id"], folds=3)
    assert "Window" not in made._jdf.queryExecution().optimizedPlan().toString()
    order = sorted(range(203), key=lambda i: (times[i] is not None, times[i] or 0, i))
    place = {i: p for p, i in enumerate(order)}
    want = {(i, f, "train" if place[i] < 203 - (4 - f) * 50 else "test") for i in range(203) for f in (1, 2, 3) if place[i] < 203 - (4 - f) * 50 + 50}
    assert {(r["id"], r["fold"], r["role"]) for r in made.collect()} == want
    alike = mlprep.timeseries_folds(df.withColumn("id", F.lit(1)).withColumn("ts", F.lit("2024-01-01").cast("timestamp")), ts="ts", id=["id"], folds=3)
    assert {(r["fold"], r["role"]): r["count"] for r in alike.groupBy("fold", "role").count().collect()} == {(f, o): c for f in (1, 2, 3) for o, c in (("train", 3 + 50 * f), ("test", 50))}
    split = mlprep.time_split(df, ts="ts", id=["id"], shares={"train": 0.7, "val": 0.15, "test": 0.15}).collect()
    assert all(r["split"] == ("train" if place[r["id"]] < 142 else "val" if place[r["id"]] < 172 else "test") for r in split)
    for r in mlmodels.fold_moments(made, features=["a"], target="y").collect():
        v = np.array([[i % 7, 1e8 + i % 11] for i, f, o in want if (f, o) == (r["fold"], r["role"])])
        np.testing.assert_allclose(moments.unpack(r["cells"], 2), np.cov(v.T, ddof=0) * len(v), rtol=1e-9)
        np.testing.assert_allclose(r["means"], v.mean(axis=0), rtol=1e-12)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="stored tables are not here")
def test_shared_steps_are_stored(spark, monkeypatch):
    """Edges are not joined again, and rows not hashed again, by every reader."""
    from undertow.operators import mlmodels
    from undertow.sources.tables import Tables

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan(Tables(spark, "/root/testdata/sf0.001").flows)
    train, plans = mlmodels.train_regressor, []

    def seen(df, **kw):
        plans.append(plan(df))
        return train(df, **kw)

    monkeypatch.setattr(mlmodels, "train_regressor", seen)
    assert catalog.QUERIES["train_regressor"](spark, "/root/testdata/sf0.001").count() == 3
    assert len(plans) == 3 and not any("md5" in p for p in plans)


def test_permutations_leave_no_shuffle_and_carry_no_id(spark, monkeypatch):
    """Copies travel by a number instead of the id, in rounds, into as many partitions as ranges; equal hashes go by id; no round leaves its shuffle."""
    import hashlib
    import re

    import numpy as np

    from undertow.operators import stattests

    def left():
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        names = [files.apply(i).getName() for i in range(files.size())]
        return {name.split("_")[1] for name in names if name.startswith("shuffle_")}

    number = lambda tag, i: int(hashlib.md5(f"{tag}-{i}".encode()).hexdigest()[:2], 16)
    monkeypatch.setattr(stattests, "hash_number", lambda *p: F.conv(F.substring(F.md5(F.concat_ws("-", *[c.cast("string") for c in p])), 1, 2), 16, 10).cast("long"))
    monkeypatch.setattr(stattests, "DRAWS_AT_ONCE", 2)
    plans, cut = [], stattests.cut_lineage
    monkeypatch.setattr(stattests, "cut_lineage", lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString()) or cut(d))
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=900), rng.normal(size=900)
    ids = [f"r{i}" for i in rng.permutation(900)]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, a, b in zip(ids, x, y)], "id string, x double, y double")
    before = left()
    got = {r["draw"]: r["r2"] for r in stattests.permutation_test(df, id="id", features=["x"], target="y", draws=5, rows=200).collect()}
    order = lambda tag: sorted(range(900), key=lambda k: (number(tag, ids[k]), ids[k]))
    for b in range(6):
        want = np.corrcoef(x[order("row")], y[order("row" if b == 0 else b)])[0, 1] ** 2
        assert got[b] == pytest.approx(want, rel=1e-9), b
    assert len(left() - before) <= 3  # the count of the rows, and the result's own two steps
    rounds = [p.splitlines() for p in plans if "CoGroup" in p]
    assert len(rounds) == 3
    for lines in rounds:
        below = lines[next(i for i, line in enumerate(lines) if "CoGroup" in line) :]
        made = [i for i, line in enumerate(below) if re.search(r"Exchange hashpartitioning\(block#\w+, 5\), REPARTITION_BY_NUM", line)]
        assert len(made) == 2
        assert not any(re.search(r"\bid#", below[i + 1]) for i in made)  # the columns that are shuffled
