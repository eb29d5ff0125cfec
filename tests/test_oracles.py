"""A sample of the registered queries beside their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from undertow.plans import catalog

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "flagship_panel", "explode_comments", "sample_head_per_file", "lexicon_sentiment", "mention_counts", "daily_sentiment", "hourly_activity",
    "dq_timestamps", "gini_balance", "asof_join_nearest", "asof_join_backward", "rolling_stats_rows", "rolling_stats_time", "var_panel", "fevd",
    "granger_pairwise", "lagged_corr_score", "spill_table", "weighted_clustering", "backtest_compounding", "performance_report", "adf_test",
    "variance_break_bootstrap", "wilcoxon_signed_rank", "stratified_split_exact", "binary_auc",
]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="stored tables are not here")


def text(value):
    if isinstance(value, float):
        return f"{value:.4g}"
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(text(row[i]) for i in order) for row in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    got = rows_of(df.columns, df.collect())
    cursor = duck.execute(catalog.ORACLES[name])
    want = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    differing = sum(a != b for a, b in zip(got[1], want[1]))
    assert differing <= len(want[1]) // 200, (got[1][:3], want[1][:3])


def test_every_check_belongs_to_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert len(catalog.QUERIES) > 190
