"""Grouped aggregates and data-quality summaries."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undertow.operators import blocks
from undertow.session import cut_lineage

LABELS = ["positive", "neutral", "negative"]


def _when(label: str, value: Column) -> Column:
    return F.when(F.col("label") == label, value)


def daily_sentiment(df: DataFrame) -> DataFrame:
    """Per community and day: distinct posts, comments, score and count per label, mean scores.

    Distinct posts come from a first level keyed by post, which also shrinks hot
    communities before the final shuffle.
    """
    per_post = df.groupBy("community", "day", "post_id").agg(
        F.count("comment_id").alias("comments"),
        *[F.sum(_when(x, F.col("score"))).alias(f"sum_{x}") for x in LABELS],
        *[F.count(_when(x, F.col("score"))).alias(f"scored_{x}") for x in LABELS],
        *[F.sum(_when(x, F.lit(1))).alias(f"n_{x}") for x in LABELS],
        F.sum("post_score").alias("sum_post"),
        F.count("post_score").alias("n_post"),
        F.sum("comment_score").alias("sum_comment"),
        F.count("comment_score").alias("n_comment"),
    )
    return per_post.groupBy("community", "day").agg(
        F.count("post_id").alias("posts"),
        F.sum("comments").alias("comments"),
        *[(F.sum(f"sum_{x}") / F.nullif(F.sum(f"scored_{x}"), F.lit(0))).alias(f"avg_{x[:3]}_score") for x in LABELS],
        *[F.coalesce(F.sum(f"n_{x}"), F.lit(0)).alias(f"{x}_count") for x in LABELS],
        (F.sum("sum_post") / F.nullif(F.sum("n_post"), F.lit(0))).alias("avg_post_score"),
        (F.sum("sum_comment") / F.nullif(F.sum("n_comment"), F.lit(0))).alias("avg_comment_score"),
    )


def daily_sentiment_ratio(df: DataFrame) -> DataFrame:
    """:func:`daily_sentiment` over known comments, labels as shares."""
    daily = daily_sentiment(df.filter("comment_id is not null"))
    return daily.select(
        "community", "day", "posts", "comments", "avg_pos_score", "avg_neg_score",
        *[(F.col(f"{x}_count") / F.col("comments")).alias(f"{x[:3]}_ratio") for x in LABELS],
        "avg_post_score", "avg_comment_score",
    )


# The measures of an hourly bar and their names.
HOURLY = {
    "score": ["sum", "mean", "std", "count"],
    "num_comments": ["sum", "mean"],
    "engagement_score": ["sum", "mean"],
    "sentiment_score": ["mean", "sum", "std"],
    "sentiment_polarity": ["sum", "mean"],
    "bullish_mentions": ["sum"],
    "bearish_mentions": ["sum"],
    "text_length": ["sum", "mean"],
    "upvote_ratio": ["mean"],
    "gilded": ["sum"],
    "total_awards_received": ["sum"],
}
_FUNCTIONS = {"sum": F.sum, "mean": F.avg, "std": F.stddev_samp, "count": F.count}
_NAMES = {
    "score_count": "post_count", "score_sum": "total_score", "score_mean": "avg_score", "score_std": "score_volatility",
}


def hourly_measures() -> list[Column]:
    """The aggregate columns of an hourly bar."""
    return [
        _FUNCTIONS[f](c).alias(_NAMES.get(f"{c}_{f}", f"{c}_{f}")) for c, functions in HOURLY.items() for f in functions
    ]


def hourly_activity(df: DataFrame) -> DataFrame:
    """Per community and hour: the measures of :data:`HOURLY`; unknown score spread is 0."""
    hourly = df.groupBy("community", F.date_trunc("hour", "ts").alias("hour")).agg(*hourly_measures())
    return hourly.withColumn("score_volatility", F.coalesce("score_volatility", F.lit(0.0)))


def daily_rollup(hourly: DataFrame) -> DataFrame:
    """Hourly bars to days: sums of sums, means of hourly means."""
    return hourly.groupBy("community", F.to_date("hour").alias("day")).agg(
        F.sum("post_count").alias("post_count"),
        F.sum("total_score").alias("total_score"),
        F.avg("avg_score").alias("avg_score"),
        F.avg("sentiment_score_mean").alias("sentiment_score_mean"),
        F.sum("num_comments_sum").alias("num_comments_sum"),
        F.avg("engagement_score_mean").alias("engagement_score_mean"),
        F.sum("sentiment_polarity_sum").alias("sentiment_polarity_sum"),
    )


def market_series(
    bars: DataFrame, *, ts: str, key: str, mean: Sequence[str] = (), first: Sequence[str] = (), total: Sequence[str] = ()
) -> DataFrame:
    """One row per time over all communities, gaps carried forward."""
    per_time = bars.groupBy(ts).agg(
        *[F.avg(c).alias(f"{c}_mean") for c in mean],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(key))).alias(f"{c}_first") for c in first],
        *[F.sum(c).alias(f"{c}_total") for c in total],
    )
    names = [c for c in per_time.columns if c != ts]
    filled = blocks.carry(per_time, [], [ts], {f"_f_{c}": c for c in names})
    return filled.select(ts, *[F.col(f"_f_{c}").alias(c) for c in names])


def label_breakdown(df: DataFrame) -> DataFrame:
    return df.groupBy("community", "day", "label").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("score").alias("avg_sentiment"),
        F.avg("comment_score").alias("avg_score"),
    )


def community_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("community").agg(
        F.count(F.lit(1)).alias("posts"),
        F.round(F.avg("score"), 2).alias("avg_score"),
        F.round(F.stddev_samp("score"), 2).alias("std_score"),
        F.round(F.avg("num_comments"), 2).alias("avg_comments"),
        F.sum("num_comments").alias("total_comments"),
    )


def label_distribution(df: DataFrame, *, label: str = "label") -> DataFrame:
    """Counts and shares; the window runs over the few label rows only."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def daily_post_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("community", "day").count().withColumnRenamed("count", "n")


def dq_timestamps(df: DataFrame, *, key: str = "community", ts: str = "ts", stored: str = "comment_id") -> DataFrame:
    """Per community: rows, repeated times, stored in time order?, gaps over a day, gap and span statistics."""
    rows = df.select(key, ts, stored)
    by_time = blocks.previous(rows, [key], [ts, stored], {"_before": ts}).withColumn(
        "gap", (F.unix_micros(ts) - F.unix_micros("_before")) / 60e6
    )
    by_stored = blocks.previous(rows, [key], [stored], {"_before": ts}).groupBy(key).agg(
        F.bool_and(F.coalesce(F.col(ts) >= F.col("_before"), F.lit(True))).cast("int").alias("monotonic")
    )
    stats = by_time.groupBy(key, ts).agg(
        F.count(F.lit(1)).alias("c"), F.count("gap").alias("g"), F.sum("gap").alias("gap_sum"),
        F.count_if(F.col("gap") > 1440).alias("long"),
    ).groupBy(key).agg(
        F.sum("c").alias("rows"),
        (F.sum("c") - F.count(F.lit(1))).alias("repeated"),
        F.sum("long").alias("long_gaps"),
        (F.sum("gap_sum") / F.sum("g")).alias("mean_gap"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        F.datediff(F.max(ts), F.min(ts)).alias("span_days"),
    )
    medians = blocks.quantiles(by_time, [key], "gap", {"median_gap": 0.5})
    return stats.join(medians, key).join(by_stored, key)


def dq_scores(df: DataFrame, *, score: str = "score") -> DataFrame:
    """One row: range, missing, moments, median, label counts, weak neutral rows."""
    x = F.col(score)
    row = df.agg(
        F.min(x).alias("min_score"),
        F.max(x).alias("max_score"),
        F.bool_and(x.between(0, 1)).cast("int").alias("in_range"),
        F.count_if(x.isNull()).alias("missing"),
        F.avg(x).alias("mean_score"),
        F.stddev_samp(x).alias("std_score"),
        F.skewness(x).alias("skew_score"),
        F.kurtosis(x).alias("kurt_score"),
        *[F.count_if(F.col("label") == v).alias(f"n_{v}") for v in LABELS],
        F.count_if((F.col("label") == "neutral") & (x < 0.6)).alias("weak_neutral"),
    )
    median = blocks.quantiles(df, [], score, {"m": 0.5})
    return row.withColumn("median_score", median.scalar())


def dq_coverage(df: DataFrame, *, key: str = "community", ts: str = "ts") -> DataFrame:
    """Per community coverage beside the spread of the counts over communities."""
    per = df.groupBy(key).agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n"),
        F.datediff(F.max(ts), F.min(ts)).alias("span_days"),
    )
    every = Window.partitionBy()
    return per.withColumns(
        {
            "min_n": F.min("n").over(every),
            "max_n": F.max("n").over(every),
            "median_n": F.median("n").over(every),
        }
    )


def gini(sizes: DataFrame, *, value: str) -> DataFrame:
    """Gini coefficient of a column of sizes, from counts of equal sizes."""
    tied = cut_lineage(sizes.groupBy(F.col(value).alias("x")).agg(F.count(F.lit(1)).alias("c")))
    cum = blocks.running(tied, [], ["x"], {"cum": F.col("c")}, blocks.value_block(tied, "x"))
    total = cum.agg(
        F.sum("c").alias("n"),
        F.sum(F.col("c") * F.col("x")).alias("sum_x"),
        F.sum(F.col("c") * F.col("x") * (2 * F.col("cum") - F.col("c"))).alias("ranked"),
    )
    return total.select(
        F.col("n").alias("groups"),
        ((F.col("ranked") - F.col("n") * F.col("sum_x")) / (F.col("n") * F.col("sum_x"))).alias("gini"),
    )


def completeness_score(df: DataFrame) -> DataFrame:
    """(share of known cells + 1) / 2."""
    known = sum((F.count(F.col(c)) for c in df.columns[1:]), F.count(F.col(df.columns[0])))
    cells = F.count(F.lit(1)) * len(df.columns)
    return df.agg(known.alias("known"), cells.alias("cells")).select(
        "known", "cells", ((F.col("known") / F.col("cells") + 1) / 2).alias("completeness")
    )


def dataset_profile(df: DataFrame, *, key: str, ts: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.countDistinct(key).alias("communities"),
        F.datediff(F.max(ts), F.min(ts)).alias("range_days"),
    )


def series_stats(df: DataFrame, *, key: str, value: str) -> DataFrame:
    stats = df.groupBy(key).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    return stats.withColumn("cv", F.col("std") / F.nullif("mean", F.lit(0.0)))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson matrix of the listed columns in one pass: (a, b, corr), both directions and the diagonal."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = row.unpivot([], [f"`{a}|{b}`" for a, b in pairs], "pair", "corr")
    parts = F.split("pair", r"\|")
    half = long.select(parts[0].alias("a"), parts[1].alias("b"), "corr")
    both = half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr"))
    return both.filter(F.col("corr").isNotNull())


def max_cross_correlation(matrix: DataFrame, *, limit: float = 0.9) -> DataFrame:
    return matrix.filter("a <> b").agg(F.max(F.abs("corr")).alias("max_abs_corr")).withColumn(
        "independent", (F.col("max_abs_corr") < limit).cast("int")
    )


def count_distinct(df: DataFrame, *, value: str, by: Sequence[str] = (), approximate: bool = False) -> DataFrame:
    """Distinct count, exact in two levels or as a sketch."""
    if approximate:
        return df.groupBy(*by).agg(F.approx_count_distinct(value).alias("n_distinct"))
    return df.groupBy(*by, value).agg(F.lit(1)).groupBy(*by).agg(F.count(value).alias("n_distinct"))


def distinct_sketches(df: DataFrame, *, value: str, by: Sequence[str], bits: int = 14) -> DataFrame:
    """A sketch of the distinct values of every group, to be stored: 2^bits registers, whatever the number of values.

    The estimate of a group, or of any union of groups, has a relative standard error of about 1.04 / 2^(bits / 2)
    (0.8 % for 14 bits).  NULL is no value; a group without values has an empty sketch.
    """
    return df.groupBy(*by).agg(F.hll_sketch_agg(F.col(value).cast("string"), F.lit(bits)).alias("sketch"))


def rolled_distinct(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Estimated distinct values of coarser groups from stored sketches alone; values that groups share count once."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_estimated"))


def quantile_flag_score(
    df: DataFrame,
    *,
    high: tuple[str, float, float] = ("score", 0.8, 0.3),
    busy: tuple[str, float, float] = ("num_comments", 0.7, 0.3),
    strong: tuple[str, float, float] = ("upvote_ratio", 0.9, 0.2),
    members: tuple[str, tuple[str, ...], float] = ("community", ("click", "view"), 0.2),
) -> DataFrame:
    """Weighted sum of flags: two against table quantiles, one against a level, one by membership."""
    cuts = [blocks.quantiles(df, [], c, {"q": p}).scalar() for c, p, _ in (high, busy)]
    flags = [
        (F.col(high[0]) > cuts[0], high[2]),
        (F.col(busy[0]) > cuts[1], busy[2]),
        (F.abs(strong[0]) > strong[1], strong[2]),
        (F.col(members[0]).isin(*members[1]), members[2]),
    ]
    total = sum((F.coalesce(flag.cast("int"), F.lit(0)) * weight for flag, weight in flags[1:]), F.coalesce(flags[0][0].cast("int"), F.lit(0)) * flags[0][1])
    return df.withColumn("flag_score", total)
