"""Grouped aggregates and data-quality summaries as checked queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from undertow.functions import scalars
from undertow.operators import aggregate
from undertow.plans.registry import R, query, r, rounded
from undertow.session import match, shared_folder
from undertow.sources import sinks
from undertow.sources.tables import BARS, COMMENTS, POSTS, PRICES

DAILY = """SELECT community, day, count(DISTINCT post_id)::BIGINT AS posts, count(comment_id)::BIGINT AS comments, {avgs}, {counts},
  {aps} AS avg_post_score, {acs} AS avg_comment_score FROM comments GROUP BY 1, 2"""
LABELS = aggregate.LABELS


def avg_label(label, digits=6):
    return R(f"avg(score) FILTER (label = '{label}')", digits) + f" AS avg_{label[:3]}_score"


@query(
    "daily_sentiment",
    f"WITH {COMMENTS} "
    + DAILY.format(
        avgs=", ".join(avg_label(x, 10) for x in LABELS),
        counts=", ".join(f"count(*) FILTER (label = '{x}')::BIGINT AS {x}_count" for x in LABELS),
        aps=R("avg(post_score)", 10),
        acs=R("avg(comment_score)", 10),
    ),
)
def _(t):
    return rounded(aggregate.daily_sentiment(t.comments), 10)


@query(
    "daily_sentiment_ratio",
    f"WITH {COMMENTS} "
    + DAILY.format(
        avgs=", ".join(avg_label(x, 10) for x in ("positive", "negative")),
        counts=", ".join(R(f"count(*) FILTER (label = '{x}') / count(*)", 10) + f" AS {x[:3]}_ratio" for x in LABELS),
        aps=R("avg(post_score)", 10),
        acs=R("avg(comment_score)", 10),
    ),
)
def _(t):
    return rounded(aggregate.daily_sentiment_ratio(t.comments), 10)


UP, DOWN = ["1", "22"], ["3", "k"]


def count_words(words):
    return " + ".join(f"(length(x) - length(replace(x, '{w}', ''))) // {len(w)}" for w in words)


def activity_rows(t):
    """Timed posts with every measure of an hourly bar."""
    p = scalars.text_length(t.posts)
    p = scalars.signed_log_score(scalars.engagement_features(p))
    return scalars.mention_counts(p, bullish=UP, bearish=DOWN)


ACTIVITY = f"""{POSTS}, x AS (SELECT *, lower(title || ' ' || body) AS x FROM posts), activity AS (
  SELECT *, (score + num_comments)::DOUBLE AS engagement_score, sign(score) * ln(1 + abs(score)) / 10 AS sentiment_score,
  ({count_words(UP)}) AS bullish_mentions, ({count_words(DOWN)}) AS bearish_mentions,
  ({count_words(UP)}) - ({count_words(DOWN)}) AS sentiment_polarity, length(title) + length(body) AS text_length FROM x)"""


def hourly_sql(source="activity", group="community, date_trunc('hour', ts) AS hour", by="1, 2", digits=6):
    cells = []
    sql = {"sum": "sum", "mean": "avg", "std": "stddev_samp", "count": "count"}
    exact = {c for c in aggregate.HOURLY if c not in ("engagement_score", "sentiment_score", "upvote_ratio")}
    for c, functions in aggregate.HOURLY.items():
        for f in functions:
            name = aggregate._NAMES.get(f"{c}_{f}", f"{c}_{f}")
            e = f"{sql[f]}({c})"
            if name == "score_volatility":
                e = f"coalesce({e}, 0)"
            if f == "count" or (f == "sum" and c in exact):
                cells.append(f"({e})::BIGINT AS {name}")
            else:
                cells.append(f"{R(e, 10 if name == 'upvote_ratio_mean' else digits)} AS {name}")
    return f"SELECT {group}, {', '.join(cells)} FROM {source} GROUP BY {by}"


def round_hourly(df):
    doubles = {f.name for f in df.schema.fields if f.dataType.typeName() == "double"}
    return df.select(*[r(c, 10 if c == "upvote_ratio_mean" else 6).alias(c) if c in doubles else F.col(c) for c in df.columns])


@query("hourly_activity", f"WITH {ACTIVITY} " + hourly_sql())
def _(t):
    return round_hourly(aggregate.hourly_activity(activity_rows(t)))


@query(
    "daily_rollup",
    f"WITH {ACTIVITY}, h AS (" + hourly_sql(digits=12) + f""") SELECT community, hour::DATE AS day, sum(post_count)::BIGINT AS post_count, sum(total_score)::BIGINT AS total_score,
    {R('avg(avg_score)')} AS avg_score, {R('avg(sentiment_score_mean)')} AS sentiment_score_mean, sum(num_comments_sum)::BIGINT AS num_comments_sum,
    {R('avg(engagement_score_mean)')} AS engagement_score_mean, sum(sentiment_polarity_sum)::BIGINT AS sentiment_polarity_sum FROM h GROUP BY 1, 2""",
)
def _(t):
    return rounded(aggregate.daily_rollup(aggregate.hourly_activity(activity_rows(t))))


@query(
    "market_series",
    f"""WITH {BARS}, s AS (SELECT ts, avg(value) AS m, arg_min(volume, community) AS f, sum(CASE WHEN community = 'purchase' THEN n END) AS s FROM bars GROUP BY 1)
    SELECT ts, {R("last_value(m IGNORE NULLS) OVER w", 10)} AS value_mean, last_value(f IGNORE NULLS) OVER w AS volume_first, (last_value(s IGNORE NULLS) OVER w)::BIGINT AS buys_total
    FROM s WINDOW w AS (ORDER BY ts)""",
)
def _(t):
    b = t.bars.withColumn("buys", F.when(F.col("community") == "purchase", F.col("n")))
    return rounded(aggregate.market_series(b, ts="ts", key="community", mean=["value"], first=["volume"], total=["buys"]), 10)


@query(
    "label_breakdown",
    f"""WITH {COMMENTS} SELECT community, day, label, count(*)::BIGINT AS n, {R('avg(score)', 10)} AS avg_sentiment, {R('avg(comment_score)', 10)} AS avg_score FROM comments GROUP BY 1, 2, 3""",
)
def _(t):
    return rounded(aggregate.label_breakdown(t.comments), 10)


@query(
    "community_summary",
    f"""WITH {POSTS} SELECT community, count(*)::BIGINT AS posts, {R('avg(score)', 2)} AS avg_score, {R('stddev_samp(score)', 2)} AS std_score,
    {R('avg(num_comments)', 2)} AS avg_comments, sum(num_comments)::BIGINT AS total_comments FROM posts GROUP BY 1""",
)
def _(t):
    return rounded(aggregate.community_summary(t.posts), 2)


@query(
    "label_distribution",
    f"WITH {COMMENTS} SELECT label, count(*)::BIGINT AS n, {R('count(*) / sum(count(*)) OVER ()')} AS share FROM comments GROUP BY 1",
)
def _(t):
    return rounded(aggregate.label_distribution(t.comments))


@query("daily_post_counts", f"WITH {COMMENTS} SELECT community, day, count(*)::BIGINT AS n FROM comments GROUP BY 1, 2")
def _(t):
    return aggregate.daily_post_counts(t.comments)


@query(
    "dq_timestamps",
    f"""WITH {COMMENTS}, g AS (SELECT community, ts, comment_id, epoch_us(ts - lag(ts) OVER (PARTITION BY community ORDER BY ts, comment_id)) / 60e6::DOUBLE AS gap,
      coalesce(ts >= lag(ts) OVER (PARTITION BY community ORDER BY comment_id), true) AS up FROM comments)
    SELECT community, count(*)::BIGINT AS rows, (count(*) - count(DISTINCT ts))::BIGINT AS repeated, count(*) FILTER (gap > 1440)::BIGINT AS long_gaps,
    {R('avg(gap)', 4)} AS mean_gap, min(ts) AS first_ts, max(ts) AS last_ts, date_diff('day', min(ts)::DATE, max(ts)::DATE)::INT AS span_days,
    {R('quantile_cont(gap, 0.5)', 4)} AS median_gap, bool_and(up)::INT AS monotonic FROM g GROUP BY 1""",
)
def _(t):
    return rounded(aggregate.dq_timestamps(t.comments), 4)


@query(
    "dq_scores",
    f"""WITH {COMMENTS} SELECT {R('min(score)')} AS min_score, {R('max(score)')} AS max_score, bool_and(score BETWEEN 0 AND 1)::INT AS in_range,
    count(*) FILTER (score IS NULL)::BIGINT AS missing, {R('avg(score)')} AS mean_score, {R('stddev_samp(score)')} AS std_score,
    {R('skewness(score) * (count(*) - 2) / sqrt(count(*)::DOUBLE * (count(*) - 1))', 5)} AS skew_score, {R('kurtosis_pop(score)', 5)} AS kurt_score,
    {', '.join(f"count(*) FILTER (label = '{x}')::BIGINT AS n_{x}" for x in LABELS)},
    count(*) FILTER (label = 'neutral' AND score < 0.6)::BIGINT AS weak_neutral, {R('median(score)')} AS median_score FROM comments""",
)
def _(t):
    d = aggregate.dq_scores(t.comments)
    return d.select(*[r(c, 5).alias(c) if c in ("skew_score", "kurt_score") else (r(c).alias(c) if c.endswith("_score") else F.col(c)) for c in d.columns])


@query(
    "dq_coverage",
    f"""WITH {COMMENTS}, c AS (SELECT community, min(ts) AS first_ts, max(ts) AS last_ts, count(*)::BIGINT AS n, date_diff('day', min(ts)::DATE, max(ts)::DATE)::INT AS span_days FROM comments GROUP BY 1)
    SELECT *, min(n) OVER () AS min_n, max(n) OVER () AS max_n, (SELECT median(n) FROM c)::DOUBLE AS median_n FROM c""",
)
def _(t):
    return aggregate.dq_coverage(t.comments)


@query(
    "gini_balance",
    f"""WITH c AS (SELECT user_id, count(*) AS x FROM events GROUP BY 1), o AS (SELECT x, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS n FROM c)
    SELECT max(n)::BIGINT AS groups, {R('sum((2 * i - n - 1) * x) / (max(n) * sum(x))')} AS gini FROM o""",
)
def _(t):
    sizes = t.raw("events").groupBy("user_id").agg(F.count("*").alias("x"))
    return rounded(aggregate.gini(sizes, value="x"))


@query(
    "completeness_score",
    f"""WITH d AS (SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)), k AS (SELECT count(doc_id) + count(quality) + count(toxic) AS known, 3 * count(*) AS cells FROM d)
    SELECT known::BIGINT AS known, cells::BIGINT AS cells, {R('(known / cells + 1) / 2')} AS completeness FROM k""",
)
def _(t):
    d = t.raw("documents").select("doc_id").join(t.raw("labels"), "doc_id", "left")
    return rounded(aggregate.completeness_score(d))


@query(
    "dataset_profile",
    f"WITH {COMMENTS} SELECT count(*)::BIGINT AS rows, 9 AS columns, count(DISTINCT community)::BIGINT AS communities, date_diff('day', min(day), max(day))::INT AS range_days FROM comments",
)
def _(t):
    return aggregate.dataset_profile(t.comments, key="community", ts="day")


@query(
    "series_stats",
    f"""WITH {PRICES} SELECT symbol, {R('avg(price)', 4)} AS mean, {R('stddev_samp(price)', 4)} AS std, {R('min(price)', 4)} AS min, {R('max(price)', 4)} AS max, {R('stddev_samp(price) / avg(price)', 4)} AS cv FROM prices GROUP BY 1""",
)
def _(t):
    return rounded(aggregate.series_stats(t.prices, key="symbol", value="price"), 4)


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
MATRIX = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS c FROM lineitem" for a in NUMERIC for b in NUMERIC if a != b)


@query("correlation_matrix", f"SELECT a, b, {R('c')} AS corr FROM ({MATRIX})")
def _(t):
    return rounded(aggregate.correlation_matrix(t.raw("lineitem"), NUMERIC))


@query(
    "max_cross_correlation",
    f"SELECT {R('max(abs(c))')} AS max_abs_corr, (max(abs(c)) < 0.9)::INT AS independent FROM ({MATRIX})",
)
def _(t):
    return rounded(aggregate.max_cross_correlation(aggregate.correlation_matrix(t.raw("lineitem"), NUMERIC)))


@query(
    "sentiment_price_correlation",
    f"""WITH {COMMENTS}, {PRICES}, d AS (SELECT community, day, avg(score) FILTER (label = 'positive') AS p FROM comments GROUP BY 1, 2)
    SELECT community, symbol, count(p)::BIGINT AS n, {R('corr(p, price)')} AS corr FROM d JOIN prices USING (day) GROUP BY 1, 2""",
)
def _(t):
    d = aggregate.daily_sentiment(t.comments).select("community", "day", "avg_pos_score")
    j = d.join(t.prices, "day").groupBy("community", "symbol")
    return rounded(j.agg(F.count("avg_pos_score").alias("n"), F.corr("avg_pos_score", "price").alias("corr")))


@query("count_distinct_ids", "SELECT event_type AS community, count(DISTINCT user_id)::BIGINT AS n_distinct FROM events GROUP BY 1")
def _(t):
    return aggregate.count_distinct(t.comments, value="post_id", by=["community"])


@query(
    "distinct_rollup",
    """WITH e AS (SELECT event_type AS community, user_id FROM events)
    SELECT community, count(DISTINCT user_id)::BIGINT AS n_distinct, true AS within_5_percent FROM e GROUP BY 1
    UNION ALL SELECT '(all)', count(DISTINCT user_id)::BIGINT, true FROM e""",
)
def _(t):
    """Sketches stored per community and day, rolled up to communities and to everything, beside the exact counts."""
    path = f"{shared_folder(t.spark)}/undertow-sketches-{uuid.uuid4().hex}"
    sinks.sink_truncate(aggregate.distinct_sketches(t.comments, value="post_id", by=["community", "day"]), path)
    stored = t.spark.read.parquet(path)
    named = F.lit("(all)").alias("community")
    exact = aggregate.count_distinct(t.comments, value="post_id", by=["community"]).unionByName(
        aggregate.count_distinct(t.comments, value="post_id").select(named, "n_distinct")
    )
    guess = aggregate.rolled_distinct(stored, ["community"]).unionByName(aggregate.rolled_distinct(stored).select(named, "n_estimated"))
    both = match(exact, guess, ["community"])
    near = F.abs(F.col("n_estimated") - F.col("n_distinct")) * 20 <= F.col("n_distinct")
    return both.select("community", "n_distinct", near.alias("within_5_percent"))
