"""Row-wise operators: predicates, text, engagement and target expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undertow import schemas


def map_value(column: Column, table: Mapping) -> Column:
    """Dictionary lookup as an expression; NULL when absent."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.create_map(*pairs)[column]


def in_list(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.filter(F.col(column).isin(list(values)))


def not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def dedupe(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Distinct rows, or one row per key."""
    return df.dropDuplicates(list(keys)) if keys else df.dropDuplicates()


def dedupe_report(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Row count, distinct count and number removed, counted without a row-wide sort."""
    groups = df.groupBy(*(keys or df.columns)).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.sum("_n").alias("rows"),
        F.count(F.lit(1)).alias("kept"),
        (F.sum("_n") - F.count(F.lit(1))).alias("removed"),
    )


def slug_map(df: DataFrame, column: str, slugs: Mapping[str, str], name: str = "slug") -> DataFrame:
    return df.withColumn(name, F.coalesce(map_value(F.col(column), slugs), F.lower(column)))


def label_sign(label: Column) -> Column:
    return F.when(label == "positive", 1).when(label == "neutral", 0).when(label == "negative", -1)


def compound(label: Column, score: Column) -> Column:
    """Signed confidence, clipped to [-1, 1]."""
    signed = label_sign(label) * score
    return F.when(signed.isNotNull(), F.greatest(F.least(signed, F.lit(1.0)), F.lit(-1.0)))


def compound_sentiment(df: DataFrame, *, label: str = "label", score: str = "score") -> DataFrame:
    return df.withColumn("sentiment_numeric", label_sign(F.col(label))).withColumn(
        "compound", compound(F.col(label), F.col(score))
    )


def compound_from_aggregate(df: DataFrame, *, pos: str, neg: str, threshold: float = 0.1) -> DataFrame:
    """Aggregated positive minus negative score, and the label it implies."""
    value = F.coalesce(F.col(pos), F.lit(0.0)) - F.coalesce(F.col(neg), F.lit(0.0))
    return df.withColumn("compound", value).withColumn(
        "label", F.when(value > threshold, "positive").when(value < -threshold, "negative").otherwise("neutral")
    )


def has_any(text: Column, words: Sequence[str]) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(words)), F.lit(False))


def keyword_flags(
    df: DataFrame,
    *,
    text: str,
    fear: Sequence[str] = schemas.FEAR_WORDS,
    greed: Sequence[str] = schemas.GREED_WORDS,
    uncertain: Sequence[str] = schemas.UNCERTAINTY_WORDS,
) -> DataFrame:
    """Does the text hold a fear, greed or uncertainty word (inside words too)?"""
    column = F.col(text)
    return df.select(
        "*",
        has_any(column, fear).alias("has_fear"),
        has_any(column, greed).alias("has_greed"),
        has_any(column, uncertain).alias("has_uncertain"),
    )


def emotion_scores(df: DataFrame, *, sign: str = "sentiment_numeric") -> DataFrame:
    """Sign of the sentiment together with the keyword flag."""
    s = F.col(sign)
    return df.select(
        "*",
        ((s == -1) & F.col("has_fear")).alias("fear"),
        ((s == 1) & F.col("has_greed")).alias("greed"),
        ((s == 1) & F.col("has_uncertain")).alias("fomo"),
    )


def emotion_scores_fallback(df: DataFrame, *, sign: str = "sentiment_numeric", score: str = "score") -> DataFrame:
    """Without text: strong negative, strong positive, lukewarm positive."""
    s, p = F.col(sign), F.col(score)
    return df.select(
        "*",
        ((s == -1) & (p > 0.8)).alias("fear"),
        ((s == 1) & (p > 0.8)).alias("greed"),
        ((s == 1) & (p < 0.7)).alias("fomo"),
    )


def _add(columns: Sequence[Column]) -> Column:
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    return total


def joined_text(title: str, body: str) -> Column:
    return F.lower(F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "), F.coalesce(F.col(body), F.lit(""))))


def lexicon_sentiment(
    df: DataFrame,
    *,
    title: str = "title",
    body: str = "body",
    positive: Sequence[str] = schemas.POSITIVE_WORDS,
    negative: Sequence[str] = schemas.NEGATIVE_WORDS,
) -> DataFrame:
    """Number of distinct words found decides label and score."""
    text = joined_text(title, body)
    pos = _add([text.contains(w).cast("int") for w in positive])
    neg = _add([text.contains(w).cast("int") for w in negative])
    counted = df.select("*", pos.alias("pos_words"), neg.alias("neg_words"))
    p, n = F.col("pos_words"), F.col("neg_words")
    return counted.select(
        "*",
        F.when(p > n, "positive").when(n > p, "negative").otherwise("neutral").alias("lexicon_label"),
        F.when(p > n, F.least(F.lit(1.0), p / 10)).when(n > p, F.greatest(F.lit(-1.0), -n / 10)).otherwise(0.0).alias(
            "lexicon_score"
        ),
    )


def mention_counts(
    df: DataFrame,
    *,
    title: str = "title",
    body: str = "body",
    bullish: Sequence[str] = schemas.BULLISH_WORDS,
    bearish: Sequence[str] = schemas.BEARISH_WORDS,
) -> DataFrame:
    """Occurrences of bullish and bearish words and their difference."""
    text = joined_text(title, body)
    up = _add([F.regexp_count(text, F.lit(w)) for w in bullish]).cast("long")
    down = _add([F.regexp_count(text, F.lit(w)) for w in bearish]).cast("long")
    return df.select("*", up.alias("bullish_mentions"), down.alias("bearish_mentions")).withColumn(
        "sentiment_polarity", F.col("bullish_mentions") - F.col("bearish_mentions")
    )


def text_length(df: DataFrame, *, title: str = "title", body: str = "body") -> DataFrame:
    return df.withColumn(
        "text_length", (F.length(F.coalesce(F.col(title), F.lit(""))) + F.length(F.coalesce(F.col(body), F.lit("")))).cast("long")
    )


def engagement_features(df: DataFrame) -> DataFrame:
    """Needs score, num_comments, text_length."""
    total = F.coalesce(F.col("score") + F.col("num_comments"), F.lit(0)).cast("double")
    return df.select(
        "*",
        total.alias("engagement_score"),
        F.when(F.col("score") > 0, F.col("num_comments") / F.col("score")).otherwise(0.0).alias("comment_rate"),
        F.when(F.col("text_length") > 0, total / F.log1p("text_length")).otherwise(0.0).alias("text_engagement"),
    )


def signed_log_score(df: DataFrame, *, score: str = "score", name: str = "sentiment_score") -> DataFrame:
    return df.withColumn(name, F.signum(F.col(score).cast("double")) * F.log1p(F.abs(score)) / 10)


def proxy_comment_rows(df: DataFrame, *, id: str = "id", count: str = "num_comments") -> DataFrame:
    """One stand-in comment per post."""
    return df.select(
        "*",
        F.concat(F.col(id).cast("string"), F.lit("_comment")).alias("comment_id"),
        F.greatest(F.lit(1), F.floor(F.col(count) / 10)).cast("long").alias("comment_score"),
    )


def time_features(df: DataFrame, *, ts: str = "ts") -> DataFrame:
    return df.select(
        "*",
        F.hour(ts).alias("hour_of_day"),
        F.weekday(ts).alias("day_of_week"),
        F.weekday(ts).isin(5, 6).cast("int").alias("is_weekend"),
    )


def ratio_score_features(df: DataFrame) -> DataFrame:
    """Ratio-weighted polarity, activity product and score product of a daily row."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return df.select(
        "*",
        (z("pos_ratio") * z("avg_pos_score") - z("neg_ratio") * z("avg_neg_score")).alias("weighted_sentiment"),
        (F.col("posts") * F.col("comments")).cast("double").alias("activity"),
        (F.col("avg_post_score") * F.col("avg_comment_score")).alias("score_product"),
    )


def fill_zero(df: DataFrame) -> DataFrame:
    return df.na.fill(0)


def _finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def finite_filter(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep rows whose columns are all finite numbers."""
    for c in columns:
        df = df.filter(_finite(c))
    return df


def inf_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(_finite(c), F.col(c)) for c in columns})


def numeric_columns(df: DataFrame, *, more_than: int = 0) -> DataFrame:
    """Numeric columns with more than so many values: (column_name, n_values)."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    counted = df.agg(*[F.count(c).alias(c) for c in names])
    return counted.unpivot([], names, "column_name", "n_values").filter(F.col("n_values") > more_than)


def direction_label(df: DataFrame, *, change: str, threshold: float = 0.001, name: str = "direction") -> DataFrame:
    """+1 / -1 beyond the threshold, else 0 (also when the change is unknown)."""
    x = F.col(change)
    return df.withColumn(name, F.when(x > threshold, 1).when(x < -threshold, -1).otherwise(0))


def binary_up(df: DataFrame, *, change: str, name: str = "up") -> DataFrame:
    return df.withColumn(name, F.coalesce((F.col(change) > 0).cast("int"), F.lit(0)))


# Feature registry: named column lists instead of matching column names by substring.
FEATURE_VIEWS = {
    "daily": ["pos_ratio", "neg_ratio", "avg_pos_score", "avg_neg_score", "posts", "comments"],
    "lineitem": ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
}


def select_feature_view(df: DataFrame, *, view: str, target: str) -> DataFrame:
    """Rows with a known target; features of the named view, NULL to 0."""
    names = FEATURE_VIEWS[view]
    return df.filter(F.col(target).isNotNull()).select(*names, target).na.fill(0, names)
