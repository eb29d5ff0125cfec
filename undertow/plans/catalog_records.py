"""Scans, sinks and row-wise operators as checked queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from undertow import schemas
from undertow.functions import scalars
from undertow.operators import aggregate, features
from undertow.plans.registry import R, query, r, rounded
from undertow.session import shared_folder
from undertow.sources import readers, sinks
from undertow.sources.tables import ARTICLES, COMMENTS, FLOWS, POSTS, PRICES

# Word lists that occur in the stored texts (the default lists hardly do).
POS, NEG, SURE = ["up", "great", "the"], ["hate", "sell", "worthless"], ["maybe", "ent", "doubt"]

FIRST, LAST = "2024-01-05", "2024-01-20"


def nested(t):
    """Posts as JSON text, one nested comment per line of the text."""
    lines = F.when(F.length("body") > 0, F.split("body", "\n"))
    comments = F.transform(
        lines,
        lambda line, i: F.struct(
            F.concat_ws("-", F.col("id").cast("string"), i.cast("string")).alias("id"),
            F.lit("a").alias("author"),
            line.alias("body"),
            i.cast("long").alias("score"),
            (F.col("id") * 60 + i).alias("created_utc"),
            F.struct(
                F.when(F.length(line) % 3 == 0, "positive").when(F.length(line) % 3 == 1, "negative").otherwise("neutral").alias("label"),
                (F.length(line) % 10 / 10).alias("score"),
            ).alias("sentiment"),
        ),
    )
    return t.articles.select(
        "community", "id",
        F.to_json(
            F.struct(
                F.col("community").alias("subreddit"), F.col("id").cast("string").alias("id"), "title", "score",
                (F.col("id") * 60).alias("created_utc"), "num_comments", comments.alias("comments"),
                F.timestamp_seconds(F.col("id") * 60).cast("string").alias("created_at"),
            )
        ).alias("json")
    )


BATCHES, SPAN = 20, 100_000  # every SPAN ids of a community are BATCHES files of at most 5,000 posts; the last of each is cut, so that it is no JSON


def array_files(df, name, id, json):
    """JSON arrays ``<name>_batch_N.json`` in the shared folder; rows of one batch are one array, as a crawler leaves them."""
    number = F.col(id) % BATCHES + F.floor(F.col(id) / SPAN) * BATCHES
    rows = df.select(F.concat(F.col(name), F.lit("_batch_"), number.cast("string"), F.lit(".json")).alias("file"), number.alias("_n"), F.col(json).alias("_json"))
    arrays = rows.groupBy("file", "_n").agg(F.concat(F.lit("["), F.array_join(F.collect_list("_json"), ","), F.lit("]")).alias("value"))
    cut = F.when(F.col("_n") % BATCHES == BATCHES - 1, F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    folder = f"{shared_folder(df.sparkSession)}/arrays-{uuid.uuid4().hex}"
    arrays.select("file", cut.alias("value")).write.partitionBy("file").text(folder)
    return folder


@query(
    "scan_nested_posts",
    f"""WITH {ARTICLES} SELECT community AS subreddit, id::VARCHAR AS id, score::BIGINT AS score,
    to_timestamp(id * 60)::TIMESTAMP AS created, num_comments::BIGINT AS num_comments,
    CASE WHEN length(body) > 0 THEN len(string_split(body, chr(10))) ELSE 0 END::BIGINT AS n_nested, community || '_batch_' || (id % 20 + id // 100000 * 20) || '.json' AS batch_file
    FROM articles WHERE id % 20 <> 19""",
)
def _(t):
    p = readers.scan_nested_posts(t.spark, array_files(nested(t), "community", "id", "json"))
    return p.select(
        "batch_file", "subreddit", "id", "score", F.timestamp_seconds("created_utc").alias("created"), "num_comments",
        F.coalesce(F.size("comments"), F.lit(0)).cast("long").alias("n_nested"),
    )


@query(
    "explode_comments",
    f"""WITH {ARTICLES}, lines AS (SELECT community, id, CASE WHEN length(body) > 0 THEN string_split(body, chr(10)) ELSE [NULL] END AS l FROM articles),
    e AS (SELECT community, id, unnest(l) AS body, unnest(range(0, len(l))) AS i FROM lines)
    SELECT community AS subreddit, id::VARCHAR AS post_id, CASE WHEN body IS NOT NULL THEN id::VARCHAR || '-' || i END AS comment_id,
    body AS comment_body, CASE WHEN body IS NOT NULL THEN to_timestamp(id * 60 + i)::TIMESTAMP END AS comment_created_utc,
    CASE WHEN body IS NULL THEN NULL WHEN length(body) % 3 = 0 THEN 'positive' WHEN length(body) % 3 = 1 THEN 'negative' ELSE 'neutral' END AS sentiment_label,
    {R("length(body) % 10 / 10.0")} AS sentiment_score, to_timestamp(id * 60)::TIMESTAMP AS post_created_at, NULL::TIMESTAMP AS comment_created_at FROM e""",
)
def _(t):
    e = readers.explode_comments(readers.parse_nested_posts(nested(t)))
    return e.select(
        "post_created_at", "comment_created_at", "subreddit", "post_id", "comment_id", "comment_body", "comment_created_utc", "sentiment_label",
        r("sentiment_score").alias("sentiment_score"),
    )


def flat_files(t):
    post = F.struct(
        F.col("event_id").cast("string").alias("id"),
        F.when(F.col("event_id") % 7 != 0, F.unix_seconds(F.col("ts").cast("timestamp"))).cast("double").alias("created_utc"),
        F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("title"),
        F.when(F.col("event_id") % 5 != 0, F.col("user_id")).alias("score"),
    )
    return array_files(t.raw("events").select("event_type", "event_id", F.to_json(post).alias("json")), "event_type", "event_id", "json")


@query(
    "scan_flat_posts",
    """SELECT event_id::VARCHAR AS id, event_type AS community, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS title, '' AS selftext,
    CASE WHEN event_id % 5 = 0 THEN 0 ELSE user_id END::BIGINT AS score, 0::BIGINT AS gilded, 0::BIGINT AS all_awardings_count, false AS is_original_content,
    0.5::DOUBLE AS upvote_ratio, date_trunc('second', ts) AS ts FROM events WHERE event_id % 7 <> 0 AND event_id % 20 <> 19""",
)
def _(t):
    posts = readers.scan_flat_posts(t.spark, flat_files(t))
    return posts.select("id", "community", "title", "selftext", "score", "gilded", "all_awardings_count", "is_original_content", "upvote_ratio", "ts")


@query("unreadable_files", "SELECT DISTINCT event_type || '_batch_' || (event_id % 20 + event_id // 100000 * 20) || '.json' AS file, 1::BIGINT AS files FROM events WHERE event_id % 20 = 19")
def _(t):
    bad = readers.unreadable_files(readers.scan_arrays(t.spark, flat_files(t), schemas.FLAT_POST))
    return bad.groupBy("file").agg(F.count(F.lit(1)).alias("files"))


@query(
    "epoch_to_ts",
    "SELECT event_id, date_trunc('second', ts) AS at FROM events WHERE event_type <> 'error'",
)
def _(t):
    e = t.raw("events")
    text = F.when(F.col("event_type") == "error", "n/a").otherwise(F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"))
    return readers.epoch_to_ts(e.select("event_id", text.alias("created_utc")), name="at").select("event_id", "at").orderBy("at")


SYMBOL_FILES = {"1-URGENT": "URG", "2-HIGH": "HIG", "3-MEDIUM": "MED", "5-LOW": "LOW"}
SYMBOL_NAMES = {"URG": "Urgent", "HIG": "High", "MED": "Medium"}


@query(
    "scan_prices_csv",
    f"""WITH {PRICES} SELECT upper(string_split(lower(symbol), '-')[1] || 'x') AS symbol, day, {R("price")} AS price, total_volume::BIGINT AS total_volume FROM prices""",
)
def _(t):
    line = F.concat_ws(",", F.col("day").cast("string"), F.col("price").cast("string"), F.col("market_cap").cast("string"), F.col("total_volume").cast("string"))
    file = F.concat(F.split(F.lower("symbol"), "-")[0], F.lit("x-usd-max.csv"))
    folder = f"{shared_folder(t.spark)}/prices-{uuid.uuid4().hex}"
    head = t.prices.select(file.alias("file")).distinct().select("file", F.lit("snapped_at,price,market_cap,total_volume").alias("value"), F.lit(0).alias("_k"))
    lines = head.unionByName(t.prices.select(file.alias("file"), line.alias("value"), F.lit(1).alias("_k")))
    lines.repartition("file").sortWithinPartitions("file", "_k").drop("_k").write.partitionBy("file").text(folder)
    prices = readers.scan_prices_csv(t.spark, folder)
    return prices.select("symbol", F.to_date("snapped_at").alias("day"), r("price").alias("price"), F.col("total_volume").cast("long").alias("total_volume"))


@query(
    "normalize_prices",
    f"""WITH {PRICES}, n AS (SELECT CASE symbol WHEN '1-URGENT' THEN 'URG' WHEN '2-HIGH' THEN 'HIG' WHEN '3-MEDIUM' THEN 'MED' WHEN '5-LOW' THEN 'LOW' END AS symbol,
    day, price, CASE WHEN total_volume > 3 THEN NULL ELSE total_volume END AS v FROM prices)
    SELECT symbol, CASE symbol WHEN 'URG' THEN 'Urgent' WHEN 'HIG' THEN 'High' WHEN 'MED' THEN 'Medium' ELSE symbol END AS name,
    day::TIMESTAMP AS snapped_at, {R("price")} AS price, coalesce(v, 0)::DOUBLE AS total_volume
    FROM n WHERE symbol IS NOT NULL AND day BETWEEN DATE '2024-01-01' AND DATE '2026-12-31'""",
)
def _(t):
    raw = t.prices.select(
        "symbol", F.col("day").cast("timestamp").alias("snapped_at"), "price", "market_cap",
        F.when(F.col("total_volume") <= 3, F.col("total_volume")).alias("total_volume"),
    )
    n = readers.normalize_prices(
        raw, symbols=SYMBOL_FILES, names=SYMBOL_NAMES, key="symbol", first="2024-01-01", last="2026-12-31"
    )
    return n.select("symbol", "name", "snapped_at", r("price").alias("price"), "total_volume").orderBy("symbol", "snapped_at")


def scratch(t, name: str) -> str:
    return f"{shared_folder(t.spark)}/undertow-{name}-{uuid.uuid4().hex}"


@query(
    "sink_append",
    f"WITH {PRICES} SELECT symbol, day, total_volume::BIGINT AS total_volume, CASE WHEN symbol < '3' THEN total_volume * 2 END::BIGINT AS extra FROM prices",
)
def _(t):
    path = scratch(t, "append")
    p = t.prices.select("symbol", "day", "total_volume")
    sinks.sink_append(p.filter("symbol >= '3'"), path, "symbol")
    sinks.sink_append(p.filter("symbol < '3'").withColumn("extra", F.col("total_volume") * 2), path, "symbol")
    return sinks.read_merged(t.spark, path).select("symbol", "day", "total_volume", "extra")


@query("sink_truncate", f"WITH {PRICES} SELECT symbol, day, total_volume::BIGINT AS total_volume FROM prices")
def _(t):
    path = scratch(t, "truncate")
    p = t.prices.select("symbol", "day", "total_volume")
    sinks.sink_truncate(p.filter("total_volume > 1"), path)
    sinks.sink_truncate(p, path)
    return t.spark.read.parquet(path)


@query(
    "sink_feature_parquet",
    f"WITH {COMMENTS} SELECT community, day, count(*)::BIGINT AS n, {R('avg(score)')} AS mean FROM comments GROUP BY 1, 2",
)
def _(t):
    path = scratch(t, "features")
    sinks.sink_feature_parquet(t.comments.groupBy("community", "day").agg(F.count("*").alias("n"), r(F.avg("score")).alias("mean")), path)
    return t.spark.read.parquet(path)


@query(
    "sink_split_csv",
    """SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 10 < 6 THEN 'train' WHEN o_orderkey % 10 < 8 THEN 'val' ELSE 'test' END AS split FROM orders""",
)
def _(t):
    path = scratch(t, "split")
    m = F.col("o_orderkey") % 10
    o = t.raw("orders").select("o_orderkey", "o_orderstatus", F.when(m < 6, "train").when(m < 8, "val").otherwise("test").alias("split"))
    sinks.sink_split_csv(o, path)
    return t.spark.read.option("header", True).schema("o_orderkey long, o_orderstatus string, split string").csv(f"{path}/data")


@query(
    "sink_network",
    f"""WITH {FLOWS} SELECT 'edge' AS part, src, dst, {R('weight', 2)} AS weight FROM edges
    UNION ALL SELECT 'node', n, NULL, count(*)::DOUBLE FROM (SELECT src AS n FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 2""",
)
def _(t):
    path = scratch(t, "network")
    ends = t.flows.select(F.col("src").alias("n")).unionAll(t.flows.select("dst"))
    sinks.sink_network(ends.groupBy("n").agg(F.count(F.lit(1)).cast("double").alias("weight")), t.flows, path)
    nodes = t.spark.read.parquet(f"{path}/nodes").select(F.lit("node").alias("part"), F.col("n").alias("src"), F.lit(None).cast("string").alias("dst"), "weight")
    edges = t.spark.read.parquet(f"{path}/edges").select(F.lit("edge").alias("part"), "src", "dst", r("weight", 2).alias("weight"))
    return edges.unionByName(nodes)


@query(
    "sink_results_tables",
    f"""WITH {PRICES} SELECT 'levels' AS result, symbol, {R('avg(price)')} AS value FROM prices GROUP BY 2
    UNION ALL SELECT 'volumes', symbol, sum(total_volume)::DOUBLE FROM prices GROUP BY 2""",
)
def _(t):
    path = scratch(t, "results")
    by = t.prices.groupBy("symbol")
    sinks.sink_results_tables({"levels": by.agg(r(F.avg("price")).alias("value")), "volumes": by.agg(F.sum("total_volume").cast("double").alias("value"))}, path)
    parts = [t.spark.read.parquet(f"{path}/{name}").select("result", "symbol", "value") for name in ("levels", "volumes")]
    return parts[0].unionByName(parts[1])


@query(
    "scan_events_range",
    f"WITH {COMMENTS} SELECT community, comment_id, ts FROM comments WHERE day BETWEEN DATE '{FIRST}' AND DATE '{LAST}'",
)
def _(t):
    return readers.scan_range(t.comments_in(FIRST, LAST), "day", FIRST, LAST).select("community", "comment_id", "ts").orderBy("ts")


@query(
    "scan_comments_range",
    f"""WITH {COMMENTS} SELECT community, comment_id, ts, label AS sentiment_label, {R('score')} AS sentiment_score, post_score AS score
    FROM comments WHERE comment_id IS NOT NULL AND day BETWEEN DATE '{FIRST}' AND DATE '{LAST}'""",
)
def _(t):
    return rounded(readers.scan_comments_range(t.comments_in(FIRST, LAST), FIRST, LAST))


@query(
    "sample_head_per_file",
    """SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 10""",
)
def _(t):
    return readers.sample_head_per_file(t.raw("documents").select("source", "doc_id", "n_chars"), "source", "doc_id", 10)


@query(
    "date_range_filter",
    f"""WITH {COMMENTS} SELECT 'both' AS bounds, count(*)::BIGINT AS n FROM comments WHERE day BETWEEN DATE '{FIRST}' AND DATE '{LAST}'
    UNION ALL SELECT 'first', count(*) FROM comments WHERE day >= DATE '{FIRST}' UNION ALL SELECT 'last', count(*) FROM comments WHERE day <= DATE '{LAST}'""",
)
def _(t):
    def counted(name, first, last):
        return readers.scan_range(t.comments_in(first, last), "day", first, last).agg(F.count("*").alias("n")).select(F.lit(name).alias("bounds"), "n")

    return counted("both", FIRST, LAST).union(counted("first", FIRST, None)).union(counted("last", None, LAST))


@query("symbol_in_filter", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def _(t):
    return scalars.in_list(t.raw("orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["1-URGENT", "5-LOW"])


@query(
    "not_null_filter",
    "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL",
)
def _(t):
    d = t.raw("documents").select("doc_id").join(t.raw("labels"), "doc_id", "left")
    return scalars.not_null(d, ["quality", "toxic"]).select("doc_id", "quality")


@query("dedupe_rows", "SELECT DISTINCT event_type, user_id, ts::DATE AS day FROM events")
def _(t):
    return scalars.dedupe(t.raw("events").select("event_type", "user_id", F.to_date("ts").alias("day")))


@query(
    "dedupe_by_key",
    """SELECT count(*)::BIGINT AS rows, count(DISTINCT (event_type, user_id))::BIGINT AS kept, (count(*) - count(DISTINCT (event_type, user_id)))::BIGINT AS removed FROM events""",
)
def _(t):
    return scalars.dedupe_report(t.raw("events"), ["event_type", "user_id"])


@query(
    "slug_map",
    """SELECT s_suppkey, CASE n_name WHEN 'NATION_0' THEN 'zero' WHEN 'NATION_1' THEN 'one' ELSE lower(n_name) END AS slug
    FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def _(t):
    s = t.raw("supplier").join(t.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return scalars.slug_map(s, "n_name", {"NATION_0": "zero", "NATION_1": "one"}).select("s_suppkey", "slug")


SIGN = "CASE label WHEN 'positive' THEN 1 WHEN 'neutral' THEN 0 WHEN 'negative' THEN -1 END"


@query(
    "compound_sentiment",
    f"WITH {COMMENTS} SELECT comment_id, {SIGN} AS sentiment_numeric, {R(f'greatest(least({SIGN} * score, 1), -1)')} AS compound FROM comments",
)
def _(t):
    return rounded(scalars.compound_sentiment(t.comments).select("comment_id", "sentiment_numeric", "compound"))


@query(
    "compound_from_aggregate",
    f"""WITH {COMMENTS}, d AS (SELECT community, day, coalesce(avg(score) FILTER (label = 'positive'), 0) - coalesce(avg(score) FILTER (label = 'negative'), 0) AS c FROM comments GROUP BY 1, 2)
    SELECT community, day, {R('c')} AS compound, CASE WHEN c > 0.1 THEN 'positive' WHEN c < -0.1 THEN 'negative' ELSE 'neutral' END AS label FROM d""",
)
def _(t):
    d = aggregate.daily_sentiment(t.comments)
    return rounded(scalars.compound_from_aggregate(d, pos="avg_pos_score", neg="avg_neg_score").select("community", "day", "compound", "label"))


def any_of(words):
    return f"regexp_matches(lower(body), '{'|'.join(words)}')"


@query(
    "keyword_flags",
    f"""WITH {ARTICLES} SELECT id, {any_of(NEG)}::INT AS has_fear, {any_of(POS)}::INT AS has_greed, {any_of(SURE)}::INT AS has_uncertain FROM articles""",
)
def _(t):
    k = scalars.keyword_flags(t.articles, text="body", fear=NEG, greed=POS, uncertain=SURE)
    return k.select("id", *[F.col(c).cast("int") for c in ("has_fear", "has_greed", "has_uncertain")])


ARTICLE_SIGN = "CASE WHEN quality = 1 THEN 1 WHEN quality = 0 THEN -1 ELSE 0 END"


@query(
    "emotion_scores",
    f"""WITH {ARTICLES}, s AS (SELECT a.*, {ARTICLE_SIGN} AS s FROM articles a LEFT JOIN labels l ON a.id = l.doc_id)
    SELECT id, (s = -1 AND {any_of(NEG)})::INT AS fear, (s = 1 AND {any_of(POS)})::INT AS greed, (s = 1 AND {any_of(SURE)})::INT AS fomo FROM s""",
)
def _(t):
    labels = t.raw("labels").select(F.col("doc_id").alias("id"), "quality")
    s = F.when(F.col("quality") == 1, 1).when(F.col("quality") == 0, -1).otherwise(0)
    a = t.articles.join(labels, "id", "left").withColumn("sentiment_numeric", s)
    e = scalars.emotion_scores(scalars.keyword_flags(a, text="body", fear=NEG, greed=POS, uncertain=SURE))
    return e.select("id", *[F.col(c).cast("int") for c in ("fear", "greed", "fomo")])


@query(
    "emotion_scores_fallback",
    f"""WITH {COMMENTS}, s AS (SELECT comment_id, score, {SIGN} AS s FROM comments)
    SELECT comment_id, (s = -1 AND score > 0.8)::INT AS fear, (s = 1 AND score > 0.8)::INT AS greed, (s = 1 AND score < 0.7)::INT AS fomo FROM s""",
)
def _(t):
    e = scalars.emotion_scores_fallback(scalars.compound_sentiment(t.comments))
    return e.select("comment_id", *[F.col(c).cast("int") for c in ("fear", "greed", "fomo")])


def holds(words):
    return " + ".join(f"contains(lower(' ' || body), '{w}')::INT" for w in words)


@query(
    "lexicon_sentiment",
    f"""WITH {ARTICLES}, c AS (SELECT id, {holds(POS)} AS p, {holds(NEG)} AS n FROM articles)
    SELECT id, p::INT AS pos_words, n::INT AS neg_words, CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS lexicon_label,
    {R('CASE WHEN p > n THEN least(1, p / 10.0) WHEN n > p THEN greatest(-1, -n / 10.0) ELSE 0 END')} AS lexicon_score FROM c""",
)
def _(t):
    s = scalars.lexicon_sentiment(t.articles, positive=POS, negative=NEG)
    return rounded(s.select("id", "pos_words", "neg_words", "lexicon_label", "lexicon_score"))


def mentions(words):
    return " + ".join(f"(length(x) - length(replace(x, '{w}', ''))) // {len(w)}" for w in words)


@query(
    "mention_counts",
    f"""WITH {ARTICLES}, x AS (SELECT id, lower(' ' || body) AS x FROM articles)
    SELECT id, ({mentions(POS)})::BIGINT AS bullish_mentions, ({mentions(NEG)})::BIGINT AS bearish_mentions,
    ({mentions(POS)} - ({mentions(NEG)}))::BIGINT AS sentiment_polarity FROM x""",
)
def _(t):
    m = scalars.mention_counts(t.articles, bullish=POS, bearish=NEG)
    return m.select("id", "bullish_mentions", "bearish_mentions", "sentiment_polarity")


@query("text_length", f"WITH {ARTICLES} SELECT id, (length(title) + length(body))::BIGINT AS text_length FROM articles")
def _(t):
    return scalars.text_length(t.articles).select("id", "text_length")


@query(
    "engagement_features",
    f"""WITH {ARTICLES} SELECT id, (score + num_comments)::DOUBLE AS engagement_score,
    {R('CASE WHEN score > 0 THEN num_comments / score ELSE 0 END')} AS comment_rate,
    {R('CASE WHEN length(body) > 0 THEN (score + num_comments) / ln(1 + length(body)) ELSE 0 END')} AS text_engagement FROM articles""",
)
def _(t):
    return rounded(scalars.engagement_features(scalars.text_length(t.articles)).select("id", "engagement_score", "comment_rate", "text_engagement"))


@query(
    "signed_log_score",
    f"WITH {POSTS} SELECT id, {R('sign(score) * ln(1 + abs(score)) / 10')} AS sentiment_score FROM posts",
)
def _(t):
    return rounded(scalars.signed_log_score(t.posts).select("id", "sentiment_score"))


@query(
    "proxy_comment_rows",
    f"WITH {POSTS} SELECT id, id || '_comment' AS comment_id, greatest(1, num_comments // 10)::BIGINT AS comment_score FROM posts",
)
def _(t):
    return scalars.proxy_comment_rows(t.posts).select("id", "comment_id", "comment_score")


@query(
    "time_features",
    f"""WITH {POSTS} SELECT id, hour(ts)::INT AS hour_of_day, (isodow(ts) - 1)::INT AS day_of_week, (isodow(ts) > 5)::INT AS is_weekend FROM posts""",
)
def _(t):
    return scalars.time_features(t.posts).select("id", "hour_of_day", "day_of_week", "is_weekend")


@query(
    "ratio_score_features",
    f"""WITH {COMMENTS}, d AS (SELECT community, day, count(DISTINCT post_id) AS posts, count(*) AS comments,
      avg(score) FILTER (label = 'positive') AS ap, avg(score) FILTER (label = 'negative') AS an,
      count(*) FILTER (label = 'positive') / count(*) AS rp, count(*) FILTER (label = 'negative') / count(*) AS rn,
      avg(post_score) AS aps, avg(comment_score) AS acs FROM comments GROUP BY 1, 2)
    SELECT community, day, {R('coalesce(rp, 0) * coalesce(ap, 0) - coalesce(rn, 0) * coalesce(an, 0)', 10)} AS weighted_sentiment,
    (posts * comments)::DOUBLE AS activity, {R('aps * acs', 4)} AS score_product FROM d""",
)
def _(t):
    f = scalars.ratio_score_features(aggregate.daily_sentiment_ratio(t.comments))
    return f.select("community", "day", r("weighted_sentiment", 10).alias("weighted_sentiment"), "activity", r("score_product", 4).alias("score_product"))


@query(
    "fill_zero",
    "SELECT doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic FROM documents LEFT JOIN labels USING (doc_id)",
)
def _(t):
    return scalars.fill_zero(t.raw("documents").select("doc_id").join(t.raw("labels"), "doc_id", "left"))


@query(
    "finite_filter",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / l_tax AS price_per_tax FROM lineitem WHERE l_tax <> 0",
)
def _(t):
    x = F.col("l_extendedprice") * F.when(F.col("l_tax") == 0, float("inf")).otherwise(1 / F.lit(1.0))
    li = t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_tax", (F.col("l_extendedprice")).alias("p"), x.alias("x"))
    return scalars.finite_filter(li, ["x"]).select("l_orderkey", "l_linenumber", "l_partkey", (F.col("p") / F.col("l_tax")).alias("price_per_tax"))


@query(
    "inf_to_null",
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount <> 0 THEN l_quantity END AS x FROM lineitem",
)
def _(t):
    x = F.when(F.col("l_discount") == 0, float("inf")).otherwise(F.col("l_quantity"))
    return scalars.inf_to_null(t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", x.alias("x")), ["x"])


@query(
    "numeric_columns",
    """SELECT 'doc_id' AS column_name, count(*)::BIGINT AS n_values FROM documents UNION ALL SELECT 'n_chars', count(n_chars) FROM documents
    UNION ALL SELECT 'quality', count(quality) FROM documents LEFT JOIN labels USING (doc_id)
    UNION ALL SELECT 'toxic', count(toxic) FROM documents LEFT JOIN labels USING (doc_id)""",
)
def _(t):
    return scalars.numeric_columns(t.raw("documents").join(t.raw("labels"), "doc_id", "left"), more_than=20)


RETURN_SQL = f"WITH {PRICES}, c AS (SELECT symbol, day, price / lag(price) OVER (PARTITION BY symbol ORDER BY day) - 1 AS ret FROM prices)"


@query(
    "direction_label",
    RETURN_SQL + " SELECT symbol, day, CASE WHEN ret > 0.001 THEN 1 WHEN ret < -0.001 THEN -1 ELSE 0 END AS direction FROM c",
)
def _(t):
    p = features.pct_change(t.prices, "price", keys=["symbol"], order="day", name="ret")
    return scalars.direction_label(p, change="ret").select("symbol", "day", "direction")


@query("binary_up_target", RETURN_SQL + " SELECT symbol, day, coalesce((ret > 0)::INT, 0) AS up FROM c")
def _(t):
    p = features.pct_change(t.prices, "price", keys=["symbol"], order="day", name="ret")
    return scalars.binary_up(p, change="ret").select("symbol", "day", "up")


@query(
    "quantile_flag_score",
    f"""WITH {POSTS}, q AS (SELECT quantile_cont(score, 0.8) AS q80, quantile_cont(num_comments, 0.7) AS q70 FROM posts)
    SELECT id, {R("0.3 * (score > q80)::INT + 0.3 * (num_comments > q70)::INT + 0.2 * (upvote_ratio > 0.9)::INT + 0.2 * (community IN ('click', 'view'))::INT")} AS flag_score FROM posts, q""",
)
def _(t):
    return rounded(aggregate.quantile_flag_score(t.posts).select("id", "flag_score"))


@query(
    "select_feature_view",
    "SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag FROM lineitem WHERE l_returnflag IS NOT NULL",
)
def _(t):
    return scalars.select_feature_view(t.raw("lineitem"), view="lineitem", target="l_returnflag")
