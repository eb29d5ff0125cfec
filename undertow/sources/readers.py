"""Scans: nested and flat post files, price files, stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undertow import schemas
from undertow.functions.scalars import map_value


UNREADABLE = "_unreadable"


def source_file() -> Column:
    """Name of the file a row was read from; a file that Spark wrote is a folder of parts and has the folder's name."""
    steps = F.split(F.col("_metadata.file_path"), "/")
    last, above = F.element_at(steps, -1), F.element_at(steps, -2)
    return F.url_decode(F.when(last.startswith("part-"), F.regexp_replace(above, "^[^=]*=", "")).otherwise(last))


def scan_arrays(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files that hold one JSON array each (a task a file): the fields, ``file``, and ``_unreadable``, the text of a file that is no JSON.

    ``path`` is a folder of files, or of folders named after the files that Spark wrote in parts.
    """
    wide = T.StructType([*schema.fields, T.StructField(UNREADABLE, T.StringType())])
    reader = spark.read.schema(wide).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", UNREADABLE)
    return reader.option("recursiveFileLookup", True).json(path).withColumn("file", source_file())


def unreadable_files(scanned: DataFrame) -> DataFrame:
    """(file, n_chars) of what a scan could not read: skipped, but not unseen."""
    some = next(f.name for f in scanned.schema.fields if f.name not in (UNREADABLE, "file"))  # Spark reads no unreadable text alone
    bad = scanned.filter(F.col(UNREADABLE).isNotNull() & F.col(some).isNull())
    return bad.select("file", F.char_length(UNREADABLE).cast("long").alias("n_chars"))


def readable(scanned: DataFrame) -> DataFrame:
    return scanned.filter(F.col(UNREADABLE).isNull()).drop(UNREADABLE)


def scan_nested_posts(spark: SparkSession, path: str) -> DataFrame:
    """Directory of JSON arrays of posts, comments nested; see :func:`unreadable_files` for files that are no JSON."""
    return readable(scan_arrays(spark, path, schemas.NESTED_POST)).withColumnRenamed("file", "batch_file")


def parse_nested_posts(df: DataFrame, json: str = "json") -> DataFrame:
    """Posts held as JSON text in a column."""
    return df.select(F.from_json(json, schemas.NESTED_POST).alias("p")).select("p.*")


def explode_comments(posts: DataFrame) -> DataFrame:
    """One row per comment; a post without comments keeps one row with NULL comment fields."""
    return posts.select(
        F.col("subreddit"),
        F.col("id").alias("post_id"),
        F.col("title").alias("post_title"),
        F.col("url").alias("post_url"),
        F.col("score").alias("post_score"),
        F.col("text").alias("post_text"),
        F.timestamp_seconds("created_utc").alias("post_created_utc"),
        F.col("created_at").try_cast("timestamp").alias("post_created_at"),
        F.col("num_comments").alias("post_num_comments"),
        *[F.col(c) for c in ("batch_file",) if c in posts.columns],
        F.explode_outer("comments").alias("c"),
    ).select(
        "*",
        F.col("c.id").alias("comment_id"),
        F.col("c.author").alias("comment_author"),
        F.col("c.body").alias("comment_body"),
        F.col("c.score").alias("comment_score"),
        F.timestamp_seconds("c.created_utc").alias("comment_created_utc"),
        F.col("c.created_at").try_cast("timestamp").alias("comment_created_at"),
        F.col("c.sentiment.label").alias("sentiment_label"),
        F.col("c.sentiment.score").alias("sentiment_score"),
    ).drop("c")


def scan_flat_posts(spark: SparkSession, path: str) -> DataFrame:
    """``<Community>_batch_N.json`` listings; :func:`unreadable_files` tells which files were skipped."""
    raw = readable(scan_arrays(spark, path, schemas.FLAT_POST))
    return flat_post_defaults(raw.withColumn("community", F.regexp_extract("file", r"^(.*)_batch_", 1)).drop("file"))


def flat_post_defaults(df: DataFrame) -> DataFrame:
    """Missing fields get their default; rows without a readable time are dropped."""
    known = {c: v for c, v in schemas.FLAT_POST_DEFAULTS.items() if c in df.columns}
    return epoch_to_ts(df.na.fill(known), "created_utc")


def epoch_to_ts(df: DataFrame, column: str = "created_utc", name: str = "ts") -> DataFrame:
    """Epoch seconds (number or text) to a UTC timestamp; unparsable rows are dropped."""
    seconds = F.col(column).try_cast("double")
    return df.withColumn(name, F.timestamp_seconds(seconds)).filter(F.col(name).isNotNull())


def scan_prices_csv(spark: SparkSession, path: str) -> DataFrame:
    """Price CSVs; the symbol is the upper-cased prefix of the file name."""
    return (
        spark.read.schema(schemas.PRICE_FILE)
        .option("header", True)
        .option("recursiveFileLookup", True)
        .csv(path)
        .withColumn("symbol", F.upper(F.split(source_file(), "-")[0]))
    )


def normalize_prices(
    df: DataFrame, *, symbols: dict[str, str], names: dict[str, str], key: str, first: str, last: str
) -> DataFrame:
    """Known files only, NULL numbers to 0, date range, names attached."""
    numbers = ["price", "market_cap", "total_volume"]
    return (
        df.withColumn("symbol", map_value(F.col(key), symbols))
        .filter(F.col("symbol").isNotNull() & F.col("snapped_at").between(F.lit(first).cast("timestamp"), F.lit(last).cast("timestamp")))
        .select(
            "symbol",
            F.coalesce(map_value(F.col("symbol"), names), F.col("symbol")).alias("name"),
            "snapped_at",
            *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in numbers],
        )
    )


def scan_range(df: DataFrame, day: str | Column, first: str | None = None, last: str | None = None) -> DataFrame:
    """Rows whose day lies in the closed range; either bound may be missing."""
    at = F.col(day) if isinstance(day, str) else day
    if first is not None:
        df = df.filter(at >= F.lit(first).cast("date"))
    if last is not None:
        df = df.filter(at <= F.lit(last).cast("date"))
    return df


def scan_comments_range(df: DataFrame, first: str, last: str) -> DataFrame:
    """Comment-level projection: label, score, post score; NULL comments dropped."""
    return scan_range(df.filter("comment_id is not null"), "day", first, last).select(
        "community",
        "comment_id",
        "ts",
        F.col("label").alias("sentiment_label"),
        F.col("score").alias("sentiment_score"),
        F.col("post_score").alias("score"),
    )


def sample_head_per_file(df: DataFrame, file: str, position: str, n: int, fan: int = 64) -> DataFrame:
    """The first ``n`` rows of every source file.

    Each file is first cut to n candidates in ``fan`` salted parts, so a file
    that holds most rows is never ordered in one task.
    """
    salt = F.pmod(F.xxhash64(position), F.lit(fan))
    part = Window.partitionBy(file, "_salt").orderBy(position)
    whole = Window.partitionBy(file).orderBy(position)
    return (
        df.withColumn("_salt", salt)
        .withColumn("_rank", F.row_number().over(part))
        .filter(F.col("_rank") <= n)
        .withColumn("_rank", F.row_number().over(whole))
        .filter(F.col("_rank") <= n)
        .drop("_salt", "_rank")
    )
