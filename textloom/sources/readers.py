"""Readers and the normalisers of raw sources."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as X

UNIFIED = ("title", "date", "url", "text", "source")
RAW_BLOG = "title string, date string, url string, content string, text string"
RAW_LINKEDIN = "content string, published_text string"
RAW_X = "text string, url string, created_at string, is_reply boolean, is_repost_or_quote boolean"
RAW_VIDEO = "channel string, video_id string, video_title string, video_url string, matched_keywords array<string>, transcript_source string, upload_date string, upload_date_iso string, description string, transcript_text string, transcript_language string, transcript_segments_count int, transcript_error string, fetched_at_utc string, listing_source string"
RAW_ITEM = "id string, source string, url string, title string, text string, word_count int, score string, author string"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A directory or file of JSON lines under a fixed schema."""
    return spark.read.schema(schema).json(path)


def tolerant_json_lines(spark: SparkSession, path: str, schema: str, comments: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, lines that are not JSON objects). Blank lines, and with ``comments`` those that begin
    with ``//``, count as neither."""
    lines = spark.read.text(path).withColumn("value", F.trim("value")).where("value <> ''")
    if comments:
        lines = lines.where(~F.col("value").startswith("//"))
    parsed = lines.withColumn("r", F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull() | ~F.col("value").startswith("{")
    return parsed.where(~bad).select("r.*").drop("_bad"), parsed.where(bad).select("value")


def json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A file with one JSON array, its columns those found in it, or ``schema``. None, with a warning, if it
    is missing, empty, has no rows or is no JSON; rows that do not fit are left out with a warning."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        warnings.warn(f"{path} is missing", stacklevel=2)
        return None
    reader = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
    df = (reader.schema(schema + ", _bad string") if schema else reader).json(path).cache()
    if "_bad" in df.columns:
        bad = df.where("_bad is not null").count()
        if bad:
            warnings.warn(f"{path}: {bad} rows that do not fit are left out", stacklevel=2)
        df = df.where("_bad is null").drop("_bad")
    if not df.columns or df.isEmpty():
        warnings.warn(f"{path} has no rows", stacklevel=2)
        return None
    return df


def ordered_urls(pages: DataFrame, url: str, order: str, most: int | None = None) -> DataFrame:
    """Urls without fragments, each once, in the order in which they came first; the first ``most``."""
    out = pages.select(F.split_part(url, F.lit("#"), F.lit(1)).alias("url"), order).where("url <> ''").groupBy("url").agg(F.min(order).alias(order)).orderBy(order, "url")
    return out.limit(most) if most else out


def eval_set(spark: SparkSession, path: str) -> DataFrame:
    rows, _ = tolerant_json_lines(spark, path, "id string, format string, topic string, audience string, goal string, cta string, k int, gold_reference string", comments=True)
    if rows.isEmpty():
        raise ValueError(f"no rows in {path}")
    return rows


def anchor_texts(rows: DataFrame, order: str, most: int = 400, least_words: int = 32) -> DataFrame:
    """Texts that show a style: the first of output, content, text and body that is not blank, without
    a list of related posts at its end; long enough, one per beginning, the first ``most``."""
    fields = [F.nullif(F.trim(F.col(c)), F.lit("")) for c in ("output", "content", "text", "body") if c in rows.columns]
    at = F.locate("\nrelated posts", F.lower("anchor"))
    out = rows.select(order, F.coalesce(*fields).alias("anchor")).where("anchor is not null")
    out = out.withColumn("anchor", F.when(at > 121, F.trim(F.left("anchor", at - 1))).otherwise(F.col("anchor"))).where(X.word_count("anchor") >= least_words)
    key = F.left(F.sha2(F.left("anchor", F.lit(240)), 256), F.lit(16))
    return out.groupBy(key.alias("k")).agg(F.min(F.struct(order, "anchor")).alias("r")).select("r.*").orderBy(order).limit(most)


def objects(spark: SparkSession, path: str, suffix: str = "*.json") -> DataFrame:
    """Whole objects of a folder by name; names that begin with _ are not read."""
    return spark.read.option("pathGlobFilter", suffix).option("recursiveFileLookup", True).text(path, wholetext=True).select(F.input_file_name().alias("name"), F.col("value").alias("body"))


def markdown(spark: SparkSession, path: str) -> DataFrame:
    return objects(spark, path, "*.md").orderBy("name")


def best_vtt(files: DataFrame, key: str = "video_id", name: str = "name") -> DataFrame:
    """One subtitle file per video: plain English, then its original track, then any."""
    rank = F.when(F.col(name).endswith(".en.vtt") & ~F.contains(F.col(name), F.lit("en-orig")), 0).when(F.contains(F.col(name), F.lit("en-orig")), 1).otherwise(2)
    return files.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(rank, name))).where("_r = 1").drop("_r")


def _preview(body):
    return F.concat(F.left(body, F.lit(120)), F.when(F.length(body) > 120, "...").otherwise(""))


def from_blog(raw: DataFrame) -> DataFrame:
    """Text is the content, or the text where there is none at all; blank rows go."""
    body = F.trim(F.coalesce(F.nullif("content", F.lit("")), "text", F.lit("")))
    title = F.left(F.coalesce(F.nullif("title", F.lit("")), F.lit("Blog post")), F.lit(500))
    return raw.select(title.alias("title"), X.text("date").alias("date"), X.text("url").alias("url"), body.alias("text"), F.lit("blog").alias("source")).where("text <> ''")


def from_linkedin(raw: DataFrame) -> DataFrame:
    body = F.trim(X.text("content"))
    return raw.select(_preview(body).alias("title"), X.text("published_text").alias("date"), F.lit("").alias("url"), body.alias("text"), F.lit("linkedin").alias("source")).where("text <> ''")


def from_video(raw: DataFrame, source: str) -> DataFrame:
    date = F.coalesce(F.nullif("upload_date_iso", F.lit("")), F.left(X.text("fetched_at_utc"), F.lit(10)))
    title = F.coalesce(F.nullif("video_title", F.lit("")), F.lit("YouTube video"))
    return raw.select(title.alias("title"), date.alias("date"), X.text("video_url").alias("url"), F.trim(X.text("transcript_text")).alias("text"), F.lit(source).alias("source")).where("text <> ''")


def from_x(raw: DataFrame) -> DataFrame:
    """No replies, no reposts, at least 25 characters."""
    body = F.trim(X.text("text"))
    own = ~F.coalesce("is_reply", F.lit(False)) & ~F.coalesce("is_repost_or_quote", F.lit(False))
    return raw.where(own & (F.length(body) >= 25)).select(_preview(body).alias("title"), X.text("created_at").alias("date"), X.text("url").alias("url"), body.alias("text"), F.lit("x").alias("source"))


def padded(*frames: DataFrame, source: str = "") -> DataFrame:
    """Older items under one schema: missing columns are null, scores that are no numbers too; a row
    keeps its own source."""
    out = None
    for df in frames:
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.withColumn("score", F.col("score").try_cast("int")).withColumn("source", F.coalesce(F.nullif("source", F.lit("")), F.lit(source)))


def unify(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out.dropDuplicates(["source", "title", "url", "text"]).withColumn("essay_id", F.xxhash64("source", "title", "url", "text"))
