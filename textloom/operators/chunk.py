"""Chunking: word windows, sentence and character packing, training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions import udfs
from textloom.plans import config as C


def windows(words: Column, size: int, step: int) -> Column:
    """Texts of the windows of ``size`` words that start every ``step`` words."""

    def cut(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(w) - 1) / step).cast("int"))
        return F.when(F.size(w) > 0, F.transform(starts, lambda k: F.array_join(F.slice(w, k * step + 1, size), " "))).otherwise(F.array().cast("array<string>"))

    return X.let(words, cut)


def fixed(c: str | Column, size: int = C.CHUNK_WORDS) -> Column:
    """Chunks of ``size`` words; none of an empty text."""
    return windows(X.words(c), size, size)


def overlapping(c: str | Column, size: int = C.CHUNK_WORDS, overlap: int = C.CHUNK_OVERLAP) -> Column:
    """A text of up to ``size`` words as it is; else windows that share ``overlap`` words, the last of
    which may lie inside the one before."""
    return X.let(X.words(c), lambda w: F.when(F.size(w) <= size, F.array(X.text(c))).otherwise(windows(w, size, size - overlap)))


def punctuation_windows(c: str | Column, size: int = 200, overlap: int = 5) -> Column:
    return windows(X.words(c), size, size - overlap)


def explode_chunks(docs: DataFrame, chunks: Column, *keep: str) -> DataFrame:
    """(``keep``, chunk_index, chunk_text, word_count) of the chunks that are not blank."""
    out = docs.select(*keep, F.posexplode(chunks).alias("chunk_index", "chunk_text"))
    return out.where(F.length(F.trim("chunk_text")) > 0).withColumn("word_count", X.word_count("chunk_text"))


def pack_sentences(c: str | Column, most: int) -> Column:
    """Sentences packed greedily up to ``most`` characters, as one expression."""
    s = X.sentences(c)

    def step(a: Column, u: Column) -> Column:
        joined = F.when(a["cur"] == "", u).otherwise(F.concat(a["cur"], F.lit(" "), u))
        fits = (a["cur"] == "") | (F.length(joined) <= most)
        return F.when(fits, F.struct(a["done"].alias("done"), joined.alias("cur"))).otherwise(F.struct(F.concat(a["done"], F.array(a["cur"])).alias("done"), u.alias("cur")))

    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))
    return F.aggregate(s, zero, step, lambda a: F.when(a["cur"] != "", F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]))


def chunk_id(source: str, doc: str, index: str = "chunk_index") -> Column:
    return F.concat_ws("_", F.coalesce(F.nullif(F.col(source), F.lit("")), F.lit("unknown")), doc, index)


def training_rows(docs: DataFrame, title: Column, source: str, body: str, most: int = C.SFT_CHARS, author: str = C.AUTHOR, sentence_aware: bool = False, *keep: str, least_words: int = C.MIN_WORDS) -> DataFrame:
    """(``keep``, part, parts, instruction, input, output). Bodies of fewer than ``least_words`` words, blank
    and short ones, replacement characters and junk titles give no row; long bodies are split and labelled by part. ``most`` of 0
    gives one row, shortened."""
    keep = keep or ("doc_id",)
    fallback = F.coalesce(F.create_map(*(F.lit(x) for kv in C.FALLBACK_TOPICS.items() for x in kv))[F.col(source)], F.lit(C.DEFAULT_TOPIC))
    t = F.trim(X.text(title))
    rows = docs.withColumn("_body", F.regexp_replace(X.text(body), r"^\s+|\s+$", "")).withColumn("_topic", F.when(t != "", F.left(t, F.lit(200))).otherwise(fallback))
    rows = rows.where((X.word_count(body) >= least_words) & (F.length("_body") >= C.MIN_CHARS) & ~F.contains(F.col("_body"), F.lit("�")) & ~F.contains(F.col("_topic"), F.lit("�")) & ~F.contains(F.lower("_topic"), F.lit(C.JUNK[0])))
    if most <= 0:
        rows = rows.select(*keep, "_topic", F.lit(0).alias("_i"), F.lit(1).alias("parts"), X.truncate("_body").alias("output"))
    else:
        cut = (udfs.chunks_by_sentences if sentence_aware else udfs.chunks_by_chars)(most)
        rows = rows.withColumn("_chunks", cut("_body")).select(*keep, "_topic", F.size("_chunks").alias("parts"), F.posexplode("_chunks").alias("_i", "output"))
    label = F.when(F.col("parts") == 1, F.col("_topic")).otherwise(F.format_string("%s (part %d of %d)", "_topic", F.col("_i") + 1, "parts"))
    return rows.select(*keep, (F.col("_i") + 1).alias("part"), "parts", F.concat(F.lit(C.instruction(author=author)), label).alias("instruction"), F.lit("").alias("input"), "output")


def expand_rows(rows: DataFrame, most: int = C.SFT_CHARS, author: str = C.AUTHOR, *keep: str) -> DataFrame:
    """Long outputs of (instruction, input, output) split at sentences; short rows stay as they are."""
    keep = keep or ("doc_id",)
    long_ = rows.withColumn("_chunks", udfs.chunks_by_sentences(most)("output")).withColumn("_n", F.size("_chunks"))
    out = long_.select(*keep, "instruction", "input", F.col("output").alias("_whole"), "_n", F.posexplode_outer("_chunks").alias("_i", "_chunk"))
    name = F.concat(F.lit(C.instruction(author=author)), F.format_string("%s (part %d of %d)", X.base_topic("instruction", author), F.col("_i") + 1, "_n"))
    return out.select(*keep, F.when(F.col("_n") > 1, name).otherwise(F.col("instruction")).alias("instruction"), "input", F.when(F.col("_n") > 1, F.col("_chunk")).otherwise(F.col("_whole")).alias("output"), F.col("_n").alias("parts"))


def expansion_stats(rows: DataFrame, expanded: DataFrame) -> DataFrame:
    """One row: rows before and after ``expand_rows``, and how many of them were split."""
    first = expanded.agg(F.count("*").alias("rows_out"), F.coalesce(F.sum(F.when(F.col("parts") > 1, 1 / F.col("parts"))), F.lit(0)).alias("s"))
    return first.select(rows.agg(F.count("*")).scalar().alias("rows_in"), "rows_out", F.round("s").cast("long").alias("split_from_long"))
