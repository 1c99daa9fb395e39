"""Vocabulary and phrasing profile of an author."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators.analytics import top_terms
from textloom.plans import config as C


def terms(docs: DataFrame, array: Column) -> DataFrame:
    return docs.select(F.explode(array).alias("term"))


def profile_words(c: str, stop: tuple[str, ...] = C.PROFILE_STOP_WORDS) -> Column:
    """Runs of five letters a-z or more that are not stop words."""
    return F.filter(F.regexp_extract_all(F.lower(X.text(c)), F.lit("[a-z]{5,}"), F.lit(0)), lambda w: ~w.isin(*stop))


#: Words that are letters throughout, as word tokenisers have them: no part of a word with digits,
#: hyphens, points or slashes inside; endings after an apostrophe and ``n't`` are cut off.
WORD = r"(?<![\p{L}\p{N}_./'-])\p{L}{3,}?(?=n't(?!\p{L})|'(?:s|ll|re|ve|d|m)(?!\p{L})|(?![\p{L}\p{N}_]|[./'-][\p{L}\p{N}]))"


def content_words(c: str) -> Column:
    """Tokens of letters only, three or more, that are not function words."""
    return F.filter(F.regexp_extract_all(F.lower(X.text(c)), F.lit(WORD), F.lit(0)), lambda w: ~w.isin(*C.STOP_WORDS))


def sentence_count(c: str) -> Column:
    """Sentences that are not blank; they end at marks or line breaks."""
    return F.size(F.filter(F.split(X.text(c), r"[.!?]\s+|\n+"), lambda x: F.trim(x) != ""))


def bigrams(words: Column) -> Column:
    none = F.array().cast("array<string>")

    def pairs(w: Column) -> Column:
        return F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))

    return X.let(words, lambda w: F.when(F.size(w) > 1, pairs(w)).otherwise(none))


def starters(c: str) -> Column:
    """The first two words of each sentence; sentences end at marks or line breaks."""
    s = F.filter(F.split(X.text(c), r"[.!?]\s+|\n+"), lambda x: F.trim(x) != "")
    two = F.transform(s, lambda x: F.slice(X.words(F.lower(x)), 1, 2))
    return F.transform(F.filter(two, lambda w: F.size(w) == 2), lambda w: F.array_join(w, " "))


def framing(docs: DataFrame, c: str = "text", n: int = 15) -> DataFrame:
    """Phrases by how often they occur, those that do."""
    low = F.lower(X.text(c))
    counts = docs.agg(*(F.sum(F.regexp_count(low, F.lit(p))).cast("long").alias(str(k)) for k, p in enumerate(C.FRAMING)))
    pairs = F.array(*(F.struct(F.lit(p).alias("term"), F.col(str(k)).alias("n")) for k, p in enumerate(C.FRAMING)))
    return counts.select(F.explode(pairs).alias("x")).select("x.*").where("n > 0").orderBy(F.desc("n"), "term").limit(n)


def profile(docs: DataFrame, c: str = "text") -> DataFrame:
    """One row: ranked terms and counts, as nested columns."""
    ranked = lambda df, name: df.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "term"))), lambda x: x["term"]).alias(name))
    docs = docs.withColumn("_w", content_words(c))
    w = F.col("_w")
    words = ranked(top_terms(terms(docs, w), 50), "top_words")
    pairs = ranked(top_terms(terms(docs, bigrams(w)), 20), "top_bigrams")
    start = ranked(top_terms(terms(docs, starters(c)), 20), "starters")
    frame = ranked(framing(docs, c), "framing")
    meta = docs.agg(F.count("*").alias("num_documents"), F.sum(sentence_count(c)).cast("long").alias("num_sentences"), F.sum(F.size(w)).cast("long").alias("num_content_words"))
    one = meta
    for df in (words, pairs, start, frame):  # one row each
        one = one.withColumns({df.columns[0]: df.scalar()})
    return one.withColumn("themes", F.concat(F.slice("top_words", 1, 20), "top_bigrams"))
