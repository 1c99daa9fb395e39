"""Posts with style features, profiles, funnels, splits, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.plans import config as C


def posts(docs: DataFrame, body: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ("source",)) -> DataFrame:
    """One row per distinct cleaned text of at least 50 words, that with the least key: key, ``keep``
    and the style features.

    Features are made once in the scan's stage. Texts with one digest have the same features, so a
    hash aggregate of numbers is all that is exchanged; ``keep`` joins by key.
    """
    out = docs.select(key, X.clean_markdown(body).alias("_t"))
    out = out.withColumn("_w", X.words("_t")).withColumn("_low", F.lower("_t")).withColumn("_n", F.size("_w"))
    # words between spaces and full stops, over the stretches between full stops that hold any
    stretches = F.size(F.filter(F.split("_t", r"\."), lambda s: F.trim(s) != ""))
    said = F.size(F.filter(F.split("_t", r"[\s.]+"), lambda w: w != ""))
    b2b = F.lit(False)
    for word in C.B2B_KEYWORDS:
        b2b = b2b | F.contains(F.col("_low"), F.lit(word))
    columns = {
        "word_count": F.col("_n"),
        "avg_sentence_length": F.when(stretches > 0, said / stretches).otherwise(F.lit(0.0)),
        "vocabulary_richness": F.when(F.col("_n") > 0, F.size(F.array_distinct(F.transform("_w", F.lower))) / F.col("_n")).otherwise(F.lit(0.0)),
        "question_count": F.length("_t") - F.length(F.replace("_t", F.lit("?"), F.lit(""))),
        "formality_score": F.when(F.col("_n") > 0, F.size(F.filter("_w", lambda w: F.length(w) >= 7)) / F.col("_n")).otherwise(F.lit(0.0)),
        "is_b2b": b2b,
    }
    one = out.groupBy(F.xxhash64("_t").alias("_a"), F.xxhash64(F.lit(1), F.col("_t")).alias("_b")).agg(F.min(key).alias(key), *(F.any_value(c).alias(n) for n, c in columns.items()))
    one = one.where(F.col("word_count") >= C.MIN_WORDS).drop("_a", "_b")
    return one.join(docs.select(key, *keep).dropDuplicates([key]), key) if keep else one


def style_profile(p: DataFrame, by: str = "source") -> DataFrame:
    return p.groupBy(by).agg(
        F.count("*").alias("n_posts"),
        F.round(F.avg("word_count"), 4).alias("avg_words"),
        F.round(F.avg("avg_sentence_length"), 4).alias("avg_sentence_length"),
        F.round(F.avg("vocabulary_richness"), 6).alias("avg_richness"),
        F.round(F.avg("formality_score"), 6).alias("avg_formality"),
    )


def with_scores(p: DataFrame, scores: DataFrame, key: str = "doc_id") -> DataFrame:
    return p.join(scores, key, "left")


def top_quality(p: DataFrame, n: int = 500) -> DataFrame:
    """The first posts by score times words, ties by key."""
    rank = (F.coalesce(F.col("score"), F.lit(1)) * F.col("word_count")).cast("long")
    return p.where("word_count > 100").withColumn("rank_value", rank).orderBy(F.desc("rank_value"), "doc_id").limit(n)


def funnel(docs: DataFrame, by: str = "source", body: str = "text") -> DataFrame:
    """Raw rows, rows with text, rows of 50 words; with a total."""
    n = X.word_count(body)
    return docs.rollup(by).agg(F.count("*").alias("n_raw"), F.count_if(n > 0).alias("n_text"), F.count_if(n >= C.MIN_WORDS).alias("n_long")).withColumn(by, F.coalesce(by, F.lit("TOTAL")))


def hash_rank(key: str, seed: int) -> Column:
    """A stable order that does not depend on storage; SQL engines agree on it."""
    return F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(key).cast("string")))


def splits(docs: DataFrame, by: str = "source", key: str = "doc_id", seed: int = 298, shares: tuple[float, float] = (0.8, 0.1), prefix: int = 3) -> DataFrame:
    """``split`` per document: train, val or test, by the rank of its digest within the source.

    A source is ranked in slices by the first ``prefix`` digits of the digest, which keep the order;
    counts of the slices before give the rest of the rank. So no task holds a whole source.
    """
    rows = docs.withColumn("_d", hash_rank(key, seed)).withColumn("_p", F.left("_d", F.lit(prefix)))
    own = Window.partitionBy("_by", "_s")
    sizes = rows.groupBy(F.col(by).alias("_by"), F.col("_p").alias("_s")).agg(F.count("*").alias("_c"))
    before = sizes.withColumn("_n", F.sum("_c").over(Window.partitionBy("_by"))).withColumn("_b", F.sum("_c").over(Window.partitionBy("_by").orderBy("_s")) - F.col("_c")).drop("_c")
    joined = rows.join(before, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_p") == F.col("_s")))
    r = F.row_number().over(own.orderBy("_d", key)) + F.col("_b")
    a, b = F.round(F.col("_n") * shares[0]), F.round(F.col("_n") * shares[1])
    return joined.withColumn("split", F.when(r <= a, "train").when(r <= a + b, "val").otherwise("test")).select(*docs.columns, "split")


def holdout(docs: DataFrame, key: str = "doc_id", seed: int = 42, percent: int = 10) -> DataFrame:
    """``part``: about ``percent`` in a hundred rows are held out, by digest; no sort."""
    bucket = F.conv(F.left(hash_rank(key, seed), F.lit(6)), 16, 10).cast("long") % 100
    return docs.withColumn("part", F.when(bucket < percent, "eval").otherwise("train"))


def stage_summary(*stages: tuple[str, DataFrame], by: str = "source") -> DataFrame:
    """Counts of several stages side by side, 0 where a source is missing."""
    out = None
    for name, df in stages:
        own = df.groupBy(by).agg(F.count("*").alias(name))
        out = own if out is None else out.join(own, by, "full_outer")
    return out.na.fill(0, [name for name, _ in stages])


def micros(when: str) -> Column:
    return F.unix_micros(F.col(when).cast("timestamp"))


def rank_border(rows: DataFrame, when: str, key: str, rank: int, parts: int = 4096) -> tuple | None:
    """(time in microseconds, key) of the row with a rank (from 1) in that order.

    Counts of equal stretches of time narrow it down, one stretch after another; only the last, short
    stretch is sorted. At most ``parts`` counts come to the driver at a time.
    """
    own = rows.select(key, micros(when).alias("_t")).where("_t is not null")
    lo, hi = own.agg(F.min("_t"), F.max("_t")).first()
    while lo is not None and hi - lo >= parts:
        step = (hi - lo) // parts + 1
        counts = own.where(F.col("_t").between(lo, hi)).groupBy(F.floor((F.col("_t") - lo) / step).alias("b")).count().orderBy("b").collect()
        for b, n in counts:
            if rank <= n:
                lo, hi = lo + b * step, min(hi, lo + (b + 1) * step - 1)
                break
            rank -= n
        else:
            return None
        if n <= 10_000:
            break
    if lo is None:
        return None
    return own.where(F.col("_t").between(lo, hi)).orderBy("_t", key).limit(rank).agg(F.max(F.struct("_t", key)).alias("b")).first()["b"]


def drift(rows: DataFrame, when: str, key: str, value: str) -> DataFrame:
    """Mean, median and 90th percentile of the early and the late half by (time, key)."""
    rows = rows.where(F.col(when).isNotNull())
    n = rows.count()
    border = rank_border(rows, when, key, n // 2) if n > 1 else None
    early = (micros(when) < border[0]) | ((micros(when) == border[0]) & (F.col(key) <= border[1])) if border else F.lit(False)
    return rows.withColumn("half", F.when(early, "early").otherwise("late")).groupBy("half").agg(
        F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean_value"), F.round(F.percentile(value, 0.5), 6).alias("p50"), F.round(F.percentile(value, 0.9), 6).alias("p90")
    )


def top_terms(terms: DataFrame, n: int, col: str = "term") -> DataFrame:
    """The most frequent, ties in order of the alphabet."""
    return terms.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col).limit(n)


def collection_upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Last write wins."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    return both.groupBy(key).agg(F.max_by(F.struct(*[c for c in old.columns if c != key]), "_v").alias("r")).select(key, "r.*")


def require_rows(rows: DataFrame, condition: Column, least: int) -> int:
    """How many rows meet a condition; fails if they are too few."""
    n = rows.agg(F.count_if(condition)).first()[0]
    if n < least:
        raise ValueError(f"{n} rows, {least} are needed")
    return n
