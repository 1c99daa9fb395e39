"""Rules that classify and clean rows of training data."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions import udfs
from textloom.operators import chunk
from textloom.operators.vector import Generator
from textloom.plans import config as C
from textloom.plans import prompts


def is_echo(instr: str | Column, out: str | Column, author: str = C.AUTHOR) -> Column:
    """The instruction is the beginning of the output, cut with dots."""
    i, o = F.trim(X.text(instr)), F.trim(X.text(out))
    topic = F.regexp_replace(X.base_title(i, author), r"[. …]+$", "")
    head = F.lower(F.left(topic, F.lit(60)))
    start = F.lower(F.left(o, F.lit(80)))
    return i.endswith("...") & (F.length(topic) >= 40) & start.startswith(F.left(head, F.least(F.length(head), F.length(o))))


def is_guest_opener(body: str | Column, own_names: tuple[str, ...] = ()) -> Column:
    """Someone else introduces themselves in the first 300 characters."""
    head = F.lower(F.left(X.text(body), F.lit(300)))
    own = F.lit(False)
    for n in own_names:
        own = own | F.contains(head, F.lit(n))
    return head.rlike(C.GUEST) & ~own


def is_podcast_intro(body: str | Column, phrases: tuple[str, ...] = C.INTRO_PHRASES, chars: int | None = 400) -> Column:
    head = X.text(body) if chars is None else F.left(X.text(body), F.lit(chars))
    return X.has_any(head, phrases)


def is_junk(instr: str | Column, out: str | Column) -> Column:
    return X.has_any(instr, C.JUNK) | X.has_any(out, C.JUNK) | F.contains(X.text(instr), F.lit("�")) | F.contains(X.text(out), F.lit("�")) | (F.length(F.trim(X.text(out))) < C.MIN_CHARS)


def body_class(c: str | Column) -> Column:
    """``transcript``, ``blog``, ``tweet`` or ``other`` by casing, marks and length."""
    t = X.text(c)
    long_ = F.contains(t, F.lit("\n")) | (F.length(t) > 600)
    rates = F.struct(X.cap_rate(c).alias("cap"), X.punct_rate(c).alias("punct"))

    def by_rates(r: Column) -> Column:
        spoken = (r["cap"] < 0.05) & (r["punct"] < 0.02)
        written = (r["cap"] >= 0.05) & (r["punct"] >= 0.02)
        return F.when(spoken, "transcript").when(written, F.when(long_, "blog").otherwise("tweet")).otherwise("other")

    return F.when(F.length(t) < C.MIN_CHARS, "other").otherwise(X.let(rates, by_rates))


EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2700}-\x{27BF}]"


def audit_class(c: str | Column) -> Column:
    t = X.text(c)
    caps, punct = X.cap_rate(c) > 0.05, X.punct_rate(c) > 0.02
    line = F.contains(t, F.lit("\n"))
    short = (F.length(t) < 280) & (t.rlike(EMOJI) | t.rlike(r"#\w+") | (~line & caps & punct))
    return F.when(t == "", "empty").when(short, "tweet_or_short_post").when(caps & punct & line, "blog_post_chunk").when(~caps & ~punct, "transcript_chunk").otherwise("other")


def script_flags(c: str | Column) -> dict[str, Column]:
    """Shares over limits and marks of social posts."""
    t = X.text(c)
    return {
        "cyrillic_cjk": X.share(c, X.CYRILLIC_CJK) > 0.01,
        "non_ascii": X.share(c, r"[^\x00-\x7f]") > 0.02,
        "emoji": t.rlike(EMOJI),
        "hashtag": t.rlike(r"#\w+"),
        "mention": t.rlike(r"@\w+"),
        "url": t.rlike(r"(?i)https?://\S+|pic\.twitter\.com/\S+"),
        "tag": t.rlike(C.AUDIT_TAG),
        "lower_start": t.rlike(r"^\s*\p{Ll}"),
    }


def audit_counters(rows: DataFrame, out: str = "output", instr: str = "instruction") -> DataFrame:
    """All counters in one pass."""
    flags = script_flags(out)
    n = lambda c: F.count_if(c).cast("long")
    t = X.text(out)
    return rows.agg(
        F.count("*").alias("n_rows"),
        *(n(c).alias(f"n_{k}") for k, c in flags.items()),
        n(F.length(t) < C.MIN_CHARS).alias("n_short"),
        n(is_podcast_intro(out, C.AUDIT_INTRO_PHRASES, None)).alias("n_intro"),
        n(is_guest_opener(out)).alias("n_guest"),
        n(is_echo(instr, out)).alias("n_echo"),
        n(X.part_of(instr, 2) > 1).alias("n_multi_part"),
        (F.count("*") - F.count_distinct(F.trim(t))).alias("n_duplicates"),
    )


def clean_rows(rows: DataFrame, order: str = "doc_id", most: int = C.TRUNCATE_CHARS, signatures: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``cleaned``, ``reason``: ``keep``, ``junk`` or ``duplicate`` (the first of equal outputs
    by ``order`` is kept), and whether it was ``shortened``."""
    out = rows.withColumn("_tagged", X.scrub_stage_tags("output")).withColumn("_plain", udfs.strip_footer("_tagged", signatures))
    out = out.withColumn("_junk", is_junk("instruction", "_plain")).withColumn("cleaned", X.truncate("_plain", most))
    out = out.withColumn("_d", F.md5(F.trim("cleaned"))).withColumn("_o", F.struct(order, "instruction"))
    # the least of each group by an aggregate: however often an output is copied, no task holds its rows
    first = out.where("not _junk").groupBy(F.col("_d").alias("_g")).agg(F.min("_o").alias("_first"))
    out = out.join(first, F.col("_d") == F.col("_g"), "left")
    reason = F.when(F.col("_junk"), "junk").when(F.col("_o") != F.col("_first"), "duplicate").otherwise("keep")
    return out.withColumn("reason", reason).withColumn("shortened", F.col("cleaned") != F.col("_plain")).drop("_tagged", "_plain", "_junk", "_d", "_o", "_g", "_first")


def cleaning_stats(cleaned: DataFrame) -> DataFrame:
    """One row of counts from ``clean_rows``."""
    n = lambda c: F.count_if(c).cast("long")
    kept = F.col("reason") == "keep"
    return cleaned.agg(F.count("*").alias("rows_in"), n(kept).alias("rows_out"), n(F.col("reason") == "junk").alias("dropped_junk"), n(F.col("reason") == "duplicate").alias("dropped_duplicates"), n(kept & F.col("shortened")).alias("truncated_outputs"))


def stitch(rows: DataFrame, key: str, part: str, out: str) -> DataFrame:
    """Outputs of one key joined in order of their parts, without a separator."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(part).alias("p"), F.col(out).alias("o"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["o"]), "").alias("body"), F.count("*").alias("parts"))


def clean_bodies(rows: DataFrame, author: str = C.AUTHOR, own_names: tuple[str, ...] = (), most: int = C.SFT_CHARS, signatures: tuple[str, ...] = (), generator: Generator | None = None, window: int = 4000) -> DataFrame:
    """Rows of (title, part, instruction, output) without echoes, stitched by title, without guests,
    intros and foreign scripts, scrubbed, classified, split again and labelled by part. With a
    ``generator`` transcripts get their punctuation back, window by window (``repunctuated``)."""
    own = rows.where(~is_echo("instruction", "output", author))
    whole = stitch(own, "title", "part", "output").where(~is_guest_opener("body", own_names) & ~is_podcast_intro("body") & (X.share("body", X.CYRILLIC_CJK) <= 0.01))
    plain = whole.withColumn("body", X.scrub_fillers(udfs.strip_footer(X.scrub_urls("body"), signatures)))
    plain = plain.withColumn("body", F.trim(F.regexp_replace(F.regexp_replace("body", r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")))
    plain = plain.where(F.length("body") >= C.MIN_CHARS).withColumn("style", body_class("body"))
    if generator is not None:
        plain = plain.withColumn("body", F.when(F.col("style") == "transcript", repunctuated("body", generator, window)["body"]).otherwise(F.col("body")))
    parts = plain.withColumn("_c", F.filter(udfs.chunks_by_sentences(most)("body"), lambda x: F.length(x) >= C.MIN_CHARS))
    out = parts.select("title", "style", F.size("_c").alias("parts"), F.posexplode("_c").alias("_i", "output"))
    label = F.when(F.col("parts") == 1, F.col("title")).otherwise(F.format_string("%s (part %d of %d)", "title", F.col("_i") + 1, "parts"))
    return out.select("title", "style", (F.col("_i") + 1).alias("part"), "parts", F.concat(F.lit(C.instruction(author=author)), label).alias("instruction"), "output")


def prepare(rows: DataFrame, most: int = C.SFT_CHARS, author: str = C.AUTHOR, signatures: tuple[str, ...] = ()) -> DataFrame:
    """Split long outputs first, then clean."""
    return clean_rows(chunk.expand_rows(rows, most, author), signatures=signatures).where("reason = 'keep'")


def source_instruction(source: str) -> Column:
    """What a post of a source answers."""
    names = F.create_map(*(F.lit(x) for kv in C.SOURCE_INSTRUCTIONS.items() for x in kv))
    return F.coalesce(F.try_element_at(names, X.text(source)), F.lit(C.SOURCE_INSTRUCTION))


def drifted(before: str, after: str, limit: float = 0.10) -> Column:
    """Whether a rewritten text lost or gained more than a share of its words."""
    n = X.word_count(before)
    return F.when(n > 0, F.abs(X.word_count(after) - n) / n > limit).otherwise(F.lit(False))


def repunctuated(c: str, generator: Generator, window: int = 4000, tries: int = 2, limit: float = 0.10) -> Column:
    """(body, windows, ok, fallback): a text rewritten by a model in windows of whole words. An answer that
    is empty or has lost or gained more than ``limit`` of the words, or a model that fails, is asked for again
    ``tries`` times in all; then the window stays as it was."""

    @F.pandas_udf("body string, windows int, ok int, fallback int")
    def run(s: pd.Series) -> pd.DataFrame:
        out = []
        for t in s:
            parts, good = udfs.word_windows(t or "", window), 0
            for k, w in enumerate(parts):
                if (new := _rewritten(generator, w, tries, limit)) is not None:
                    parts[k], good = new, good + 1
            body = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]{2,}", " ", " ".join(parts).strip()))
            out.append((body, len(parts), good, len(parts) - good))
        return pd.DataFrame(out, columns=["body", "windows", "ok", "fallback"])

    return run(c)


def _rewritten(generator: Generator, text: str, tries: int, limit: float) -> str | None:
    for _ in range(tries):
        try:
            new = generator.generate(prompts.repunctuation_prompt(text))
        except OSError:
            continue
        new = re.sub(r"(?i)^\s*(?:here(?:'s| is) (?:the )?(?:corrected|repunct[^:\n]*?)[:\s]+|corrected text[:\s]+|corrected[:\s]+)", "", new.strip())
        new = re.sub(r"\s*>>>$", "", re.sub(r"^<<<\s*", "", new.strip())).strip()
        n = len(text.split())
        if new and n and abs(len(new.split()) - n) / n <= limit:
            return new
    return None
