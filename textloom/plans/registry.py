"""Where queries register, and SQL pieces that their oracles share (DuckDB)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.plans import config as C

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(xs) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


def words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')"


def count(x: str) -> str:
    return f"len({words(x)})"


def has_any(x: str, phrases) -> str:
    return "(" + " or ".join(f"contains(lower({x}), {quoted([p])})" for p in phrases) + ")"


#: Entities that the queries put into their texts, as DuckDB has no function for them.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "''", "&apos;": "''", "&nbsp;": "\u00a0", "&rsquo;": "\u2019", "&mdash;": "\u2014", "&eacute;": "\u00e9", "&hellip;": "\u2026", "&copy;": "\u00a9", "&middot;": "\u00b7", "&#8217;": "\u2019", "&#x2014;": "\u2014", "&amp;": "&"}
SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def unescape(x: str) -> str:
    for name, char in ENTITIES.items():
        x = f"replace({x}, '{name}', '{char}')"
    return x


def clean_markdown(x: str) -> str:
    out = rf"regexp_replace({unescape(x)}, 'https?://\S+', '', 'g')"
    out = rf"regexp_replace({out}, '\[([^\]]+)\]\([^)]+\)', '\1', 'g')"
    out = rf"regexp_replace({out}, '(\*\*|##|~~|`|__)', ' ', 'g')"
    return rf"trim(regexp_replace(regexp_replace({out}, '&[\pL\pN_]+;', ' ', 'g'), '{SPACES}', ' ', 'g'))"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def rstrip(x: str) -> str:
    return rf"regexp_replace({x}, '\s+$', '')"


def footer(x: str) -> str:
    """Without the footer that begins in the last 38 percent: the places of all matches of all patterns
    from the lengths of the pieces between them."""
    starts = [f"list_transform(range(1, len(regexp_extract_all(z, '(?i){p}')) + 1), lambda k: list_sum(list_transform(string_split_regex(z, '(?i){p}')[1:k], lambda y: length(y))) + coalesce(list_sum(list_transform(regexp_extract_all(z, '(?i){p}')[1:k - 1], lambda y: length(y))), 0))" for p in C.FOOTERS]
    cut = f"list_min(list_filter(flatten([{', '.join(starts)}]), lambda a: a >= floor(length(z) * 0.62)))"
    return f"(select case when length(z) < 120 then w else {rstrip(f'left(z, coalesce({cut}, length(z))::bigint)')} end from (select w, {strip('w')} as z from (select {x} as w)))"


def packed(units: str, most: int, joiner: str) -> str:
    """A list of texts joined greedily up to a size."""
    n = 2 if "chr" in joiner else 1
    return f"list_reduce(list_transform({units}, lambda v: [v]), lambda a, b: case when length(a[-1]) + {n} + length(b[1]) <= {most} then list_concat(a[:-2], [a[-1] || {joiner} || b[1]]) else list_concat(a, b) end)"


def by_sentences(body: str, most: int) -> str:
    """A stripped text's paragraphs, where too long their sentences, where too long their words, packed."""
    said = rf"""list_filter(list_transform(string_split(regexp_replace(p, '([.!?])\s+(["''“‘(\[]?[A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: {strip("x")}), lambda x: x <> '')"""
    units = f"flatten(list_transform({said}, lambda s: case when length(s) <= {most} then [s] else {packed(words('s'), most, chr(39) + ' ' + chr(39))} end))"
    one = f"case when length(p) <= {most} then [p] else {packed(units, most, chr(39) + ' ' + chr(39))} end"
    paragraphs = rf"list_filter(list_transform(string_split_regex({body}, '\n{{2,}}'), lambda x: {strip('x')}), lambda x: x <> '')"
    return f"case when length({body}) <= {most} then (case when {body} = '' then [] else [{body}] end) else {packed(f'flatten(list_transform({paragraphs}, lambda p: {one}))', most, 'chr(10) || chr(10)')} end"


def truncated(x: str, most: int = C.TRUNCATE_CHARS) -> str:
    """Cut with a note, at a paragraph break in the last fifth if there is one."""
    h = f"left({x}, {most})"
    at = f"case when contains({h}, chr(10) || chr(10)) then length({h}) - instr(reverse({h}), chr(10) || chr(10)) - 1 else -1 end"
    return f"case when length({x}) <= {most} then {x} else {rstrip(f'left({x}, case when {at} > {most * 4 // 5} then {at} else {most} end)')} || chr(10) || chr(10) || '[Truncated for training.]' end"


def features(x: str) -> dict[str, str]:
    w = words(x)
    n = rf"list_filter(list_transform(string_split({x}, '.'), lambda s: {count('s')}), lambda k: k > 0)"
    return {
        "word_count": f"len({w})",
        "avg_sentence_length": f"case when len({n}) > 0 then list_sum({n}) / len({n}) else 0.0 end",
        "vocabulary_richness": f"len(list_distinct({words(f'lower({x})')})) / len({w})",
        "question_count": f"len({x}) - len(replace({x}, '?', ''))",
        "formality_score": f"len(list_filter({w}, lambda t: len(t) >= 7)) / len({w})",
        "is_b2b": has_any(x, C.B2B_KEYWORDS),
    }


#: Common table expression of ``analytics.posts``.
POSTS = f"""c as (select *, {clean_markdown("coalesce(text, '')")} as cleaned_text from documents),
l as (select * from c where {count("cleaned_text")} >= {C.MIN_WORDS}),
posts as (select *, {", ".join(f"{v} as {k}" for k, v in features("cleaned_text").items())}
  from l where doc_id in (select min(doc_id) from l group by md5(cleaned_text)))"""


def cap(x: str) -> str:
    return rf"(case when {count(x)} > 0 then len(list_filter({words(x)}, lambda t: regexp_matches(t, '^\p{{Lu}}'))) / {count(x)} else 0.0 end)"


def punct(x: str) -> str:
    return rf"(case when {count(x)} > 0 then len(regexp_extract_all({x}, '[.!?]')) / {count(x)} else 0.0 end)"
