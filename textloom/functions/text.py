"""Text functions as native expressions. Null counts as the empty text unless said otherwise."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.plans import config as C

SPACE = r"\s+"
#: White space as Unicode has it, as a class of characters and by property.
ANY_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
UNICODE_SPACE = r"(?U)[\s\x{1c}-\x{1f}]+"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: str | Column) -> Column:
    return F.coalesce(col(c), F.lit(""))


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def ratio(part: Column, whole: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def words(c: str | Column, space: str = SPACE) -> Column:
    """Tokens between white space; no empty ones."""
    return F.filter(F.split(text(c), space), lambda w: w != "")


def word_count(c: str | Column) -> Column:
    return F.size(words(c))


def split_count(c: str | Column) -> Column:
    """Pieces of a plain split, empty edges included; null for null."""
    return F.when(col(c).isNotNull(), F.size(F.split(col(c), SPACE)))


def avg_sentence_length(c: str | Column) -> Column:
    """Mean words of the stretches between full stops that are not blank; 0 where there are none."""
    n = F.transform(F.split(text(c), r"\."), lambda s: F.size(words(s)))
    return let(F.filter(n, lambda k: k > 0), lambda m: ratio(F.aggregate(m, F.lit(0), lambda a, k: a + k), F.size(m)))


def vocabulary_richness(c: str | Column) -> Column:
    """Distinct lower-cased tokens over tokens."""
    return let(words(F.lower(text(c))), lambda w: ratio(F.size(F.array_distinct(w)), F.size(w)))


def question_count(c: str | Column) -> Column:
    return F.regexp_count(text(c), F.lit(r"\?"))


def formality(c: str | Column) -> Column:
    """Share of tokens of seven characters or more."""
    return let(words(c), lambda w: ratio(F.size(F.filter(w, lambda x: F.length(x) >= 7)), F.size(w)))


def has_any(c: str | Column, phrases: tuple[str, ...]) -> Column:
    """Whether the lower-cased text holds one of the phrases."""

    def any_of(low: Column) -> Column:
        out = F.lit(False)
        for p in phrases:
            out = out | F.contains(low, F.lit(p))
        return out

    return let(F.lower(text(c)), any_of)


def is_b2b(c: str | Column) -> Column:
    return has_any(c, C.B2B_KEYWORDS)


def cap_rate(c: str | Column) -> Column:
    """Share of tokens that begin with an upper-case letter."""
    return let(words(c), lambda w: ratio(F.size(F.filter(w, lambda x: x.rlike(r"^\p{Lu}"))), F.size(w)))


def punct_rate(c: str | Column) -> Column:
    """Sentence marks per token."""
    return let(word_count(c), lambda n: ratio(F.regexp_count(text(c), F.lit("[.!?]")), n))


def share(c: str | Column, chars: str) -> Column:
    """Share of characters in a class."""
    return F.when(F.length(text(c)) > 0, F.regexp_count(text(c), F.lit(chars)) / F.length(text(c))).otherwise(F.lit(0.0))


CYRILLIC_CJK = r"[\x{0400}-\x{04FF}\x{3000}-\x{9FFF}\x{AC00}-\x{D7AF}]"


_ENTITY = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{0,31};?)"
#: Names that count without a semicolon too, longest first.
_OPEN_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
#: Code points that stand for others: those of the old Windows page, and none.
_OTHER_POINTS = {0: "\ufffd", 13: "\r"} | {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)}
#: Code points that stand for nothing.
_NO_POINTS = r"[\x{1}-\x{8}\x{e}-\x{1f}\x{7f}-\x{9f}\x{fdd0}-\x{fdef}\x{b}\x{fffe}\x{ffff}]|[\x{1fffe}\x{1ffff}\x{2fffe}\x{2ffff}\x{3fffe}\x{3ffff}\x{4fffe}\x{4ffff}\x{5fffe}\x{5ffff}\x{6fffe}\x{6ffff}\x{7fffe}\x{7ffff}\x{8fffe}\x{8ffff}\x{9fffe}\x{9ffff}\x{afffe}\x{affff}\x{bfffe}\x{bffff}\x{cfffe}\x{cffff}\x{dfffe}\x{dffff}\x{efffe}\x{effff}\x{ffffe}\x{fffff}\x{10fffe}\x{10ffff}]"


def _table(values: dict) -> Column:
    return F.from_json(F.lit(json.dumps({str(k): v for k, v in values.items()})), "map<string,string>")


def _point(n: Column) -> Column:
    """The character of a code point; what is none or means nothing as HTML has it."""
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return F.when((n > 0x10FFFF) | n.between(0xD800, 0xDFFF), "\ufffd").otherwise(F.coalesce(F.try_element_at(_table(_OTHER_POINTS), n.cast("string")), F.when(char.rlike(_NO_POINTS), "").otherwise(char)))


def unescape(c: str | Column) -> Column:
    """All entities of HTML, by name or number, as characters."""
    t = text(c)
    names = _table(html5)

    def decoded(e: Column) -> Column:  # without the ampersand
        digits = F.regexp_extract(e, r"^#[xX]?([0-9a-fA-F]+)", 1)
        digits = F.when(F.length(F.ltrim(digits, F.lit("0"))) > 9, "1114112").when(F.lower(F.left(e, F.lit(2))) == "#x", F.conv(digits, 16, 10)).otherwise(digits)
        number = F.coalesce(digits.try_cast("long"), F.lit(0x110000))
        head = F.regexp_extract(e, "^(" + "|".join(_OPEN_NAMES) + ")", 1)
        named = F.coalesce(F.try_element_at(names, e), F.when(head != "", F.concat(F.try_element_at(names, head), F.substring(e, F.length(head) + 1, F.length(e)))), F.concat(F.lit("&"), e))
        return F.when(F.startswith(e, F.lit("#")), let(number, _point)).otherwise(named)

    def whole(x: Column) -> Column:
        found, between = F.regexp_extract_all(x, F.lit(_ENTITY), F.lit(1)), F.split(x, _ENTITY, -1)
        return F.concat(F.array_join(F.zip_with(F.slice(between, F.lit(1), F.size(between) - 1), found, lambda a, e: F.concat(a, decoded(e))), ""), F.element_at(between, -1))

    return F.when(F.contains(t, F.lit("&")), let(t, whole)).otherwise(t)


def collapse(c: str | Column) -> Column:
    """Runs of white space, as Unicode has it, become one space; none at the ends."""
    return F.trim(F.regexp_replace(text(c), ANY_SPACE, " "))


def clean_markdown(c: str | Column) -> Column:
    """Entities, urls, links, marks, left-over entities, white space; the url rule goes first and
    takes a link's closing bracket with it."""
    out = F.regexp_replace(unescape(c), C.WEB_URL, "")
    out = F.regexp_replace(out, C.MARKDOWN_LINK, "$1")
    out = F.regexp_replace(out, C.MARKDOWN_MARKS, " ")
    return collapse(F.regexp_replace(out, "(?U)" + C.LEFT_ENTITY, " "))


def clean_collected(c: str | Column) -> Column:
    """The collectors' order: marks before links, no rule for left-over entities."""
    out = F.regexp_replace(unescape(c), C.COLLECTED_MARKS, " ")
    out = F.regexp_replace(out, C.MARKDOWN_LINK, "$1")
    return collapse(F.regexp_replace(out, C.WEB_URL, ""))


def scrub_urls(c: str | Column) -> Column:
    return F.regexp_replace(text(c), C.URLS, "")


def scrub_fillers(c: str | Column) -> Column:
    return F.regexp_replace(text(c), C.FILLERS, "")


def filler_count(c: str | Column) -> Column:
    return F.regexp_count(text(c), F.lit(C.FILLERS))


def strip_fillers(c: str | Column) -> Column:
    """Interjections, asides between commas and stutters."""
    out = F.regexp_replace(text(c), r"(?i)(?<![\w-])(?:" + "|".join(C.INTERJECTIONS) + r")(?![\w-])", " ")
    out = F.regexp_replace(out, C.ASIDES, ", ")
    out = F.regexp_replace(out, C.STUTTER, "$1")
    return F.trim(F.regexp_replace(out, r"[ \t]{2,}", " "))


def scrub_stage_tags(c: str | Column) -> Column:
    """Stage directions of transcripts, runs of spaces and blank lines, white space at line ends."""
    out = F.regexp_replace(text(c), C.STAGE_TAGS, " ")
    out = F.regexp_replace(out, r"[ \t]{2,}", " ")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(out, r"[ \t]+\n", "\n"), r"^\s+|\s+$", "")


def rfind(c: Column, what: str) -> Column:
    """Place of the last occurrence, from 0; -1 if there is none."""
    at = F.locate(what[::-1], F.reverse(c))
    return F.when(at == 0, -1).otherwise(F.length(c) - at - len(what) + 1)


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+$", "")


def truncate(c: str | Column, most: int = C.TRUNCATE_CHARS) -> Column:
    """Cut at ``most`` characters, or at a paragraph break in the last fifth, with a note."""
    t = text(c)
    if most <= 0:
        return t
    head = F.left(t, F.lit(most))
    at = rfind(head, "\n\n")
    cut = F.when(at > most * 4 // 5, F.left(head, at)).otherwise(head)
    return F.when(F.length(t) > most, F.concat(rstrip(cut), F.lit(C.TRUNCATED))).otherwise(t)


def truncate_anchor(c: str | Column, most: int = 680) -> Column:
    """Cut at the last sentence in the second half, else before the last word with an ellipsis."""
    t = F.trim(text(c))
    head = F.left(t, F.lit(most))
    at = rfind(head, ". ")
    words_ = F.concat(F.regexp_replace(head, r"\s+\S*$", ""), F.lit("…"))
    return F.when(F.length(t) <= most, t).when(at > most // 2, F.left(head, at + 1)).otherwise(words_)


def normal_lines(c: str | Column) -> Column:
    """Line feeds only, without the note of ``truncate``."""
    out = F.regexp_replace(text(c), r"\r\n?", "\n")
    return F.when(out.endswith(C.TRUNCATED), rstrip(F.left(out, F.length(out) - len(C.TRUNCATED)))).otherwise(out)


def base_title(c: str | Column, author: str = C.AUTHOR) -> Column:
    """An instruction's topic without its part label."""
    out = F.regexp_replace(text(c), rf"(?i)^Write in the style of {author} about:\s*", "")
    return F.trim(F.regexp_replace(out, r"(?i)\s*\(part\s+(\d+)\s+of\s+(\d+)\)\s*$", ""))


def part_of(c: str | Column, group: int = 1) -> Column:
    """Part number (1) or number of parts (2) of a title, 1 where it has no label."""
    return F.coalesce(F.regexp_extract(text(c), r"(?i)\(part\s+(\d+)\s+of\s+(\d+)\)\s*$", group).try_cast("int"), F.lit(1))


def base_topic(c: str | Column, author: str = C.AUTHOR) -> Column:
    """``base_title``, else the instruction, else a stand-in."""
    return F.coalesce(F.nullif(base_title(c, author), F.lit("")), F.nullif(F.trim(text(c)), F.lit("")), F.lit("this topic"))


def instruction_format(body: str | Column, title: str | Column, author: str = C.AUTHOR) -> Column:
    topic = F.coalesce(F.nullif(text(title), F.lit("")), F.lit("business growth"))
    return F.concat(F.lit(f"### Instruction:\n{C.instruction(author=author)}"), topic, F.lit("\n\n### Response:\n"), text(body))


def alpaca_prompt(instr: str | Column, inp: str | Column, out: str | Column) -> Column:
    head = F.concat(F.lit("### Instruction:\n"), text(instr))
    mid = F.when(text(inp) != "", F.concat(F.lit("\n\n### Input:\n"), text(inp))).otherwise(F.lit(""))
    return F.concat(head, mid, F.lit("\n\n### Response:\n"), text(out))


def user_text(instr: str | Column, inp: str | Column) -> Column:
    i = F.trim(text(inp))
    return F.when(i != "", F.concat(F.trim(text(instr)), F.lit("\n\n"), i)).otherwise(F.trim(text(instr)))


def chat_text(instr: str | Column, inp: str | Column, out: str | Column) -> Column:
    """A row in the public Llama 3 chat format."""
    turn = lambda who, t: F.concat(F.lit(f"<|start_header_id|>{who}<|end_header_id|>\n\n"), t, F.lit("<|eot_id|>"))
    return F.concat(F.lit("<|begin_of_text|>"), turn("user", user_text(instr, inp)), turn("assistant", F.trim(text(out))))


def json_object(c: str | Column) -> Column:
    """From the first brace to the last, fences aside; empty if there is none."""
    return F.regexp_extract(F.regexp_replace(text(c), r"```(?:json)?", ""), r"(?s)\{.*\}", 0)


def strip_preamble(c: str | Column) -> Column:
    """An answer without its introduction and markers."""
    out = F.regexp_replace(text(c), r"(?i)^\s*(?:here'?s|here is)(?: the)? (?:corrected|cleaned|punctuated)[^:\n]*:\s*", "")
    return F.trim(F.regexp_replace(out, r"<<<|>>>", ""))


def slug(c: str | Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.trim(text(c)), r"[^a-zA-Z0-9_.-]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(out, F.lit("")), F.lit("dataset"))


def title_rules(c: str | Column) -> Column:
    """Names of the title rules that match."""
    return F.array_compact(F.array(*(F.when(text(c).rlike(p), F.lit(n)) for n, p in C.TITLE_RULES)))


def stable_id(c: str | Column) -> Column:
    return F.left(F.sha1(text(c)), F.lit(12))


def doc_identity(source: str | Column, url: str | Column, title: str | Column, body: str | Column) -> Column:
    """``source|url``, or without a url a digest of source, title and the text's beginning."""
    digest = F.md5(F.concat_ws("|", text(source), text(title), F.left(text(body), F.lit(200))))
    return F.when(text(url) != "", F.concat_ws("|", text(source), text(url))).otherwise(digest)


def iso_day(c: str | Column) -> Column:
    """``yyyymmdd`` with hyphens, else null; no calendar check."""
    return F.when(text(c).rlike("^[0-9]{8}$"), F.regexp_replace(text(c), r"(\d{4})(\d{2})(\d{2})", "$1-$2-$3"))


def parse_date(c: str | Column) -> Column:
    """ISO first, then the written forms, then the first year in the text; else null."""
    s = F.trim(text(c))
    iso = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.regexp_replace(s, "Z$", "+00:00")))
    forms = [F.try_to_timestamp(s, F.lit(f)) for f in ("MMMM yyyy", "yyyy", "MMMM d, yyyy", "MMM yyyy", "M/yyyy", "yyyy-M-d")]
    year = F.regexp_extract(s, r"(\d{4})", 1)
    first = F.when((year != "") & (year != "0000"), F.try_to_timestamp(F.concat(year, F.lit("-01-01"))))
    ok = ~s.rlike(r"^0000")
    return F.when((s != "") & ok, F.coalesce(iso, *forms, first))


def video_id(c: str | Column) -> Column:
    """From a url's ``v``, or a bare id; else empty."""
    t = F.trim(text(c))
    return F.when(t.rlike("^[A-Za-z0-9_-]{11}$"), t).otherwise(F.regexp_extract(t, "[?&]v=([A-Za-z0-9_-]{11})", 1))


def vtt_cues(c: str | Column) -> Column:
    return F.size(F.filter(F.split(text(c), "\n"), lambda x: F.contains(x, F.lit("-->"))))


def vtt_text(c: str | Column) -> Column:
    """Spoken text of WebVTT: no header, cue lines, notes and tags; a line equal to the one before
    it is left out."""
    lines = F.transform(F.split(text(c), r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"<[^>]*>", "")))
    said = F.filter(lines, lambda x: (x != "") & ~F.contains(x, F.lit("-->")) & ~x.rlike(r"^(WEBVTT|NOTE|Kind:|Language:|STYLE)") & ~x.rlike(r"^\d+$"))
    return let(said, lambda s: F.array_join(F.filter(s, lambda x, i: (i == 0) | (x != F.get(s, i - 1))), " "))


def sentences(c: str | Column) -> Column:
    """Cut after ``.``, ``!`` or ``?`` and white space where a capital follows, quoted or not."""
    out = F.transform(F.split(text(c), "(?<=[.!?])\\s+(?=[\"'“‘(\\[]?[A-Z])"), lambda s: F.trim(s))
    return F.filter(out, lambda s: s != "")


def vocab_overlap(c: str | Column, vocabulary: tuple[str, ...]) -> Column:
    """Share of a vocabulary that a text's tokens cover."""
    if not vocabulary:
        return F.lit(0.0)
    own = F.array_distinct(words(F.lower(text(c))))
    return F.size(F.array_intersect(own, F.lit(list(dict.fromkeys(vocabulary))))) / len(set(vocabulary))


def compliance(c: str | Column, least: int, most: int, banned: tuple[str, ...]) -> Column:
    """What a text breaks of its format: too short, too long, prohibited phrases."""
    n, low = word_count(c), F.lower(text(c))
    issues = [F.when(n < least, F.lit("too short")), F.when(n > most, F.lit("too long"))]
    issues += [F.when(F.contains(low, F.lit(b.lower())), F.lit(f"prohibited: {b}")) for b in banned]
    return F.array_compact(F.array(*issues))
