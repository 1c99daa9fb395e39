"""Chunks, training rows and their cleaning."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import analytics as A
from textloom.operators import chunk
from textloom.operators import quality as Q
from textloom.plans import config as C
from textloom.plans.registry import by_sentences, cap, count, footer, has_any, punct, query, read, strip, truncated, words


def _windows(size: int, step: int, whole: bool) -> str:
    w = words("coalesce(text, '')")
    made = f"select doc_id, i as chunk_index, array_to_string(w[i * {step} + 1 : i * {step} + {size}], ' ') as t from (select doc_id, w, unnest(range(cast(ceil(len(w) / {step}.0) as bigint))) as i from (select doc_id, {w} as w, text from documents)"
    if whole:
        return f"select doc_id, 0 as chunk_index, coalesce(text, '') as t from documents where {count("coalesce(text, '')")} <= {size} union all {made} where len(w) > {size})"
    return made + ")"


def _chunk_sql(size: int, step: int, whole: bool) -> str:
    return f"select doc_id, cast(chunk_index as bigint) as chunk_index, md5(t) as digest, {count('t')} as word_count from ({_windows(size, step, whole)}) where length(trim(t)) > 0"


def _chunks(spark, d, c):
    out = chunk.explode_chunks(read(spark, d, "documents"), c, "doc_id")
    return out.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("chunk_text").alias("digest"), F.col("word_count").cast("long").alias("word_count"))


@query(_chunk_sql(500, 500, False))
def chunk_fixed_500(spark, d):
    return _chunks(spark, d, chunk.fixed("text"))


@query(_chunk_sql(500, 450, True))
def chunk_overlap_500_50(spark, d):
    return _chunks(spark, d, chunk.overlapping("text"))


@query(_chunk_sql(200, 195, False))
def window_200_5(spark, d):
    return _chunks(spark, d, chunk.punctuation_windows("text"))


@query(f"select source, count(*) as n_chunks, cast(sum(n) as bigint) as n_words, count(distinct doc_id) as n_docs from (select doc_id, source, {count('t')} as n from ({_windows(500, 500, False)}) join documents using (doc_id)) group by source")
def chunk_word_counts_by_source(spark, d):
    c = chunk.explode_chunks(read(spark, d, "documents"), chunk.fixed("text"), "doc_id", "source")
    return c.groupBy("source").agg(F.count("*").alias("n_chunks"), F.sum("word_count").alias("n_words"), F.count_distinct("doc_id").alias("n_docs"))


@query(f"select concat_ws('_', source, doc_id, chunk_index) as id, {count('t')} as word_count from ({_windows(500, 500, False)}) join documents using (doc_id) where {count('t')} > 100")
def chunk_explode_nonblank(spark, d):
    c = chunk.explode_chunks(read(spark, d, "documents"), chunk.fixed("text"), "doc_id", "source").where("word_count > 100")
    return c.select(chunk.chunk_id("source", "doc_id").alias("id"), F.col("word_count").cast("long").alias("word_count"))


_LONG = f"""long as (select doc_id, source, {strip("text")} as body from documents where {count("coalesce(text, '')")} >= {C.MIN_WORDS} and length({strip("text")}) >= {C.MIN_CHARS} and not contains(text, chr(65533)))"""


def _labelled(topic: str) -> str:
    """Training rows of (doc_id, p: the list of a document's pieces, in table ``pieces``)."""
    return f"""select doc_id, i::int as part, len(p)::int as parts, '{C.instruction()}' || {topic} || case when len(p) = 1 then '' else ' (part ' || i || ' of ' || len(p) || ')' end as instruction, '' as input, p[i] as output
from (select *, unnest(range(1, len(p) + 1)) as i from pieces)"""


_HEAD = f"left(rest, {C.SFT_CHARS})"


@query(f"""with recursive {_LONG}, cut as (select doc_id, 0 as i, body as rest, cast(null as varchar) as piece from long
union all select doc_id, i + 1, regexp_replace(substr(rest, z + 1), '^\\s+', ''), regexp_replace(left(rest, z), '\\s+$', '') from (
  select *, case when length(rest) <= {C.SFT_CHARS} then length(rest) when contains({_HEAD}, chr(10) || chr(10)) and length({_HEAD}) - instr(reverse({_HEAD}), chr(10) || chr(10)) - 1 >= {C.SFT_CHARS // 5}
  then length({_HEAD}) - instr(reverse({_HEAD}), chr(10) || chr(10)) - 1 else {C.SFT_CHARS} end as z from cut where rest <> '')),
pieces as (select doc_id, list_reduce(list([piece] order by i), lambda a, b: case when length(b[1]) < {C.MIN_CHARS} and length(a[-1]) + 2 + length(b[1]) <= {C.SFT_CHARS} then list_concat(a[:-2], [a[-1] || chr(10) || chr(10) || b[1]]) else list_concat(a, b) end) as p from cut where piece <> '' group by doc_id)
{_labelled(f"'{C.DEFAULT_TOPIC}'")}""")
def sft_lines(spark, d):
    return chunk.training_rows(read(spark, d, "documents"), F.lit(None).cast("string"), "source", "text")


@query(f"with {_LONG}, pieces as (select doc_id, {by_sentences('body', 600)} as p from long) {_labelled("'Topic ' || doc_id")}")
def sentence_chunks(spark, d):
    return chunk.training_rows(read(spark, d, "documents"), F.concat(F.lit("Topic "), "doc_id"), "source", "text", 600, sentence_aware=True)


@query(r"""with s as (select doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+(["''“‘(\[]?[A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') as s from documents),
p as (select doc_id, list_reduce(list_transform(s, lambda x: [x]), lambda a, b: case when length(a[-1]) + 1 + length(b[1]) <= 600 then list_concat(a[:-2], [a[-1] || ' ' || b[1]]) else list_concat(a, b) end) as p from s where len(s) > 0)
select doc_id, unnest(range(len(p)))::int as i, unnest(p) as piece from p""")
def sentence_pack(spark, d):
    return read(spark, d, "documents").select("doc_id", F.posexplode(chunk.pack_sentences("text", 600)).alias("i", "piece"))


def _rows(spark, d):
    """Conversations as training rows: the turn is the part."""
    c = read(spark, d, "conversations")
    n = F.count("*").over(Window.partitionBy("conv_id"))
    head = F.concat(F.lit(C.instruction()), F.lit("Talk "), F.col("conv_id"))
    part = F.concat(F.lit(" (part "), F.col("turn") + 1, F.lit(" of "), n, F.lit(")"))
    echo = F.concat(F.lit(C.instruction()), F.left("text", F.lit(100)), F.lit("..."))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "conv_id", F.col("turn").alias("part"), F.when(F.col("turn") == 3, echo).otherwise(F.concat(head, part)).alias("instruction"), F.lit("").alias("input"), F.col("text").alias("output"))


_ROWS = f"""rows as (select conv_id * 1000 + turn as doc_id, conv_id, turn as part, case when turn = 3 then '{C.instruction()}' || left(text, 100) || '...'
else '{C.instruction()}Talk ' || conv_id || ' (part ' || (turn + 1) || ' of ' || count(*) over (partition by conv_id) || ')' end as instruction, text as output from conversations)"""


_EXPANDED = f"""split as (select doc_id, instruction, output, {by_sentences(strip("output"), 400)} as p from rows),
topics as (select *, coalesce(nullif(trim(regexp_replace(trim(regexp_replace(instruction, '(?i)^Write in the style of {C.AUTHOR} about:\\s*', '')), '(?i)\\s*\\(part\\s+(\\d+)\\s+of\\s+(\\d+)\\)\\s*$', '')), ''), nullif(trim(instruction), ''), 'this topic') as topic from split),
expanded as (select doc_id, case when len(p) > 1 then '{C.instruction()}' || topic || ' (part ' || i || ' of ' || len(p) || ')' else instruction end as instruction, '' as input, case when len(p) > 1 then p[i] else output end as output, len(p)::int as parts
from (select *, unnest(range(1, greatest(len(p), 1) + 1)) as i from topics))"""


@query(f"with {_ROWS}, {_EXPANDED} select * from expanded")
def sft_expand(spark, d):
    return chunk.expand_rows(_rows(spark, d), 400)


@query("select conv_id, string_agg(text, '' order by turn) as body, count(*) as parts from conversations group by conv_id")
def stitch_parts(spark, d):
    return Q.stitch(read(spark, d, "conversations"), "conv_id", "turn", "text")


@query(f"""with {_ROWS} select doc_id from rows where instruction like '%...' and length(regexp_replace(substr(instruction, {len(C.instruction()) + 1}), '[. …]+$', '')) >= 40
and starts_with(lower(left(trim(output), 80)), left(lower(left(trim(regexp_replace(substr(instruction, {len(C.instruction()) + 1}), '[. …]+$', '')), 60)), length(trim(output))))""")
def echo_bug_rows(spark, d):
    return _rows(spark, d).where(Q.is_echo("instruction", "output")).select("doc_id")


@query(f"with {_ROWS} select doc_id from rows where {has_any('output', C.JUNK)} or contains(output, chr(65533)) or length(trim(output)) < 80")
def junk_rows(spark, d):
    return _rows(spark, d).where(Q.is_junk("instruction", "output")).select("doc_id")


_SAID = "case doc_id % 4 when 0 then 'Hi, my name is Ann. ' when 1 then 'Welcome to the show. ' when 2 then 'I''m the CEO of a firm with jo. ' else '' end || coalesce(text, '')"


@query(f"with t as (select doc_id, {_SAID} as t from documents) select doc_id from t where regexp_matches(lower(left(t, 300)), '{C.GUEST.replace(chr(39), chr(39) * 2)}') and not contains(lower(left(t, 300)), 'with jo')")
def guest_openers(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.expr(_SAID.replace("I''m", "I\\'m")).alias("t"))
    return docs.where(Q.is_guest_opener("t", ("with jo",))).select("doc_id")


@query(f"with t as (select doc_id, {_SAID} as t from documents) select doc_id from t where {has_any('left(t, 400)', C.INTRO_PHRASES)}")
def podcast_intros(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.expr(_SAID.replace("I''m", "I\\'m")).alias("t"))
    return docs.where(Q.is_podcast_intro("t")).select("doc_id")


@query(f"""with {_ROWS} select count(*) as n_rows, count(*) filter (length(output) < 80) as n_short, count(*) filter ({has_any('output', C.AUDIT_INTRO_PHRASES)}) as n_intro,
count(*) filter (regexp_matches(instruction, '\\(part\\s+\\d+\\s+of\\s+([2-9]|\\d\\d+)\\)\\s*$')) as n_multi_part, count(*) - count(distinct trim(output)) as n_duplicates,
count(*) filter (regexp_matches(lower(left(output, 300)), '{C.GUEST.replace(chr(39), chr(39) * 2)}')) as n_guest,
count(*) filter (instruction like '%...' and length(regexp_replace(substr(instruction, {len(C.instruction()) + 1}), '[. …]+$', '')) >= 40 and starts_with(lower(left(trim(output), 80)), left(lower(left(trim(regexp_replace(substr(instruction, {len(C.instruction()) + 1}), '[. …]+$', '')), 60)), length(trim(output))))) as n_echo,
count(*) filter (len(regexp_extract_all(output, '[\\x{{0400}}-\\x{{04FF}}\\x{{3000}}-\\x{{9FFF}}\\x{{AC00}}-\\x{{D7AF}}]')) / greatest(length(output), 1) > 0.01) as n_cyrillic_cjk, count(*) filter (len(regexp_extract_all(output, '[^\\x00-\\x7f]')) / greatest(length(output), 1) > 0.02) as n_non_ascii,
count(*) filter (regexp_matches(output, '[\\x{{1F300}}-\\x{{1FAFF}}\\x{{2700}}-\\x{{27BF}}]')) as n_emoji, count(*) filter (regexp_matches(output, '#\\w+')) as n_hashtag, count(*) filter (regexp_matches(output, '@\\w+')) as n_mention,
count(*) filter (regexp_matches(output, '(?i)https?://\\S+|pic\\.twitter\\.com/\\S+')) as n_url, count(*) filter (regexp_matches(output, '(?i)\\[(?:music|applause|laughter|crosstalk|inaudible|.{{0,15}}?)\\]')) as n_tag, count(*) filter (regexp_matches(output, '^\\s*\\p{{Ll}}')) as n_lower_start from rows""")
def audit_counters(spark, d):
    return Q.audit_counters(_rows(spark, d))


@query("""select conv_id, count(*) as n from conversations where turn <> 3 group by 1 order by 2 desc, 1 limit 10""")
def series_top10(spark, d):
    """Turn 3 of each conversation is made to repeat itself as its title and is dropped by the echo rule
    before series are counted; here by its number."""
    r = _rows(spark, d).where("part <> 3")
    return r.groupBy(F.split_part(X.base_title("instruction"), F.lit(" "), F.lit(2)).cast("long").alias("conv_id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "conv_id").limit(10)


_BODY = "b as (select conv_id, string_agg(text, '' order by turn) as body, count(*) as parts from conversations group by 1)"


_STYLE = "case when length(body) < 80 then 'other' when {cap} < 0.05 and {punct} < 0.02 then 'transcript' when {cap} >= 0.05 and {punct} >= 0.02 then case when contains(body, chr(10)) or length(body) > 600 then 'blog' else 'tweet' end else 'other' end".format(cap=cap("body"), punct=punct("body"))


@query(f"with {_BODY} select {_STYLE} as class, count(*) as n, cast(sum(length(body)) as bigint) as total_chars, cast(max(length(body)) as bigint) as max_chars, round(avg(length(body)), 4) as avg_chars from b group by 1")
def class_stats(spark, d):
    """Per class of the stitched bodies: how many, and their lengths."""
    b = Q.stitch(read(spark, d, "conversations"), "conv_id", "turn", "text").withColumn("n", F.length("body"))
    return b.groupBy(Q.body_class("body").alias("class")).agg(F.count("*").alias("n"), F.sum("n").alias("total_chars"), F.max("n").cast("long").alias("max_chars"), F.round(F.avg("n"), 4).alias("avg_chars"))


@query(f"with {_BODY} select cast(least(parts, 4) as bigint) as class, count(*) as n, cast(sum(length(body)) as bigint) as total_chars, max(length(body)) as max_chars, round(avg(length(body)), 4) as avg_chars, cast(ceil(sum(length(body)) / 2500) as bigint) as windows, cast(ceil(sum(length(body)) / 2500) * 8 as bigint) as secs from b group by 1")
def repunct_workload(spark, d):
    # lengths of joined texts are sums, so no text is gathered
    b = read(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("n"), F.count("*").alias("parts"))
    w = F.ceil(F.sum("n") / 2500)
    return b.groupBy(F.least("parts", F.lit(4)).cast("long").alias("class")).agg(F.count("*").alias("n"), F.sum("n").alias("total_chars"), F.max("n").cast("long").alias("max_chars"), F.round(F.avg("n"), 4).alias("avg_chars"), w.cast("long").alias("windows"), (w * 8).cast("long").alias("secs"))


@query(f"with {_BODY} select conv_id, length(body) as chars from b order by 2 desc, 1 limit 5")
def class_length_stats(spark, d):
    b = read(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars"))
    return b.select("conv_id", "chars").orderBy(F.desc("chars"), "conv_id").limit(5)


_TAGS = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(output, '{C.STAGE_TAGS}', ' ', 'g'), '[ \t]{{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '^\s+|\s+$', '', 'g')"""
_CLEANED = f"""tagged as (select doc_id, instruction, {_TAGS} as tagged from rows), plain as (select doc_id, instruction, {footer("tagged")} as plain from tagged),
judged as (select doc_id, instruction, plain, {truncated("plain")} as cleaned, ({has_any("instruction", C.JUNK)} or {has_any("plain", C.JUNK)} or contains(instruction, chr(65533)) or contains(plain, chr(65533)) or length(trim(plain)) < 80) as junk from plain),
cleaned as (select *, case when junk then 'junk' when row_number() over (partition by junk, trim(cleaned) order by doc_id, instruction) > 1 then 'duplicate' else 'keep' end as reason from judged)"""


@query(f"with {_ROWS}, {_CLEANED} select doc_id, reason, cleaned from cleaned")
def clean_v1(spark, d):
    return Q.clean_rows(_rows(spark, d)).select("doc_id", "reason", "cleaned")


@query(f"with {_ROWS}, {_CLEANED} select count(*) as rows_in, count(*) filter (reason = 'keep') as rows_out, count(*) filter (reason = 'junk') as dropped_junk, count(*) filter (reason = 'duplicate') as dropped_duplicates, count(*) filter (reason = 'keep' and cleaned <> plain) as truncated_outputs from cleaned")
def cleaning_stats(spark, d):
    return Q.cleaning_stats(Q.clean_rows(_rows(spark, d)))


@query(f"with {_ROWS}, {_EXPANDED}, {_CLEANED.replace('from rows)', 'from expanded)')} select doc_id, instruction, cleaned from cleaned where reason = 'keep'")
def prepare_rows(spark, d):
    """Split first, then cleaned."""
    return Q.prepare(_rows(spark, d), 400).select("doc_id", "instruction", "cleaned")


@query(f"with {_ROWS}, {_EXPANDED} select (select count(*) from rows) as rows_in, count(*) as rows_out, (select count(*) from split where len(p) > 1) as split_from_long from expanded")
def expansion_stats(spark, d):
    r = _rows(spark, d)
    return chunk.expansion_stats(r, chunk.expand_rows(r, 400))


@query()
def repunctuated_bodies(spark, d):
    """A stand-in that gives the text back, but for windows that begin with a vowel, from which it drops
    words: those stay as they were."""
    b = Q.stitch(read(spark, d, "conversations"), "conv_id", "turn", "text")
    return b.select("conv_id", Q.repunctuated("body", _Dropping(), 500).alias("x")).select("conv_id", "x.*")


class _Dropping:
    def generate(self, prompt: str) -> str:
        text = prompt.split("<<<\n", 1)[1].rsplit("\n>>>", 1)[0]
        return "Here's the corrected text: " + ("gone" if text[:1].lower() in "aeiou" else text.upper())


_IS_ECHO = f"""(instruction like '%...' and length(regexp_replace(substr(instruction, {len(C.instruction()) + 1}), '[. …]+$', '')) >= 40
and starts_with(lower(left(trim(output), 80)), left(lower(left(trim(regexp_replace(substr(instruction, {len(C.instruction()) + 1}), '[. …]+$', '')), 60)), length(trim(output)))))"""
_GUEST = "regexp_matches(lower(left(body, 300)), '" + C.GUEST.replace("'", "''") + "')"
_FOREIGN = r"len(regexp_extract_all(body, '[\x{0400}-\x{04FF}\x{3000}-\x{9FFF}\x{AC00}-\x{D7AF}]')) / greatest(length(body), 1) <= 0.01"


@query(f"""with {_ROWS}, whole as (select conv_id, string_agg(output, '' order by part) as body from rows where not {_IS_ECHO} group by conv_id),
own as (select * from whole where not {_GUEST} and not {has_any('left(body, 400)', C.INTRO_PHRASES)} and {_FOREIGN}),
plain as (select conv_id, trim(regexp_replace(regexp_replace(regexp_replace({footer(f"regexp_replace(body, '{C.URLS}', '', 'g')")}, '{C.FILLERS}', '', 'g'), '[ \\t]{{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')) as body from own),
styled as (select 'Talk ' || conv_id as title, body, {_STYLE} as style from plain where length(body) >= {C.MIN_CHARS}),
cut as (select title, style, list_filter({by_sentences(strip('body'), C.SFT_CHARS)}, lambda x: length(x) >= {C.MIN_CHARS}) as p from styled)
select title, style, i::int as part, len(p)::int as parts, '{C.instruction()}' || title || case when len(p) = 1 then '' else ' (part ' || i || ' of ' || len(p) || ')' end as instruction, p[i] as output from (select *, unnest(range(1, len(p) + 1)) as i from cut)""")
def clean_v2(spark, d):
    r = _rows(spark, d).withColumn("title", F.concat(F.lit("Talk "), "conv_id"))
    return Q.clean_bodies(r.select("title", "part", "instruction", "output"))


@query("select conv_id, turn, row_number() over (partition by conv_id, role order by turn) - 1 as role_idx, count(*) over (partition by conv_id, role) as role_total from conversations")
def occurrence_index(spark, d):
    w = Window.partitionBy("conv_id", "role")
    return read(spark, d, "conversations").select("conv_id", "turn", (F.row_number().over(w.orderBy("turn")) - 1).cast("long").alias("role_idx"), F.count("*").over(w).alias("role_total"))


@query("select source, doc_id from (select source, doc_id, row_number() over (partition by source order by doc_id) as r from documents) where r <= 3")
def first_n_per_group(spark, d):
    first = F.slice(F.array_sort(F.collect_set("doc_id")), 1, 3)
    # the least three combine over salted partial sets, so a large source is not gathered at once
    docs = read(spark, d, "documents").select("source", "doc_id").withColumn("s", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    part = docs.groupBy("source", "s").agg(first.alias("f")).select("source", F.explode("f").alias("doc_id"))
    return part.groupBy("source").agg(first.alias("f")).select("source", F.explode("f").alias("doc_id"))


@query("select conv_id, count(*) as n_kept from (select conv_id, role, lag(role) over (partition by conv_id order by turn) as before from conversations) where before is null or before <> role group by conv_id")
def adjacent_dedup(spark, d):
    c = read(spark, d, "conversations").withColumn("before", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.where("before is null or before <> role").groupBy("conv_id").agg(F.count("*").alias("n_kept"))


@query("""select doc_id, case when length(t) <= 680 then t when rf > 340 then left(h, rf + 1) else regexp_replace(h, '\\s+\\S*$', '') || '…' end as anchor from
(select doc_id, t, left(t, 680) as h, case when contains(left(t, 680), '. ') then length(left(t, 680)) - instr(reverse(left(t, 680)), ' .') - 1 else -1 end as rf from (select min(doc_id) as doc_id, trim(any_value(text)) as t from documents where len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) >= 32 and doc_id in (select min(doc_id) from documents group by left(sha256(left(text, 240)), 16)) group by text)) order by doc_id limit 400""")
def style_anchors(spark, d):
    """Texts of 32 words or more, one per beginning, cut to a size; the first 400."""
    docs = read(spark, d, "documents").where("text is not null")
    first = docs.groupBy(F.left(F.sha2(F.left("text", F.lit(240)), 256), F.lit(16)).alias("k")).agg(F.min("doc_id").alias("doc_id"))
    own = docs.join(first.select("doc_id"), "doc_id", "left_semi").where(X.word_count("text") >= 32)
    return own.orderBy("doc_id").limit(400).select("doc_id", X.truncate_anchor("text").alias("anchor"))


@query(f"select doc_id from documents where {count("coalesce(text, '')")} >= 80 order by doc_id limit 500")
def reference_sample(spark, d):
    return read(spark, d, "documents").where(X.word_count("text") >= 80).orderBy("doc_id").limit(500).select("doc_id")


@query(f"""select doc_id, case when length(coalesce(text, '')) <= 2000 then coalesce(text, '') else regexp_replace(left(text, 2000), '\\s+$', '') || chr(10) || chr(10) || '[Truncated for training.]' end as cut from documents""")
def truncate_output(spark, d):
    return read(spark, d, "documents").select("doc_id", X.truncate("text").alias("cut"))
