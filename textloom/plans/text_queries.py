"""Text functions over the documents, pages and conversations. Inputs are decorated in the query where
the tables lack what a rule looks for, with the same text in the SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions import udfs
from textloom.operators import quality as Q
from textloom.plans import config as C
from textloom.plans.registry import SPACES, cap, clean_markdown, count, footer, punct, query, quoted, read, strip, unescape
from textloom.sources import readers

_MARKED = "concat('**', coalesce(text, ''), '** [here](/p/', doc_id, ') [out](https://x.io/a) now &amp; `code` __x__ &lt;b&gt; &nbsp; AT&amp;T caf&eacute; it&rsquo;s&mdash;so&hellip; &#8217;&#x2014; &nosuch; &amp;amp;')"


@query(f"select doc_id, {clean_markdown(_MARKED)} as cleaned_text from documents")
def clean_text_markdown(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.expr(_MARKED).alias("m"))
    return docs.select("doc_id", X.clean_markdown("m").alias("cleaned_text"))


@query(rf"""with m as (select doc_id, {_MARKED} as m from documents)
select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({unescape("m")}, '(\*\*|~~|`|##+|__)', ' ', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), 'https?://\S+', '', 'g'), '{SPACES}', ' ', 'g')) as cleaned_text from m""")
def collector_clean(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.expr(_MARKED).alias("m"))
    return docs.select("doc_id", X.clean_collected("m").alias("cleaned_text"))


_SPOKEN = "concat('Um, so uh we went ahead hmm. see https://a.io/x?y=1 or t.co/abc ', coalesce(text, ''), ' aha! pic.twitter.com/q')"


@query(rf"""with s as (select doc_id, {_SPOKEN} as s from documents)
select doc_id, regexp_replace(regexp_replace(s, '{C.URLS}', '', 'g'), '{C.FILLERS}', '', 'g') as scrubbed, len(regexp_extract_all(s, '{C.FILLERS}')) as n_fillers from s""")
def scrub_urls_fillers(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.expr(_SPOKEN).alias("s"))
    return docs.select("doc_id", X.scrub_fillers(X.scrub_urls("s")).alias("scrubbed"), X.filler_count("s").cast("long").alias("n_fillers"))


@query()
def strip_stutters(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.concat(F.lit("um, the the the cat, you know, i I go "), X.text("text")).alias("s"))
    return docs.select("doc_id", X.strip_fillers("s").alias("plain"))


_TAGGED = "concat('[Music]  Hello   there [loud applause] ', text, chr(10), chr(10), chr(10), chr(10), 'end  ', chr(10), '[not a tag] ')"


@query(rf"""select conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_TAGGED}, '{C.STAGE_TAGS}', ' ', 'g'), '[ \t]{{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'),
'[ \t]+\n', chr(10), 'g'), '^\s+|\s+$', '', 'g') as plain from conversations""")
def transcript_markup_scrub(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", F.expr(_TAGGED).alias("t"))
    return c.select("conv_id", "turn", X.scrub_stage_tags("t").alias("plain"))


def _nodes(x: str) -> str:
    """Text nodes in SQL: what stands between tags and comments, without scripts and styles."""
    bare = f"regexp_replace({x}, '(?s)<script.*?</script>|<style.*?</style>', '<x>', 'g')"
    return f"list_transform(list_filter(string_split_regex({bare}, '(?s)<!--.*?-->|<[^>]*>'), lambda x: x <> ''), lambda x: {unescape('x')})"


def _said(x: str) -> str:
    return f"array_to_string(list_filter(list_transform({_nodes(x)}, lambda x: {strip('x')}), lambda x: x <> ''), ' ')"


@query(f"select page_id, array_to_string({_nodes('html')}, ' ') as plain from pages")
def strip_html_pages(spark, d):
    return read(spark, d, "pages").select("page_id", udfs.strip_html("html").alias("plain"))


_PAGE = """case when page_id % 3 = 0 then replace(replace(html, '<article>', '<article><div class="x entry-content"><div>in</div>'), '</article>', '</div>tail</article>') else html end"""


@query(rf"""with p as (select page_id, url, {_PAGE} as h from pages), c as (select *, case when page_id % 3 = 0 then regexp_extract(h, '(?s)entry-content">(.*)</div>tail', 1) when contains(h, '<article') then regexp_extract(h, '(?s)<article[^>]*>(.*?)</article>', 1) else h end as b from p)
select page_id, case when contains(h, '<h1') then {_said("regexp_extract(h, '(?s)<h1[^>]*>(.*?)</h1>', 1)")} else url end as title, {_said("b")} as body from c""")
def article_extract(spark, d):
    pages = read(spark, d, "pages").select("page_id", "url", F.expr(_PAGE).alias("h"))
    return pages.select("page_id", udfs.extract_article("h", "url").alias("a")).select("page_id", "a.*")


_SIGNED = "concat(coalesce(text, ''), case doc_id % 3 when 0 then concat(chr(10), '- Apples are good', chr(10), 'and so on', chr(10)) when 1 then concat(chr(10), 'Related Posts', chr(10), 'more', chr(10)) else concat(chr(10), ' READ  MORE', chr(10), chr(10), 'READ MORE ', chr(10), chr(8212), ' Ann said') end)"


@query(f"select doc_id, {footer(_SIGNED)} as plain from documents")
def footer_scrub(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.expr(_SIGNED.replace("chr(8212)", "'\u2014'")).alias("t"))
    return docs.select("doc_id", udfs.strip_footer("t").alias("plain"))


_CASES = "map([" + quoted(w.lower() for w in C.CASING) + "], [" + quoted(C.CASING) + "])"


@query(rf"""with t as (select doc_id, list_transform(regexp_extract_all('i think saas and ai. i''m sure ' || lower(coalesce(text, '')), '[\pL\pN_'']+|[^\pL\pN_'']+'), lambda w: coalesce({_CASES}[w], w)) as w from documents),
s as (select doc_id, string_split(regexp_replace(array_to_string(w, ''), '((?:^|[.!?]\s+|\n\s*))([a-z])', '\1' || chr(1) || '\2', 'g'), chr(1)) as p from t),
u as (select doc_id, p[1] || array_to_string(list_transform(p[2:], lambda x: upper(left(x, 1)) || substr(x, 2)), '') as x from s)
select doc_id, array_to_string(list_transform(regexp_extract_all(x, '[\pL\pN_'']+|[^\pL\pN_'']+'), lambda w: case when w = 'i' then 'I' when regexp_matches(w, '^i''[a-z]') then 'I' || substr(w, 2) else w end), '') as cased from u""")
def restore_casing(spark, d):
    return read(spark, d, "documents").select("doc_id", udfs.restore_casing(F.concat(F.lit("i think saas and ai. i'm sure "), F.lower(X.text("text")))).alias("cased"))


_TITLES = "case doc_id % 4 when 0 then '' when 1 then null else 'T' || doc_id end"


@query(f"""with b as (select coalesce(nullif({_TITLES}, ''), 'Blog post') as title, '2024' as date, 'u' || doc_id as url, trim(coalesce(text, '')) as text, 'blog' as source from documents),
l as (select left(trim(text), 120) || case when length(trim(text)) > 120 then '...' else '' end as title, '' as date, '' as url, trim(text) as text, 'linkedin' as source from conversations),
x as (select left(trim(text), 120) || case when length(trim(text)) > 120 then '...' else '' end as title, '' as date, 'c' || conv_id as url, trim(text) as text, 'x' as source from conversations where turn % 2 = 0 and length(trim(text)) >= 25)
select source, count(*) as n, count(distinct title) as n_titles, cast(sum(length(title)) as bigint) as title_chars, cast(sum(length(text)) as bigint) as text_chars from (select * from b union all select * from l union all select * from x) where text <> '' group by source""")
def normalize_sources(spark, d):
    docs, talk = read(spark, d, "documents"), read(spark, d, "conversations")
    blog = readers.from_blog(docs.selectExpr(f"{_TITLES} as title", "'2024' as date", "concat('u', doc_id) as url", "text as content", "cast(null as string) as text"))
    posts = readers.from_linkedin(talk.selectExpr("text as content", "'' as published_text"))
    short = readers.from_x(talk.selectExpr("text", "concat('c', conv_id) as url", "'' as created_at", "turn % 2 = 1 as is_reply", "false as is_repost_or_quote"))
    every = blog.unionByName(posts).unionByName(short)
    return every.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("title").alias("n_titles"), F.sum(F.length("title")).cast("long").alias("title_chars"), F.sum(F.length("text")).cast("long").alias("text_chars"))


@query("""select event_id, coalesce(k, 'none') as kind, case k when 'iso' then ts::timestamp when 'month' then date_trunc('month', ts) when 'year' then date_trunc('year', ts) when 'day' then date_trunc('day', ts) when 'words' then date_trunc('year', ts) end::varchar as parsed
from (select *, case event_id % 6 when 0 then 'iso' when 1 then 'month' when 2 then 'year' when 3 then 'day' when 4 then 'words' end as k from events)""")
def parse_dates(spark, d):
    """Each event's time written in one of several forms, and read again."""
    k = F.col("event_id") % 6
    forms = {0: ("iso", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), 1: ("month", "MMMM yyyy"), 2: ("year", "yyyy"), 3: ("day", "MMMM d, yyyy"), 4: ("words", "'around' yyyy 'or so'")}
    written, kind = F.lit("2 weeks ago"), F.lit("none")
    for n, (name, form) in forms.items():
        written, kind = F.when(k == n, F.date_format("ts", form)).otherwise(written), F.when(k == n, name).otherwise(kind)
    return read(spark, d, "events").select("event_id", kind.alias("kind"), X.parse_date(written).cast("timestamp_ntz").cast("string").alias("parsed"))


@query(f"""select doc_id, {cap("coalesce(text, '')")} as cap_rate, {punct("coalesce(text, '')")} as punct_rate,
case when length(coalesce(text, '')) < 80 then 'other' when {cap("coalesce(text, '')")} < 0.05 and {punct("coalesce(text, '')")} < 0.02 then 'transcript'
when {cap("coalesce(text, '')")} >= 0.05 and {punct("coalesce(text, '')")} >= 0.02 then case when contains(text, chr(10)) or length(text) > 600 then 'blog' else 'tweet' end else 'other' end as class from documents""")
def classify_bodies(spark, d):
    return read(spark, d, "documents").select("doc_id", X.cap_rate("text").alias("cap_rate"), X.punct_rate("text").alias("punct_rate"), Q.body_class("text").alias("class"))


_AUDIT = f"""case when t = '' then 'empty' when length(t) < 280 and (regexp_matches(t, '#\\w+') or (not contains(t, chr(10)) and caps and punct)) then 'tweet_or_short_post'
when caps and punct and contains(t, chr(10)) then 'blog_post_chunk' when not caps and not punct then 'transcript_chunk' else 'other' end"""


@query(f"""with c as (select text as t, {cap("text")} > 0.05 as caps, {punct("text")} > 0.02 as punct from (select coalesce(text, '') as text from documents))
select {_AUDIT} as class, count(*) as n, round(100.0 * count(*) / (select count(*) from documents), 1) as percent, median(length(t)) as median_chars, max(length(t)) as max_chars from c group by 1""")
def audit_class(spark, d):
    docs = read(spark, d, "documents")
    return docs.groupBy(Q.audit_class("text").alias("class")).agg(F.count("*").alias("n"), F.round(100.0 * F.count("*") / docs.agg(F.count("*")).scalar(), 1).alias("percent"), F.median(F.length(X.text("text"))).alias("median_chars"), F.max(F.length(X.text("text"))).cast("long").alias("max_chars"))


@query(r"""with t as (select doc_id, coalesce(text, '') || case when doc_id % 3 = 0 then ' #tag @me https://a.b [Music] Жук 🚀' else '' end as t from documents)
select count(*) filter (len(regexp_extract_all(t, '[\x{0400}-\x{04FF}\x{3000}-\x{9FFF}\x{AC00}-\x{D7AF}]')) / greatest(length(t), 1) > 0.01) as cyrillic_cjk,
count(*) filter (len(regexp_extract_all(t, '[^\x00-\x7f]')) / greatest(length(t), 1) > 0.02) as non_ascii, count(*) filter (regexp_matches(t, '[\x{1F300}-\x{1FAFF}\x{2700}-\x{27BF}]')) as emoji, count(*) filter (regexp_matches(t, '#\w+')) as hashtag, count(*) filter (regexp_matches(t, '@\w+')) as mention,
count(*) filter (regexp_matches(t, '(?i)https?://\S+|pic\.twitter\.com/\S+')) as url, count(*) filter (regexp_matches(t, '(?i)\[(?:music|applause|laughter|crosstalk|inaudible|.{0,15}?)\]')) as tag, count(*) filter (regexp_matches(t, '^\s*\p{Ll}')) as lower_start from t""")
def script_share_flags(spark, d):
    docs = read(spark, d, "documents").select(F.concat(X.text("text"), F.when(F.col("doc_id") % 3 == 0, " #tag @me https://a.b [Music] Жук 🚀").otherwise("")).alias("t"))
    return docs.agg(*(F.count_if(c).alias(k) for k, c in Q.script_flags("t").items()))


_BANNED = ("the thing", "Worthless", "in ")


@query(f"""with t as (select doc_id, coalesce(text, '') as t from documents) select doc_id, list_filter([case when {count("t")} < 100 then 'too short' end, case when {count("t")} > 300 then 'too long' end,
{", ".join(f"case when contains(lower(t), {quoted([b.lower()])}) then 'prohibited: {b}' end" for b in _BANNED)}], lambda x: x is not null) as issues from t""")
def compliance_issues(spark, d):
    return read(spark, d, "documents").select("doc_id", X.compliance("text", 100, 300, _BANNED).alias("issues"))


@query(f"select conv_id, turn as best_turn, n as n_words from (select conv_id, turn, {count('text')} as n, row_number() over (partition by conv_id order by {count('text')} desc, turn) as r from conversations where role = 'assistant') where r = 1")
def best_draft(spark, d):
    c = read(spark, d, "conversations").where("role = 'assistant'").withColumn("n", X.word_count("text"))
    return c.groupBy("conv_id").agg(F.min(F.struct((-F.col("n")).alias("k"), "turn")).alias("b")).select("conv_id", F.col("b.turn").alias("best_turn"), (-F.col("b.k")).cast("long").alias("n_words"))


_TITLE = "case page_id % 5 when 0 then 'AMA with a founder' when 1 then 'Workshop  Wednesday: keynote' when 2 then '10 ways to sell' when 3 then '5 more interesting learnings' else 'Dramatic plans' end"


@query(f"""select page_id, list_filter([{", ".join(f"case when regexp_matches({_TITLE}, '{p}') then '{n}' end" for n, p in C.TITLE_RULES)}], lambda x: x is not null) as rules from pages""")
def title_keywords(spark, d):
    return read(spark, d, "pages").select("page_id", X.title_rules(F.expr(_TITLE)).alias("rules"))


@query(r"select page_id, coalesce(nullif(regexp_replace(regexp_replace(trim(url), '[^a-zA-Z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'dataset') as slug, split_part(url, '#', 1) as page_url from pages")
def slugify(spark, d):
    return read(spark, d, "pages").select("page_id", X.slug("url").alias("slug"), F.split_part("url", F.lit("#"), F.lit(1)).alias("page_url"))


@query("select doc_id, substring(coalesce(text, ''), 1, 200) as snippet from documents where source = 'src3' order by doc_id limit 10")
def snippet(spark, d):
    return read(spark, d, "documents").where("source = 'src3'").orderBy("doc_id").limit(10).select("doc_id", F.substring(X.text("text"), 1, 200).alias("snippet"))


@query("select doc_id, lang from documents where source = 'src1' and lang = 'en'")
def metadata_filter(spark, d):
    return read(spark, d, "documents").where("source = 'src1' and lang = 'en'").select("doc_id", "lang")


@query("""select doc_id, left(sha1(coalesce(text, '')), 12) as stable_id, case when doc_id % 2 = 0 then source || '|u' || doc_id else md5(source || '||' || left(coalesce(text, ''), 200)) end as identity from documents""")
def doc_identity(spark, d):
    url = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("u"), "doc_id"))
    return read(spark, d, "documents").select("doc_id", X.stable_id("text").alias("stable_id"), X.doc_identity("source", url, F.lit(""), "text").alias("identity"))


@query("""with p as (select doc_id as id, source, text, 1 as score from documents union all select conv_id, null, text, null from conversations)
select coalesce(source, 'talk') as source, count(*) as n, count(score) as n_scored from p group by 1""")
def pad_union(spark, d):
    a = read(spark, d, "documents").selectExpr("doc_id as id", "source", "text", "'1' as score")
    b = read(spark, d, "conversations").selectExpr("conv_id as id", "text", "'n/a' as score")
    return readers.padded(a, b, source="talk").groupBy("source").agg(F.count("*").alias("n"), F.count("score").alias("n_scored"))


@query(f"""with r as (select 'blog' as source, trim(coalesce(text, '')) as t from documents union all select 'x', trim(text) from conversations where turn % 2 = 0 and length(trim(text)) >= 25)
select source, count(*) as n, count(*) filter ({count("t")} >= 50) as n_long from r where t <> '' group by 1""")
def funnel_normalised(spark, d):
    blog = readers.from_blog(read(spark, d, "documents").selectExpr("'' as title", "'' as date", "'' as url", "text as content", "'' as text"))
    x = readers.from_x(read(spark, d, "conversations").selectExpr("text", "'' as url", "'' as created_at", "turn % 2 = 1 as is_reply", "false as is_repost_or_quote"))
    return blog.unionByName(x).groupBy("source").agg(F.count("*").alias("n"), F.count_if(X.word_count("text") >= 50).alias("n_long"))


@query(f"""select source, {clean_markdown("coalesce(text, '')")} as output, '' as input, case source when 'blog' then '{C.SOURCE_INSTRUCTIONS["blog"]}' when 'podcast' then '{C.SOURCE_INSTRUCTIONS["podcast"]}' when 'saas_video' then '{C.SOURCE_INSTRUCTIONS["saas_video"]}' else '{C.SOURCE_INSTRUCTION}' end as instruction
from (select case doc_id % 4 when 0 then 'blog' when 1 then 'podcast' when 2 then 'saas_video' else source end as source, text from documents)""")
def instruction_rows(spark, d):
    docs = read(spark, d, "documents").selectExpr("case doc_id % 4 when 0 then 'blog' when 1 then 'podcast' when 2 then 'saas_video' else source end as source", "text")
    return docs.select("source", X.clean_markdown("text").alias("output"), F.lit("").alias("input"), Q.source_instruction("source").alias("instruction"))


@query("select split_part(url, '#', 1) as url, min(page_id) as page_id from (select page_id, url || case when page_id % 2 = 0 then '#top' else '' end as url from pages union all select page_id + 1000, url from pages) where split_part(url, '#', 1) <> '' group by 1 order by 2, 1 limit 40")
def ordered_page_urls(spark, d):
    p = read(spark, d, "pages").select("page_id", "url")
    both = p.withColumn("url", F.concat("url", F.when(F.col("page_id") % 2 == 0, "#top").otherwise(""))).unionByName(p.withColumn("page_id", F.col("page_id") + 1000))
    return readers.ordered_urls(both, "url", "page_id", 40)


@query("select page_id, case page_id % 3 when 0 then 'abcdefghi' || lpad(page_id::varchar, 2, '0')[-2:] when 1 then 'v0000000_-' || (page_id % 10) else '' end as video_id from pages")
def video_ids(spark, d):
    id_ = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("abcdefghi"), F.substring(F.lpad(F.col("page_id").cast("string"), 2, "0"), -2, 2))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://y.com/watch?a=b&v=v0000000_-"), F.col("page_id") % 10, F.lit("&t=1"))).otherwise(F.col("url"))
    return read(spark, d, "pages").select("page_id", X.video_id(id_).alias("video_id"))
