"""Profiles, funnels, splits, joins, drift: queries over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import analytics as A
from textloom.operators import joins
from textloom.operators import persona as P
from textloom.plans import config as C
from textloom.plans.registry import POSTS, count, query, quoted, read, words
from textloom.streaming import incremental


def _scores(spark, d):
    return read(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("score"))


@query(f"""with {POSTS} select source, count(*) as n_posts, round(avg(word_count), 4) as avg_words, round(avg(avg_sentence_length), 4) as avg_sentence_length,
round(avg(vocabulary_richness), 6) as avg_richness, round(avg(formality_score), 6) as avg_formality from posts group by source""")
def style_profile_by_source(spark, d):
    return A.style_profile(A.posts(read(spark, d, "documents")))


@query(f"with {POSTS} select source, count(*) as n_posts, round(avg(word_count), 4) as avg_words, round(avg(formality_score), 6) as avg_formality from posts where is_b2b group by source")
def b2b_source_breakdown(spark, d):
    p = A.posts(read(spark, d, "documents")).where("is_b2b")
    return p.groupBy("source").agg(F.count("*").alias("n_posts"), F.round(F.avg("word_count"), 4).alias("avg_words"), F.round(F.avg("formality_score"), 6).alias("avg_formality"))


_TOP = "select doc_id, cast(coalesce(score, 1) * word_count as bigint) as rank_value from posts left join (select doc_id, max(quality) as score from labels group by 1) using (doc_id) where word_count > 100 order by 2 desc, 1 limit {n}"


@query(f"with {POSTS} {_TOP.format(n=500)}")
def top_quality_posts(spark, d):
    return A.top_quality(A.with_scores(A.posts(read(spark, d, "documents")), _scores(spark, d))).select("doc_id", "rank_value")


@query(f"with {POSTS} {_TOP.format(n=7)}")
def parametrised_top_n(spark, d):
    A.with_scores(A.posts(read(spark, d, "documents")), _scores(spark, d)).createOrReplaceTempView("_posts")
    return spark.sql("select doc_id, cast(coalesce(score, 1) * word_count as bigint) as rank_value from _posts where word_count > 100 order by 2 desc, 1 limit :n", args={"n": 7})


_GLOBAL = "round(coalesce(avg(word_count), 0), 1) as avg_words, round(coalesce(avg(avg_sentence_length), 0), 1) as avg_sentence_length, round(coalesce(avg(vocabulary_richness), 0), 4) as avg_richness, round(coalesce(avg(formality_score), 0), 4) as avg_formality, round(coalesce(avg(question_count), 0), 2) as avg_questions"


@query(f"with {POSTS} select {_GLOBAL} from posts")
def global_style_stats(spark, d):
    return A.posts(read(spark, d, "documents")).selectExpr(*_GLOBAL.split(", round")[:1], *("round" + x for x in _GLOBAL.split(", round")[1:]))


@query(f"with {POSTS} select count(*) as n_posts, count(*) filter (is_b2b) as n_b2b, count(distinct source) as n_sources, round(avg(word_count), 1) as avg_words from posts")
def dashboard_metrics(spark, d):
    return A.posts(read(spark, d, "documents")).agg(F.count("*").alias("n_posts"), F.count_if("is_b2b").alias("n_b2b"), F.count_distinct("source").alias("n_sources"), F.round(F.avg("word_count"), 1).alias("avg_words"))


@query(f"""with {POSTS} select (select count(*) from documents) as n_raw, count(*) as n_kept, count(*) filter (is_b2b) as n_b2b,
(select count(*) from embeddings) as n_vectors, (select count(*) filter (coalesce(len(embedding), 0) > 0) from embeddings) as n_embedded from posts""")
def etl_summary(spark, d):
    docs, e = read(spark, d, "documents"), read(spark, d, "embeddings")
    one = A.posts(docs).agg(F.count("*").alias("n_kept"), F.count_if("is_b2b").alias("n_b2b"))
    full = F.coalesce(F.size("embedding"), F.lit(0)) > 0
    return one.withColumns({"n_raw": docs.agg(F.count("*")).scalar(), "n_vectors": e.agg(F.count("*")).scalar(), "n_embedded": e.agg(F.count_if(full)).scalar()})


@query("select coalesce(nullif(source, ''), 'unknown') as source, count(*) as n, count(distinct doc_id) as n_docs from documents group by 1")
def rows_per_source(spark, d):
    s = F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown"))
    return read(spark, d, "documents").groupBy(s.alias("source")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query(f"""select coalesce(source, 'TOTAL') as source, count(*) as n_raw, count(*) filter ({count("coalesce(text,'')")} > 0) as n_text, count(*) filter ({count("coalesce(text,'')")} >= 50) as n_long
from documents group by rollup (source)""")
def source_funnel_rollup(spark, d):
    return A.funnel(read(spark, d, "documents"))


_SPLIT = """s as (select doc_id, source, row_number() over (partition by source order by md5('298:' || doc_id), doc_id) as r, count(*) over (partition by source) as n from documents),
split as (select doc_id, source, case when r <= round(n * 0.8) then 'train' when r <= round(n * 0.8) + round(n * 0.1) then 'val' else 'test' end as split from s)"""


@query(f"with {_SPLIT} select * from split")
def split_assign(spark, d):
    return A.splits(read(spark, d, "documents").select("doc_id", "source"))


@query(f"with {_SPLIT} select source, count(*) filter (split = 'train') as train, count(*) filter (split = 'val') as val, count(*) filter (split = 'test') as test from split group by source")
def split_pivot(spark, d):
    s = A.splits(read(spark, d, "documents").select("doc_id", "source"))
    return s.groupBy("source").pivot("split", ["train", "val", "test"]).count().na.fill(0)


@query(f"with {_SPLIT} select split, count(*) as n_chunks from (select doc_id, unnest(range(cast(ceil({count("coalesce(text,'')")} / 500.0) as bigint))) as i from documents) join split using (doc_id) group by split")
def chunk_split_join(spark, d):
    from textloom.operators import chunk

    docs = read(spark, d, "documents")
    chunks = chunk.explode_chunks(docs, chunk.fixed("text"), "doc_id", "source")
    return chunks.join(A.splits(docs.select("doc_id", "source")), ["doc_id", "source"], "left").groupBy("split").agg(F.count("*").alias("n_chunks"))


@query("select doc_id, case when cast('0x' || left(md5('42:' || doc_id), 6) as bigint) % 100 < 10 then 'eval' else 'train' end as part from documents")
def train_holdout(spark, d):
    return A.holdout(read(spark, d, "documents").select("doc_id"))


@query("select doc_id from documents order by md5('7:' || doc_id), doc_id limit 10")
def sample_hash(spark, d):
    return read(spark, d, "documents").orderBy(A.hash_rank("doc_id", 7), "doc_id").limit(10).select("doc_id")


@query("""select source, coalesce(a.n, 0) as n_docs, coalesce(b.n, 0) as n_labelled, coalesce(c.n, 0) as n_good, coalesce(e.n, 0) as n_toxic from
(select source, count(*) n from documents group by 1) a full join (select source, count(*) n from documents join labels using (doc_id) group by 1) b using (source)
full join (select source, count(*) n from documents join labels using (doc_id) where quality = 1 group by 1) c using (source)
full join (select source, count(*) n from documents join labels using (doc_id) where toxic = 1 group by 1) e using (source)""")
def stage_summary_outer(spark, d):
    docs = read(spark, d, "documents")
    x = docs.join(read(spark, d, "labels"), "doc_id")
    return A.stage_summary(("n_docs", docs), ("n_labelled", x), ("n_good", x.where("quality = 1")), ("n_toxic", x.where("toxic = 1")))


@query("""with r as (select *, row_number() over (order by ts, event_id) as r, count(*) over () as n from events)
select case when r <= n // 2 then 'early' else 'late' end as half, count(*) as n, round(avg(value), 6) as mean_value, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.9), 6) as p90 from r group by 1""")
def drift_early_late(spark, d):
    return A.drift(read(spark, d, "events"), "ts", "event_id", "value")


@query("select cast(least(length(coalesce(text, '')) // 1000, 20) as bigint) as bucket, count(*) as n from documents group by 1")
def length_histogram(spark, d):
    b = F.least(F.floor(F.length(X.text("text")) / 1000), F.lit(20))
    return read(spark, d, "documents").groupBy(b.cast("long").alias("bucket")).agg(F.count("*").alias("n"))


@query("select n_chars, round(sum(n) over (order by n_chars) / (select count(*) from documents), 9) as ecdf from (select length(coalesce(text, '')) as n_chars, count(*) as n from documents group by 1)")
def length_ecdf(spark, d):
    docs = read(spark, d, "documents")
    n = docs.groupBy(F.length(X.text("text")).cast("long").alias("n_chars")).agg(F.count("*").alias("n"))
    # lengths are few beside the rows; running sums go by blocks of lengths so that no task has them all
    blocks = n.withColumn("b", F.floor(F.sqrt("n_chars")))
    before = blocks.groupBy("b").agg(F.sum("n").alias("bn")).withColumn("upto", F.sum("bn").over(Window.orderBy("b")) - F.col("bn")).select("b", "upto")
    inside = F.sum("n").over(Window.partitionBy("b").orderBy("n_chars"))
    return blocks.withColumn("s", inside).join(F.broadcast(before), "b").select("n_chars", F.round((F.col("s") + F.col("upto")) / docs.agg(F.count("*")).scalar(), 9).alias("ecdf"))


@query("""select doc_id from (select doc_id, row_number() over (partition by source, lang, text order by doc_id) as r from documents) where r = 1""")
def dedup_exact(spark, d):
    docs = read(spark, d, "documents")
    return docs.groupBy("source", "lang", F.md5(X.text("text")).alias("t"), F.col("text").isNull().alias("z")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("select min(doc_id) as doc_id, count(*) as copies from documents group by trim(coalesce(text, '')) having count(*) > 1")
def dedup_output(spark, d):
    return read(spark, d, "documents").groupBy(F.md5(F.trim(X.text("text"))).alias("t")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).where("copies > 1").select("doc_id", "copies")


@query("select lang, list_sort(list(distinct source)) as sources from documents group by lang")
def ordered_unique(spark, d):
    return read(spark, d, "documents").groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("sources"))


@query(f"select doc_id, len(list_intersect(list_distinct({words("lower(coalesce(text,''))")}), ['the', 'and', 'of', 'der', 'que', 'de'])) / 6 as overlap from documents")
def vocab_intersection(spark, d):
    return read(spark, d, "documents").select("doc_id", X.vocab_overlap("text", ("the", "and", "of", "der", "que", "de")).alias("overlap"))


_OUT = "select 3 * doc_id + k as out_id, case k when 0 then text when 1 then left(text, 200) else text || ' more' end as output from documents, (select unnest([0, 1, 2]) as k) where text <> ''"


def _outputs(docs):
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), t.alias("t")) for k, t in ((0, F.col("text")), (1, F.left("text", F.lit(200))), (2, F.concat("text", F.lit(" more")))))))
    return docs.where("text <> ''").select("doc_id", kinds.alias("x")).select((3 * F.col("doc_id") + F.col("x.k")).alias("out_id"), F.col("x.t").alias("output"))


@query(f"""with o as ({_OUT}), m as (
select out_id, doc_id, 0 as rank, -length(text) as neg from o join documents on text = output
union all select out_id, doc_id, 1, -length(text) from o join documents on starts_with(text, output) and length(text) > length(output)
union all select out_id, doc_id, 2, -length(text) from o join documents on starts_with(output, text) and length(text) < length(output) and text <> '')
select out_id, doc_id as src, coalesce(how, 'none') as how from o left join
(select out_id, doc_id, ['exact', 'starts', 'inside'][rank + 1] as how from m qualify row_number() over (partition by out_id order by rank, neg, doc_id) = 1) using (out_id)""")
def lineage_prefix_match(spark, d):
    """Outputs made of every document: whole, shortened, lengthened."""
    docs = read(spark, d, "documents")
    out = _outputs(docs)
    return joins.match_lineage(out, docs, "output", "text", "out_id", "doc_id").withColumnRenamed("doc_id", "src")


def _top(expr, n, where=""):
    return f"select term, count(*) as n from (select unnest({expr}) as term from documents) {where} group by 1 order by 2 desc, 1 limit {n}"


#: Tokens by another way than the engine's: stretches without white space and marks, without points at
#: their ends and endings after an apostrophe, that are letters throughout.
_LETTERS = r"list_filter(list_transform(string_split_regex(lower(coalesce(text, '')), '[^\pL\pN_./''-]+'), lambda w: regexp_replace(regexp_replace(regexp_replace(w, '^[./-]+|[./''-]+$', '', 'g'), chr(39) || '(s|ll|re|ve|d|m)$', ''), 'n''t$', '')), lambda w: regexp_full_match(w, '\pL{3,}') and not list_contains([" + quoted(C.STOP_WORDS) + "], w))"


@query(_top("regexp_extract_all(lower(coalesce(text, '')), '[a-z]{5,}')", 50, f"where term not in ({quoted(C.PROFILE_STOP_WORDS)})"))
def top_words(spark, d):
    return A.top_terms(P.terms(read(spark, d, "documents"), P.profile_words("text")), 50)


@query(_top(_LETTERS, 50))
def top_content_words(spark, d):
    return A.top_terms(P.terms(read(spark, d, "documents"), P.content_words("text")), 50)


@query(f"""with w as (select {_LETTERS} as w from documents) select term, count(*) as n from
(select unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as term from w) group by 1 order by 2 desc, 1 limit 20""")
def content_bigrams(spark, d):
    docs = read(spark, d, "documents").select(P.content_words("text").alias("w"))
    return A.top_terms(P.terms(docs, P.bigrams(F.col("w"))), 20)


@query(rf"""with s as (select unnest(string_split_regex(coalesce(text, ''), '[.!?]\s+|\n+')) as s from documents), w as (select {words("lower(s)")} as w from s)
select w[1] || ' ' || w[2] as term, count(*) as n from w where len(w) >= 2 group by 1 order by 2 desc, 1 limit 20""")
def starter_bigrams(spark, d):
    return A.top_terms(P.terms(read(spark, d, "documents"), P.starters("text")), 20)


_FRAMED = "lower(coalesce(text, '') || case when doc_id % 7 = 0 then ' In fact, the bottom line: in fact if you' else '' end)"


@query(f"""select term, cast(sum((length(t) - length(replace(t, term, ''))) / length(term)) as bigint) as n from (select {_FRAMED} as t from documents), (select unnest([{quoted(C.FRAMING)}]) as term)
group by 1 having n > 0 order by 2 desc, 1 limit 15""")
def framing_counts(spark, d):
    docs = read(spark, d, "documents").select(F.concat(X.text("text"), F.when(F.col("doc_id") % 7 == 0, " In fact, the bottom line: in fact if you").otherwise("")).alias("text"))
    return P.framing(docs)


_SENTENCES = r"len(list_filter(string_split_regex(coalesce(text, ''), '[.!?]\s+|\n+'), lambda x: trim(x) <> ''))"


@query(f"select count(*) as num_documents, cast(sum({_SENTENCES}) as bigint) as num_sentences, cast(sum(len({_LETTERS})) as bigint) as num_content_words from documents")
def persona_meta_counts(spark, d):
    return read(spark, d, "documents").agg(F.count("*").alias("num_documents"), F.sum(P.sentence_count("text")).cast("long").alias("num_sentences"), F.sum(F.size(P.content_words("text"))).cast("long").alias("num_content_words"))


def _ranked(sql: str) -> str:
    return f"(select list(term order by n desc, term) from ({sql}))"


_STARTERS = rf"""with s as (select unnest(string_split_regex(coalesce(text, ''), '[.!?]\s+|\n+')) as s from documents), w as (select {words("lower(s)")} as w from s)
select w[1] || ' ' || w[2] as term, count(*) as n from w where len(w) >= 2 group by 1 order by 2 desc, 1 limit 20"""
_PAIRS = f"""with w as (select {_LETTERS} as w from documents) select term, count(*) as n from
(select unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as term from w) group by 1 order by 2 desc, 1 limit 20"""
_FRAMES = f"""select term, cast(sum((length(t) - length(replace(t, term, ''))) / length(term)) as bigint) as n from (select lower(coalesce(text, '')) as t from documents), (select unnest([{quoted(C.FRAMING)}]) as term) group by 1 having n > 0 order by 2 desc, 1 limit 15"""


@query(f"""with x as (select (select count(*) from documents) as d, (select cast(sum({_SENTENCES}) as bigint) from documents) as s, (select cast(sum(len({_LETTERS})) as bigint) from documents) as c,
coalesce({_ranked(_top(_LETTERS, 50))}, []) as w, coalesce({_ranked(_PAIRS)}, []) as b, coalesce({_ranked(_STARTERS)}, []) as f, coalesce({_ranked(_FRAMES)}, []) as g)
select to_json({{'num_documents': d, 'num_sentences': s, 'num_content_words': c, 'top_words': w, 'top_bigrams': b, 'starters': f, 'framing': g, 'themes': list_concat(w[1:20], b)}})::varchar as profile from x""")
def persona_profile_json(spark, d):
    return P.profile(read(spark, d, "documents")).select(F.to_json(F.struct("*")).alias("profile"))


@query("select key, count(*) as n from (select unnest(json_keys(props)) as key from events) group by 1 order by 2 desc, 1 limit 20")
def key_presence(spark, d):
    return A.top_terms(read(spark, d, "events").select(F.explode(F.json_object_keys("props")).alias("key")), 20, "key")


@query("select event_id, user_id from events where user_id not in (select user_id from events where event_id < 50 and user_id is not null)")
def seen_anti_join(spark, d):
    e = read(spark, d, "events")
    return incremental.unseen(e, e.where("event_id < 50").select("user_id").distinct(), "user_id").select("event_id", "user_id")


@query("select event_type, case when value < 5 then 'low value' end as error, count(*) as n from events group by 1, 2")
def quarantine_rows(spark, d):
    e = incremental.with_quarantine(read(spark, d, "events"), F.when(F.col("value") < 5, "low value"))
    return e.groupBy("event_type", "error").agg(F.count("*").alias("n"))


@query("select user_id, min(event_id) as event_id from events group by user_id")
def first_event_per_user(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("event_id"))


@query("select event_type, count(distinct event_id) as n from events group by 1")
def incremental_dedup_stream(spark, d):
    """The events as a stream that is read to its end and holds each id once."""
    import uuid

    name = f"events_{uuid.uuid4().hex}"
    stream = spark.readStream.schema(read(spark, d, "events").schema).option("pathGlobFilter", "*").parquet(_as_glob(d))
    q = incremental.new_ids(stream, "event_id").groupBy("event_type").agg(F.count("*").alias("n")).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def _as_glob(d: str) -> str:
    return f"{d}/events.parque[t]"


_MATCHED = f"""o as ({_OUT}), m as (
select out_id, doc_id, 0 as rank, -length(text) as neg from o join documents on text = output
union all select out_id, doc_id, 1, -length(text) from o join documents on starts_with(text, output) and length(text) > length(output)
union all select out_id, doc_id, 2, -length(text) from o join documents on starts_with(output, text) and length(text) < length(output) and text <> ''),
x as (select out_id, doc_id as src from (select out_id from o union all select -1 - doc_id from documents) left join (select out_id, doc_id from m qualify row_number() over (partition by out_id order by rank, neg, doc_id) = 1) using (out_id))"""


@query(f"""with {_MATCHED}, y as (select coalesce(source, 'unmatched') as source from x left join documents on src = doc_id)
select coalesce(source, 'TOTAL') as source, count(*) as n, round(100.0 * count(*) / (select count(*) from y), 1) as percent from y group by rollup (source)""")
def matched_source_shares(spark, d):
    """Outputs of every document and as many that match none."""
    docs = read(spark, d, "documents")
    none = docs.select((-1 - F.col("doc_id")).alias("out_id"), F.concat(F.lit("\x02 none "), "doc_id").alias("output"))
    m = joins.match_lineage(_outputs(docs).unionByName(none), docs, "output", "text", "out_id", "doc_id")
    return joins.source_shares(m.join(docs.select("doc_id", "source"), "doc_id", "left"), "source")


@query("""with t as (select 'T' || (doc_id % 50) || ' ' || coalesce(source, '') as title, coalesce(text, '') as body, doc_id from documents),
a as (select title, body from t where doc_id % 2 = 0), b as (select title || ' new' as title, body || '!' as body from t where doc_id % 3 = 0), n as (select unnest(['T1', 'T2 src', 'T49 src1', 'T7 ', 'none', 'T33 src12 ne']) as needle)
select needle, coalesce(chars_before, -1) as chars_before, before_title, coalesce(chars_after, -1) as chars_after, after_title from (select needle, (select min(title) from a where starts_with(title, needle)) as before_title, (select min(length(body)) from a where title = (select min(title) from a where starts_with(title, needle))) as chars_before,
(select min(title) from b where starts_with(title, needle)) as after_title, (select min(length(body)) from b where title = (select min(title) from b where starts_with(title, needle))) as chars_after from n)""")
def before_after_titles(spark, d):
    """Bodies before and after a change, by the beginnings of their titles."""
    t = read(spark, d, "documents").select(F.concat(F.lit("T"), F.col("doc_id") % 50, F.lit(" "), X.text("source")).alias("title"), X.text("text").alias("body"), "doc_id")
    a = t.where("doc_id % 2 = 0")
    b = t.where("doc_id % 3 = 0").select(F.concat("title", F.lit(" new")).alias("title"), F.concat("body", F.lit("!")).alias("body"))
    out = joins.before_after(spark.createDataFrame([(x,) for x in ("T1", "T2 src", "T49 src1", "T7 ", "none", "T33 src12 ne")], "title string"), a, b)
    return out.select("needle", "before_title", F.coalesce("chars_before", F.lit(-1)).cast("long").alias("chars_before"), "after_title", F.coalesce("chars_after", F.lit(-1)).cast("long").alias("chars_after"))
