"""Small cases with known results, and native forms against plain Python."""

import html
import math
import random
import re
from html.entities import html5

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions import udfs
from textloom.operators import chunk
from textloom.operators import evaluate as E
from textloom.operators import joins
from textloom.operators import persona as P
from textloom.operators import quality as Q
from textloom.plans import catalogue
from textloom.plans import config as C


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f("t").alias("x")).first()["x"]


@pytest.mark.parametrize(
    "f, text, expected",
    [
        (X.clean_markdown, "Read [this](https://x.io/a) now", "Read [this]( now"),
        (X.clean_markdown, "Read [this](/local) now", "Read this now"),
        (X.clean_markdown, "**Bold** &amp; `code` __x__", "Bold & code x"),
        (X.clean_markdown, "AT&amp;T &amp;nbsp; ok", "AT&T ok"),
        (X.clean_markdown, None, ""),
        (X.avg_sentence_length, "SaaS pricing is hard. Is pricing hard? Yes.", 4.0),
        (X.avg_sentence_length, "Grew 3.5x in 2024.", 2.5),
        (X.avg_sentence_length, "", 0.0),
        (X.vocabulary_richness, "SaaS pricing is hard. Is pricing hard? Yes.", 0.75),
        (X.formality, "SaaS pricing is hard. Is pricing hard? Yes.", 0.25),
        (X.word_count, "  a b  c \n", 3),
        (X.word_count, None, 0),
        (X.split_count, "  a b  c \n", 5),
        (X.split_count, None, None),
        (X.is_b2b, "we carry on", True),
        (X.scrub_fillers, "Um, so uh we went ahead", "so we went ahead"),
        (X.scrub_fillers, "hmm. ok ermine aha!", "ok ermine !"),
        (X.filler_count, "Um, so uh we went ahead", 2),
        (X.strip_fillers, "the the the cat i I go", "the cat i go"),
        (X.strip_fillers, "really really good", "really really good"),
        (X.iso_day, "20240230", "2024-02-30"),
        (X.iso_day, "2024-02", None),
        (X.base_title, f"{C.instruction('Pricing (part 2 of 3)')}", "Pricing"),
        (X.part_of, "Pricing (part 2 of 3)", 2),
        (X.part_of, "Pricing", 1),
        (X.vtt_text, "WEBVTT\nKind: captions\n\n00:00 --> 00:01\nhi\n<c>hi</c>\nthere\nhi", "hi there hi"),
        (X.vtt_cues, "a\n00:00 --> 00:01\nb\n00:01 --> 00:02", 2),
        (X.json_object, 'Sure ```json\n{"a": 1}\n``` ok', '{"a": 1}'),
        (X.strip_preamble, "Here's the corrected text: <<<hi>>>", "hi"),
        (X.slug, " a b/c.d ", "a_b_c.d"),
        (X.slug, "///", "dataset"),
        (X.video_id, "https://y.com/watch?v=abcdefghijk&t=1", "abcdefghijk"),
        (X.normal_lines, "a\r\nb\rc" + C.TRUNCATED, "a\nb\nc"),
        (Q.body_class, "so we went and did the thing again " * 4, "transcript"),
        (Q.body_class, "We grew fast.\nThen we hired two reps at once and it worked really well for us all.", "blog"),
        (Q.body_class, "We grew fast.\nThen we hired.", "other"),
    ],
)
def test_small_cases(spark, f, text, expected):
    assert one(spark, text, f) == expected


@pytest.mark.parametrize(
    "text, day",
    [
        ("2024-01-02T03:04:05Z", "2024-01-02 03:04:05"), ("March 2024", "2024-03-01 00:00:00"), ("2024", "2024-01-01 00:00:00"),
        ("March 5, 2024", "2024-03-05 00:00:00"), ("Mar 2024", "2024-03-01 00:00:00"), ("3/2024", "2024-03-01 00:00:00"),
        ("Spring of 2019", "2019-01-01 00:00:00"), ("2 weeks ago", None), ("", None), ("2024-03-05", "2024-03-05 00:00:00"), ("id 0000 x", None),
    ],
)
def test_dates(spark, text, day):
    got = one(spark, text, X.parse_date)
    assert (str(got) if got else None) == day


@pytest.mark.parametrize("n, fixed, overlap", [(0, 0, 1), (500, 1, 1), (501, 2, 2), (900, 2, 2), (901, 2, 3), (951, 2, 3)])
def test_chunk_counts(spark, n, fixed, overlap):
    row = spark.createDataFrame([(" ".join(f"w{k}" for k in range(n)),)], "t string").select(F.size(chunk.fixed("t")).alias("a"), F.size(chunk.overlapping("t")).alias("b")).first()
    assert (row["a"], row["b"]) == (fixed, overlap)


@pytest.mark.parametrize(
    "body, sizes",
    [
        ("a" * 2500, [1000, 1000, 500]), ("a" * 600 + "\n\n" + "b" * 600, [600, 600]), ("a" * 100 + "\n\n" + "b" * 1500, [1000, 602]),
        ("a" * 900 + "\n\n" + "b" * 140 + "\n\n" + "c" * 30, [900, 172]), ("a" * 1000 + "b" * 20, [1000, 20]),
    ],
)
def test_character_chunks(body, sizes):
    assert [len(x) for x in udfs.split_by_chars(body, 1000)] == sizes


def test_sentence_chunks_keep_all_words():
    rng = random.Random(1)
    for _ in range(200):
        body = "".join(rng.choice(["alpha ", "Beta. ", "gamma! ", "Delta? ", "\n\n", "longword" * 6 + " "]) for _ in range(rng.randint(0, 80)))
        out = udfs.split_by_sentences(body, 60)
        assert " ".join(out).split() == body.split()
        assert all(len(x) <= 60 or " " not in x for x in out)


def test_footer():
    x = "x" * 150
    assert udfs.strip_footer_text(x + "\nRelated Posts\nfoo") == x
    assert udfs.strip_footer_text("y" * 30 + "\nRelated Posts\n" + x) == "y" * 30 + "\nRelated Posts\n" + x
    assert udfs.strip_footer_text("  a\nRelated Posts\nb ") == "  a\nRelated Posts\nb "
    assert udfs.strip_footer_text(x + "\nRelated Posts") == x + "\nRelated Posts"
    assert udfs.strip_footer_text(x + "\n— Ann B (@x) 2024") == x + "\n— Ann B (@x) 2024"
    assert udfs.strip_footer_text(x + "\n— Ann B (@x) 2024", signatures=("Ann",)) == x and udfs.strip_footer_text(x + "\n— ann", signatures=("Bob", "Ann")) == x
    bullets = x + "\n- Apples are good\n- Pears too\n— Dashes in the middle\nand more text. " + x
    assert udfs.strip_footer_text(bullets) == bullets and udfs.strip_footer_text(bullets, signatures=("Ann",)) == bullets
    assert udfs.strip_footer_text(None) is None


def test_html():
    page = "<html><head><style>p{}</style><script>var a='</p>'</script></head><body><h1>T &amp; t</h1><nav>n</nav><article><p>a</p><!-- c --><p>b</p></article></body></html>"
    assert udfs.article_text(page, "u") == ("T & t", "a b")
    assert udfs.article_text(None, "u") == ("u", "")
    assert "var" not in udfs.strip_html_text(page) and udfs.strip_html_text(None) is None


def test_casing_is_idempotent():
    once = udfs.restore_casing_text("i think saas and ai rock. we use api calls")
    assert once == "I think SaaS and AI rock. We use API calls" and udfs.restore_casing_text(once) == once


def test_scores():
    assert udfs.rouge_l("a b c".split(), "a x c".split()) == pytest.approx(2 / 3)
    assert udfs.sentence_bleu("a b c d e".split(), "a b c d e".split()) == pytest.approx(1.0)
    assert udfs.sentence_bleu([], ["a"]) == 0.0


def test_stage_tags_and_truncation(spark):
    assert one(spark, "a [Music] b\n\n\n\nc  \n", X.scrub_stage_tags) == "a b\n\nc"
    long_ = "x" * 1700 + "\n\n" + "y" * 500
    assert one(spark, long_, X.truncate) == "x" * 1700 + C.TRUNCATED
    assert one(spark, "x" * 2100, X.truncate) == "x" * 2000 + C.TRUNCATED


def test_word_count_is_python_split(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab \n\té") for _ in range(30)) for _ in range(100)]
    got = [r["n"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.word_count("t").alias("n")).collect()]
    assert sorted(got) == sorted(len(re.findall(r"\S+", t)) for t in texts)


def test_chunk_size_for_a_sequence():
    assert C.chunk_chars_for(512) == int(132 * 3.2) and C.chunk_chars_for(100) == int(64 * 3.2)


@pytest.mark.parametrize("name", ["clean_text_markdown", "collector_clean", "scrub_urls_fillers", "transcript_markup_scrub"])
def test_cleaning_reads_whole_texts(spark, tmp_path, name):
    """Against the SQL, on texts of any length."""
    tail = " **bold** [a](/b) https://x.io/q um, uh the end [Music]  of it &amp; more"
    texts = [None, "", "short", "word " * 59 + tail, ("long words, " * 60 + tail + "\n\n\n") * 3]
    duck = duckdb.connect()
    for table, keys in (("documents", "doc_id bigint"), ("conversations", "conv_id bigint, turn bigint")):
        rows = [(*[i] * (keys.count(",") + 1), t) for i, t in enumerate(texts) if t is not None or table == "documents"]
        spark.createDataFrame(rows, f"{keys}, text string").write.parquet(f"{tmp_path}/{table}.parquet")
        duck.execute(f"create table {table} ({keys}, text varchar)")
        duck.executemany(f"insert into {table} values ({', '.join('?' * len(rows[0]))})", rows)
    sql = catalogue.oracle_sql()[name]
    got = sorted((tuple(r) for r in catalogue.queries()[name](spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(duck.execute(sql).fetchall(), key=repr)


def test_best_scores_read_all_references_whole(spark, tmp_path):
    """Copies that stand late in a text, in another language, in a late or short document."""
    rng = random.Random(31)
    words = lambda n: [f"w{rng.randint(0, 60)}" for _ in range(n)]
    refs = [(i, " ".join(words(60)), "en") for i in range(40)]
    late, other, last, short = words(30), words(30), words(30), words(6)
    refs += [(50, " ".join(words(900) + late), "en"), (51, " ".join(other), "de"), (99, " ".join(last), "en"), (100, " ".join(short), "fr"), (101, None, "en"), (102, "", "en")]
    items = [(i, " ".join(t) if t is not None else None) for i, t in enumerate([late, other, last, short, words(40), ["absent"], [], None])]
    spark.createDataFrame(refs, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    got = {r["item_id"]: (r["bleu"], r["rouge_l"]) for r in catalogue.queries()["best_of_k_scores"](spark, str(tmp_path)).collect()}
    for i, t in items:
        a, bs = (t or "").split(), [(r or "").split() for _, r, _ in refs]
        bleu = max(udfs.sentence_bleu(a, b) for b in bs)
        rouge = max((2 * common(a, b) / (len(a) + len(b)) for b in bs if a), default=0.0)
        assert got[i] == pytest.approx((bleu, rouge), abs=1e-6)
    assert [got[i][1] for i in (1, 2, 3)] == [1.0] * 3 and got[0][1] >= 60 / 960 and len(got) == len(items)


def test_best_scores_skip_what_cannot_be_best(monkeypatch):
    """The scores of all pairs, from few of them."""
    rng = random.Random(43)
    words = lambda n: " ".join(f"w{min(rng.randint(0, 80), rng.randint(0, 80))}" for _ in range(n))
    items = [words(rng.randint(1, 40)) for _ in range(12)] + ["", None, "x", "w1"]
    refs = [words(rng.choice([1, 2, 20, 60, 400])) for _ in range(150)] + ["", None, "x y"] + [words(50) + " " + t for t in items[:6]]
    split = lambda t: re.findall(r"\w+", (t or "").lower())
    expected = [(max(udfs.sentence_bleu(split(t), split(r)) for r in refs), max(udfs.rouge_l(split(t), split(r)) for r in refs)) for t in items]
    scored, rouge = [], udfs.rouge_l
    monkeypatch.setattr(udfs, "rouge_l", lambda a, b: scored.append(0) or rouge(a, b))
    (out,) = udfs.best_scores(items)([pa.RecordBatch.from_pydict({"t": refs[:80]}), pa.RecordBatch.from_pydict({"t": refs[80:]})])
    assert list(zip(out.column(1).to_pylist(), out.column(2).to_pylist())) == expected
    assert len(scored) < len(items) * len(refs) / 4


def test_lineage_and_union_take_all_documents(spark, tmp_path):
    """Ids that are no multiples of five, and over 100."""
    rng = random.Random(37)
    long_ = " ".join(f"w{rng.randint(0, 999)}" for _ in range(90))
    texts = {1: long_, 2: long_ + " more", 5: "short", 7: "short", 13: "short and on", 121: long_[:250], 999: long_[:199], 1004: "", 1005: None}
    spark.createDataFrame([(i, t, "src0") for i, t in texts.items()], "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a"), (2, None)], "conv_id bigint, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    run = catalogue.queries()
    some, expected = {i: t for i, t in texts.items() if t}, {}
    for i, t in some.items():
        for k, o in enumerate((t, t[:200], t + " more")):
            found = [(0 if o == s else 1 if s.startswith(o) else 2, -len(s), j) for j, s in some.items() if s.startswith(o) or o.startswith(s)]
            rank, _, j = min(found)
            expected[3 * i + k] = (j, ("exact", "starts", "inside")[rank])
    assert {r["out_id"]: (r["src"], r["how"]) for r in run["lineage_prefix_match"](spark, str(tmp_path)).collect()} == expected
    got = {r["source"]: (r["n"], r["n_scored"]) for r in run["pad_union"](spark, str(tmp_path)).collect()}
    assert got["src0"] == (len(texts), len(texts)) and got["talk"] == (2, 0)


def _moved(spark):
    return sum(x.totalShuffleWrite() for x in [spark._jsc.sc().statusStore().executorList(True).apply(0)])


def test_lineage_moves_each_text_once(spark, tmp_path):
    """Random texts of many common beginnings against brute force, and the bytes that are exchanged."""
    rng = random.Random(41)
    bases = ["".join(rng.choice("abé \U0001f600\n") for _ in range(300)) for _ in range(3)]
    draw = lambda: rng.choice(bases)[: rng.choice([0, 1, 2, 3, 4, 5, 15, 16, 17, 63, 64, 65, 200, rng.randint(1, 300)])] + rng.choice(["", "", "x", "é"])
    bodies = [(rng.choice([None, *range(60)]), draw()) for _ in range(120)] + [(1, None), (2, bases[0]), (None, bases[0])]
    outs = [(rng.choice([None, *range(150)]), draw()) for _ in range(300)] + [(7, None), (151, None), (152, "none of them")]
    best = {}
    for i, o in outs:
        for j, b in bodies:
            if i is not None and o and b and (b.startswith(o) or o.startswith(b)):
                found = (0 if o == b else 1 if b.startswith(o) else 2, -len(b), j is None, j or 0)
                best[i] = min(best.get(i, found), found)
    expected = sorted((-1 if i is None else i, *(("none", None) if i not in best else (("exact", "starts", "inside")[best[i][0]], None if best[i][2] else best[i][3]))) for i, _ in outs)
    o, c = spark.createDataFrame(outs, "out_id bigint, output string"), spark.createDataFrame(bodies, "src int, body string").repartition(3)
    got = sorted((-1 if r["out_id"] is None else r["out_id"], r["how"], r["src"]) for r in joins.match_lineage(o, c).collect())
    assert list(map(repr, got)) == list(map(repr, expected))
    texts = [(i, "".join(rng.choice("0123456789abcdef") for _ in range(20000))) for i in range(60)]
    spark.createDataFrame(texts, "src bigint, body string").write.parquet(f"{tmp_path}/texts")
    df = spark.read.parquet(f"{tmp_path}/texts")
    outs = df.select(F.explode(F.array("src", F.col("src") + 100)).alias("out_id"), F.when(F.col("out_id") < 100, F.col("body")).otherwise(F.concat("body", F.lit("!"))).alias("output"))
    before, most = _moved(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where neither side is small
    try:
        assert {r["how"] for r in joins.match_lineage(outs, df).collect()} == {"exact", "inside"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert _moved(spark) - before < 4_000_000  # 3.6 million characters of outputs and bodies, which compress to a half


def test_shares_match_the_outputs_once(spark):
    """The rows of what is matched are made one time."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(s,) for s in ["a", "a", "b", None]], "source string").mapInArrow(run, "source string")
    got = {r["source"]: (r["n"], r["percent"]) for r in joins.source_shares(df, "source").collect()}
    assert got == {"a": (2, 50.0), "b": (1, 25.0), "unmatched": (1, 25.0), "TOTAL": (4, 100.0)} and made.value == 4


def test_entities(spark):
    """All names, numbers and odd forms, as the standard library has them."""
    rng = random.Random(21)
    bits = ["&", "&amp;", "&amp", "&ampere;", "&notit;", "&not", "&lt", "&rsquo;", "&mdash", "&NotEqualTilde;", "&#8217;", "&#x2014;", "&#X41", "&#65x", "&#0;", "&#128;", "&#x9f;", "&#xD800;", "&#1114112;", "&#99999999999;", "&#xfdd0;", "&#1;", "&#13;", "&#127;", "&#x10FFFF;", "&#x1F600;", "&nosuch;", "&#;", "&#x;", "&;", " ", "a", "é", "<b>", "copy;", "&copy2", "&&&", "&#x000041;"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(800)] + [f"&{n}" for n in sorted(html5)[::7]] + [None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(2)
    got = {r["i"]: r["x"] for r in df.select("i", X.unescape("t").alias("x")).collect()}
    assert [got[i] for i in range(len(texts))] == [html.unescape(t or "") for t in texts]


def test_articles():
    page = '<h1>first</h1><h1 class="a entry-title">Real <b>title</b></h1><article>no<div class="entry-content x">body <div>in</div> end</div>tail</article>'
    assert udfs.article_text(page, "u") == ("Real title", "body in end")
    assert udfs.article_text("<h1> a </h1><h1>b</h1><article>x</article><article>y</article>", "u") == ("a", "x")
    assert udfs.article_text("<p>x</p>", "u") == ("u", "x") and udfs.article_text(None, None) == ("", "")


CUT = {"a &amp; b&amp;&amp</h1>": "a & b&&amp", "x &lt": "x &lt", "&#8217;&#39 &#x2014;": "\u2019&#39 \u2014", "&notit; &eacute;&eacute": "&notit; \u00e9&eacute", "AT&T &": "AT&T &", "&amp;amp; &amp;lt": "&amp; &lt"}


def test_entities_of_articles_end_in_a_semicolon():
    """As in SQL: cut ones, as at the end of a title that is cut, stay as they are."""
    for page, plain in CUT.items():
        assert udfs.article_text(f"<h1>{page}</h1><article>{page}</article>", "u") == (plain, plain)
    assert udfs.article_text('<div title="a&gt" class="x&amp entry-content">y</div>z', "u")[1] == "y"


def test_entities_of_stripped_pages_end_in_a_semicolon():
    for page, plain in CUT.items():
        assert udfs.strip_html_text("<h1>" + page) == plain


ODD = [None, "", "<p>a</p> b</foot", "<p>a b<p cla", 'x<p>y<a href="u">z</a', "a < b", "a<", "a</", "a<!", "a<!-", "a<!--", "a<!-- c", "a<!-- c <b>d", "a<!--->b", "a<![foo[x]]>b", "a<![ >b", "a<![endif]-->b", "a</>b", "a<!-- c --><br/>\n<b> d&am</b>&amp"]


def test_odd_pages_are_stripped_as_in_sql(spark, tmp_path):
    """Pages that end within a tag or comment, marked sections, a sign that opens nothing."""
    rows = list(enumerate(ODD))
    spark.createDataFrame(rows, "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.execute("create table pages (page_id bigint, html varchar)")
    duck.executemany("insert into pages values (?, ?)", rows)
    got = sorted(tuple(r) for r in catalogue.queries()["strip_html_pages"](spark, str(tmp_path)).collect())
    assert got == sorted(duck.execute(catalogue.oracle_sql()["strip_html_pages"]).fetchall())
    assert udfs.article_text("<h1>a < b</h1><article>1 < 2<b>3</b> <</article>", "u") == ("a < b", "1 < 2 3 <")


def test_casing_of_own_names():
    assert udfs.restore_casing_text("ann of acmecorp. she met the ceo", ("Ann", "AcmeCorp")) == "Ann of AcmeCorp. She met the CEO"


def test_words_of_a_profile(spark):
    t = "The co-founder's B2B plan couldn't fail, won't it? We've e.g. U.S. plans/ideas: 'great' (really) naïve_x naïve state-of-the-art. end."
    got = spark.createDataFrame([(t,)], "t string").select(P.content_words("t").alias("w"), P.sentence_count("t").alias("n")).first()
    assert got["w"] == ["plan", "could", "fail", "really", "naïve", "end"] and got["n"] == 5


def test_weights_of_the_style_model(spark):
    """Smoothed idf: ln((1 + n) / (1 + df)) + 1 times the count, normalised."""
    from pyspark.ml.feature import IDF, CountVectorizer

    df = spark.createDataFrame([(0, ["a", "a", "b"]), (1, ["b", "c"]), (2, ["b"])], "i int, w array<string>")
    cv = CountVectorizer(inputCol="w", outputCol="_c").fit(df)
    c = cv.transform(df)
    rows = {r["i"]: r["features"].toArray() for r in E._weights(c, IDF(inputCol="_c", outputCol="_i").fit(c)).collect()}
    idf = {t: math.log(4 / (1 + n)) + 1 for t, n in (("a", 1), ("b", 3), ("c", 1))}
    for i, words in ((0, "aab"), (1, "bc"), (2, "b")):
        own = [words.count(t) * idf[t] for t in cv.vocabulary]
        size = math.sqrt(sum(x * x for x in own))
        assert all(abs(x / size - y) < 1e-9 for x, y in zip(own, rows[i]))


def test_folds_and_accuracy(spark):
    rows = [(k, f"alpha beta gamma word{k}" if k % 2 else f"delta epsilon zeta word{k}", float(k % 2)) for k in range(60)]
    df = spark.createDataFrame(rows, "i int, t string, y double")
    got = E.authorship(df, df, "t", "y", "i").collect()
    assert all((r["p_author"] > 0.5) == bool(r["i"] % 2) for r in got) and {r["cv_accuracy"] for r in got} == {1.0}


def test_repunctuation_falls_back(spark):
    class Model:
        def generate(self, prompt):
            text = prompt.split("<<<\n", 1)[1].rsplit("\n>>>", 1)[0]
            if "broken" in text:
                raise OSError
            return "Corrected text: <<<" + ("x" if "drop" in text else text.upper()) + ">>>"

    words = "one two three four five drop six seven eight nine ten eleven broken twelve thirteen"
    df = spark.createDataFrame([(1, words), (2, ""), (3, None), (4, "all good here")], "i int, t string")
    got = {r["i"]: tuple(r["x"]) for r in df.select("i", Q.repunctuated("t", Model(), 24).alias("x")).collect()}
    assert got[2] == got[3] == ("", 0, 0, 0) and got[4] == ("ALL GOOD HERE", 1, 1, 0)
    parts = udfs.word_windows(words, 24)
    assert " ".join(parts) == words and max(map(len, parts)) <= 24
    assert got[1] == (" ".join(p if "drop" in p or "broken" in p else p.upper() for p in parts), len(parts), len(parts) - 2, 2)


def test_expansion_and_preparation(spark):
    rows = [(1, f"{C.instruction('Long')}", "", ("Some words stand here. " * 40).strip()), (2, "short", "", "x " * 50), (3, "junk", "", "tiny")]
    df = spark.createDataFrame(rows, "doc_id int, instruction string, input string, output string")
    out = chunk.expand_rows(df, 300)
    parts = udfs.split_by_sentences(rows[0][3], 300)
    assert tuple(chunk.expansion_stats(df, out).first()) == (3, 2 + len(parts), 1)
    got = Q.prepare(df, 300).collect()
    assert sum(r["doc_id"] == 1 for r in got) <= len(parts) and {r["doc_id"] for r in got} == {1, 2}
    assert all(any(r["cleaned"] == p for p in parts) for r in got if r["doc_id"] == 1)


def test_training_rows_need_words(spark):
    df = spark.createDataFrame([(1, "s", "word " * 49 + "x" * 200), (2, "s", "word " * 50)], "doc_id int, source string, text string")
    assert {r["doc_id"] for r in chunk.training_rows(df, F.lit("T"), "source", "text").collect()} == {1, 2}
    assert {r["doc_id"] for r in chunk.training_rows(df.withColumn("text", F.regexp_replace("text", "x+", "")), F.lit("T"), "source", "text").collect()} == {2}


def test_stutters_by_plain_python(spark):
    rng = random.Random(5)
    bits = ["um", "the", "the", "I", "i", "go", "go", "you know,", ", you know,", "kind of", "mm-hmm", "uh-huh", "well", " ", "a-um", "really", "really"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 20))) for _ in range(200)]
    got = [r["x"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(1).orderBy("i").select(X.strip_fillers("t").alias("x")).collect()]

    def plain(t):
        t = re.sub(r"(?<![\w-])(?:" + "|".join(C.INTERJECTIONS) + r")(?![\w-])", " ", t, flags=re.I)
        t = re.sub(r",\s*(?:you know|i mean|kind of|sort of)\s*,", ", ", t, flags=re.I)
        t = re.sub(r"\b(\w{1,4})(?:\s+\1\b)+", r"\1", t, flags=re.I)
        return re.sub(r"[ \t]{2,}", " ", t).strip(" ")

    assert got == [plain(t) for t in texts]
