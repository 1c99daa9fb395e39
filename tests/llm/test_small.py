"""Operators on small fixtures: brute force, edge cases, and defined results.

Every operator sees nulls, empty and long texts, repeated rows and extra columns with clashing names;
and an empty table.
"""

import math
import random
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import line_dedup, near_dedup, packing, token_counts, url_filter
from textloom.llm.encoders import encoder

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, id string, t string, h string, p string, n bigint, label string, digest string"
WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu"]


def docs(spark, texts):
    """Texts as documents with columns that clash with the operators' own names."""
    rows = [(i, t, "en", "src0", len(t or ""), "k", "i", "t", "h", "p", 1, "l", "d") for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 400)) for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    """(id, text) of every odd kind: null and empty, blank, very long, ties, repeated rows, a null id."""
    rng = random.Random(3)
    long_ = prose(rng, 6000) + "\n" + prose(rng, 40)
    body = prose(rng, 120)
    return [(1, None), (2, ""), (3, " \n\t "), (4, long_), (5, body), (5, body), (6, body), (None, prose(rng, 60)), (8, "é🙂 ß 日本\n"), (9, body + "\n" + prose(rng, 80)), (10, "one")]


def test_url_filter(spark):
    urls = ["http://A.net/x?y", "https://m.Example.net/en/1#t", "http://example.com/de/", "ftp://x.org/fr/", "http://bad.tld", "http://www.bad.tld/a", "http://notbad.tld/a", "nothing", "", None, "http://net", "x://a.net?q/", "http://bad.tld"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id int, url string, key string")
    listed = spark.createDataFrame([("bad.tld",), ("unused.tld",), ("bad.tld",)], "key string")
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df, "url", listed).orderBy("page_id").collect()]
    assert got[:4] == [("a.net", "/x", "net/", "block"), ("m.example.net", "/en/1", "example.net/en/", "allow"), ("example.com", "/de/", "example.com/de/", "block"), ("x.org", "/fr/", "org/fr/", "allow")]
    assert [g[3] for g in got[4:]] == ["block", "block", "allow", "allow", "allow", "allow", "allow", "allow", "block"]
    assert got[7][:2] == got[8][:2] == got[9][:2] == ("", "") and got[10][:3] == ("net", "", None)
    empty = df.limit(0)
    assert url_filter.judge_urls(empty, "url", listed).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(df, "url", listed.limit(0), rules=()).collect()} == {"allow"}
    clash = df.select("page_id", "url", *(F.lit(k).alias(n) for k, n in enumerate(("_hit", "_level0", "row", "key", "host", "verdict"))))
    out = url_filter.judge_urls(clash, "url", listed)
    assert out.columns == ["page_id", "url", "_hit", "_level0", "row", "key", "host", "path", "rule", "verdict"] and out.where("_level0 = 1 and row = 2").count() == len(urls)
    # a list that is too large for filters gives the same result by a join
    again = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df, "url", listed, max_bits=1).orderBy("page_id").collect()]
    assert again == got


def test_registered_query_and_sql(spark, tmp_path):
    """``OP1_SQL`` in DuckDB."""
    rng = random.Random(8)
    hosts = [*url_filter.LISTED, "example.net", "m.example.net", "example.com", "a.org", "x.net", "net", "notexample.com", "EXAMPLE.Com", "", "spam-farm.example.com.x"]
    urls = [rng.choice(["http://", "HTTPS://", "://", ""]) + rng.choice(["", "www.", "a.b."]) + rng.choice(hosts) + rng.choice(["", "/", "/en/a", "/de/", "/fr/x", "/EN/"]) + rng.choice(["", "?q=1/", "#t", "/x?y"]) for _ in range(600)] + [None, "", "://", "http://a://b.net/"]
    spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id int, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(tuple(r) for r in url_filter.op1_url_filter(spark, str(tmp_path)).select("page_id", "host", "path", F.coalesce("rule", F.lit("-")), "verdict").collect())
    duck = duckdb.connect()
    duck.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(duck.execute(f"select page_id, host, path, coalesce(rule, '-'), verdict from ({url_filter.OP1_SQL})").fetchall())


def test_cascade_is_exact(spark):
    universe = spark.range(4000).select(F.concat(F.lit("h"), "id").alias("key"))
    listed = universe.where("pmod(hash(key), 7) = 0")
    c = url_filter.build_cascade(listed, universe, fpp=0.3)
    assert len(c.levels) > 2
    marked = universe.withColumns(c.words()).withColumn("x", c.contains(F.col("key")))
    assert {r["key"] for r in marked.where("x").select("key").collect()} == {r["key"] for r in listed.collect()}


def sets(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_near_dedup_against_all_pairs(spark, odd):
    rng = random.Random(5)
    texts, i = list(odd), 100
    for _ in range(12):
        base = prose(rng, 90).split()
        for cut in (0, 0, 1, 2, 4, 12):
            new = list(base)
            for k in rng.sample(range(90), cut):
                new[k] = "changed"
            texts.append((i, " ".join(new)))
            i += 1
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs(spark, texts)).collect()}
    ids = [x for x, _ in texts]
    boss = list(range(len(texts)))

    def root(k):
        while boss[k] != k:
            k = boss[k]
        return k

    s = [sets(t or "") for _, t in texts]
    for a in range(len(texts)):
        for b in range(a):
            if s[a] == s[b] or (s[a] and s[b] and len(s[a] & s[b]) / len(s[a] | s[b]) >= 0.8):
                boss[root(a)] = root(b)
    classes = {}
    for k in range(len(texts)):
        classes.setdefault(root(k), []).append(ids[k])
    expected = {x: min((y for y in c if y is not None), default=None) for c in classes.values() for x in c}
    assert got == expected


def test_hot_centre_is_split(spark, monkeypatch):
    """One text with far more near copies than go to one task."""
    monkeypatch.setattr(near_dedup, "SHARE", 7)
    rng, base = random.Random(41), prose(random.Random(40), 120).split()
    texts = [(0, " ".join(base))]
    for k in range(1, 90):
        new = list(base)
        new[rng.randrange(120)] = f"changed{k}"
        texts.append((k, " ".join(new)))
    texts += [(500 + k, prose(rng, 100)) for k in range(20)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs(spark, texts)).collect()}
    assert got == {i: 0 if i < 500 else i for i, _ in texts}


def test_near_dedup_of_uneven_repeats(spark):
    """Texts that differ in how often a passage repeats have nearly the same shingle set."""
    rng, texts = random.Random(29), []
    for k in range(40):
        words = prose(rng, 100).split()
        often = 20 if k % 2 else 100
        texts.append((2 * k, " ".join(words)))
        texts.append((2 * k + 1, " ".join(words[:40] + words[40:70] * often + words[70:])))
    s = [sets(t) for _, t in texts]
    pairs = [k for k in range(40) if len(s[2 * k] & s[2 * k + 1]) / len(s[2 * k] | s[2 * k + 1]) >= 0.9]
    assert len(pairs) == 40
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs(spark, texts)).collect()}
    assert got == {i: i - i % 2 for i, _ in texts}


def test_register_limit_loses_next_to_nothing(spark):
    """A pair at the least similarity passes the register bits but for a chance of 1 in 9,500 (at 3 deviations: 1 in 480)."""
    n, p = near_dedup.ROWS * near_dedup.BANDS, (1 - near_dedup.SIMILARITY) * 15 / 16
    few = [np.concatenate([np.ones(d, np.uint8), np.zeros(-(-n // 16) * 16 - d, np.uint8)]) for d in range(n + 1)]
    rows = [(d, (x[::2] << 4 | x[1::2]).view(np.int64).tolist(), [0] * -(-n // 16)) for d, x in enumerate(few)]
    df = spark.createDataFrame(rows, "d int, a array<bigint>, b array<bigint>")
    most = df.where(near_dedup._near(n, near_dedup.SIMILARITY)("a", "b")).agg(F.max("d")).first()[0]
    assert sum(math.comb(n, d) * p**d * (1 - p) ** (n - d) for d in range(most + 1, n + 1)) < 2e-4


def test_near_dedup_keeps_one(spark, odd):
    df = docs(spark, odd)
    out = near_dedup.keep_one(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted([1, 4, 5, 8, 9, 10, None], key=str)
    assert near_dedup.keep_one(df.limit(0)).count() == 0
    clash = df.select("doc_id", "text", *(F.lit(k).alias(n) for k, n in enumerate(("_i", "_h", "_n", "_stays", "_hash", "_maybe", "_words", "i", "h", "id", "row", "k", "stays", "n"))))
    kept = near_dedup.keep_one(clash)
    assert kept.columns == clash.columns and kept.count() == 7 and kept.where("_words = 6 and n = 13").count() == 7
    assert near_dedup.near_duplicates(df.where("doc_id < 4")).select("class_id").distinct().count() == 1


def test_signatures_estimate_probability_jaccard():
    a = [f"w{i}" for i in range(300)]
    b = [w if i % 10 else w + "x" for i, w in enumerate(a)]
    texts = [" ".join(a), " ".join(b)]
    own, key, times = near_dedup.shingles(*near_dedup.word_hashes(texts))
    sig = near_dedup.signatures(own, key, times, 2, 2048)
    x, y = near_dedup._sets(texts, 5)
    assert abs((sig[0] == sig[1]).mean() - near_dedup._jaccard(x, y)) < 0.05


def lines_of(text):
    out = []
    for p, x in enumerate(re.split(r"(?<=\n)", text)):
        y = x.strip(" \n\r\t")
        if y:
            out.append((p, y, y.count(" ") + 1))
    return out


def brute_lines(texts, least):
    """Lines in a run of ``least`` words that occurs earlier."""
    seen, gone = {}, {}
    order = sorted(range(len(texts)), key=lambda k: texts[k][0])
    for k in order:
        own = lines_of(texts[k][1])
        for a in range(len(own)):
            for b in range(a, len(own)):
                if sum(x[2] for x in own[a : b + 1]) >= least:
                    run = tuple(x[1] for x in own[a : b + 1])
                    if run in seen and seen[run] != (k, a):
                        gone.setdefault(k, set()).update(range(own[a][0], own[b][0] + 1))
                    seen.setdefault(run, (k, a))
    return ["".join(x for p, x in enumerate(re.split(r"(?<=\n)", t)) if p not in gone.get(k, ())) for k, (_, t) in enumerate(texts)]


def test_line_dedup_against_all_runs(spark):
    rng = random.Random(7)
    pool = [" ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 2, 3, 6, 9, 30]))) for _ in range(9)]
    texts = [(i, "\n".join(rng.choice([*pool, "", prose(rng, 5)]) for _ in range(rng.randint(0, 14)))) for i in range(60)]
    got = [r["text"] for r in line_dedup.dedup_lines(docs(spark, texts), min_words=12).orderBy("doc_id").collect()]
    assert got == brute_lines(texts, 12)
    unfiltered = [r["text"] for r in line_dedup.dedup_lines(docs(spark, texts), min_words=12, max_bits=1).orderBy("doc_id").collect()]
    assert unfiltered == got


def test_line_dedup_odd_rows(spark, odd):
    df = docs(spark, odd)
    out = line_dedup.dedup_lines(df)
    assert out.columns == [*df.columns, "n_lines", "n_deleted"] and out.count() == len(odd)
    by = {r["doc_id"]: r["text"] for r in out.collect()}
    assert by[1] == "" and by[3] == " \n\t " and by[6] == "" and by[5] == dict(odd)[5] and by[9] == dict(odd)[9].split("\n")[1]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_inside_lines(spark):
    """Sentences of long lines: against all runs, and against the SQL."""
    cut, rng = re.compile(r"(?<=\n)|(?<=[.!?] )"), random.Random(17)
    pool = [prose(rng, rng.choice([1, 3, 8, 14, 26])) + rng.choice(".!?") for _ in range(12)]
    texts = [(i, "".join(rng.choice([*pool, prose(rng, 7) + "."]) + rng.choice([" ", " ", " ", "\n"]) for _ in range(rng.randint(1, 16)))) for i in range(40)]
    passage = " ".join(prose(rng, 12) + "." for _ in range(5))
    texts += [(90, f"{prose(rng, 30)}. {passage} {prose(rng, 9)}."), (91, f"{prose(rng, 8)}. {passage} {prose(rng, 40)}.")]
    seen, expected = set(), []
    for _, t in texts:
        parts = cut.split(t)
        own = [(p, x.strip(" \n\r\t")) for p, x in enumerate(parts) if x.strip(" \n\r\t")]
        gone = set()
        for a in range(len(own)):
            for b in range(a, len(own)):
                run = tuple(x for _, x in own[a : b + 1])
                if sum(x.count(" ") + 1 for x in run) >= line_dedup.MIN_WORDS:
                    if run in seen:
                        gone.update(range(own[a][0], own[b][0] + 1))
                    seen.add(run)
        expected.append("".join(x for p, x in enumerate(parts) if p not in gone))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert [got[i] for i, _ in texts] == expected
    assert passage in got[90] and not any(s in got[91] for s in cut.split(passage))
    duck = duckdb.connect()
    duck.execute("create table documents (doc_id bigint, text varchar)")
    duck.executemany("insert into documents values (?, ?)", texts)
    assert got == {r[0]: r[1] for r in duck.execute(line_dedup.OP10_SQL).fetchall()}


@pytest.fixture(scope="module")
def library():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path("byte_bpe_50k.json"))


def test_token_counts_at_every_chunk_size(library):
    rng = random.Random(1)
    bits = ["a", "B", " ", "  ", "\n", "\n\n", " \n", "\t", "é", "'s", "1", "!", "...", "<|endoftext|>", "日本", "🙂", " ", "\x1c", "\r\n", "can't", "　", "\0", "_", "́"]
    enc = encoder()
    for _ in range(400):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))
        ids = library.encode(t, add_special_tokens=False).ids
        assert list(np.frombuffer(enc.ids(t), "<u4")) == ids
        assert token_counts.count_tokens(t, enc, chunk=12, overlap=3) == len(ids)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_of_other_files(library, name):
    rng, enc = random.Random(4), encoder(name)
    for _ in range(40):
        t = " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 9))) for _ in range(60))
        assert token_counts.count_tokens(t, enc, chunk=80, overlap=30) == len(enc.ids(t)) // 4


def test_token_counts_odd_rows(spark, odd, library):
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(docs(spark, odd), chunk=1000, overlap=64).collect()}
    for i, t in odd:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 1024)
    assert token_counts.token_counts(docs(spark, odd).limit(0)).count() == 0


def test_packing(spark, odd, library):
    rng = random.Random(8)
    texts = odd + [(100 + k, prose(rng, rng.randint(1, 90))) for k in range(150)]
    packed = packing.pack(docs(spark, texts), length=256, with_ids=True)
    rows = packed.collect()
    expected = []
    for i, t in texts:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        expected += [(str(i), j, a, n, zlib.crc32(ids[a : a + n].tobytes())) for j, (a, n) in enumerate(packing.cut(len(ids), 256))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(expected)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for a, n in sorted(places):
            assert a == end
            end += n
        assert end <= 256
    assert len(by) <= 1.05 * sum(r["length"] for r in rows) / 256 + 2
    assert packing.sequences(packed).where(F.size("ids") > 256).count() == 0
    assert packing.pack(docs(spark, odd).limit(0)).count() == 0


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(0)
    for scale in (1, 30):
        hist = np.zeros(129, dtype=np.int64)
        hist[1:] = rng.integers(0, 9, 128) * scale
        plan = packing.make_plan(hist, 128)
        total = int((hist * np.arange(129)).sum())
        assert plan.n_sequences >= -(-total // 128) and plan.n_sequences <= 1.03 * total / 128 + 2
    assert packing.make_plan(np.zeros(129, dtype=np.int64), 128).n_sequences == 0


def test_plan_is_never_worse_than_best_fit():
    rng = np.random.default_rng(3)
    for k in range(12):
        hist = np.zeros(257, dtype=np.int64)
        np.add.at(hist, np.minimum(256, rng.lognormal(rng.uniform(2, 5), rng.uniform(0.3, 1.5), 3000).astype(int) + 1), 1 + 30 * (k % 2))
        assert packing.make_plan(hist, 256).n_sequences <= sum(n for _, n in packing.best_fit(hist, 256))


def test_packing_fit_is_small():
    """The patterns of all lengths fit into little memory of the driver."""
    hist = np.full(2049, 50, dtype=np.int64)
    hist[0] = 0
    tracemalloc.start()
    fitted = packing.fit_repeats(hist, 2048, sweeps=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert fitted and all(sum(p) == 2048 for p, _ in fitted) and peak < 50e6
