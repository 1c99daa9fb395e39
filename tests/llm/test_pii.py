"""Personal data: the base by brute force, the found spans by a plain-Python graph, odd rows."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from textloom.llm import pii


def docs(spark, texts):
    rows = [(i, t, "k", "h", "b", "f", 1) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id bigint, text string, kind string, h string, base string, found string, value int")


@pytest.fixture(scope="module")
def odd():
    return [(1, None), (2, ""), (3, " \n\t "), (4, "call +1 743 555 3824 now " * 9), (5, "mail a@b.c"), (5, "mail a@b.c"), (6, "mail a@b.c"), (None, "ip 1.2.3.4"), (8, "é🙂 ß 日本 1.2.3.4\n"), (10, "one")]


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        x = [int(c) for c in reversed(d)]
        return 13 <= len(d) <= 19 and sum(n if k % 2 == 0 else sum(divmod(2 * n, 10)) for k, n in enumerate(x)) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute_pii(t):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, t) if valid(k, m[0]))


def test_pii_base(spark, odd):
    rng = random.Random(11)
    bits = ["a", "B1", "@", "@x.", "a.b", "%", "+", "1", "23", "+1 ", "(", ")", " ", "-", ".", "é", "🙂", "\n", "255", "256", "1.2.3.4", "4111 1111 1111 1111", "+1 (743) 555-3824", "bob.x@mail.example.com", "..", "0000012"]
    texts = odd + [(100 + k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for k in range(600)]
    texts += [(900, "1" * 30_000), (901, "a" * 30_000 + "@"), (902, "a@b.c%d@e.f"), (903, "1." * 9000)]
    got = pii.extract_pii(docs(spark, texts)).select("doc_id", pii.spans_text(F.col("base")).alias("s")).collect()
    assert sorted((str(r["doc_id"]), r["s"]) for r in got) == sorted((str(i), brute_pii(t or "")) for i, t in texts)
    assert pii.extract_pii(docs(spark, texts).limit(0)).count() == 0


def test_pii_bootstraps(spark):
    texts = [(k, f"please write today to contact address {n}@mail.example.com for more of it") for k, n in enumerate(["ann", "bob", "cy", "di"])]
    texts += [(50, "please write today to contact address zed#at#mail2 for more of it"), (51, "we counted apples and found 12345 of them")]
    found = {r["doc_id"]: [(f["kind"], f["value"]) for f in r["found"]] for r in pii.extract_pii(docs(spark, texts)).collect()}
    assert found[50] == [("email", "zed#at#mail2")] and not found[51] and not found[0]


TOKEN, GROUP = re.compile(r"(?<!\S)(?=[^\s0-9@]*[0-9@])\S{5,}(?!\S)", re.ASCII), re.compile(pii._GROUP.replace("}+", "}"), re.ASCII)


def graph(texts, least_seeds=3, accept=0.6):
    """{(id, start, end): kind} of the found spans: the definition, step by step."""
    seen, edges = [], {}
    for n, (i, t) in enumerate(texts):
        t = t or ""
        base = [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, t) if valid(k, m[0])]
        apart = lambda a, b, spans: all(b <= x or y <= a for *_, x, y in spans)
        groups = [(None, m.start(), m.end()) for m in GROUP.finditer(t) if apart(m.start(), m.end(), base)]
        tokens = [(None, m.start(), m.end()) for m in TOKEN.finditer(t) if apart(m.start(), m.end(), base + groups)]
        for kind, a, b in base + groups + tokens:
            before = re.sub(r"[ \t\n\r\f\v]+", " ", t[max(0, a - 80) : a].lower())
            after = re.match(r"^\S?[ \t\n\r\f\v]+([^ \t\n\r\f\v]+)", t[b : b + 40].lower())
            two, one = re.search(r"(\S+ \S+) \S?$", before, re.ASCII), re.search(r"(\S+) \S?$", before, re.ASCII)
            patterns = ([two[1] + " _"] if two else []) + ([f"{one[1]} _ {after[1]}"] if one and after else [])
            seen.append((n, i, a, b, t[a:b], kind))
            for p in patterns:
                edges.setdefault((t[a:b], kind), set()).add(p)
    sure = {v: {} for v, _ in edges}
    for v, k in edges:
        if k:
            sure[v][k] = 1.0
    values = {}
    for (v, k), ps in edges.items():
        for p in ps:
            values.setdefault(p, set()).add(v)
    confident, accepted = sure, 0
    while True:
        scores = {}
        for p, vs in values.items():
            for k in BASE:
                c = [confident.get(v, {}).get(k, 0) for v in vs]
                if sum(x >= 0.5 for x in c) >= least_seeds:
                    scores[p, k] = sum(c) / (len(vs) + 1)
        confident = {v: dict(x) for v, x in sure.items()}
        for (v, k0), ps in edges.items():
            if k0 is None:
                for k in BASE:
                    left = 1.0
                    for p in ps:
                        left *= 1 - min(scores.get((p, k), 0), 0.999)
                    if left < 1 and k not in sure[v]:
                        confident[v][k] = 1 - left
        good = {v: max((c, k) for k, c in x.items() if accept <= c < 1) for v, x in confident.items() if any(accept <= c < 1 for c in x.values())}
        if len(good) <= accepted:
            break
        accepted = len(good)
    return {(str(i), a, b): good[v][1] for n, i, a, b, v, kind in seen if kind is None and v in good}


def test_found_spans_by_a_plain_graph(spark, odd):
    rng = random.Random(3)
    ways = ["please write to {} for more", "his mail is {} and", "call us at {} today", "the number {} is", "server {} answered", "card {} was", "we bought {} apples", "see room {} there"]
    kinds = {"email": ["ann{}@mail.example.com", "bob{}#at#mail", "x{}@nowhere"], "phone": ["+1 743 555 38{}", "743 555 38{}", "(743) 555-38{}"], "ip": ["10.0.0.{}", "10.0.0.9{}9", "10-0-0-{}"], "card": ["4111 1111 1111 1111", "4111 1111 1111 11{}", "4111-1111-1111-11{}"]}
    texts = list(odd)
    for k in range(400):
        out = []
        for _ in range(rng.randint(1, 6)):
            way = rng.choice(ways)
            kind = {0: "email", 1: "email", 2: "phone", 3: "phone", 4: "ip", 5: "card"}.get(ways.index(way), rng.choice(list(kinds)))
            out.append(way.format(rng.choice(kinds[kind]).format(rng.randint(10, 99))))
        texts.append((100 + k, rng.choice([". ", "\n", " "]).join(out)))
    found = {(str(r["doc_id"]), f["start"], f["end"]): f["kind"] for r in pii.extract_pii(docs(spark, texts)).collect() for f in r["found"]}
    expected = graph(texts)
    assert found == expected and len(expected) > 50 and set(expected.values()) >= {"email", "phone"}
    by = dict(texts)
    assert any(" " in by[int(i)][a:b] for i, a, b in expected)


def test_very_many_matches_in_a_text(spark):
    df = docs(spark, [(1, "mail a1@b.cd or 10.0.0.1 at 12345 " * 3000)])
    began = time.time()
    assert len(pii.extract_pii(df).first()["base"]) == 6000
    assert time.time() - began < 90


def test_registered_query(spark, odd, tmp_path):
    import hashlib

    texts = odd + [(100 + k, f"write to contact address u{k}@mail.example.com for more") for k in range(5)] + [(200, "write to contact address zed#at#mail2 for more")]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    rows = pii.op3_pii(spark, str(tmp_path)).collect()
    expected = []
    for i, t in texts:
        b = brute_pii(t or "")
        expected.append((str(i), *(sum(x.startswith(k + ":") for x in b.split(",")) for k in BASE), hashlib.sha256(b.encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in rows) == sorted(expected)
    assert {r["doc_id"]: r["spans"] for r in rows}[200] == "email:25:37"
