"""Fingerprints: boundaries byte by byte, likeness and neighbours in plain Python, odd rows."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textloom.llm import fingerprints

WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "日本", "é🙂"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 400)) for _ in range(n))


def ends(data):
    """The definition: one byte after another."""
    out, last, h = [], 0, 0
    for k, byte in enumerate(data):
        h = (h * 2 + int(fingerprints.GEAR[byte])) % (1 << 32)
        end = k + 1
        if end == len(data):
            break
        while end - last > fingerprints.MOST:
            last += fingerprints.MOST
            while data[last] & 0xC0 == 0x80:
                last -= 1
            out.append(last)
        size, inside = end - last, data[end] & 0xC0 == 0x80
        bits = fingerprints.STRICT if size < fingerprints.NORMAL else fingerprints.LOOSE
        if size >= fingerprints.LEAST and not inside and h >> (32 - bits) == 0:
            out.append(end)
            last = end
    while len(data) - last > fingerprints.MOST:
        last += fingerprints.MOST
        while data[last] & 0xC0 == 0x80:
            last -= 1
        out.append(last)
    return out + [len(data)] if data else []


def weights(text):
    data, out, last = text.encode(), {}, 0
    for end in ends(data):
        d = xxhash.xxh3_64_intdigest(data[last:end])
        out[d] = out.get(d, 0) + end - last
        last = end
    return out


def likeness(a, b):
    return sum(min(n, b.get(d, 0)) for d, n in a.items()) / sum(a.values()) if a else float(not b)


def text_of(w):
    return ",".join(f"{d:016x}:{w[d]}" for d in sorted(w))


def test_boundaries_byte_by_byte():
    rng = random.Random(4)
    for n in (0, 1, 3, 40, 400, 4000):
        data = prose(rng, n).encode()
        assert fingerprints.boundaries(data) == ends(data)
    for data in (b"a" * 5000, "日本語é🙂".encode() * 300, "é".encode() * 700, bytes(range(32, 127)) * 40):
        assert fingerprints.boundaries(data) == ends(data)


def made(rng):
    long_ = prose(rng, 3000)
    return [(None, prose(rng, 30)), (1, None), (2, ""), (3, "é🙂 ß 日本\n"), (5, prose(rng, 200)), (5, prose(rng, 90)), (7, long_), (8, long_), (9, long_[40:]), *((20 + 3 * k, prose(rng, rng.randint(0, 300))) for k in range(60))]


@pytest.mark.parametrize("kind", ["bigint", "string", "decimal(12,2)"])
def test_follows_the_definition(spark, kind):
    texts = made(random.Random(6))
    df = spark.createDataFrame([(i, t, "h", "b", 1) for i, t in texts], "doc_id bigint, text string, h string, bucket string, key int").withColumn("doc_id", F.col("doc_id").cast(kind)).repartition(5)
    texts = [(r["doc_id"], r["text"] or "") for r in df.collect()]
    order = sorted(texts, key=lambda x: (x[0] is not None, x[0] if x[0] is not None else 0))
    same = {}
    for i, t in order:
        same.setdefault(i, []).append(t)
    for size in (100, 4000, 1 << 24):
        rows = fingerprints.compare_edited(df, bucket_bytes=size).collect()
        assert len(rows) == len(order)
        ids = list(same)
        for r in rows:
            i = r["doc_id"]
            own = [t for t in same[i] if text_of(weights(t)) == r["fingerprint"]]
            assert own
            t, later = own[0], same[ids[(ids.index(i) + 1) % len(ids)]]
            good = False
            for following in later + [x for x in same[i] if x is not t]:  # rows of one id go by a hash
                half = len(t) // 2
                edited = t[: len(t) - half] + following[:half]
                a, b = weights(t), weights(edited)
                good |= (r["n_chars"], r["edited_sha256"], r["edited_fingerprint"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), text_of(b)) and abs(r["near_edited"] - likeness(a, b)) < 1e-12 and abs(r["near_next"] - likeness(a, weights(following))) < 1e-12
            assert good


def test_few_rows(spark):
    one = spark.createDataFrame([(1, "abc")], "doc_id int, text string")
    assert fingerprints.compare_edited(one).first()["near_next"] == 1.0
    assert fingerprints.compare_edited(one.limit(0)).count() == 0
    rows = fingerprints.compare_edited(spark.createDataFrame([(None, "aaaa"), (1, "bbbb")], "doc_id int, text string")).collect()
    assert {r["doc_id"]: r["edited_sha256"] for r in rows} == {None: hashlib.sha256(b"aabb").hexdigest(), 1: hashlib.sha256(b"bbaa").hexdigest()}
    again = spark.createDataFrame([(1, "abc")] * 9 + [(2, "x")], "doc_id int, text string")
    for size in (80, 1 << 24):
        rows = fingerprints.compare_edited(again, bucket_bytes=size).collect()
        assert len(rows) == 10 and sorted(r["near_next"] for r in rows if r["doc_id"] == 1) == [0.0] + [1.0] * 8


def test_plain_fingerprints(spark):
    texts = made(random.Random(8))
    got = {(r["doc_id"], r["fingerprint"], r["n_chars"]) for r in fingerprints.fingerprints(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert got == {(i, text_of(weights(t or "")), len(t or "")) for i, t in texts}


def test_registered_query(spark, tmp_path):
    texts = [x for x in made(random.Random(2)) if x[0] != 5]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = fingerprints.op8_fingerprints(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"] and out.count() == len(texts)


def test_chunks_resist_shifts():
    rng = random.Random(2)
    text = prose(rng, 3000).encode()
    moved = b"inserted words " + text
    a, b = fingerprints.chunk_weights(text), fingerprints.chunk_weights(moved)
    assert fingerprints.containment(a, b) > 0.95 and sum(a.values()) == len(text)
    ends = fingerprints.boundaries(text)
    sizes = np.diff([0, *ends])
    assert sizes.max() <= fingerprints.MOST and sizes[:-1].min() >= fingerprints.LEAST and ends[-1] == len(text)
    for end in fingerprints.boundaries("日本語é🙂".encode() * 300)[:-1]:
        ("日本語é🙂" * 300).encode()[:end].decode()
