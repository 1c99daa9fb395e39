"""The secret scan: base by brute force, layers by round trips, blocks, odd rows."""

import base64
import bz2
import gzip
import hashlib
import random
import re
import textwrap
import urllib.parse
import zlib

import pytest

from textloom.llm import secrets

SECRET = 'token = "abcdefgh12345"'
LONG = "\n".join(f"line {k} of some text" for k in range(40))


def b64(data, wrap=0, sep="\n"):
    out = base64.b64encode(data if isinstance(data, bytes) else data.encode()).decode()
    return sep.join(textwrap.wrap(out, wrap)) if wrap else out


def hidden(rng):
    """Text that does not compress well."""
    return " ".join(f"{rng.randrange(1 << 40):x}g" for _ in range(60))


WITH = f"{LONG}\n{SECRET}\n{hidden(random.Random(1))}"


@pytest.mark.parametrize(
    "coded",
    [
        urllib.parse.quote(SECRET), "".join(f"\\u{ord(c):04x}" for c in SECRET), b64(SECRET), b64(gzip.compress(SECRET.encode())), b64(bz2.compress(SECRET.encode())),
        b64(zlib.compress(b64(SECRET).encode())), urllib.parse.quote(b64(zlib.compress(urllib.parse.quote(SECRET).encode())), safe=""),
        b64(gzip.compress(WITH.encode()), 76), b64(gzip.compress(WITH.encode()), 64, "\r\n"), b64(zlib.compress(WITH.encode()), 76, "\n  "), b64(WITH, 76), b64(b64(bz2.compress(WITH.encode()), 76), 64),
        b64(gzip.compress(b"first member") + gzip.compress(SECRET.encode())), b64(bz2.compress(b"first") + bz2.compress(b"second") + bz2.compress(SECRET.encode()), 76),
        b64(gzip.compress(gzip.compress(bz2.compress(WITH.encode())))), b64(gzip.compress(b"first member") + gzip.compress(zlib.compress(SECRET.encode()))[:0] + gzip.compress(SECRET.encode())),
        b64(gzip.compress(WITH.encode())[:-6], 76),
    ],
)
def test_secret_in_layers(coded):
    for text in (f"é some text {coded} after", f"é\n{coded}\nafter words\n"):
        found, layers, blocks = secrets.findings(text)
        assert layers and not blocks and "assign" in {f[0] for f in found}
        assert all(text.index(coded) <= f[1] < f[2] <= text.index(coded) + len(coded) for f in found)


def test_text_beside_a_wrapped_run():
    """A line after a run that only looks like one does not spoil it."""
    coded = b64(gzip.compress(WITH.encode()), 76)
    for text in (f"{coded}\nhello", f"{coded}\nhello there", f"words\n{coded}", f"key: {coded}"):
        assert "assign" in {f[0] for f in secrets.findings(text)[0]}


def test_large_layers_are_scanned_to_their_end():
    rng = random.Random(2)
    for body in ("\n".join(hidden(rng) for _ in range(200)), "a" * 300_000, "a b" * 100_000):
        for at in range(0, len(body), len(body) // 37):
            text = b64(zlib.compress(f"{body[:at]} {SECRET} {body[at:]}".encode()))
            found, layers, blocks = secrets.findings(text, max_layer=10_000)
            assert blocks == 1 and layers > 1 and ("assign", 0, len(text)) in {f[:3] for f in found}
    assert secrets.findings(b64(zlib.compress(b"\0" * 50_000_000)))[1:] == (0, 0)


def test_ends_on_cycles():
    assert secrets.findings("%25" * 200 + "41")[1] < 500


BASE = {"assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}
LEAST = {"assign": 6, "access": 20, "hex": 24}


def brute(text):
    spans = [(m.start(), k, m.end()) for k, p in BASE.items() for m in re.finditer(p, text, re.ASCII) if len(m[2] if k == "assign" else m[0]) >= LEAST[k]]
    return sorted(spans, key=lambda x: (x[0], list(BASE).index(x[1])))


def odd():
    rng = random.Random(11)
    bits = ["password", "Passwd", "SECRET", "token", "api_key", "apikey", "ſecret", '"', "'", " ", "  ", ":", "=", "\n", "é", "🙂", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "deadbeef", "a", "Z", "9", "+/_.-", "%41", "\\u0041", "x.y"]
    texts = [(None, None), (1, None), (2, ""), (3, " \n"), (4, "Password: hunter22 AKIA" + "A1" * 9 + " " + "0a" * 12 + " token=abc"), (5, "x" * 50 + "%zz %41%4"), (6, f"token=abcdefg {b64(SECRET)} " * 300)]
    texts += [(100 + k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for k in range(1500)]
    return texts + texts[4:6]


def test_base_and_registered_query(spark, tmp_path):
    texts = odd()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id bigint, text string, findings string, id int").repartition(2)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    out = secrets.op4_secrets(spark, str(tmp_path))
    expected, found = [], set()
    for i, t in texts:
        b = brute(t or "")
        joined = ",".join(f"{k}:{s}:{e}" for s, k, e in b)
        expected.append((str(i), *(sum(x[1] == k for x in b) for k in BASE), hashlib.sha256(joined.encode()).hexdigest()))
        found |= {(str(i), x) for x in joined.split(",") if x}
    rows = out.collect()
    assert sorted((str(r["doc_id"]), r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in rows) == sorted(expected)
    assert found <= {(str(r["doc_id"]), x) for r in rows for x in r["spans"].split(",")}
    assert sum(x.startswith("assign") for r in rows if r["doc_id"] == 6 for x in r["spans"].split(",")) == 600
    assert secrets.scan_secrets(df.limit(0)).count() == 0
