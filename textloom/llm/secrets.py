"""Secret scan with a recursive decoding worklist.

The text is the first layer. Each layer is scanned, then unwrapped: percent escapes and Unicode
escapes are decoded in place, base64 runs (also such as are wrapped over lines) are decoded, and what
they hold is decompressed where it is gzip, zlib or bz2, all members of it and as often as it is packed.
Every result that is text is a new layer, until no new layer appears. A layer whose digest was seen in
the same place is not scanned again, so cycles end. Offsets are carried along: a finding in any layer is
reported as the stretch of the original text that it came from.

Findings of the first layer are the base: leftmost non-overlapping matches per kind.

Layers are taken from the worklist one at a time, depth first, and packed data is unpacked block by block
(first to see that all of it is text, then to scan it), so memory holds a block for each level. A layer of
more than ``max_layer`` characters is scanned in blocks to its end and counted in ``n_oversize``. Blocks
end where no finding and no wrapped run is cut; only in a run without such a place do they overlap by
``OVERLAP`` characters, so there a single base64 run of more than half of ``max_layer`` characters within
packed data is not unpacked again.

Defined results: null and empty texts have no findings; a stream that ends early or breaks is read as far
as it goes; repeated rows are scanned each; a null id stays null; extra columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import table, text_or_empty

KINDS = ("assign", "access", "hex")
#: Characters of a packed layer that are scanned at once, bytes that are unpacked at once, characters that
#: blocks share where a run has no break.
MAX_LAYER, UNPACKED, OVERLAP = 1 << 26, 1 << 22, 1 << 12

_assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_access = re.compile(r"AKIA[A-Z0-9]+")
_hex = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_percent = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_escape = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+|\\u\{[0-9A-Fa-f]{1,6}\}|&#x[0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
_base64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
_more = re.compile(r"[ \t]*\r?\n[ \t]*([A-Za-z0-9+/_-]+={0,2})")
_control = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")
#: Where no finding and no wrapped run is cut; a space is safe between letters only.
_break = re.compile(r"(?<![A-Za-z0-9+/_=\r-])\n|\n(?![ \t]*[A-Za-z0-9+/_-])|[,<>()|!?*~^$@\[\]]|(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")

#: A layer's stretches: where each starts in the layer, and its stretch of the original text. In a
#: stretch as long as its source, characters map one to one; else each maps to the whole source.
Stretches = list[tuple[int, int, int]]


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of one layer."""
    out = [("assign", m.start(), m.end()) for m in _assign.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _access.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in _hex.finditer(text)]
    return out


class Layer:
    def __init__(self, text: str, stretches: Stretches, path: str) -> None:
        self.text, self.stretches, self.path = text, stretches, path
        self.starts = [s[0] for s in stretches]

    def origin(self, a: int, b: int) -> tuple[int, int]:
        """The stretch of the original text that [a, b) came from."""
        return self._at(a)[0], self._at(b - 1)[1]

    def _at(self, i: int) -> tuple[int, int]:
        k = bisect_right(self.starts, i) - 1
        at, a, b = self.stretches[k]
        size = (self.starts[k + 1] if k + 1 < len(self.starts) else len(self.text)) - at
        return (a + i - at, a + i - at + 1) if size == b - a else (a, b)

    def rewritten(self, pattern: re.Pattern, decode, step: str) -> Layer | None:
        """With every match replaced by what ``decode`` makes of it."""
        parts, stretches, at, done = [], [], 0, 0
        for m in pattern.finditer(self.text):
            new = decode(m[0])
            if new is None:
                continue
            at = self._keep(parts, stretches, at, done, m.start())
            if new:
                stretches.append((at, *self.origin(m.start(), m.end())))
                parts.append(new)
                at += len(new)
            done = m.end()
        if not done:
            return None
        self._keep(parts, stretches, at, done, len(self.text))
        return Layer("".join(parts), stretches, f"{self.path}/{step}") if stretches else None

    def _keep(self, parts: list[str], stretches: Stretches, at: int, a: int, b: int) -> int:
        k = bisect_right(self.starts, a) - 1
        while a < b:
            end = min(b, self.starts[k + 1] if k + 1 < len(self.starts) else len(self.text))
            whole = self._at(a)
            last = self._at(end - 1)
            stretches.append((at, whole[0], last[1]))
            parts.append(self.text[a:end])
            at += end - a
            a, k = end, k + 1
        return at


def _from_percent(s: str) -> str | None:
    return _text(bytes.fromhex(s.replace("%", "")), 1)


def _from_escape(s: str) -> str | None:
    if s[0] == "&":
        points = [int(s[3:-1], 16) if s[2] in "xX" else int(s[2:-1])]
    elif s[1] == "x":
        return _text(bytes.fromhex(s.replace("\\x", "")), 1)
    elif s[2] == "{":
        points = [int(s[3:-1], 16)]
    elif s[1] == "U":
        points = [int(s[2:], 16)]
    else:
        units = [int(x, 16) for x in s.split("\\u")[1:]]
        return _decoded(b"".join(u.to_bytes(2, "big") for u in units), "utf-16-be")
    return None if any(p > 0x10FFFF or 0xD800 <= p <= 0xDFFF for p in points) else "".join(map(chr, points))


def _decoded(data: bytes, code: str) -> str | None:
    try:
        return data.decode(code)
    except UnicodeDecodeError:
        return None


def _text(data: bytes, least: int = 8) -> str | None:
    """``data`` as text, if it is UTF-8 without control characters."""
    s = _decoded(data, "utf-8") if len(data) >= least else None
    return s if s is not None and not _control.search(s) else None


def _opened(head: bytes):
    """A new decompressor for what begins so, or None."""
    if head[:2] == b"\x1f\x8b" or (len(head) > 2 and head[0] == 0x78 and (head[0] << 8 | head[1]) % 31 == 0):
        return zlib.decompressobj(wbits=47)
    return bz2.BZ2Decompressor() if head[:3] == b"BZh" else None


def _unpacked(data: Iterator[bytes]) -> Iterator[bytes]:
    """What packed ``data`` holds, all members, block by block; ends where it is no packed data."""
    z, rest = None, b""
    try:
        for block in data:
            rest += block
            while rest:
                if z is None:
                    if len(rest) < 3:
                        break
                    z = _opened(rest)
                    if z is None:
                        return
                out = z.decompress(rest, UNPACKED)
                rest = z.unconsumed_tail if hasattr(z, "unconsumed_tail") else b""
                if out:
                    yield out
                if z.eof:
                    rest, z = z.unused_data.lstrip(b"\0"), None
                elif hasattr(z, "needs_input"):
                    while not z.needs_input and not z.eof:
                        yield z.decompress(b"", UNPACKED)
                    if z.eof:
                        rest, z = z.unused_data, None
    except (zlib.error, OSError, EOFError, ValueError):
        return


def _levels(data: bytes) -> int:
    """How often ``data`` is packed."""
    n = 0
    while True:
        first = next(_content(data, n), b"")
        if _opened(first) is None or not next(_content(data, n + 1), b""):
            return n
        n += 1


def _content(data: bytes, levels: int) -> Iterator[bytes]:
    """``data`` unpacked so many times."""
    blocks = iter((data,))
    for _ in range(levels):
        blocks = _unpacked(blocks)
    return blocks


def _texts(data: bytes, levels: int) -> Iterator[str]:
    decoder = codecs.getincrementaldecoder("utf-8")()
    for block in _content(data, levels):
        yield decoder.decode(block)


def _is_text(data: bytes, levels: int) -> bool:
    n = 0
    try:
        for t in _texts(data, levels):
            n += len(t)
            if _control.search(t):
                return False
    except UnicodeDecodeError:
        return False
    return n > 0


def _blocks(texts: Iterator[str], most: int) -> Iterator[str]:
    """One text, or blocks of at most about ``most`` characters that end where no finding is cut."""
    held = ""
    for t in texts:
        held += t
        while len(held) > most:
            at = max((m.end() for m in _break.finditer(held, most // 2, most)), default=0) or held.rfind("\n", most // 2, most) + 1
            yield held[: at or most]
            held = held[at or most - min(OVERLAP, most // 2) :]
    if held:
        yield held


def _runs(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, characters) of base64 runs: on one line, and wrapped ones: after the first line lines
    of one length, of which the last may be shorter."""
    upto = 0
    for m in _base64.finditer(text):
        yield m.start(), m.end(), m[0]
        if m.start() < upto or m.end() >= len(text) or text[m.end()] not in " \t\r\n" or m[0].endswith("="):
            continue
        lines, size, at = [m[0]], None, m.end()
        while next_ := _more.match(text, at):
            size = size or len(next_[1])
            if len(next_[1]) > size:
                break
            if len(lines) > 1 and len(next_[1]) < size:  # without a shorter last line, which may be a word
                yield m.start(), at, "".join(lines)
            lines.append(next_[1])
            at = next_.end()
            if len(next_[1]) < size or next_[1].endswith("="):
                break
        if len(lines) > 1:
            yield m.start(), at, "".join(lines)
            upto = at


def _inside(layer: Layer, max_layer: int, oversize: list) -> Iterator[Layer]:
    """Layers that base64 runs hold."""
    for a, b, run in _runs(layer.text):
        s = run.rstrip("=").replace("-", "+").replace("_", "/")
        if len(s) % 4 == 1:
            continue
        try:
            data = base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
        except (binascii.Error, ValueError):
            continue
        where, levels = [(0, *layer.origin(a, b))], _levels(data)
        if not levels:
            if text := _text(data):
                yield Layer(text, where, f"{layer.path}/base64")
        elif _is_text(data, levels):
            for k, text in enumerate(_blocks(_texts(data, levels), max_layer)):
                if k == 1:
                    oversize.append(where)
                yield Layer(text, where, f"{layer.path}/base64{'/unpack' * levels}")


def _unwrapped(layer: Layer, max_layer: int, oversize: list) -> Iterator[Layer]:
    """All layers that a layer holds."""
    if "%" in layer.text and (new := layer.rewritten(_percent, _from_percent, "url")):
        yield new
    if ("\\" in layer.text or "&#" in layer.text) and (new := layer.rewritten(_escape, _from_escape, "unicode")):
        yield new
    yield from _inside(layer, max_layer, oversize)


def findings(text: str, max_layer: int = MAX_LAYER) -> tuple[list[tuple[str, int, int, str]], int, int]:
    """((kind, start, end, layer path), ...) with path ``""`` for the base; layers; layers in blocks."""
    out = {(k, a, b): "" for k, a, b in scan(text)}
    oversize: list = []
    seen, layers = set(), 0
    work = [_unwrapped(Layer(text, [(0, 0, len(text))], ""), max_layer, oversize)]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        key = hashlib.blake2b(f"{layer.stretches[0][1]}:{layer.stretches[-1][2]}:{layer.text}".encode(), digest_size=16).digest()
        if key in seen:
            continue
        seen.add(key)
        layers += 1
        for kind, a, b in scan(layer.text):
            out.setdefault((kind, *layer.origin(a, b)), layer.path)
        work.append(_unwrapped(layer, max_layer, oversize))
    order = sorted(out.items(), key=lambda x: (x[0][1], KINDS.index(x[0][0]), x[0][2]))
    return [(*k, path) for k, path in order], layers, len(oversize)


FINDING = "array<struct<kind:string,start:int,end:int,layer:string>>"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_layer: int = MAX_LAYER) -> DataFrame:
    """One row per document: id, ``findings`` (by start, then kind), ``n_layers``, ``n_oversize``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("layer", pa.string())]))
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                got = [findings(t, max_layer) for t in part.column(1).to_pylist()]
                rows = pa.array([[dict(zip(("kind", "start", "end", "layer"), f)) for f in g[0]] for g in got], kind)
                yield pa.RecordBatch.from_arrays([part.column(0), rows, pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32())], names=["id", "findings", "n_layers", "n_oversize"])

    own = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t")).mapInArrow(run, f"id {own}, findings {FINDING}, n_layers int, n_oversize int")
    return out.withColumnRenamed("id", id_col)


def spans_text(found) -> F.Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: counts and digest of the base, all spans."""
    df = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("findings", lambda f: f["layer"] == "")
    count = lambda kind: F.size(F.filter(base, lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return df.select("doc_id", *map(count, KINDS), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("findings")).alias("spans"), "n_layers", "n_oversize")
