"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes: each byte's table entry, shifted by its distance, over the
last 32 bytes. A chunk ends where the hash's top bits are zero: nine bits before the chunk has its
normal size, five after it (normalised chunking), never below the least or above the largest size
and never inside a character. An edit moves only the boundaries near it. The fingerprint is the set
of chunk digests, each with the bytes it covers; containment of one text in another is the share of
its bytes in chunks that the other has too.

For the comparison with the next document texts are laid out in ranges of (id, text hash), in one
exchange. The bounds of the ranges are rows that are picked by hash, the longer a text the likelier, so
that ranges have about ``bucket_bytes`` each; every bound is the first row of its range and goes to the
range before it too. Bounds are in a table of one row (some 20 bytes for each ``bucket_bytes``), which
tasks search by halves; the driver gets their number only. Results do not depend on the bounds.

Defined results: null counts as the empty text, whose fingerprint is empty; two empty texts have a
likeness of 1, an empty and another 0. Next documents go by ascending id (null first), rows of one
id by a hash of the text; ids may be of any type that can be ordered; a table of one row is its own
next; an empty table gives none. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import materialize, table, text_or_empty

LEAST, NORMAL, MOST = 32, 128, 512
STRICT, LOOSE = 9, 5


def _gear() -> np.ndarray:
    """256 entries by the splitmix64 rule."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def rolling(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, over the last 32: sums over 1, 2, 4, 8, 16, 32 bytes."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        if len(h) <= k:
            break
        wide = h.copy()
        wide[k:] += h[:-k] << np.uint32(k)
        h = wide
    return h


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks."""
    n = len(data)
    if not n:
        return []
    raw = np.frombuffer(data, np.uint8)
    h = rolling(raw)
    at = np.flatnonzero(h >> np.uint32(32 - LOOSE) == 0)
    strict = (h[at] >> np.uint32(32 - STRICT) == 0).tolist()
    out, last = [], 0
    for end, hard in zip((at + 1).tolist(), strict):
        if end >= n:
            break
        while end - last > MOST:
            last = _forced(data, last)
            out.append(last)
        size = end - last
        if size >= LEAST and (hard or size >= NORMAL) and data[end] & 0xC0 != 0x80:
            out.append(end)
            last = end
    while n - last > MOST:
        last = _forced(data, last)
        out.append(last)
    out.append(n)
    return out


def _forced(data: bytes, last: int) -> int:
    end = last + MOST
    while data[end] & 0xC0 == 0x80:
        end -= 1
    return end


def chunk_weights(data: bytes) -> dict[int, int]:
    """Bytes by chunk digest."""
    out: dict[int, int] = {}
    last, digest = 0, xxhash.xxh3_64_intdigest
    for end in boundaries(data):
        d = digest(data[last:end])
        out[d] = out.get(d, 0) + end - last
        last = end
    return out


def as_text(weights: dict[int, int]) -> str:
    """``digest:bytes``, by digest, comma-joined."""
    return ",".join([f"{d:016x}:{weights[d]}" for d in sorted(weights)])


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of ``a`` that ``b`` has too."""
    if not a:
        return 1.0 if not b else 0.0
    small, other = (a, b) if len(a) <= len(b) else (b, a)
    return sum(min(w, other.get(d, 0)) for d, w in small.items()) / sum(a.values())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_chars``, ``fingerprint``; no exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array([as_text(chunk_weights(t.encode())) for t in texts], pa.string())], names=["id", "n_chars", "fingerprint"])

    own = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t")).mapInArrow(run, f"id {own}, n_chars bigint, fingerprint string").withColumnRenamed("id", id_col)


#: Rows picked for each range; every so manyth is a bound.
PICKED = 8


def with_next(docs: DataFrame, bucket_bytes: int) -> DataFrame:
    """Rows (id, t) laid out so that each is followed, in its task and bucket, by its next: the first row
    of a bucket is in the bucket before it too (``guest``), that of all in the last."""
    key = F.struct("id", "h")
    rows = docs.withColumn("h", F.get(F.transform(F.array(F.xxhash64("t")), lambda x: x), F.lit(0)))
    chance = (F.octet_length("t") + 64) * F.lit(PICKED / bucket_bytes)
    picked = F.pmod(F.xxhash64(F.lit(8), "id", "h"), F.lit(1 << 30)) < chance * F.lit(float(1 << 30))
    one = rows.agg(F.min(key).alias("first"), F.array_sort(F.collect_set(F.when(picked, key))).alias("some"))
    bounds = F.filter("some", lambda x, i: (i % PICKED == PICKED - 1) & (x > F.col("first")))
    one = materialize(one.select("first", bounds.alias("bounds")), "bounds")
    n = one.select(F.size("bounds")).first()[0] or 0
    first, bounds = one.select("first").scalar(), one.select("bounds").scalar()
    # how many bounds are not above the key, by halves
    rows = rows.withColumn("key", key).withColumn("bucket", F.lit(0))
    for step in (1 << k for k in reversed(range(n.bit_length()))):
        at = F.col("bucket") + step
        rows = rows.withColumn("bucket", F.when((at <= n) & (F.get(bounds, at - 1) <= F.col("key")), at).otherwise(F.col("bucket")))
    starts = F.when(F.col("key") == first, n).when((F.col("bucket") > 0) & (F.get(bounds, F.col("bucket") - 1) == F.col("key")), F.col("bucket") - 1)
    own = F.struct("bucket", F.lit(False).alias("guest"))
    both = F.when(starts.isNotNull(), F.array(own, F.struct(starts.alias("bucket"), F.lit(True).alias("guest")))).otherwise(F.array(own))
    rows = rows.select("id", "t", "h", F.explode(both).alias("to")).select("id", "t", "h", "to.bucket", "to.guest")
    return rows.repartitionById(n + 1, "bucket").sortWithinPartitions("bucket", "guest", "id", "h").select("id", "t", "bucket", "guest")


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 16 << 20) -> DataFrame:
    """Fingerprints of every text, of its edited text (the second half replaced by the start of the
    next document) and their likeness, and the likeness to the next document."""

    def fingerprinted(rows: Iterator[tuple]) -> Iterator[tuple]:
        held, bucket, done = None, None, False
        for own, text, b, guest in rows:
            if b != bucket:
                held, bucket, done = None, b, False
            if held is None and guest or done:
                continue
            weights = chunk_weights(text.encode())
            if held is not None:
                yield _compared(*held, text, weights)
            held, done = (own, text, weights), guest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for k in range(0, batch.num_rows, 256) for r in zip(*(batch.column(c).slice(k, 256).to_pylist() for c in range(4))))
        out = []
        for row in fingerprinted(rows):
            out.append(row)
            if len(out) == 256:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(docs.schema[id_col].dataType), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    df = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))
    schema = f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(df, bucket_bytes).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _compared(own, text: str, weights: dict[int, int], following: str, following_weights: dict[int, int]) -> tuple:
    half = len(text) // 2
    edited = (text[: len(text) - half] + following[:half]).encode()
    changed = chunk_weights(edited)
    return own, len(text), hashlib.sha256(edited).hexdigest(), as_text(weights), as_text(changed), containment(weights, changed), containment(weights, following_weights)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, its edited text and its next."""
    return compare_edited(table(spark, sf_dir, "documents"))
