"""Token counts of whole texts, however long, by overlap resynchronisation.

A text of at most ``chunk`` characters is encoded at once. A longer one is encoded in chunks that
overlap. Each encoding comes with the offsets of its token boundaries. Two neighbours are spliced at
a boundary that both have, that lies in the overlap, that is proven stable (``encoders.stable``) and
after which both have the same boundaries and counts up to the last stable one; where there is none,
the overlap is doubled, up to the whole of what is left. So no more than two chunks are in memory,
and the count equals the library's for the whole text.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows count each; a null id
stays null; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import table, text_or_empty
from textloom.llm.encoders import BYTE_BPE, BYTE_BPE_RANKS, encoder, stable


def _splice(left: tuple[list[int], list[int]], right: tuple[list[int], list[int]], a: int, b: int, text: str) -> tuple[int, int, int] | None:
    """``left`` and ``right`` are marks of text[a:...] and text[b:...]. Returns the place of the
    splice and the tokens before it in both, or None."""
    known = dict(zip((b + s for s in right[0][:-1]), right[1]))
    common = [(a + s, n, known[a + s]) for s, n in zip(left[0][:-1], left[1]) if a + s in known and stable(text, a + s)]
    if len(common) < 2:
        return None
    (at, n, m), (last, n2, m2) = common[0], common[-1]
    agree = [a + s for s in left[0] if at <= a + s <= last] == [b + s for s in right[0] if at <= b + s <= last]
    return (at, n, m) if agree and n2 - n == m2 - m else None


def count_tokens(text: str, enc, chunk: int = 32_768, overlap: int = 512) -> int:
    """Tokens of ``text`` under an encoder with ``ids`` and ``marks``."""
    if len(text) <= chunk:
        return len(enc.ids(text)) // 4
    total, a, skip = 0, 0, 0
    end = min(len(text), chunk)
    left = enc.marks(text[:end])
    while end < len(text):
        wide = overlap
        while True:
            b = max(a, end - wide)
            stop = min(len(text), b + max(chunk, 2 * wide))
            right = enc.marks(text[b:stop])
            found = _splice(left, right, a, b, text) if b > a else None
            if found or b == a:
                break
            wide *= 2
        if found:
            _, n, m = found
            total += n - skip
            a, skip = b, m
        # else the right chunk begins where the left one did and takes its place
        left, end = right, stop
    return total + left[1][-1] - skip


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = BYTE_BPE, ranks: str = BYTE_BPE_RANKS, limit: int = 1024, chunk: int = 32_768, overlap: int = 512) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_tokens``, ``over_limit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, ranks)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = part.column(1).to_pylist()
                n = pa.array([count_tokens(t, enc, chunk, overlap) for t in texts], pa.int64())
                size = pa.array([len(t) if t.isascii() else len(t.encode()) for t in texts], pa.int64())
                over = pa.array([x > limit for x in n.to_pylist()], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), size, n, over], names=["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t")).mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return out.withColumnRenamed("id", id_col)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under byte_bpe_50k.json."""
    return token_counts(table(spark, sf_dir, "documents"))
