"""Lineage: which catalogue text an output came from."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PREFIX = 64
#: Texts meet by their first 1, 4, 16, ... bytes.
LEVELS = tuple(4**k for k in range(16))


def _digest(t: bytes) -> hashlib.blake2b:
    return hashlib.blake2b(t, digest_size=16)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, m, n, d, at) of (id, m, text): bytes, digest, and the first 64 bits of the digests of the
    beginnings that ``LEVELS`` name."""
    for batch in batches:
        n, d, at = [], [], []
        for t in batch.column(2).cast(pa.binary()).to_pylist():
            h, own, begun = _digest(b""), [], 0
            for k in LEVELS:
                if k > len(t):
                    break
                h.update(t[begun:k])
                own.append(int.from_bytes(h.digest()[:8], "little", signed=True))
                begun = k
            h.update(t[begun:])
            n.append(len(t))
            d.append(h.digest())
            at.append(own)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int32()), pa.array(d, pa.binary()), pa.array(at, pa.list_(pa.int64()))], names=["id", "m", "n", "d", "at"])


def _shrunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(side, d, z) of (side, text): digest and the compressed text."""
    codec = pa.Codec("zstd")
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        d, z = [_digest(t).digest() for t in texts], [codec.compress(t, asbytes=True) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d, pa.binary()), pa.array(z, pa.binary())], names=["side", "d", "z"])


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, side, m, src, h) of (t, side, m, src, n, z, lens): of each text the digests of its beginnings
    of the lengths in question."""
    codec = pa.Codec("zstd")
    for batch in batches:
        row, out = [], []
        for i, (n, z, lens) in enumerate(zip(*(c.to_pylist() for c in batch.columns[4:]))):
            t, h, begun = codec.decompress(z, n, asbytes=True), _digest(b""), 0
            for k in sorted(set(lens)):
                h.update(t[begun:k])
                begun = k
                row.append(i)
                out.append(h.digest())
        rows = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns[:4]), pa.array(out, pa.binary())], names=["t", "side", "m", "src", "h"])


def match_lineage(outputs: DataFrame, catalogue: DataFrame, out: str = "output", body: str = "body", key: str = "out_id", src: str = "src") -> DataFrame:
    """(``key``, ``src``, ``how``): the text equal to the output, else the longest that begins with it,
    else the longest that it begins with.

    Joins carry digests (128 bits; equal ones are equal texts). Texts that share their first 4^k bytes
    meet with the lengths of the shorter ones, which are under 4^(k+1), so a text has at most as many
    lengths to look at as four times its own; the digests of its beginnings of these lengths find the
    shorter texts. Each text moves once for that, compressed."""
    kinds = {c: dict(df.dtypes)[c] for df, c in ((outputs, key), (catalogue, src))}
    o = outputs.where(F.length(out) > 0).select(F.col(key).alias("id"), F.length(out).alias("m"), F.col(out).alias("x"))
    c = catalogue.where(F.length(body) > 0).select(F.col(src).alias("id"), F.length(body).alias("m"), F.col(body).alias("x"))
    sketch = lambda df, kind: df.mapInArrow(_sketches, f"id {kind}, m int, n int, d binary, at array<bigint>")
    own = sketch(o, kinds[key])
    both = own.select(F.lit(0).alias("side"), F.lit(None).cast(kinds[src]).alias("src"), "m", "n", "d", "at").unionByName(sketch(c, kinds[src]).select(F.lit(1).alias("side"), F.col("id").alias("src"), "m", "n", "d", "at"))
    # each text once: side 1 if it is a body, with its least key, else 0
    texts = both.groupBy("d").agg(F.max("side").alias("side"), F.min("side").alias("least"), F.min("src").alias("src"), F.first("m").alias("m"), F.first("n").alias("n"), F.first("at").alias("at")).persist()
    lens = texts.groupBy(F.element_at("at", -1).alias("h")).agg(*(F.collect_set(F.when(F.col("side") == k, F.col("n"))).alias(f"n{k}") for k in (0, 1)))
    met = texts.select("d", "side", "m", "src", "n", F.explode("at").alias("h")).join(lens, "h")
    met = met.withColumn("lens", F.filter(F.when(F.col("side") == 1, F.col("n0")).otherwise(F.col("n1")), lambda k: k < F.col("n"))).where("size(lens) > 0")
    met = met.groupBy("d", "side", "m", "src", "n").agg(F.flatten(F.collect_list("lens")).alias("lens"))
    moved = o.select(F.lit(0).alias("side"), "x").unionByName(c.select(F.lit(1).alias("side"), "x")).mapInArrow(_shrunk, "side int, d binary, z binary")
    begun = moved.join(met.hint("shuffle_hash"), ["side", "d"]).select("d", "side", "m", "src", "n", "z", "lens").mapInArrow(_beginnings, f"t binary, side int, m int, src {kinds[src]}, h binary")
    # a body that begins with an output, or an output that begins with a body
    pairs = begun.join(texts.select(F.col("d").alias("h"), F.col("side").alias("of"), F.col("m").alias("h_m"), F.col("src").alias("h_src")), "h").where("side != of")
    body = F.col("side") == 1
    pairs = pairs.select(*(F.when(body, a).otherwise(b).alias(n) for n, a, b in (("d", F.col("h"), F.col("t")), ("rank", F.lit(1), F.lit(2)), ("m", F.col("m"), F.col("h_m")), ("src", F.col("src"), F.col("h_src")))))
    exact = texts.where("side != least").select("d", F.lit(0).alias("rank"), "m", "src")
    least = F.min(F.struct("rank", (-F.col("m")).alias("neg"), F.col("src").isNull().alias("no"), "src"))
    best = exact.unionByName(pairs).groupBy("d").agg(least.alias("b"))
    best = own.select(F.col("id").alias(key), F.col("d").alias("_d")).join(best.withColumnRenamed("d", "_d"), "_d").groupBy(key).agg(F.min("b").alias("b"))
    rank = F.col("b.rank")
    how = F.when(F.col("b").isNull(), "none").when(rank == 0, "exact").when(rank == 1, "starts").otherwise("inside")
    return outputs.select(key).join(best, key, "left").select(key, F.col("b.src").alias(src), how.alias("how"))


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def source_shares(matched: DataFrame, source: str) -> DataFrame:
    """(source, n, percent) of outputs by where they came from, ``unmatched`` for null, and TOTAL. The
    outputs are matched once: the total is the largest of the few counts."""
    n = matched.rollup(F.coalesce(F.col(source), F.lit("unmatched")).alias("source")).agg(F.count("*").alias("n"))
    total = F.max("n").over(Window.partitionBy())
    return n.select(F.coalesce("source", F.lit("TOTAL")).alias("source"), "n", F.round(100.0 * F.col("n") / total, 1).alias("percent"))


def before_after(titles: DataFrame, before: DataFrame, after: DataFrame, title: str = "title", body: str = "body") -> DataFrame:
    """(needle, before_title, after_title, chars_before, chars_after): for each beginning of a title the
    first title in either table that starts with it, and the length of its body. ``titles`` is the small
    side; it goes to the others by its first characters."""
    needle = titles.select(F.col(title).alias("needle")).distinct()
    out = needle
    for name, df in (("before", before), ("after", after)):
        own = df.select(F.col(title).alias("_t"), F.length(body).alias("_n"))
        n = F.least(F.length("needle"), F.lit(PREFIX))
        lengths = [r[0] for r in needle.select(n.alias("n")).distinct().collect()]  # at most PREFIX numbers
        keys = own.withColumn("_k", F.explode(F.array(*(F.left("_t", F.lit(k)) for k in sorted(lengths))) if lengths else F.array().cast("array<string>")))
        hit = needle.join(keys.distinct(), (F.left("needle", F.lit(PREFIX)) == F.col("_k")) & F.col("_t").startswith(F.col("needle")))
        best = hit.groupBy("needle").agg(F.min(F.struct("_t", "_n")).alias("b")).select("needle", F.col("b._t").alias(f"{name}_title"), F.col("b._n").alias(f"chars_{name}"))
        out = out.join(best, "needle", "left")
    return out
