"""Near-duplicate classes by ProbMinHash over sets of shingles, banding and exact verification.

Words are what ASCII white space parts, lower-cased; a shingle is five words (a shorter text is one
shingle of all its words). How often a text has a shingle does not count: signatures, the limit on
registers and the verdict all go by the Jaccard similarity of the sets.

1. Texts with the same words are one group, found by a 64-bit digest; one member's text stands for it.
2. Signatures: shingle d sends arrivals of a Poisson process with rate 1, each to a random
   register, which keeps the first to arrive; a shingle stops as soon as its next arrival is later
   than the latest register (early termination). Two registers are equal with the probability of the
   Jaccard similarity. All shingles of a batch of texts go through the rounds together.
3. Banding: 27 keys of 7 registers. At a similarity of 0.8 a pair shares a key with probability 0.998.
4. Verification of groups that share a key, by the Jaccard similarity of the shingle sets:
   a. Two rounds: in each bucket one centre is compared with every member that is not in its component
      yet. Centres are the texts that share keys with the most others, so they lie in the middle of a
      class and are the same in most of its buckets; in the second round, of the texts outside the
      first one's component.
   b. Pairs in one bucket that are still in different components are compared each, so no candidate
      pair goes unjudged. The class is the component, so pairs within one need no comparison.
   Four bits of each register go along; a pair of which more registers differ than 4 standard
   deviations above what a similarity of 0.8 gives is not compared (a chance of 1 in 9,500 at 0.8). A pair that shares several keys leaves the join with the least of them only.
5. Components by label propagation with pointer jumping on tables in the shared folder.

Texts move only for groups that share a key with another: a Bloom filter of those goes with the scan
(within ``max_bits``; beyond, all texts move).

Defined results: null, empty and blank texts have no words and are one class; repeated rows with one
id share a class if their words are near; a null id is kept, in the class of its text, and names it
only if no other member has an id; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import free, materialize, packed, quoted, table, text_or_empty, unpacked
from textloom.llm.url_filter import bloom_filter, bloom_filter_parts

WORDS, SIMILARITY, ROWS, BANDS = 5, 0.8, 7, 27
#: Characters of text that are hashed at once.
BATCH = 1 << 20
#: Pairs of one centre that go to one task.
SHARE = 500

_u = np.uint64
_MIX1, _MIX2, _STEP = _u(0xBF58476D1CE4E5B9), _u(0x94D049BB133111EB), _u(0x9E3779B97F4A7C15)
_BASE = _u(0x100000001B3)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> _u(30))) * _MIX1
    x = (x ^ (x >> _u(27))) * _MIX2
    return x ^ (x >> _u(31))


_POWERS = np.cumprod(np.full(1 << 12, _BASE, dtype=np.uint64))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the words of each text."""
    data = np.frombuffer("\n".join(t.lower().replace("\n", " ") for t in texts).encode() + b"\n", np.uint8)
    white = (data == 32) | ((data >= 9) & (data <= 13))
    step = np.flatnonzero(np.diff(white.astype(np.int8), prepend=1))
    starts = step[~white[step]]  # of words
    ends = np.concatenate([step[white[step]], []]).astype(np.int64)
    ends = ends[ends > starts[0]] if len(starts) else ends[:0]
    own = np.searchsorted(np.flatnonzero(data == 10), starts)
    counts = np.bincount(own, minlength=len(texts))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    size = ends - starts
    place = np.arange(len(data), dtype=np.int64)
    inside = ~white
    which = np.repeat(np.arange(len(starts)), size)
    place = place[inside] - starts[which]
    value = (data[inside].astype(np.uint64) + _u(1)) * mix(_POWERS[place & 4095] + (place >> 12).astype(np.uint64))
    return mix(np.add.reduceat(value, np.concatenate([[0], np.cumsum(size)[:-1]])) ^ size.astype(np.uint64)), counts


def shingles(h: np.ndarray, counts: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, times it occurs) of all texts, by text and hash."""
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    n = np.where(counts >= words, counts - words + 1, (counts > 0).astype(np.int64))
    own = np.repeat(np.arange(len(counts)), n)
    start = first[own] + (np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n))
    key = np.zeros(len(own), np.uint64)
    size = np.minimum(counts[own], words)
    for k in range(words):
        has = k < size
        key[has] = mix(key[has] + h[start[has] + k] + _STEP)
    order = np.lexsort((key, own))
    own, key = own[order], key[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(new)
    return own[at], key[at], np.diff(at, append=len(own))


def signatures(own: np.ndarray, key: np.ndarray, times: np.ndarray, n: int, registers: int) -> np.ndarray:
    """ProbMinHash signatures of ``n`` texts: in each register the hash of the first to arrive.

    A round sends the next few arrivals of every shingle that goes on: so many that one round is
    mostly enough for a text.
    """
    first = np.full(n * registers, np.inf)
    winner = np.zeros(n * registers, np.uint64)
    need = registers * (np.log(registers) + 1.5)
    each = np.maximum(1, np.ceil(need / np.maximum(np.bincount(own, minlength=n), 1))).astype(np.int64)
    rate = 1.0 + np.log(times)
    at, when, sent = np.arange(len(key)), np.zeros(len(key)), np.zeros(len(key), np.int64)
    while len(at):
        m = each[own[at]]
        end = np.cumsum(m)
        src = np.repeat(np.arange(len(at)), m)
        number = sent[src] + (np.arange(len(src)) - (end - m)[src])
        state = mix(mix(key[at][src]) + number.astype(np.uint64) * _STEP)
        gap = -np.log1p(-(state >> _u(11)).astype(np.float64) * 2.0**-53) / rate[at][src]
        total = np.cumsum(gap)
        x = total - np.repeat((total[end - 1] - np.add.reduceat(gap, end - m)), m) + when[src]
        register = own[at][src] * registers + (((mix(state ^ _MIX1) >> _u(32)) * _u(registers)) >> _u(32)).astype(np.int64)
        np.minimum.at(first, register, x)
        won = np.flatnonzero(x == first[register])
        winner[register[won]] = key[at[src[won]]]
        latest = first.reshape(n, registers).max(axis=1)
        when, sent = x[end - 1], sent + m
        go = when < latest[own[at]]
        at, when, sent = at[go], when[go], sent[go]
    return winner.reshape(n, registers)


def batches_of(texts: list[str], size: int = BATCH) -> Iterator[tuple[int, int]]:
    """[a, b) of texts of about ``size`` characters together."""
    a, n = 0, 0
    for k, t in enumerate(texts):
        n += len(t) + 1
        if n >= size:
            yield a, k + 1
            a, n = k + 1, 0
    if a < len(texts):
        yield a, len(texts)


def sign(docs: DataFrame, words: int, rows: int, bands: int) -> DataFrame:
    """(id, h, digest, bands, few) of rows (id, h, t); a text without words has no bands. ``few``:
    four bits of each register."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(bands, dtype=np.uint64) * _STEP
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = part.column(2).to_pylist()
                for a, b in batches_of(texts):
                    n = b - a
                    hashes, counts = word_hashes(texts[a:b])
                    own, key, _ = shingles(hashes, counts, words)
                    sig = signatures(own, key, np.ones(len(key), np.int64), n, rows * bands)
                    few = np.zeros((n, -(-rows * bands // 16) * 16), np.uint8)
                    few[:, : rows * bands] = mix(sig) >> _u(60)
                    few = (few[:, ::2] << 4 | few[:, 1::2]).view(np.int64)
                    sig = sig.reshape(n, bands, rows)
                    band = np.broadcast_to(salt, (n, bands))
                    for r in range(rows):
                        band = mix(band + sig[:, :, r] + _STEP)
                    some = counts > 0
                    ends = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).slice(a, n), part.column(1).slice(a, n), pa.array(digests(hashes, counts).view(np.int64)), pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(band[some]).view(np.int64).ravel())), pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * few.shape[1], pa.array(few.ravel()))],
                        names=["id", "h", "digest", "bands", "few"],
                    )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, h bigint, digest bigint, bands array<bigint>, few array<bigint>")


def digests(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of each text's words in order; 0 without words."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        start = (np.cumsum(counts) - counts)[some]
        place = np.arange(len(hashes)) - np.repeat(start, counts[some])
        out[some] = mix(np.add.reduceat(mix(hashes + (place.astype(np.uint64) + _u(1)) * _STEP), start) + counts[some].astype(np.uint64)) | _u(1)
    return out


def _judge(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of digests whose shingle sets are similar enough. ``texts``: (digest, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                left = part.column("ta").dictionary_encode()
                many = left.dictionary.to_pylist()
                sets = _sets(many, words)
                own = _sets(part.column("tb").to_pylist(), words)
                keep = [_jaccard(sets[i], s) >= similarity for i, s in zip(left.indices.to_pylist(), own)]
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # a centre with very many pairs stands in several tasks, once in each
    pairs = materialize(pairs, "pairs")
    many = pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > SHARE).select(F.col("a").alias("digest"), F.ceil(F.col("n") / SHARE).cast("int").alias("parts"))
    own = texts.join(many, "digest", "left").select(F.col("digest").alias("a"), F.col("t").alias("ta"), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.coalesce("parts", F.lit(1)).alias("parts"))
    b = texts.select(F.col("digest").alias("b"), F.col("t").alias("tb"))
    dealt = pairs.join(many.select(F.col("digest").alias("a"), "parts"), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    return dealt.join(b, "b").join(own.drop("parts"), ["a", "part"]).select("a", "ta", "b", "tb").mapInArrow(run, "a bigint, b bigint")


def _sets(texts: list[str], words: int) -> list[np.ndarray]:
    out = []
    for a, b in batches_of(texts):
        own, key, _ = shingles(*word_hashes(texts[a:b]), words)
        out += np.split(key, np.searchsorted(own, np.arange(1, b - a)))
    return out


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def components(nodes: DataFrame, edges: DataFrame, name: str = "label") -> DataFrame:
    """(digest, ``name``): the least digest of the component. Each round every node takes the least
    label among its neighbours' and then its label's own label; ends when nothing changes, as labels
    only fall. A round's table goes when the next one is there."""
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    label = materialize(both.select(F.col("a").alias("digest")).distinct().withColumn("l", F.col("digest")), "labels")
    moved, last = True, label
    while moved:
        near = both.join(label, F.col("b") == F.col("digest")).groupBy("a").agg(F.min("l").alias("m"))
        new = label.join(near, label["digest"] == near["a"], "left").select("digest", "l", F.least("l", "m").alias("m"))
        up = label.select(F.col("digest").alias("m"), F.col("l").alias("up"))
        new = materialize(new.join(up, "m", "left").select("digest", F.coalesce("up", "m").alias("l"), (F.coalesce("up", "m") != F.col("l")).alias("moved")), "labels")
        moved = not new.where("moved").isEmpty()
        free(last)
        label, last = new.select("digest", "l"), new
    return nodes.join(label, "digest", "left").select("digest", F.coalesce("l", "digest").alias(name))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, rows: int = ROWS, bands: int = BANDS, max_bits: int = 1 << 27) -> DataFrame:
    """One row per input row: id, ``text_hash`` (xxhash64 of the text), ``class_id`` (the least id of
    its class), ``class_size`` (rows), ``stays`` (whether the row is the one of its class to keep:
    least id, then least hash)."""
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t")).select("id", F.xxhash64("t").alias("h"), "t")
    signed = materialize(sign(base, words, rows, bands), "signed")
    groups = materialize(signed.groupBy("digest").agg(_least("id", "h").alias("least"), F.count("*").alias("n"), F.any_value("bands").alias("bands"), F.any_value("few").alias("few")), "groups")
    seats = groups.select(F.explode("bands").alias("key"), "digest").repartition("key")
    crowded = seats.groupBy("key").agg(F.min("digest").alias("x"), F.max("digest").alias("y"), F.count("*").alias("size")).where("x != y").select("key", "size")
    seats = materialize(seats.join(crowded, "key"), "seats")
    nodes = materialize(groups.select("digest", "least.id", "least.h", "few", "bands").join(seats.groupBy("digest").agg(F.sum("size").alias("links")), "digest"), "nodes")
    seats = seats.select("key", "digest")
    code = F.xxhash64("id", "h")
    maybe = bloom_filter(nodes.select(code.alias("key")), max_bits)
    found = base.where(maybe(code)) if maybe else base
    texts = found.join(nodes, found["id"].eqNullSafe(nodes["id"]) & (found["h"] == nodes["h"])).select("digest", "t").dropDuplicates(["digest"])
    texts = materialize(texts, "texts")
    few, near = nodes.select("digest", "few"), _near(rows * bands, similarity)
    label, edges = nodes.select("digest", F.col("digest").alias("label")), None
    for turn in range(3):
        placed = seats.join(label.join(nodes.select("digest", "links"), "digest"), "digest")
        centre = F.max(F.struct("links", "digest", "label"))
        split = placed.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), centre.alias("c")).where("x != y").select("key", "c")
        if turn == 1:
            split = placed.join(split, "key").where("label != c.label").groupBy("key").agg(centre.alias("c"))
        if turn < 2:
            pairs = placed.join(split, "key").where("label != c.label").select(F.col("c.digest").alias("a"), F.col("digest").alias("b"))
        else:
            pairs = _across(placed.drop("links"), split.select("key"), nodes.select("digest", "few", "bands"), near, bands)
        pairs = pairs.distinct()  # a is the centre
        if turn < 2:
            pairs = pairs.join(few.withColumnsRenamed({"digest": "a", "few": "fa"}), "a").join(few.withColumnsRenamed({"digest": "b", "few": "fb"}), "b").where(near("fa", "fb")).select("a", "b")
        new = materialize(_judge(pairs, texts, words, similarity), "judged")
        if new.limit(1).count():
            edges = new if edges is None else edges.union(new)
            label = materialize(components(nodes.select("digest"), edges), "classes")
    classes = groups.select("digest", "least", "n").join(label, "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    whole = classes.groupBy("label").agg(_least("least.id", "least.h").alias("top"), F.sum("n").alias("class_size"))
    member = classes.select("digest", "label").join(whole, "label").select("digest", "top", "class_size")
    out = signed.select("id", "h", "digest").join(member, "digest")
    return out.select(F.col("id").alias(id_col), F.col("h").alias("text_hash"), F.col("top.id").alias("class_id"), "class_size", (F.col("id").eqNullSafe(F.col("top.id")) & (F.col("h") == F.col("top.h"))).alias("stays"))


def _least(own: str, h: str) -> F.Column:
    """The least (id, hash); null ids last."""
    s = F.min(F.struct(F.col(own).isNull().alias("none"), F.col(own).alias("id"), F.col(h).alias("h")))
    return s


def _near(registers: int, similarity: float):
    """A condition on two ``few``: not more registers differ than ``similarity`` allows."""
    p = (1 - similarity) * 15 / 16
    most = registers * p + 4 * (registers * p * (1 - p)) ** 0.5

    def near(a: str, b: str) -> F.Column:
        differ = F.lit(0)
        for k in range(-(-registers // 16)):
            x = F.get(F.col(a), F.lit(k)).bitwiseXOR(F.get(F.col(b), F.lit(k)))
            for step in (1, 2):
                x = x.bitwiseOR(F.shiftrightunsigned(x, step))
            differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
        return differ <= most

    return near


def _across(placed: DataFrame, split: DataFrame, marks: DataFrame, near, bands: int) -> DataFrame:
    """Pairs of one bucket in different components: members outside the bucket's main component with
    all others. Work per bucket: its size times what the rounds have left outside, a few bit
    operations each; only near pairs leave the join."""
    open_ = placed.join(split, "key").join(marks, "digest")
    main = open_.groupBy("key", "label").agg(F.count("*").alias("m")).groupBy("key").agg(F.max_by("label", F.struct("m", "label")).alias("main"))
    open_ = open_.join(main, "key")
    minor = open_.where("label != main").select("key", F.col("digest").alias("b"), F.col("label").alias("lb"), F.col("few").alias("fb"), F.col("bands").alias("kb"))
    every = open_.select("key", F.col("digest").alias("a"), F.col("label").alias("la"), "main", F.col("few").alias("fa"), F.col("bands").alias("ka"))
    earlier = F.lit(False)
    for k in range(bands):
        earlier = earlier | ((F.get("ka", F.lit(k)) == F.get("kb", F.lit(k))) & (F.get("ka", F.lit(k)) < F.col("key")))
    return minor.withColumnRenamed("key", "k2").join(every, (F.col("key") == F.col("k2")) & F.expr("la != lb and (la = main or a < b)") & near("fa", "fb") & ~earlier).select("a", "b")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 1 << 28, **options) -> DataFrame:
    """``docs`` with one row of each class: that with the least id (then hash); of repeated rows one.

    Only rows that go, or that may (a Bloom filter), move; all others pass through the scan. The caller's
    columns travel as one, so their names cannot clash.
    """
    found = materialize(near_duplicates(docs, id_col, text_col, **options).select(F.col(id_col).alias("i"), F.col("text_hash").alias("h"), "stays"), "verdicts")
    special = found.groupBy("i", "h").agg(F.count("*").alias("n"), F.any_value("stays").alias("stays")).where("n > 1 or not stays")
    special = materialize(special, "special")
    words, maybe = bloom_filter_parts(special.select(F.xxhash64("i", "h").alias("key")), max_bits)
    rows = docs.select(packed(docs), F.col(quoted(id_col)).alias("id"), F.xxhash64(text_or_empty(F.col(quoted(text_col)))).alias("hash"))
    rest = None
    if maybe:
        rows = rows.withColumn("maybe", maybe(F.xxhash64("id", "hash"), words))
        rest, rows = rows.where("not maybe").select("row"), rows.where("maybe")
    rows = rows.join(special, F.col("id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h")), "left")
    once = rows.where("stays").select("row", F.row_number().over(Window.partitionBy("i", "h").orderBy("hash")).alias("k")).where("k = 1").select("row")
    out = rows.where("stays is null").select("row").unionByName(once)
    return (out.unionByName(rest) if rest is not None else out).select(*unpacked(docs.columns))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")
