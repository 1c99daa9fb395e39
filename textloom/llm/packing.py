"""Best-fit packing of documents into sequences of a fixed length, by non-negative least squares.

1. Every document is tokenized, ended with ``end_id`` and, only if it is longer than a sequence, cut
   into pieces of exactly that length, the first of which may be shorter.
2. Only the histogram of piece lengths (at most ``length`` rows) comes to the driver. There, patterns
   of one to three lengths that fill a sequence exactly are enumerated, repeat counts are fitted to
   the histogram by non-negative least squares (cyclic coordinate descent until the residual hardly
   falls), rounded down, and never use more pieces of a length than there are. Pieces left over are
   packed by best fit, longest first, on counts. Of several shares of the fit, none of it among them, the
   best plan is taken, so it is never worse than best fit alone. Plan and time depend on the sequence
   length, not on the corpus.
3. Pieces of one length are interchangeable: each gets its rank among them (by length and a salt
   whose number grows with the corpus, so that a length which many pieces share is spread over many
   tasks), and the plan says which sequence and place a rank has.

Defined results: null and empty texts are documents of one token, ``end_id``; repeated rows are
packed each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import materialize, table, text_or_empty
from textloom.llm.encoders import BYTE_BPE, BYTE_BPE_RANKS, encoder

LENGTH = 2048


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens."""
    first = n % length or length
    return [(0, first), *((k, length) for k in range(first, n, length))]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, tokenizer: str = BYTE_BPE, ranks: str = BYTE_BPE_RANKS, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, ranks)
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                row, piece, start, size, crc, ids = [], [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    data = enc.ids(text) + end
                    for j, (a, n) in enumerate(cut(len(data) // 4, length)):
                        own = data[4 * a : 4 * (a + n)]
                        row.append(i)
                        piece.append(j)
                        start.append(a)
                        size.append(n)
                        crc.append(zlib.crc32(own))
                        if with_ids:
                            ids.append(np.frombuffer(own, "<u4").astype("i8"))
                cols = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array(ids, pa.list_(pa.int64()))] if with_ids else [])], names=names)

    names = ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t")).mapInArrow(run, schema)


@dataclass
class Plan:
    """Slots: of the pieces of ``length`` those from rank ``first`` on go to the sequences from
    ``sequence`` on, at ``offset``. ``n_sequences`` in all. Sorted by (length, first)."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    n_sequences: int


def fit_repeats(hist: np.ndarray, length: int, sweeps: int = 4, least: float = 0.02) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of one to three lengths that fill a sequence, with whole repeat counts.

    ``hist[n]`` pieces have length n. Cyclic coordinate descent on ||A x - hist||^2, x >= 0; columns
    of A are patterns; it ends after ``sweeps``, or where one lowers the residual by less than ``least`` of it. Counts are rounded down and cut to the pieces that are there.
    """
    have = [n for n in range(1, length + 1) if hist[n] > 0]
    here = set(have)
    # a pattern is three lengths, 0 for none; arrays of numbers, as there are some 100,000s of patterns
    first, second, third = array("l"), array("l"), array("l")

    def add(a: int, b: int = 0, c: int = 0) -> None:
        first.append(a)
        second.append(b)
        third.append(c)

    if length in here:
        add(length)
    for a in reversed(have):
        if 2 * a >= length and length - a in here:
            add(a, length - a)
    for a in reversed(have):
        rest = length - a
        for b in reversed(have):
            if b > a or 2 * b < rest:
                continue
            if b < rest and rest - b in here:
                add(a, b, rest - b)
    left = hist.astype(float).tolist()
    x = array("d", bytes(8 * len(first)))
    before = math.inf
    for _ in range(sweeps):
        residual = sum(r * r for r in left)
        if residual > (1 - least) * before:
            break
        before = residual
        for k, (a, b, c) in enumerate(zip(first, second, third)):
            s = _shape(a, b, c)
            norm = sum(m * m for _, m in s)
            step = sum(m * left[n] for n, m in s) / norm
            if step < -x[k]:
                step = -x[k]
            if step:
                x[k] += step
                for n, m in s:
                    left[n] -= m * step
    free, out = hist.copy(), []
    for k in np.argsort(-np.frombuffer(x), kind="stable").tolist() if x else []:
        if x[k] < 1:
            break
        s = _shape(first[k], second[k], third[k])
        n = min(int(x[k]), *(int(free[a]) // m for a, m in s))
        if n > 0:
            out.append((tuple(a for a in (first[k], second[k], third[k]) if a), n))
            for a, m in s:
                free[a] -= m * n
    return out


def _shape(a: int, b: int, c: int) -> tuple[tuple[int, int], ...]:
    """The lengths of a pattern, longest first, and how often each is in it."""
    if not b:
        return ((a, 1),)
    if not c:
        return ((a, 2),) if a == b else ((a, 1), (b, 1))
    if a == b:
        return ((a, 3),) if b == c else ((a, 2), (c, 1))
    return ((a, 1), (b, 2)) if b == c else ((a, 1), (b, 1), (c, 1))


def best_fit(hist: np.ndarray, length: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts: patterns with how often each is used."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    out: list[tuple[tuple[int, ...], int]] = []
    for n in range(length, 0, -1):
        todo = int(hist[n])
        while todo:
            space = min((s for s in open_ if s >= n), default=0)
            if not space:
                fits = length // n  # new sequences, each filled with this length as far as it goes
                new, rest = divmod(todo, fits)
                todo = 0
                for times, many in ((fits, new), (rest, 1)):
                    if times and many:
                        _put(open_, out, (n,) * times, many, length - n * times)
                continue
            pattern, count = open_[space].pop()
            if not open_[space]:
                del open_[space]
            used = min(count, todo)
            if count > used:
                open_.setdefault(space, []).append((pattern, count - used))
            todo -= used
            _put(open_, out, (*pattern, n), used, space - n)
    return out + [x for group in open_.values() for x in group]


def _put(open_: dict, out: list, pattern: tuple[int, ...], count: int, space: int) -> None:
    if space:
        open_.setdefault(space, []).append((pattern, count))
    else:
        out.append((pattern, count))


def make_plan(hist: np.ndarray, length: int) -> Plan:
    """``hist`` has ``length + 1`` counts. Rounding leaves too few short pieces to fill up with, so
    a few shares of the fitted counts are tried and the plan with the fewest sequences is taken."""
    whole, best = fit_repeats(hist, length), None
    for share in (1.0, 0.95, 0.9, 0.7, 0.5, 0.0):
        fitted = [(p, int(n * share)) for p, n in whole if int(n * share)]
        rest = hist.copy()
        for pattern, n in fitted:
            for a in pattern:
                rest[a] -= n
        every = fitted + best_fit(rest, length)
        if best is None or sum(n for _, n in every) < sum(n for _, n in best):
            best = every
    used = np.zeros(length + 1, dtype=np.int64)
    rows, sequence = [], 0
    for pattern, n in best:
        offset = 0
        for a in pattern:
            rows.append((a, int(used[a]), sequence, offset))
            used[a] += n
            offset += a
        sequence += n
    cols = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4).T
    return Plan(cols[0], cols[1], cols[2], cols[3], sequence)


def assign(parts: DataFrame, plan: Plan, length: int = LENGTH, total: int = 0, rows_per_salt: int = 1_000_000) -> DataFrame:
    """``parts`` with ``sequence_id`` and ``offset``. Ranks within (length, salt), then the start of
    each salt among the pieces of its length, from a table of counts."""
    salts = max(16, -(-total // rows_per_salt))
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = counts.select(F.col("length").alias("_length"), F.col("_salt").alias("_s"), (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("id", "piece", "ids_crc32")) - 1)
    joined = ranked.join(before, (F.col("length") == F.col("_length")) & (F.col("_salt") == F.col("_s"))).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_salt", "_s", "_length", "_before")
    by_length, first, sequence, offset = plan.length, plan.first, plan.sequence, plan.offset

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = np.int64(first.max(initial=0) + 1)
        key = by_length * (scale + 1) + first
        for batch in batches:
            n = batch.column("length").to_numpy(zero_copy_only=False)
            r = batch.column("_rank").to_numpy(zero_copy_only=False)
            slot = np.searchsorted(key, n * (scale + 1) + np.minimum(r, scale), "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(sequence[slot] + r - first[slot], pa.int64()), pa.array(offset[slot], pa.int64())],
                names=[*keep, "sequence_id", "offset"],
            )

    keep = parts.columns
    schema = ", ".join(f"`{c}` {t}" for c, t in parts.dtypes) + ", sequence_id bigint, offset bigint"
    return joined.select(*keep, "_rank").mapInArrow(run, schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **encode) -> DataFrame:
    """One row per piece with its place: id, ``piece``, ``start``, ``length``, ``ids_crc32`` (``ids``
    too with ``with_ids=True``), ``sequence_id``, ``offset``."""
    parts = materialize(pieces(docs, id_col, text_col, length, **encode), "pieces")
    hist = np.zeros(length + 1, dtype=np.int64)
    for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most `length` rows
        hist[r["length"]] = r["n"]
    plan = make_plan(hist, length)
    return assign(parts, plan, length, int(hist.sum())).withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences of ``pack(..., with_ids=True)``: ``sequence_id`` and all its ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of 2048 tokens of byte_bpe_50k.json."""
    return pack(table(spark, sf_dir, "documents"))
