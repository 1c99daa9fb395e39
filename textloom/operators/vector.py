"""Embedding, exact nearest neighbours, reranking and context packing."""

from __future__ import annotations

import random
import time
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as X


class Embedder(Protocol):
    """What turns texts into vectors; an external model stands behind this."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Generator(Protocol):
    """What completes a prompt; an external model stands behind this."""

    def generate(self, prompt: str) -> str: ...


class HashingEmbedder:
    """Deterministic stand-in without a model: signed word hashes, normalised."""

    def __init__(self, size: int = 64) -> None:
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        from zlib import crc32

        out = np.zeros((len(texts), self.size))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = crc32(w.encode())
                out[i, h % self.size] += 1 if h >> 31 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(n > 0, n, 1)).tolist()


class EchoGenerator:
    """Deterministic stand-in without a model."""

    def generate(self, prompt: str) -> str:
        return prompt.strip().splitlines()[-1] if prompt.strip() else ""


def embed_batch(embedder: Embedder, texts: list[str], tries: int = 5, base: float = 1.5, jitter: float = 0.75, sleep=time.sleep) -> list[list[float]]:
    """Vectors of a batch. A call that fails, or gives another number of vectors, is made again after
    ``base`` * 2^k seconds and up to ``jitter`` more; after ``tries`` the last error is raised."""
    problem = ""
    for k in range(tries):
        try:
            got = embedder.embed(texts)
            if len(got) == len(texts):
                return got
            problem = f"{len(got)} vectors for {len(texts)} texts"
        except Exception as e:  # whatever the model's client raises
            problem = str(e)
        if k < tries - 1:
            sleep(base * 2**k + random.uniform(0, jitter))
    raise RuntimeError(f"no embedding after {tries} tries: {problem}")


def embed(rows: DataFrame, key: str, c: str, embedder: Embedder, batch: int = 128, most: int = 12_000, tries: int = 5, base: float = 1.5, failed: str = "empty") -> DataFrame:
    """(key, embedding): texts cut at ``most`` characters go to the model in batches. Blank texts get an
    empty vector; so do the texts of a batch that fails, or with ``failed="raise"`` the job fails."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, batch):
                part = b.slice(k, batch)
                texts = [(t or "").strip()[:most] for t in part.column(1).to_pylist()]
                some = [t for t in texts if t]
                try:
                    vectors = iter(embed_batch(embedder, some, tries, base) if some else [])
                except RuntimeError:
                    if failed == "raise":
                        raise
                    vectors = iter([[]] * len(some))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([next(vectors) if t else [] for t in texts], pa.list_(pa.float32()))], names=["k", "embedding"])

    return rows.select(F.col(key).alias("k"), X.text(c).alias("t")).mapInArrow(run, f"k {kind}, embedding array<float>").withColumnRenamed("k", key)


def rebuild(rows: DataFrame, key: str, c: str, embedder: Embedder, path: str, batch: int = 64, **options) -> dict[str, int]:
    """Embed all rows and put a new collection in the old one's place; rows without a vector are left out
    and counted."""
    from textloom.sources import writers

    return writers.replace_collection(embed(rows, key, c, embedder, batch, **options), path)


def _matrix(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, which of them are there, lengths) of a column of lists, as wide as the longest."""
    lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    i = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
    x, there = np.zeros((len(n), n.max(initial=0))), np.zeros((len(n), n.max(initial=0)), bool)
    x[i, j] = flat.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)
    there[i, j] = flat.is_valid().to_numpy(zero_copy_only=False)
    return x, there, n


def _wider(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _rounded(x: np.ndarray) -> np.ndarray:
    """To six places, halves away from zero, as SQL does it."""
    y = np.abs(x * 1e6)
    low = np.floor(y)
    out = np.copysign(low + (y - low >= 0.5), x) / 1e6
    return np.where(np.isfinite(y), out, x) + 0.0


class _Best:
    """The ``k`` least (kind, distance, place) of each query. Kinds: 0 a number, 1 none, 2 null, 3 not taken."""

    def __init__(self, m: int, k: int) -> None:
        self.kind, self.dist, self.at = np.full((m, k), 3, np.int8), np.full((m, k), np.inf), np.full((m, k), -1, np.int64)

    def add(self, i: np.ndarray, kind: np.ndarray, dist: np.ndarray, at: np.ndarray) -> None:
        k, u = self.at.shape[1], np.unique(i)
        i, kind = np.concatenate([i, np.repeat(u, k)]), np.concatenate([kind, self.kind[u].ravel()])
        dist, at = np.concatenate([dist, self.dist[u].ravel()]), np.concatenate([at, self.at[u].ravel()])
        order = np.lexsort((at, dist, kind, i))
        i = i[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        i, rank, order = i[rank < k], rank[rank < k], order[rank < k]
        self.kind[i, rank], self.dist[i, rank], self.at[i, rank] = kind[order], dist[order], at[order]


def best_of_slice(rows: pa.Table, queries: pa.Table, k: int, metric: str, tile: tuple[int, int] = (1024, 512)) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, place of the row, distance, whether it is null): for each query the ``k`` first rows
    by rounded distance and key, without rows of the query's key. Tables have key and vector.

    Products of matrices give distances with an error that is bounded. Where rounding leaves it open,
    and for vectors that are not whole, finite and of the usual length, they are summed in order as SQL does.
    """
    keys, ids = (t.column(0).to_numpy() for t in (rows, queries))
    order = np.argsort(keys, kind="stable")  # places follow the keys: of equal distances the first stays
    keys = keys[order]
    (r, r_there, r_n), (q, q_there, q_n) = _matrix(rows.column(1).take(pa.array(order))), _matrix(queries.column(1))
    width = max(r.shape[1], q.shape[1])
    r, r_there, q, q_there = (_wider(x, width) for x in (r, r_there, q, q_there))
    d = int(np.bincount(q_n[q_n > 0], minlength=1).argmax())
    where: dict = {}
    for i, x in enumerate(ids.tolist()):
        where.setdefault(x, []).append(i)
    own = np.array([(i, j) for j, x in enumerate(keys.tolist()) for i in where.get(x, ())], np.int64).reshape(-1, 2)
    best = _Best(len(ids), k)

    def squares(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for c in range(width):
            out += x[:, c] * x[:, c]
        return out

    with np.errstate(all="ignore"):
        rr, qq = squares(r), squares(q)

        def exact(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            a, b, s = q[i].T, r[j].T, np.zeros(len(i))
            both = q_there[i].T & r_there[j].T
            for c in range(width):
                s += np.where(both[c], (b[c] - a[c]) ** 2 if metric == "l2" else b[c] * a[c], 0)
            return s if metric == "l2" else 1 - s / np.sqrt(rr[j] * qq[i])

        def defined(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            if metric == "l2":
                return (q_there[i] & r_there[j]).any(axis=1)
            return (q_n[i] > 0) & (q_n[i] == r_n[j]) & (q_there[i].sum(axis=1) == q_n[i]) & (r_there[j].sum(axis=1) == r_n[j])

        def usual(n: np.ndarray, there: np.ndarray, s: np.ndarray) -> np.ndarray:
            return (n > 0) & (n == d) & (there.sum(axis=1) == n) & (s < 1e150) & ((s > 1e-150) | (metric == "l2"))

        def product(x: np.ndarray, s: np.ndarray, side: int) -> np.ndarray:
            one = np.ones((len(x), 1))
            if metric == "l2":
                return np.hstack([x[:, :d] * (-2, 1)[side], *((s[:, None], one) if side else (one, s[:, None]))])
            return np.hstack([x[:, :d] / np.sqrt(s)[:, None] * (-1, 1)[side], one])

        fine_q, fine_r = usual(q_n, q_there, qq), usual(r_n, r_there, rr)
        for qs in np.split(fq := np.flatnonzero(fine_q), range(tile[0], len(fq), tile[0])):
            left = product(q[qs], qq[qs], 0)
            mine = own[np.isin(own[:, 0], qs)]
            mine = np.stack([np.searchsorted(qs, mine[:, 0]), mine[:, 1]], axis=1)
            for rs in np.split(fr := np.flatnonzero(fine_r), range(tile[1], len(fr), tile[1])):
                if not len(qs) or not len(rs):
                    continue
                near = left @ product(r[rs], rr[rs], 1).T
                err = 8 * (d + 8) * np.finfo(float).eps * (qq[qs] + rr[rs].max() if metric == "l2" else np.ones(len(qs)))
                same = mine[np.isin(mine[:, 1], rs)]
                near[same[:, 0], np.searchsorted(rs, same[:, 1])] = np.inf
                # Rows come in the order of keys, so one as near as the last one taken is behind it. Until there are k,
                # the k nearest of the tile say how far to look.
                most = best.dist[qs, -1] - 5e-7 + err
                new = np.flatnonzero(best.kind[qs, -1] == 3)
                if len(new) and len(rs) > k:
                    most[new] = np.partition(near[new], k - 1, axis=1)[:, k - 1] + 3 * err[new] + 2e-6
                most += np.where(np.isfinite(most), np.abs(most) * 1e-15, 0)  # large numbers have no six places
                i, j = np.divmod(np.flatnonzero(near < most[:, None]), len(rs))
                x = near[i, j]
                dist = _rounded(x)
                open_ = np.flatnonzero(_rounded(x - err[i]) != _rounded(x + err[i]))
                for part in np.split(open_, range(1 << 15, len(open_), 1 << 15)) if len(open_) else []:
                    dist[part] = _rounded(exact(qs[i[part]], rs[j[part]]))
                some = dist < best.dist[qs[i], -1]
                best.add(qs[i[some]], np.zeros(some.sum(), np.int8), dist[some], rs[j[some]])

        def slowly(some_q: np.ndarray, some_r: np.ndarray) -> None:
            step = max(1, (1 << 15) // max(1, len(some_q)))
            for rs in np.split(some_r, range(step, len(some_r), step)) if len(some_q) else []:
                for qs in np.split(some_q, range(1 << 15, len(some_q), 1 << 15)):
                    i, j = np.repeat(qs, len(rs)), np.tile(rs, len(qs))
                    ok = ids[i] != keys[j]
                    i, j = i[ok], j[ok]
                    x = _rounded(exact(i, j))
                    kind = np.where(defined(i, j), np.isnan(x), 2).astype(np.int8)
                    best.add(i, kind, np.where(kind == 0, x, 0), j)

        # Without a vector on either side only the least keys matter: as many, and the query's own.
        first = np.flatnonzero(np.isin(keys, np.unique(keys)[: k + 1]))
        gone = np.flatnonzero(r_n == 0)
        gone = gone[np.isin(keys[gone], np.unique(keys[gone])[: k + 1])]
        slowly(np.flatnonzero(q_n == 0), first)
        slowly(np.flatnonzero(q_n > 0), gone)
        slowly(np.flatnonzero(fine_q), np.flatnonzero(~fine_r & (r_n > 0)))
        slowly(np.flatnonzero(~fine_q & (q_n > 0)), np.flatnonzero(r_n > 0))

    i, rank = np.nonzero(best.kind < 3)
    kind = best.kind[i, rank]
    return i, order[best.at[i, rank]], np.where(kind == 1, np.nan, best.dist[i, rank]), kind == 2


def nearest(index: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", key: str = "vec_id", vec: str = "embedding", block: int = 10_000) -> DataFrame:
    """(query_id, rank, key, dist): the exact k nearest of each query by ``cosine`` or squared ``l2`` distance,
    rounded to six places, then key. Rows without a distance come last.

    Each slice of the rows meets each block of about ``block`` queries once, in a task that holds nothing
    else, and gives its best k per query.
    """
    kind = index.schema[key].dataType.simpleString()
    n, longest = index.agg(F.count("*"), F.coalesce(F.max(F.size(vec)), F.lit(0))).first()
    blocks = max(1, -(-queries.count() // block))
    unit = max(256, 2**19 // max(1, longest))  # rows of 4 MB
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = max(1, min(-(-n // unit), max(4 * tasks, -(-n // (8 * unit)))))

    def place(df: DataFrame, s: Column, b: Column) -> DataFrame:
        df = df.select(F.col(key).alias("k"), F.col(vec).alias("v")).where("k is not null")
        return df.select("*", s.alias("s")).select("*", b.alias("b")).groupBy("s", "b")

    def every(x: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(x - 1)))

    def share(x: int) -> Column:
        return F.pmod(F.xxhash64("k"), F.lit(x)).cast("int")

    def run(rows: pa.Table, some: pa.Table) -> pa.Table:
        rows, some = rows.select(["k", "v"]), some.select(["k", "v"])
        if rows.num_rows and some.num_rows:
            i, j, dist, null = best_of_slice(rows, some, k, metric)
        else:
            i, j, dist, null = np.array([], int), np.array([], int), np.array([]), np.array([], bool)
        return pa.table({"query_id": some.column("k").take(pa.array(i)), "k": rows.column("k").take(pa.array(j)), "dist": pa.array(dist, mask=null)})

    best = place(index, share(slices), every(blocks)).cogroup(place(queries, every(slices), share(blocks))).applyInArrow(run, f"query_id {kind}, k {kind}, dist double")
    last = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("dist"), "k")
    return best.withColumn("rank", F.row_number().over(last)).where(f"rank <= {k}").select("query_id", "rank", F.col("k").alias(key), "dist")


def rerank(found: DataFrame, body: str, vocabulary: tuple[str, ...], n: int, by: str = "query_id") -> DataFrame:
    """Candidates by the share of the author's vocabulary they cover, then distance, then key."""
    scored = found.withColumn("alignment", F.round(X.vocab_overlap(body, vocabulary), 6))
    w = Window.partitionBy(by).orderBy(F.desc("alignment"), "dist", "vec_id")
    return scored.withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= n)


def context(found: DataFrame, by: str, rank: str, doc: str, body: str, budget: int = 5000) -> DataFrame:
    """(``by``, context): ranked texts under headers, within a budget of characters; the text that
    crosses it is cut with dots and is the last. Blank texts are left out but keep their number."""
    items = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(doc).cast("string").alias("d"), F.trim(X.text(body)).alias("t"))))

    def step(a: Column, x: Column) -> Column:
        head = F.concat(F.lit("[Chunk "), x["r"].cast("string"), F.lit(" — doc_id="), F.coalesce(x["d"], F.lit("?")), F.lit("]\n"))
        room = F.lit(budget) - a["used"] - F.length(head) - 2
        skip = (x["t"] == "") | a["full"]
        cut = F.length(x["t"]) > room
        body_ = F.when(cut, F.concat(F.left(x["t"], F.greatest(room - 3, F.lit(0))), F.lit("..."))).otherwise(x["t"])
        fits = room > 3
        return F.when(skip, a).otherwise(
            F.struct(
                F.when(fits, F.concat(a["out"], F.array(F.concat(head, body_)))).otherwise(a["out"]).alias("out"),
                F.when(fits, a["used"] + F.length(head) + F.length(body_) + 2).otherwise(a["used"]).cast("int").alias("used"),
                (cut | ~fits).alias("full"),
            )
        )

    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("used"), F.lit(False).alias("full"))
    return found.groupBy(by).agg(items.alias("i")).select(by, F.aggregate("i", zero, step, lambda a: F.array_join(a["out"], "\n\n")).alias("context"))
