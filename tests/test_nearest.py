"""Nearest neighbours against the SQL of ``knn_cosine`` and ``knn_l2``, on odd vectors and in tiles."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from textloom.operators import vector as V
from textloom.plans import catalogue

METRICS = ["cosine", "l2"]
KIND = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32()))])


def by_sql(table, name):
    c = duckdb.connect()
    c.register("embeddings", table)
    return sorted(tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r) for r in c.execute(f"select query_id, rank, vec_id, dist from ({catalogue.oracle_sql()[name]})").fetchall())


def by_slice(table, metric, k=5, **options):
    """Of one slice: (query, rank, row, distance)."""
    table = table.filter(pa.compute.is_valid(table["vec_id"]))
    some = table.filter(pa.array([x % 100 == 0 for x in table["vec_id"].to_pylist()]))
    i, j, dist, null = V.best_of_slice(table, some, k, metric, **options)
    ids, keys, seen, out = some["vec_id"].to_pylist(), table["vec_id"].to_pylist(), {}, []
    for a, b, x, gone in zip(i.tolist(), j.tolist(), dist.tolist(), null.tolist(), strict=True):
        seen[a] = seen.get(a, 0) + 1
        out.append((ids[a], seen[a], keys[b], None if gone else "nan" if math.isnan(x) else x))
    return sorted(out)


def odd(metric, n=700, size=6):
    """Copies, near copies, vectors of zeros, missing ones and ones that are not finite, in mixed order."""
    g = np.random.default_rng(7)
    x = g.normal(size=(n, size)).astype(np.float32)
    x[::9] = x[0]
    x[::11] = x[100] + g.normal(size=(len(x[::11]), size)).astype(np.float32) * 1e-4
    x[5::50] *= 1e6
    rows = x.tolist()
    for k in (3, 4, 300):
        rows[k] = [0.0] * size
    for k in (0, 1, 7, 200):
        rows[k] = None
    rows[400], rows[401] = [math.nan] + [1.0] * (size - 1), [math.inf] + [1.0] * (size - 1)
    if metric == "l2":  # SQL leaves out what is missing
        rows[500], rows[501], rows[502], rows[503] = [1.0, None, 2.0], [], [None] * size, [*x[503].tolist(), 1.0]
    ids = g.permutation(n).tolist()
    return pa.table({"vec_id": [*ids, None], "embedding": [*(rows[i] for i in ids), rows[2]]}, KIND)


@pytest.mark.parametrize("metric", METRICS)
def test_slice_equals_sql(metric):
    table = odd(metric)
    want = by_sql(table, f"knn_{metric}")
    for tile in ((1024, 512), (3, 64), (2, 4)):
        assert by_slice(table, metric, tile=tile) == want


@pytest.mark.parametrize("metric", METRICS)
def test_fewer_rows_than_k(metric):
    table = odd(metric, 504).slice(0, 504)
    some = table.filter(pa.array([x in (0, 1, 100, 7) for x in table["vec_id"].to_pylist()]))
    assert by_slice(some, metric) == by_sql(some, f"knn_{metric}")


def test_half_of_the_last_place():
    """Distances halfway between two roundings, where the product of matrices alone may fall on either side."""
    steps = np.sqrt(np.arange(1, 400) * 1e-6 + 5e-7)
    rows = [[0.0, 0.0], *([float(s), 0.0] for s in steps[::-1]), *([0.6 * float(s), 0.8 * float(s)] for s in steps)]
    kind = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float64()))])
    table = pa.table({"vec_id": [100 * (k == 0) or k if k < 100 else k + 1 for k in range(len(rows))], "embedding": rows}, kind)
    assert by_slice(table, "l2", tile=(4, 16)) == by_sql(table, "knn_l2")


@pytest.mark.parametrize("metric", METRICS)
def test_blocks_and_slices(spark, tmp_path, metric):
    import pyarrow.parquet as pq

    table = odd(metric, 1500)
    pq.write_table(table, tmp_path / "embeddings.parquet")
    e = spark.read.parquet(str(tmp_path / "embeddings.parquet"))
    for block in (4, 10_000):
        got = V.nearest(e, e.where("vec_id % 100 = 0"), 5, metric, block=block).select("query_id", "rank", "vec_id", "dist").collect()
        assert sorted(tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r) for r in got) == by_sql(table, f"knn_{metric}")


def test_keys_of_text(spark):
    e = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("é", [1.0, 0.1]), ("c", None)], "id string, v array<double>")
    got = V.nearest(e, e.where("id = 'b'"), 3, key="id", vec="v").orderBy("rank").collect()
    assert [(r["query_id"], r["id"]) for r in got] == [("b", "a"), ("b", "é"), ("b", "c")]
    assert got[2]["dist"] is None


@pytest.mark.parametrize("metric", METRICS)
def test_no_pairs_as_rows(spark, metric):
    """The plan has no join that lists every pair."""
    e = spark.range(1000).selectExpr("id vec_id", "array(float(id), float(1)) embedding")
    plan = V.nearest(e, e.where("vec_id % 100 = 0"), 5, metric)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
