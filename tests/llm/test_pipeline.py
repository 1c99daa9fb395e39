"""The five stages: what they keep, and odd rows in each."""

import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 400)) for _ in range(n))


ITEMS = [(1, "What is the capital of the fair land of Oz now. It is the Emerald City by the green river."), (2, "one two three four five six seven eight nine ten eleven twelve"), (3, None), (4, ""), (5, "tiny item")]


def test_pipeline_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "packing"] and corpus_pipeline.ORACLE_SQL is None
    rng = random.Random(13)
    good = [(k, prose(rng, 120)) for k in range(60)]
    leak = (300, prose(rng, 60) + " " + ITEMS[0][1] + " " + prose(rng, 60))
    near = (301, " ".join([*good[0][1].split()[:-2], "other", "end"]))
    junk = [(400 + k, " ".join(w.upper() + "!!" for w in prose(rng, 80).split())) for k in range(30)]
    rows = [(i, t, "en", "src0", len(t)) for i, t in [*good, leak, near, *junk]]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i < 400), 0) for i, *_ in rows]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == {i for i, _ in good}


def test_odd_rows_in_every_stage(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing names; and empty tables."""
    rng = random.Random(5)
    long_, body = prose(rng, 6000), prose(rng, 120)
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, long_), (5, body), (5, body), (6, body + " more"), (None, prose(rng, 60)), (8, "é🙂 ß 日本\n"), (9, body + "\n" + prose(rng, 80)), (10, "one"), *((20 + k, prose(rng, 40)) for k in range(10))]
    rows = [(i, t, None if (i or 0) % 4 == 0 else "en", None if (i or 0) % 3 == 0 else "src0", len(t or ""), 7, "x", 1.5) for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, row int, _ld_id string, p double")
    spark.createDataFrame([(i, int((i or 0) % 7 != 3), 0) for i, _ in texts], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (2, ""), (3, prose(random.Random(77), 20))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = out.collect()
        assert {r["row"] for r in got} == {7} and {r["_ld_id"] for r in got} == {"x"} and {r["p"] for r in got} == {1.5}
        assert len(got) == len(rows) if name in ("line_dedup", "decontaminate") else 0 < len(got) <= len(rows)
        if name == "near_dedup":
            assert sum(r["doc_id"] in (1, 2, 3) for r in got) == 1 and sum(r["doc_id"] in (5, 6) for r in got) == 1
        if name == "line_dedup":
            assert all(r["n_chars"] == len(r["text"]) for r in got)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    packed = corpus_pipeline.packing_stage(spark, docs, str(tmp_path))
    assert packed.select("doc_id").distinct().count() == len({i for i, _ in texts}) and packed.where(F.col("offset") + F.col("length") > 2048).count() == 0
    assert corpus_pipeline.packing_stage(spark, docs.limit(0), str(tmp_path)).count() == 0
