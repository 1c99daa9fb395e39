"""The quality classifier: held-out labels, a plain-Python posterior, odd rows and names."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import quality as Q


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]) + str(rng.randint(0, 400)) for _ in range(n))


NAMES = "doc_id bigint, text string, lang string, source string, _n int, n int, s double, p double, p_quality string, keep string, host string, path string, x string, row string, strength string"


def made(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, 1, 2, 3.0, 4.0, "mine", "mine", "h", "p", "x", "r", "s") for i, t, src, lang in rows], NAMES)


@pytest.fixture(scope="module")
def judged(spark):
    rng, rows, labels = random.Random(9), [], []
    for k in range(300):
        good = k % 3 != 0
        toxic = good and k % 7 == 0
        text = prose(rng, 60) if good else " ".join(w.upper() + "!!" for w in prose(rng, 60).split())
        rows.append((k, text + (" scumbag" if toxic else ""), f"s{k % 4}", None if k % 5 == 0 else f"l{k % 3}"))
        labels.append((k, int(good), int(toxic)))
    rows += [(900, None, None, None), (901, "", "s1", "l1"), (None, "  \n", "s9", "l9"), (1, rows[1][1], "s1", "l1"), (902, prose(rng, 9000), "s2", "l2")]
    df, lab = made(spark, rows), spark.createDataFrame([*labels, (1, None, None), (None, 1, None), (7, 1, None)], "doc_id bigint, quality int, toxic int")
    return df, lab, labels, Q.fit(df, lab.where("doc_id < 200 or doc_id is null"))


def test_held_out_labels(judged):
    df, _, labels, model = judged
    out = {r["doc_id"]: r["keep"] for r in Q.classify(df, model).collect()}
    held = [(out[k], bool(q and not t)) for k, q, t in labels if k >= 200]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert all(out[k] for k, q, t in labels if q and not t)


def test_posterior_against_plain_python(judged):
    """Every document's site rate and odds, worked out from all documents' evidence."""
    df, _, _, model = judged
    rows = Q.classify(df, model, least=0.3).collect()
    p = [r["p_quality"] * (1 - r["p_toxic"]) for r in rows]
    for r, x in zip(rows, p):
        q, t = model.logits(r["text"] or "")
        assert math.isclose(r["p_quality"], 1 / (1 + math.exp(-q))) and math.isclose(r["p_toxic"], 1 / (1 + math.exp(-t)))
    paths, hosts = {}, {}
    for r, x in zip(rows, p):
        paths.setdefault((r["source"], r["lang"]), []).append(x)
        hosts.setdefault(r["source"], []).append(x)
    rate = sum(p) / len(p)

    def strength(groups, mean):
        n2 = sum(len(g) ** 2 for g in groups.values())
        spread = sum(len(g) * (sum(g) / len(g) - mean(k)) ** 2 for k, g in groups.items())
        prior = (spread - (len(groups) - 1) * rate * (1 - rate)) / max(len(p) - n2 / len(p), 1e-9)
        return min(1e6, max(1.0, rate * (1 - rate) / prior - 1)) if prior > 0 else 1e6

    a = strength(hosts, lambda k: rate)
    host_rate = {k: (a * rate + sum(g)) / (a + len(g)) for k, g in hosts.items()}
    b = strength(paths, lambda k: host_rate[k[0]])
    logit = lambda x: math.log(min(max(x, 1e-6), 1 - 1e-6) / (1 - min(max(x, 1e-6), 1 - 1e-6)))
    for r, x in zip(rows, p):
        own = paths[r["source"], r["lang"]]
        site = (b * host_rate[r["source"]] + sum(own) - x) / (b + len(own) - 1)
        keep = 1 / (1 + math.exp(-(logit(x) + logit(site) - logit(rate))))
        assert math.isclose(r["site_rate"], site, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r["p_keep"], keep, rel_tol=1e-6) and r["keep"] == (r["p_keep"] >= 0.3)


def test_odd_rows_and_names(judged):
    df, lab, _, model = judged
    every = Q.classify(df, model)
    own = ["p_quality", "p_toxic", "site_rate", "p_keep", "keep"]
    assert every.columns == [c for c in df.columns if c not in own] + own and every.count() == df.count()
    assert every.where("_n = 1 and n = 2 and s = 3 and p = 4 and x = 'x' and row = 'r' and host = 'h'").count() == df.count()
    assert Q.classify(df.limit(0), model).count() == 0
    none = Q.fit(df, lab.limit(0))
    assert none.quality == [] and {r["p_quality"] for r in Q.classify(df, none).collect()} == {0.5}


def test_sites_shrink(spark):
    p = [("a", "x", 0.0)] * 500 + [("b", "x", 1.0)] * 500 + [("c", "x", 0.0)] + [("d", "y", 1.0)] * 400 + [(None, None, 0.0)]
    sites, rate = Q.site_posteriors(spark.createDataFrame(p, "host string, path string, p double"))
    r = {x["host"]: x["host_rate"] for x in sites.collect()}
    assert r["a"] < 0.05 and r["b"] > 0.95 and 0.05 < r["c"] < rate and None in r


def test_sparse_fit_is_the_dense_one():
    rng = np.random.default_rng(1)
    x = (rng.random((200, 12)) < 0.2).astype(float)
    y, weight = (rng.random(200) < 0.1 + 0.7 * x[:, 0]).astype(float), rng.random(200)
    row, term = np.nonzero(x)
    w, base = Q.fit_sparse(row, term, 12, y, 1e-3, weight)
    assert np.allclose([*w, base], Q.fit_logistic(x, y, 1e-3, weight), atol=1e-3)


def test_two_passes(spark, judged):
    """The result scores the texts once; the sites are a table by then."""
    df, _, _, model = judged
    plan = Q.classify(df, model)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_registered_query(spark, judged, tmp_path):
    df, lab, _, model = judged
    df.write.parquet(str(tmp_path / "documents.parquet"))
    lab.write.parquet(str(tmp_path / "labels.parquet"))
    out = Q.op7_quality(spark, str(tmp_path))
    assert out.columns[:3] == ["doc_id", "source", "lang"] and out.count() == df.count() and out.where(F.col("keep").isNull()).count() == 0
