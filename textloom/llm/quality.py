"""Quality classifier with hierarchical empirical Bayes over sites.

1. Evidence of a document: two logistic models, fitted on at most ``sample`` labelled rows (by a hash
   of the id; the bound is the one limit here): ``quality`` from style (shares of upper-case letters,
   symbols, repeated neighbours, distinct words, bars; length), ``toxic`` from all words and word
   beginnings that the labels single out. Labelled rows that look like copies of one another share the
   weight of one. Of labelled rows only numbers come to the driver, no texts.
   p_clean = p_quality * (1 - p_toxic).
2. Sites: counts and expected clean documents by (host, path) in one aggregate, which is written; by
   host from that. The prior for hosts is a beta distribution fitted to the host rates by moments, the
   strength of the prior for paths by the spread of path rates around their host. A host's posterior
   shrinks towards the global rate, a path's towards its host: sparse sites follow what stands above
   them.
3. A document's log odds are its evidence plus the log odds of its path's posterior, itself left out,
   less those of the global rate. It is kept from ``least`` on.

Texts are scored twice (once for the sites, once for the result) and never moved: the site table joins
to the documents, by broadcast only where it has at most ``broadcast_sites`` rows.

Defined results: null, empty and blank texts have the style of an empty text and no words, and are
kept only if labels say that such are good; a null host or path is a site of its own; repeated rows
are judged each; labels without an id or a quality do not count, a null ``toxic`` is 0; without labels
of both classes a model says 0.5 (quality) or 0 (toxic) for all; an empty table gives an empty one;
other columns are kept, whatever they are called, but for those of the result's own names.
"""

from __future__ import annotations

import math
import operator
from collections import Counter
from dataclasses import dataclass, field
from functools import cached_property
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import materialize, packed, quoted, table, text_or_empty, unpacked

SAMPLE = 5000
#: Least penalty on the weights of words, so that few labelled rows give cautious weights.
TERM_RIDGE = 0.2
_SYMBOLS = np.array([chr(b) in "!?;:\"'()*%$&#|+-/<=>@[\\]^_`{}~" for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LETTERS = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])


def read(text: str) -> tuple[list[float], set[str]]:
    """Numbers that do not depend on the language, and the distinct words in lower case, without the
    usual marks."""
    low = text.lower()
    for mark in ".,!?;:\"":
        if mark in low:
            low = low.replace(mark, " ")
    words = low.split()
    size = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    n, distinct = max(1, len(words)), set(words)
    same = sum(map(operator.eq, words, words[1:]))
    return [float(size[_UPPER].sum() / max(1, size[_LETTERS].sum())), float(size[_SYMBOLS].sum()) / max(1, len(text)), same / n, len(distinct) / n**0.9, float(size[ord("|")]) / n, math.log1p(len(words))], distinct


def terms_of(words: set[str]) -> set[str]:
    """The words, and their first five letters with a star."""
    return words | {w[:5] + "*" for w in words if len(w) > 5}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float, weight: np.ndarray, steps: int = 60) -> np.ndarray:
    """Newton steps on the penalised likelihood; the last weight is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge * weight.sum())
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (weight * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_sparse(row: np.ndarray, term: np.ndarray, terms: int, y: np.ndarray, ridge: float, weight: np.ndarray, steps: int = 500) -> tuple[np.ndarray, float]:
    """The same for columns of 0 and 1, given by the places of the ones, by L-BFGS: weights, constant."""
    penalty = np.append(np.full(terms, ridge * weight.sum()), 1e-6)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(row, w[term], len(y)) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        off = weight * (p - y)
        value = float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (penalty * w * w).sum())
        return value, np.append(np.bincount(term, off[row], terms), off.sum()) + penalty * w

    w, past = np.zeros(terms + 1), []
    value, slope = loss(w)
    for _ in range(steps):
        if np.abs(slope).max() < 1e-7 * max(1.0, weight.sum()):
            break
        d, back = slope.copy(), []
        for s, g in reversed(past):
            a = (s @ d) / (s @ g)
            d -= a * g
            back.append(a)
        d *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.linalg.norm(slope))
        for (s, g), a in zip(past, reversed(back)):
            d += s * (a - (g @ d) / (s @ g))
        step = 1.0
        while step > 1e-12:
            new, at = loss(w - step * d)
            if new <= value - 1e-4 * step * (slope @ d):
                break
            step /= 2
        else:
            break
        if (-step * d) @ (at - slope) > 1e-14:
            past = [*past[-9:], (-step * d, at - slope)]
        w, value, slope = w - step * d, new, at
    return w[:-1], float(w[-1])


@dataclass
class Model:
    """Weights; ``terms`` has those of the words for ``toxic``."""

    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    quality: list[float] = field(default_factory=list)
    terms: dict[str, float] = field(default_factory=dict)
    base: float = -30.0

    def logits(self, text: str) -> tuple[float, float]:
        """Log odds of good quality and of toxicity."""
        style, words = read(text)
        q = 0.0
        if self.quality:
            z = [min(6.0, max(-6.0, (x - m) / s)) for x, m, s in zip(style, self.mean, self.scale)]
            q = sum(map(operator.mul, z, self.quality)) + self.quality[-1]
        t = self.base
        if self.terms:
            begins = {w[:5] for w in words if len(w) > 5} & self.begins
            t += sum(self.terms[w] for w in sorted(words & self.terms.keys())) + sum(self.terms[w + "*"] for w in sorted(begins))
        return min(30.0, max(-30.0, q)), min(30.0, max(-30.0, t))

    @cached_property
    def begins(self) -> set[str]:
        return {t[:-1] for t in self.terms if t.endswith("*")}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, least_rows: int = 4) -> Model:
    """Fit on at most ``sample`` labelled documents; their numbers come to the driver, and the terms that
    are in ``least_rows`` toxic ones and in one in a hundred, and more usual there than elsewhere."""
    some = labels.select(F.col(id_col).alias("i"), "quality", "toxic").where("i is not null and quality is not null").orderBy(F.xxhash64("i"), "i", "quality", "toxic").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))
    rows = texts.join(F.broadcast(some), F.col("id") == F.col("i")).select("t", F.col("quality").cast("int").alias("quality"), F.coalesce("toxic", F.lit(0)).cast("int").alias("toxic"), F.xxhash64("i").alias("o"), F.xxhash64("t").alias("h"))

    @F.pandas_udf("style array<double>, sketch array<bigint>, terms array<string>")
    def features(t: pd.Series) -> pd.DataFrame:
        out = []
        for text in t:
            style, words = read(text)
            out.append((style, sorted({crc32(w.encode()) for w in words})[:4], sorted(terms_of(words))))
        return pd.DataFrame(out, columns=["style", "sketch", "terms"])

    order = ("o", "h", "quality", "toxic")  # an id may have many rows
    read_ = rows.select(*order, features("t").alias("x")).select(*order, "x.*").orderBy(*order).limit(sample)
    read_ = materialize(read_.withColumn("n", F.row_number().over(Window.orderBy(*order)) - 1), "features")
    own = sorted(read_.select("n", "quality", "toxic", "style", "sketch").collect())  # at most `sample` short rows
    out = Model()
    groups = Counter((*r["sketch"], r["quality"], r["toxic"]) for r in own)
    weight = np.array([1 / groups[*r["sketch"], r["quality"], r["toxic"]] for r in own])
    good, toxic = (np.array([float(r[c] > 0) for r in own]) for c in ("quality", "toxic"))
    if 0 < good.sum() < len(own):
        x = np.array([r["style"] for r in own])
        mean = np.average(x, 0, weight)
        out.mean, out.scale = mean.tolist(), (np.sqrt(np.average((x - mean) ** 2, 0, weight)) + 1e-6).tolist()
        out.quality = fit_logistic(np.clip((x - out.mean) / out.scale, -6, 6), good, 1e-4, weight).tolist()
    if 0 < toxic.sum() < len(own):
        a, b = float(weight @ toxic), float(weight @ (1 - toxic))
        weights = docs.sparkSession.createDataFrame([(k, float(w), int(t)) for k, (w, t) in enumerate(zip(weight, toxic))], "n int, w double, x int")
        each = read_.select("n", F.explode("terms").alias("term")).join(F.broadcast(weights), "n")
        chosen = each.groupBy("term").agg(F.sum(F.col("w") * F.col("x")).alias("c"), F.sum(F.col("w") * (1 - F.col("x"))).alias("d")).where((F.col("c") >= max(least_rows, 0.01 * a) - 1e-9) & (F.col("c") / a > 8 * F.col("d") / b)).select("term")
        ones = sorted((r["term"], r["n"]) for r in each.join(F.broadcast(chosen), "term").select("term", "n").collect())
        if ones:
            place = {t: k for k, t in enumerate(dict.fromkeys(t for t, _ in ones))}
            w, out.base = fit_sparse(np.array([n for _, n in ones]), np.array([place[t] for t, _ in ones]), len(place), toxic, max(1e-5, TERM_RIDGE / weight.sum()), weight)
            out.terms = dict(zip(place, w.tolist()))
    return out


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(p, F.lit(1 - 1e-6)))
    return F.log(p / (1 - p))


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """Of rows (host, path, p): (host, path, n, s, host_rate, strength) and the global rate. Scalars
    come to the driver."""
    paths = materialize(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    g = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.count("*").alias("k"), F.sum(F.col("hn") * F.col("hn")).alias("n2")).first()
    if not g["n"]:
        return paths.select("host", "path", "n", "s", F.lit(0.5).alias("host_rate"), F.lit(1.0).alias("strength")), 0.5
    rate = min(max(g["s"] / g["n"], 1e-6), 1 - 1e-6)
    between = hosts.agg(F.sum(F.col("hn") * F.pow(F.col("hs") / F.col("hn") - rate, F.lit(2))).alias("x")).first()["x"]
    a = _strength(rate, between, g["n"], g["n2"], g["k"])
    hosts = hosts.withColumn("host_rate", (F.lit(a * rate) + F.col("hs")) / (a + F.col("hn")))
    joined = paths.join(hosts.select(F.col("host").alias("h2"), "host_rate"), F.col("host").eqNullSafe(F.col("h2"))).drop("h2")
    p = joined.agg(F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("host_rate"), F.lit(2))).alias("x"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("n")).alias("n2")).first()
    b = _strength(rate, p["x"], g["n"], p["n2"], p["k"])
    return joined.withColumn("strength", F.lit(b)), rate


def _strength(rate: float, spread: float, n: float, n2: float, groups: int) -> float:
    """The prior's weight in documents, by moments: group rates vary by rate * (1 - rate) / size from
    chance; what they vary beyond that is the prior's variance."""
    unit = rate * (1 - rate)
    prior = (spread - (groups - 1) * unit) / max(n - n2 / n, 1e-9)
    return float(min(1e6, max(1.0, unit / prior - 1))) if prior > 0 else 1e6


def classify(docs: DataFrame, model: Model, text_col: str = "text", host: Column | None = None, path: Column | None = None, least: float = 0.5, broadcast_sites: int = 50_000) -> DataFrame:
    """``docs`` with ``p_quality``, ``p_toxic``, ``site_rate`` (its path's posterior, the document left
    out), ``p_keep`` and ``keep``."""
    out = "q double, t double"

    @F.pandas_udf(out)
    def logits(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.logits(t) for t in texts], columns=["q", "t"]).astype(float)

    logits = logits.asNondeterministic()  # it is computed once, and not again for a filter
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    good = lambda x: 1 / (1 + F.exp(-x))
    odds = docs.select(packed(docs), host.alias("host"), path.alias("path"), logits(text_or_empty(F.col(quoted(text_col)))).alias("x"))
    scored = odds.select("row", "host", "path", good(F.col("x.q")).alias("p_quality"), good(F.col("x.t")).alias("p_toxic")).withColumn("p", F.col("p_quality") * (1 - F.col("p_toxic")))
    sites, rate = site_posteriors(scored.select("host", "path", "p"))
    sites = materialize(sites, "sites").withColumnsRenamed({"host": "h", "path": "q"})
    if sites.limit(broadcast_sites + 1).count() <= broadcast_sites:
        sites = F.broadcast(sites)
    joined = scored.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")), "left")
    joined = joined.withColumn("site_rate", (F.col("strength") * F.col("host_rate") + F.col("s") - F.col("p")) / (F.col("strength") + F.col("n") - 1))
    joined = joined.withColumn("p_keep", good(_logit(F.col("p")) + _logit(F.col("site_rate")) - _logit(F.lit(rate))))
    own = ("p_quality", "p_toxic", "site_rate", "p_keep", "keep")
    return joined.withColumn("keep", F.col("p_keep") >= least).select(*unpacked([c for c in docs.columns if c not in own]), *own)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, judged by a model of the labels; source and language are host and path."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return classify(docs.select("doc_id", "text", "source", "lang"), model).drop("text")
