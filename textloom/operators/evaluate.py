"""Scores of generated texts: authorship model, judge answers, aggregates."""

from __future__ import annotations

from typing import Protocol

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, Normalizer, RegexTokenizer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as X


class Scorer(Protocol):
    """What scores texts against references with a model of its own (semantic similarity, faithfulness);
    an external model stands behind this."""

    def score(self, texts: list[str], references: list[list[str]]) -> list[float]: ...


def best_of(scores: DataFrame, key: str, score: str) -> DataFrame:
    """Of (``key``, reference, ``score``) rows of an external ``Scorer`` the best per key, and the mean of
    all keys in each row."""
    best = scores.groupBy(key).agg(F.max(score).alias("best"))
    return best.withColumn("mean_best", best.agg(F.round(F.avg("best"), 4)).scalar())


def _weights(counted: DataFrame, idf) -> DataFrame:
    """Term counts times the smoothed ln((1 + n) / (1 + df)) + 1, normalised; the model has the logarithm."""
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(idf.idf.toArray() + 1), inputCol="_c", outputCol="_v").transform(counted)
    return Normalizer(inputCol="_v", outputCol="features", p=2.0).transform(scaled)


def authorship(train: DataFrame, candidates: DataFrame, body: str, label: str, key: str, features: int = 5000, least_df: float = 1.0, folds: int = 3) -> DataFrame:
    """(key, p_author, cv_accuracy): TF-IDF with smoothed idf and logistic regression with an L2 penalty of
    one in n. The accuracy is the mean over ``folds``, which digests of the texts deal out: each is judged by
    a model of the others (vocabulary and idf included)."""
    tokens = Pipeline(stages=[RegexTokenizer(inputCol="_t", outputCol="_w", pattern=r"\w\w+", gaps=False), StopWordsRemover(inputCol="_w", outputCol="_s")])

    def fitted(rows: DataFrame):
        n = max(1, rows.count())
        counts = CountVectorizer(inputCol="_s", outputCol="_c", vocabSize=features, minDF=least_df).fit(rows)
        idf = IDF(inputCol="_c", outputCol="_i").fit(counts.transform(rows))
        made = lambda df: _weights(counts.transform(df), idf)
        model = LogisticRegression(labelCol=label, regParam=1 / n, standardization=False, maxIter=50).fit(made(rows))
        return lambda df: model.transform(made(df))

    with_text = train.withColumn("_t", X.text(body))
    words = tokens.fit(with_text).transform(with_text).select("_s", label, F.pmod(F.xxhash64("_t"), F.lit(folds)).alias("_fold"))
    rates = []
    for k in range(folds):
        rest, own = words.where(F.col("_fold") != k), words.where(F.col("_fold") == k)
        if own.isEmpty() or rest.select(label).distinct().count() < 2:
            continue
        rates.append(fitted(rest)(own).agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0])
    accuracy = round(sum(rates) / len(rates), 4) if rates else 0.0
    asked = candidates.withColumn("_t", X.text(body))
    return fitted(words)(tokens.fit(asked).transform(asked)).select(key, F.round(vector_to_array("probability")[1], 6).alias("p_author"), F.lit(accuracy).alias("cv_accuracy"))


def judge_scores(answer: str | Column) -> Column:
    """Numbers from 1 to 5 of a judge's JSON object, by dimension; anything else is left out."""
    parsed = F.from_json(X.json_object(answer), "map<string,string>", {"mode": "PERMISSIVE"})
    numbers = F.map_filter(F.transform_values(parsed, lambda k, v: v.try_cast("double")), lambda k, v: v.between(1, 5))
    return numbers


def anchor_index(key: str | Column, n: int) -> Column:
    """Which of n anchors a key gets: the first 32 bits of its digest."""
    return F.conv(F.left(F.md5(X.text(key)), F.lit(8)), 16, 10).cast("long") % n


def aggregate(rows: DataFrame, by: str, scores: str) -> DataFrame:
    """Mean of each dimension per model, and their mean; ``scores`` is a map."""
    dims = rows.select(by, F.explode(scores).alias("dim", "v")).groupBy(by, "dim").agg(F.round(F.avg("v"), 3).alias("mean_score"))
    overall = dims.groupBy(by).agg(F.round(F.avg("mean_score"), 3).alias("mean_score")).withColumn("dim", F.lit("overall"))
    return dims.unionByName(overall)
