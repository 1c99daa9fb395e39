"""Nearest neighbours, context, and scores of generated texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions import udfs
from textloom.operators import analytics as A
from textloom.operators import evaluate as E
from textloom.operators import vector as V
from textloom.plans.registry import count, query, read, words

_COS = "1 - list_dot_product(e.embedding::double[], q.embedding::double[]) / sqrt(list_dot_product(e.embedding::double[], e.embedding::double[]) * list_dot_product(q.embedding::double[], q.embedding::double[]))"
_L2 = "list_sum(list_transform(list_zip(e.embedding::double[], q.embedding::double[]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _knn_sql(dist: str, k: int = 5) -> str:
    return f"""select query_id, rank, vec_id, dist from (select q.vec_id as query_id, e.vec_id, round({dist}, 6) as dist, row_number() over (partition by q.vec_id order by round({dist}, 6), e.vec_id) as rank
from embeddings e, (select * from embeddings where vec_id % 100 = 0) q where e.vec_id <> q.vec_id) where rank <= {k}"""


def _queries(e):
    """Every hundredth stored vector stands for a question."""
    return e.where("vec_id % 100 = 0")


def _knn(spark, d, metric, k=5):
    e = read(spark, d, "embeddings")
    return V.nearest(e, _queries(e), k, metric).withColumn("rank", F.col("rank").cast("long"))


@query(_knn_sql(_COS))
def knn_cosine(spark, d):
    return _knn(spark, d, "cosine")


@query(_knn_sql(_L2))
def knn_l2(spark, d):
    return _knn(spark, d, "l2")


_VOCAB = ("the", "and", "of", "to", "in", "der", "die", "que", "de", "la")


@query(f"""with f as ({_knn_sql(_COS, 10)}), s as (select query_id, vec_id, dist, round(len(list_intersect(list_distinct({words("lower(coalesce(text, ''))")}), {list(_VOCAB)})) / {len(_VOCAB)}.0, 6) as alignment from f join documents on doc_id = vec_id)
select query_id, vec_id, alignment, new_rank from (select *, row_number() over (partition by query_id order by alignment desc, dist, vec_id) as new_rank from s) where new_rank <= 5""")
def persona_rerank(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return V.rerank(_knn(spark, d, "cosine", 10).join(docs, "vec_id"), "text", _VOCAB, 5).select("query_id", "vec_id", "alignment", F.col("new_rank").cast("long").alias("new_rank"))


@query()
def context_pack(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return V.context(_knn(spark, d, "cosine", 10).join(docs, "vec_id"), "query_id", "rank", "vec_id", "text")


@query("select vec_id, case when vec_id % 3 = 0 then label + 100 else label end as label from embeddings union all select vec_id + 1000000, label + 100 from embeddings where vec_id % 3 = 0")
def collection_upsert(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", "label")
    new = e.where("vec_id % 3 = 0").withColumn("label", F.col("label") + 100)
    return A.collection_upsert(e, new.unionByName(new.withColumn("vec_id", F.col("vec_id") + 1000000)), "vec_id")


@query("select vec_id from (select vec_id, case when vec_id % 9 = 0 then null when vec_id % 7 = 0 then [] else embedding end as v from embeddings) where coalesce(len(v), 0) = 0 order by 1 limit 5")
def missing_embeddings(spark, d):
    v = F.when(F.col("vec_id") % 9 == 0, None).when(F.col("vec_id") % 7 == 0, F.array().cast("array<float>")).otherwise(F.col("embedding"))
    return read(spark, d, "embeddings").where(F.coalesce(F.size(v), F.lit(0)) <= 0).orderBy("vec_id").limit(5).select("vec_id")


@query()
def embed_batches(spark, d):
    return V.embed(read(spark, d, "documents"), "doc_id", "text", V.HashingEmbedder())


@query("""with r as (select lang as model, unnest([{'dim': 'quality', 'v': quality * 4.0 + 1}, {'dim': 'tone', 'v': toxic * 2.0 + 1}], recursive := true) from documents join labels using (doc_id)),
m as (select model, dim, round(avg(v), 3) as mean_score from r group by 1, 2) select * from m union all select model, 'overall', round(avg(mean_score), 3) from m group by 1""")
def eval_aggregate(spark, d):
    x = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id")
    scores = F.create_map(F.lit("quality"), F.col("quality") * F.lit(4.0) + 1, F.lit("tone"), F.col("toxic") * F.lit(2.0) + 1)
    return E.aggregate(x.select(F.col("lang").alias("model"), scores.alias("s")), "model", "s").withColumnRenamed("by", "model")


@query("""select lang as model, count(*) as n, round(avg(length(coalesce(text, ''))), 4) as mean_chars, round(avg(quality), 4) as mean_quality from documents left join (select doc_id, max(quality) as quality from labels group by 1) using (doc_id) group by 1""")
def eval_judge_join(spark, d):
    best = read(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    x = read(spark, d, "documents").join(best, "doc_id", "left")
    return x.groupBy(F.col("lang").alias("model")).agg(F.count("*").alias("n"), F.round(F.avg(F.length(X.text("text"))), 4).alias("mean_chars"), F.round(F.avg("quality"), 4).alias("mean_quality"))


@query("select doc_id, cast('0x' || left(md5(source || ':' || doc_id), 8) as bigint) % 40 as anchor from documents")
def anchor_pick(spark, d):
    return read(spark, d, "documents").select("doc_id", E.anchor_index(F.concat("source", F.lit(":"), "doc_id"), 40).alias("anchor"))


_ANSWER = "concat('Sure! ```json {\"style\": ', doc_id % 7, ', \"tone\": \"', doc_id % 3 + 1, '\", \"comment\": \"fine\"} ``` done')"


@query("select doc_id, case when doc_id % 7 between 1 and 5 then cast(doc_id % 7 as double) end as style, cast(doc_id % 3 + 1 as double) as tone from documents")
def json_from_text(spark, d):
    docs = read(spark, d, "documents").select("doc_id", E.judge_scores(F.expr(_ANSWER)).alias("s"))
    return docs.select("doc_id", F.col("s").getItem("style").alias("style"), F.col("s").getItem("tone").alias("tone"))


@query()
def best_of_k_scores(spark, d):
    """Test items, the bounded side, against every document's whole text, the best of all."""
    items = read(spark, d, "benchmark").select("item_id", "text").collect()
    least = spark.createDataFrame([(n, r["item_id"], 0.0, 0.0) for n, r in enumerate(items)], "n bigint, item_id " + read(spark, d, "benchmark").schema["item_id"].dataType.simpleString() + ", bleu double, rouge_l double")
    best = read(spark, d, "documents").select("text").mapInArrow(udfs.best_scores([r["text"] for r in items]), "n bigint, bleu double, rouge_l double")
    every = least.unionByName(best, allowMissingColumns=True).groupBy("n").agg(F.max("item_id").alias("item_id"), F.max("bleu").alias("bleu"), F.max("rouge_l").alias("rouge_l"))
    return every.select("item_id", F.round("bleu", 6).alias("bleu"), F.round("rouge_l", 6).alias("rouge_l"))


@query()
def authorship_score(spark, d):
    x = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id")
    train = x.select("text", F.col("quality").cast("double").alias("y"))
    return E.authorship(train, read(spark, d, "documents"), "text", "y", "doc_id", features=2000, least_df=3.0)
