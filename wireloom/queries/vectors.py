"""Queries over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from wireloom.functions import vectors as v
from wireloom.operators import knn
from wireloom.queries.views import sql, table
from wireloom.sources import writers

_HITS = """with n as (select vec_id, label, embedding::double[] as v from embeddings),
s as (select q.vec_id as query, e.vec_id as neighbour, e.label, round(list_dot_product(q.v, e.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(e.v, e.v)), 6) as score
  from n q join n e on q.vec_id <> e.vec_id where q.vec_id % 50 = 0),
h as (select *, row_number() over (partition by query order by score desc, neighbour) as rank from s)"""


def rag_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    return knn.search(e, e.where("vec_id % 50 = 0"), 5).select("query", "neighbour", F.round("score", 4).alias("score"), "rank")


RAG_TOPK = _HITS + " select query, neighbour, round(score, 4) as score, rank from h where rank <= 5"


def rag_topk_vote(spark, sf):
    e = table(spark, sf, "embeddings")
    hits = knn.search(e, e.where("vec_id % 50 = 0"), 5)
    voted = knn.vote(hits, e)
    return voted.select("query", "label", "votes", F.round("score", 4).alias("score"), F.round(F.least(F.lit(0.95), F.col("score") + 0.2), 4).alias("confidence"))


RAG_TOPK_VOTE = _HITS + """, c as (select query, label, count(*) as votes, avg(score) as a from h where rank <= 5 group by all),
w as (select *, row_number() over (partition by query order by votes desc, label) as n from c)
select query, label, votes, round(a, 4) as score, round(least(0.95, a + 0.2), 4) as confidence from w where n = 1"""


def vector_stats(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(v.norm(F.col("embedding"))), 4).alias("mean_norm"))


VECTOR_STATS = "select label, count(*) as n, round(avg(sqrt(list_dot_product(embedding::double[], embedding::double[]))), 4) as mean_norm from embeddings group by label"


def vector_upsert(spark, sf):
    """Rows with new labels replace those of the same key; keys to delete go."""
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    fresh = e.where("vec_id % 7 = 0").withColumn("label", F.col("label") + 100).unionByName(e.where("vec_id % 7 = 1").select((F.col("vec_id") + 1_000_000).alias("vec_id"), "label"))
    gone = e.where("vec_id % 11 = 0").select("vec_id")
    twice = fresh.withColumn("seq", F.lit(1)).unionByName(fresh.select("vec_id", (F.col("label") + 50).alias("label"), F.lit(0).alias("seq")))
    return writers.delete(writers.upsert(e, twice, "vec_id", "seq"), gone, "vec_id")


VECTOR_UPSERT = """select vec_id, case when vec_id % 7 = 0 then label + 100 else label end as label from embeddings where vec_id % 11 <> 0
union all select vec_id + 1000000, label from embeddings where vec_id % 7 = 1"""


def vector_blend(spark, sf):
    e = table(spark, sf, "embeddings")
    mirrored = F.reverse("embedding")
    mixed = v.blend(F.col("embedding"), mirrored)
    return e.select("vec_id", F.round(v.cosine(F.col("embedding"), mirrored), 5).alias("cosine"), F.round(v.norm(mixed), 5).alias("length"), F.round(F.element_at(mixed, 1), 5).alias("first"), F.round(F.element_at(mixed, -1), 5).alias("last"))


VECTOR_BLEND = """with b as (select vec_id, embedding::double[] as v, list_reverse(embedding)::double[] as r from embeddings),
m as (select vec_id, v, r, list_transform(range(1, len(v) + 1), lambda i: 0.7 * v[i] + 0.3 * r[i]) as m from b),
n as (select vec_id, v, r, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) as u from m)
select vec_id, round(list_dot_product(v, r) / list_dot_product(v, v), 5) as cosine, round(sqrt(list_dot_product(u, u)), 5) as length, round(u[1], 5) as first, round(u[len(u)], 5) as last from n"""

ENTRIES = {
    "rag_topk": (rag_topk, RAG_TOPK),
    "rag_topk_vote": (rag_topk_vote, RAG_TOPK_VOTE),
    "vector_stats": (vector_stats, VECTOR_STATS),
    "vector_upsert": (vector_upsert, VECTOR_UPSERT),
    "vector_blend": (vector_blend, VECTOR_BLEND),
}
ORACLES = {k: sql(s) for k, (_, s) in ENTRIES.items() if s}
