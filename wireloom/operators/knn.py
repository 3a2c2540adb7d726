"""Nearest neighbours among embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries that are held in memory and sent to the executors at once.
BLOCK = 4096
#: Queries and vectors that a task holds against each other at once: its memory doesn't grow with either.
_QUERIES, _VECTORS = 512, 1024


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """query, neighbour, score and rank of the ``k`` vectors most like each query (cosine, rounded), itself left out.

    The query set is a stated one; it is gone through in blocks of at most
    :data:`BLOCK` rows.  Every task keeps its best ``k`` for each query, and
    only these are shuffled.  Of equal scores the smaller key goes first.
    """
    spark = vectors.sparkSession
    numbered = queries.select(F.col(key).alias("q"), F.col(vector).cast("array<double>").alias("v"))
    n_blocks = max(1, -(-queries.count() // BLOCK))
    out = None
    for block in range(n_blocks):
        here = numbered.where(F.pmod(F.xxhash64("q"), F.lit(n_blocks)) == block).orderBy("q").toPandas()
        keys = here["q"].to_numpy(np.int64)
        matrix = _unit(np.array(here["v"].tolist(), np.float64).reshape(len(here), -1))
        shared = spark.sparkContext.broadcast((keys, matrix))

        def best(batches, shared=shared):
            keys, matrix = shared.value
            top_s, top_k = np.full((len(keys), k), -np.inf), np.zeros((len(keys), k), np.int64)
            for batch in batches:
                if not batch.num_rows or not len(keys):
                    continue
                ids = batch.column(0).to_numpy()
                data = _unit(_matrix(batch.column(1)))
                for n in range(0, len(ids), _VECTORS):
                    for q in range(0, len(keys), _QUERIES):
                        here = slice(q, q + _QUERIES)
                        top_s[here], top_k[here] = _better(top_s[here], top_k[here], keys[here], matrix[here], ids[n : n + _VECTORS], data[n : n + _VECTORS], digits)
            rows = np.repeat(keys, k)
            flat = top_s.ravel()
            real = np.isfinite(flat)
            yield pa.RecordBatch.from_arrays([pa.array(rows[real]), pa.array(top_k.ravel()[real]), pa.array(flat[real])], names=["query", "neighbour", "score"])

        part = vectors.select(F.col(key).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(best, "query bigint, neighbour bigint, score double")
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "neighbour")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _matrix(lists: pa.Array) -> np.ndarray:
    """Arrays of numbers, all of one length, as rows."""
    if lists.null_count or lists.flatten().null_count or pc.count_distinct(pc.list_value_length(lists)).as_py() != 1:
        return np.array(lists.to_pylist(), np.float64).reshape(len(lists), -1)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(lists), -1)


def _better(top_s, top_k, keys, matrix, ids, data, digits):
    """The best scores and keys of some queries so far, with some more vectors."""
    # by einsum: equal rows get equal sums, whatever stands around them
    scores = np.round(np.einsum("qd,nd->qn", matrix, data), digits)
    scores[keys[:, None] == ids[None, :]] = -np.inf
    # only what reaches a query's last place so far is sorted: these few, each beside its query
    row, at = np.nonzero((scores >= top_s[:, -1:]) & (scores > -np.inf))
    if not len(row):
        return top_s, top_k
    k = top_s.shape[1]
    q = np.concatenate([np.repeat(np.arange(len(keys)), k), row])
    s, i = np.concatenate([top_s.ravel(), scores[row, at]]), np.concatenate([top_k.ravel(), ids[at]])
    order = np.lexsort((i, -s, q))
    first = np.flatnonzero(np.r_[True, np.diff(q[order]) > 0])
    best = order[(first[:, None] + np.arange(k)).ravel()]
    return s[best].reshape(-1, k), i[best].reshape(-1, k)


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.sqrt(np.einsum("nd,nd->n", m, m))[:, None] if m.size else np.ones((len(m), 1))
    return m / np.where(size > 0, size, 1)


def vote(hits: DataFrame, labels: DataFrame, key: str = "vec_id", label: str = "label") -> DataFrame:
    """The label that most neighbours of each query have, their number and mean score; of equal counts the smaller label."""
    named = hits.join(labels.select(F.col(key).alias("neighbour"), F.col(label).alias("label")), "neighbour")
    counts = named.groupBy("query", "label").agg(F.count("*").alias("votes"), F.avg("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("votes"), "label")
    return counts.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def store_stats(vectors: DataFrame, label: str = "label") -> DataFrame:
    """Entries by label, and all (label null)."""
    return vectors.rollup(label).agg(F.count("*").alias("n"))


def with_entries(hits: DataFrame, entries: DataFrame, key: str = "vec_id", label: str = "label") -> DataFrame:
    """Hits beside their entries' labels; a hit whose entry is gone stays, labelled ``unknown``."""
    named = entries.select(F.col(key).alias("neighbour"), F.col(label).cast("string").alias("label"))
    return hits.join(named, "neighbour", "left").withColumn("label", F.coalesce("label", F.lit("unknown")))


def connection_vote(hits: DataFrame, question: str) -> DataFrame:
    """connected, confidence and votes of each query, from hits with labels.

    Labels that name a connection or a junction vote for one.  Only a question
    about junctions or dots is decided by them.
    """
    for_it = F.lower("label").contains("connected") | F.lower("label").contains("junction")
    votes = hits.groupBy("query").agg(F.count_if(for_it).alias("votes"), F.count("*").alias("n"), F.avg("score").alias("score"))
    asked = "junction" in question.lower() or "dot" in question.lower()
    sure = F.least(F.lit(0.95), F.col("score") + 0.2) if asked else F.lit(0.6)
    return votes.select("query", "votes", (F.lit(asked) & (2 * F.col("votes") > F.col("n"))).alias("connected"), sure.alias("confidence"))


def keyword_search(entries: DataFrame, query: str, key: str, label: str, description: str, k: int = 5) -> DataFrame:
    """The ``k`` entries that fit a word best, over 0.2; ties by key."""
    from wireloom.functions.text import keyword_score

    scored = entries.withColumn("score", keyword_score(F.lit(query), F.col(label), F.col(description)))
    return scored.where(F.col("score") > 0.2).orderBy(F.desc("score"), key).limit(k)
