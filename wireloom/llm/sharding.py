"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass 1 scatters the records into memory-sized buckets by a seeded hash of key
and text.  Pass 2 gathers a bucket as one array, puts it into an order that
doesn't depend on arrival, shuffles it (Fisher-Yates, Spark's ``shuffle``) and
writes it.  The number of tasks of pass 2 goes by the data, not by the session,
and each has its own seed, so the order is decided by seed and records.  Dealing
the written sequence out card by card then gives shards whose row counts are at
most one apart (law ``rows``).

Defined results: a null text counts 0 bytes; repeated rows are rows like any
other.  Rows that agree in key and text share a bucket as long as they are few;
more than :data:`EQUAL_ROWS` are scattered by their place in the input as well
(which of them goes where makes no difference to key and text).  An empty table
gives an empty result.  Columns that can't be ordered (maps) are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wireloom.tables import written

#: Bytes of text that a bucket holds on average.
BUCKET_BYTES = 16 << 20
#: Tasks of pass 2 at most; further buckets share them.
TASKS = 1 << 16
#: Rows that agree in key and text and may still share a bucket.
EQUAL_ROWS = 1024
#: Buckets whose offsets may be broadcast (16 bytes each), and that are summed up together.
BROADCAST_BUCKETS, TOGETHER = 1 << 20, 4096


def external_shuffle(
    df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 17, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """The records of ``df`` as column ``record``, written in random order: ``bucket``, ``place`` (from 0 in it)."""
    name = F.xxhash64(F.col(key), F.col(text))
    equal = df.groupBy(name.alias("name")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 64).alias("bytes"))
    told = equal.agg(F.sum("bytes").alias("bytes"), F.sum(F.when(F.col("n") > EQUAL_ROWS, 1).otherwise(0)).alias("hot")).first()
    n_buckets = max(1, -(-(told["bytes"] or 0) // bucket_bytes))
    place = F.lit(0).cast("long")
    if told["hot"]:
        hot = equal.where(F.col("n") > EQUAL_ROWS).select("name")
        row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
        df = df.select(row.alias("row"), name.alias("name"), F.monotonically_increasing_id().alias("at")).join(
            F.broadcast(hot.withColumn("is_hot", F.lit(True))) if told["hot"] <= BROADCAST_BUCKETS else hot.withColumn("is_hot", F.lit(True)), "name", "left"
        )
        place, key, text = F.when(F.col("is_hot"), F.col("at")).otherwise(F.lit(0).cast("long")), f"row.{key}", f"row.{text}"
        record = F.col("row")
    else:
        record = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    scatter = F.xxhash64(F.lit(seed), F.col(key), F.col(text), place)
    order = F.xxhash64(F.lit(seed + 1), F.col(key), F.col(text))
    one = F.struct(order.alias("at"), record.alias("record"))
    buckets = (
        df.select(F.pmod(scatter, F.lit(n_buckets)).alias("bucket"), one.alias("one"))
        .repartition(min(n_buckets, TASKS), "bucket")
        .groupBy("bucket")
        .agg(F.sort_array(F.collect_list("one")).alias("all"))
        .sortWithinPartitions("bucket")  # the seeded generator goes on from bucket to bucket of a task
        .select("bucket", F.shuffle("all", seed).alias("all"))
        .select("bucket", F.posexplode("all").alias("place", "one"))
    )
    return written(buckets.select("bucket", "place", F.col("one.record").alias("record")), "shuffled")


def deal(shuffled: DataFrame, n_shards: int = 16) -> DataFrame:
    """``shuffled`` with ``shard`` and ``slot``: the written sequence dealt out in turn.

    Only sums go through one task: a row for each :data:`TOGETHER` buckets.
    """
    sizes = shuffled.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("part", F.floor(F.col("bucket") / TOGETHER))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    so_far = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", so_far(Window.orderBy("part")).alias("before"))
    starts = sizes.select("part", "bucket", so_far(Window.partitionBy("part").orderBy("bucket")).alias("start"))
    starts = starts.join(parts, "part").select("bucket", (F.col("before") + F.col("start")).alias("start"))
    if sizes.count() <= BROADCAST_BUCKETS:  # else the records would be shuffled once more for this join
        starts = F.broadcast(starts)
    at = F.col("start") + F.col("place")
    return shuffled.join(starts, "bucket").select(
        "record",
        "bucket",
        "place",
        F.pmod(at, F.lit(n_shards)).cast("int").alias("shard"),
        F.floor(at / F.lit(n_shards)).cast("long").alias("slot"),
    )


def write_shards(dealt: DataFrame, path: str) -> None:
    """One folder for each shard; within a file the rows go by slot."""
    dealt.select("record.*", "shard", "slot").repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard"
    ).parquet(path)
