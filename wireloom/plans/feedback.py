"""What reviewers' corrections add up to, and when they call for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wireloom.functions.text import ab_bucket


def statistics(feedback: DataFrame) -> DataFrame:
    """One table (kind, name, n): total, distinct files and users, and counts by issue type, label and correction."""
    pair = F.concat("original_label", F.lit("->"), "corrected_label")
    keyed = feedback.select(
        F.explode(
            F.array(
                F.struct(F.lit("issue_type").alias("kind"), F.col("issue_type").alias("name")),
                F.struct(F.lit("original_label").alias("kind"), F.col("original_label").alias("name")),
                F.struct(F.lit("correction").alias("kind"), pair.alias("name")),
                F.struct(F.lit("total").alias("kind"), F.lit("all").alias("name")),
            )
        ).alias("k")
    ).select("k.*")
    counts = keyed.groupBy("kind", "name").agg(F.count("*").alias("n"))
    once = feedback.agg(F.countDistinct("file_id").alias("f"), F.countDistinct("user_id").alias("u")).select(
        F.explode(
            F.array(
                F.struct(F.lit("distinct").alias("kind"), F.lit("files").alias("name"), F.col("f").alias("n")),
                F.struct(F.lit("distinct").alias("kind"), F.lit("users").alias("name"), F.col("u").alias("n")),
            )
        ).alias("k")
    )
    return counts.unionByName(once.select("k.*"))


def per_day(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def top_corrections(feedback: DataFrame, k: int = 5) -> DataFrame:
    """The most frequent corrections; of equal counts the one seen first."""
    pair = F.concat("original_label", F.lit("->"), "corrected_label")
    counts = feedback.groupBy(pair.alias("correction")).agg(F.count("*").alias("n"), F.min("id").alias("first_seen"))
    return counts.orderBy(F.desc("n"), "first_seen").limit(k)


def training_due(feedback: DataFrame, threshold: int = 0, default: int = 50) -> DataFrame:
    """n, threshold and due; a threshold of 0 stands for the default."""
    limit = threshold or default
    return feedback.agg(F.count("*").alias("n")).select("n", F.lit(limit).cast("long").alias("threshold"), (F.col("n") >= limit).alias("due"))


def route(keys: DataFrame, key: str, current: str, challenger: str | None, ratio: float) -> DataFrame:
    """``keys`` with the version that serves each: a stable share of them goes to the challenger."""
    bucket = ab_bucket(F.col(key))
    version: Column = F.lit(current)
    if challenger is not None:
        version = F.when(bucket / F.lit(10_000.0) < ratio, F.lit(challenger)).otherwise(F.lit(current))
    return keys.withColumn("bucket", bucket).withColumn("version_id", version)


def ab_summary(log: DataFrame) -> DataFrame:
    return log.groupBy(F.coalesce("version_id", F.lit("unknown")).alias("version_id")).agg(
        F.count("*").alias("n"), F.count_if(F.coalesce("accepted", F.lit(False))).alias("accepted")
    )


def latest_state(events: DataFrame, key: str, at: list[str], state: list[str]) -> DataFrame:
    """Of an event log the last row of each key."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in at)))
    return events.withColumn("_n", last).where("_n = 1").select(key, *state)


def compare_metrics(a: DataFrame, b: DataFrame) -> DataFrame:
    """metric, a, b and their difference over all metrics (name, value) of two versions."""
    left, right = a.select("metric", F.col("value").alias("a")), b.select("metric", F.col("value").alias("b"))
    return left.join(right, "metric", "full_outer").select("metric", "a", "b", (F.col("b") - F.col("a")).alias("delta"))
