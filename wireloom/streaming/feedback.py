"""Feedback as a stream: running counts, the training trigger and routing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wireloom.plans import feedback
from wireloom.schema import FEEDBACK


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """New feedback files of a folder; lines that don't parse go."""
    raw = spark.readStream.schema(FEEDBACK + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return raw.where(F.col("_bad").isNull()).drop("_bad")


def correction_counts(stream: DataFrame, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """Corrections by window and labels; rows later than the watermark don't count."""
    timed = stream.withColumn("at", F.col("created_at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window).alias("w"), "original_label", "corrected_label").agg(F.count("*").alias("n"))


def on_due(stream: DataFrame, checkpoint: str, threshold: int, due: Callable[[DataFrame, int], None], count_path: str) -> StreamingQuery:
    """Calls ``due`` after each batch at which as many rows as the threshold have come; it goes on firing until the log is cleared.

    Rows are kept by batch number, so that a batch that is run again counts once.
    """

    def step(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{count_path}/batch={number}")
        spark = batch.sparkSession
        total = feedback.training_due(spark.read.parquet(f"{count_path}/batch=*"), threshold).first()
        if total["due"]:
            due(spark.read.parquet(f"{count_path}/batch=*"), total["n"])

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def route(stream: DataFrame, key: str, current: str, challenger: str | None, ratio: float) -> DataFrame:
    """Each row of a stream with the version that serves its key."""
    return feedback.route(stream, key, current, challenger, ratio)
