"""What several operators use: the word rule's white space, Arrow batches, texts without nulls."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word rule ``[^\x20\x09-\x0D]+``, as a Java/RE2 class body.
SPACE_CLASS = r"\x20\x09-\x0D"
#: Rows and bytes of text that an Arrow batch holds at most.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that go to Python, so that long texts don't pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def or_empty(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))
