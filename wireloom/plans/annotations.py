"""The store of images and their annotations: one table for each; a single writer replaces rows by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Images (image_id, file_name, width, height) and annotations (image_id, class_name, box) of a written store."""
    return spark.read.parquet(f"{path}/images"), spark.read.parquet(f"{path}/annotations")


def write_store(images: DataFrame, annotations: DataFrame, path: str) -> None:
    images.write.mode("overwrite").parquet(f"{path}/images")
    annotations.write.mode("overwrite").parquet(f"{path}/annotations")


def with_state(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Images with the number of their annotations and whether they have any."""
    counts = annotations.groupBy("image_id").agg(F.count("*").alias("n"))
    return images.join(counts, "image_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).withColumn("annotated", F.col("n") > 0)


def replace_annotations(images: DataFrame, annotations: DataFrame, touched: DataFrame, fresh: DataFrame) -> DataFrame:
    """Annotations after an update of the ``touched`` images (image_id) to the ``fresh`` ones; images that aren't known are left out.

    A class without a name is called by its number.
    """
    known = touched.select("image_id").distinct().join(images.select("image_id"), "image_id", "left_semi")
    named = fresh.withColumn("class_name", F.coalesce("class_name", F.concat(F.lit("class_"), F.col("class_id").cast("string"))))
    return annotations.join(known, "image_id", "left_anti").unionByName(named.join(known, "image_id", "left_semi"))


def delete_images(images: DataFrame, annotations: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    keys = gone.select("image_id").distinct()
    return images.join(keys, "image_id", "left_anti"), annotations.join(keys, "image_id", "left_anti")


def stats(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """(what, n): images, annotated images, annotations, and annotations by class."""
    state = with_state(images, annotations)
    totals = state.agg(F.count("*").alias("images"), F.count_if("annotated").alias("annotated"), F.coalesce(F.sum("n"), F.lit(0)).alias("annotations"))
    rows = totals.select(F.explode(F.array(*(F.struct(F.lit(c).alias("what"), F.col(c).alias("n")) for c in totals.columns))).alias("r")).select("r.*")
    by_class = annotations.join(images, "image_id", "left_semi").groupBy(F.concat(F.lit("class "), F.col("class_name")).alias("what")).agg(F.count("*").alias("n"))
    return rows.unionByName(by_class)
