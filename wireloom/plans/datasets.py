"""Training sets: class ids, oversampling, splits, label lines and COCO documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wireloom.schema import PUBLIC_CLASSES


def remap_classes(names: DataFrame, canonical: DataFrame) -> DataFrame:
    """(source, local_id, class_id): class names of sources (source, source_order, local_id, name) by canonical (class_id, name) rows.

    Unknown names get new ids from the number of canonical classes on, in the
    order in which sources bring them.
    """
    known = names.join(F.broadcast(canonical), "name", "left")
    fresh = known.where(F.col("class_id").isNull()).groupBy("name").agg(F.min(F.struct("source_order", "local_id")).alias("at"))
    size = canonical.agg(F.count("*").alias("size"))
    order = F.row_number().over(Window.orderBy("at"))  # distinct new names only
    numbered = fresh.crossJoin(F.broadcast(size)).select("name", (F.col("size") + order - 1).cast("int").alias("new_id"))
    return known.join(numbered, "name", "left").select("source", "local_id", "name", F.coalesce("class_id", "new_id").alias("class_id"))


def public_to_own(name: Column) -> Column:
    """The class that stands for a public collection's class; a resistor where none does."""
    table = F.create_map(*(F.lit(x) for kv in PUBLIC_CLASSES.items() for x in kv))
    return F.coalesce(table[F.lower(name)], F.lit("resistor"))


def oversample(rows: DataFrame, weight: Column, stem: str = "stem") -> DataFrame:
    """Each row ``max(1, int(weight))`` times; copies have ``_1``, ``_2``, ... at the end of their stem."""
    times = F.greatest(F.lit(1), F.floor(weight).cast("int"))
    copies = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0), times - 1)))
    named = F.when(F.col("_copy") == 0, F.col(stem)).otherwise(F.concat(stem, F.lit("_"), F.col("_copy").cast("string")))
    return copies.withColumn(stem, named).drop("_copy")


def split_rows(rows: DataFrame, key: str, train_share: float = 0.8) -> DataFrame:
    """``rows`` with ``split``: train or val, by a hash of the key, so that it never moves."""
    place = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint") % 10_000
    return rows.withColumn("split", F.when(place < int(train_share * 10_000), "train").otherwise("val"))


def label_line(class_id: Column, b: list[Column], width: Column, height: Column) -> Column:
    """A line ``class cx cy w h`` in shares of the image."""
    half = F.lit(2.0)
    return F.format_string(
        "%d %.6f %.6f %.6f %.6f", class_id, (b[0] + b[2]) / half / width, (b[1] + b[3]) / half / height, (b[2] - b[0]) / width, (b[3] - b[1]) / height
    )


def parse_label_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Label lines as columns; lines of fewer than five parts go."""
    parts = F.split(F.trim(value), r"\s+")
    named = lines.withColumn("_p", parts).where(F.size("_p") >= 5)
    columns = {"class_id": F.col("_p")[0].cast("int")} | {c: F.col("_p")[i + 1].cast("double") for i, c in enumerate(("cx", "cy", "w", "h"))}
    return named.withColumns(columns).drop("_p")


def coco_annotations(boxes: DataFrame) -> DataFrame:
    """(id, image_id, category_id, x, y, w, h, area, iscrowd) with running ids by image and row.

    Ids start with the counts of the images before: only one row for each image is numbered in one place.
    """
    own = F.row_number().over(Window.partitionBy("image_id").orderBy("det_id"))
    sizes = boxes.groupBy("image_id").agg(F.count("*").alias("n"))
    before = Window.orderBy("image_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("image_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return boxes.withColumn("own", own).join(starts, "image_id").select(
        (F.col("start") + F.col("own")).alias("id"), "image_id", F.col("class_id").alias("category_id"),
        F.col("x0").alias("x"), F.col("y0").alias("y"), w.alias("w"), h.alias("h"), (w.cast("long") * h).alias("area"), F.lit(0).alias("iscrowd"),
    )


def merge_manifest(rows: DataFrame) -> DataFrame:
    """Rows by source and split, with subtotals and the total."""
    return rows.rollup("source", "split").agg(F.count("*").alias("n"))


def coco_document(images: DataFrame, boxes: DataFrame, classes: DataFrame) -> dict[str, DataFrame]:
    """The three lists of a COCO document: images (id, file_name, width, height), annotations, categories."""
    return {
        "images": images.select(F.col("image_id").alias("id"), "file_name", "width", "height"),
        "annotations": coco_annotations(boxes),
        "categories": classes.select(F.col("class_id").alias("id"), F.col("class_name").alias("name")),
    }


def write_coco(parts: dict[str, DataFrame], path: str) -> None:
    for name, rows in parts.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")


#: Hash buckets that :func:`split_exactly` counts.
SPLIT_BUCKETS = 4096


def split_exactly(rows: DataFrame, key: str, train_share: float = 0.8) -> DataFrame:
    """``rows`` with ``split``: the first ``int(n * share)`` in the order of a hash of the key are train.

    Buckets of the hash are counted; only the bucket in which the cut lies is ranked.
    """
    place = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint")
    named = rows.withColumns({"_h": place, "_b": F.floor(place / ((1 << 32) // SPLIT_BUCKETS))})
    counts = {r["_b"]: r["count"] for r in named.groupBy("_b").count().collect()}
    cut, bucket = int(sum(counts.values()) * train_share), 0
    while bucket < SPLIT_BUCKETS and counts.get(bucket, 0) <= cut:
        cut -= counts.get(bucket, 0)
        bucket += 1
    inside = named.where(F.col("_b") == bucket).withColumn("_n", F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)))
    whole = named.where(F.col("_b") != bucket).withColumn("_n", F.lit(None).cast("int"))
    train = (F.col("_b") < bucket) | ((F.col("_b") == bucket) & (F.col("_n") <= cut))
    return whole.unionByName(inside).withColumn("split", F.when(train, "train").otherwise("val")).drop("_h", "_b", "_n")


def val_or_train(rows: DataFrame) -> DataFrame:
    """Rows (source, split); a source without rows to validate on gives its training rows for that too."""
    has = rows.where("split = 'val'").select("source").distinct()
    return rows.unionByName(rows.where("split = 'train'").join(has, "source", "left_anti").withColumn("split", F.lit("val")))
