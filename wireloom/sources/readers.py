"""Scans: logs, label files, registries, images and their headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wireloom.plans.datasets import parse_label_lines
from wireloom.schema import AB_LOG, FEEDBACK


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines log; lines that don't parse go."""
    columns = ", ".join(x.strip() for x in schema.split(","))
    raw = spark.read.schema(columns + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return raw.where(F.col("_bad").isNull()).drop("_bad")


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return read_log(spark, path, FEEDBACK)


def read_ab_log(spark: SparkSession, path: str) -> DataFrame:
    return read_log(spark, path, AB_LOG)


def last_rows(log: DataFrame, order: str, n: int) -> DataFrame:
    """The last ``n`` rows of a log, in its order."""
    return log.orderBy(F.desc(order)).limit(n).orderBy(order)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A registry document {"current": ..., "versions": {id: {...}}} as rows of versions."""
    kind = "current string, versions map<string, struct<version_id:string, model_type:string, weights_path:string, status:string, parent_version:string, notes:string, metrics:map<string,double>>>"
    index = spark.read.schema(kind).option("multiLine", True).json(path)
    rows = index.select("current", F.explode("versions").alias("key", "v")).select("current", "key", "v.*")
    return rows.withColumn("is_current", F.col("key") == F.col("current")).drop("key")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label files of a folder: file, class_id, cx, cy, w, h; lines of fewer than five parts go."""
    lines = spark.read.text(path).withColumn("file", F.input_file_name())
    return parse_label_lines(lines).drop("value")


def read_netlists(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Golden netlist documents as components (file, designator, class_name, box, pins) and nets (file, refs).

    A pin's value is a point, or a list of points where it has two sides; both become rows of a list.
    """
    kind = "components array<struct<designator:string, class_name:string, bbox:array<int>, pins:map<string,string>>>, nets array<array<string>>"
    raw = spark.read.schema(kind).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    point = "array<int>"
    one = lambda v: F.when(v.rlike(r"^\s*\[\s*\["), F.from_json(v, f"array<{point}>")).otherwise(F.array(F.from_json(v, point)))
    c = raw.select("file", F.explode("components").alias("c")).select("file", "c.designator", "c.class_name", *(F.col("c.bbox")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))), F.transform_values("c.pins", lambda _, v: one(v)).alias("pins"))
    return c, raw.select("file", F.explode("nets").alias("refs"))


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Files as rows (path, modified, length, content)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def is_pdf(path: Column, content: Column) -> Column:
    return F.lower(path).endswith(".pdf") | (F.substring(content, 1, 4) == F.lit(b"%PDF"))


def _number(content: Column, at: int, size: int) -> Column:
    """A big-endian number from byte ``at`` (from 1) on."""
    return F.conv(F.hex(F.substring(content, at, size)), 16, 10).cast("int")


def image_info(files: DataFrame) -> DataFrame:
    """path, length, format, width, height from file headers, without decoding; sizes of PNG, GIF and BMP only."""
    c = F.col("content")
    starts = lambda b: F.substring(c, 1, len(b)) == F.lit(b)
    little = lambda at, n: F.conv(F.hex(F.concat(*(F.substring(c, at + n - 1 - i, 1) for i in range(n)))), 16, 10).cast("int")
    kind = (
        F.when(starts(b"\x89PNG\r\n\x1a\n"), "png")
        .when(starts(b"\xff\xd8\xff"), "jpeg")
        .when(starts(b"GIF8"), "gif")
        .when(starts(b"BM"), "bmp")
        .when(starts(b"II*\x00") | starts(b"MM\x00*"), "tiff")
        .when(is_pdf(F.col("path"), c), "pdf")
        .otherwise("unknown")
    )
    return files.select("path", "length", kind.alias("format"), "content").select(
        "path",
        "length",
        "format",
        F.when(F.col("format") == "png", _number(c, 17, 4)).when(F.col("format") == "gif", little(7, 2)).when(F.col("format") == "bmp", little(19, 4)).alias("width"),
        F.when(F.col("format") == "png", _number(c, 21, 4)).when(F.col("format") == "gif", little(9, 2)).when(F.col("format") == "bmp", little(23, 4)).alias("height"),
    )


def read_dataset(path: str) -> dict:
    """A data set's YAML: its folder, the folders of its splits (validation falls back to training), and class names by number."""
    import os

    import yaml

    with open(path, encoding="utf-8") as file:
        told = yaml.safe_load(file) or {}
    here = os.path.dirname(os.path.abspath(path))
    names = told.get("names") or {}
    numbered = enumerate(names) if isinstance(names, list) else names.items()
    train = told.get("train", "images/train")
    return {"path": os.path.normpath(os.path.join(here, told.get("path", ""))), "train": train, "val": told.get("val", train), "names": {int(k): v for k, v in numbered}}


def read_vector_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Entries of a stored index beside their vectors, by id; what has only one of the two goes, and so do places of pictures and times."""
    entries = spark.read.schema(schema).json(f"{path}/meta").drop("image_path", "created_at")
    return entries.join(spark.read.parquet(f"{path}/vectors").select("id", "embedding"), "id")
