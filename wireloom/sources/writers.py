"""Sinks: logs, manifests, vector stores, label files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATS = ("json", "xml")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def truncate_log(log: DataFrame, path: str) -> None:
    log.limit(0).write.mode("overwrite").json(path)


def write_manifests(manifests: DataFrame, path: str, kind: str = "json") -> None:
    """One document a line (json), or one file a part (xml)."""
    if kind not in FORMATS:
        raise ValueError(f"unknown manifest format: {kind}")
    if kind == "json":
        manifests.write.mode("overwrite").json(path)
    else:
        manifests.write.mode("overwrite").format("xml").option("rowTag", "manifest").save(path)


def write_pages(manifests: DataFrame, path: str, page: str = "page") -> None:
    manifests.write.mode("overwrite").partitionBy(page).json(path)


def upsert(store: DataFrame, fresh: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """``store`` with the rows of ``fresh`` in place of those of the same key.

    Of repeated new keys the last by ``order`` stays (ties, and without one: the greatest row).
    """
    rest = [c for c in fresh.columns if c not in (key, order)]
    ranked = F.struct(*([order] if order else []), *rest)
    once = fresh.groupBy(key).agg(F.max(ranked).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in fresh.columns if c != key))
    return store.join(once.select(key), key, "left_anti").unionByName(once.select(*store.columns))


def delete(store: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return store.join(gone.select(key).distinct(), key, "left_anti")


def clear(store: DataFrame) -> DataFrame:
    """No rows, the same columns."""
    return store.limit(0)


def write_labels(lines: DataFrame, path: str) -> None:
    """Label lines (file, value), a folder for each file's name."""
    lines.select("file", "value").write.mode("overwrite").partitionBy("file").text(path)


def correction_crops(feedback: DataFrame, symbols: DataFrame, crops: DataFrame) -> DataFrame:
    """Label lines of reviewers' crops: the whole crop, the corrected class (class 0 where it is unknown); rows without a crop go."""
    known = feedback.join(crops.select("id"), "id", "left_semi").join(F.broadcast(symbols.select(F.col("class_name").alias("corrected_label"), "class_id")), "corrected_label", "left")
    return known.select(F.col("id").alias("file"), F.format_string("%d 0.500000 0.500000 0.900000 0.900000", F.coalesce("class_id", F.lit(0))).alias("value"))
