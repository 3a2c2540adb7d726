"""Manifests: documents of several pages, and their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_pages(rows: DataFrame, page: str, *ids: str) -> DataFrame:
    """``rows`` with the page in front of their ids, so that pages can lie in one document."""
    return rows.withColumns({c: F.concat(F.lit("p"), F.col(page).cast("string"), F.lit("_"), F.col(c)) for c in ids})


def stage_totals(runs: DataFrame) -> DataFrame:
    """document, stage, seconds over all pages, and the document's warnings, each once, as first seen."""
    seconds = runs.groupBy("document", "stage").agg(F.sum("seconds").cast("double").alias("seconds"))
    once = runs.where(F.col("warning").isNotNull()).groupBy("document", "warning").agg(F.min("seq").alias("seq"))
    lists = once.groupBy("document").agg(F.sort_array(F.collect_list(F.struct("seq", "warning"))).alias("w"))
    lists = lists.select("document", F.array_join("w.warning", ",").alias("warnings"))
    return seconds.join(lists, "document", "left").withColumn("warnings", F.coalesce("warnings", F.lit("")))


def netlist_line(connections: Column) -> Column:
    """``A:1 - B:2``: a net's references in order."""
    return F.array_join(F.array_sort(F.transform(connections, lambda c: F.concat(c["component_id"], F.lit(":"), c["pin"]))), " - ")


def review_issues(detections: DataFrame, texts: DataFrame, junctions: DataFrame, sure: float = 0.7, readable: float = 0.65) -> DataFrame:
    """What a person should look at: unsure symbols and texts, and every junction."""
    unsure = detections.where(F.col("confidence") < sure).select("sheet_id", F.lit("symbol").alias("issue_type"), F.col("det_id").cast("string").alias("ref"), "confidence")
    unread = texts.where(F.col("confidence") < readable).select("sheet_id", F.lit("text").alias("issue_type"), F.col("text_id").cast("string").alias("ref"), "confidence")
    crossings = junctions.select("sheet_id", F.lit("junction").alias("issue_type"), F.col("node_id").alias("ref"), F.lit(0.5).alias("confidence"))
    found = unsure.unionByName(unread).unionByName(crossings)
    order = Window.partitionBy("sheet_id").orderBy("issue_type", "ref")
    return found.withColumn("issue_idx", F.row_number().over(order) - 1)


def first_issues(issues: DataFrame, most: int = 50) -> DataFrame:
    """The issues of each sheet that a call budget covers, in their order."""
    return issues.where(F.col("issue_idx") < most)


def manifest(components: DataFrame, nets: DataFrame, issues: DataFrame) -> DataFrame:
    """One nested document for each sheet."""
    gather = lambda df, name: df.groupBy("sheet_id").agg(F.sort_array(F.collect_list(F.struct(*(c for c in df.columns if c != "sheet_id")))).alias(name))
    out = gather(components, "components")
    for df, name in ((nets, "nets"), (issues, "human_review_queue")):
        out = out.join(gather(df, name), "sheet_id", "full_outer")
    return out


def to_xml_text(document: Column, root: str = "manifest") -> Column:
    return F.to_xml(document, {"rowTag": root})
