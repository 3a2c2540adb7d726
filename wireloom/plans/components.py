"""Components of a sheet: numbers, names and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wireloom.functions.geometry import box, centre, distance_to_box, floor_centre
from wireloom.functions.text import designator_prefix, normalize_designator
from wireloom.operators.greedy import match_one_to_one
from wireloom.operators.spatial import nearest, spatial_join


def number_components(detections: DataFrame, prefixes: DataFrame, band: float = 40.0) -> DataFrame:
    """sheet_id, det_id, id and designator: by rows of ``band`` pixels, then from left to right.

    ``prefixes``: (category, prefix).  Designators count by prefix within a sheet.
    """
    b = box()
    row, x = F.bround(floor_centre(b[1], b[3]) / F.lit(band)), floor_centre(b[0], b[2])
    named = detections.join(F.broadcast(prefixes), "category", "left").withColumns({"row": row, "cx": x, "prefix": F.coalesce("prefix", F.lit("U"))})
    all_of = Window.partitionBy("sheet_id").orderBy("row", "cx", "det_id")
    one_prefix = Window.partitionBy("sheet_id", "prefix").orderBy("row", "cx", "det_id")
    return named.select(
        "sheet_id",
        "det_id",
        F.format_string("comp_%03d", F.row_number().over(all_of)).alias("id"),
        F.concat("prefix", F.row_number().over(one_prefix).cast("string")).alias("designator"),
    )


def renumber_free(open_rows: DataFrame, taken: DataFrame) -> DataFrame:
    """``open_rows`` (sheet_id, prefix, id) with the k-th number that ``taken`` (sheet_id, prefix, number) leaves free."""
    keys = ["sheet_id", "prefix"]
    want = open_rows.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("id")))
    sizes = want.groupBy(*keys).agg(F.count("*").alias("n"))
    used = taken.groupBy(*keys).agg(F.collect_set("number").alias("used"))
    free = F.array_except(F.sequence(F.lit(1), (F.col("n") + F.coalesce(F.size("used"), F.lit(0))).cast("int")), F.coalesce("used", F.array().cast("array<int>")))
    lists = sizes.join(used, keys, "left").select(*keys, F.posexplode(free).alias("at", "number"))
    return want.join(lists.select(*keys, (F.col("at") + 1).alias("k"), "number"), [*keys, "k"]).drop("k")


def assign_designators(components: DataFrame, texts: DataFrame, prefixes: DataFrame, most: float = 60.0) -> DataFrame:
    """(sheet_id, comp_id, text_id, designator, distance): each name, label and component once, cheapest pairs first.

    A label may name a component whose class carries its letter code and that
    lies within reach of it; codes that a class prefers less cost more.
    """
    name = normalize_designator(F.col("text"))
    labels = texts.withColumn("designator", name).where(F.col("designator").isNotNull())
    b = labels.select(
        "sheet_id", F.col("text_id").alias("b_id"), "designator", designator_prefix(F.col("designator")).alias("prefix"),
        centre(F.col("x0"), F.col("x1")).alias("tx"), centre(F.col("y0"), F.col("y1")).alias("ty"), F.greatest(F.lit(1), F.col("y1") - F.col("y0")).alias("th"),
    )
    a = components.join(F.broadcast(prefixes), F.col("category") == F.col("class_name")).select(
        "sheet_id", F.col("comp_id").alias("a_id"), "prefix", "rank", *(F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1"))
    )
    size = F.greatest(F.col("a_x1") - F.col("a_x0"), F.col("a_y1") - F.col("a_y0"))
    limit = F.greatest(F.lit(most), 0.8 * size, 3 * F.col("th"))
    d = distance_to_box(F.col("tx"), F.col("ty"), box("a_"))
    # a sheet and a letter code have few rows each; the distance is a residual predicate
    pairs = a.join(b, ["sheet_id", "prefix"]).withColumn("distance", d).where(F.col("distance") <= limit)
    pairs = pairs.select("sheet_id", F.col("a_id").alias("comp_id"), F.col("b_id").alias("text_id"), "designator", "distance", (F.col("distance") + 4.0 * F.col("rank")).alias("cost"))
    order = [F.col("cost"), F.col("distance"), F.col("text_id"), F.col("comp_id")]
    out = match_one_to_one(pairs, ["sheet_id"], order, ["text_id", "comp_id", "designator"])
    return out.select("sheet_id", "comp_id", "text_id", "designator", F.bround("distance", 1).alias("distance"))


def associate_texts(texts: DataFrame, components: DataFrame, radius: float = 50.0) -> DataFrame:
    """(sheet_id, comp_id, text_id, text): texts go to the nearest centre within the radius; of several the last one stays."""
    b = box()
    a = texts.select("sheet_id", F.col("text_id").alias("a_id"), "text", floor_centre(b[0], b[2]).alias("a_x"), floor_centre(b[1], b[3]).alias("a_y"))
    c = components.select("sheet_id", F.col("comp_id").alias("b_id"), floor_centre(b[0], b[2]).alias("b_x"), floor_centre(b[1], b[3]).alias("b_y"))
    hits = nearest(a, c, ["sheet_id"], radius, strict=True)
    return hits.groupBy("sheet_id", F.col("b_id").alias("comp_id")).agg(F.max("a_id").alias("text_id"), F.max_by("text", "a_id").alias("text"))


def merge_detections(primary: DataFrame, secondary: DataFrame, most: float = 0.5) -> DataFrame:
    """All of the first, and of the second what covers none of it; dots clash with dots only."""
    from wireloom.functions.geometry import overlap_of_smaller

    a = secondary.select("sheet_id", F.col("det_id").alias("a_id"), F.col("category").alias("a_cat"), *(F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")))
    b = primary.select("sheet_id", F.col("category").alias("b_cat"), *(F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")))
    same_kind = (F.col("a_cat") == "junction_dot") == (F.col("b_cat") == "junction_dot")
    free = spatial_join(a, b, ["sheet_id"], lambda: same_kind & (overlap_of_smaller(box("a_"), box("b_")) > most), 64, 0, "left_anti")
    return primary.unionByName(secondary.join(free.select("sheet_id", F.col("a_id").alias("det_id")), ["sheet_id", "det_id"], "left_semi"))
