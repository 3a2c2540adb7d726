"""Tiles of sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wireloom.functions.geometry import area, box, intersection
from wireloom.operators.spatial import spatial_join


def starts(size: Column, tile: int, overlap: float) -> Column:
    """Tile origins along one axis: steps, then one flush with the end."""
    step = int(tile * (1 - overlap))
    last = size - F.lit(tile)
    return F.when(size <= tile, F.array(F.lit(0))).otherwise(
        F.array_distinct(F.concat(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step)), F.array(last)))
    )


def tile_grid(sheets: DataFrame, tile: int = 1024, overlap: float = 0.2, key: str = "sheet_id") -> DataFrame:
    """Row by row the tiles of each sheet (width, height): key, tile_id, x0, y0, x1, y1."""
    spread = sheets.select(
        key,
        "width",
        "height",
        F.posexplode(starts(F.col("height").cast("int"), tile, overlap)).alias("_row", "y0"),
    ).select("*", F.posexplode(starts(F.col("width").cast("int"), tile, overlap)).alias("_col", "x0"))
    columns = F.size(starts(F.col("width").cast("int"), tile, overlap))
    return spread.select(
        key,
        (F.col("_row") * columns + F.col("_col")).cast("long").alias("tile_id"),
        "x0",
        "y0",
        F.least(F.col("x0") + tile, F.col("width").cast("int")).alias("x1"),
        F.least(F.col("y0") + tile, F.col("height").cast("int")).alias("y1"),
    )


def to_sheet(detections: DataFrame, tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes of tiles in the coordinates of their sheet; boxes of unknown tiles go."""
    origin = tiles.select(*keys, F.col("x0").alias("_ox"), F.col("y0").alias("_oy"))
    joined = detections.join(origin, keys)
    moved = {c: F.col(c) + F.col("_ox" if c[0] == "x" else "_oy") for c in ("x0", "y0", "x1", "y1")}
    return joined.withColumns(moved).drop("_ox", "_oy")


def fixed_steps(sheets: DataFrame, tile: int = 1024, overlap: float = 0.2, key: str = "sheet_id") -> DataFrame:
    """Tile bounds of the older scheme: steps from 0 up to each side; tiles at an end are shifted back to be whole, also below 0."""
    step = int(tile * (1 - overlap))
    steps = lambda c: F.sequence(F.lit(0), F.floor((F.col(c).cast("int") - 1) / step).cast("int") * step, F.lit(step))
    spread = sheets.select(key, "width", "height", F.explode(steps("height")).alias("y")).select("*", F.explode(steps("width")).alias("x"))
    ends = spread.withColumns({"x1": F.least(F.col("x") + tile, F.col("width").cast("int")), "y1": F.least(F.col("y") + tile, F.col("height").cast("int"))})
    back = lambda at, end, side: F.when(F.col(end) == F.col(side), F.col(end) - tile).otherwise(F.col(at))
    return ends.select(key, "x", "y", back("x", "x1", "width").alias("x0"), back("y", "y1", "height").alias("y0"), "x1", "y1")


def visible_in_tiles(tiles: DataFrame, boxes: DataFrame, least: float = 0.6, key: str = "sheet_id", large: tuple[str, float, float] | None = None) -> DataFrame:
    """Boxes (b_id) clipped to the tiles (a_id) that show at least this share of them, in the tile's coordinates.

    ``large``: a category, a share of the tile's side and a lower share to be
    seen: boxes of that category with a longer side than that need to show only so much.
    """
    a = tiles.select(key, F.col("tile_id").alias("a_id"), *(F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")))
    b = boxes.select(key, F.col("det_id").alias("b_id"), *(F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")))
    share = F.lit(least)
    if large:
        kind, part, lower = large
        b = boxes.select(key, "category", "det_id").withColumnRenamed("det_id", "b_id").join(b, [key, "b_id"])
        longest = F.greatest(F.col("b_x1") - F.col("b_x0"), F.col("b_y1") - F.col("b_y0"))
        share = F.when((F.col("category") == kind) & (longest > part * (F.col("a_x1") - F.col("a_x0"))), lower).otherwise(least)
    seen = intersection(box("a_"), box("b_"))
    pairs = spatial_join(a, b, [key], lambda: (seen > 0) & (seen >= share * area(box("b_"))), 256)
    return pairs.select(
        key,
        F.col("a_id").alias("tile_id"),
        F.col("b_id").alias("det_id"),
        (F.greatest("a_x0", "b_x0") - F.col("a_x0")).alias("x0"),
        (F.greatest("a_y0", "b_y0") - F.col("a_y0")).alias("y0"),
        (F.least("a_x1", "b_x1") - F.col("a_x0")).alias("x1"),
        (F.least("a_y1", "b_y1") - F.col("a_y0")).alias("y1"),
    )


def best_crops(detections: DataFrame, sheets: DataFrame, width: int = 900, height: int = 600, most: int = 3, part: float = 0.4) -> DataFrame:
    """The surest detections' surroundings, of each sheet at most so many that share less than ``part`` of their sides with a surer one: windows inside the sheet."""
    from wireloom.operators.greedy import greedy_leader

    placed = detections.join(sheets.select("sheet_id", "width", "height"), "sheet_id")
    at = lambda a, b, side, size: F.when(F.col(side) > size, F.greatest(F.lit(0), F.least(F.col(side) - size, F.floor((F.col(a) + F.col(b)) / 2).cast("int") - size // 2))).otherwise(0)
    x0, y0 = at("x0", "x1", "width", width), at("y0", "y1", "height", height)
    rows = placed.select("sheet_id", "det_id", "confidence", x0.alias("cx0"), y0.alias("cy0"), F.least(F.col("width"), x0 + width).alias("cx1"), F.least(F.col("height"), y0 + height).alias("cy1"))

    def clash(k: Column, x: Column) -> Column:
        shared = lambda a, b: F.least(k[b], x[b]) - F.greatest(k[a], x[a])
        return (shared("cx0", "cx1") > part * width) & (shared("cy0", "cy1") > part * height)

    kept = greedy_leader(rows, ["sheet_id"], [-F.col("confidence"), F.col("det_id")], clash)
    return kept.withColumn("nth", F.row_number().over(Window.partitionBy("sheet_id").orderBy(F.desc("confidence"), "det_id"))).where(F.col("nth") <= most)
