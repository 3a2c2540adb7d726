"""What is known of a sheet's boxes, pins and wires before nets are made."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wireloom.functions.geometry import area, box, floor_centre, projection, touches
from wireloom.operators.groups import by_group
from wireloom.operators.spatial import nearest, spatial_join
from wireloom.schema import CYRILLIC, LATIN

NO_WIRES = ("junction_dot", "device_block")


def clean_detections(detections: DataFrame, sheets: DataFrame, classes: DataFrame) -> DataFrame:
    """Boxes of known classes, clipped to their sheet, that still have an area; confidence to three digits."""
    known = detections.join(F.broadcast(classes.select(F.col("class_name").alias("category"))), "category", "left_semi")
    clipped = known.join(sheets.select("sheet_id", "width", "height"), "sheet_id").withColumns(
        {
            "x0": F.least(F.greatest("x0", F.lit(0)), "width"),
            "y0": F.least(F.greatest("y0", F.lit(0)), "height"),
            "x1": F.least(F.greatest("x1", F.lit(0)), "width"),
            "y1": F.least(F.greatest("y1", F.lit(0)), "height"),
            "confidence": F.bround("confidence", 3),
        }
    )
    return clipped.where("x1 > x0 and y1 > y0").drop("width", "height")


def wire_exclusions(detections: DataFrame) -> DataFrame:
    """Boxes in which there are no wires: dots are part of a wire, blocks are frames around many."""
    keep = ~F.col("category").isin(*NO_WIRES)
    if "exclude_from_wires" in detections.columns:
        keep &= F.coalesce("exclude_from_wires", F.lit(True))
    return detections.where(keep)


def shift_edge_pins(pins: DataFrame, owners: DataFrame, pad: int, reach: float = 3.0) -> DataFrame:
    """Pins on their symbol's edge move outwards by ``pad``, not below 0; of equally near edges left, right, top, bottom."""
    b = box()
    own = owners.select("sheet_id", F.col("comp_id").alias("component_id"), F.col("category").alias("_category"), "x0", "y0", "x1", "y1")
    gaps = [(F.col("x") - b[0], -1, 0), (b[2] - F.col("x"), 1, 0), (F.col("y") - b[1], 0, -1), (b[3] - F.col("y"), 0, 1)]
    best = F.array_min(F.array(*(F.struct(gap.alias("gap"), F.lit(i).alias("i"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (gap, dx, dy) in enumerate(gaps))))
    moved = (F.col("_e.gap") <= reach) & (F.col("_category") != "junction_dot")
    step = lambda c, d: F.greatest(F.lit(0), F.col(c) + F.when(moved, F.col(d) * pad).otherwise(0))
    return pins.join(own, ["sheet_id", "component_id"]).withColumn("_e", best).withColumns({"x": step("x", "_e.dx"), "y": step("y", "_e.dy")}).drop("_e", "_category", "x0", "y0", "x1", "y1")


def region_of_interest(x: Column, y: Column, size: int, width: Column, height: Column) -> list[Column]:
    """A window around a point, cut at the sheet's borders."""
    half = size // 2
    return [F.greatest(F.lit(0), x - half), F.greatest(F.lit(0), y - half), F.least(width, x + half), F.least(height, y + half)]


def _centres(df: DataFrame, side: str, key: str) -> DataFrame:
    b = box()
    return df.select("sheet_id", F.col(key).alias(f"{side}_id"), floor_centre(b[0], b[2]).alias(f"{side}_x"), floor_centre(b[1], b[3]).alias(f"{side}_y"))


def connector_pins(connectors: DataFrame, pins: DataFrame, radius: float = 45.0, most: int = 10) -> DataFrame:
    """(sheet_id, det_id, pin_id, pin_number): up to ten pins near each connector, numbered by distance; pins may be shared."""
    hits = nearest(_centres(connectors, "a", "det_id"), _centres(pins, "b", "det_id"), ["sheet_id"], radius, most, strict=True)
    return hits.select("sheet_id", F.col("a_id").alias("det_id"), F.col("b_id").alias("pin_id"), F.col("nth").cast("string").alias("pin_number"))


def connector_pins_once(connectors: DataFrame, pins: DataFrame, radius: float = 150.0) -> DataFrame:
    """(sheet_id, det_id, pin_id): each pin goes to the first connector that reaches it."""
    a = _centres(connectors, "a", "det_id")
    b = _centres(pins, "b", "det_id")
    as_box = lambda df, s: df.withColumns({f"{s}_x0": F.col(f"{s}_x"), f"{s}_x1": F.col(f"{s}_x"), f"{s}_y0": F.col(f"{s}_y"), f"{s}_y1": F.col(f"{s}_y")})
    dx, dy = F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")
    pairs = spatial_join(as_box(a, "a"), as_box(b, "b"), ["sheet_id"], lambda: dx * dx + dy * dy < radius * radius, int(radius), radius)
    return pairs.groupBy("sheet_id", F.col("b_id").alias("pin_id")).agg(F.min("a_id").alias("det_id"))


def connector_numbers(cells: DataFrame, texts: DataFrame) -> DataFrame:
    """(sheet_id, comp_id, pin_number, number): digits printed in a connector's cells.

    ``cells``: a row for each cell (sheet_id, comp_id, connector box, at, pin_number, px, py, vertical, n_cells).  A
    cell takes the nearest number along its axis, if it lies within half a
    cell and no cell before took it.  A connector whose names would repeat
    keeps its own.
    """
    digits = F.translate(F.upper(F.translate(F.btrim("text"), CYRILLIC, LATIN)), "OIL", "011")
    b = box()
    read = texts.select("sheet_id", "text_id", digits.alias("number"), ((b[0] + b[2]) / 2.0).alias("cx"), ((b[1] + b[3]) / 2.0).alias("cy")).where(F.col("number").rlike("^[0-9]{1,3}$"))
    inside = cells.join(read, "sheet_id").where((F.col("cx") >= F.col("x0")) & (F.col("cx") <= F.col("x1")) & (F.col("cy") >= F.col("y0")) & (F.col("cy") <= F.col("y1")))
    gap = F.when(F.col("vertical"), F.abs(F.col("cy") - F.col("py"))).otherwise(F.abs(F.col("cx") - F.col("px")))
    cell = F.when(F.col("vertical"), F.col("y1") - F.col("y0")).otherwise(F.col("x1") - F.col("x0")) / F.col("n_cells")
    own = ["sheet_id", "comp_id"]
    nearest_one = F.row_number().over(Window.partitionBy(*own, "at").orderBy("gap", "text_id"))
    best = inside.withColumns({"gap": gap, "cell": cell}).withColumn("_n", nearest_one).where((F.col("_n") == 1) & (F.col("gap") <= 0.5 * F.col("cell")))
    taken = best.withColumn("_t", F.row_number().over(Window.partitionBy(*own, "number").orderBy("at"))).where("_t = 1").select(*own, "at", "number")
    named = cells.join(taken, [*own, "at"], "left").withColumn("final", F.coalesce("number", "pin_number"))
    whole = named.groupBy(*own).agg(F.count("*").alias("n"), F.countDistinct("final").alias("d")).where("n = d").select(*own)
    return named.where(F.col("number").isNotNull()).join(whole, own, "left_semi").select(*own, "pin_number", "number")


def covered_share(b: list[Column], rects: Column) -> Column:
    """Share of a box that the union of rectangles (x0, y0, x1, y1) covers: slab by slab between their edges."""
    cut = F.transform(
        rects,
        lambda r: F.struct(F.greatest(r["x0"], b[0]).alias("x0"), F.greatest(r["y0"], b[1]).alias("y0"), F.least(r["x1"], b[2]).alias("x1"), F.least(r["y1"], b[3]).alias("y1")),
    )
    real = F.filter(cut, lambda r: (r["x0"] < r["x1"]) & (r["y0"] < r["y1"]))
    edges = F.array_sort(F.array_distinct(F.flatten(F.transform(real, lambda r: F.array(r["x0"], r["x1"])))))
    slabs = F.zip_with(edges, F.slice(edges, 2, 1 << 30), lambda a, z: F.struct(a.alias("a"), z.alias("z")))

    def height(slab: Column) -> Column:
        spans = F.array_sort(F.transform(F.filter(real, lambda r: (r["x0"] <= slab["a"]) & (r["x1"] >= slab["z"])), lambda r: F.struct(r["y0"].alias("y0"), r["y1"].alias("y1"))))
        start = F.struct(F.lit(0).alias("sum"), F.lit(-(1 << 30)).alias("end"))
        return F.aggregate(
            spans,
            start,
            lambda s, r: F.struct((s["sum"] + F.greatest(F.lit(0), r["y1"] - F.greatest(r["y0"], s["end"]))).alias("sum"), F.greatest(s["end"], r["y1"]).alias("end")),
            lambda s: s["sum"],
        )

    total = F.aggregate(slabs, F.lit(0).cast("long"), lambda t, s: t + F.when(s["z"].isNull(), 0).otherwise((s["z"] - s["a"]).cast("long") * height(s)))
    return total / F.greatest(F.lit(1), area(b))


def drop_under_texts(detections: DataFrame, texts: DataFrame, most: float = 0.5) -> DataFrame:
    """Detections of which words (two letters or digits at least, with some room around) cover less than ``most``.

    Dots and connectors stay.
    """
    tall = F.col("y1") - F.col("y0")
    py, px = F.floor(0.45 * tall).cast("int"), F.floor(0.2 * tall).cast("int")
    words = texts.where(F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", "")) >= 2).select(
        "sheet_id", F.greatest(F.lit(0), F.col("x0") - px).alias("b_x0"), F.greatest(F.lit(0), F.col("y0") - py).alias("b_y0"), (F.col("x1") + px).alias("b_x1"), (F.col("y1") + py).alias("b_y1")
    )
    a = detections.where(~F.col("category").isin("junction_dot", "connector_body")).select("sheet_id", F.col("det_id").alias("a_id"), *(F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")))
    pairs = spatial_join(a, words, ["sheet_id"], lambda: touches(box("a_"), box("b_")))
    rect = F.struct(*(F.col(f"b_{c}").alias(c) for c in ("x0", "y0", "x1", "y1")))
    lists = pairs.groupBy("sheet_id", "a_id", *(f"a_{c}" for c in ("x0", "y0", "x1", "y1"))).agg(F.collect_list(rect).alias("rects"))
    gone = lists.where(covered_share(box("a_"), F.col("rects")) >= most).select("sheet_id", F.col("a_id").alias("det_id"))
    return detections.join(gone, ["sheet_id", "det_id"], "left_anti")


def junctions_without_dot(junctions: DataFrame, dots: DataFrame, reach: int = 15) -> DataFrame:
    """Junctions (sheet_id, x, y) with no dot's centre nearer than ``reach`` on both axes."""
    a = junctions.select("sheet_id", F.struct("x", "y").alias("a_id"), F.col("x").alias("a_x0"), F.col("y").alias("a_y0"), F.col("x").alias("a_x1"), F.col("y").alias("a_y1"))
    c = _centres(dots, "b", "det_id")
    b = c.select("sheet_id", F.col("b_x").alias("b_x0"), F.col("b_y").alias("b_y0"), F.col("b_x").alias("b_x1"), F.col("b_y").alias("b_y1"))
    near = lambda: (F.abs(F.col("a_x0") - F.col("b_x0")) < reach) & (F.abs(F.col("a_y0") - F.col("b_y0")) < reach)
    return spatial_join(a, b, ["sheet_id"], near, 32, reach, "left_anti").select("sheet_id", "a_id.*")


def drop_isolated(segments: DataFrame, boxes: DataFrame, short: float = 50.0, reach: int = 19, tolerance: float = 4.0) -> DataFrame:
    """Short segments stay only where an end lies in a padded box or by another segment."""
    length = F.hypot(F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy"))
    ends = segments.where(length < short).select(
        "sheet_id", "segment_id", F.explode(F.array(F.struct(F.col("sx").alias("x"), F.col("sy").alias("y")), F.struct(F.col("ex").alias("x"), F.col("ey").alias("y")))).alias("p")
    )
    points = ends.select("sheet_id", F.col("segment_id").alias("a_id"), *(F.col(f"p.{c[0]}").alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")))
    b = boxes.select("sheet_id", *(F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")))
    by_box = spatial_join(points, b, ["sheet_id"], lambda: touches(box("a_"), box("b_"), reach), 64, reach).select("sheet_id", F.col("a_id").alias("segment_id"))
    wires = segments.select(
        "sheet_id", F.col("segment_id").alias("b_id"), "sx", "sy", "ex", "ey",
        F.least("sx", "ex").alias("b_x0"), F.least("sy", "ey").alias("b_y0"), F.greatest("sx", "ex").alias("b_x1"), F.greatest("sy", "ey").alias("b_y1"),
    )
    d = projection(*map(F.col, ("a_x0", "a_y0", "sx", "sy", "ex", "ey")))[3]
    by_wire = spatial_join(points, wires, ["sheet_id"], lambda: (F.col("a_id") != F.col("b_id")) & (d <= tolerance), 64, tolerance).select("sheet_id", F.col("a_id").alias("segment_id"))
    held = by_box.unionByName(by_wire).distinct().withColumn("_held", F.lit(True))
    return segments.join(held, ["sheet_id", "segment_id"], "left").where((length >= short) | F.col("_held")).drop("_held")


def merge_touching(boxes: DataFrame, pad: int = 2) -> DataFrame:
    """Hulls (sheet_id, x0, y0, x1, y1) of boxes that touch, until no two hulls do.

    Hulls grow, so rounds repeat, within the sheet: one shuffle in all.  A sheet is held in one task.
    """
    rows = boxes.select("sheet_id", *_CORNERS).distinct()
    whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in rows.columns))

    def body(table, starts):
        corners = np.stack([table.column(c).to_numpy() for c in _CORNERS], 1)
        made = [_hulls(corners[lo:hi], pad) for lo, hi in zip(starts[:-1], starts[1:], strict=True)]
        own = table.column("sheet_id").combine_chunks().take(pa.array(np.repeat(starts[:-1], [len(m) for m in made])))
        flat = np.concatenate(made)
        return pa.table([own, *(pa.array(flat[:, i]).cast(table.schema.field(c).type) for i, c in enumerate(_CORNERS))], names=["sheet_id", *_CORNERS])

    # what lacks a corner or a sheet touches nothing
    return by_group(rows.where(whole), ["sheet_id"], [], body, rows.schema).unionByName(rows.where(~whole))


_CORNERS = ("x0", "y0", "x1", "y1")
#: Boxes that are held against the others at once.
_AT_ONCE = 256


def _hulls(b: np.ndarray, pad: int) -> np.ndarray:
    """The hulls of one sheet's boxes: touching is asked of boxes by their left sides, a window at a time."""
    while True:
        b = b[np.argsort(b[:, 0], kind="stable")]
        root = list(range(len(b)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for lo in range(0, len(b), _AT_ONCE):
            some = b[lo : lo + _AT_ONCE]
            others = b[lo : np.searchsorted(b[:, 0], some[:, 2].max() + pad, "right")]
            p, q = some[:, None], others[None]
            meet = (p[..., 0] - pad <= q[..., 2]) & (q[..., 0] - pad <= p[..., 2]) & (p[..., 1] - pad <= q[..., 3]) & (q[..., 1] - pad <= p[..., 3])
            i, k = np.nonzero(meet)
            for x, y in zip((i[k > i] + lo).tolist(), (k[k > i] + lo).tolist(), strict=True):
                x, y = find(x), find(y)
                if x != y:
                    root[max(x, y)] = min(x, y)
        part = np.array([find(x) for x in range(len(b))], np.int64)
        if (part == np.arange(len(b))).all():
            return b
        order = np.argsort(part, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(part[order]) > 0])
        b = np.concatenate([np.minimum.reduceat(b[order][:, :2], first), np.maximum.reduceat(b[order][:, 2:], first)], 1)


def scale_score(candidates: DataFrame, least: float = 0.62) -> DataFrame:
    """(sheet_id, scale, score): for each scale the best candidate of each class, above the least score; the best scale is the greatest sum."""
    best = candidates.groupBy("sheet_id", "scale", "category").agg(F.max("score").alias("score"))
    return best.groupBy("sheet_id", "scale").agg(F.sum(F.col("score") - least + 0.05).alias("score"))


def layout_conflicts(boxes: DataFrame, segments: DataFrame) -> DataFrame:
    """(sheet_id, kind, a, b): boxes that overlap, and wires that run through a box."""
    side = lambda s: boxes.select("sheet_id", F.col("det_id").alias(f"{s}_id"), *(F.col(c).alias(f"{s}_{c}") for c in ("x0", "y0", "x1", "y1")))
    inner = lambda a, b: (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])
    over = spatial_join(side("a"), side("b"), ["sheet_id"], lambda: (F.col("a_id") < F.col("b_id")) & inner(box("a_"), box("b_")))
    wires = segments.select("sheet_id", F.col("segment_id").alias("a_id"), F.least("sx", "ex").alias("a_x0"), F.least("sy", "ey").alias("a_y0"), F.greatest("sx", "ex").alias("a_x1"), F.greatest("sy", "ey").alias("a_y1"))
    through = spatial_join(wires, side("b"), ["sheet_id"], lambda: (F.col("a_x0") < F.col("b_x1")) & (F.col("b_x0") < F.col("a_x1")) & (F.col("a_y0") < F.col("b_y1")) & (F.col("b_y0") < F.col("a_y1")))
    named = lambda df, kind: df.select("sheet_id", F.lit(kind).alias("kind"), F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return named(over, "overlap").unionByName(named(through, "wire_through_box"))


def without_repeats(points: Column) -> Column:
    """A path without points that equal the one before."""
    return F.filter(points, lambda x, i: (i == 0) | (x != F.get(points, i - 1)))
