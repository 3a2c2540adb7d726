"""Labels, pins and the components that carry them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wireloom.functions.geometry import box, floor_centre
from wireloom.operators.spatial import nearest, spatial_join


def label_segments(texts: DataFrame, segments: DataFrame, radius: float = 50.0) -> DataFrame:
    """(sheet_id, segment, text): texts go to the segment whose middle is nearest within the radius; of several the last one stays.

    Blank texts go; of equally near segments the smaller id is taken.
    """
    b = box()
    a = texts.where(F.col("text") != "").select("sheet_id", F.col("text_id").alias("a_id"), "text", floor_centre(b[0], b[2]).alias("a_x"), floor_centre(b[1], b[3]).alias("a_y"))
    middle = segments.select("sheet_id", F.col("segment_id").alias("b_id"), floor_centre(F.col("sx"), F.col("ex")).alias("b_x"), floor_centre(F.col("sy"), F.col("ey")).alias("b_y"))
    hits = nearest(a, middle, ["sheet_id"], radius)
    return hits.groupBy("sheet_id", F.concat(F.lit("segment_"), F.col("b_id").cast("string")).alias("segment")).agg(F.max_by("text", "a_id").alias("text"))


def nearest_label(points: DataFrame, labels: DataFrame, radius: float = 50.0, kinds: list[str] | None = None) -> DataFrame:
    """(sheet_id, a_id, b_id): the label (b_id, b_x, b_y, kind) nearest to each point (a_id, a_x, a_y).

    The nearest one is found first: if its kind isn't asked for, the point has none.
    """
    hits = nearest(points, labels, ["sheet_id"], radius)
    return (hits.where(F.col("kind").isin(kinds)) if kinds else hits).select("sheet_id", "a_id", "b_id")


def drop_repeated_pins(pins: DataFrame, order: str = "seq") -> DataFrame:
    """Of pins of one component with the same name and place the first stays."""
    keys = ["sheet_id", "component_id", "pin_number", "x", "y"]
    rest = [c for c in pins.columns if c not in keys]
    return pins.groupBy(*keys).agg(F.min(F.struct(order, *(c for c in rest if c != order))).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def set_default(notes: Column, key: str, value: Column) -> Column:
    """A map of notes with a key that isn't there yet set."""
    return F.when(F.map_contains_key(notes, key), notes).otherwise(F.map_concat(notes, F.create_map(F.lit(key), value)))


def first_open(components: DataFrame, named: Column, most: int = 40, order: str = "det_id") -> DataFrame:
    """The first components of a sheet that have no name, for a second look."""
    nth = F.row_number().over(Window.partitionBy("sheet_id").orderBy(order))
    return components.where(~named).withColumn("nth", nth).where(F.col("nth") <= most)


def number_by_kind(detections: DataFrame, connectors: list[str], parts: list[str]) -> DataFrame:
    """sheet_id, det_id, id and designator: connectors first, as ``X`` and their number; the others by two letters of their class.

    ``parts`` are classes that belong to connectors and get no number.
    """
    own = detections.where(~F.col("category").isin(parts)).withColumn("other", (~F.col("category").isin(connectors)).cast("int"))
    n = F.row_number().over(Window.partitionBy("sheet_id").orderBy("other", "det_id"))
    letters = F.when(F.col("other") == 0, "X").otherwise(F.upper(F.substring("category", 1, 2)))
    return own.withColumn("n", n).select("sheet_id", "det_id", F.format_string("comp_%03d", "n").alias("id"), F.concat(letters, F.col("n").cast("string")).alias("designator"))


def nodes_by_point(nodes: DataFrame) -> DataFrame:
    """(sheet_id, x, y, nodes): the sorted ids of the nodes at each place."""
    return nodes.groupBy("sheet_id", "x", "y").agg(F.sort_array(F.collect_set("node_id")).alias("nodes"))


def facing_pins(pins: DataFrame, boxes: DataFrame, align: float = 5.0, longest: float = 120.0) -> DataFrame:
    """Pairs of pins of two components that look at each other along one axis with no other component between.

    ``pins``: sheet_id, pin_id, comp_id, x, y and the direction (dx, dy) they
    leave their component in.  ``boxes``: sheet_id, comp_id and a box, without
    those that wires may cross.  (sheet_id, a_id, b_id, length).  Whether ink joins
    them is for a recogniser to say.
    """
    out = None
    for along, across in (("x", "y"), ("y", "x")):
        start = pins.where(F.col(f"d{along}") == 1).select(
            "sheet_id", F.col("pin_id").alias("a_id"), F.col("comp_id").alias("a_comp"), F.col("x").alias("a_px"), F.col("y").alias("a_py"),
            F.col(along).alias(f"a_{along}0"), (F.col(along) + F.lit(int(longest))).alias(f"a_{along}1"),
            (F.col(across) - F.lit(int(align))).alias(f"a_{across}0"), (F.col(across) + F.lit(int(align))).alias(f"a_{across}1"),
        )
        end = pins.where(F.col(f"d{along}") == -1).select(
            "sheet_id", F.col("pin_id").alias("b_id"), F.col("comp_id").alias("b_comp"), F.col("x").alias("b_px"), F.col("y").alias("b_py"),
            *(F.col(c[0]).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")),
        )
        length = F.col(f"b_p{along}") - F.col(f"a_p{along}")
        apart = F.abs(F.col(f"b_p{across}") - F.col(f"a_p{across}"))
        on = lambda n=length, d=apart: (F.col("a_comp") != F.col("b_comp")) & n.between(2, longest) & (d <= align)
        pairs = spatial_join(start, end, ["sheet_id"], on, 64).select("sheet_id", "a_id", "b_id", "a_comp", "b_comp", "a_px", "a_py", "b_px", "b_py", length.alias("length"))
        out = pairs if out is None else out.unionByName(pairs)
    way = out.select(
        "sheet_id", F.struct("a_id", "b_id").alias("a_id"), "a_comp", "b_comp",
        F.least("a_px", "b_px").alias("a_x0"), F.least("a_py", "b_py").alias("a_y0"), F.greatest("a_px", "b_px").alias("a_x1"), F.greatest("a_py", "b_py").alias("a_y1"),
    )
    # a box counts without its outermost pixels, and the way is a pixel wider across
    shrunk = boxes.select("sheet_id", F.col("comp_id").alias("b_other"), (F.col("x0") + 1).alias("b_x0"), (F.col("y0") + 1).alias("b_y0"), (F.col("x1") - 1).alias("b_x1"), (F.col("y1") - 1).alias("b_y1"))
    between = lambda: (F.col("b_other") != F.col("a_comp")) & (F.col("b_other") != F.col("b_comp")) & (F.col("b_x0") < F.col("a_x1")) & (F.col("a_x0") < F.col("b_x1")) & (F.col("b_y0") < F.col("a_y1") + 1) & (F.col("a_y0") - 1 < F.col("b_y1"))
    free = spatial_join(way, shrunk.where("b_x0 <= b_x1 and b_y0 <= b_y1"), ["sheet_id"], between, 64, 1, "left_anti")
    return out.join(free.select("sheet_id", "a_id.a_id", "a_id.b_id"), ["sheet_id", "a_id", "b_id"], "left_semi").select("sheet_id", "a_id", "b_id", "length")


def side_neighbours(stack: DataFrame, cells: DataFrame, tolerance: int = 3, gap: int = 5, upright: bool = True) -> DataFrame:
    """(sheet_id, a_id, b_id): cells in the same row as a cell of a stack that touch it sideways; members of the stack don't count."""
    side = lambda df, s: df.select("sheet_id", F.col("cell_id").alias(f"{s}_id"), *(F.col(c).alias(f"{s}_{c}") for c in ("x0", "y0", "x1", "y1")))
    along, across = ("x", "y") if upright else ("y", "x")
    others = cells.join(stack.select("sheet_id", "cell_id"), ["sheet_id", "cell_id"], "left_anti")
    c = F.col

    def on() -> Column:
        row = (F.abs(c(f"a_{across}0") - c(f"b_{across}0")) <= tolerance) & (F.abs(c(f"a_{across}1") - c(f"b_{across}1")) <= tolerance)
        return row & ((c(f"b_{along}0") - c(f"a_{along}1")).between(0, gap) | (c(f"a_{along}0") - c(f"b_{along}1")).between(0, gap))

    return spatial_join(side(stack, "a"), side(others, "b"), ["sheet_id"], on, 64, max(gap, tolerance)).select("sheet_id", "a_id", "b_id")
