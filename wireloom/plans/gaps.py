"""Gaps between wire ends that the picture closes.

Which ends may be joined is relational: leaves of the graph, aligned, facing
each other, with no symbol between.  Only the ink between them is looked up in
the picture, one sheet at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.operators.components import local_components
from wireloom.operators.spatial import spatial_join

#: Grey value below which a pixel is ink, and the share of a gap that must have some.
INK, SHARE = 160, 0.9


def ink_share(grey: np.ndarray, a: tuple[int, int], b: tuple[int, int]) -> float:
    """Share of the pixels strictly between two points that have ink in the 3 x 3 around them; 0 where the line leaves the picture."""
    n = max(abs(b[0] - a[0]), abs(b[1] - a[1]))
    if n < 2:
        return 0.0
    t = np.arange(1, n) / n
    x, y = np.rint(a[0] + t * (b[0] - a[0])).astype(int), np.rint(a[1] + t * (b[1] - a[1])).astype(int)
    height, width = grey.shape
    if ((x < 0) | (x >= width) | (y < 0) | (y >= height)).any():
        return 0.0
    dark = np.pad(grey < INK, 1)
    near = np.zeros(len(x), bool)
    for dy in range(3):
        for dx in range(3):
            near |= dark[y + dy, x + dx]
    return float(near.mean())


def candidates(edges: DataFrame, boxes: DataFrame | None = None, most: int = 60, tolerance: float = 4.0) -> DataFrame:
    """Pairs of wire leaves (a before b along their axis) that a straight stroke could join, with their parts and distance."""
    wires = edges.where("kind = 'wire'")
    ends = wires.select("sheet_id", F.explode(F.array(
        F.struct(F.col("src").alias("n"), F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("x1").alias("nx"), F.col("y1").alias("ny")),
        F.struct(F.col("dst").alias("n"), F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("x0").alias("nx"), F.col("y0").alias("ny")),
    )).alias("e")).select("sheet_id", "e.*")
    pinned = edges.where("kind = 'pin'").select("sheet_id", F.col("dst").alias("n"))
    leaves = ends.groupBy("sheet_id", "n").agg(F.count("*").alias("d"), *(F.first(c).alias(c) for c in ("x", "y", "nx", "ny"))).where("d = 1").join(pinned, ["sheet_id", "n"], "left_anti")
    parts = local_components(edges, "sheet_id", "src", "dst").withColumnRenamed("node", "n")
    leaves = leaves.join(parts, ["sheet_id", "n"])
    side = lambda s: leaves.select("sheet_id", *(F.col(c).alias(f"{s}_{k}") for k, c in (("id", "n"), ("part", "component"), ("x", "x"), ("y", "y"), ("nx", "nx"), ("ny", "ny"), ("x0", "x"), ("y0", "y"), ("x1", "x"), ("y1", "y"))))
    dx, dy = F.col("b_x") - F.col("a_x"), F.col("b_y") - F.col("a_y")
    across = (dx >= 3) & (F.abs(dy) <= tolerance) & (F.abs(F.col("a_y") - F.col("a_ny")) <= 2) & (F.abs(F.col("b_y") - F.col("b_ny")) <= 2) & (F.col("a_nx") < F.col("a_x")) & (F.col("b_nx") > F.col("b_x"))
    down = (dy >= 3) & (F.abs(dx) <= tolerance) & (F.abs(F.col("a_x") - F.col("a_nx")) <= 2) & (F.abs(F.col("b_x") - F.col("b_nx")) <= 2) & (F.col("a_ny") < F.col("a_y")) & (F.col("b_ny") > F.col("b_y"))
    on = lambda: (F.col("a_part") != F.col("b_part")) & (dx * dx + dy * dy <= most * most) & (across | down)
    pairs = spatial_join(side("a"), side("b"), ["sheet_id"], on, max(8, most), most).select("sheet_id", "a_id", "b_id", "a_part", "b_part", "a_x", "a_y", "b_x", "b_y", (dx * dx + dy * dy).alias("d2"))
    if boxes is None:
        return pairs
    stroke = pairs.withColumns({"a_key": F.struct("a_id", "b_id"), "a_x0": F.least("a_x", "b_x"), "a_y0": F.least("a_y", "b_y"), "a_x1": F.greatest("a_x", "b_x"), "a_y1": F.greatest("a_y", "b_y")})
    b = boxes.select("sheet_id", *(F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")))
    a = stroke.select("sheet_id", F.col("a_key").alias("a_id"), "a_x0", "a_y0", "a_x1", "a_y1")
    inside = lambda: (F.col("b_x0") + 1 < F.col("a_x1")) & (F.col("a_x0") < F.col("b_x1") - 1) & (F.col("b_y0") + 1 < F.col("a_y1") + 1) & (F.col("a_y0") - 1 < F.col("b_y1") - 1)
    free = spatial_join(a, b, ["sheet_id"], inside, 64, 1, "left_anti").select("sheet_id", "a_id.*")
    return pairs.join(free, ["sheet_id", "a_id", "b_id"], "left_semi")


def supported_gaps(pairs: DataFrame, pictures: DataFrame) -> DataFrame:
    """Edges (sheet_id, src, dst, kind, x0, y0, x1, y1) for the gaps with ink, nearest first, each joining two parts that weren't joined yet.

    ``pictures``: sheet_id, width, height and ``grey``, a byte for each pixel.
    """

    def one_sheet(gaps, picture):
        schema = pa.schema([("sheet_id", pa.int64()), ("src", pa.string()), ("dst", pa.string()), ("kind", pa.string()), ("x0", pa.int32()), ("y0", pa.int32()), ("x1", pa.int32()), ("y1", pa.int32())])
        rows = sorted(gaps.to_pylist(), key=lambda r: (r["d2"], r["a_id"], r["b_id"])) if picture.num_rows else []
        if not rows:
            return schema.empty_table()
        p = picture.slice(0, 1).to_pylist()[0]
        grey = np.frombuffer(p["grey"], np.uint8).reshape(p["height"], p["width"])
        root: dict[str, str] = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        out = []
        for r in rows:
            a, b = find(r["a_part"]), find(r["b_part"])
            if a != b and ink_share(grey, (r["a_x"], r["a_y"]), (r["b_x"], r["b_y"])) >= SHARE:
                root[a] = b
                out.append((r["sheet_id"], r["a_id"], r["b_id"], "wire", r["a_x"], r["a_y"], r["b_x"], r["b_y"]))
        return pa.Table.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(schema.types)], schema=schema)

    return pairs.groupBy("sheet_id").cogroup(pictures.select("sheet_id", "width", "height", "grey").groupBy("sheet_id")).applyInArrow(
        one_sheet, "sheet_id bigint, src string, dst string, kind string, x0 int, y0 int, x1 int, y1 int"
    )
