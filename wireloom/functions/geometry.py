"""Column builders for boxes (x0, y0, x1, y1), points and segments; all of them built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = Sequence[Column]


def box(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")]


def floor_centre(a: Column, b: Column) -> Column:
    """Centre as pixels count it: halves go down, for negative sums too."""
    return F.floor((a + b) / 2).cast("int")


def centre(a: Column, b: Column) -> Column:
    return (a + b) / F.lit(2.0)


def area(b: Box) -> Column:
    return (b[2] - b[0]).cast("long") * (b[3] - b[1])


def overlap_sides(a: Box, b: Box) -> tuple[Column, Column]:
    return F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.least(a[3], b[3]) - F.greatest(a[1], b[1])


def intersection(a: Box, b: Box) -> Column:
    w, h = overlap_sides(a, b)
    return F.greatest(w, F.lit(0)).cast("long") * F.greatest(h, F.lit(0))


def iou(a: Box, b: Box) -> Column:
    shared = intersection(a, b)
    union = area(a) + area(b) - shared
    return F.when((shared > 0) & (union > 0), shared / union).otherwise(F.lit(0.0))


def overlap_of_smaller(a: Box, b: Box) -> Column:
    smaller = F.least(area(a), area(b))
    return F.when(smaller > 0, intersection(a, b) / smaller).otherwise(F.lit(0.0))


def touches(a: Box, b: Box, pad: int = 0) -> Column:
    """Whether padded boxes meet; edges that touch count."""
    return (a[0] - pad <= b[2]) & (b[0] - pad <= a[2]) & (a[1] - pad <= b[3]) & (b[1] - pad <= a[3])


def distance_to_box(x: Column, y: Column, b: Box) -> Column:
    dx = F.greatest(b[0] - x, F.lit(0), x - b[2])
    dy = F.greatest(b[1] - y, F.lit(0), y - b[3])
    return F.sqrt(dx * dx + dy * dy)


def projection(px: Column, py: Column, sx: Column, sy: Column, ex: Column, ey: Column) -> tuple[Column, Column, Column, Column]:
    """Of a point on a finite segment: place in [0, 1], rounded foot, distance to the foot before rounding."""
    dx, dy = ex - sx, ey - sy
    size = dx * dx + dy * dy
    t = F.when(size == 0, F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - sx) * dx + (py - sy) * dy) / F.nullif(size, F.lit(0))))
    )
    fx, fy = sx + t * dx, sy + t * dy
    return t, F.bround(fx).cast("int"), F.bround(fy).cast("int"), F.hypot(px - fx, py - fy)


def segment_facts(sx: Column, sy: Column, ex: Column, ey: Column) -> dict[str, Column]:
    dx, dy = F.abs(ex - sx), F.abs(ey - sy)
    return {
        "length": F.sqrt((dx * dx + dy * dy).cast("double")),
        "is_horizontal": (dx > dy) & (dy < 5),
        "is_vertical": (dy > dx) & (dx < 5),
        "mid_x": F.floor((sx + ex) / 2).cast("int"),
        "mid_y": F.floor((sy + ey) / 2).cast("int"),
    }


def perpendicular(ax: Column, ay: Column, bx: Column, by: Column, most: float = 0.2) -> Column:
    """Whether two direction vectors stand on each other, by the cosine between them; never where one has no length."""
    dot, lengths = F.abs(ax * bx + ay * by), F.hypot(ax, ay) * F.hypot(bx, by)
    return (lengths > 0) & (dot <= most * lengths)


def turned(x: Column, y: Column, w: Column, h: Column, rotation: Column, mirrored: Column) -> tuple[Column, Column]:
    """A point of a w x h window after mirroring left to right and quarter turns counter-clockwise."""
    x = F.when(mirrored, w - x).otherwise(x)
    quarter = F.pmod(rotation, F.lit(360))
    return (
        F.when(quarter == 90, y).when(quarter == 180, w - x).when(quarter == 270, h - y).otherwise(x),
        F.when(quarter == 90, w - x).when(quarter == 180, h - y).when(quarter == 270, x).otherwise(y),
    )


def nearest_edge(x: Column, y: Column, b: Box, reach: int = 1) -> Column:
    """left, right, top or bottom for a point within ``reach`` of an edge; of equal ones the first named."""
    sides = F.array(
        F.struct(F.abs(x - b[0]).alias("d"), F.lit(0).alias("at"), F.lit("left").alias("edge")),
        F.struct(F.abs(x - b[2]).alias("d"), F.lit(1).alias("at"), F.lit("right").alias("edge")),
        F.struct(F.abs(y - b[1]).alias("d"), F.lit(2).alias("at"), F.lit("top").alias("edge")),
        F.struct(F.abs(y - b[3]).alias("d"), F.lit(3).alias("at"), F.lit("bottom").alias("edge")),
    )
    best = F.array_min(sides)
    return F.when(best["d"] <= reach, best["edge"])


def pin_in_box(x_mm: Column, y_mm: Column, w_mm: Column, h_mm: Column, b: Box) -> tuple[Column, Column]:
    """Pixel place of a symbol's pin, for the symbol drawn into a box."""
    return (
        F.bround(b[0] + x_mm / w_mm * (b[2] - b[0])).cast("int"),
        F.bround(b[1] + y_mm / h_mm * (b[3] - b[1])).cast("int"),
    )


def snap_tolerances(stroke: Column, snap: Column, junction: Column) -> tuple[Column, Column]:
    """Tolerances that grow with the stroke width."""
    return snap + F.bround(F.greatest(F.lit(0.0), 2 * (stroke - 2.5))), F.greatest(junction, 1.5 * stroke)


def template_score(ncc: Column, covered: Column, extra: Column, free_pins: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.4 * ncc + 0.6 * covered - 0.6 * extra - 0.12 * free_pins))


def segments_touch(a: Sequence[Column], b: Sequence[Column], tolerance: float = 5.0) -> Column:
    """Whether an end of segment ``b`` (sx, sy, ex, ey) lies nearer than the tolerance to segment ``a``."""
    near = [projection(b[k], b[k + 1], *a)[3] < tolerance for k in (0, 2)]
    return near[0] | near[1]


def moved_point(x: Column, y: Column, m: Sequence[float]) -> tuple[Column, Column]:
    """A point after the affine map (m0 m1 m2 / m3 m4 m5), rounded."""
    return F.rint(m[0] * x + m[1] * y + m[2]).cast("int"), F.rint(m[3] * x + m[4] * y + m[5]).cast("int")


def moved_box(b: Box, m: Sequence[float]) -> list[Column]:
    """The box around the moved corners of a box."""
    corners = [moved_point(b[i], b[j], m) for i in (0, 2) for j in (1, 3)]
    xs, ys = zip(*corners, strict=True)
    return [F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)]


def fallback_pin(x_mm: Column, y_mm: Column, w_mm: Column, h_mm: Column, b: Box) -> tuple[Column, Column, Column]:
    """Place of a symbol's pin and the symbol's rotation (0 or 90), by the box alone: upright boxes of lying symbols mean a quarter turn."""
    w, h = b[2] - b[0], b[3] - b[1]
    turn = (h > w) != (h_mm > w_mm)
    fx, fy = x_mm / w_mm, y_mm / h_mm
    x, y = F.when(turn, fy).otherwise(fx), F.when(turn, 1.0 - fx).otherwise(fy)
    return F.rint(b[0] + x * w).cast("int"), F.rint(b[1] + y * h).cast("int"), F.when(turn, 90).otherwise(0)


def scale_range(stroke: Column) -> tuple[Column, Column]:
    """Least and greatest pixels per millimetre that a stroke of this width allows."""
    return F.greatest(F.lit(1.5), stroke / 1.2), F.least(F.lit(40.0), F.greatest(F.lit(3.0), stroke / 0.15))
