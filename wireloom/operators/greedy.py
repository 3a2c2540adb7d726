"""Order-dependent folds inside a group, as one expression over the group's sorted rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.functions.geometry import area, intersection
from wireloom.operators.groups import by_group
from wireloom.operators.spatial import spatial_join
from wireloom.tables import shuffled


def greedy_leader(
    df: DataFrame, keys: list[str], order: list[Column], conflict: Callable[[Column, Column], Column], columns: list[str] | None = None
) -> DataFrame:
    """The rows of each group that conflict with no row kept before them.

    Rows are visited by ``order`` (a total one) ; ``conflict`` takes the structs
    of a kept row and of a new one.  A group is a sheet or a part of one.
    """
    columns = columns or [c for c in df.columns if c not in keys]
    row = F.struct(*(c.alias(f"_{i}") for i, c in enumerate(order)), *(F.col(c) for c in columns))
    items = F.sort_array(F.collect_list(row))
    kept = F.aggregate(
        "_items",
        F.filter("_items", lambda _: F.lit(False)),
        lambda acc, x: F.when(F.exists(acc, lambda k: conflict(k, x)), acc).otherwise(F.array_append(acc, x)),
    )
    out = df.groupBy(*keys).agg(items.alias("_items")).select(*keys, F.explode(kept).alias("_k"))
    return out.select(*keys, *(F.col(f"_k.{c}").alias(c) for c in columns))


def _box(s: Column) -> list[Column]:
    return [s["x0"], s["y0"], s["x1"], s["y1"]]


def suppress_any_class(detections: DataFrame, threshold: float = 0.45, key: str = "sheet_id") -> DataFrame:
    """The surest boxes of a sheet; a box goes when its IoU with a kept one reaches the threshold."""

    def clash(k: Column, x: Column) -> Column:
        shared = intersection(_box(k), _box(x))
        union = area(_box(k)) + area(_box(x)) - shared
        return (shared > 0) & (shared >= F.lit(threshold) * union)

    return greedy_leader(detections, [key], [-F.col("confidence"), F.col("det_id")], clash)


def suppress_per_class(detections: DataFrame, threshold: float = 0.5, inside: float = 0.8, key: str = "sheet_id") -> DataFrame:
    """As before among boxes of one class; a box also goes when most of the smaller one is shared (parts cut by tiles)."""

    def clash(k: Column, x: Column) -> Column:
        shared = intersection(_box(k), _box(x))
        union = area(_box(k)) + area(_box(x)) - shared
        return (shared > 0) & ((shared > F.lit(threshold) * union) | (shared > F.lit(inside) * F.least(area(_box(k)), area(_box(x)))))

    return greedy_leader(detections, [key, "category"], [-F.col("confidence"), F.col("det_id")], clash)


def drop_repeated_texts(texts: DataFrame, threshold: float = 0.5, key: str = "sheet_id") -> DataFrame:
    """Equal texts that tiles read twice: the surest of those that overlap stays."""

    def clash(k: Column, x: Column) -> Column:
        shared = intersection(_box(k), _box(x))
        return (shared > 0) & (shared >= F.lit(threshold) * (area(_box(k)) + area(_box(x)) - shared))

    return greedy_leader(texts, [key, "text"], [-F.col("confidence"), F.col("text_id")], clash)


def drop_contained_segments(segments: DataFrame, tolerance: int = 2, key: str = "sheet_id") -> DataFrame:
    """Segments from the longest down; one whose ends both lie by a kept segment goes."""
    dx, dy = F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy")
    rest = [c for c in segments.columns if c != key]

    def body(table, starts):
        ends = np.stack([table.column(c).to_numpy().astype(np.float64) for c in ("sx", "sy", "ex", "ey")], 1)
        return table.take(pa.array(np.concatenate([lo + _uncontained(ends[lo:hi], tolerance) for lo, hi in zip(starts[:-1], starts[1:], strict=True)])))

    return by_group(segments.select(key, *rest), [key], [-(dx * dx + dy * dy), F.col("segment_id"), *rest], body, segments.select(key, *rest).schema)


def _by(k: np.ndarray, px: np.ndarray, py: np.ndarray, tolerance: float) -> np.ndarray:
    """Whether points (down) lie by segments (across)."""
    sx, sy, ux, uy = k[:, 0], k[:, 1], k[:, 2] - k[:, 0], k[:, 3] - k[:, 1]
    size = ux * ux + uy * uy
    px, py = px[:, None], py[:, None]
    t = np.where(size == 0, 0.0, np.clip(((px - sx) * ux + (py - sy) * uy) / np.where(size == 0, 1.0, size), 0.0, 1.0))
    ox, oy = px - (sx + t * ux), py - (sy + t * uy)
    return ox * ox + oy * oy <= tolerance * tolerance


def _uncontained(ends: np.ndarray, tolerance: float) -> np.ndarray:
    """Which of a group's segments, in their order, lie by none kept before: a few new ones at a time, against all kept."""
    kept = np.zeros(0, np.int64)
    lo = 0
    while lo < len(ends):
        hi = min(len(ends), lo + max(1, min(256, (1 << 18) // max(1, len(kept)))))
        new = ends[lo:hi]
        inside = lambda k: _by(k, new[:, 0], new[:, 1], tolerance) & _by(k, new[:, 2], new[:, 3], tolerance)  # noqa: B023, E731
        stays = ~inside(ends[kept]).any(1)
        own = np.tril(inside(new), -1)
        for i in np.flatnonzero(own.any(1) & stays):
            stays[i] = not (own[i] & stays).any()
        kept = np.concatenate([kept, lo + np.flatnonzero(stays)])
        lo = hi
    return kept


def canonical_points(points: DataFrame, tolerance: float = 2.0, key: str = "sheet_id") -> DataFrame:
    """Each distinct point (x, y) beside the earliest representative within the tolerance: (x, y, cx, cy).

    Points go by x, then y.  One within the tolerance of no representative
    becomes one; the relation isn't transitive.
    """
    close = lambda k, x: (k["x"] - x["x"]) * (k["x"] - x["x"]) + (k["y"] - x["y"]) * (k["y"] - x["y"]) <= tolerance * tolerance
    distinct = points.select(key, "x", "y").distinct()
    # a point that is near no other stands for itself; only the others are folded
    side = lambda s: distinct.select(key, F.struct("x", "y").alias(f"{s}_id"), *(F.col(c[0]).alias(f"{s}_{c}") for c in ("x0", "y0", "x1", "y1")))
    near = lambda: (F.col("a_id") != F.col("b_id")) & close(F.col("a_id"), F.col("b_id"))
    crowded = spatial_join(side("a"), side("b"), [key], near, max(16, int(4 * tolerance)), tolerance).select(key, "a_id.x", "a_id.y").distinct()
    leaders = greedy_leader(crowded, [key], [F.col("x"), F.col("y")], close).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("_l"))
    first = F.element_at(F.filter("_l", lambda k: close(k, F.struct("x", "y"))), 1)
    moved = crowded.join(shuffled(leaders), key).select(key, "x", "y", first.alias("_c"))
    out = distinct.join(shuffled(moved), [key, "x", "y"], "left")
    return out.select(key, "x", "y", F.coalesce("_c.x", "x").alias("cx"), F.coalesce("_c.y", "y").alias("cy"))


def match_one_to_one(pairs: DataFrame, keys: list[str], order: list[Column], sides: list[str]) -> DataFrame:
    """Pairs from the best down; one goes when a value of any of ``sides`` is taken already."""

    def clash(k: Column, x: Column) -> Column:
        out = k[sides[0]] == x[sides[0]]
        for side in sides[1:]:
            out = out | (k[side] == x[side])
        return out

    return greedy_leader(pairs, keys, order, clash)
