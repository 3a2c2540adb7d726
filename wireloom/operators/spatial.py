"""Joins of boxes and points by a grid: an equi-join on cells with the exact predicate on top, never a Cartesian product."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wireloom.functions.geometry import box
from wireloom.tables import shuffled


def _cells(df: DataFrame, side: str, cell: int, pad: float) -> DataFrame:
    x0, y0, x1, y1 = box(side)
    low = lambda c: F.floor((c - F.lit(pad)) / F.lit(cell))
    high = lambda c: F.floor((c + F.lit(pad)) / F.lit(cell))
    return (
        df.withColumns({f"_{side}cx": low(x0), f"_{side}cy": low(y0)})
        .withColumn("_cx", F.explode(F.sequence(low(x0), high(x1))))
        .withColumn("_cy", F.explode(F.sequence(low(y0), high(y1))))
    )


def spatial_join(
    a: DataFrame, b: DataFrame, keys: list[str], on: Callable[[], Column], cell: int = 64, pad: float = 0, how: str = "inner", b_pad: float = 0
) -> DataFrame:
    """Rows of ``a`` (box columns ``a_x0`` ...) and ``b`` (``b_x0`` ...) of equal ``keys`` whose padded boxes share a cell, and ``on`` holds.

    A pair is taken in the first cell that both boxes reach, so that nothing
    needs to be made distinct.  ``how``: inner, or left_semi / left_anti, which
    keep rows of ``a`` (they must be told apart by a column ``a_id``).
    """
    left, right = _cells(a, "a_", cell, pad), _cells(b, "b_", cell, b_pad)
    first = (F.col("_cx") == F.greatest("_a_cx", "_b_cx")) & (F.col("_cy") == F.greatest("_a_cy", "_b_cy"))
    pairs = left.join(shuffled(right), [*keys, "_cx", "_cy"]).where(first & on()).drop("_cx", "_cy", "_a_cx", "_a_cy", "_b_cx", "_b_cy")
    if how == "inner":
        return pairs
    return a.join(shuffled(pairs.select(*keys, "a_id").distinct()), [*keys, "a_id"], how)


def nearest(points: DataFrame, targets: DataFrame, keys: list[str], radius: float, k: int = 1, strict: bool = False) -> DataFrame:
    """The up to ``k`` targets (``b_id``, ``b_x``, ``b_y``) nearest to each point (``a_id``, ``a_x``, ``a_y``) within ``radius``.

    Columns of both, ``d2`` (squared distance) and ``nth`` from 1; of equally near targets the smaller id comes first.
    """
    as_box = lambda df, s: df.withColumns({f"{s}x0": F.col(f"{s}x"), f"{s}x1": F.col(f"{s}x"), f"{s}y0": F.col(f"{s}y"), f"{s}y1": F.col(f"{s}y")})
    dx, dy = F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")
    d2 = dx * dx + dy * dy
    limit = F.lit(radius * radius)
    # a point stands in one cell, and targets, of which there are fewer as a rule, in all from which they are reached
    pairs = spatial_join(
        as_box(points, "a_"), as_box(targets, "b_"), keys, lambda: (d2 < limit) if strict else (d2 <= limit), max(1, int(2 * radius)), b_pad=radius
    ).withColumn("d2", d2)
    order = Window.partitionBy(*keys, "a_id").orderBy("d2", "b_id")
    return (
        pairs.withColumn("nth", F.row_number().over(order))
        .where(F.col("nth") <= k)
        .drop(*(f"{s}{c}" for s in ("a_", "b_") for c in ("x0", "y0", "x1", "y1")))
    )
