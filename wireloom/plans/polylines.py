"""Polylines with fewer points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kept_points(x: np.ndarray, y: np.ndarray, most: float) -> np.ndarray:
    """Which points of a line stay so that no other lies farther than ``most`` from the line through its neighbours that stay.

    Ramer, Douglas and Peucker, with a stack of spans instead of recursion; of
    equally far points the first splits a span.
    """
    n = len(x)
    stay = np.zeros(n, bool)
    stay[[0, n - 1]] = True
    spans = [(0, n - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        dx, dy = float(x[b] - x[a]), float(y[b] - y[a])
        size = np.hypot(dx, dy)
        px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        d = np.abs(dy * px - dx * py) / size if size else np.hypot(px, py)
        k = int(d.argmax())
        if d[k] > most:
            stay[a + 1 + k] = True
            spans += [(a, a + 1 + k), (a + 1 + k, b)]
    return stay


def simplified(lines: DataFrame, points: str = "points", most: float = 2.0) -> DataFrame:
    """``lines`` with the points (x, y) of each that stay; lines of fewer than three points, and nulls, stay as they are."""

    @F.arrow_udf("array<struct<x:int,y:int>>")
    def shorter(column: pa.Array) -> pa.Array:
        out = []
        for line in column.to_pylist():
            if line is not None and len(line) > 2:
                stay = kept_points(np.array([p["x"] for p in line], np.int64), np.array([p["y"] for p in line], np.int64), most)
                line = [p for p, s in zip(line, stay.tolist(), strict=True) if s]
            out.append(line)
        return pa.array(out, pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())])))

    return lines.withColumn(points, shorter(F.col(points).cast("array<struct<x:int,y:int>>")))
