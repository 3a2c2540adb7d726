"""Recognisers behind one protocol: a detector, a reader of texts or an encoder turns pictures into rows.

A backend is named by a factory that each Python worker calls once; it takes a
row's bytes and returns rows as dictionaries.  The first factory of a ladder
that works is used; where none does, there are no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

Backend = Callable[[bytes], list[dict]]
_made: dict[Callable[[], Backend], Backend | None] = {}


def _first(factories: Sequence[Callable[[], Backend]]) -> Backend | None:
    for f in factories:
        if f not in _made:
            try:
                _made[f] = f()
            except Exception:  # a missing library or model: the next one is tried
                _made[f] = None
        if _made[f] is not None:
            return _made[f]
    return None


def recognise(pictures: DataFrame, factories: Sequence[Callable[[], Backend]], keys: str, result: str, content: str = "content") -> DataFrame:
    """Rows (``keys`` and ``result``, both DDL) that a backend finds in each picture of ``pictures``."""
    names = [c.strip().split(" ")[0] for c in keys.split(",")]
    schema = pictures.sparkSession.createDataFrame([], f"{keys}, {result}").schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        backend = _first(factories)
        for batch in batches:
            out = [{**{k: row[k] for k in names}, **found} for row in batch.to_pylist() if backend for found in backend(row[content] or b"")]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return pictures.select(*names, content).mapInArrow(run, schema)


def fake_detector() -> Backend:
    """A stand-in that derives one box from a picture's digest; for tests and dry runs."""

    def run(data: bytes) -> list[dict]:
        d = hashlib.sha256(data).digest()
        return [{"x0": d[0], "y0": d[1], "x1": d[0] + 20, "y1": d[1] + 10, "confidence": d[2] / 255, "category": ("resistor", "diode", "relay")[d[3] % 3]}]

    return run
