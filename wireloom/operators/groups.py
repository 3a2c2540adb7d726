"""Groups of rows, such as sheets, handed whole to Arrow functions: many at a time, as a call for each small group costs more than its work."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame


def _changes(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Where a row's keys differ from those of the row before (null equals null); from 1 on."""
    out = np.zeros(max(0, table.num_rows - 1), bool)
    for key in keys:
        c = table.column(key).combine_chunks()
        here, before = c.slice(1), c.slice(0, max(0, len(c) - 1))
        gone = pc.is_null(here).to_numpy(zero_copy_only=False) != pc.is_null(before).to_numpy(zero_copy_only=False)
        out |= gone | pc.fill_null(pc.not_equal(here, before), False).to_numpy(zero_copy_only=False)
    return np.flatnonzero(out) + 1


def by_group(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], body: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """What ``body`` makes of a table of whole groups, each sorted by ``order``, and of the groups' first rows (and the end).

    One shuffle by ``keys``. A task holds the rows of a batch and of the group
    at its end, so that a group should be of bounded size.
    """

    def run(batches):
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            cuts = _changes(table, keys)
            if not len(cuts) and (not held or not len(_changes(pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), table.slice(0, 1)]), keys))):
                held.append(table)
                continue
            last = int(cuts[-1]) if len(cuts) else 0
            yield from told([*held, table.slice(0, last)])
            held = [table.slice(last)]
        yield from told(held)

    def told(parts):
        table = pa.concat_tables(parts) if parts else None
        if table is not None and table.num_rows:
            yield from body(table, np.r_[0, _changes(table, keys), table.num_rows]).combine_chunks().to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
