"""Connected components of graphs of any diameter."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.tables import forgotten, shuffled, written


#: Nodes that a task of :func:`_contracted` holds at most before it hands on what it has.
HELD_NODES = 1 << 20


def _find(root: dict, x):
    """The root of a node, with the path to it shortened; a node that isn't there yet is its own."""
    top = x
    while (up := root.setdefault(top, top)) != top:
        top = up
    while root[x] != top:
        root[x], x = top, root[x]
    return top


def _once(batch: pa.RecordBatch):
    """The different edges of a batch."""
    pairs = pa.Table.from_batches([batch]).group_by(["u", "v"]).aggregate([])
    return zip(pairs.column("u").to_pylist(), pairs.column("v").to_pylist(), strict=True)


def _is_done(now: DataFrame) -> bool:
    """Whether different edges (u > v) are stars already: no node points at two, none that points is pointed at."""
    roles = now.select("u", F.lit(1).alias("n")).unionByName(now.groupBy("v").agg(F.lit(1).alias("n")).withColumnRenamed("v", "u"))
    return not roles.groupBy("u").agg(F.sum("n").alias("n")).where("n > 1").limit(1).count()


def _contracted(arcs: DataFrame) -> DataFrame:
    """Fewer edges (u, v) of the same components: each task joins what its own rows join, and points nodes at the least."""

    def run(batches):
        root: dict = {}

        def told():
            ends = [(x, _find(root, x)) for x in list(root)]
            pairs = [(x, top) for x, top in ends if x != top]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], kind) for k in (0, 1)], names=["u", "v"])

        kind = None
        for batch in batches:
            kind = batch.column("u").type
            for x, y in _once(batch):
                x, y = _find(root, x), _find(root, y)
                if x != y:
                    root[max(x, y)] = min(x, y)
            if len(root) > HELD_NODES:
                yield told()
                root.clear()
        if root:
            yield told()

    return arcs.mapInArrow(run, arcs.schema)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of all ends of the edges: the smallest node that edges reach.

    Tasks first contract what their own rows join.  Then large and small stars in
    turn (Kiveris and others, 2014): minima by node, which combine before the
    shuffle, and joins with these minima.  Each round is written, so that no plan
    grows; the loop ends when all edges are stars.
    What the tasks' own rows have settled costs no round.
    """
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    alone = ends.where("u = v").select("u", "v").distinct()
    now = written(_contracted(ends.where("u <> v")).distinct(), "edges")
    while not _is_done(now):
        arcs = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = arcs.groupBy("u").agg(F.min("v").alias("m"))
        large = arcs.where("v > u").join(shuffled(low), "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(shuffled(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        last, now = now, written(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        forgotten(last)
    roots = now.select(F.col("v").alias("u"), "v").distinct()
    known = now.unionByName(roots)
    return known.unionByName(alone.join(shuffled(known), "u", "left_anti")).select(F.col("u").alias("node"), F.col("v").alias("component"))


def local_components(edges: DataFrame, key: str = "sheet_id", a: str = "a", b: str = "b") -> DataFrame:
    """(key, node, component) as before, for edges (with string ends) that never leave their group: one shuffle, no rounds.

    A group is held in one task, so this is for groups of bounded size, such as sheets.
    """

    def join_ends(keys, group):
        root: dict = {}
        for x, y in zip(group.column("a").to_pylist(), group.column("b").to_pylist(), strict=True):
            x, y = _find(root, x), _find(root, y)
            if x != y:
                root[max(x, y)] = min(x, y)
        nodes = list(root)
        return pa.table({"key": pa.array([keys[0].as_py()] * len(nodes), pa.int64()), "node": nodes, "component": [_find(root, x) for x in nodes]})

    rows = edges.select(F.col(key).cast("bigint").alias("key"), F.col(a).alias("a"), F.col(b).alias("b"))
    out = rows.groupBy("key").applyInArrow(join_ends, "key bigint, node string, component string")
    return out.withColumnRenamed("key", key)
