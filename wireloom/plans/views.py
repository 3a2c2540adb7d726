"""Tables that pages and reports show: counts, bounds, graphs as nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.functions.geometry import floor_centre

#: Heights of a layered graph, by kind of component.
LAYERS = {"resistor": 50, "diode": 50, "relay": 50, "capacitor": 50, "ground": -30, "shield": -30}


def by_source(detections: DataFrame) -> DataFrame:
    """Detections by where their pins, or else they themselves, come from."""
    return detections.groupBy(F.coalesce("pins_source", "source", F.lit("?")).alias("origin")).agg(F.count("*").alias("n"))


def by_class(detections: DataFrame) -> DataFrame:
    return detections.groupBy("category").agg(F.count("*").alias("n"))


def class_stats(boxes: DataFrame) -> DataFrame:
    """Of each class of a training set: boxes, images, and the least and greatest width and height."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return boxes.groupBy("category").agg(
        F.count("*").alias("n"), F.count_distinct("sheet_id").alias("sheets"), F.min(w).alias("least_w"), F.max(w).alias("most_w"), F.min(h).alias("least_h"), F.max(h).alias("most_h")
    )


def bounds(boxes: DataFrame) -> DataFrame:
    """The box around all boxes of a sheet."""
    return boxes.groupBy("sheet_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def graph_nodes(components: DataFrame, pins: DataFrame) -> DataFrame:
    """(sheet_id, id, type, x, y): components at their centres, pins at their places as ``component:pin``."""
    c = components.select("sheet_id", F.col("component_id").alias("id"), F.lit("component").alias("type"), floor_centre(F.col("x0"), F.col("x1")).alias("x"), floor_centre(F.col("y0"), F.col("y1")).alias("y"))
    p = pins.select("sheet_id", F.concat_ws(":", "component_id", "pin_number").alias("id"), F.lit("pin").alias("type"), "x", "y")
    return c.unionByName(p).dropDuplicates(["sheet_id", "id"])


def pin_edges(pins: DataFrame) -> DataFrame:
    """(sheet_id, src, dst): from each component to its pins."""
    return pins.select("sheet_id", F.col("component_id").alias("src"), F.concat_ws(":", "component_id", "pin_number").alias("dst"), F.lit("has_pin").alias("type"))


def net_edges(connections: DataFrame) -> DataFrame:
    """(sheet_id, net_id, src, dst): all pairs of pins of a net (sheet_id, net_id, ref), the smaller name first.

    A picture's edges: nets are drawn, so their sizes are those of a sheet.
    """
    a, b = (connections.select("sheet_id", "net_id", F.col("ref").alias(c)).distinct() for c in ("src", "dst"))
    return a.join(b, ["sheet_id", "net_id"]).where(F.col("src") < F.col("dst"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each sheet: components, pins, wires, connections between pins."""
    of_nodes = nodes.groupBy("sheet_id").agg(*(F.count_if(F.col("type") == t).alias(f"{t}s") for t in ("component", "pin", "wire")))
    of_edges = edges.groupBy("sheet_id").agg(F.count_if(F.col("type") == "net").alias("connections"))
    return of_nodes.join(of_edges, "sheet_id", "left").withColumn("connections", F.coalesce("connections", F.lit(0).cast("long")))


def layer(kind: Column, x: Column, width: Column) -> Column:
    """The height of a component in a layered graph: connectors on two sides, symbols above, grounds below."""
    table = F.create_map(*(F.lit(v) for kv in LAYERS.items() for v in kv))
    sides = F.when(x < F.floor(width / 2), -20).otherwise(20)
    return F.when(kind == "connector", sides).otherwise(F.coalesce(table[kind], F.lit(30)))
