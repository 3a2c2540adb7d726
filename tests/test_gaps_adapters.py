import numpy as np
import pytest

from wireloom.plans import gaps
from wireloom.plans import netlist as n
from wireloom.schema import PINS, SEGMENTS
from wireloom.sources import adapters

BOX = "x0 int, y0 int, x1 int, y1 int, confidence double, category string"


def joined(spark, strokes, boxes=None):
    grey = np.full((60, 200), 255, np.uint8)
    for x0, x1 in strokes:
        grey[19:21, x0:x1] = 0
    s = spark.createDataFrame([(1, 0, 10, 20, 80, 20, 1.0), (1, 1, 110, 20, 180, 20, 1.0)], SEGMENTS)
    nodes, edges = n.build_graph(s, spark.createDataFrame([], PINS))
    pictures = spark.createDataFrame([(1, 200, 60, grey.tobytes())], "sheet_id bigint, width int, height int, grey binary")
    found = gaps.supported_gaps(gaps.candidates(edges, boxes), pictures)
    nets = n.extract_nets(nodes, edges.unionByName(found, allowMissingColumns=True))
    return nets.count(), [(r.x0, r.x1) for r in found.collect()]


def test_a_stroke_closes_a_gap(spark):
    assert joined(spark, [(10, 181)]) == (1, [(80, 110)])


def test_no_ink_no_join(spark):
    assert joined(spark, [(10, 81), (110, 181)]) == (2, [])


def test_a_symbol_in_the_gap(spark):
    boxes = spark.createDataFrame([(1, 85, 10, 105, 30)], "sheet_id bigint, x0 int, y0 int, x1 int, y1 int")
    assert joined(spark, [(10, 181)], boxes) == (2, [])


@pytest.mark.parametrize(("a", "b"), [((0, 0), (1, 0)), ((-5, 0), (5, 0)), ((0, 0), (500, 0))])
def test_no_share_outside(a, b):
    assert gaps.ink_share(np.zeros((10, 10), np.uint8), a, b) == 0


def broken():
    raise ImportError("no such backend")


def test_ladder_of_backends(spark):
    pictures = spark.createDataFrame([(1, 0, bytearray(b"abc")), (1, 1, bytearray(b"xyz")), (2, 0, None)], "sheet_id bigint, tile_id bigint, content binary")
    keys = "sheet_id bigint, tile_id bigint"
    found = adapters.recognise(pictures, [broken, adapters.fake_detector], keys, BOX)
    assert found.count() == 3 and {r.category for r in found.collect()} <= {"resistor", "diode", "relay"}
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, adapters.recognise(pictures.repartition(3), [adapters.fake_detector], keys, BOX).collect()))
    assert adapters.recognise(pictures, [broken], keys, BOX).count() == 0
