"""Every registered query against its SQL on the small driver tables; those without SQL run and keep their shape."""

import os

import pytest

from tests import oracle
from wireloom.queries import registered

SF = "/root/testdata/sf0.01"
QUERIES = registered()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.mark.parametrize("name", [n for n, (_, text) in QUERIES.items() if text])
def test_against_sql(spark, name):
    query, text = QUERIES[name]
    assert oracle.compare(spark, name, query, text, SF) > 0


@pytest.mark.parametrize("name", [n for n, (_, text) in QUERIES.items() if not text])
def test_runs(spark, name):
    assert QUERIES[name][0](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["iou_pairs", "knn_points", "text_association", "labels_in_box", "tile_visibility", "snap_endpoints"])
def test_no_cartesian_product(spark, name):
    plan = QUERIES[name][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
