"""Small given cases of single operators."""

import pytest
from pyspark.sql import functions as F

from wireloom.functions import geometry as g
from wireloom.functions import text as t
from wireloom.functions import vectors as v
from wireloom.operators import greedy, knn, tiling
from wireloom.operators.components import components
from wireloom.plans import components as plan
from wireloom.plans import datasets, evaluate, feedback, manifest, registry
from wireloom.schema import DETECTIONS, TEXTS, class_prefixes, symbol_pins, symbols


def boxes(spark, *rows):
    return spark.createDataFrame([(1, i, None, *r[:4], r[4], r[5] if len(r) > 5 else "x", "model") for i, r in enumerate(rows)], DETECTIONS)


def test_suppression_of_any_class(spark):
    d = boxes(spark, (10, 10, 50, 50, 0.9), (15, 15, 55, 55, 0.8), (100, 100, 150, 150, 0.85))
    assert {r.det_id for r in greedy.suppress_any_class(d, 0.5).collect()} == {0, 2}


def test_suppression_per_class(spark):
    d = boxes(spark, (100, 100, 200, 140, 0.9, "resistor"), (102, 101, 199, 141, 0.8, "resistor"), (150, 100, 200, 140, 0.7, "resistor"), (100, 100, 200, 140, 0.6, "fuse"))
    assert {(r.category, r.confidence) for r in greedy.suppress_per_class(d).collect()} == {("resistor", 0.9), ("fuse", 0.6)}


def test_repeated_texts(spark):
    rows = [("R1", 4000, 100, 4096, 130, 0.9), ("R1", 4005, 101, 4098, 131, 0.7), ("R1", 100, 100, 140, 130, 0.8), ("C2", 4000, 100, 4096, 130, 0.5)]
    d = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], TEXTS)
    assert {(r.text, r.confidence) for r in greedy.drop_repeated_texts(d).collect()} == {("R1", 0.9), ("R1", 0.8), ("C2", 0.5)}


def test_empty_groups(spark):
    assert greedy.suppress_any_class(boxes(spark, (0, 0, 1, 1, 0.5)).limit(0)).count() == 0


@pytest.mark.parametrize(("w", "h", "tile", "overlap", "n"), [(800, 600, 1024, 0.2, 1), (5000, 1000, 4096, 0.12, 2), (2560, 1815, 2560, 0.12, 1)])
def test_tile_counts(spark, w, h, tile, overlap, n):
    assert tiling.tile_grid(spark.createDataFrame([(1, w, h)], "sheet_id int, width int, height int"), tile, overlap).count() == n


def test_tiles_cover_the_sheet(spark):
    tiles = tiling.tile_grid(spark.createDataFrame([(1, 2500, 1300)], "sheet_id int, width int, height int")).orderBy("tile_id").collect()
    assert (tiles[0].x0, tiles[0].y0, tiles[0].x1, tiles[0].y1) == (0, 0, 1024, 1024)
    assert max(r.x1 for r in tiles) == 2500 and max(r.y1 for r in tiles) == 1300
    assert all(r.x1 - r.x0 <= 1024 and r.y1 - r.y0 <= 1024 for r in tiles)


def test_tile_to_sheet(spark):
    tiles = spark.createDataFrame([(1, 7, 100, 100)], "sheet_id int, tile_id int, x0 int, y0 int")
    d = spark.createDataFrame([(1, 7, 10, 10, 50, 50), (1, 8, 0, 0, 1, 1)], "sheet_id int, tile_id int, x0 int, y0 int, x1 int, y1 int")
    (r,) = tiling.to_sheet(d, tiles, ["sheet_id", "tile_id"]).collect()
    assert (r.x0, r.y0, r.x1, r.y1) == (110, 110, 150, 150)


@pytest.mark.parametrize(
    ("raw", "name"),
    [("R1", "R1"), ("VD1", "VD1"), ("K1.1", "K1.1"), ("K1,1", "K1.1"), ("К1.1", "K1.1"), ("Х1", "X1"), ("С1", "C1"), ("ЕL2", "EL2"), ("R l", "R1"), ("RO", None), ("HL1", "HL1"), ("FUl", "FU1"), ("SA 1", "SA1"), ("GB1", "GB1"), ("XP12", "XP12"), ("1000", None), ("HOUSE", None), ("", None), ("12V", None), ("QQQ1", None)],
)
def test_designators(spark, raw, name):
    assert spark.createDataFrame([(raw,)], "t string").select(t.normalize_designator(F.col("t")).alias("n")).first().n == name


@pytest.mark.parametrize(("raw", "kind"), [("X1", "connector"), ("1", "pin"), ("+27В", "voltage"), ("БПВЛ-0.35", "wire_type"), ("VD1", "designator"), ("", "other")])
def test_text_kinds(spark, raw, kind):
    assert spark.createDataFrame([(raw,)], "t string").select(t.classify_text(F.col("t")).alias("k")).first().k == kind


@pytest.mark.parametrize(("raw", "name"), [("x1", "Х1"), (" X2 ", "Х2"), ("bpvl-0.35", "bpvl-0.35"), ("МГТФ 0.5", "МГТФ0.5")])
def test_designations(spark, raw, name):
    assert spark.createDataFrame([(raw,)], "t string").select(t.normalize_designation(F.col("t")).alias("n")).first().n == name


def test_designators_of_components(spark):
    c = spark.createDataFrame([(1, 0, "switch_no", 100, 100, 180, 136), (1, 1, "lamp", 300, 100, 348, 184), (1, 2, "resistor", 500, 100, 596, 124)], "sheet_id int, comp_id int, category string, x0 int, y0 int, x1 int, y1 int")
    at = lambda i, s, x, y: (1, i, s, x - 15, y - 7, x + 15, y + 7, 0.9)
    texts = spark.createDataFrame([at(0, "K1.1", 140, 87), at(1, "EL1", 270, 142), at(2, "R1", 915, 407), at(3, "C5", 535, 87)], TEXTS)
    got = {r.comp_id: r.designator for r in plan.assign_designators(c, texts, class_prefixes(spark)).collect()}
    assert got == {0: "K1.1", 1: "EL1"}


def test_one_name_once(spark):
    c = spark.createDataFrame([(1, 0, "resistor", 0, 0, 60, 20), (1, 1, "resistor", 0, 100, 60, 120)], "sheet_id int, comp_id int, category string, x0 int, y0 int, x1 int, y1 int")
    texts = spark.createDataFrame([(1, 0, "R1", 10, -18, 40, -4, 0.9), (1, 1, "R1", 10, 82, 40, 96, 0.9)], TEXTS)
    assert plan.assign_designators(c, texts, class_prefixes(spark)).count() == 1


def test_components_of_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100), (201, 200), (202, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert {got[i] for i in range(41)} == {0} and got[100] == 100 and got[202] == got[200] == 200
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_nearest_vectors(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0], 0), (2, [0.9, 0.1, 0.0, 0.0], 0), (3, [0.0, 1.0, 0.0, 0.0], 1), (4, [0.0, 0.0, 0.0, 0.0], 1)], "vec_id bigint, embedding array<float>, label int")
    hits = knn.search(e, e.where("vec_id = 1"), 2).orderBy("rank").collect()
    assert [r.neighbour for r in hits] == [2, 3] and hits[0].score > 0.9
    assert knn.vote(knn.search(e, e.where("vec_id = 1"), 2), e).first().label == 0


def test_vector_functions(spark):
    r = spark.range(1).select(v.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))).alias("zero"), v.norm(v.blend(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)))).alias("one")).first()
    assert r.zero == 0 and abs(r.one - 1) < 1e-9


def test_turned_points(spark):
    r = spark.range(1).select(*(F.struct(*g.turned(F.lit(1), F.lit(2), F.lit(10), F.lit(20), F.lit(a), F.lit(m))).alias(f"r{a}{int(m)}") for a, m in ((0, False), (90, False), (180, False), (270, False), (0, True)))).first()
    assert [tuple(x) for x in r] == [(1, 2), (2, 9), (9, 18), (18, 1), (9, 2)]


def test_pins_of_symbols(spark):
    s = symbols(spark).join(symbol_pins(spark), "class_name").where("class_name = 'resistor'")
    b = [F.lit(x) for x in (100, 50, 260, 90)]
    got = {r.pin: tuple(r.p) for r in s.select("pin", F.struct(*g.pin_in_box(F.col("x_mm"), F.col("y_mm"), F.col("width_mm"), F.col("height_mm"), b)).alias("p")).collect()}
    assert got == {"1": (100, 70), "2": (260, 70)} and symbols(spark).count() == 33


def test_registry_lifecycle(spark):
    log = lambda *e: spark.createDataFrame([(i, *x) for i, x in enumerate(e)], registry.EVENTS)
    got = lambda df: {r.version_id: r.status for r in registry.states(df).collect()}
    assert got(log(("register", "a"), ("register", "b"))) == {"a": "current", "b": "candidate"}
    assert got(log(("register", "a"), ("register", "b"), ("promote", "b"))) == {"a": "retired", "b": "current"}
    assert got(log(("register", "a"), ("register", "b"), ("start_ab", "b"))) == {"a": "current", "b": "challenger"}
    assert got(log(("register", "a"), ("register", "b"), ("start_ab", "b"), ("stop_ab", "b"))) == {"a": "current", "b": "retired"}
    assert got(log(("register", "a"), ("register", "b"), ("reject", "b"))) == {"a": "current", "b": "rejected"}
    back = registry.states(log(("register", "a"), ("register", "b"), ("promote", "b")))
    assert registry.rollback_target(back).first().version_id == "a"
    assert registry.next_version(2, {"v000003"}) == "v000004"


def test_routing(spark):
    keys = spark.range(200).select(F.col("id").cast("string").alias("k"))
    assert {r.version_id for r in feedback.route(keys, "k", "a", "b", 1.0).collect()} == {"b"}
    assert {r.version_id for r in feedback.route(keys, "k", "a", None, 1.0).collect()} == {"a"}
    share = feedback.route(keys, "k", "a", "b", 0.5).where("version_id = 'b'").count()
    assert 70 < share < 130


def test_label_line_and_oversampling(spark):
    line = spark.range(1).select(datasets.label_line(F.lit(0), [F.lit(x) for x in (100, 100, 200, 200)], F.lit(1000), F.lit(1000)).alias("l")).first().l
    assert line == "0 0.150000 0.150000 0.100000 0.100000"
    one = spark.createDataFrame([("a",)], "stem string")
    assert [r.stem for r in datasets.oversample(one, F.lit(3)).collect()] == ["a", "a_1", "a_2"]
    assert datasets.oversample(one, F.lit(0.2)).count() == 1


def test_nets_against_truth(spark):
    a = spark.createDataFrame([(1, ["R1:1", "R2:1"]), (1, ["X:1"]), (1, ["C1:1", "C2:2"])], "sheet_id int, refs array<string>")
    b = spark.createDataFrame([(1, ["R2:1", "R1:1"]), (1, ["D1:1", "D2:1"])], "sheet_id int, refs array<string>")
    got = {tuple(r.refs): r.verdict for r in evaluate.compare_nets(a, b).collect()}
    assert got == {("R1:1", "R2:1"): "matched", ("C1:1", "C2:2"): "extra", ("D1:1", "D2:1"): "missing"}
    top = evaluate.roll_up(evaluate.compare_nets(a, b)).where("sheet_id is null").first()
    assert (top.recall, top.precision) == (0.5, 0.5)


def test_review_issues(spark):
    d = boxes(spark, (0, 0, 1, 1, 0.6), (0, 0, 1, 1, 0.8))
    texts = spark.createDataFrame([(1, 0, "a", 0, 0, 1, 1, 0.5)], TEXTS)
    j = spark.createDataFrame([(1, "wire_1_1")], "sheet_id bigint, node_id string")
    issues = manifest.review_issues(d, texts, j)
    assert sorted(r.issue_type for r in issues.collect()) == ["junction", "symbol", "text"]
    assert manifest.first_issues(issues, 2).count() == 2


def test_pages_in_one_document(spark):
    d = spark.createDataFrame([(2, "comp_001")], "page int, id string")
    assert manifest.merge_pages(d, "page", "id").first().id == "p2_comp_001"


def test_neighbours_a_few_at_a_time(monkeypatch):
    # F5 to F7: a task's memory goes by its blocks; ties and places are those of a full sort
    import numpy as np

    rng = np.random.default_rng(5)
    data, ids = knn._unit(rng.integers(-2, 3, (300, 4)).astype(float)), rng.permutation(300)
    q, keys = data[::7], ids[::7]
    top_s, top_k = np.full((len(keys), 5), -np.inf), np.zeros((len(keys), 5), np.int64)
    for n in range(0, 300, 37):
        top_s, top_k = knn._better(top_s, top_k, keys, q, ids[n : n + 37], data[n : n + 37], 6)
    for i, key in enumerate(keys):
        full = sorted((-s, k) for s, k in zip(np.round(np.einsum("qd,nd->qn", q[i : i + 1], data), 6)[0], ids, strict=True) if k != key)[:5]
        assert [(-s, k) for s, k in zip(top_s[i], top_k[i], strict=True)] == full


def test_contained_segments_of_long_lists(spark):
    # F8: a sheet's segments are held against each other a block at a time, with what they were before
    import random

    draw = random.Random(8)
    rows = []
    for i in range(900):
        x, y, n = draw.randrange(600), draw.randrange(12), draw.randrange(9)
        rows.append((1 + i % 2, i, x, y, x + n, y) if i % 3 else (1 + i % 2, i, x, y, x, y + n))
    rows.append((1, 901, None, 3, 4, 5))

    def by(k, x, y):
        t = min(1, max(0, ((x - k[2]) * (k[4] - k[2]) + (y - k[3]) * (k[5] - k[3])) / max(1, (k[4] - k[2]) ** 2 + (k[5] - k[3]) ** 2)))
        return (x - k[2] - t * (k[4] - k[2])) ** 2 + (y - k[3] - t * (k[5] - k[3])) ** 2 <= 4

    kept = []
    for r in sorted(rows[:-1], key=lambda r: (-((r[4] - r[2]) ** 2) - (r[5] - r[3]) ** 2, r[1])):
        if not any(k[0] == r[0] and by(k, r[2], r[3]) and by(k, r[4], r[5]) for k in kept):
            kept.append(r)
    got = greedy.drop_contained_segments(spark.createDataFrame(rows, "sheet_id bigint, segment_id bigint, sx int, sy int, ex int, ey int"))
    assert {r.segment_id for r in got.collect()} == {k[1] for k in kept} | {901} and len(kept) > 300
    assert "collect_list" not in got._jdf.queryExecution().executedPlan().toString()


def test_states_of_a_log_in_parts(spark, monkeypatch):
    # no task has the whole log; a part goes on from the promotion before it
    import random

    monkeypatch.setattr(registry, "PART_ROWS", 9)
    draw, names = random.Random(2), ("register", "promote", "reject", "start_ab", "stop_ab")
    log = [(3 * i + 1, names[draw.randrange(5)] if i % 60 < 20 or draw.random() < 0.05 else "stop_ab", f"v{draw.randrange(40):06d}") for i in range(200)]
    current, first, parent = None, min(s for s, a, _ in log if a == "register"), {}
    for s, a, version in log:
        parent.setdefault(version, None)
        if a == "register":
            parent[version] = max(filter(None, (parent[version], current)), default=None)
        if a == "promote" or s == first:
            current = version
    made = registry.states(spark.createDataFrame(log, registry.EVENTS).repartition(5))
    got = {r.version_id: r.parent for r in made.collect()}
    assert got == parent and [r.version_id for r in made.where("status = 'current'").collect()] == [current]
    whole = made._jdf.queryExecution().optimizedPlan().toString()
    assert "lag(" not in whole and "partitionBy" not in whole and "part#" in whole


def test_components_that_tasks_settle_take_no_round(spark):
    # stars are known as such, and no round is written to find that nothing changes
    from wireloom.tables import table_count

    rows = [(f"{i:03d}_{k}", f"{i:03d}_{k + 1}") for i in range(50) for k in range(3)] * 2
    edges = spark.createDataFrame(rows, "a string, b string")
    before = table_count()
    got = {(r.node, r.component) for r in components(edges.coalesce(1)).collect()}
    assert got == {(f"{i:03d}_{k}", f"{i:03d}_0") for i in range(50) for k in range(4)} and table_count() == before + 1
    assert got == {(r.node, r.component) for r in components(edges.repartition(16)).collect()}
