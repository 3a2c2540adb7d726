"""Scans of pages, the training schedule, settings, the annotation store, simplified lines and merged segments on small inputs."""

import json
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from wireloom.functions import vectors
from wireloom.plans import netlist, polylines, registry
from wireloom.settings import Settings
from wireloom.sources import pages, readers, writers
from wireloom.streaming import ticks


def tiff(sizes, end="<"):
    """A file of directories only."""
    out = (b"II*\0" if end == "<" else b"MM\0*") + struct.pack(end + "I", 8)
    for i, (w, h) in enumerate(sizes):
        at = len(out)
        after = at + 2 + 24 + 4 if i + 1 < len(sizes) else 0
        out += struct.pack(end + "H", 2) + struct.pack(end + "HHII", 256, 4, 1, w) + struct.pack(end + "HHII", 257, 4, 1, h) + struct.pack(end + "I", after)
    return out


PDF = b"%PDF-1.4\n1 0 obj <</Type /Pages /Kids [2 0 R 3 0 R]>> endobj 2 0 obj <</Type /Page>> endobj 3 0 obj <</Type/Page /Rotate 0>> endobj"
PACKED = b"%PDF-1.5\n9 0 obj <</Type /ObjStm /N 3>> stream\n" + zlib.compress(b"<</Type /Pages>> <</Type /Page>> <</Type /Page>> <</Type /Page>>") + b"\nendstream"
PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480)
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 30, 50) + b"\x03"


def test_pages_of_files(spark):
    files = spark.createDataFrame(
        [("a.tif", tiff([(10, 20), (30, 40), (50, 60)])), ("b.tif", tiff([(7, 8)], ">")), ("c.pdf", PDF), ("d.pdf", PACKED), ("e.png", PNG), ("f.jpg", JPEG), ("g.txt", b"no picture"), ("h", None)],
        "path string, content binary",
    )
    got = {(r.path, r.page): (r.kind, r.width, r.height) for r in pages.pages(files).collect()}
    assert [got["a.tif", i][1:] for i in (1, 2, 3)] == [(10, 20), (30, 40), (50, 60)] and got["b.tif", 1] == ("tiff", 7, 8)
    assert sum(p == "c.pdf" for p, _ in got) == 2 and sum(p == "d.pdf" for p, _ in got) == 3
    assert got["e.png", 1] == ("png", 640, 480) and got["f.jpg", 1] == ("jpeg", 50, 30) and not any(p in "gh" for p, _ in got)
    numbers = lambda **k: sorted((r.path, r.page) for r in pages.pages(files, **k).where("path in ('a.tif', 'd.pdf')").collect())
    assert numbers(max_pages=2) == [("a.tif", 1), ("a.tif", 2), ("d.pdf", 1), ("d.pdf", 2)]
    assert numbers(page_numbers=[3, 9]) == [("a.tif", 3), ("d.pdf", 3)] and numbers(page_numbers=[2, 3], max_pages=1) == [("a.tif", 2), ("d.pdf", 2)]
    assert pages.first_page(files.where("path < 'g'")).count() == 6
    with pytest.raises(Exception, match="no pages"):
        pages.first_page(files).collect()


def test_looped_directories_end():
    looped = bytearray(tiff([(1, 2), (3, 4)]))
    looped[-4:] = struct.pack("<I", 8)
    assert pages.tiff_frames(bytes(looped)) == [(1, 2), (3, 4)] and pages.tiff_frames(b"II*\0\xff\xff\xff\xff") == []


def test_schedule(spark, tmp_path):
    results = iter([{"status": "success", "weights_path": "w.pt", "metrics": {"map": 0.5}}, {"status": "failed"}])
    registered, called = [], []

    def train():
        found = next(results, None)
        if found is None:
            raise RuntimeError("out of memory")
        return found

    def webhook(entry):
        called.append(entry["event_type"])
        raise OSError("no network")

    own = ticks.Schedule(spark, str(tmp_path / "log"), 3, train, lambda path, metrics: registered.append((path, metrics)), webhook)
    assert own.tick(2)["status"] == "skipped" and not called
    assert [own.tick(n)["result"]["status"] for n in (3, 4, 5)] == ["success", "failed", "failed"]
    assert registered == [("w.pt", {"map": 0.5})] and own.state.last_result["error"] == "out of memory"
    assert (own.state.total_checks, own.state.total_retrains) == (4, 3)
    rows = ticks.history(spark, str(tmp_path / "log"), 4).collect()
    assert [r.event_type for r in rows] == ["retrain_failed", "retrain_started", "retrain_due", "retrain_failed"] and called == ["retrain_due", "retrain_started", "retrain_done"] + ["retrain_due", "retrain_started", "retrain_failed"] * 2
    own.save(str(tmp_path / "state"))
    again = ticks.Schedule(spark, str(tmp_path / "log"), 3, train)
    again.load(str(tmp_path / "state"))
    assert again.state == own.state


def test_schedule_on_a_stream(spark, tmp_path):
    said = []
    for k, n in enumerate((2, 3)):
        spark.range(n).write.mode("append").json(str(tmp_path / "in"))
        own = ticks.Schedule(spark, str(tmp_path / "log"), 4, lambda: {"status": "success"})
        stream = spark.readStream.schema("id bigint").json(str(tmp_path / "in"))
        ticks.run(stream, own, str(tmp_path / "cp"), str(tmp_path / "n")).awaitTermination()
        said.append(own.state.total_retrains)
    assert said == [0, 1]


def test_settings():
    own = Settings.read("slicing: {tile_size: 512}\nretrieval:\n  min_similarity: 0.5\n").check()
    assert own.slicing.tile_size == 512 and own.graph.text_radius == 50 and Settings.read(own.dump()) == own
    for bad in ({"slicing": {"tile_size": 100}}, {"slicing": {"overlap_ratio": 0.6}}, {"graph": {"snap_radius": -1}}):
        with pytest.raises(ValueError):
            Settings.of(bad).check()
    with pytest.raises(ValueError, match="unknown"):
        Settings.of({"slicing": {"size": 1}})


def test_data_set_yaml(tmp_path):
    path = tmp_path / "set" / "data.yaml"
    path.parent.mkdir()
    path.write_text("path: own\ntrain: images/a\nnames: [resistor, diode]\n")
    got = readers.read_dataset(str(path))
    assert got == {"path": str(tmp_path / "set" / "own"), "train": "images/a", "val": "images/a", "names": {0: "resistor", 1: "diode"}}
    path.write_text("names: {'3': lamp}\nval: images/v\n")
    assert readers.read_dataset(str(path)) == {"path": str(tmp_path / "set"), "train": "images/train", "val": "images/v", "names": {3: "lamp"}}


def test_vector_store(spark, tmp_path):
    spark.createDataFrame([("a", "x", "p1"), ("b", "y", "p2"), ("gone", "z", "p3")], "id string, label string, image_path string").write.json(str(tmp_path / "meta"))
    spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("other", [1.0, 1.0])], "id string, embedding array<double>").write.parquet(str(tmp_path / "vectors"))
    got = readers.read_vector_store(spark, str(tmp_path), "id string, label string, image_path string, created_at string")
    assert got.columns == ["id", "label", "embedding"] and sorted(r.id for r in got.collect()) == ["a", "b"]


def test_registry_write_back(spark, tmp_path):
    events = spark.createDataFrame([(1, "register", "v000001"), (2, "register", "v000002"), (3, "promote", "v000002")], registry.EVENTS)
    facts = spark.createDataFrame([("v000002", "w2.pt"), ("v000001", "w1.pt")], "version_id string, weights_path string")
    registry.write_back(events, facts, str(tmp_path / "r"))
    registry.write_back(events, facts, str(tmp_path / "r"))
    got = [(r.version_id, r.status, r.weights_path) for r in registry.listed(spark.read.parquet(str(tmp_path / "r" / "versions"))).collect()]
    assert got == [("v000001", "retired", "w1.pt"), ("v000002", "current", "w2.pt")]


def test_upsert_takes_the_last(spark):
    store = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    fresh = spark.createDataFrame([(2, "old", 1), (2, "new", 2), (3, "c", 1)], "k int, v string, seq int")
    assert sorted(map(tuple, writers.upsert(store, fresh, "k", "seq").collect())) == [(1, "a"), (2, "new"), (3, "c")]
    assert sorted(r.k for r in writers.delete(store, fresh, "k").collect()) == [1] and writers.clear(store).count() == 0


def test_text_vectors(spark):
    rows = spark.createDataFrame([("one",), ("two",), ("one",), ("",)], "t string").select("t", vectors.text_vector(F.col("t"), 32).alias("v")).collect()
    assert rows[0].v == rows[2].v != rows[1].v and all(abs(sum(x * x for x in r.v) - 1) < 1e-9 and len(r.v) == 32 for r in rows)


def far(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    size = (dx * dx + dy * dy) ** 0.5
    return abs(dy * (p[0] - a[0]) - dx * (p[1] - a[1])) / size if size else ((p[0] - a[0]) ** 2 + (p[1] - a[1]) ** 2) ** 0.5


def plain_simplified(points, most):
    if len(points) < 3:
        return points
    d = [far(p, points[0], points[-1]) for p in points[1:-1]]
    if max(d) <= most:
        return [points[0], points[-1]]
    k = d.index(max(d)) + 1
    return plain_simplified(points[: k + 1], most)[:-1] + plain_simplified(points[k:], most)


def test_simplified_lines(spark):
    rng = random.Random(3)
    lines = [[(x * 5, rng.randint(-4, 4) + (x % 7) * rng.randint(0, 3)) for x in range(rng.randint(0, 40))] for _ in range(40)] + [[(0, 0), (5, 5), (0, 0)], [(1, 1)] * 4]
    rows = [(i, [{"x": x, "y": y} for x, y in line]) for i, line in enumerate(lines)]
    got = polylines.simplified(spark.createDataFrame(rows, "id int, points array<struct<x:int,y:int>>"), "points", 2.0).collect()
    for r in got:
        assert [(p.x, p.y) for p in r.points] == plain_simplified(lines[r.id], 2.0), r.id
    long = [(0, [{"x": x, "y": x * x % 97} for x in range(20_000)])]
    assert len(polylines.simplified(spark.createDataFrame(long, "id int, points array<struct<x:int,y:int>>"), "points", 0.5).first().points) > 1000


def plain_merge(rows, pins, tolerance):
    """Segments of one line, the pair of the smallest numbers first, until none meets; (start, end, confidence, merged)."""
    live = {i: ((a, 0), (b, 0), c, 0) for i, (a, b, c) in enumerate(rows)}
    fixed = {i: {p for p in live[i][:2] if p[0] in pins} for i in live}
    while True:
        pair = min(
            ((i, k) for i in live for k in live if i < k and any(abs(p[0] - q[0]) <= tolerance and p not in fixed[i] and q not in fixed[k] for p in live[i][:2] for q in live[k][:2])), default=None
        )
        if pair is None:
            return sorted((a[0], b[0], c, m) for a, b, c, m in live.values())
        (a, b), new = (live.pop(i) for i in pair), max(fixed) + 1
        ends = [*a[:2], *b[:2]]
        live[new] = (min(ends), max(ends), min(a[2], b[2]), a[3] + b[3] + 1)
        fixed[new] = fixed[pair[0]] | fixed[pair[1]]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merged_segments(spark, seed):
    rng = random.Random(seed)
    rows = [(a := rng.randint(0, 150), a + rng.randint(5, 30), round(rng.random(), 3)) for _ in range(30)]
    pins = {rows[k][0] for k in (3, 9)}
    segments = spark.createDataFrame([(1, i, a, 7, b, 7, c) for i, (a, b, c) in enumerate(rows)], "sheet_id bigint, segment_id bigint, sx int, sy int, ex int, ey int, confidence double")
    places = spark.createDataFrame([(1, x, 7) for x in sorted(pins)], "sheet_id bigint, x int, y int")
    got = netlist.merge_collinear(segments, places, 2.0).collect()
    assert sorted((r.sx, r.ex, r.confidence, r.merged) for r in got) == plain_merge(rows, pins, 2)


def test_json_lines_of_the_log(spark, tmp_path):
    own = ticks.Schedule(spark, str(tmp_path / "log"), 1, lambda: {"status": "success"})
    entry = own.notify("retrain_due", {"n": 1}, "now")
    row = ticks.history(spark, str(tmp_path / "log")).first()
    assert json.loads(row.payload) == {"n": 1} and row.message == "now" and row.timestamp == entry["timestamp"]
