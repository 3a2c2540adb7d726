import json

from pyspark.sql import functions as F

from wireloom.plans import manifest
from wireloom.schema import FEEDBACK, symbols
from wireloom.sources import readers, writers
from wireloom.streaming import feedback as stream


def lines(path, rows):
    path.mkdir(parents=True, exist_ok=True)
    (path / f"part{len(list(path.iterdir()))}.json").write_text("\n".join(rows))


def row(i, a="diode", b="resistor"):
    return json.dumps({"id": str(i), "file_id": f"f{i}", "original_label": a, "corrected_label": b, "issue_type": "symbol", "user_id": "u", "created_at": "2024-01-0%dT00:00:00" % (i % 9 + 1)})


def test_bad_lines_of_a_log_go(spark, tmp_path):
    lines(tmp_path / "log", [row(1), "{not json", row(2)])
    assert {r.id for r in readers.read_feedback(spark, str(tmp_path / "log")).collect()} == {"1", "2"}


def test_last_rows(spark):
    assert [r.id for r in readers.last_rows(spark.range(9), "id", 3).collect()] == [6, 7, 8]


def test_label_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("3 0.5 0.5 0.1 0.2\n1 0.5\n")
    (r,) = readers.read_labels(spark, str(tmp_path)).collect()
    assert (r.class_id, r.w, r.h) == (3, 0.1, 0.2)


def test_netlist_documents(spark, tmp_path):
    doc = {"components": [{"designator": "R1", "class_name": "resistor", "bbox": [1, 2, 3, 4], "pins": {"1": [5, 6], "2": [[7, 8], [9, 10]]}}], "nets": [["R1:1", "R2:1"]]}
    (tmp_path / "n.json").write_text(json.dumps(doc))
    c, nets = readers.read_netlists(spark, str(tmp_path))
    (r,) = c.collect()
    assert r.pins == {"1": [[5, 6]], "2": [[7, 8], [9, 10]]} and r.x1 == 3
    assert nets.first().refs == ["R1:1", "R2:1"]


def test_image_headers(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (300).to_bytes(4, "big") + (200).to_bytes(4, "big") + b"\x08\x02")
    (tmp_path / "b.gif").write_bytes(b"GIF89a" + (7).to_bytes(2, "little") + (513).to_bytes(2, "little"))
    (tmp_path / "c.bin").write_bytes(b"%PDF-1.7")
    got = {r.path.rsplit("/", 1)[1]: (r.format, r.width, r.height) for r in readers.image_info(readers.read_files(spark, str(tmp_path))).collect()}
    assert got == {"a.png": ("png", 300, 200), "b.gif": ("gif", 7, 513), "c.bin": ("pdf", None, None)}


def test_upsert_and_crops(spark):
    store = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    out = writers.upsert(store, spark.createDataFrame([("b", 5), ("c", 6)], "id string, v int"), "id")
    assert {(r.id, r.v) for r in out.collect()} == {("a", 1), ("b", 5), ("c", 6)}
    f = spark.createDataFrame([("1", "resistor"), ("2", "no such"), ("3", "diode")], "id string, corrected_label string")
    crops = spark.createDataFrame([("1",), ("2",)], "id string")
    got = {r.file: r.value.split()[0] for r in writers.correction_crops(f, symbols(spark), crops).collect()}
    assert got == {"1": "8", "2": "0"}


def test_manifest_files(spark, tmp_path):
    one = spark.createDataFrame([(1, "x")], "sheet_id int, name string")
    for kind in writers.FORMATS:
        writers.write_manifests(one, str(tmp_path / kind), kind)
    assert spark.read.json(str(tmp_path / "json")).count() == 1
    try:
        writers.write_manifests(one, str(tmp_path / "x"), "yaml")
        raise AssertionError
    except ValueError:
        pass


def test_manifest_of_a_sheet(spark):
    c = spark.createDataFrame([(1, "comp_001")], "sheet_id int, id string")
    n = spark.createDataFrame([(1, "NET_000")], "sheet_id int, net_id string")
    i = spark.createDataFrame([(2, 0)], "sheet_id int, issue_idx int")
    out = {r.sheet_id: r for r in manifest.manifest(c, n, i).collect()}
    assert out[1].components[0].id == "comp_001" and out[2].components is None and out[2].human_review_queue[0].issue_idx == 0


def test_stream_equals_batch(spark, tmp_path):
    lines(tmp_path / "in", [row(i, b="resistor" if i % 2 else "fuse") for i in range(6)])
    counts = stream.correction_counts(stream.read_stream(spark, str(tmp_path / "in")))
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = readers.read_feedback(spark, str(tmp_path / "in")).groupBy("corrected_label").count()
    got = spark.table("counts").groupBy("corrected_label").agg(F.sum("n").alias("count"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_trigger_fires_until_cleared(spark, tmp_path):
    fired = []
    for i in range(3):
        lines(tmp_path / "in", [row(10 * i + k) for k in range(2)])
        stream.on_due(stream.read_stream(spark, str(tmp_path / "in")), str(tmp_path / "cp"), 4, lambda df, n: fired.append(n), str(tmp_path / "rows")).awaitTermination(120)
    assert fired == [4, 6]


def test_late_schema_is_fixed():
    assert FEEDBACK.startswith("id string")
