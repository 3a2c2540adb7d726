"""Queries over labels, pins, annotations, scores and views, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wireloom.functions import geometry as g
from wireloom.functions import text as t
from wireloom.operators import knn, tiling
from wireloom.plans import annotations, datasets, evaluate, labels, registry, views
from wireloom.queries.views import sql, table, view


def segment_labels(spark, sf):
    return labels.label_segments(view(spark, sf, "v_texts"), view(spark, sf, "v_segments"))


SEGMENT_LABELS = """with x as (select sheet_id, text_id, text, cast(floor((x0 + x1) / 2.0) as int) as x, cast(floor((y0 + y1) / 2.0) as int) as y from v_texts where text <> ''),
m as (select sheet_id, segment_id, cast(floor((sx + ex) / 2.0) as int) as x, cast(floor((sy + ey) / 2.0) as int) as y from v_segments),
n as (select x.sheet_id, text_id, text, segment_id, row_number() over (partition by x.sheet_id, text_id order by (x.x - m.x) * (x.x - m.x) + (x.y - m.y) * (x.y - m.y), segment_id) as nth
  from x join m on x.sheet_id = m.sheet_id and (x.x - m.x) * (x.x - m.x) + (x.y - m.y) * (x.y - m.y) <= 2500)
select sheet_id, 'segment_' || segment_id as segment, max_by(text, text_id) as text from n where nth = 1 group by sheet_id, segment_id"""


def point_labels(spark, sf):
    p = view(spark, sf, "v_pins").select("sheet_id", F.col("pin_number").alias("a_id"), F.col("x").alias("a_x"), F.col("y").alias("a_y"))
    b = view(spark, sf, "v_texts").select("sheet_id", F.col("text_id").alias("b_id"), F.concat(F.lit("k"), F.pmod("text_id", F.lit(3)).cast("string")).alias("kind"), F.col("x0").alias("b_x"), F.col("y0").alias("b_y"))
    return labels.nearest_label(p, b, 150.0, ["k0", "k1"])


POINT_LABELS = """with n as (select p.sheet_id, p.pin_number as a_id, t.text_id as b_id, row_number() over (partition by p.sheet_id, p.pin_number order by (p.x - t.x0) * (p.x - t.x0) + (p.y - t.y0) * (p.y - t.y0), t.text_id) as nth
  from v_pins p join v_texts t on p.sheet_id = t.sheet_id and (p.x - t.x0) * (p.x - t.x0) + (p.y - t.y0) * (p.y - t.y0) <= 22500)
select sheet_id, a_id, b_id from n where nth = 1 and b_id % 3 < 2"""


def pin_dedupe(spark, sf):
    p = view(spark, sf, "v_pins").withColumn("seq", F.col("pin_number").cast("long"))
    again = p.where("seq % 3 = 0").withColumn("seq", F.col("seq") + 1_000_000)
    moved = p.where("seq % 4 = 0").withColumns({"x": F.col("x") + 1, "seq": F.col("seq") + 2_000_000})
    return labels.drop_repeated_pins(again.unionByName(p).unionByName(moved))


PIN_DEDUPE = """with p as (select *, cast(pin_number as bigint) as seq from v_pins),
a as (select * from p union all select * replace (seq + 1000000 as seq) from p where seq % 3 = 0 union all select * replace (x + 1 as x, seq + 2000000 as seq) from p where seq % 4 = 0)
select sheet_id, component_id, pin_number, x, y, min(seq) as seq from a group by all"""


def note_defaults(spark, sf):
    notes = F.when(F.pmod("text_id", F.lit(2)) == 0, F.create_map(F.lit("source"), F.col("text"))).otherwise(F.create_map(F.lit("other"), F.lit("x")))
    d = view(spark, sf, "v_texts").withColumn("notes", labels.set_default(notes, "source", F.lit("auto")))
    return d.select("text_id", F.col("notes")["source"].alias("source"), F.size("notes").alias("n"))


NOTE_DEFAULTS = "select text_id, case when text_id % 2 = 0 then text else 'auto' end as source, cast(case when text_id % 2 = 0 then 1 else 2 end as int) as n from v_texts"


def second_look(spark, sf):
    return labels.first_open(view(spark, sf, "v_detections"), F.pmod("det_id", F.lit(4)) != 0, 7).select("sheet_id", "det_id", "nth")


SECOND_LOOK = "select sheet_id, det_id, cast(nth as int) as nth from (select sheet_id, det_id, row_number() over (partition by sheet_id order by det_id) as nth from v_detections where det_id % 4 = 0) where nth <= 7"


def numbers_by_kind(spark, sf):
    return labels.number_by_kind(view(spark, sf, "v_detections"), ["1-URGENT"], ["5-LOW"])


NUMBERS_BY_KIND = """with n as (select sheet_id, det_id, category, row_number() over (partition by sheet_id order by category <> '1-URGENT', det_id) as n from v_detections where category <> '5-LOW')
select sheet_id, det_id, printf('comp_%03d', n) as id, case when category = '1-URGENT' then 'X' else upper(category[:2]) end || n as designator from n"""


def points_to_nodes(spark, sf):
    s = view(spark, sf, "v_segments")
    ends = s.select("sheet_id", F.col("segment_id").alias("node_id"), F.col("sx").alias("x"), F.col("sy").alias("y")).unionByName(s.select("sheet_id", F.col("segment_id").alias("node_id"), F.col("ex").alias("x"), F.col("ey").alias("y")))
    return labels.nodes_by_point(ends).select("sheet_id", "x", "y", F.array_join("nodes", ",").alias("nodes"))


POINTS_TO_NODES = """with e as (select sheet_id, segment_id as n, sx as x, sy as y from v_segments union select sheet_id, segment_id, ex, ey from v_segments)
select sheet_id, x, y, string_agg(cast(n as varchar), ',' order by n) as nodes from e group by sheet_id, x, y"""


def pin_bridges(spark, sf):
    d = view(spark, sf, "v_detections")
    middle = g.floor_centre(F.col("y0"), F.col("y1"))
    side = lambda x, way, k: d.select("sheet_id", (F.col("det_id") * 4 + k).alias("pin_id"), F.col("det_id").alias("comp_id"), F.col(x).alias("x"), middle.alias("y"), F.lit(way).alias("dx"), F.lit(0).alias("dy"))
    across = g.floor_centre(F.col("x0"), F.col("x1"))
    end = lambda y, way, k: d.select("sheet_id", (F.col("det_id") * 4 + k).alias("pin_id"), F.col("det_id").alias("comp_id"), across.alias("x"), F.col(y).alias("y"), F.lit(0).alias("dx"), F.lit(way).alias("dy"))
    pins = side("x0", -1, 0).unionByName(side("x1", 1, 1)).unionByName(end("y0", -1, 2)).unionByName(end("y1", 1, 3))
    return labels.facing_pins(pins, d.withColumnRenamed("det_id", "comp_id"))


PIN_BRIDGES = """with m as (select *, cast(floor((x0 + x1) / 2.0) as int) as mx, cast(floor((y0 + y1) / 2.0) as int) as my from v_detections),
p as (select a.sheet_id, a.det_id * 4 + 1 as a_id, b.det_id * 4 as b_id, a.det_id as a, b.det_id as b, b.x0 - a.x1 as length, a.x1 as lx, b.x0 as hx, least(a.my, b.my) as ly, greatest(a.my, b.my) as hy
  from m a join m b on a.sheet_id = b.sheet_id and a.det_id <> b.det_id and b.x0 - a.x1 between 2 and 120 and abs(a.my - b.my) <= 5
  union all
  select a.sheet_id, a.det_id * 4 + 3, b.det_id * 4 + 2, a.det_id, b.det_id, b.y0 - a.y1, least(a.mx, b.mx), greatest(a.mx, b.mx), a.y1, b.y0
  from m a join m b on a.sheet_id = b.sheet_id and a.det_id <> b.det_id and b.y0 - a.y1 between 2 and 120 and abs(a.mx - b.mx) <= 5)
select sheet_id, a_id, b_id, length from p where not exists (select 1 from m k where k.sheet_id = p.sheet_id and k.det_id not in (p.a, p.b)
  and k.x0 + 1 < p.hx and p.lx < k.x1 - 1 and k.y0 + 1 < p.hy + 1 and p.ly - 1 < k.y1 - 1)"""


def table_neighbours(spark, sf):
    d = view(spark, sf, "v_detections").withColumnRenamed("det_id", "cell_id")
    return labels.side_neighbours(d.where("cell_id % 3 = 0"), d, 12, 30)


TABLE_NEIGHBOURS = """select a.sheet_id, a.det_id as a_id, b.det_id as b_id from v_detections a join v_detections b on a.sheet_id = b.sheet_id
where a.det_id % 3 = 0 and b.det_id % 3 <> 0 and abs(a.y0 - b.y0) <= 12 and abs(a.y1 - b.y1) <= 12 and (b.x0 - a.x1 between 0 and 30 or a.x0 - b.x1 between 0 and 30)"""


def segment_touch(spark, sf):
    s = view(spark, sf, "v_segments")
    c = ("sx", "sy", "ex", "ey")
    a = s.select("sheet_id", F.col("segment_id").alias("a_id"), *(F.col(x).alias(f"a_{x}") for x in c))
    b = s.select("sheet_id", F.col("segment_id").alias("b_id"), *(F.col(x).alias(f"b_{x}") for x in c))
    box = lambda df, p: df.withColumns({f"{p}x0": F.least(f"{p}sx", f"{p}ex"), f"{p}x1": F.greatest(f"{p}sx", f"{p}ex"), f"{p}y0": F.least(f"{p}sy", f"{p}ey"), f"{p}y1": F.greatest(f"{p}sy", f"{p}ey")})
    from wireloom.operators.spatial import spatial_join

    on = lambda: (F.col("a_id") != F.col("b_id")) & g.segments_touch([F.col(f"a_{x}") for x in c], [F.col(f"b_{x}") for x in c])
    return spatial_join(box(a, "a_"), box(b, "b_"), ["sheet_id"], on, 64, 5).select("sheet_id", "a_id", "b_id")


_TO = "sqrt(pow({p}x - least(greatest({p}x, least(a.sx, a.ex)), greatest(a.sx, a.ex)), 2) + pow({p}y - least(greatest({p}y, least(a.sy, a.ey)), greatest(a.sy, a.ey)), 2)) < 5"
SEGMENT_TOUCH = f"select a.sheet_id, a.segment_id as a_id, b.segment_id as b_id from v_segments a join v_segments b on a.sheet_id = b.sheet_id and a.segment_id <> b.segment_id where {_TO.format(p='b.s')} or {_TO.format(p='b.e')}"


def segment_scalars(spark, sf):
    s = view(spark, sf, "v_segments")
    facts = g.segment_facts(*(F.col(c) for c in ("sx", "sy", "ex", "ey")))
    stands = g.perpendicular(F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy"), F.pmod("segment_id", F.lit(5)), F.lit(1) + F.pmod("segment_id", F.lit(3)) * 4)
    low, high = g.scale_range(F.pmod("segment_id", F.lit(9)) / 2)
    return s.select("segment_id", F.round(facts["length"], 4).alias("length"), facts["is_horizontal"].alias("flat"), facts["is_vertical"].alias("upright"), facts["mid_x"].alias("mid_x"), facts["mid_y"].alias("mid_y"), stands.alias("stands"), F.round(low, 4).alias("least_scale"), F.round(high, 4).alias("most_scale"))


SEGMENT_SCALARS = """with s as (select *, ex - sx as dx, ey - sy as dy, segment_id % 5 as ux, 1 + segment_id % 3 * 4 as uy from v_segments)
select segment_id, round(sqrt(dx * dx + dy * dy), 4) as length, abs(dx) > abs(dy) and abs(dy) < 5 as flat, abs(dy) > abs(dx) and abs(dx) < 5 as upright,
  cast(floor((sx + ex) / 2.0) as int) as mid_x, cast(floor((sy + ey) / 2.0) as int) as mid_y,
  dx * dx + dy * dy > 0 and abs(dx * ux + dy * uy) <= 0.2 * sqrt(dx * dx + dy * dy) * sqrt(ux * ux + uy * uy) as stands,
  round(greatest(1.5, segment_id % 9 / 2.0 / 1.2), 4) as least_scale, round(least(40.0, greatest(3.0, segment_id % 9 / 2.0 / 0.15)), 4) as most_scale from s"""


def moved_boxes(spark, sf):
    d = view(spark, sf, "v_detections")
    moved = g.moved_box(g.box(), (0.75, -0.125, 30.0, 0.25, 0.5, -7.0))
    px, py, turn = g.fallback_pin(F.lit(2.0), F.lit(1.0), F.lit(8.0), F.lit(4.0), g.box())
    return d.select("det_id", *(c.alias(n) for c, n in zip(moved, ("x0", "y0", "x1", "y1"), strict=True)), px.alias("pin_x"), py.alias("pin_y"), turn.alias("rotation"))


_MX = lambda x, y: f"cast(round_even(0.75::double * {x} - 0.125::double * {y} + 30, 0) as int)"
_MY = lambda x, y: f"cast(round_even(0.25::double * {x} + 0.5::double * {y} - 7, 0) as int)"
_CORNERS = [(x, y) for x in ("x0", "x1") for y in ("y0", "y1")]
MOVED_BOXES = f"""select det_id, least({', '.join(_MX(*c) for c in _CORNERS)}) as x0, least({', '.join(_MY(*c) for c in _CORNERS)}) as y0,
  greatest({', '.join(_MX(*c) for c in _CORNERS)}) as x1, greatest({', '.join(_MY(*c) for c in _CORNERS)}) as y1,
  cast(round_even(x0 + 0.25::double * (x1 - x0), 0) as int) as pin_x, cast(round_even(y0 + case when y1 - y0 > x1 - x0 then 0.75::double else 0.25::double end * (y1 - y0), 0) as int) as pin_y,
  case when y1 - y0 > x1 - x0 then 90 else 0 end as rotation from v_detections"""


def annotation_stats(spark, sf):
    images = view(spark, sf, "v_sheets").where("sheet_id <= 500").select(F.col("sheet_id").alias("image_id"))
    own = view(spark, sf, "v_detections").select(F.col("sheet_id").alias("image_id"), F.pmod("det_id", F.lit(9)).cast("int").alias("class_id"), F.when(F.pmod("det_id", F.lit(2)) == 0, F.col("category")).alias("class_name"))
    old = own.withColumn("class_name", F.coalesce("class_name", F.lit("old")))
    touched = images.where("image_id % 3 = 0")
    now = annotations.replace_annotations(images, old, touched, own.where("image_id % 6 = 0"))
    left, now = annotations.delete_images(images, now, images.where("image_id % 7 = 0"))
    return annotations.stats(left, now)


ANNOTATION_STATS = """with i as (select sheet_id as image_id from v_sheets where sheet_id <= 500), o as (select sheet_id as image_id, det_id, category from v_detections),
a as (select image_id, case when det_id % 2 = 0 then category else 'old' end as c from o where not (image_id % 3 = 0 and image_id in (select image_id from i))
  union all select image_id, case when det_id % 2 = 0 then category else 'class_' || (det_id % 9) end from o where image_id % 6 = 0 and image_id in (select image_id from i)),
l as (select image_id from i where image_id % 7 <> 0), b as (select * from a where image_id in (select image_id from l))
select 'images' as what, count(*) as n from l union all select 'annotated', count(distinct image_id) from b union all select 'annotations', count(*) from b
union all select 'class ' || c, count(*) from b group by c"""

_FOUND = "det_id % 5 <> 0 and det_id % 6 <> 0"


def _matches(spark, sf):
    both = view(spark, sf, "v_detections").where(_FOUND).select("sheet_id", "det_id")
    return both.withColumn("truth_id", F.col("det_id")).join(view(spark, sf, "v_truth").select("sheet_id", "truth_id"), ["sheet_id", "truth_id"], "left_semi")


def _nets(spark, sf):
    return view(spark, sf, "v_detections").select("sheet_id", F.when(F.pmod("sheet_id", F.lit(4)) == 0, "matched").when(F.pmod("det_id", F.lit(3)) == 0, "missing").when(F.pmod("det_id", F.lit(3)) == 1, "extra").otherwise("matched").alias("verdict"))


def _scores(spark, sf):
    return evaluate.sheet_scores(view(spark, sf, "v_detections"), view(spark, sf, "v_truth"), _matches(spark, sf), _nets(spark, sf), "5-LOW")


def class_recall(spark, sf):
    return evaluate.recall_by_class(view(spark, sf, "v_truth"), _matches(spark, sf)).withColumn("recall", F.round("recall", 6))


CLASS_RECALL = "select category, count(*) filter (truth_id % 5 <> 0 and truth_id % 6 <> 0) as found, count(*) as expected, round(count(*) filter (truth_id % 5 <> 0 and truth_id % 6 <> 0) / greatest(1, count(*)), 6) as recall from v_truth group by category"


def false_positives(spark, sf):
    return evaluate.false_positives(view(spark, sf, "v_detections"), _matches(spark, sf), "5-LOW")


FALSE_POSITIVES = "select category, count(*) as n from v_detections where category <> '5-LOW' and (det_id % 5 = 0 or det_id % 6 = 0) group by category"


def sheet_scores(spark, sf):
    out = _scores(spark, sf)
    return out.select("sheet_id", "expected", "found", "matched", "detected", "nets_matched", "nets_expected", "nets_found", *(F.round(c, 6).alias(c) for c in ("recall", "precision", "net_recall", "net_precision")), "exact")


_SCORES = """e as (select sheet_id, count(*) as expected, count(*) filter (truth_id % 5 <> 0 and truth_id % 6 <> 0) as found from v_truth group by 1),
f as (select sheet_id, count(*) filter (category <> '5-LOW') as detected from v_detections group by 1),
v as (select sheet_id, case when sheet_id % 4 = 0 then 'matched' when det_id % 3 = 0 then 'missing' when det_id % 3 = 1 then 'extra' else 'matched' end as verdict from v_detections),
n as (select sheet_id, count(*) filter (verdict = 'matched') as nets_matched, count(*) filter (verdict <> 'extra') as nets_expected, count(*) filter (verdict <> 'missing') as nets_found from v group by 1),
s as (select sheet_id, expected, found, found as matched, coalesce(detected, 0) as detected, nets_matched, nets_expected, nets_found, found / greatest(1, expected) as recall, found / greatest(1, detected) as precision,
  nets_matched / greatest(1, nets_expected) as net_recall, nets_matched / greatest(1, nets_found) as net_precision, nets_matched = nets_expected and nets_matched = nets_found and nets_found > 0 as exact
  from e left join f using (sheet_id) left join n using (sheet_id))"""
SHEET_SCORES = f"with {_SCORES} select * replace (round(recall, 6) as recall, round(precision, 6) as precision, round(net_recall, 6) as net_recall, round(net_precision, 6) as net_precision) from s"


def bench_rollup(spark, sf):
    scores = _scores(spark, sf).withColumn("mode", F.concat(F.lit("m"), F.pmod("sheet_id", F.lit(3)).cast("string")))
    return evaluate.bench(scores, "mode").select("mode", "sheets", "found", "expected", "detected", "nets_matched", "nets_expected", "exact_sheets", *(F.round(c, 6).alias(c) for c in ("recall", "precision", "net_recall")))


BENCH_ROLLUP = f"""with {_SCORES} select 'm' || (sheet_id % 3) as mode, count(*) as sheets, cast(sum(found) as bigint) as found, cast(sum(expected) as bigint) as expected, cast(sum(detected) as bigint) as detected,
  cast(sum(nets_matched) as bigint) as nets_matched, cast(sum(nets_expected) as bigint) as nets_expected, count(*) filter (exact) as exact_sheets,
  round(sum(found) / greatest(1, sum(expected)), 6) as recall, round(sum(found) / greatest(1, sum(detected)), 6) as precision, round(sum(nets_matched) / greatest(1, sum(nets_expected)), 6) as net_recall from s group by 1"""


def worst_sheets(spark, sf):
    return evaluate.worst_sheets(_scores(spark, sf)).select("sheet_id", "nets_matched", "nets_expected")


WORST_SHEETS = f"with {_SCORES} select sheet_id, nets_matched, nets_expected from s order by net_recall, sheet_id limit 3"


def designator_scores(spark, sf):
    truth = view(spark, sf, "v_truth").withColumn("designator", F.concat(F.when(F.pmod("truth_id", F.lit(8)) == 1, "_").otherwise("R"), F.col("truth_id").cast("string")))
    found = view(spark, sf, "v_detections").withColumns({"designator": F.concat(F.lit("R"), (F.col("det_id") + F.when(F.pmod("det_id", F.lit(7)) == 0, 1).otherwise(0)).cast("string")), "origin": F.when(F.pmod("det_id", F.lit(2)) == 0, "ocr").otherwise("auto")})
    return evaluate.designator_scores(_matches(spark, sf), found, truth)


DESIGNATOR_SCORES = """select sheet_id, count(*) as expected, count(*) filter (hit and truth_id % 7 <> 0) as correct, count(*) filter (hit and truth_id % 7 = 0) as wrong, count(*) filter (hit and truth_id % 7 <> 0 and truth_id % 2 = 0) as read
from (select *, truth_id % 5 <> 0 and truth_id % 6 <> 0 as hit from v_truth where truth_id % 8 <> 1) group by sheet_id"""


def symmetric_refs(spark, sf):
    d = view(spark, sf, "v_detections")
    return d.select("det_id", evaluate.symmetric_ref(F.concat(F.lit("R"), F.col("det_id").cast("string")), F.pmod("det_id", F.lit(4)).cast("string"), F.col("category"), ["1-URGENT", "2-HIGH"]).alias("ref"))


SYMMETRIC_REFS = "select det_id, 'R' || det_id || ':' || case when category in ('1-URGENT', '2-HIGH') then '*' else cast(det_id % 4 as varchar) end as ref from v_detections"


def report_counts(spark, sf):
    d = view(spark, sf, "v_detections").withColumn("pins_source", F.when(F.pmod("det_id", F.lit(3)) == 0, "geometry")).withColumn("source", F.when(F.pmod("det_id", F.lit(5)) != 0, F.col("source")))
    a = views.by_source(d).select(F.concat(F.lit("from "), F.col("origin")).alias("what"), "n")
    return a.unionByName(views.by_class(d).select(F.concat(F.lit("class "), F.col("category")).alias("what"), "n"))


REPORT_COUNTS = """with d as (select category, coalesce(case when det_id % 3 = 0 then 'geometry' end, case when det_id % 5 <> 0 then source end, '?') as origin from v_detections)
select 'from ' || origin as what, count(*) as n from d group by 1 union all select 'class ' || category, count(*) from d group by 1"""


def training_stats(spark, sf):
    return views.class_stats(view(spark, sf, "v_detections"))


TRAINING_STATS = "select category, count(*) as n, count(distinct sheet_id) as sheets, min(x1 - x0) as least_w, max(x1 - x0) as most_w, min(y1 - y0) as least_h, max(y1 - y0) as most_h from v_detections group by category"


def plan_bounds(spark, sf):
    return views.bounds(view(spark, sf, "v_detections"))


PLAN_BOUNDS = "select sheet_id, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from v_detections group by sheet_id"


def graph_view(spark, sf):
    p = view(spark, sf, "v_pins")
    c = p.groupBy("sheet_id", "component_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    nets = p.select("sheet_id", F.floor(F.col("x") / 200).alias("net_id"), F.concat_ws(":", "component_id", "pin_number").alias("ref"))
    edges = views.pin_edges(p).unionByName(views.net_edges(nets).select("sheet_id", "src", "dst", F.lit("net").alias("type")))
    return views.graph_stats(views.graph_nodes(c, p), edges)


GRAPH_VIEW = """with r as (select sheet_id, cast(floor(x / 200.0) as int) as net, component_id || ':' || pin_number as ref from v_pins),
e as (select a.sheet_id, count(*) as n from r a join r b on a.sheet_id = b.sheet_id and a.net = b.net and a.ref < b.ref group by 1)
select p.sheet_id, count(distinct component_id) as components, count(distinct component_id || ':' || pin_number) as pins, 0::bigint as wires, coalesce(any_value(e.n), 0) as connections from v_pins p left join e on e.sheet_id = p.sheet_id group by p.sheet_id"""


def layered_graph(spark, sf):
    p = view(spark, sf, "v_pins")
    kind = F.element_at(F.array(*map(F.lit, ("connector", "resistor", "ground", "lamp"))), (F.pmod(F.col("pin_number").cast("int"), F.lit(4)) + 1).cast("int"))
    return p.select("component_id", "pin_number", views.layer(kind, F.col("x"), F.lit(1001)).alias("z"))


LAYERED_GRAPH = "select component_id, pin_number, case cast(pin_number as int) % 4 when 0 then case when x < 500 then -20 else 20 end when 1 then 50 when 2 then -30 else 30 end as z from v_pins"


def old_tiles(spark, sf):
    return tiling.fixed_steps(view(spark, sf, "v_sheets"))


OLD_TILES = """with s as (select sheet_id, width, height, unnest(range(0, cast(height as bigint), 819)) as y from v_sheets), t as (select *, unnest(range(0, cast(width as bigint), 819)) as x from s),
e as (select *, least(x + 1024, width) as x1, least(y + 1024, height) as y1 from t)
select sheet_id, cast(x as int) as x, cast(y as int) as y, cast(case when x1 = width then x1 - 1024 else x end as int) as x0, cast(case when y1 = height then y1 - 1024 else y end as int) as y0, cast(x1 as int) as x1, cast(y1 as int) as y1 from e"""


def large_visible(spark, sf):
    sheets = view(spark, sf, "v_detections").select("sheet_id").distinct().withColumns({"width": F.lit(1100), "height": F.lit(800)})
    tiles = tiling.tile_grid(sheets, 160, 0.2)
    return tiling.visible_in_tiles(tiles, view(spark, sf, "v_detections"), large=("1-URGENT", 0.35, 0.3)).select("sheet_id", "tile_id", "det_id")


_STARTS = lambda side: f"list_distinct(list_concat(range(0, {side} - 160 + 1, 128), [{side} - 160]))"
LARGE_VISIBLE = f"""with ys as (select unnest(list_sort({_STARTS(800)})) as y0), xs as (select unnest(list_sort({_STARTS(1100)})) as x0),
yn as (select y0, row_number() over (order by y0) - 1 as r from ys), xn as (select x0, row_number() over (order by x0) - 1 as c from xs),
t as (select r * (select count(*) from xs) + c as tile_id, x0, y0, x0 + 160 as x1, y0 + 160 as y1 from yn, xn),
p as (select d.*, t.tile_id, cast(least(d.x1, t.x1) - greatest(d.x0, t.x0) as bigint) * (least(d.y1, t.y1) - greatest(d.y0, t.y0)) as seen from v_detections d, t where least(d.x1, t.x1) > greatest(d.x0, t.x0) and least(d.y1, t.y1) > greatest(d.y0, t.y0))
select sheet_id, tile_id, det_id from p where seen >= case when category = '1-URGENT' and greatest(x1 - x0, y1 - y0) > 0.35 * 160 then 0.3 else 0.6 end * (cast(x1 - x0 as bigint) * (y1 - y0))"""


def sure_crops(spark, sf):
    d = view(spark, sf, "v_detections")
    sheets = d.select("sheet_id").distinct().withColumns({"width": F.lit(1100), "height": F.lit(800)})
    return tiling.best_crops(d, sheets, 300, 200).select("sheet_id", "det_id", "cx0", "cy0", "nth")


SURE_CROPS = """with recursive b as (select sheet_id, det_id, confidence, greatest(0, least(800, cast(floor((x0 + x1) / 2.0) as int) - 150)) as x, greatest(0, least(600, cast(floor((y0 + y1) / 2.0) as int) - 100)) as y from v_detections),
d as (select *, row_number() over (partition by sheet_id order by confidence desc, det_id) as rk from b),
f as (select sheet_id, rk, [{'det_id': det_id, 'x': x, 'y': y}] as kept from d where rk = 1 union all
  select f.sheet_id, d.rk, case when len(list_filter(f.kept, lambda k: least(k.x, d.x) + 300 - greatest(k.x, d.x) > 120 and least(k.y, d.y) + 200 - greatest(k.y, d.y) > 80)) > 0 then f.kept else list_append(f.kept, {'det_id': d.det_id, 'x': d.x, 'y': d.y}) end
  from f join d on d.sheet_id = f.sheet_id and d.rk = f.rk + 1),
l as (select sheet_id, max_by(kept, rk) as kept from f group by sheet_id), u as (select sheet_id, unnest(kept) as k, generate_subscripts(kept, 1) as nth from l)
select sheet_id, k.det_id as det_id, k.x as cx0, k.y as cy0, cast(nth as int) as nth from u where nth <= 3"""


def file_stems(spark, sf):
    d = view(spark, sf, "v_texts")
    tall = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: i * 10)
    dots = F.array((F.pmod("text_id", F.lit(4)) * 10 + 5).cast("int"))
    kind = F.element_at(F.array(F.lit("text"), F.lit("rag"), F.lit("junction")), (F.pmod("text_id", F.lit(3)) + 1).cast("int"))
    return d.select(
        "text_id", t.ascii_stem(F.col("text")).alias("stem"), t.restored_point(F.lit("К12"), tall, dots).alias("pointed"), t.short_id(F.col("text_id")).alias("short"),
        t.resolution(kind, F.pmod("text_id", F.lit(2)) == 0, F.lit("R1")).alias("note"),
    )


_SPELLED = "text"
for _from, _to in {**t.SPELLING, **{k.upper(): v.capitalize() for k, v in t.SPELLING.items()}}.items():
    _SPELLED = f"replace({_SPELLED}, '{_from}', '{_to}')"
FILE_STEMS = f"""with s as (select text_id, trim(regexp_replace({_SPELLED}, '[^0-9A-Za-z._ -]+', '_', 'g'), ' ._-') as stem from v_texts)
select text_id, case when stem = '' then 'sheet' else stem end as stem, case when text_id % 4 = 2 then 'K1.2' else 'К12' end as pointed, md5(cast(text_id as varchar))[:12] as short,
  case text_id % 3 when 0 then 'corrected_text=R1' when 1 then 'rag_connected=' || case when text_id % 2 = 0 then 'True' else 'False' end else 'connected=' || case when text_id % 2 = 0 then 'True' else 'False' end end as note from s"""


def weights_origin(spark, sf):
    s = view(spark, sf, "v_sheets")
    mod = lambda n: F.pmod("sheet_id", F.lit(n))
    path, origin = registry.weights_of(F.when(mod(3) == 0, "own.pt").when(mod(3) == 1, ""), F.when(mod(4) != 0, "v.pt"), F.lit("v000002"), mod(5) != 0)
    return s.select("sheet_id", path.alias("path"), origin.alias("origin"))


WEIGHTS_ORIGIN = """select sheet_id, case when sheet_id % 3 = 0 then 'own.pt' when sheet_id % 4 <> 0 and sheet_id % 5 <> 0 then 'v.pt' end as path,
  case when sheet_id % 3 = 0 then 'config' when sheet_id % 4 <> 0 and sheet_id % 5 <> 0 then 'registry v000002' else 'none' end as origin from v_sheets"""


def split_counts(spark, sf):
    return datasets.split_exactly(view(spark, sf, "v_sheets").select("sheet_id"), "sheet_id")


SPLIT_COUNTS = """with h as (select sheet_id, cast('0x' || md5(cast(sheet_id as varchar))[:8] as bigint) as h from v_sheets), r as (select sheet_id, row_number() over (order by h, sheet_id) as n from h)
select sheet_id, case when n <= (select cast(floor(count(*) * 0.8) as bigint) from h) then 'train' else 'val' end as split from r"""


def val_fallback(spark, sf):
    d = view(spark, sf, "v_detections").select(F.pmod("det_id", F.lit(5)).alias("source"), "det_id", F.when((F.pmod("det_id", F.lit(5)) > 1) & (F.pmod("det_id", F.lit(7)) == 0), "val").otherwise("train").alias("split"))
    return datasets.val_or_train(d)


VAL_FALLBACK = """with d as (select det_id % 5 as source, det_id, case when det_id % 5 > 1 and det_id % 7 = 0 then 'val' else 'train' end as split from v_detections)
select * from d union all select source, det_id, 'val' from d where source <= 1"""


def coco_lists(spark, sf):
    images = view(spark, sf, "v_sheets").select(F.col("sheet_id").alias("image_id"), F.format_string("sheet_%d.png", "sheet_id").alias("file_name"), "width", "height")
    boxes = view(spark, sf, "v_detections").select(F.col("sheet_id").alias("image_id"), "det_id", F.substring("category", 1, 1).cast("int").alias("class_id"), "x0", "y0", "x1", "y1")
    classes = boxes.select("class_id", F.concat(F.lit("c"), F.col("class_id").cast("string")).alias("class_name")).distinct()
    parts = datasets.coco_document(images, boxes, classes)
    row = lambda name, text: parts[name].select(F.lit(name).alias("list"), F.col("id").cast("long").alias("id"), text.alias("value"))
    return row("images", F.format_string("%s %d %d", "file_name", "width", "height")).unionByName(row("categories", F.col("name"))).unionByName(row("annotations", F.format_string("%d %d %d", "image_id", "category_id", "area")))


COCO_LISTS = """select 'images' as list, sheet_id as id, printf('sheet_%d.png %d %d', sheet_id, width, height) as value from v_sheets
union all select distinct 'categories', cast(category[:1] as bigint), 'c' || category[:1] from v_detections
union all select 'annotations', row_number() over (order by sheet_id, det_id), printf('%d %d %d', sheet_id, cast(category[:1] as int), cast(x1 - x0 as bigint) * (y1 - y0)) from v_detections"""

_HITS = """with n as (select vec_id, label, embedding::double[] as v from embeddings),
s as (select q.vec_id as query, e.vec_id as neighbour, e.label, round(list_dot_product(q.v, e.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(e.v, e.v)), 6) as score
  from n q join n e on q.vec_id <> e.vec_id where q.vec_id % 50 = 0),
h as (select *, row_number() over (partition by query order by score desc, neighbour) as rank from s)"""


def connection_votes(spark, sf):
    e = table(spark, sf, "embeddings")
    hits = knn.search(e, e.where("vec_id % 50 = 0"), 5)
    names = e.select("vec_id", F.element_at(F.array(*map(F.lit, ("Junction dot", "crossing", "connected", "crossing_none"))), (F.pmod(F.col("label"), F.lit(4)) + 1).cast("int")).alias("label"))
    named = knn.with_entries(hits, names.where("vec_id % 9 <> 0"))
    voted = knn.connection_vote(named, "Is there a junction here?")
    return voted.select("query", "votes", "connected", F.round("confidence", 4).alias("confidence"))


CONNECTION_VOTES = _HITS + """ select query, count(*) filter (neighbour % 9 <> 0 and label % 4 in (0, 2)) as votes, 2 * count(*) filter (neighbour % 9 <> 0 and label % 4 in (0, 2)) > count(*) as connected,
  round(least(0.95, avg(score) + 0.2), 4) as confidence from h where rank <= 5 group by query"""


def store_counts(spark, sf):
    return knn.store_stats(table(spark, sf, "embeddings"))


STORE_COUNTS = "select label, count(*) as n from embeddings group by rollup(label)"


def hidden_nodes(spark, sf):
    s = view(spark, sf, "v_segments")
    name = lambda x, y: F.concat(F.when(F.pmod(F.col(x) / 50, F.lit(3)) == 0, "#").otherwise(""), F.format_string("%06d", "sheet_id"), F.lit("_"), F.col(x).cast("string"), F.lit("_"), F.col(y).cast("string"))
    from wireloom.plans.netlist import truth_nets

    return truth_nets(s.select(name("sx", "sy").alias("a"), name("ex", "ey").alias("b"))).select(F.array_join("refs", ",").alias("refs"))


_HIDDEN = lambda s: f"case when {s}x / 50 % 3 = 0 then '#' else '' end || printf('%06d', sheet_id) || '_' || {s}x || '_' || {s}y"
HIDDEN_NODES = f"""with recursive e as (select distinct {_HIDDEN('s')} as a, {_HIDDEN('e')} as b from v_segments), n as (select a, b from e union select b, a from e),
r as (select a as node, a as other from n union select r.node, n.b from r join n on n.a = r.other), c as (select node, min(other) as c from r group by node),
g as (select c, string_agg(node, ',' order by node) as refs, count(*) as n from c where node[:1] <> '#' group by c)
select refs from g where n >= 2"""

ENTRIES = {
    "segment_labels": (segment_labels, SEGMENT_LABELS),
    "point_labels": (point_labels, POINT_LABELS),
    "pin_dedupe": (pin_dedupe, PIN_DEDUPE),
    "note_defaults": (note_defaults, NOTE_DEFAULTS),
    "second_look": (second_look, SECOND_LOOK),
    "numbers_by_kind": (numbers_by_kind, NUMBERS_BY_KIND),
    "points_to_nodes": (points_to_nodes, POINTS_TO_NODES),
    "pin_bridges": (pin_bridges, PIN_BRIDGES),
    "table_neighbours": (table_neighbours, TABLE_NEIGHBOURS),
    "segment_touch": (segment_touch, SEGMENT_TOUCH),
    "segment_scalars": (segment_scalars, SEGMENT_SCALARS),
    "moved_boxes": (moved_boxes, MOVED_BOXES),
    "annotation_stats": (annotation_stats, ANNOTATION_STATS),
    "class_recall": (class_recall, CLASS_RECALL),
    "false_positives": (false_positives, FALSE_POSITIVES),
    "sheet_scores": (sheet_scores, SHEET_SCORES),
    "bench_rollup": (bench_rollup, BENCH_ROLLUP),
    "worst_sheets": (worst_sheets, WORST_SHEETS),
    "designator_scores": (designator_scores, DESIGNATOR_SCORES),
    "symmetric_refs": (symmetric_refs, SYMMETRIC_REFS),
    "report_counts": (report_counts, REPORT_COUNTS),
    "training_stats": (training_stats, TRAINING_STATS),
    "plan_bounds": (plan_bounds, PLAN_BOUNDS),
    "graph_view": (graph_view, GRAPH_VIEW),
    "layered_graph": (layered_graph, LAYERED_GRAPH),
    "old_tiles": (old_tiles, OLD_TILES),
    "large_visible": (large_visible, LARGE_VISIBLE),
    "sure_crops": (sure_crops, SURE_CROPS),
    "file_stems": (file_stems, FILE_STEMS),
    "weights_origin": (weights_origin, WEIGHTS_ORIGIN),
    "split_counts": (split_counts, SPLIT_COUNTS),
    "val_fallback": (val_fallback, VAL_FALLBACK),
    "coco_lists": (coco_lists, COCO_LISTS),
    "connection_votes": (connection_votes, CONNECTION_VOTES),
    "store_counts": (store_counts, STORE_COUNTS),
    "hidden_nodes": (hidden_nodes, HIDDEN_NODES),
}
ORACLES = {k: sql(s) for k, (_, s) in ENTRIES.items() if s}
