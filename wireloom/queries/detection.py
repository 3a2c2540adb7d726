"""Queries over boxes: scalars, spatial joins, suppression, tiles, matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from wireloom.functions import geometry as g
from wireloom.operators import greedy, spatial, tiling
from wireloom.plans import components, evaluate
from wireloom.queries.views import sql, view
from wireloom.schema import CLASS_PREFIXES, class_prefixes


def _side(df, side, key):
    return df.select("sheet_id", F.col(key).alias(f"{side}_id"), *(F.col(c).alias(f"{side}_{c}") for c in ("x0", "y0", "x1", "y1")))


def box_scalars(spark, sf):
    d = view(spark, sf, "v_detections")
    b = g.box()
    return d.select(
        "det_id",
        g.floor_centre(b[0], b[2]).alias("cx"),
        g.floor_centre(b[1], b[3]).alias("cy"),
        g.centre(b[0], b[2]).alias("fx"),
        g.area(b).alias("area"),
        F.round(g.distance_to_box(F.lit(500), F.lit(350), b), 4).alias("distance"),
        g.nearest_edge(b[0] + F.pmod("det_id", F.lit(3)).cast("int"), b[1] + 9, b).alias("edge"),
    )


BOX_SCALARS = """select det_id, cast(floor((x0 + x1) / 2.0) as int) as cx, cast(floor((y0 + y1) / 2.0) as int) as cy, (x0 + x1) / 2.0 as fx,
  cast(x1 - x0 as bigint) * (y1 - y0) as area,
  round(sqrt(cast(pow(greatest(x0 - 500, 0, 500 - x1), 2) + pow(greatest(y0 - 350, 0, 350 - y1), 2) as double)), 4) as distance,
  case when det_id % 3 <= 1 then 'left' end as edge from v_detections"""


def iou_pairs(spark, sf):
    d = view(spark, sf, "v_detections")
    a, b = _side(d, "a", "det_id"), _side(d, "b", "det_id")
    on = lambda: (F.col("a_id") < F.col("b_id")) & (g.intersection(g.box("a_"), g.box("b_")) > 0)
    pairs = spatial.spatial_join(a, b, ["sheet_id"], on)
    shared = g.intersection(g.box("a_"), g.box("b_"))
    return pairs.select("sheet_id", "a_id", "b_id", shared.alias("shared"), (g.area(g.box("a_")) + g.area(g.box("b_")) - shared).alias("joint"), F.round(g.iou(g.box("a_"), g.box("b_")), 6).alias("iou"))


_SHARED = "(cast(least(a.x1, b.x1) - greatest(a.x0, b.x0) as bigint) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)))"
_MEET = "least(a.x1, b.x1) > greatest(a.x0, b.x0) and least(a.y1, b.y1) > greatest(a.y0, b.y0)"
_AREA = "(cast({0}.x1 - {0}.x0 as bigint) * ({0}.y1 - {0}.y0))"
IOU_PAIRS = f"""with p as (select a.sheet_id, a.det_id as a_id, b.det_id as b_id, {_SHARED} as shared, {_AREA.format('a')} + {_AREA.format('b')} as both_areas
  from v_detections a join v_detections b on a.sheet_id = b.sheet_id and a.det_id < b.det_id and {_MEET})
select sheet_id, a_id, b_id, shared, both_areas - shared as joint, round(shared / (both_areas - shared), 6) as iou from p"""


def overlap_semi(spark, sf):
    d = view(spark, sf, "v_detections")
    a, b = _side(d.where("source = 'model'"), "a", "det_id"), _side(d.where("source = 'template'"), "b", "det_id")
    out = spatial.spatial_join(a, b, ["sheet_id"], lambda: g.intersection(g.box("a_"), g.box("b_")) > 0, 64, 0, "left_semi")
    return out.select("sheet_id", F.col("a_id").alias("det_id"))


OVERLAP_SEMI = f"select a.sheet_id, a.det_id from v_detections a where a.source = 'model' and exists (select 1 from v_detections b where b.sheet_id = a.sheet_id and b.source = 'template' and {_MEET})"


def overlap_anti_merge(spark, sf):
    d = view(spark, sf, "v_detections")
    out = components.merge_detections(d.where("source = 'model'"), d.where("source = 'template'"))
    return out.select("sheet_id", "det_id", "source")


OVERLAP_ANTI_MERGE = f"""select sheet_id, det_id, source from v_detections where source = 'model' union all
select a.sheet_id, a.det_id, a.source from v_detections a where a.source = 'template' and not exists (select 1 from v_detections b
  where b.sheet_id = a.sheet_id and b.source = 'model' and {_MEET} and 2 * {_SHARED} > least({_AREA.format('a')}, {_AREA.format('b')}))"""


def _fold(order: str, keys: str, table: str, fields: str, conflict: str, where: str = "true") -> str:
    """A greedy fold in SQL: rows by rank, what is kept so far in a list."""
    pack = ", ".join(f"'{f}': d.{f}" for f in fields.split(", "))
    on = " and ".join(f"d.{k} = f.{k}" for k in keys.split(", "))
    return f"""with recursive d as (select *, row_number() over (partition by {keys} order by {order}) as rk from {table} where {where}),
f as (select {', '.join('d.' + k for k in keys.split(', '))}, d.rk, [{{{pack}}}] as kept from d where rk = 1
  union all
  select {', '.join('f.' + k for k in keys.split(', '))}, d.rk, case when len(list_filter(f.kept, lambda k: {conflict})) > 0 then f.kept else list_append(f.kept, {{{pack}}}) end
  from f join d on {on} and d.rk = f.rk + 1),
l as (select {keys}, unnest(max_by(kept, rk)) as k from f group by {keys})"""


_KX = "(least(k.x1, d.x1) > greatest(k.x0, d.x0) and least(k.y1, d.y1) > greatest(k.y0, d.y0) and "
_KS = "(cast(least(k.x1, d.x1) - greatest(k.x0, d.x0) as bigint) * (least(k.y1, d.y1) - greatest(k.y0, d.y0)))"
_KA = "((k.x1 - k.x0) * (k.y1 - k.y0))"
_DA = "((d.x1 - d.x0) * (d.y1 - d.y0))"


def nms_agnostic(spark, sf):
    return greedy.suppress_any_class(view(spark, sf, "v_detections")).select("sheet_id", "det_id")


NMS_AGNOSTIC = _fold("confidence desc, det_id", "sheet_id", "v_detections", "det_id, x0, y0, x1, y1", f"{_KX} 100 * {_KS} >= 45 * ({_KA} + {_DA} - {_KS}))") + " select sheet_id, k.det_id as det_id from l"


def nms_per_class(spark, sf):
    return greedy.suppress_per_class(view(spark, sf, "v_detections")).select("sheet_id", "category", "det_id")


NMS_PER_CLASS = (
    _fold("confidence desc, det_id", "sheet_id, category", "v_detections", "det_id, x0, y0, x1, y1", f"{_KX} (2 * {_KS} > {_KA} + {_DA} - {_KS} or 5 * {_KS} > 4 * least({_KA}, {_DA})))")
    + " select sheet_id, category, k.det_id as det_id from l"
)


def text_dedupe(spark, sf):
    t = view(spark, sf, "v_detections").select("sheet_id", F.col("det_id").alias("text_id"), F.col("category").alias("text"), "x0", "y0", "x1", "y1", "confidence")
    return greedy.drop_repeated_texts(t).select("sheet_id", "text", "text_id", "confidence")


TEXT_DEDUPE = _fold("confidence desc, det_id", "sheet_id, category", "v_detections", "det_id, confidence, x0, y0, x1, y1", f"{_KX} 2 * {_KS} >= {_KA} + {_DA} - {_KS})") + " select sheet_id, category as text, k.det_id as text_id, k.confidence as confidence from l"


def tile_grid(spark, sf):
    return tiling.tile_grid(view(spark, sf, "v_sheets"))


TILE_GRID = """with xs as (select sheet_id, unnest(case when width <= 1024 then [0] else list_distinct(list_concat(range(0, width - 1024 + 1, 819), [width - 1024])) end) as x0, width from v_sheets),
ys as (select sheet_id, unnest(case when height <= 1024 then [0] else list_distinct(list_concat(range(0, height - 1024 + 1, 819), [height - 1024])) end) as y0, height from v_sheets)
select xs.sheet_id, row_number() over (partition by xs.sheet_id order by y0, x0) - 1 as tile_id, cast(x0 as int) as x0, cast(y0 as int) as y0,
  cast(least(x0 + 1024, width) as int) as x1, cast(least(y0 + 1024, height) as int) as y1 from xs join ys using (sheet_id)"""


def tile_visibility(spark, sf):
    d = view(spark, sf, "v_detections")
    sheets = d.groupBy("sheet_id").agg(F.max("x1").alias("width"), F.max("y1").alias("height"))
    tiles = tiling.tile_grid(sheets, 256, 0.2)
    return tiling.visible_in_tiles(tiles, d)


TILE_VISIBILITY = """with s as (select sheet_id, max(x1) as width, max(y1) as height from v_detections group by 1),
xs as (select sheet_id, unnest(case when width <= 256 then [0] else list_distinct(list_concat(range(0, width - 256 + 1, 204), [width - 256])) end) as x0, width from s),
ys as (select sheet_id, unnest(case when height <= 256 then [0] else list_distinct(list_concat(range(0, height - 256 + 1, 204), [height - 256])) end) as y0, height from s),
t as (select xs.sheet_id, row_number() over (partition by xs.sheet_id order by y0, x0) - 1 as tile_id, x0, y0, least(x0 + 256, width) as x1, least(y0 + 256, height) as y1 from xs join ys using (sheet_id))
select a.sheet_id, a.tile_id, b.det_id, cast(greatest(a.x0, b.x0) - a.x0 as int) as x0, cast(greatest(a.y0, b.y0) - a.y0 as int) as y0,
  cast(least(a.x1, b.x1) - a.x0 as int) as x1, cast(least(a.y1, b.y1) - a.y0 as int) as y1
from t a join v_detections b on a.sheet_id = b.sheet_id and """ + _MEET + " and 10 * " + _SHARED + " >= 6 * " + _AREA.format("b")


def greedy_match(spark, sf):
    return evaluate.match_components(view(spark, sf, "v_detections"), view(spark, sf, "v_truth")).select("sheet_id", "det_id", "truth_id")


GREEDY_MATCH = f"""with recursive p as (select a.sheet_id, a.det_id, b.truth_id, {_SHARED} / ({_AREA.format('a')} + {_AREA.format('b')} - {_SHARED}) as iou
  from v_detections a join v_truth b on a.sheet_id = b.sheet_id and a.category = b.category and {_MEET} and 2 * {_SHARED} >= {_AREA.format('a')} + {_AREA.format('b')} - {_SHARED}),""" + _fold(
    "det_id, iou desc, truth_id desc", "sheet_id", "p", "det_id, truth_id", "k.det_id = d.det_id or k.truth_id = d.truth_id"
).replace("with recursive", "") + " select sheet_id, k.det_id as det_id, k.truth_id as truth_id from l"


def component_numbering(spark, sf):
    d = view(spark, sf, "v_detections")
    prefixes = spark.createDataFrame([("1-URGENT", "K"), ("2-HIGH", "R"), ("3-MEDIUM", "R")], "category string, prefix string")
    return components.number_components(d, prefixes)


COMPONENT_NUMBERING = """with n as (select sheet_id, det_id, round_even(floor((y0 + y1) / 2.0) / 40.0, 0) as r, floor((x0 + x1) / 2.0) as cx,
  case category when '1-URGENT' then 'K' when '2-HIGH' then 'R' when '3-MEDIUM' then 'R' else 'U' end as prefix from v_detections)
select sheet_id, det_id, printf('comp_%03d', row_number() over (partition by sheet_id order by r, cx, det_id)) as id,
  concat(prefix, row_number() over (partition by sheet_id, prefix order by r, cx, det_id)) as designator from n"""


def renumber_free(spark, sf):
    d = view(spark, sf, "v_detections").select("sheet_id", F.col("category").alias("prefix"), F.col("det_id").alias("id"))
    taken = d.where("id % 3 = 0").select("sheet_id", "prefix", (F.pmod("id", F.lit(40)) + 1).cast("int").alias("number"))
    return components.renumber_free(d.where("id % 3 <> 0"), taken).select("sheet_id", "prefix", "id", "number")


RENUMBER_FREE = """with w as (select sheet_id, category as prefix, det_id as id, row_number() over (partition by sheet_id, category order by det_id) as k from v_detections where det_id % 3 <> 0),
t as (select distinct sheet_id, category as prefix, cast(det_id % 40 + 1 as int) as number from v_detections where det_id % 3 = 0),
c as (select sheet_id, prefix, unnest(range(1, 401)) as number from (select distinct sheet_id, prefix from w)),
f as (select sheet_id, prefix, number, row_number() over (partition by sheet_id, prefix order by number) as k from c anti join t using (sheet_id, prefix, number))
select w.sheet_id, w.prefix, w.id, cast(f.number as int) as number from w join f using (sheet_id, prefix, k)"""


def _components(spark, sf):
    names = F.create_map(*(F.lit(x) for i, n in enumerate(sorted(CLASS_PREFIXES)) for x in (i, n)))
    d = view(spark, sf, "v_detections")
    return d.select("sheet_id", F.col("det_id").alias("comp_id"), names[F.pmod("det_id", F.lit(len(CLASS_PREFIXES))).cast("int")].alias("category"), "x0", "y0", "x1", "y1")


def assign_designators(spark, sf):
    return components.assign_designators(_components(spark, sf), view(spark, sf, "v_texts"), class_prefixes(spark))


_PREFIX_ROWS = ", ".join(f"({i}, '{p}', {r})" for i, n in enumerate(sorted(CLASS_PREFIXES)) for r, p in enumerate(CLASS_PREFIXES[n]))
ASSIGN_DESIGNATORS = f"""with recursive names(text, designator, prefix) as (values ('R1', 'R1', 'R'), ('VD1', 'VD1', 'VD'), ('K1,1', 'K1.1', 'K'), ('С1', 'C1', 'C'), ('ЕL2', 'EL2', 'EL'), ('R l', 'R1', 'R'), ('SA 1', 'SA1', 'SA'), ('X1', 'X1', 'X'), ('x1', 'X1', 'X')),
codes(class_no, prefix, code_rank) as (values {_PREFIX_ROWS}),
q as (select c.sheet_id, c.det_id as comp_id, t.text_id, n.designator, o.code_rank, greatest(60.0, 0.8 * greatest(c.x1 - c.x0, c.y1 - c.y0), 3.0 * greatest(1, t.y1 - t.y0)) as reach,
  sqrt(pow(greatest(c.x0 - (t.x0 + t.x1) / 2.0, 0.0, (t.x0 + t.x1) / 2.0 - c.x1), 2) + pow(greatest(c.y0 - (t.y0 + t.y1) / 2.0, 0.0, (t.y0 + t.y1) / 2.0 - c.y1), 2)) as distance
  from v_detections c join codes o on o.class_no = c.det_id % {len(CLASS_PREFIXES)} join v_texts t on t.sheet_id = c.sheet_id join names n on n.text = t.text and n.prefix = o.prefix),
p as (select sheet_id, comp_id, text_id, designator, distance, distance + 4.0 * code_rank as cost from q where distance <= reach),""" + _fold(
    "cost, distance, text_id, comp_id", "sheet_id", "p", "comp_id, text_id, designator, distance", "k.text_id = d.text_id or k.comp_id = d.comp_id or k.designator = d.designator"
).replace("with recursive", "") + " select sheet_id, k.comp_id as comp_id, k.text_id as text_id, k.designator as designator, round_even(k.distance, 1) as distance from l"


def text_association(spark, sf):
    return components.associate_texts(view(spark, sf, "v_texts"), view(spark, sf, "v_detections").withColumnRenamed("det_id", "comp_id"))


TEXT_ASSOCIATION = """with t as (select sheet_id, text_id, text, floor((x0 + x1) / 2.0) as x, floor((y0 + y1) / 2.0) as y from v_texts),
c as (select sheet_id, det_id, floor((x0 + x1) / 2.0) as x, floor((y0 + y1) / 2.0) as y from v_detections),
n as (select t.sheet_id, text_id, text, det_id, row_number() over (partition by t.sheet_id, text_id order by pow(t.x - c.x, 2) + pow(t.y - c.y, 2), det_id) as k
  from t join c on t.sheet_id = c.sheet_id and pow(t.x - c.x, 2) + pow(t.y - c.y, 2) < 2500)
select sheet_id, det_id as comp_id, max(text_id) as text_id, max_by(text, text_id) as text from n where k = 1 group by 1, 2"""


def labels_in_box(spark, sf):
    d = view(spark, sf, "v_detections")
    b = g.box()
    boxes = d.select("sheet_id", F.col("det_id").alias("a_id"), g.floor_centre(b[0], b[2]).alias("a_x"), g.floor_centre(b[1], b[3]).alias("a_y"))
    texts = view(spark, sf, "v_texts").select("sheet_id", F.col("text_id").alias("b_id"), "text", g.floor_centre(b[0], b[2]).alias("b_x"), g.floor_centre(b[1], b[3]).alias("b_y"))
    return spatial.nearest(boxes, texts, ["sheet_id"], 100, 10).select("sheet_id", F.col("a_id").alias("det_id"), F.col("b_id").alias("text_id"), "d2", "nth")


LABELS_IN_BOX = """with a as (select sheet_id, det_id, cast(floor((x0 + x1) / 2.0) as int) as x, cast(floor((y0 + y1) / 2.0) as int) as y from v_detections),
b as (select sheet_id, text_id, cast(floor((x0 + x1) / 2.0) as int) as x, cast(floor((y0 + y1) / 2.0) as int) as y from v_texts),
p as (select a.sheet_id, det_id, text_id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) as d2 from a join b on a.sheet_id = b.sheet_id),
r as (select *, row_number() over (partition by sheet_id, det_id order by d2, text_id) as nth from p where d2 <= 10000)
select * from r where nth <= 10"""


def knn_points(spark, sf):
    s = view(spark, sf, "v_segments").select("sheet_id", F.col("segment_id").alias("a_id"), F.col("sx").alias("a_x"), F.col("sy").alias("a_y"))
    p = view(spark, sf, "v_pins").select("sheet_id", F.col("pin_number").cast("bigint").alias("b_id"), F.col("x").alias("b_x"), F.col("y").alias("b_y"))
    return spatial.nearest(s, p, ["sheet_id"], 150, 3).select("sheet_id", F.col("a_id").alias("segment_id"), F.col("b_id").alias("pin"), "d2", "nth")


KNN_POINTS = """with p as (select s.sheet_id, segment_id, cast(pin_number as bigint) as pin, (sx - x) * (sx - x) + (sy - y) * (sy - y) as d2 from v_segments s join v_pins using (sheet_id)),
r as (select *, row_number() over (partition by sheet_id, segment_id order by d2, pin) as nth from p where d2 <= 22500) select * from r where nth <= 3"""

ENTRIES = {
    "box_scalars": (box_scalars, BOX_SCALARS),
    "iou_pairs": (iou_pairs, IOU_PAIRS),
    "overlap_semi": (overlap_semi, OVERLAP_SEMI),
    "overlap_anti_merge": (overlap_anti_merge, OVERLAP_ANTI_MERGE),
    "nms_agnostic": (nms_agnostic, NMS_AGNOSTIC),
    "nms_per_class": (nms_per_class, NMS_PER_CLASS),
    "text_dedupe": (text_dedupe, TEXT_DEDUPE),
    "tile_grid": (tile_grid, TILE_GRID),
    "tile_visibility": (tile_visibility, TILE_VISIBILITY),
    "greedy_match": (greedy_match, GREEDY_MATCH),
    "component_numbering": (component_numbering, COMPONENT_NUMBERING),
    "renumber_free": (renumber_free, RENUMBER_FREE),
    "assign_designators": (assign_designators, ASSIGN_DESIGNATORS),
    "text_association": (text_association, TEXT_ASSOCIATION),
    "labels_in_box": (labels_in_box, LABELS_IN_BOX),
    "knn_points": (knn_points, KNN_POINTS),
}
ORACLES = {k: sql(s) for k, (_, s) in ENTRIES.items() if s}
