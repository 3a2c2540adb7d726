"""Queries over what is known of sheets before nets are made."""

from __future__ import annotations

from pyspark.sql import functions as F

from wireloom.plans import sheets
from wireloom.queries.views import sql, view
from wireloom.schema import SYMBOLS

_CONNECTOR, _PIN, _DOT = "'1-URGENT'", "'2-HIGH'", "'3-MEDIUM'"


def _kind(spark, sf, priority):
    return view(spark, sf, "v_detections").where(f"category = {priority}")


def sheet_clean(spark, sf):
    """Detections of known classes inside an 1000 x 600 sheet, without those that hold wires."""
    d = view(spark, sf, "v_detections")
    names = F.create_map(*(F.lit(x) for s in SYMBOLS for x in (s[0], s[1])))
    d = d.withColumn("category", F.coalesce(names[F.pmod("det_id", F.lit(40)).cast("int")], F.lit("no such class")))
    frame = d.select("sheet_id").distinct().withColumns({"width": F.lit(1000), "height": F.lit(600)})
    classes = spark.createDataFrame([(s[1],) for s in SYMBOLS], "class_name string")
    return sheets.wire_exclusions(sheets.clean_detections(d, frame, classes)).select("sheet_id", "det_id", "x0", "y0", "x1", "y1", "confidence")


SHEET_CLEAN = f"""with c as (select sheet_id, det_id, least(x0, 1000) as x0, least(y0, 600) as y0, least(x1, 1000) as x1, least(y1, 600) as y1, round_even(confidence, 3) as confidence
  from v_detections where det_id % 40 < {len(SYMBOLS)} and det_id % 40 not in (2, 32))
select * from c where x1 > x0 and y1 > y0"""


def edge_pins(spark, sf):
    d = view(spark, sf, "v_detections")
    owners = d.select("sheet_id", F.col("det_id").cast("string").alias("comp_id"), "category", "x0", "y0", "x1", "y1")
    pins = d.select("sheet_id", F.col("det_id").cast("string").alias("component_id"), F.lit("1").alias("pin_number"), (F.col("x0") + F.pmod("det_id", F.lit(9)).cast("int")).alias("x"), (F.col("y0") + 10).alias("y"))
    return sheets.shift_edge_pins(pins, owners, 6).select("sheet_id", "component_id", "x", "y")


EDGE_PINS = """select sheet_id, cast(det_id as string) as component_id, cast(case when det_id % 9 <= 3 then greatest(0, x0 + det_id % 9 - 6) else x0 + det_id % 9 end as int) as x, y0 + 10 as y from v_detections"""

_D2 = "(cast(floor((a.x0 + a.x1) / 2.0) as bigint) - cast(floor((b.x0 + b.x1) / 2.0) as bigint)) ** 2 + (cast(floor((a.y0 + a.y1) / 2.0) as bigint) - cast(floor((b.y0 + b.y1) / 2.0) as bigint)) ** 2"


def connector_pins(spark, sf):
    return sheets.connector_pins(_kind(spark, sf, _CONNECTOR), _kind(spark, sf, _PIN), 90.0)


CONNECTOR_PINS = f"""with p as (select a.sheet_id, a.det_id, b.det_id as pin_id, {_D2} as d2 from v_detections a join v_detections b on a.sheet_id = b.sheet_id and a.category = {_CONNECTOR} and b.category = {_PIN}),
n as (select *, row_number() over (partition by sheet_id, det_id order by d2, pin_id) as k from p where d2 < 8100)
select sheet_id, det_id, pin_id, cast(k as string) as pin_number from n where k <= 10"""


def connector_pins_once(spark, sf):
    return sheets.connector_pins_once(_kind(spark, sf, _CONNECTOR), _kind(spark, sf, _PIN))


CONNECTOR_PINS_ONCE = f"select a.sheet_id, b.det_id as pin_id, min(a.det_id) as det_id from v_detections a join v_detections b on a.sheet_id = b.sheet_id and a.category = {_CONNECTOR} and b.category = {_PIN} and {_D2} < 22500 group by 1, 2"


def junction_issues(spark, sf):
    d = view(spark, sf, "v_segments").select("sheet_id", F.col("sx").alias("x"), F.col("sy").alias("y")).distinct()
    return sheets.junctions_without_dot(d, _kind(spark, sf, _DOT))


JUNCTION_ISSUES = f"""select distinct s.sheet_id, s.sx as x, s.sy as y from v_segments s where not exists (select 1 from v_detections b where b.sheet_id = s.sheet_id and b.category = {_DOT}
  and abs(cast(floor((b.x0 + b.x1) / 2.0) as int) - s.sx) < 15 and abs(cast(floor((b.y0 + b.y1) / 2.0) as int) - s.sy) < 15)"""


def isolated_segments(spark, sf):
    return sheets.drop_isolated(view(spark, sf, "v_segments"), view(spark, sf, "v_detections"), 120.0, 2).select("sheet_id", "segment_id")


_HIT = "(b.x0 - 2 <= {0}x and {0}x <= b.x1 + 2 and b.y0 - 2 <= {0}y and {0}y <= b.y1 + 2)"
_BY = "({0}x between o.sx - 4 and o.ex + 4 and {0}y between o.sy - 4 and o.ey + 4 and pow(greatest(o.sx - {0}x, 0, {0}x - o.ex), 2) + pow(greatest(o.sy - {0}y, 0, {0}y - o.ey), 2) <= 16)"
ISOLATED_SEGMENTS = f"""select s.sheet_id, s.segment_id from (select *, sx as ax, sy as ay, ex as zx, ey as zy from v_segments) s where ex - sx + ey - sy >= 120
  or exists (select 1 from v_detections b where b.sheet_id = s.sheet_id and ({_HIT.format('s.a')} or {_HIT.format('s.z')}))
  or exists (select 1 from v_segments o where o.sheet_id = s.sheet_id and o.segment_id <> s.segment_id and ({_BY.format('s.a')} or {_BY.format('s.z')}))"""


def merged_boxes(spark, sf):
    return sheets.merge_touching(view(spark, sf, "v_detections"), 0)


def texts_over_symbols(spark, sf):
    return sheets.drop_under_texts(view(spark, sf, "v_detections"), view(spark, sf, "v_texts")).select("sheet_id", "det_id")


def scale_score(spark, sf):
    d = view(spark, sf, "v_detections").select("sheet_id", F.pmod("det_id", F.lit(7)).alias("scale"), "category", F.col("confidence").alias("score"))
    return sheets.scale_score(d).select("sheet_id", "scale", F.round("score", 6).alias("score"))


SCALE_SCORE = """with b as (select sheet_id, det_id % 7 as scale, category, max(confidence) as score from v_detections group by all)
select sheet_id, scale, round(sum(score - 0.62 + 0.05), 6) as score from b group by 1, 2"""


def layout_conflicts(spark, sf):
    return sheets.layout_conflicts(view(spark, sf, "v_detections"), view(spark, sf, "v_segments"))


LAYOUT_CONFLICTS = """select a.sheet_id, 'overlap' as kind, a.det_id as a, b.det_id as b from v_detections a join v_detections b on a.sheet_id = b.sheet_id and a.det_id < b.det_id
  and a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1
union all select s.sheet_id, 'wire_through_box', s.segment_id, b.det_id from v_segments s join v_detections b on s.sheet_id = b.sheet_id and s.sx < b.x1 and b.x0 < s.ex and s.sy < b.y1 and b.y0 < s.ey"""

ENTRIES = {
    "sheet_clean": (sheet_clean, SHEET_CLEAN),
    "edge_pins": (edge_pins, EDGE_PINS),
    "connector_pins": (connector_pins, CONNECTOR_PINS),
    "connector_pins_once": (connector_pins_once, CONNECTOR_PINS_ONCE),
    "junction_issues": (junction_issues, JUNCTION_ISSUES),
    "isolated_segments": (isolated_segments, ISOLATED_SEGMENTS),
    "merged_boxes": (merged_boxes, None),
    "texts_over_symbols": (texts_over_symbols, None),
    "scale_score": (scale_score, SCALE_SCORE),
    "layout_conflicts": (layout_conflicts, LAYOUT_CONFLICTS),
}
ORACLES = {k: sql(s) for k, (_, s) in ENTRIES.items() if s}
