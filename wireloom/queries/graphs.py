"""Queries over wires and pins."""

from __future__ import annotations

from pyspark.sql import functions as F

from wireloom.operators import greedy
from wireloom.operators.components import components
from wireloom.plans import netlist
from wireloom.queries.views import sql, view


def snap_endpoints(spark, sf):
    return netlist.snap_to_pins(view(spark, sf, "v_segments"), view(spark, sf, "v_pins"), 15.0).select("sheet_id", "segment_id", "sx", "sy", "ex", "ey")


SNAP_ENDPOINTS = """with p as (select *, concat_ws(':', component_id, pin_number, cast(x as string), cast(y as string)) as id from v_pins),
s as (select sheet_id, segment_id, p.x, p.y, row_number() over (partition by sheet_id, segment_id order by (sx - p.x) * (sx - p.x) + (sy - p.y) * (sy - p.y), id) as k
  from v_segments join p using (sheet_id) where (sx - p.x) * (sx - p.x) + (sy - p.y) * (sy - p.y) <= 225),
e as (select sheet_id, segment_id, p.x, p.y, row_number() over (partition by sheet_id, segment_id order by (ex - p.x) * (ex - p.x) + (ey - p.y) * (ey - p.y), id) as k
  from v_segments join p using (sheet_id) where (ex - p.x) * (ex - p.x) + (ey - p.y) * (ey - p.y) <= 225)
select v.sheet_id, v.segment_id, coalesce(s.x, sx) as sx, coalesce(s.y, sy) as sy, coalesce(e.x, ex) as ex, coalesce(e.y, ey) as ey
from v_segments v left join s on s.sheet_id = v.sheet_id and s.segment_id = v.segment_id and s.k = 1
left join e on e.sheet_id = v.sheet_id and e.segment_id = v.segment_id and e.k = 1"""


def contained_segments(spark, sf):
    return greedy.drop_contained_segments(view(spark, sf, "v_segments")).select("sheet_id", "segment_id")


_LEN = "((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy))"
_ON = "(case when k.sx = k.ex then d.{0}x between k.sx - 2 and k.sx + 2 and d.{0}y between k.sy and k.ey else d.{0}y between k.sy - 2 and k.sy + 2 and d.{0}x between k.sx and k.ex end)"
CONTAINED_SEGMENTS = f"""with recursive d as (select *, row_number() over (partition by sheet_id order by {_LEN} desc, segment_id) as rk from v_segments),
f as (select sheet_id, rk, [{{'segment_id': segment_id, 'sx': sx, 'sy': sy, 'ex': ex, 'ey': ey}}] as kept from d where rk = 1
  union all
  select f.sheet_id, d.rk, case when len(list_filter(f.kept, lambda k: {_ON.format('s')} and {_ON.format('e')})) > 0 then f.kept
    else list_append(f.kept, {{'segment_id': d.segment_id, 'sx': d.sx, 'sy': d.sy, 'ex': d.ex, 'ey': d.ey}}) end
  from f join d on d.sheet_id = f.sheet_id and d.rk = f.rk + 1),
l as (select sheet_id, unnest(max_by(kept, rk)) as k from f group by sheet_id) select sheet_id, k.segment_id as segment_id from l"""


def canonical_points(spark, sf):
    p = view(spark, sf, "v_pins")
    return greedy.canonical_points(p.select("sheet_id", "x", "y"), 60.0)


CANONICAL_POINTS = """with recursive p as (select distinct sheet_id, x, y from v_pins), d as (select *, row_number() over (partition by sheet_id order by x, y) as rk from p),
f as (select sheet_id, rk, [{'x': x, 'y': y}] as kept from d where rk = 1
  union all
  select f.sheet_id, d.rk, case when len(list_filter(f.kept, lambda k: (k.x - d.x) * (k.x - d.x) + (k.y - d.y) * (k.y - d.y) <= 3600)) > 0 then f.kept else list_append(f.kept, {'x': d.x, 'y': d.y}) end
  from f join d on d.sheet_id = f.sheet_id and d.rk = f.rk + 1),
l as (select sheet_id, max_by(kept, rk) as kept from f group by sheet_id)
select d.sheet_id, d.x, d.y, list_filter(l.kept, lambda k: (k.x - d.x) * (k.x - d.x) + (k.y - d.y) * (k.y - d.y) <= 3600)[1].x as cx,
  list_filter(l.kept, lambda k: (k.x - d.x) * (k.x - d.x) + (k.y - d.y) * (k.y - d.y) <= 3600)[1].y as cy from d join l using (sheet_id)"""


def collinear_merge(spark, sf):
    s = view(spark, sf, "v_segments")
    n = F.col("pin_number").cast("long")
    pins = view(spark, sf, "v_pins").select("sheet_id", (F.pmod(n, F.lit(60)) * 10).cast("int").alias("x"), F.pmod(n, F.lit(6)).cast("int").alias("y"))
    line = s.withColumns({"sy": F.pmod("segment_id", F.lit(6)).cast("int"), "ey": F.pmod("segment_id", F.lit(6)).cast("int"), "sx": (F.pmod("segment_id", F.lit(60)) * 10).cast("int"), "ex": (F.pmod("segment_id", F.lit(60)) * 10 + 58 + F.pmod("segment_id", F.lit(5))).cast("int")})
    return netlist.merge_collinear(line, pins, 2.0).select("sheet_id", "sx", "sy", "ex", "ey", "confidence", "merged")


COLLINEAR_MERGE = """with p as (select distinct sheet_id, cast(pin_number as int) % 60 * 10 as x, cast(pin_number as int) % 6 as y from v_pins),
b as (select sheet_id, segment_id % 6 as line, segment_id % 60 * 10 as sx, segment_id % 60 * 10 + 58 + segment_id % 5 as ex, confidence from v_segments),
s as (select b.*, exists (select 1 from p where p.sheet_id = b.sheet_id and p.x = b.sx and p.y = b.line) as sp, exists (select 1 from p where p.sheet_id = b.sheet_id and p.x = b.ex and p.y = b.line) as ep from b),
g as (select *, case when sx - lag(ex) over (partition by sheet_id, line order by sx) between -2 and 2 and not sp and not lag(ep) over (partition by sheet_id, line order by sx) then 0 else 1 end as fresh from s),
i as (select *, sum(fresh) over (partition by sheet_id, line order by sx) as part from g)
select sheet_id, cast(min(sx) as int) as sx, cast(line as int) as sy, cast(max(ex) as int) as ex, cast(line as int) as ey, min(confidence) as confidence, cast(count(*) - 1 as int) as merged from i group by sheet_id, line, part"""


def components_cc(spark, sf):
    s = view(spark, sf, "v_segments")
    point = lambda x, y: F.concat_ws("_", F.format_string("%06d", "sheet_id"), x, y)
    return components(s.select(point("sx", "sy").alias("a"), point("ex", "ey").alias("b")))


_POINT = "concat_ws('_', printf('%06d', sheet_id), cast({0}x as string), cast({0}y as string))"
COMPONENTS_CC = f"""with recursive e as (select distinct {_POINT.format('s')} as a, {_POINT.format('e')} as b from v_segments),
n as (select a, b from e union select b, a from e),
r as (select a as node, a as other from n union select r.node, n.b from r join n on n.a = r.other)
select node, min(other) as component from r group by node"""


def graph_degree(spark, sf):
    nodes, edges = netlist.build_graph(view(spark, sf, "v_segments"), view(spark, sf, "v_pins"))
    return nodes.where("junction_type is not null").select("sheet_id", "node_id", "junction_type")


def net_extract(spark, sf):
    nodes, edges = netlist.build_graph(view(spark, sf, "v_segments"), view(spark, sf, "v_pins"))
    nets = netlist.extract_nets(nodes, edges)
    refs = F.array_join(F.transform("connections", lambda c: F.concat(c["component_id"], F.lit(":"), c["pin"])), " - ")
    return nets.select("sheet_id", "net_id", refs.alias("refs"), F.coalesce(F.size("wire_segments"), F.lit(0)).alias("n_wires"), F.coalesce(F.size("path_points"), F.lit(0)).alias("n_path"), "confidence")


#: All ends lie on a lattice, so that an end is on a segment or far from it.
_GRAPH = """with recursive stop as (
  select sheet_id, segment_id, sx as x, sy as y from v_segments union select sheet_id, segment_id, ex, ey from v_segments
  union select s.sheet_id, s.segment_id, p.x, p.y from v_segments s join (select sheet_id, segment_id, sx as x, sy as y from v_segments union all select sheet_id, segment_id, ex, ey from v_segments) p
    on p.sheet_id = s.sheet_id and p.x between s.sx and s.ex and p.y between s.sy and s.ey),
step as (select sheet_id, x, y, lead(x) over w as x1, lead(y) over w as y1 from stop window w as (partition by sheet_id, segment_id order by x, y)),
wire as (select sheet_id, concat('wire_', x, '_', y) as a, concat('wire_', x1, '_', y1) as b from step where x1 is not null),
degree as (select sheet_id, n, count(*) as d from (select sheet_id, a as n from wire union all select sheet_id, b from wire) group by all)"""
GRAPH_DEGREE = _GRAPH + " select sheet_id, n as node_id, case when d = 3 then 'T' else 'X' end as junction_type from degree where d >= 3"

_NETS = (
    _GRAPH
    + """, pin as (select distinct sheet_id, component_id, pin_number, concat('pin_', component_id, '_', pin_number) as n, concat('wire_', x, '_', y) as at from v_pins),
edge as (select sheet_id, a, b from wire union select pin.sheet_id, pin.n, pin.at from pin join degree on degree.sheet_id = pin.sheet_id and degree.n = pin.at),
arc as (select sheet_id, a, b from edge union select sheet_id, b, a from edge),
node as (select sheet_id, n from degree union select sheet_id, n from pin),
reach as (select sheet_id, n, n as r from node union select reach.sheet_id, reach.n, arc.b from reach join arc on arc.sheet_id = reach.sheet_id and arc.a = reach.r),
part as (select sheet_id, n, min(r) as c from reach group by all),
net as (select sheet_id, c, printf('NET_%03d', row_number() over (partition by sheet_id order by c) - 1) as net_id, count(*) filter (where n like 'wire%') as points from part group by sheet_id, c),
lines as (select wire.sheet_id, c, count(*) as n_wires, count(distinct least(a, b) || '>' || greatest(a, b)) as n_lines from wire join part on part.sheet_id = wire.sheet_id and part.n = wire.a group by all),
simple as (select sheet_id, n, count(*) as d from (select distinct sheet_id, a, b from wire union select sheet_id, b, a from wire) t(sheet_id, n, o) group by all),
shape as (select part.sheet_id, c, count(*) filter (where d = 1) as leaves, max(d) as most from simple join part on part.sheet_id = simple.sheet_id and part.n = simple.n group by all),
refs as (select pin.sheet_id, c, string_agg(component_id || ':' || pin_number, ' - ' order by component_id, pin_number) as refs, count(*) as n, list(component_id) as owners from pin join part on part.sheet_id = pin.sheet_id and part.n = pin.n group by all)"""
)
NET_EXTRACT = _NETS + """ select net.sheet_id, net_id, coalesce(refs, '') as refs, cast(coalesce(n_wires, 0) as int) as n_wires, cast(case when leaves = 2 and most <= 2 then points else 0 end as int) as n_path,
  case when coalesce(refs.n, 0) >= 2 then 1.0::double else 0.5::double end as confidence
from net left join lines using (sheet_id, c) left join shape using (sheet_id, c) left join refs using (sheet_id, c)"""
NET_FILTER = _NETS + """, dots as (select distinct sheet_id, component_id from v_pins where x < 300),
kept as (select pin.sheet_id, c, count(*) as n from (select * from pin anti join dots using (sheet_id, component_id)) pin join part on part.sheet_id = pin.sheet_id and part.n = pin.n group by all)
select net.sheet_id, net_id, cast(coalesce(kept.n, 0) as int) as n_connections, cast(coalesce(n_wires, 0) as int) as n_wires
from net left join lines using (sheet_id, c) left join kept using (sheet_id, c) where coalesce(n_wires, 0) > 0 or coalesce(kept.n, 0) > 1"""


def net_filter(spark, sf):
    nodes, edges = netlist.build_graph(view(spark, sf, "v_segments"), view(spark, sf, "v_pins"))
    nets = netlist.filter_nets(netlist.extract_nets(nodes, edges), view(spark, sf, "v_pins").where("x < 300").select("sheet_id", "component_id").distinct())
    return nets.select("sheet_id", "net_id", F.size("connections").alias("n_connections"), F.coalesce(F.size("wire_segments"), F.lit(0)).alias("n_wires"))


def graph_pairs(spark, sf):
    p = view(spark, sf, "v_pins")
    nets = p.groupBy("sheet_id", F.col("component_id").alias("net_id")).agg(F.sort_array(F.collect_list(F.struct("component_id", F.col("pin_number").alias("pin")))).alias("connections"))
    return netlist.pin_pairs(nets).select("sheet_id", "net_id", F.col("a.pin").alias("a"), F.col("b.pin").alias("b"))


GRAPH_PAIRS = "select a.sheet_id, a.component_id as net_id, a.pin_number as a, b.pin_number as b from v_pins a join v_pins b on a.sheet_id = b.sheet_id and a.component_id = b.component_id and a.pin_number < b.pin_number"

ENTRIES = {
    "snap_endpoints": (snap_endpoints, SNAP_ENDPOINTS),
    "contained_segments": (contained_segments, CONTAINED_SEGMENTS),
    "canonical_points": (canonical_points, CANONICAL_POINTS),
    "collinear_merge": (collinear_merge, COLLINEAR_MERGE),
    "components_cc": (components_cc, COMPONENTS_CC),
    "graph_degree": (graph_degree, GRAPH_DEGREE),
    "net_extract": (net_extract, NET_EXTRACT),
    "net_filter": (net_filter, NET_FILTER),
    "graph_pairs": (graph_pairs, GRAPH_PAIRS),
}
ORACLES = {k: sql(s) for k, (_, s) in ENTRIES.items() if s}
