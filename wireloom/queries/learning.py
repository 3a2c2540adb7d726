"""Queries over feedback, versions, evaluation and training sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from wireloom.functions import geometry as g
from wireloom.plans import datasets, evaluate, feedback, manifest, registry
from wireloom.queries.views import sql, table, view


def feedback_stats(spark, sf):
    return feedback.statistics(view(spark, sf, "v_feedback"))


FEEDBACK_STATS = """select 'issue_type' as kind, issue_type as name, count(*) as n from v_feedback group by 2
union all select 'original_label', original_label, count(*) from v_feedback group by 2
union all select 'correction', original_label || '->' || corrected_label, count(*) from v_feedback group by 2
union all select 'total', 'all', count(*) from v_feedback
union all select 'distinct', 'files', count(distinct file_id) from v_feedback
union all select 'distinct', 'users', count(distinct user_id) from v_feedback"""


def feedback_per_day(spark, sf):
    return feedback.per_day(view(spark, sf, "v_feedback"))


FEEDBACK_PER_DAY = "select strftime(created_at, '%Y-%m-%d') as day, count(*) as n from v_feedback group by 1"


def top_corrections(spark, sf):
    return feedback.top_corrections(view(spark, sf, "v_feedback"))


TOP_CORRECTIONS = "select original_label || '->' || corrected_label as correction, count(*) as n, min(id) as first_seen from v_feedback group by 1 order by n desc, first_seen limit 5"


def retrain_due(spark, sf):
    f = view(spark, sf, "v_feedback")
    return feedback.training_due(f, 0).unionByName(feedback.training_due(f, 10_000_000))


RETRAIN_DUE = "select count(*) as n, cast(50 as bigint) as threshold, count(*) >= 50 as due from v_feedback union all select count(*), 10000000, count(*) >= 10000000 from v_feedback"


def ab_route(spark, sf):
    users = table(spark, sf, "events").select("user_id").distinct()
    return feedback.route(users, "user_id", "v000001", "v000002", 0.3)


_BUCKET = "list_reduce(list_transform(string_split(sha256(cast(user_id as string)), ''), lambda d: cast(strpos('0123456789abcdef', d) - 1 as int)), lambda a, d: (a * 16 + d) % 10000)"
AB_ROUTE = f"select distinct user_id, {_BUCKET} as bucket, case when {_BUCKET} / 10000.0 < 0.3 then 'v000002' else 'v000001' end as version_id from events"


def ab_summary(spark, sf):
    e = table(spark, sf, "events")
    log = feedback.route(e, "user_id", "v000001", "v000002", 0.3)
    log = log.withColumn("version_id", F.when(F.pmod("event_id", F.lit(17)) != 0, F.col("version_id"))).withColumn("accepted", F.col("event_type") == "purchase")
    return feedback.ab_summary(log)


AB_SUMMARY = f"""select case when event_id % 17 = 0 then 'unknown' when {_BUCKET} / 10000.0 < 0.3 then 'v000002' else 'v000001' end as version_id,
  count(*) as n, count(*) filter (where event_type = 'purchase') as accepted from events group by 1"""


def version_latest_state(spark, sf):
    e = table(spark, sf, "events")
    return feedback.latest_state(e, "user_id", ["ts", "event_id"], ["event_type", "event_id"])


VERSION_LATEST_STATE = "select user_id, max_by(event_type, (ts, event_id)) as event_type, max_by(event_id, (ts, event_id)) as event_id from events group by 1"


def version_states(spark, sf):
    """The state of a registry after every event: register, promote, reject and comparisons of versions."""
    e = table(spark, sf, "events")
    actions = F.element_at(F.array(*map(F.lit, ("register", "promote", "reject", "start_ab", "stop_ab"))), (F.pmod("event_id", F.lit(5)) + 1).cast("int"))
    log = e.select(F.col("event_id").alias("seq"), actions.alias("action"), F.format_string("v%06d", F.floor(F.col("event_id") / 25)).alias("version_id"))
    return registry.states(log)


VERSION_STATES = """with log as (select event_id as seq, ['register', 'promote', 'reject', 'start_ab', 'stop_ab'][event_id % 5 + 1] as action, printf('v%06d', cast(floor(event_id / 25.0) as bigint)) as v from events),
p as (select *, action = 'promote' or (action = 'register' and seq = (select min(seq) from log where action = 'register')) as prom from log),
b as (select *, last_value(case when prom then v end ignore nulls) over (order by seq rows between unbounded preceding and 1 preceding) as before from p),
e as (select max_by(v, seq) filter (where prom) as now, max(seq) filter (where prom or action = 'stop_ab') as ended from p),
o as (select v, max(before) filter (where action = 'register') as parent, max(seq) filter (where prom) as promoted, max(seq) filter (where action = 'reject') as rejected, max(seq) filter (where action = 'start_ab') as compared from b group by v)
select v as version_id, case when v = now then 'current' when rejected > coalesce(promoted, -1) then 'rejected' when compared > coalesce(ended, -1) then 'challenger'
  when promoted is not null or compared is not null then 'retired' else 'candidate' end as status, parent from o, e"""


def metric_compare(spark, sf):
    n = table(spark, sf, "nation")
    a = n.select(F.col("n_name").alias("metric"), F.col("n_nationkey").cast("double").alias("value"))
    renamed = F.when(F.col("n_nationkey") % 4 == 0, F.concat("n_name", F.lit(" new"))).otherwise(F.col("n_name"))
    b = n.select(renamed.alias("metric"), (F.col("n_nationkey") * 1.5).cast("double").alias("value"))
    return feedback.compare_metrics(a, b)


METRIC_COMPARE = """with a as (select n_name as metric, cast(n_nationkey as double) as a from nation), b as (select n_name || case when n_nationkey % 4 = 0 then ' new' else '' end as metric, cast(n_nationkey * 1.5 as double) as b from nation)
select metric, a, b, b - a as delta from a full join b using (metric)"""


def _nets(spark, sf):
    line = table(spark, sf, "lineitem").select(F.floor(F.col("l_orderkey") / 100).alias("sheet_id"), "l_orderkey", F.col("l_partkey").cast("string").alias("ref"), "l_partkey")
    misread = F.when(F.col("l_partkey") % 17 == 0, F.concat(F.lit("?"), "ref")).otherwise(F.col("ref"))
    nets = lambda df: df.groupBy("sheet_id", "l_orderkey").agg(F.collect_set("ref").alias("refs")).select("sheet_id", "refs")
    return nets(line.withColumn("ref", misread)), nets(line)


_NETS = """with a as (select floor(l_orderkey / 100) as sheet_id, list_sort(list_distinct(list(case when l_partkey % 17 = 0 then '?' else '' end || l_partkey))) as refs from lineitem group by 1, l_orderkey),
b as (select floor(l_orderkey / 100) as sheet_id, list_sort(list_distinct(list(cast(l_partkey as string)))) as refs from lineitem group by 1, l_orderkey),
x as (select distinct * from a where len(refs) >= 2), y as (select distinct * from b where len(refs) >= 2),
v as (select coalesce(x.sheet_id, y.sheet_id) as sheet_id, coalesce(x.refs, y.refs) as refs, case when x.refs is null then 'missing' when y.refs is null then 'extra' else 'matched' end as verdict
  from x full join y on x.sheet_id = y.sheet_id and x.refs = y.refs)"""


def net_eval(spark, sf):
    return evaluate.compare_nets(*_nets(spark, sf)).select(F.col("sheet_id").cast("bigint").alias("sheet_id"), F.array_join("refs", ",").alias("refs"), "verdict")


NET_EVAL = _NETS + " select cast(sheet_id as bigint) as sheet_id, array_to_string(refs, ',') as refs, verdict from v"


def eval_rollup(spark, sf):
    out = evaluate.roll_up(evaluate.compare_nets(*_nets(spark, sf)))
    return out.select(F.col("sheet_id").cast("bigint").alias("sheet_id"), "matched", "missing", "extra", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


EVAL_ROLLUP = _NETS + """, c as (select sheet_id, count(*) filter (where verdict = 'matched') as matched, count(*) filter (where verdict = 'missing') as missing, count(*) filter (where verdict = 'extra') as extra from v group by rollup (sheet_id))
select cast(sheet_id as bigint) as sheet_id, matched, missing, extra, round(matched / greatest(1, matched + missing), 6) as recall, round(matched / greatest(1, matched + extra), 6) as precision from c"""


def class_remap(spark, sf):
    p = table(spark, sf, "part")
    names = p.select(F.col("p_brand").alias("source"), F.floor(F.col("p_partkey") / 100).cast("int").alias("source_order"), F.col("p_partkey").cast("int").alias("local_id"), F.col("p_name").alias("name"))
    canonical = spark.createDataFrame([(0, "small ring"), (1, "red widget"), (2, "blue bolt")], "class_id int, name string")
    return datasets.remap_classes(names, canonical).select("source", "local_id", "name", "class_id")


CLASS_REMAP = """with c(class_id, name) as (values (0, 'small ring'), (1, 'red widget'), (2, 'blue bolt')),
f as (select p_name as name, min(p_partkey) as place from part where p_name not in (select name from c) group by 1),
m as (select name, cast(3 + row_number() over (order by place) - 1 as int) as class_id from f union all select name, class_id from c)
select p_brand as source, cast(p_partkey as int) as local_id, p_name as name, m.class_id from part join m on p_name = m.name"""


def public_classes(spark, sf):
    p = table(spark, sf, "part")
    name = F.element_at(F.array(*map(F.lit, ("BJT", "capacitor", "speaker", "switch", "Inductor"))), (F.pmod("p_partkey", F.lit(5)) + 1).cast("int"))
    return p.select("p_partkey", datasets.public_to_own(name).alias("own"))


PUBLIC_CLASSES = "select p_partkey, case p_partkey % 5 when 0 then 'relay' when 1 then 'capacitor' when 2 then 'resistor' when 3 then 'offpage_connector' else 'resistor' end as own from part"


def oversample_union(spark, sf):
    p = table(spark, sf, "part").select(F.concat(F.lit("img"), F.col("p_partkey").cast("string")).alias("stem"), "p_size")
    return datasets.oversample(p, F.col("p_size") / 10).select("stem", "p_size")


OVERSAMPLE_UNION = "select 'img' || p_partkey || case when c = 0 then '' else '_' || c end as stem, p_size from (select *, unnest(range(0, greatest(1, cast(floor(p_size / 10.0) as bigint)))) as c from part)"


def merge_manifest(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("source"), F.when(F.pmod("p_partkey", F.lit(5)) == 0, "val").otherwise("train").alias("split"))
    return datasets.merge_manifest(p)


MERGE_MANIFEST = "select p_brand as source, case when p_partkey % 5 = 0 then 'val' else 'train' end as split, count(*) as n from part group by rollup (p_brand, case when p_partkey % 5 = 0 then 'val' else 'train' end)"


def split_by_hash(spark, sf):
    return datasets.split_rows(table(spark, sf, "part").select("p_partkey"), "p_partkey")


SPLIT_BY_HASH = "select p_partkey, case when cast('0x' || substr(md5(cast(p_partkey as string)), 1, 8) as bigint) % 10000 < 8000 then 'train' else 'val' end as split from part"


def yolo_lines(spark, sf):
    d = view(spark, sf, "v_detections")
    line = datasets.label_line(F.pmod("det_id", F.lit(33)).cast("int"), g.box(), F.lit(2000), F.lit(1000))
    lines = d.select("det_id", line.alias("value"))
    return datasets.parse_label_lines(lines).select("det_id", "value", "class_id", F.round("w", 4).alias("w"))


YOLO_LINES = """select det_id, printf('%d %.6f %.6f %.6f %.6f', det_id % 33, (x0 + x1) / 2.0 / 2000, (y0 + y1) / 2.0 / 1000, (x1 - x0) / 2000.0, (y1 - y0) / 1000.0) as value,
  cast(det_id % 33 as int) as class_id, round((x1 - x0) / 2000.0, 4) as w from v_detections"""


def coco_ids(spark, sf):
    d = view(spark, sf, "v_detections")
    return datasets.coco_annotations(d.select(F.col("sheet_id").alias("image_id"), "det_id", F.pmod("det_id", F.lit(33)).cast("int").alias("class_id"), "x0", "y0", "x1", "y1"))


COCO_IDS = """select row_number() over (order by sheet_id, det_id) as id, sheet_id as image_id, cast(det_id % 33 as int) as category_id, x0 as x, y0 as y, x1 - x0 as w, y1 - y0 as h,
  cast(x1 - x0 as bigint) * (y1 - y0) as area, 0 as iscrowd from v_detections"""


def page_union(spark, sf):
    d = view(spark, sf, "v_detections").select((F.pmod("sheet_id", F.lit(3)) + 1).alias("page"), F.col("det_id").cast("string").alias("id"))
    return manifest.merge_pages(d, "page", "id")


PAGE_UNION = "select sheet_id % 3 + 1 as page, concat('p', sheet_id % 3 + 1, '_', det_id) as id from v_detections"


def stage_timings(spark, sf):
    e = table(spark, sf, "events").select(F.pmod("user_id", F.lit(20)).alias("document"), F.col("event_type").alias("stage"), F.col("value").cast("decimal(12,2)").alias("seconds"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", F.concat(F.lit("e"), F.pmod("event_id", F.lit(3)).cast("string"))).alias("warning"))
    return manifest.stage_totals(e)


STAGE_TIMINGS = """with s as (select user_id % 20 as document, event_type as stage, sum(cast(value as decimal(12,2))) as seconds from events group by 1, 2),
w as (select user_id % 20 as document, 'e' || (event_id % 3) as warning, min(event_id) as seq from events where event_type = 'error' group by 1, 2),
x as (select document, string_agg(warning, ',' order by seq) as warnings from w group by 1)
select s.document, s.stage, cast(s.seconds as double) as seconds, coalesce(x.warnings, '') as warnings from s left join x using (document)"""

ENTRIES = {
    "feedback_stats": (feedback_stats, FEEDBACK_STATS),
    "feedback_per_day": (feedback_per_day, FEEDBACK_PER_DAY),
    "top_corrections": (top_corrections, TOP_CORRECTIONS),
    "retrain_due": (retrain_due, RETRAIN_DUE),
    "ab_route": (ab_route, AB_ROUTE),
    "ab_summary": (ab_summary, AB_SUMMARY),
    "version_latest_state": (version_latest_state, VERSION_LATEST_STATE),
    "version_states": (version_states, VERSION_STATES),
    "metric_compare": (metric_compare, METRIC_COMPARE),
    "net_eval": (net_eval, NET_EVAL),
    "eval_rollup": (eval_rollup, EVAL_ROLLUP),
    "class_remap": (class_remap, CLASS_REMAP),
    "public_classes": (public_classes, PUBLIC_CLASSES),
    "oversample_union": (oversample_union, OVERSAMPLE_UNION),
    "merge_manifest": (merge_manifest, MERGE_MANIFEST),
    "split_by_hash": (split_by_hash, SPLIT_BY_HASH),
    "yolo_lines": (yolo_lines, YOLO_LINES),
    "coco_ids": (coco_ids, COCO_IDS),
    "page_union": (page_union, PAGE_UNION),
    "stage_timings": (stage_timings, STAGE_TIMINGS),
}
ORACLES = {k: sql(s) for k, (_, s) in ENTRIES.items() if s}
