"""Queries over texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from wireloom.functions import text as t
from wireloom.operators import knn
from wireloom.queries.views import SAMPLES, sql, table, view

_CYR, _LAT = "АВСЕНКМОРТХУГЛавсенкмортху", "ABCEHKMOPTXYGLABCEHKMOPTXY"


def designator_normalize(spark, sf):
    d = view(spark, sf, "v_texts")
    name = t.normalize_designator(F.col("text"))
    return d.select("text_id", name.alias("designator"), t.designator_prefix(name).alias("prefix"))


_PREFIXES = ", ".join(f"'{p}'" for p in t.KNOWN_PREFIXES)
DESIGNATOR_NORMALIZE = f"""with a as (select text_id, trim(replace(regexp_replace(upper(translate(text, '{_CYR}', '{_LAT}')), '[\\s_\\-]+', '', 'g'), ',', '.'), '.:;''"`()[]{{}}|') as s from v_texts),
b as (select text_id, regexp_extract(s, '^([A-Z]{{1,3}})([0-9OIL|.]{{1,6}})$', 1) as l, translate(regexp_extract(s, '^([A-Z]{{1,3}})([0-9OIL|.]{{1,6}})$', 2), 'OIL|', '0111') as n from a),
c as (select text_id, case when l not in ({_PREFIXES}) and l[:-2] in ({_PREFIXES}) and l[-1:] in ('I', 'L') then l[:-2] else l end as code,
  case when l not in ({_PREFIXES}) and l[:-2] in ({_PREFIXES}) and l[-1:] in ('I', 'L') then '1' || n else n end as number from b),
d as (select text_id, case when code in ({_PREFIXES}) and regexp_matches(number, '^[1-9][0-9]{{0,2}}(\\.[1-9][0-9]?)?$') then code || number end as designator, code from c)
select text_id, designator, case when designator is not null then code end as prefix from d"""


def text_classify(spark, sf):
    d = view(spark, sf, "v_texts")
    return d.select("text_id", t.classify_text(F.col("text")).alias("kind"), t.normalize_designation(F.col("text")).alias("designation"), t.validate_designation(F.col("text"), F.lit("connector")).alias("is_connector"), t.keep_text(F.col("text"), F.col("confidence")).alias("kept"))


_KIND = {"R1": "designator", "VD1": "designator", "1000": "voltage", "12V": "voltage", "X1": "connector", "Ш2": "connector", "2РМ14": "connector_type", "БПВЛ-0.35": "wire_type", "+27В": "voltage", "GND": "gnd", "12": "pin", "МГТФ 0.5": "wire_type"}
_KEPT = ["R1", "VD1", "K1,1", "С1", "ЕL2", "R l", "SA 1", "X1", "x1", "12"]
_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)
TEXT_CLASSIFY = f"""select text_id, case text {' '.join(f"when '{k}' then '{v}'" for k, v in _KIND.items() if k in SAMPLES)} else 'other' end as kind,
  replace(case when text in ('X1', 'x1') then 'Х' || text[2:] else text end, ' ', '') as designation,
  text in ('X1', 'x1') as is_connector, confidence >= 0.65 or (confidence >= 0.25 and text in ({_IN(_KEPT)})) as kept from v_texts"""


def json_extract(spark, sf):
    e = table(spark, sf, "events")
    noisy = F.concat(F.lit("answer: "), "props", F.when(F.pmod("event_id", F.lit(3)) == 0, F.lit(" thanks")).otherwise(F.lit("")))
    found = t.first_json(F.when(F.pmod("event_id", F.lit(5)) == 0, F.lit("no object here")).otherwise(noisy))
    return e.select("event_id", F.get_json_object(found, "$.k").cast("int").alias("k"), t.resolution(F.col("event_type"), F.pmod("event_id", F.lit(2)) == 0, F.lit("x")).alias("note"))


JSON_EXTRACT = """select event_id, case when event_id % 5 = 0 then null else cast(json_extract_string(props, '$.k') as int) end as k,
  case when event_id % 2 = 0 then 'connected=True' else 'connected=False' end as note from events"""


def keyword_search(spark, sf):
    """Keyword fallback of a retrieval query: label hits, then description hits, then the rest; the best five over 0.2."""
    p = table(spark, sf, "part").select("p_partkey", "p_type", "p_name")
    return knn.keyword_search(p, "Small", "p_partkey", "p_type", "p_name")


KEYWORD_SEARCH = """with s as (select p_partkey, p_type, p_name, cast(case when contains(lower(p_type), 'small') then 0.9 when contains(lower(p_name), 'small') then 0.7 else 0.1 end as double) as score from part)
select * from s where score > 0.2 order by score desc, p_partkey limit 5"""

ENTRIES = {
    "designator_normalize": (designator_normalize, DESIGNATOR_NORMALIZE),
    "text_classify": (text_classify, TEXT_CLASSIFY),
    "json_extract": (json_extract, JSON_EXTRACT),
    "keyword_search": (keyword_search, KEYWORD_SEARCH),
}
ORACLES = {k: sql(s) for k, (_, s) in ENTRIES.items() if s}
