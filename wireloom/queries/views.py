"""Domain tables derived from the driver tables by integer arithmetic that both engines evaluate alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Texts that the derived sheets carry: designators with look-alikes and noise, and other labels.
SAMPLES = ["R1", "VD1", "K1,1", "С1", "ЕL2", "R l", "RO", "SA 1", "1000", "12V", "QQQ1", "X1", "Ш2", "2РМ14", "БПВЛ-0.35", "+27В", "GND", "x1", "12", "МГТФ 0.5"]
_CASES = " ".join(f"when {i} then '{s}'" for i, s in enumerate(SAMPLES))

VIEWS = {
    "v_detections": """select cast(floor(o_orderkey / 300.0) as bigint) as sheet_id, o_orderkey as det_id, o_orderpriority as category,
        cast((o_orderkey * 7919) % 1000 as int) as x0, cast((o_orderkey * 104729) % 700 as int) as y0,
        cast((o_orderkey * 7919) % 1000 + 20 + o_custkey % 60 as int) as x1, cast((o_orderkey * 104729) % 700 + 20 + o_custkey % 40 as int) as y1,
        cast((o_orderkey * 31) % 1000 as double) / 1000 as confidence,
        case when o_orderkey % 3 = 0 then 'template' else 'model' end as source from {orders}""",
    "v_texts": f"""select cast(floor(c_custkey / 60.0) as bigint) as sheet_id, c_custkey as text_id,
        case cast(c_custkey % {len(SAMPLES)} as int) {_CASES} end as text,
        cast((c_custkey * 613) % 1000 as int) as x0, cast((c_custkey * 911) % 700 as int) as y0,
        cast((c_custkey * 613) % 1000 + 30 as int) as x1, cast((c_custkey * 911) % 700 + 14 as int) as y1,
        cast((c_custkey * 17) % 1000 as double) / 1000 as confidence from {{customer}}""",
    "v_segments": """select cast(floor(o_orderkey / 60.0) as bigint) as sheet_id, o_orderkey as segment_id,
        cast((o_orderkey * 7) % 30 * 50 as int) as sx, cast((o_orderkey * 11) % 13 * 50 as int) as sy,
        cast((o_orderkey * 7) % 30 * 50 + (1 - o_orderkey % 2) * (50 + o_orderkey % 3 * 50) as int) as ex,
        cast((o_orderkey * 11) % 13 * 50 + o_orderkey % 2 * (50 + o_orderkey % 3 * 50) as int) as ey,
        cast((o_orderkey * 31) % 1000 as double) / 1000 as confidence from {orders}""",
    "v_pins": """select cast(floor(c_custkey / 6.0) as bigint) as sheet_id, concat('C', cast(floor(c_custkey / 2.0) as bigint)) as component_id,
        cast(c_custkey as string) as pin_number, cast((c_custkey * 41) % 30 * 50 + c_custkey % 7 as int) as x,
        cast((c_custkey * 59) % 13 * 50 + c_custkey % 5 as int) as y from {customer}""",
    "v_feedback": """select event_id as id, cast(user_id as string) as file_id, cast(user_id % 13 as string) as user_id, event_type as original_label,
        case when event_id % 4 = 0 then 'resistor' when event_id % 4 = 1 then 'diode' else event_type end as corrected_label,
        case when event_id % 3 = 0 then 'text' else 'symbol' end as issue_type, ts as created_at from {events}""",
    "v_sheets": """select p_partkey as sheet_id, cast(300 + (p_partkey * 97) % 4000 as int) as width, cast(200 + (p_partkey * 61) % 3000 as int) as height from {part}""",
    "v_truth": """select cast(floor(o_orderkey / 300.0) as bigint) as sheet_id, o_orderkey as truth_id, o_orderpriority as category,
        cast((o_orderkey * 7919) % 1000 + o_orderkey % 9 + case when o_orderkey % 6 = 0 then 5000 else 0 end as int) as x0,
        cast((o_orderkey * 104729) % 700 + o_orderkey % 5 as int) as y0,
        cast((o_orderkey * 7919) % 1000 + 20 + o_custkey % 60 + case when o_orderkey % 6 = 0 then 5000 else 0 end as int) as x1,
        cast((o_orderkey * 104729) % 700 + 20 + o_custkey % 40 as int) as y1 from {orders}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    base = text[text.rindex("{") + 1 : text.rindex("}")]
    return spark.sql(text, **{base: table(spark, sf_dir, base)})


def sql(text: str) -> str:
    """Oracle text with the views that it names put in front."""
    named = []
    for name, body in VIEWS.items():
        if name in text:
            base = body[body.rindex("{") + 1 : body.rindex("}")]
            named.append(f"{name} as ({body.replace('{' + base + '}', base)})")
    text = text.strip()
    if not named:
        return text
    if text.lower().startswith("with recursive"):
        return f"with recursive {', '.join(named)}, {text[len('with recursive'):]}"
    if text.lower().startswith("with"):
        return f"with {', '.join(named)}, {text[len('with'):]}"
    return f"with {', '.join(named)} {text}"
