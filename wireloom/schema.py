"""Dimension tables and column types of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DETECTIONS = "sheet_id bigint, det_id bigint, tile_id bigint, x0 int, y0 int, x1 int, y1 int, confidence double, category string, source string"
TEXTS = "sheet_id bigint, text_id bigint, text string, x0 int, y0 int, x1 int, y1 int, confidence double"
SEGMENTS = "sheet_id bigint, segment_id bigint, sx int, sy int, ex int, ey int, confidence double"
PINS = "sheet_id bigint, component_id string, pin_number string, x int, y int"
FEEDBACK = (
    "id string, file_id string, image_path string, original_label string, corrected_label string, issue_type string, "
    "user_id string, comment string, created_at timestamp_ntz"
)
AB_LOG = "version_id string, timestamp timestamp_ntz, accepted boolean"

# Classes of symbols (id, name, width mm, height mm, letter code, component type, found by template, mirrored search).
SYMBOLS = [
    (0, "connector_body", 8.0, 24.0, "X", "connector", False, False),
    (1, "pin", 2.0, 2.0, "", "unknown", False, False),
    (2, "junction_dot", 1.5, 1.5, "", "junction_dot", False, False),
    (3, "ground", 10.0, 8.0, "", "ground", True, False),
    (4, "shield", 20.0, 10.0, "", "shield", False, False),
    (5, "offpage_connector", 12.0, 6.0, "", "offpage_connector", True, False),
    (6, "diode", 12.0, 5.0, "VD", "diode", True, False),
    (7, "relay", 10.0, 10.0, "K", "relay", True, False),
    (8, "resistor", 16.0, 4.0, "R", "resistor", True, False),
    (9, "capacitor", 10.0, 7.0, "C", "capacitor", True, False),
    (10, "fuse", 16.0, 4.0, "FU", "fuse", True, False),
    (11, "switch_no", 14.0, 6.0, "SA", "switch", True, True),
    (12, "switch_nc", 14.0, 6.0, "SA", "switch", True, True),
    (13, "switch_changeover", 14.0, 8.0, "SA", "switch", True, True),
    (14, "pushbutton_no", 14.0, 10.0, "SB", "pushbutton", True, True),
    (15, "lamp", 14.0, 8.0, "EL", "lamp", True, False),
    (16, "led", 12.0, 8.0, "HL", "led", True, True),
    (17, "zener", 12.0, 5.0, "VD", "zener", True, True),
    (18, "capacitor_polar", 10.0, 7.0, "C", "capacitor", True, True),
    (19, "inductor", 18.0, 2.5, "L", "inductor", True, True),
    (20, "transformer", 14.0, 14.0, "T", "transformer", True, False),
    (21, "transistor_npn", 14.0, 14.0, "VT", "transistor", True, True),
    (22, "transistor_pnp", 14.0, 14.0, "VT", "transistor", True, True),
    (23, "battery", 12.0, 8.0, "GB", "battery", True, False),
    (24, "motor", 16.0, 10.0, "M", "motor", True, False),
    (25, "generator", 16.0, 10.0, "G", "generator", True, False),
    (26, "potentiometer", 16.0, 8.0, "R", "potentiometer", True, False),
    (27, "plug_contact", 8.0, 3.0, "XP", "plug", True, False),
    (28, "socket_contact", 7.0, 4.0, "XS", "socket", True, False),
    (29, "terminal", 6.0, 2.4, "XT", "terminal", False, False),
    (30, "chassis", 10.0, 6.0, "", "chassis", True, False),
    (31, "fuse_switch", 6.0, 12.0, "F", "fuse", False, False),
    (32, "device_block", 40.0, 30.0, "A", "unknown", False, False),
]

# Pins of symbols in mm from the upper left corner.
SYMBOL_PINS = {
    "ground": [("1", 5, 0)],
    "offpage_connector": [("1", 0, 3)],
    "diode": [("A", 0, 2.5), ("K", 12, 2.5)],
    "relay": [("1", 5, 0), ("2", 5, 10)],
    "resistor": [("1", 0, 2), ("2", 16, 2)],
    "capacitor": [("1", 0, 3.5), ("2", 10, 3.5)],
    "fuse": [("1", 0, 2), ("2", 16, 2)],
    "switch_no": [("1", 0, 5), ("2", 14, 5)],
    "switch_nc": [("1", 0, 5), ("2", 14, 5)],
    "switch_changeover": [("C", 0, 4), ("NC", 14, 0.8), ("NO", 14, 7)],
    "pushbutton_no": [("1", 0, 9), ("2", 14, 9)],
    "lamp": [("1", 0, 4), ("2", 14, 4)],
    "led": [("A", 0, 5.5), ("K", 12, 5.5)],
    "zener": [("A", 0, 2.5), ("K", 12, 2.5)],
    "capacitor_polar": [("+", 0, 3.5), ("-", 10, 3.5)],
    "inductor": [("1", 0, 2), ("2", 18, 2)],
    "transformer": [("1", 0, 2), ("2", 0, 12), ("3", 14, 2), ("4", 14, 12)],
    "transistor_npn": [("B", 0, 7), ("C", 9.5, 0), ("E", 9.5, 14)],
    "transistor_pnp": [("B", 0, 7), ("C", 9.5, 0), ("E", 9.5, 14)],
    "battery": [("+", 0, 4), ("-", 12, 4)],
    "motor": [("1", 0, 5), ("2", 16, 5)],
    "generator": [("1", 0, 5), ("2", 16, 5)],
    "potentiometer": [("1", 0, 6), ("2", 8, 0), ("3", 16, 6)],
    "plug_contact": [("1", 0, 1.5)],
    "socket_contact": [("1", 0, 2)],
    "terminal": [("1", 0, 1.2)],
    "chassis": [("1", 5, 0)],
    "fuse_switch": [("1", 3, 0), ("2", 3, 12)],
}

# Letter codes that a class may carry, in order of preference.
CLASS_PREFIXES = {
    "resistor": ["R", "RK", "RP", "RS", "RU"],
    "potentiometer": ["R", "RP"],
    "capacitor": ["C"],
    "capacitor_polar": ["C"],
    "fuse": ["FU", "F"],
    "diode": ["VD", "V", "D"],
    "zener": ["VD", "V"],
    "led": ["HL", "VD", "H"],
    "lamp": ["EL", "HL", "H", "E"],
    "relay": ["K", "KA", "KM", "KT", "KV", "KK", "KH"],
    "switch_no": ["SA", "S", "SB", "SF", "SQ", "SP", "SL", "SR", "K", "KA", "KM", "KT", "KV", "Q", "QF", "QS"],
    "switch_nc": ["SA", "S", "SB", "SF", "SQ", "SP", "SL", "SR", "K", "KA", "KM", "KT", "KV", "Q", "QF", "QS"],
    "switch_changeover": ["SA", "S", "K", "KA", "KM", "KT", "KV", "Q"],
    "pushbutton_no": ["SB", "S", "SA"],
    "inductor": ["L", "LL"],
    "transformer": ["T", "TV", "TA", "TS"],
    "transistor_npn": ["VT", "V"],
    "transistor_pnp": ["VT", "V"],
    "battery": ["GB", "G"],
    "generator": ["G", "GE"],
    "motor": ["M"],
    "connector_body": ["X", "XS", "XP", "XT", "XA", "XW"],
    "plug_contact": ["XP", "X"],
    "socket_contact": ["XS", "X"],
    "terminal": ["XT", "X"],
    "fuse_switch": ["F", "FU"],
    "device_block": ["A", "B"],
}

# Letter codes of the designator standard.
KNOWN_PREFIXES = (
    "A B BA BF BK BL BP BQ BR BV C D DA DD E EK EL F FA FP FU FV G GB GC GE H HA HG HL K KA KH KK KM KT KV L LL M "
    "P PA PC PF PI PK PR PS PT PV PW Q QF QK QS R RK RP RS RU S SA SB SF SL SP SQ SR ST T TA TS TV U V VD VL VS VT "
    "W WA WE WS WT X XA XP XS XT XW Y YA YB YC YH Z"
).split()

# Cyrillic letters that look like Latin ones.
CYRILLIC = "АВСЕНКМОРТХУГЛавсенкмортху"
LATIN = "ABCEHKMOPTXYGLABCEHKMOPTXY"

# Classes of public collections and the class here that stands for them.
PUBLIC_CLASSES = {
    "resistor": "resistor",
    "capacitor": "capacitor",
    "diode": "diode",
    "ground": "ground",
    "relay": "relay",
    "connector": "connector_body",
    "inductor": "resistor",
    "transformer": "relay",
    "switch": "offpage_connector",
    "battery": "ground",
    "voltage_source": "ground",
    "current_source": "ground",
    "transistor": "relay",
    "mosfet": "relay",
    "bjt": "relay",
    "op_amp": "relay",
    "integrated_circuit": "relay",
}


def symbols(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        SYMBOLS,
        "class_id int, class_name string, width_mm double, height_mm double, designator string, component_type string, template_detect boolean, chiral boolean",
    )


def symbol_pins(spark: SparkSession) -> DataFrame:
    rows = [(name, pin, float(x), float(y)) for name, pins in SYMBOL_PINS.items() for pin, x, y in pins]
    return spark.createDataFrame(rows, "class_name string, pin string, x_mm double, y_mm double")


def class_prefixes(spark: SparkSession) -> DataFrame:
    rows = [(name, p, rank) for name, prefixes in CLASS_PREFIXES.items() for rank, p in enumerate(prefixes)]
    return spark.createDataFrame(rows, "class_name string, prefix string, rank int")
