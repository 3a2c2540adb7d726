"""Column builders for the texts on a sheet; character classes are written out, as engines differ on Unicode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wireloom.schema import CYRILLIC, KNOWN_PREFIXES, LATIN

CYR_X = "Х"


def normalize_designator(text: Column) -> Column:
    """A designator in its standard form, or null: look-alike letters, spaces and misread digits are put right."""
    upper = F.upper(F.translate(text, CYRILLIC, LATIN))
    bare = F.replace(F.regexp_replace(upper, r"[\s_\-]+", ""), F.lit(","), F.lit("."))
    bare = F.btrim(bare, F.lit(".:;'\"`()[]{}|"))
    shape = r"^([A-Z]{1,3})([0-9OIL|.]{1,6})$"
    letters = F.regexp_extract(bare, shape, 1)
    tail = F.translate(F.regexp_extract(bare, shape, 2), "OIL|", "0111")
    shorter = F.when(F.length(letters) == 3, F.substring(letters, 1, 2)).when(F.length(letters) == 2, F.substring(letters, 1, 1)).otherwise("")
    last = F.substring(letters, -1, 1)
    misread = ~letters.isin(KNOWN_PREFIXES) & shorter.isin(KNOWN_PREFIXES) & last.isin("I", "L")
    code = F.when(misread, shorter).otherwise(letters)
    number = F.when(misread, F.concat(F.lit("1"), tail)).otherwise(tail)
    return F.when(code.isin(KNOWN_PREFIXES) & number.rlike(r"^[1-9][0-9]{0,2}(?:\.[1-9][0-9]?)?$"), F.concat(code, number))


def designator_prefix(designator: Column) -> Column:
    return F.regexp_extract(designator, r"^([A-Z]{1,3})[1-9][0-9]{0,2}(?:\.[1-9][0-9]?)?$", 1)


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def classify_text(text: Column) -> Column:
    """Kind of a text by the first pattern that it fits."""
    t = _strip(text)
    u = F.upper(t)
    fits = lambda c, p: c.rlike(p)
    return (
        F.when(fits(t, "^[ХX][0-9]+$") | fits(t, "^Ш[0-9]+$"), "connector")
        .when(fits(t, "^СНЦ[0-9]+") | fits(t, "^2РМ[0-9]+"), "connector_type")
        .when(fits(t, "^[0-9]{1,3}$") | fits(t, "^[A-ZА-Я]$"), "pin")
        .when(fits(u, r"^БПВЛ(-[0-9]+(\.[0-9]+)?)?$") | fits(u, "^МГТФ.*$") | fits(u, "^КГ[0-9]+.*$"), "wire_type")
        .when(fits(u, "^[+-]?[0-9]+[ВV]?$"), "voltage")
        .when(fits(u, "^GND") | fits(u, "^ЗЕМЛЯ") | fits(u, "^KОРПУС$"), "gnd")
        .when(fits(u, "^(VD|R|K|C)[0-9]+$"), "designator")
        .otherwise("other")
    )


def normalize_designation(text: Column) -> Column:
    """A connector's Latin X before a digit becomes Cyrillic; spaces go."""
    t = _strip(text)
    return F.replace(F.regexp_replace(t, "^[Xx](?=[0-9])", CYR_X), F.lit(" "), F.lit(""))


def validate_designation(text: Column, expected: Column) -> Column:
    t = normalize_designation(text)
    u = F.upper(t)
    return F.coalesce(
        F.when(expected == "connector", t.rlike("^[ХX][0-9]+$"))
        .when(expected == "pin", t.rlike("^[0-9]{1,3}$") | t.rlike("^[A-ZА-Я]$"))
        .when(expected == "wire_type", u.rlike(r"^БПВЛ(-[0-9]+(\.[0-9]+)?)?$") | u.rlike("^МГТФ.*$"))
        .when(expected == "voltage", u.rlike("^[+-]?[0-9]+[ВV]?$")),
        F.lit(False),
    )


def keep_text(text: Column, confidence: Column, threshold: float = 0.65) -> Column:
    """Sure texts, and less sure ones that are designators or short numbers."""
    return (confidence >= threshold) | (
        (confidence >= 0.25) & (normalize_designator(text).isNotNull() | _strip(text).rlike("^[0-9]{1,3}$"))
    )


def first_json(text: Column) -> Column:
    """The first JSON object in free text as a string; null where there is none that parses."""
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    whole = F.when(found != "", found).otherwise(text)
    return F.when(F.try_parse_json(whole).isNotNull(), whole)


def resolution(kind: Column, connected: Column, corrected: Column) -> Column:
    """What is noted of a resolved issue; ``rag``: it was resolved by retrieved examples."""
    said = F.when(connected, "True").otherwise("False")
    return F.when(kind == "text", F.concat(F.lit("corrected_text="), corrected)).otherwise(
        F.concat(F.when(kind == "rag", "rag_connected=").otherwise("connected="), said)
    )


def few_shot_prompt(examples: Column, most: int = 3) -> Column:
    """Lines of the first examples (label, description, score) of an array of structs."""
    line = lambda e, i: F.format_string("%d. %s: %s (%.2f)", i + 1, e["label"], e["description"], e["score"])
    return F.array_join(F.transform(F.slice(examples, 1, most), line), "\n")


def ab_bucket(key: Column, buckets: int = 10_000) -> Column:
    """A stable number below ``buckets`` from the SHA-256 of a key, read as one big integer."""
    digits = F.split(F.sha2(key.cast("string"), 256), "(?<=.)(?=.)")
    return F.aggregate(digits, F.lit(0), lambda a, d: (a * 16 + F.conv(d, 16, 10).cast("int")) % buckets)


#: Cyrillic letters in file names.
SPELLING = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p",
    "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}


def ascii_stem(name: Column) -> Column:
    """A file's stem in ASCII; ``sheet`` where nothing is left."""
    table = SPELLING | {k.upper(): v.capitalize() for k, v in SPELLING.items()}
    letters = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    spelled = F.array_join(F.transform(F.split(name, ""), lambda c: F.coalesce(letters[c], c)), "")
    plain = F.btrim(F.regexp_replace(spelled, "[^0-9A-Za-z._ -]+", "_"), F.lit(" ._-"))
    return F.when(plain == "", "sheet").otherwise(plain)


def restored_point(text: Column, tall: Column, dots: Column) -> Column:
    """A designator with the decimal point that reading lost: ``K11`` to ``K1.1``.

    ``tall`` and ``dots``: centres of the tall glyphs and of the dots at the foot
    line.  Only where there are as many tall glyphs as characters and one dot,
    which stands after the first digit and before the last one.
    """
    name = normalize_designator(text)
    letters = F.length(F.regexp_extract(name, r"^([A-Z]{1,3})\d{2,4}$", 1))
    before = F.size(F.filter(tall, lambda x: x < dots[0]))
    sure = (letters > 0) & (F.size(tall) == F.length(name)) & (F.size(dots) == 1) & (before > letters) & (before < F.length(name))
    return F.when(sure, F.concat(F.substr(name, F.lit(1), before), F.lit("."), F.substr(name, before + 1))).otherwise(text)


def keyword_score(query: Column, label: Column, description: Column) -> Column:
    """How well an entry fits a word: in its label, in its description, or not; half where nothing is asked."""
    word = F.lower(F.coalesce(query, F.lit("")))
    return (
        F.when(word == "", 0.5)
        .when(F.contains(F.lower(label), word), 0.9)
        .when(F.contains(F.lower(F.coalesce(description, F.lit(""))), word), 0.7)
        .otherwise(0.1)
    )


def short_id(key: Column) -> Column:
    """Twelve hexadecimal digits that name a row by its key, the same at every run."""
    return F.substring(F.md5(key.cast("string").cast("binary")), 1, 12)
