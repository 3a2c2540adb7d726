"""Quality rules, in DataFrame functions only.

Base rules count words, symbols, repeated lines and repeated 8-word windows.
The method's own rule compares a document with language references: the
Jensen-Shannon distance (base 2, square root) of its character-class histogram
and of its common-word histogram to the nearest reference.  References come from
all labelled documents that pass the base rules and are long enough to be judged;
they are medians and sums of whole units, so neither the order nor the
partitioning of the rows changes them.  How far a text may lie from its reference
was fitted on labelled documents by :func:`fit_limits`.

Defined results: null, empty or blank texts have no words and fail the base
rules; texts under ``min_words`` are not judged by distance; with no labelled
document there is no reference and the base rules alone decide.  Repeated rows
and ties are rows like any other; empty tables give empty results; other
columns pass through :func:`keep_good` whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wireloom.functions.arrays import ALL, let
from wireloom.llm.shared import SPACE_CLASS
from wireloom.tables import written

#: Character classes in the order in which they are taken out of a text.
CLASSES = {
    "lower": "[a-z]+",
    "space": f"[{SPACE_CLASS}]+",
    "upper": "[A-Z]+",
    "symbol": "[#*$%&|<>]+",
    "digit": "[0-9]+",
    "letter": r"\p{L}+",
}


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    max_repeat_percent: int = 30
    #: Texts with fewer words are not judged by their histograms.
    judged_words: int = 20
    #: Texts with fewer words are not judged by their common words.
    word_judged_words: int = 40
    common_words: int = 16
    #: A distance may be the first figure, and the second over the root of the word count, for what chance does to short texts.
    class_distance: tuple[float, float] = (0.02, 2.4)
    word_distance: tuple[float, float] = (0.28, 4.2)


#: Shares are counted in units: medians of so many steps, sums of so many.
STEPS, UNITS = 10_000, 1_000_000


def words_of(text: Column) -> Column:
    """The words of a text; an empty array for none."""
    # white space at the ends leaves empty words
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE_CLASS}]+"), "")


def repeated_words(words: Column, window: int = 8) -> Column:
    """How many words lie in a window of words that the array holds twice or more.

    Windows are compared by 64-bit hashes.  Arrays without a repeated window,
    nearly all, cost one pass; the others a sort.
    """

    def joined(step: int):
        """Hashes of windows of twice ``step`` words from those of ``step`` words; the last ones aren't whole."""
        return lambda h: F.zip_with(h, F.slice(h, 1 + step, ALL), lambda a, b: F.xxhash64(a, b))

    whole = F.transform(words, lambda w: F.xxhash64(w))
    step = 1
    while step < window:
        whole = let(whole, joined(step))
        step *= 2
    assert step == window, "a power of two is asked for"
    hashes = let(whole, lambda h: F.slice(h, F.lit(1), F.greatest(F.size(h) - (window - 1), F.lit(0))))

    def places(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(
            pairs,
            lambda s: F.sort_array(
                F.array_distinct(
                    F.flatten(
                        F.zip_with(
                            s,
                            F.slice(s, 2, ALL),
                            lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
                        )
                    )
                )
            ),
        )

    def covered(p: Column) -> Column:
        steps = F.zip_with(p, F.slice(p, 2, ALL), lambda a, b: F.least(F.lit(window), b - a))
        return F.aggregate(steps, F.lit(0), lambda x, y: x + y)

    return let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(places(h), covered)),
    ).cast("long")


def class_counts(text: Column) -> Column:
    """Array: characters of each of :data:`CLASSES`, then of what is left."""
    # each class is taken out of what the ones before it left, so that only the first sees the whole text
    steps = F.struct(text.alias("rest"), F.array().cast("array<bigint>").alias("counts"))
    for pattern in CLASSES.values():
        steps = let(steps, _taken_out(pattern))
    return let(steps, lambda s: F.array_append(s["counts"], F.char_length(s["rest"]).cast("long")))


def _taken_out(pattern: str):
    def step(s: Column) -> Column:
        return let(
            F.regexp_replace(s["rest"], pattern, ""),
            lambda r: F.struct(
                r.alias("rest"),
                F.array_append(s["counts"], (F.char_length(s["rest"]) - F.char_length(r)).cast("long")).alias("counts"),
            ),
        )

    return step


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def top_words(docs: DataFrame, text: str, lang: str, k: int) -> dict[str, list[str]]:
    """For each language its ``k`` most frequent words; ties by the word."""
    pairs = docs.where(F.col(lang).isNotNull()).select(
        F.col(lang).alias("lang"), F.explode(words_of(F.col(text))).alias("word")
    )
    counts = pairs.groupBy("lang", "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    best = counts.withColumn("rank", rank).where(F.col("rank") <= k).orderBy("lang", "rank").collect()
    out: dict[str, list[str]] = {}
    for r in best:
        out.setdefault(r["lang"], []).append(r["word"])
    return out


def common_counts(words: Column, vocabulary: list[str]) -> Column:
    """Array of (word, share): the common words of a text, as shares of all its common words."""
    if not vocabulary:
        return F.array().cast("array<struct<word:string,share:double>>")
    # capitals stand at the head of a sentence only; text in capitals shall differ
    either = sorted({*vocabulary, *(w[:1].upper() + w[1:] for w in vocabulary)})
    return let(
        F.transform(F.filter(words, lambda w: w.isin(either)), F.lower),
        lambda c: F.transform(
            F.array_distinct(c),
            lambda w: F.struct(
                w.alias("word"), ((F.size(c) - F.size(F.array_remove(c, w))) / F.size(c)).alias("share")
            ),
        ),
    )


def shares(counts: Column) -> Column:
    return let(
        F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x),
        lambda total: F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0))),
    )


def references(counted: DataFrame, rules: Rules) -> dict[str, tuple[list[float], dict[str, float]]]:
    """Histograms of each language over all its documents that are long enough and pass the base rules.

    Character classes by their medians, which junk can't move; common words by
    their mean shares.
    """
    # one pass: class shares, in steps, and word shares, in units, go up as one list of named parts
    named = F.concat(
        F.transform("class_shares", lambda x, i: F.struct(F.concat(F.lit("c "), i.cast("string")).alias("part"), F.round(x * STEPS).cast("long").alias("step"), F.lit(1).cast("long").alias("n"))),
        F.transform("common", lambda x: F.struct(F.concat(F.lit("w "), x["word"]).alias("part"), F.lit(-1).cast("long").alias("step"), F.round(x["share"] * UNITS).cast("long").alias("n"))),
    )
    judged = counted.where(F.col("lang").isNotNull() & (F.col("n_words") >= rules.word_judged_words) & ~base_failed(rules))
    counts = judged.select("lang", F.explode(named).alias("p")).select("lang", "p.*").groupBy("lang", "part", "step").agg(F.sum("n").alias("n"))
    value = F.when(F.col("part").startswith("c "), F.percentile("step", F.lit(0.5), F.col("n"))).otherwise(F.sum("n").cast("double"))
    found = counts.groupBy("lang", "part").agg(value.alias("value")).collect()
    n = len(CLASSES) + 1
    sums: dict[str, dict[str, float]] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["part"])):
        sums.setdefault(r["lang"], {})[r["part"]] = r["value"]
    out = {}
    for name, parts_of in sums.items():
        c = [parts_of.get(f"c {i}", 0.0) for i in range(n)]
        w = {k[2:]: v for k, v in parts_of.items() if k[0] == "w"}
        if sum(c) > 0 and sum(w.values()) > 0:
            out[name] = ([x / sum(c) for x in c], {k: v / sum(w.values()) for k, v in w.items()})
    return out


def _half(p: Column, q: Column) -> Column:
    """What a bin gives to twice the divergence, in bits."""
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    return part(p) + part(q)


def class_distance(shares_of: Column, reference: list[float]) -> Column:
    q = F.array(*map(F.lit, reference))
    total = F.aggregate(F.zip_with(shares_of, q, _half), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def word_distance(common: Column, reference: dict[str, float]) -> Column:
    """Bins that the text lacks give the reference's share each, so only the text's own bins are gone through."""
    table = F.create_map(*(F.lit(x) for kv in sorted(reference.items()) for x in kv))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("left"))

    def step(a: Column, x: Column) -> Column:
        return let(
            F.coalesce(table[x["word"]], F.lit(0.0)),
            lambda q: F.struct((a["sum"] + _half(x["share"], q)).alias("sum"), (a["left"] - q).alias("left")),
        )

    found = F.aggregate(common, start, step, lambda a: F.sqrt(F.greatest((a["sum"] + F.greatest(a["left"], F.lit(0.0))) / 2, F.lit(0.0))))
    return F.when(F.size(common) == 0, F.lit(1.0)).otherwise(found)  # no common word at all: as far as can be


def base_failed(rules: Rules) -> Column:
    return (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))


def most(limit: tuple[float, float]) -> Column:
    return F.lit(limit[0]) + F.lit(limit[1]) / F.sqrt("n_words")


def fit_limits(rows: list[tuple[int, float, bool]], floors: list[float], slopes: list[float], spare: float = 1.1) -> tuple[float, float]:
    """The limit (floor, slope) from (words, distance, good) rows that finds the most bad ones of those that ``spare`` times good distances keep to.

    Ties: the limit that lies farthest from the good ones, on average.
    """
    best = None
    for a in floors:
        for b in slopes:
            limit = [a + b / n**0.5 for n, _, _ in rows]
            if all(spare * d <= x for (_, d, good), x in zip(rows, limit, strict=True) if good):
                caught = sum(d > x for (_, d, good), x in zip(rows, limit, strict=True) if not good)
                found = (caught, sum(limit), (a, b))
                best = max(best, found) if best else found
    if best is None:
        raise ValueError("no limit keeps all good rows")
    return best[2]


def count(docs: DataFrame, text: str, lang: str, rules: Rules) -> DataFrame:
    """All that the rules need of each row, and the row itself; written, as the references and the verdicts both read it."""
    by_lang = top_words(docs, text, lang, rules.common_words)
    vocabulary = sorted({w for words in by_lang.values() for w in words})
    first = docs.select("row", F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(lang).cast("string").alias("lang"))
    counted = first.select("row", "text", "lang", words_of(F.col("text")).alias("words")).select(
        "row",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        duplicate_lines(F.col("text")).alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        class_counts(F.col("text")).alias("classes"),
        common_counts(F.col("words"), vocabulary).alias("common"),
    )
    return written(counted, "quality").withColumn("class_shares", shares(F.col("classes")))


def judge(
    docs: DataFrame, text: str = "text", lang: str = "lang", rules: Rules = Rules(), columns: list[str] | None = None
) -> DataFrame:
    """Columns ``row`` (the row as it came, or its ``columns``) and ``quality``: counts, distances, verdict of its whole text."""
    row = F.struct(*(F.col(f"`{c}`") for c in (docs.columns if columns is None else columns)))
    counted = count(docs.select(row.alias("row"), F.col(text).alias("text"), F.col(lang).alias("lang")), "text", "lang", rules)
    known = references(counted, rules)
    nothing = F.lit(None).cast("struct<word_distance:double,class_distance:double,lang:string>")
    near = (
        F.array_min(
            F.array(
                *(
                    F.struct(
                        word_distance(F.col("common"), w).alias("word_distance"),
                        class_distance(F.col("class_shares"), c).alias("class_distance"),
                        F.lit(name).alias("lang"),
                    )
                    for name, (c, w) in known.items()
                )
            )
        )
        if known
        else nothing
    )
    judged = (
        counted.withColumn("base_failed", base_failed(rules)).withColumn("near", F.when(F.col("n_words") >= rules.judged_words, near))
    )
    far_words = (F.col("n_words") >= rules.word_judged_words) & (F.col("near.word_distance") > most(rules.word_distance))
    far = (F.col("near.class_distance") > most(rules.class_distance)) | far_words
    return judged.select(
        "row",
        F.struct(
            "n_words",
            "word_chars",
            F.element_at("classes", list(CLASSES).index("symbol") + 1).alias("n_symbols"),
            "n_dup_lines",
            "n_repeat_words",
            "base_failed",
            (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept"),
            F.col("near.lang").alias("nearest_lang"),
            F.col("near.class_distance").alias("class_distance"),
            F.col("near.word_distance").alias("word_distance"),
        ).alias("quality"),
    )


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` whose text passes, with their columns."""
    return judge(docs, text, lang, rules).where("quality.kept").select("row.*")
