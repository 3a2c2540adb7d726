"""Licence scans, in DataFrame functions only.

A text's paragraphs are the blocks between blank lines (lines without a letter or
digit count as blank, so that comment frames do as well); wrapped lines are joined.
A paragraph is judged line by line and in overlapping windows of two sizes, the
larger one at least twice as long as any template, so that a notice is found
however it is wrapped and whatever stands around it.

A sparse multinomial logistic regression on word 1- and 2-grams names the licence
family of each of these passages, or ``unknown``.  Its probabilities are
calibrated by a temperature, fitted on templates that the weights of that fit
have not seen.  A prediction counts only if a template of that family confirms it:
enough of the template's word pairs stand in the passage.  The model is fitted on
the driver, on the texts in :mod:`wireloom.llm.license_texts` and variants by
rule; its weights are a small table that passages are joined with.  Weights are
whole numbers of 2^-16, so that sums don't depend on their order.

Only texts, paragraphs and passages that hold a stem (:data:`STEMS`) are judged;
all others are unknown by definition.  The rest of the plan runs over those only.

Defined results: null, empty and blank texts have no paragraphs and no licence.
Of passages of one paragraph and family the one that its template covers best is
told (ties: higher score, then the earlier, then the shorter).  Of families of one
kin (GNU, Creative Commons), whose notices share most of their words, one yields to
another that covers the same words better.  Repeated rows are rows like any other;
extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.functions.arrays import let
from wireloom.llm.license_texts import NAME_FRAMES, NAMES, OTHERS, TAG_FRAMES, TAGS, TEXTS
from wireloom.tables import written

UNKNOWN = "unknown"
#: Parts of words of which a passage holds one at least to be judged.
STEMS = ["licen", "copyright", "warrant", "redistribut", "permi", "gpl", "spdx", "cc0", "cc by", "cc-by", "waiv", "unencumbered", "apache", "artistic-", "bsl-", "bsd", "mpl-", "epl-", "commons"]
WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+){0,8}"
#: Words of the windows; they begin at every half.
WINDOWS = (40, 200)
#: A weight is so many units.
UNIT = 1 << 16
#: A line without a letter or digit between two line ends.
BLANK = r"\n[^\p{L}\p{N}]*\n"


@dataclass(frozen=True)
class Model:
    families: list[str]
    #: By n-gram: the weights of all families, in units.
    weights: dict[str, list[int]]
    bias: list[int]
    temperature: float
    #: (family, its word pairs) of each template.
    templates: list[tuple[str, list[str]]]


def words_in(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def pairs_in(words: list[str]) -> list[str]:
    return sorted(set(map(" ".join, zip(words, words[1:], strict=False))))


def grams_in(words: list[str]) -> list[str]:
    return sorted({*words, *pairs_in(words)})


def templates() -> list[tuple[str, str]]:
    """(family, notice): names and tags in all their frames, and the texts."""
    out = [(f, frame.format(n)) for f, names in NAMES.items() for n in names for frame in NAME_FRAMES]
    out += [(f, frame.format(t)) for f, tags in TAGS.items() for t in tags for frame in TAG_FRAMES]
    out += [(f, n) for f, names in NAMES.items() for n in names if len(words_in(n)) > 1]
    return out + [(f, t) for f, texts in TEXTS.items() for t in texts]


def _examples(rows: list[tuple[str, str]], rng: np.random.Generator) -> list[tuple[str, list[str]]]:
    """(family, words): notices whole, with words left out and with others around them; small parts of them are unknown."""
    noise = sorted({w for o in OTHERS for w in words_in(o)} | set("the of and to a in is that for it as was with be by on not he his but at are this have from or had an they which you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through".split()))
    out = []
    for family, text in rows:
        t = words_in(text)
        for k in range(3 if len(t) < 12 else 6):
            kept = [w for w in t if k == 0 or len(t) < 6 or rng.random() > 0.1]
            around = [str(w) for w in rng.choice(noise, int(rng.integers(0, 30)))]
            cut = int(rng.integers(0, len(around) + 1))
            out.append((family, around[:cut] + kept + around[cut:]))
        if len(t) > 12:
            at = int(rng.integers(0, len(t) - len(t) // 5))
            out.append((UNKNOWN, t[at : at + len(t) // 5] + [str(w) for w in rng.choice(noise, 8)]))
    return out


def _unknown(rows: list[str], rng: np.random.Generator) -> list[tuple[str, list[str]]]:
    noise = sorted({w for o in OTHERS for w in words_in(o)})
    return [(UNKNOWN, words_in(o) + [str(w) for w in rng.choice(noise, 5 * k)]) for o in rows for k in range(5)]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _matrix(rows: list[tuple[str, list[str]]], at: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(rows), len(at)), np.float32)
    for i, (_, w) in enumerate(rows):
        x[i, [at[g] for g in grams_in(w) if g in at]] = 1
    return x


def _fit(rows: list[tuple[str, list[str]]], at: dict[str, int], families: list[str], l1: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of a sparse multinomial regression, by proximal gradient steps with momentum."""
    x, y = _matrix(rows, at), np.eye(len(families), dtype=np.float32)[[families.index(f) for f, _ in rows]]
    w = old = np.zeros((len(at), len(families)), np.float32)
    b = np.zeros(len(families), np.float32)
    b[-1] = 1.0  # what holds no feature is unknown
    for k in range(rounds):
        ahead = w + (k / (k + 3)) * (w - old)
        g = (_softmax(x @ ahead + b) - y) / len(rows)
        step = 0.5
        now = ahead - step * (x.T @ g)
        old, w = w, np.sign(now) * np.maximum(np.abs(now) - step * l1, 0)
    return w, b


def held_out(rows: list[tuple[str, str]]) -> list[bool]:
    """Every fifth template of a family is kept from the fit that the temperature is found with."""
    seen: dict[str, int] = {}
    out = []
    for family, _ in rows:
        seen[family] = seen.get(family, 0) + 1
        out.append(seen[family] % 5 == 0)
    return out


@cache
def model(l1: float = 2e-4, rounds: int = 150) -> Model:
    """Every call gives the same model."""
    rng = np.random.default_rng(11)
    rows = templates()
    families = sorted(NAMES) + [UNKNOWN]
    out = held_out(rows)
    inside = _examples([r for r, o in zip(rows, out, strict=True) if not o], rng) + _unknown(OTHERS[::2], rng)
    outside = _examples([r for r, o in zip(rows, out, strict=True) if o], rng) + _unknown(OTHERS[1::2], rng)
    # n-grams that only chance put together are no features
    plain = [t for _, t in rows] + OTHERS
    at = {g: i for i, g in enumerate(sorted({g for t in plain for g in grams_in(words_in(t))}))}
    w, b = _fit(inside, at, families, l1, rounds)
    logits = _matrix(outside, at) @ w + b
    y = np.eye(len(families))[[families.index(f) for f, _ in outside]]
    losses = {t: -(y * np.log(_softmax(logits / t) + 1e-12)).sum() for t in np.geomspace(0.1, 5, 50)}
    temperature = float(min(losses, key=losses.get))
    w, b = _fit(inside + outside, at, families, l1, rounds)
    units = np.rint(w * UNIT).astype(int)
    kept = {g: units[i].tolist() for g, i in at.items() if units[i].any()}
    return Model(families, kept, np.rint(b * UNIT).astype(int).tolist(), temperature, [(f, pairs_in(words_in(t))) for f, t in rows])


def has_stem(text: Column) -> Column:
    return F.array_max(F.array(*(F.contains(text, F.lit(s)) for s in STEMS)))


def passages(base: DataFrame) -> DataFrame:
    """(row, paragraph, start, words) of the passages with a stem of ``base`` (row, text); start: the first word's place in its paragraph.

    Lines begin at words as well; a passage that is there twice is there once.
    """
    blocks = base.select("row", F.posexplode(F.split("text", BLANK)).alias("paragraph", "block")).withColumn("block", F.lower("block")).where(has_stem(F.col("block")))
    cut = blocks.withColumn("lines", F.transform(F.split("block", "\n"), _words)).withColumn("words", F.flatten("lines"))

    def window(size: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size("words") - size // 2 - 1, F.lit(0)), F.lit(size // 2))
        return F.transform(starts, lambda i: F.struct(i.alias("start"), F.slice("words", i + 1, size).alias("words")))

    before = F.aggregate("lines", F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + F.size(x)))
    of_lines = let(
        before,
        lambda at: F.filter(F.transform("lines", lambda x, i: F.struct(F.get(at, i).alias("start"), x.alias("words"))), lambda p: (F.size(p["words"]) > 0) & (F.size(p["words"]) <= WINDOWS[-1])),
    )
    every = F.concat(of_lines, *map(window, WINDOWS))
    found = cut.select("row", "paragraph", F.explode(F.filter(every, lambda p: has_stem(F.array_join(p["words"], " ")))).alias("p"))
    return found.groupBy("row", "paragraph", "p.words").agg(F.min("p.start").alias("start"))


def _words(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(f"({WORD})"), F.lit(1))


def judged(found: DataFrame, fitted: Model, containment: float, min_score: float) -> DataFrame:
    """``found`` passages (row, paragraph, start, n_words) with family, score and template_share."""
    spark = found.sparkSession
    n = len(fitted.families)
    at: dict[str, list[int]] = {}
    for i, (_, pairs) in enumerate(fitted.templates):
        for p in pairs:
            at.setdefault(p, []).append(i)
    rows = [(g, *fitted.weights.get(g, [0] * n), at.get(g, [])) for g in sorted({*fitted.weights, *at})]
    kind = "gram string, " + ", ".join(f"w{k} int" for k in range(n)) + ", of array<int>"
    table = F.broadcast(spark.createDataFrame(rows, kind))  # of fixed size: the model's features

    both = F.transform(F.sequence(F.lit(0), F.size("words") - 2), lambda i: F.concat(F.get("words", i), F.lit(" "), F.get("words", i + 1)))
    grams = F.array_distinct(F.concat("words", F.when(F.size("words") > 1, both).otherwise(F.array().cast("array<string>"))))
    keys = ["row", "paragraph", "start", "n_words", "name"]
    # passages that begin together and are as long may still differ, where lines were split
    hits = found.select("row", "paragraph", "start", F.size("words").alias("n_words"), F.xxhash64("words").alias("name"), F.explode(grams).alias("gram")).join(table, "gram")
    sums = hits.groupBy(*keys).agg(*(F.sum(f"w{k}").alias(f"w{k}") for k in range(n)), F.flatten(F.collect_list("of")).alias("of"))
    z = F.array(*((F.col(f"w{k}") + b) / UNIT for k, b in enumerate(fitted.bias)))
    scored = sums.withColumn("z", z).withColumn("best", F.array_position("z", F.array_max("z")).cast("int") - 1)
    e = F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp((v - F.array_max("z")) / F.lit(fitted.temperature)))
    by_family = [[i for i, (f, _) in enumerate(fitted.templates) if f == family] for family in fitted.families]
    own = F.get(F.array(*(F.array(*map(F.lit, ids)) if ids else F.array().cast("array<int>") for ids in by_family)), F.col("best"))
    sizes = F.array(*(F.lit(len(p)) for _, p in fitted.templates))
    shares = F.transform(own, lambda t: F.size(F.filter("of", lambda x: x == t)) / F.get(sizes, t))
    share = F.coalesce(F.array_max(shares), F.lit(0.0))
    told = scored.select(*keys[:-1], "best", (F.lit(1.0) / e).alias("score"), share.alias("template_share"))
    sure = (F.col("best") < n - 1) & (F.col("score") >= min_score) & (F.col("template_share") >= containment)
    name = F.when(sure, F.get(F.array(*map(F.lit, fitted.families)), F.col("best"))).otherwise(F.lit(UNKNOWN))
    return told.withColumn("family", name).drop("best")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", containment: float = 0.6, min_score: float = 0.5) -> DataFrame:
    """key, ``licences`` (paragraph, family, score, template_share, start, n_words of each licence of a paragraph), and ``n_unknown``.

    n_unknown: paragraphs with a stem and without a licence.
    """
    whole = F.col(f"`{text}`").cast("string")
    near = F.when(has_stem(F.lower(whole)), whole)
    base = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), near.alias("text")), "texts")
    found = judged(passages(base.where("text is not null").select("row", "text")), model(), containment, min_score)
    order = F.struct(F.col("template_share"), "score", (-F.col("start")).alias("s"), (-F.col("n_words")).alias("n"))
    best = found.groupBy("row", "paragraph", "family").agg(F.max(order).alias("o"))
    kin = F.when(F.endswith("family", F.lit("gpl")), "gnu").when(F.startswith("family", F.lit("cc")), "cc").otherwise(F.col("family"))
    licence = F.struct("paragraph", "family", F.col("o.score").alias("score"), F.col("o.template_share").alias("template_share"), (-F.col("o.s")).alias("start"), (-F.col("o.n")).alias("n_words"), kin.alias("kin"))
    named = best.groupBy("row").agg(
        F.sort_array(F.collect_list(F.when(F.col("family") != UNKNOWN, licence))).alias("all"),
        (F.count_distinct("paragraph") - F.count_distinct(F.when(F.col("family") != UNKNOWN, F.col("paragraph")))).alias("n_unknown"),
    )

    def yields(x: Column) -> Column:
        meets = lambda y: (y["start"] < x["start"] + x["n_words"]) & (x["start"] < y["start"] + y["n_words"])
        return F.exists("all", lambda y: (y["paragraph"] == x["paragraph"]) & (y["kin"] == x["kin"]) & (y["template_share"] > x["template_share"]) & meets(y))

    kept = F.transform(F.filter("all", lambda x: ~yields(x)), lambda x: x.dropFields("kin"))
    named = named.select("row", kept.alias("licences"), "n_unknown")
    none = F.array().cast("array<struct<paragraph:int,family:string,score:double,template_share:double,start:int,n_words:int>>")
    return base.join(named, "row", "left").select(F.col("key").alias(key), F.coalesce("licences", none).alias("licences"), F.coalesce("n_unknown", F.lit(0).cast("long")).alias("n_unknown"))
