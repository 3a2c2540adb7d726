"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Features are the 1- to 3-grams of the lower-cased code points, hashed into a
fixed space.  Document frequencies come from all training documents.  The model
is fitted on a bounded sample (``per_language`` documents of each language, by a
hash of the key) with follow-the-regularised-leader, L1 and L2 penalties; a part
of the sample that is left out sets the temperature of the probabilities.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
so is every text where no document is labelled.  Equal texts get equal results;
of equal probabilities the language that comes first in order wins.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wireloom.llm.shared import small_batches

BUCKETS, ORDERS, SEGMENT = 1 << 15, (1, 2, 3), 1 << 20
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    #: Bound of the sample that the classifier is fitted on: documents of each language.
    per_language: int = 300
    epochs: int = 3
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02
    calibration_share: float = 0.2


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS + 1, 0), np.float32))
    temperature: float = 1.0

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        at, value = vector(counts, self.idf)
        return softmax((value @ self.weights[at] + self.weights[BUCKETS]) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def gram_counts(text: str) -> np.ndarray:
    """How often each bucket's n-grams stand in a text of any length; long texts go through segment by segment."""
    total = np.zeros(BUCKETS, np.int64)
    text = text.lower()
    for start in range(0, len(text), SEGMENT):
        points = np.frombuffer(text[start : start + SEGMENT + max(ORDERS) - 1].encode("utf-32-le", "surrogatepass"), "<u4")
        size = min(SEGMENT, len(text) - start)
        mixed = np.zeros(len(points), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            whole = len(points) - n + 1
            if whole <= 0:
                break
            mixed = (mixed[:whole] * np.uint32(0x01000193)) ^ (points[n - 1 :] * np.uint32(0x9E3779B1))
            if n in ORDERS:
                here = mixed[:size]
                total += np.bincount((here ^ (here >> np.uint32(15))) & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    return total


def vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their TF-IDF values (logarithmic frequency, unit length)."""
    at = np.flatnonzero(counts)
    value = (1 + np.log(counts[at])) * idf[at]
    norm = np.sqrt(value @ value)
    return at, (value / norm if norm > 0 else value).astype(np.float32)


def fit(sample: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray, settings: Settings) -> Model:
    """A model from (language, buckets, counts) rows in any order; the same rows give the same model."""
    languages = sorted({s[0] for s in sample})
    model = Model(languages, idf)
    if not languages:
        return model
    rows = []
    for lang, at, counts in sample:
        full = np.zeros(BUCKETS, np.int64)
        full[at] = counts
        rows.append((languages.index(lang), *vector(full, idf)))
    order = np.random.default_rng(7).permutation(len(rows))
    left_out = order[: int(len(rows) * settings.calibration_share)] if len(rows) >= 20 else order[:0]
    train = order[len(left_out) :]
    k = len(languages)
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - settings.l1, 0)
        return -shrunk / ((settings.beta + np.sqrt(ns)) / settings.alpha + settings.l2)

    for _ in range(settings.epochs):
        for i in train:
            y, at, value = rows[i]
            at, value = np.append(at, BUCKETS), np.append(value, np.float32(1))
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            p = softmax(value @ w)
            p[y] -= 1
            g = np.outer(value, p)
            g2 = ns + g * g
            z[at] = zs + g - (np.sqrt(g2) - np.sqrt(ns)) / settings.alpha * w
            n[at] = g2
    model.weights = weights(z, n).astype(np.float32)
    if len(left_out):
        logits = [(rows[i][0], rows[i][2] @ model.weights[rows[i][1]] + model.weights[BUCKETS]) for i in left_out]
        # smoothed targets: a sample without a mistake mustn't make the model certain
        eps = 1 / (len(logits) + 2)
        target = np.full((k, k), eps / max(1, k - 1)) + np.eye(k) * (1 - eps - eps / max(1, k - 1))
        losses = {t: -sum(target[y] @ np.log(softmax(x / t) + 1e-12) for y, x in logits) for t in np.geomspace(0.05, 5, 60)}
        model.temperature = float(min(losses, key=losses.get))
    return model


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", settings: Settings = Settings()) -> Model:
    """A model from all rows of ``labelled`` (frequencies) and a bounded sample of them (weights).

    What comes to the driver: a count for each bucket, and the sample's sparse counts.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).cast("string").alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")
    )

    def frequencies(batches):
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for x in batch.column(0):
                total += gram_counts(x.as_py()) > 0
                n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], n), pa.int64())], names=["bucket", "n"]
        )

    found = rows.select("text").mapInArrow(frequencies, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df = {r["bucket"]: r["n"] for r in found}
    n_docs = df.pop(-1, 0)
    idf = np.full(BUCKETS, np.log(1 + n_docs) + 1, np.float32)
    for bucket, n in df.items():
        idf[bucket] = np.log((1 + n_docs) / (1 + n)) + 1

    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key"))
    chosen = rows.select("key", "lang").withColumn("rank", rank).where(F.col("rank") <= settings.per_language).select("key").distinct()

    def sparse(batches):
        for batch in batches:
            langs, ats, values = [], [], []
            for x, name in zip(batch.column(0), batch.column(1), strict=True):
                counts = gram_counts(x.as_py())
                at = np.flatnonzero(counts)
                langs.append(name.as_py())
                ats.append(at.astype("<u2").tobytes())
                values.append(np.minimum(counts[at], 65535).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(ats, pa.binary()), pa.array(values, pa.binary())], names=["lang", "at", "n"]
            )

    # a repeated key may bring more rows: the sample is cut to its bound here as well
    sample = rows.join(F.broadcast(chosen), "key", "left_semi").select("text", "lang").mapInArrow(sparse, "lang string, at binary, n binary")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("at", "n"))
    kept = sample.withColumn("rank", rank).where(F.col("rank") <= settings.per_language).orderBy("lang", "at", "n").collect()
    return fit([(r["lang"], np.frombuffer(r["at"], "<u2"), np.frombuffer(r["n"], "<u2")) for r in kept], idf, settings)


def predicted(text: Column, model: Model) -> Column:
    """Struct ``lang_pred``, ``score`` for each whole text."""
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("lang_pred string, score double")
    def predict(column: pa.Array) -> pa.Array:
        out = []
        for x in column.to_pylist():
            if not model.languages or not has_letter(x):
                out.append({"lang_pred": UNKNOWN, "score": 0.0})
            else:
                p = model.probabilities(gram_counts(x))
                best = int(p.argmax())
                out.append({"lang_pred": model.languages[best], "score": float(p[best])})
        return pa.array(out, kind)

    return predict(text)


def held_out(key: str) -> Column:
    """Rows that training must not see: a fourth of the keys, by their CRC."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", settings: Settings = Settings()) -> DataFrame:
    """key, held_out, lang_pred and score of every row; learned from the rows that aren't held out."""
    model = train(docs.where(~held_out(key)), key, text, lang, settings)
    small_batches(docs.sparkSession)
    return docs.select(F.col(key), held_out(key).alias("held_out"), predicted(F.col(text), model).alias("p")).select(key, "held_out", "p.*")


def keep_known(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", min_score: float = 0.5, settings: Settings = Settings()
) -> DataFrame:
    """The rows of ``docs`` in a language that was learned, with at least ``min_score``; their columns stay as they are."""
    model = train(docs.where(~held_out(key)), key, text, lang, settings)
    small_batches(docs.sparkSession)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    judged = docs.select(row, predicted(F.col(text), model).alias("p"))
    return judged.where((F.col("p.lang_pred") != UNKNOWN) & (F.col("p.score") >= min_score)).select("row.*")
