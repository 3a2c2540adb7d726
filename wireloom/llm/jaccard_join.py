"""N-gram Jaccard join of documents, and the groups that its links form.

A document's set holds its distinct word n-grams (a text with fewer words: the
whole of them as one).  Two sets link when ``100 * shared >= percent * union``.

Order and prefix.  A fixed-size table of counters, filled from all documents,
gives each n-gram a frequency class; class and hash make one number, and sets
are sorted by it: rare first.  Linked sets share an n-gram in the first
``n - ceil(percent * n / 100) + 1`` places.  Documents with equal sets are one
set from here on, named by a 64-bit signature.

Candidates.  Prefix n-grams are shuffled and sorted.  Each list of the sets
that share one is streamed: its first set, the one with the fewest rarer
n-grams, is paired with every other (a star, not all pairs), if the length and
positional filters pass.  A suffix filter follows that needs no texts: a set's
outline tells how many of its n-grams lie in each of some ranges, and two sets
share at most the smaller count of each.  Each pair that is left is verified
once, on the whole texts.  Links make components.  Only in lists that still touch several
components can a link be missing that matters: there every set outside the
list's largest component meets the sets of other components, and what passes the
filters is verified as well, so no component is ever short of a link.  These
lists are cut into blocks, so that no task meets more than a block's pairs.
N-grams whose counter stands out from the others by more than ``list_part`` are
salted; the first sets of the parts of a list are then starred among themselves.

Rows, not keys, carry the texts: each row has a number of its own.

Defined results: null, empty and blank texts have no n-grams and are alone.
Repeated rows and equal texts share a component.  A null key names no component
unless all its keys are null, but its text links like any other.  A key on rows
with different texts is judged row by row.  Ties don't arise: the smallest key
names a component.  Empty tables give empty results; extra columns are ignored.
Two different sets whose signatures agree are told apart by a second signature.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.llm.byte_bpe import grouped
from wireloom.llm.shared import small_batches
from wireloom.operators.components import components
from wireloom.tables import forgotten, let_go, written

WORDS, PERCENT = 5, 75
#: Counters of the frequency table and how they are cut for summing; 2 ** TABLE_BITS bytes are broadcast.
TABLE_BITS, SLICES, FAN_IN = 22, 64, 64
#: Bits of the number by which sets are sorted that hold the class.
CLASS_BITS = 7
#: Sets that one part of a list may hold, about.
LIST_PART = 1 << 20
#: Sets of a block of a list in which components meet.
BLOCK_SETS = 2048
#: Numbers of rows whose texts are asked for that are broadcast (about 25 bytes each); more are shuffled, with the same result.
WANTED = 1 << 21
#: Bits that names of sets keep; fewer in tests, so that names agree.
NAME_MASK = (1 << 64) - 1
#: Bytes of text that are hashed at once (a worker takes about 60 times that), and rows that a scan holds at once.
CHUNK_BYTES, SCAN_ROWS = 512 << 10, 512
#: A set's outline has two to this power of ranges at least; a count of 255 stands for more as well.
LEAST_BITS = 8
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
_BYTES = None
_POWERS = np.ones(1, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    """Powers of an odd number, from 0 on; the table grows with the longest word seen."""
    global _POWERS
    if len(_POWERS) < n:
        size = max(64, 2 * n)
        _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _ODD[0], np.uint64)]), dtype=np.uint64)
    return _POWERS


def gram_hashes(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Of each UTF-8 text the sorted distinct 64-bit hashes of its word n-grams."""
    global _BYTES
    if _BYTES is None:
        folded = np.arange(256, dtype=np.uint64)
        folded[65:91] += np.uint64(32)  # A-Z
        _BYTES = _mix((folded + np.uint64(1)) * _ODD[0])
    none = np.zeros(0, np.uint64)
    sizes = [len(t) for t in texts]
    raw = np.frombuffer(b" ".join(texts), np.uint8)
    if not len(raw):
        return [none] * len(texts)
    black = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.diff(black.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return [none] * len(texts)
    at = np.flatnonzero(black)
    length = ends - starts
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    place = np.arange(len(at)) - np.repeat(first, length)
    word = _mix(np.add.reduceat(_BYTES[raw[at]] * _powers(int(length.max()))[place], first) + length.astype(np.uint64))
    power = _powers(words + 1)
    grams = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for k in range(words):
        grams += word[k : k + len(grams)] * power[k + 1]
    grams = _mix(grams)
    text_ends = np.cumsum(np.array(sizes, np.int64) + 1)
    cuts = np.searchsorted(starts, np.concatenate([[0], text_ends]))
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if a == b:
            out.append(none)
        elif b - a < words:
            out.append(_mix((word[a:b] * power[1 : b - a + 1]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            own = np.sort(grams[a : b - words + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
    return out


def signature(hashes: np.ndarray, seed: int = 0) -> int:
    """A signed 64-bit name of a set."""
    total = _mix(hashes + _ODD[seed]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(hashes))
    return int(_mix(total).view(np.int64)[0])


def names_of(hashes: np.ndarray, mask: int) -> tuple[int, int]:
    """A set's name, cut to a mask, and its second signature."""
    return int(np.uint64(signature(hashes) & mask & 0xFFFFFFFFFFFFFFFF).view(np.int64)), signature(hashes, 1)


def ranked(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The numbers by which a set is sorted, sorted: frequency class first, hash after it."""
    cell = classes[(hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)].astype(np.uint64)
    return np.sort((cell << np.uint64(64 - CLASS_BITS)) | (hashes >> np.uint64(CLASS_BITS)))


def class_of(counts: np.ndarray) -> np.ndarray:
    return np.floor(4 * np.log2(1 + counts.astype(np.float64))).astype(np.uint8).clip(0, (1 << CLASS_BITS) - 1)


def outline(hashes: np.ndarray) -> bytes | None:
    """How many n-grams a set has in each of equal ranges, a byte a range and two to four n-grams in most; none of an empty set."""
    if not len(hashes):
        return None
    bits = max(LEAST_BITS, len(hashes).bit_length() - 2)
    counts = np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.clip(0, 255).astype(np.uint8).tobytes()


def most_shared(x: bytes, y: bytes) -> int:
    """At most so many n-grams are shared by the sets with these outlines; ranges of the finer one are taken together."""
    ranges, counts = min(len(x), len(y)), []
    for told in (np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)):
        told = told.reshape(ranges, -1)
        counts.append(np.where((told == 255).any(axis=1), 1 << 40, told.sum(axis=1, dtype=np.int64)))
    return int(np.minimum(*counts).sum())


def least_shared(a: int, b: int, percent: int = PERCENT) -> int:
    """The fewest shared n-grams that link sets of these sizes."""
    return -(-percent * (a + b) // (100 + percent))


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 3) -> int:
    """At most so many numbers are in both sorted arrays: halves around a number of one must pair with those of the other."""
    if not len(x) or not len(y) or not depth:
        return min(len(x), len(y))
    middle = len(y) // 2
    at = int(np.searchsorted(x, y[middle]))
    same = int(at < len(x) and x[at] == y[middle])
    return suffix_bound(x[:at], y[:middle], depth - 1) + same + suffix_bound(x[at + same :], y[middle + 1 :], depth - 1)


def linked(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets link; the filters first, then the shared numbers are counted."""
    need = least_shared(len(x), len(y), percent)
    if need > min(len(x), len(y)) or suffix_bound(x, y) < need:
        return False
    both = np.sort(np.concatenate([x, y]))
    return int((both[1:] == both[:-1]).sum()) >= need


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [x or b"" for x in batch.column(name).cast(pa.large_binary()).to_pylist()]


def describe(docs: DataFrame, words: int, mask: int) -> DataFrame:
    """The rows of ``docs`` (doc, text, rest) with number, n, s, s2 and outline, and rows (slice, counts) of the tasks' frequency tables."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    told = "number bigint, n bigint, s bigint, s2 bigint, outline binary, slice int, counts binary"
    own = list(kinds)

    def run(batches):
        table = np.zeros(1 << TABLE_BITS, np.uint32)
        number, types = TaskContext.get().partitionId() << 33, None
        for batch in batches:
            types = [batch.schema.field(c).type for c in own]
            texts = _texts(batch, "text")
            for group in grouped(texts, CHUNK_BYTES):
                sets = gram_hashes([texts[i] for i in group], words)
                full = [s for s in sets if len(s)]
                if full:
                    cells = (np.concatenate(full) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
                    table += np.bincount(cells, minlength=len(table)).astype(np.uint32)
                n = len(group)
                names = [names_of(s, mask) if len(s) else (None, None) for s in sets]
                made = [
                    pa.array(np.arange(number, number + n)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([x for x, _ in names], pa.int64()),
                    pa.array([x for _, x in names], pa.int64()),
                    pa.array([outline(s) for s in sets], pa.binary()),
                    pa.nulls(n, pa.int32()),
                    pa.nulls(n, pa.binary()),
                ]
                number += n
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(group[0], n) for c in own), *made], names=[*own, *made_names])
        if types:
            parts = [zlib.compress(p.tobytes(), 1) for p in table.reshape(SLICES, -1)]
            nothing = [pa.nulls(SLICES, t) for t in [*types, *[pa.int64()] * 4, pa.binary()]]
            yield pa.RecordBatch.from_arrays([*nothing, pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names=[*own, *made_names])

    made_names = ["number", "n", "s", "s2", "outline", "slice", "counts"]
    return docs.mapInArrow(run, ", ".join([f"{c} {k}" for c, k in kinds.items()] + [told]))


def frequency_classes(parts: DataFrame, n_parts: int) -> np.ndarray:
    """The classes of all counters, from the tasks' tables; never more than :data:`FAN_IN` tables meet in one call."""

    def add(_, group):
        total = np.zeros((1 << TABLE_BITS) // SLICES, np.uint64)
        for x in group.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(x), np.uint32)
        kept = zlib.compress(np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1)
        return pa.table({"slice": group.column("slice").slice(0, 1), "counts": pa.array([kept], pa.binary())})

    parts = parts.select("slice", "counts")
    while n_parts > 1:
        n_parts = -(-n_parts // FAN_IN)
        # by content, so that a repeated task deals its rows in the same way
        spread = F.pmod(F.xxhash64("slice", "counts"), F.lit(n_parts))
        parts = parts.withColumn("part", spread).groupBy("slice", "part").applyInArrow(add, "slice int, counts binary")
    out = np.zeros((SLICES, (1 << TABLE_BITS) // SLICES), np.uint32)
    for r in parts.collect():
        out[r["slice"]] = np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
    # what a counter holds by chance alone says nothing about one n-gram
    return class_of(np.maximum(out.ravel().astype(np.int64) - 2 * int(out.mean()), 1))


def postings(docs: DataFrame, classes, words: int, percent: int, list_part: int) -> DataFrame:
    """(gram, salt, s, n, place) of each number in the prefix of each row's set; ``docs`` has s and text.

    salt: 0, or the part (from 1 on) of a list that is likely to hold more than ``list_part`` sets.
    """

    def run(batches):
        for batch in batches:
            texts, names = _texts(batch, "text"), batch.column("s").to_numpy(zero_copy_only=False)
            for group in grouped(texts, CHUNK_BYTES):
                sets = gram_hashes([texts[i] for i in group], words)
                n = np.array([len(s) for s in sets])
                size = n + (-percent * n // 100) + 1
                name = np.repeat(names[group], size)
                gram = np.concatenate([ranked(s, classes.value)[:k] for s, k in zip(sets, size.tolist(), strict=True)])
                place = np.arange(len(gram)) - np.repeat(np.cumsum(size) - size, size)
                about = np.exp2((gram >> np.uint64(64 - CLASS_BITS)).astype(np.float64) / 4)
                parts = np.ceil(about / list_part).clip(1).astype(np.uint64)
                salt = np.where(parts > 1, name.view(np.uint64) % parts + np.uint64(1), 0)
                arrays = [gram.view(np.int64), salt.astype(np.int32), name, np.repeat(n, size).astype(np.int32), place.astype(np.int32)]
                for a in range(0, len(gram), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 100_000]) for x in arrays], names=["gram", "salt", "s", "n", "place"])

    return docs.mapInArrow(run, "gram bigint, salt int, s bigint, n int, place int")


def stars(rows: DataFrame) -> DataFrame:
    """Each list's sets beside its first set: (gram, salt, first, first_n, first_place, s, n, place, nth).

    First comes the set that has the fewest rarer n-grams before this one: the
    least altered copy, to which the others most likely link.  Lists of one set
    give no rows; parts of salted lists give their first set beside itself as
    well.  A list is streamed; only the row before is held.
    """
    together = rows.repartition("gram", "salt").sortWithinPartitions("gram", "salt", "place", "s")

    def run(batches):
        last = None  # the head of the list that may go on, its last set, and how many sets it has
        for batch in batches:
            gram, salt, s, n, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "salt", "s", "n", "place"))
            if not len(gram):
                continue
            if last is not None:  # the list goes on as if it began here, with its head
                gram, salt, s, n, place = (np.concatenate([[x], y]) for x, y in zip(last[0], (gram, salt, s, n, place), strict=True))
            new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1])])
            again = np.concatenate([[False], s[1:] == s[:-1]]) & ~new  # equal texts
            if last is not None and len(s) > 1 and not new[1] and s[1] == last[1]:
                again[1] = True
            kept = np.flatnonzero(~again)
            gram, salt, s, n, place, new = (x[kept] for x in (gram, salt, s, n, place, new))
            head = np.flatnonzero(new)
            of = np.repeat(head, np.diff(np.append(head, len(gram))))
            nth = np.arange(len(gram)) - of
            if last is not None:
                nth = np.where((of == 0) & (nth > 0), nth + last[2] - 1, nth)
            headed = (of != np.arange(len(gram))) | (salt > 0)
            headed[0] &= last is None or (of != np.arange(len(gram)))[0]
            out = np.flatnonzero(headed)
            at = of[-1]
            last = ([x[at] for x in (gram, salt, s, n, place)], s[-1], int(nth[-1]) + 1 if nth[-1] or at != 0 or last is None else last[2])
            if len(out):
                h = of[out]
                arrays = [gram[out], salt[out], s[h], n[h], place[h], s[out], n[out], place[out], nth[out]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.astype(t)) for x, t in zip(arrays, ["i8", "i4", "i8", "i4", "i4", "i8", "i4", "i4", "i8"], strict=True)],
                    names=["gram", "salt", "first", "first_n", "first_place", "s", "n", "place", "nth"],
                )

    return together.mapInArrow(run, "gram bigint, salt int, first bigint, first_n int, first_place int, s bigint, n int, place int, nth bigint")


def may_link(a_n, a_place, b_n, b_place, percent: int = PERCENT):
    """Length and positional filter: what two sets can share from these places on is enough."""
    rest = F.least(F.col(a_n) - F.col(a_place), F.col(b_n) - F.col(b_place))
    return (100 + percent) * rest >= percent * (F.col(a_n) + F.col(b_n))


def outlined(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the outlines of their sets (s, n, outline) leave: the suffix filter, before any text is moved."""
    right = sets.select(F.col("s").alias("b"), F.col("n").alias("b_n"), F.col("outline").alias("b_outline"))
    left = sets.select(F.col("s").alias("a"), F.col("n").alias("a_n"), F.col("outline").alias("a_outline"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "a_n", "b_n", "a_outline", "b_outline")

    def run(batches):
        for batch in batches:
            need = least_shared(batch.column("a_n").to_numpy(), batch.column("b_n").to_numpy(), percent)
            most = [most_shared(x, y) for x, y in zip(batch.column("a_outline").to_pylist(), batch.column("b_outline").to_pylist(), strict=True)]
            keep = pa.array(np.array(most, np.int64) >= need)
            yield batch.select(["a", "b"]).filter(keep)

    return both.mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, each verified once on the whole texts ``texts`` (s, text)."""
    small_batches(pairs.sparkSession)
    left = texts.select(F.col("s").alias("a"), F.col("text").alias("a_text"))
    right = texts.select(F.col("s").alias("b"), F.col("text").alias("b_text"))
    # the second join brings the pairs of a set together: its text is read once for a run of them
    both = pairs.join(right, "b").join(left, "a")

    def run(batches):
        name, own = None, None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            a_texts, b_texts = batch.column("a_text"), _texts(batch, "b_text")
            keep = []
            for i, other in enumerate(x for g in grouped(b_texts, CHUNK_BYTES) for x in gram_hashes([b_texts[k] for k in g], words)):
                if a[i] != name:
                    name, own = a[i], gram_hashes([(a_texts[i].as_py() or "").encode()], words)[0]
                keep.append(linked(own, other, percent))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, k in zip(a, keep, strict=True) if k], pa.int64()), pa.array([x for x, k in zip(b, keep, strict=True) if k], pa.int64())],
                names=["a", "b"],
            )

    return both.select("a", "b", "a_text", "b_text").mapInArrow(run, "a bigint, b bigint")


def across_components(lists: DataFrame, found: DataFrame, percent: int, block: int) -> DataFrame:
    """Pairs (a, b) of sets of one list that lie in different components and pass the filters.

    One of the two lies outside the list's largest component.  Both sides of a
    list go into blocks: a task meets block by block, whatever a list holds.
    """
    long = lists.where("nth > 1 or salt > 0").select("gram").distinct()
    near = lists.join(long, "gram", "left_semi")
    firsts = near.where("nth = 1 or salt > 0").select("gram", F.col("first").alias("s"), F.col("first_n").alias("n"), F.col("first_place").alias("place"))
    # dealt by list and set: a join by list alone can then be split where a list is long
    rows = near.select("gram", "s", "n", "place").unionByName(firsts).repartition("gram", "s").distinct()
    rows = rows.join(found, "s", "left").select("gram", "s", "n", "place", F.coalesce("component", "s").alias("c"))
    counts = rows.groupBy("gram", "c").agg(F.count("*").alias("k")).groupBy("gram")
    mixed = counts.agg(F.max(F.struct("k", "c")).alias("most"), F.sum("k").alias("k"), F.count("*").alias("parts")).where("parts > 1")
    mixed = mixed.select(
        "gram",
        F.col("most.c").alias("main"),
        F.ceil(F.col("k") / block).cast("int").alias("blocks"),
        F.ceil((F.col("k") - F.col("most.k")) / block).cast("int").alias("other_blocks"),
    )
    rows = written(rows.join(mixed, "gram").select("gram", "s", "n", "place", "c", "main", "blocks", "other_blocks"), "members")

    def to(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def own(n: str) -> Column:
        return F.pmod(F.xxhash64("s"), F.col(n)).cast("int")

    every = rows.select("gram", "s", "n", "place", "c", own("blocks").alias("i"), to("other_blocks").alias("j"))
    other = rows.where("c <> main").select("gram", F.col("s").alias("s2"), F.col("n").alias("n2"), F.col("place").alias("place2"), F.col("c").alias("c2"), F.col("main"), own("other_blocks").alias("j"), to("blocks").alias("i"))
    # of two sets outside the largest component each pair comes up once
    once = (F.col("c") == F.col("main")) | (F.col("c") < F.col("c2"))
    met = every.join(other, ["gram", "i", "j"]).where((F.col("c") != F.col("c2")) & once & may_link("n", "place", "n2", "place2", percent))
    return met.select(F.least("s", "s2").alias("a"), F.greatest("s", "s2").alias("b")).distinct()


def linked_rows(docs: DataFrame, key: str, text: str, words: int, percent: int, list_part: int, block: int, mask: int, rest: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows (number, doc, text, rest, n, s), and the components (s, component) of sets that link with others, by their smallest names."""
    spark = docs.sparkSession
    small_batches(spark)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(SCAN_ROWS))
    carried = F.struct(*(F.col(f"`{c}`") for c in rest)) if rest else F.lit(None).cast("string")
    own = docs.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"), carried.alias("rest"))
    told = written(describe(own, words, mask), "sets")
    tables = told.where(F.col("slice").isNotNull())
    classes = spark.sparkContext.broadcast(frequency_classes(tables, tables.where("slice = 0").count()))
    rows = told.where(F.col("slice").isNull()).drop("slice", "counts")
    # few, if any: sets that differ and have one name; they are named by their second signature
    twice = [r.s for r in rows.where("n > 0").groupBy("s").agg(F.min("s2").alias("low"), F.max("s2").alias("high")).where("low <> high").select("s").collect()]
    if twice:
        rows = rows.withColumn("s", F.when(F.col("s").isin(twice), F.col("s2")).otherwise(F.col("s")))
    full = rows.where("n > 0")
    sets = full.select("s", "n", "outline").distinct()

    lists = first = written(stars(postings(full.select("s", "text"), classes, words, percent, list_part)), "lists")
    let_go(spark)  # the postings' shuffle is the largest
    # the first sets of the parts of a salted list: a list of their own
    heads = first.where("salt > 0 and nth = 0").select("gram", F.lit(0).alias("salt"), "s", "n", "place")
    second = written(stars(heads), "lists")
    lists = first.unionByName(second)

    pairs = written(
        lists.where((F.col("nth") > 0) & may_link("first_n", "first_place", "n", "place", percent)).select(F.col("first").alias("a"), F.col("s").alias("b")).distinct(), "pairs"
    )
    ones = full.groupBy("s").agg(F.min("number").alias("number"))

    def texts_of(ends: DataFrame) -> DataFrame:
        ends = ends.select(F.col("a").alias("s")).unionByName(ends.select(F.col("b").alias("s"))).distinct()
        wanted = written(ones.join(ends, "s"), "wanted")
        few = F.broadcast(wanted) if wanted.count() <= WANTED else wanted
        out = written(full.select("number", "text").join(few, "number").select("s", "text"), "texts")
        forgotten(wanted)
        return out

    near = written(outlined(pairs, sets, percent), "pairs")
    texts = texts_of(near)
    let_go(spark)
    links = written(verified(near, texts, words, percent), "links")
    forgotten(texts, near)
    let_go(spark)
    found = components(links).withColumnRenamed("node", "s")
    across = written(outlined(across_components(lists, found, percent, block).join(pairs, ["a", "b"], "left_anti"), sets, percent), "pairs")
    forgotten(first, second, pairs)
    let_go(spark)
    if not across.isEmpty():
        texts = texts_of(across)
        let_go(spark)
        more = written(verified(across, texts, words, percent), "links")
        forgotten(texts)
        let_go(spark)
        if not more.isEmpty():
            found = components(links.unionByName(more)).withColumnRenamed("node", "s")
    return rows, found


def link_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, list_part: int = LIST_PART, block: int = BLOCK_SETS, mask: int = NAME_MASK
) -> DataFrame:
    """key, n_shingles and component_id (smallest key that links reach) of every row; ``key`` is a column that can be ordered."""
    rows, found = linked_rows(docs, key, text, words, percent, list_part, block, mask, [])
    named = rows.select("doc", "n", "s").join(found, "s", "left").select("doc", "n", F.coalesce("component", "s").alias("c"))
    smallest = named.where("n > 0").groupBy("c").agg(F.min("doc").alias("component_id"))
    return named.join(smallest, "c", "left").select(
        F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id")
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component: that of its smallest key, of several the one with the smallest text and other columns.

    Rows without n-grams, which link with nothing, all stay; so do different
    texts under one key, which are documents of their own.
    """
    rest = [c for c in docs.columns if c != text]
    rows, found = linked_rows(docs, key, text, words, percent, LIST_PART, BLOCK_SETS, NAME_MASK, rest)
    # texts stay out of the joins that find the rows to drop
    order = F.struct(F.col("doc").isNull().alias("none"), "doc", F.xxhash64("text").alias("t"), F.xxhash64(F.to_json("rest")).alias("r"), "number").alias("order")
    narrow = rows.where("n > 0").select("s", order).join(found, "s").select("component", "order")
    first = narrow.groupBy("component").agg(F.min("order").alias("first"))
    # sets without links have but their own copies
    alone = rows.where("n > 0").select("s", order).join(found, "s", "left_anti").groupBy("s").agg(F.min("order").alias("first"))
    every = first.select("first.number").unionByName(alone.select("first.number"))
    gone = written(rows.where("n > 0").select("number").join(every, "number", "left_anti"), "gone")
    let_go(docs.sparkSession)
    kept = rows.select("number", "text", "rest").join(gone, "number", "left_anti")
    kind = docs.schema[text].dataType
    return kept.select(*(F.col("text").cast(kind).alias(text) if c == text else F.col(f"rest.`{c}`").alias(c) for c in docs.columns))
