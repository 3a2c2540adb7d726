"""Packing by lexical retrieval.

Documents are encoded once.  Full windows of a document are sequences of their
own; the rests are seeds from the longest down.  BM25 gives each seed its unused
neighbours, which greedily fill its window; the last one is cut where the window
ends and its rest stays for later windows.  What is left at the end of a shard is
cut into sequences whose lengths are powers of two, so that nothing is padded.

The index lies in shards of bounded rows and bytes, and a seed asks its own
shard.  Document frequencies, their number and the mean length are those of the
whole table.  Shards are lexical: rows are sorted by the nearest of a few
centroids, then by weighted minimum hashes of their terms (two documents agree in
one as often as their weighted Jaccard similarity says), and the sorted rows are
cut into shards; so copies and documents of one topic lie together, and a group
of any size is cut, never gathered.  What this loses against one index over all
documents is measured (README); :func:`routes` and :class:`Index` are what it is measured with.

Defined results: a null or empty text is a document of the one end token.
Repeated rows are documents of their own.  Ties go by the sorted order (routes,
then a hash of key and terms, then the place in the encoded table).  Empty tables give no
pieces.  The centroids are fitted on about ``sample`` documents, chosen by hash.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wireloom.llm.shared import small_batches
from wireloom.llm.token_counts import PIECE, byte_letters
from wireloom.tables import written

WINDOW, END_ID = 1024, 0
K1, B = 1.2, 0.75
#: Documents and bytes of a shard; shards that a task gets, about, and tasks at most.
SHARD_DOCS, SHARD_BYTES, TASK_SHARDS, TASKS = 2048, 16 << 20, 2, 1 << 15
#: Documents that centroids are fitted on, about; centroids, the cells that terms are hashed to, rounds.
SAMPLE, CENTROIDS, CELLS, ROUNDS = 4096, 32, 2048, 8
#: Minimum hashes of a route; rows that a border between tasks is set by.
HASHES, BORDER_ROWS = 3, 64
#: Cells of a shard's table for each posting, at most.
DENSE = 8


class TextEncoder:
    """Ids as the library gives them, its special tokens in texts included.

    Where a file's ids go by its merges, texts without a special token take a
    faster encoder that is built from the same file; the others the library.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.fast = _same_ids(path)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if self.fast is None or any(t in text for t in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def _same_ids(path: str) -> tiktoken.Encoding | None:
    """A faster encoder of the same vocabulary and merges, where the file's ids go by its merges; else none."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    pre = told.get("pre_tokenizer") or {}
    if told["model"]["type"] != "BPE" or told.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex"):
        return None
    letters = byte_letters()
    ids = {bytes(letters[c] for c in t): i for t, i in told["model"]["vocab"].items() if all(c in letters for c in t)}
    merges = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
    made = [ids.get(bytes(letters[c] for c in a + b), -1) for a, b in merges]
    if len(ids) != 256 + len(merges) or made != sorted(set(made)) or max(ids[bytes([b])] for b in range(256)) >= made[0]:
        return None
    return tiktoken.Encoding("same", pat_str=PIECE.pattern, mergeable_ranks=ids, special_tokens={})


@cache
def encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


def _summary(ids: bytes, window: int) -> dict:
    """Of one document: its length, the digests of its full windows, the ids that are left, its terms and their counts."""
    tokens = np.frombuffer(ids + END_ID.to_bytes(4, "little"), "<u4")
    full = len(tokens) // window
    step = 4 * window
    ordered = np.sort(tokens.astype("<u2") if tokens.max() < 65536 else tokens)
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return {
        "tokens": len(tokens),
        "full": np.array([zlib.crc32(ids[k * step : (k + 1) * step] if (k + 1) * step <= len(ids) else tokens[k * window : (k + 1) * window].tobytes()) for k in range(full)], "<u4").tobytes(),
        "rest": tokens[full * window :].astype("<u4").tobytes() if tokens.max() >= 65536 else tokens[full * window :].astype("<u2").tobytes(),
        "wide": bool(tokens.max() >= 65536),
        "terms": ordered[first].astype("<u4").tobytes() if tokens.max() >= 65536 else ordered[first].astype("<u2").tobytes(),
        "counts": _narrow(np.diff(np.append(first, len(ordered)))).tobytes(),
    }


def _narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in as many bytes each as the largest needs: 1 or 4."""
    return counts.astype("<u4" if counts.max(initial=0) > 255 else np.uint8)


def terms_of(terms: bytes, counts: bytes, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """A document's term ids and their counts, from the stored bytes."""
    term = np.frombuffer(terms, "<u4" if wide else "<u2")
    return term, np.frombuffer(counts, np.uint8 if len(counts) == len(term) else "<u4")


SUMMARY = pa.struct(
    [("tokens", pa.int64()), ("full", pa.binary()), ("rest", pa.binary()), ("wide", pa.bool_()), ("terms", pa.binary()), ("counts", pa.binary())]
)


def idf_of(df: np.ndarray, n: int) -> np.ndarray:
    """Zero for terms of one document and for those in half of all or more."""
    return np.where(df > 1, np.maximum(0, np.log((n - df + 0.5) / (df + 0.5))), 0)


@dataclass(frozen=True)
class Statistics:
    """Of the whole table: weight of each term id, and the mean length."""

    idf: np.ndarray
    mean: float

    def weights(self, term: np.ndarray, tf: np.ndarray, length: np.ndarray | float) -> np.ndarray:
        """In units of 1/256: whole numbers, so that their sums (below 2^24) are exact in any order."""
        return np.rint(256 * self.whole(term, tf, length))

    def whole(self, term: np.ndarray, tf: np.ndarray, length: np.ndarray | float) -> np.ndarray:
        return self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.mean))


def statistics(terms: list[np.ndarray], lengths: np.ndarray) -> Statistics:
    """The same for documents in memory."""
    every = np.concatenate([*terms, np.zeros(1, np.uint32)]).astype(np.int64)
    return Statistics(idf_of(np.bincount(every[:-1], minlength=int(every.max()) + 1), len(terms)), float(lengths.mean()))


class Index:
    """BM25 over documents in memory; terms in half of them or more, or in one, weigh nothing."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], lengths: np.ndarray, known: Statistics | None = None):
        known = known or statistics(terms, lengths)
        self.n = len(terms)
        term = np.concatenate(terms).astype(np.uint32)
        doc = np.repeat(np.arange(self.n), [len(t) for t in terms])
        tf = np.concatenate(counts).astype(np.float64)
        kept = known.idf[term] > 0
        term, doc, tf = term[kept], doc[kept], tf[kept]
        order = np.argsort(term, kind="stable")
        term, self.doc, tf = term[order], doc[order], tf[order]
        self.terms, first, df = np.unique(term, return_index=True, return_counts=True)
        weight = known.weights(term, tf, lengths[self.doc])
        # terms that many documents have go by a table, at most DENSE cells for a posting; the others by their postings
        often = df * DENSE >= self.n
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        self.table = np.zeros((int(often.sum()), self.n), np.float32)
        row = np.repeat(self.row, df)
        self.table[row[row >= 0], self.doc[row >= 0]] = weight[row >= 0]
        self.doc, self.weight = self.doc[row < 0], weight[row < 0]
        self.size = np.where(often, 0, df)
        self.first = np.cumsum(self.size) - self.size
        self.open = np.arange(self.n)
        own = [t[known.idf[t] > 0].astype(np.uint32) for t in terms]
        self.own = [np.searchsorted(self.terms, t) for t in own]

    def forget(self, gone: np.ndarray) -> None:
        """Takes documents out, so that later queries don't go through what is used up."""
        term = np.repeat(np.arange(len(self.first)), self.size)
        kept = ~gone[self.doc]
        self.doc, self.weight = self.doc[kept], self.weight[kept]
        self.size = np.bincount(term[kept], minlength=len(self.first))
        self.first = np.cumsum(self.size) - self.size
        there = ~gone[self.open]
        self.table, self.open = self.table[:, there], self.open[there]

    def scores(self, seed: int) -> np.ndarray:
        """Scores of all documents for the terms of one."""
        at = self.own[seed]
        size = self.size[at]
        rare, size = at[size > 0], size[size > 0]
        ends = np.cumsum(size)
        entry = np.repeat(self.first[rare] - (ends - size), size) + np.arange(int(size.sum()))
        out = np.bincount(self.doc[entry], self.weight[entry], self.n).astype(np.float64, copy=False)
        row = self.row[at]
        out[self.open] += self.table[row[row >= 0]].sum(0)
        return out


def fill_windows(lengths: np.ndarray, neighbours, window: int = WINDOW, forget=None) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start in it, length) that hold each item once; ``neighbours(i)`` scores all items for one.

    ``forget`` is told of used-up items each time that a third of the rest has
    gone.  Seeds go from the longest item down.  All sequences but the last ones are
    full; what is left is cut into lengths that are powers of two.
    """
    n = len(lengths)
    start, left = np.zeros(n, np.int64), lengths.astype(np.int64).copy()
    order = np.lexsort((np.arange(n), -left))
    sequences = []
    held = n
    for seed in order.tolist():
        if forget and left[seed] and held > 64 and (now := np.count_nonzero(left)) * 3 < held * 2:
            forget(left == 0)
            held = now
        while left[seed]:
            seq, space = [], window

            def take(i: int) -> None:
                nonlocal space
                size = min(space, int(left[i]))
                seq.append((i, int(start[i]), size))
                start[i] += size
                left[i] -= size
                space -= size

            take(seed)
            if space:
                score = np.where(left > 0, neighbours(seed), -1.0)
                open_items = np.flatnonzero(score >= 0)
                # the best ones, as many as may be needed, and only if these don't do, all
                for count in (32, len(open_items)):
                    best = open_items
                    if count < len(best):
                        best = best[np.argpartition(-score[best], count)[:count]]
                    for i in best[np.lexsort((best, -score[best]))].tolist():
                        if not space:
                            break
                        if left[i]:
                            take(i)
                    if not space:
                        break
            if space:
                sequences.extend(_powers(seq))
            else:
                sequences.append(seq)
    return sequences


def _powers(seq: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    out, todo, total = [], list(seq), sum(x[2] for x in seq)
    while total:
        space = 1 << (total.bit_length() - 1)
        total -= space
        own = []
        while space:
            i, at, size = todo.pop(0)
            cut = min(space, size)
            own.append((i, at, cut))
            space -= cut
            if cut < size:
                todo.insert(0, (i, at + cut, size - cut))
        out.append(own)
    return out


@dataclass(frozen=True)
class Router:
    """Where a document lies in the order that shards are cut from: its centroid and its minimum hashes."""

    known: Statistics
    centroids: np.ndarray

    def __post_init__(self):
        ids = np.arange(len(self.known.idf), dtype=np.uint64)
        object.__setattr__(self, "cells", (_mixed(ids) % np.uint64(CELLS)).astype(np.int64))
        races = [-np.log((_mixed(ids * np.uint64(HASHES) + np.uint64(k + 1)) >> np.uint64(11)) / 2.0**53 + 2.0**-54) for k in range(HASHES)]
        object.__setattr__(self, "races", np.stack(races))

    def vector(self, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        out = np.bincount(self.cells[term], weight, CELLS)
        return out / max(np.linalg.norm(out), 1e-12)

    def route(self, term: np.ndarray, tf: np.ndarray, length: int) -> list[int]:
        kept = self.known.idf[term] > 0
        term = term[kept]
        if not len(term):
            return [-1] * (HASHES + 1)
        weight = self.known.whole(term, tf[kept], length)
        near = self.centroids[:, self.cells[term]] @ weight
        return [int(near.argmax()), *term[(self.races[:, term] / weight).argmin(1)].tolist()]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def fitted(known: Statistics, docs: list[tuple[np.ndarray, np.ndarray, int]], centroids: int = CENTROIDS) -> Router:
    """Spherical k-means over the hashed terms of (terms, counts, length) documents; the same documents give the same centroids."""
    blank = Router(known, np.zeros((1, CELLS), np.float32))
    points = np.array([blank.vector(t, known.whole(t, c, n)) for t, c, n in docs], np.float32).reshape(-1, CELLS)
    points = points[np.abs(points).sum(1) > 0]
    if not len(points):
        return blank
    chosen = [0]
    while len(chosen) < min(centroids, len(points)):  # the point that is farthest from those chosen
        chosen.append(int((points @ points[chosen].T).max(1).argmin()))
    center = points[chosen]
    for _ in range(ROUNDS):
        own = (points @ center.T).argmax(1)
        sums = np.stack([points[own == k].sum(0) if (own == k).any() else center[k] for k in range(len(center))])
        center = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    # like ones next to each other, as shards may go on from one to the next
    like, chain = center @ center.T, [0]
    while len(chain) < len(center):
        rest = [k for k in range(len(center)) if k not in chain]
        chain.append(max(rest, key=lambda k: like[chain[-1], k]))
    return Router(known, center[chain].astype(np.float32))


def pack_shard(docs: list[tuple], sequence: int, known: Statistics, window: int = WINDOW) -> tuple[list[tuple], int]:
    """Pieces of one shard from (key, tokens, full, rest, wide, terms, counts) rows, and the next free sequence number."""
    pieces = []
    items, rests, terms, counts = [], [], [], []
    for key, tokens, full, rest, wide, term, count in docs:
        for k, crc in enumerate(np.frombuffer(full, "<u4").tolist()):
            pieces.append((key, k * window, window, crc, tokens, sequence, 0))
            sequence += 1
        if rest:
            items.append((key, tokens))
            rests.append(np.frombuffer(rest, "<u4" if wide else "<u2").astype("<u4"))
            t, c = terms_of(term, count, wide)
            terms.append(t)
            counts.append(c)
    if not items:
        return pieces, sequence
    index = Index(terms, counts, np.array([n for _, n in items], np.float64), known)
    for seq in fill_windows(np.array([len(r) for r in rests]), index.scores, window, index.forget):
        offset = 0
        for j, at, size in seq:
            key, tokens = items[j]
            pieces.append((key, tokens - len(rests[j]) + at, size, zlib.crc32(rests[j][at : at + size].tobytes()), tokens, sequence, offset))
            offset += size
        sequence += 1
    return pieces, sequence


def encoded(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """key, and of each whole text: length, digests of full windows, the ids that are left, terms and counts."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("tokens bigint, full binary, rest binary, wide boolean, terms binary, counts binary")
    def summary(column: pa.Array) -> pa.Array:
        own = encoder(tokenizer)
        return pa.array([_summary(own.encode(x or ""), window) for x in column.to_pylist()], SUMMARY)

    return docs.select(F.col(f"`{key}`").alias("key"), summary(F.col(f"`{text}`").cast("string")).alias("s")).select("key", "s.*")


def table_statistics(rows: DataFrame) -> Statistics:
    """Of all encoded rows; what comes to the driver is bounded by the vocabulary."""

    def frequencies(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for t, w in zip(batch.column("terms").to_pylist(), batch.column("wide").to_pylist(), strict=True):
                term = np.frombuffer(t, "<u4" if w else "<u2")
                if len(term) and int(term[-1]) >= len(total):
                    total = np.concatenate([total, np.zeros(int(term[-1]) + 1, np.int64)])
                total[term] += 1  # a document's terms are distinct
        at = np.flatnonzero(total)
        yield pa.record_batch({"term": pa.array(at, pa.int64()), "df": pa.array(total[at], pa.int64())})

    found = rows.select("terms", "wide").mapInArrow(frequencies, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    n, mean = rows.agg(F.count("*"), F.avg("tokens")).first()
    df = np.zeros(int(found["term"].to_numpy().max(initial=0)) + 1, np.int64)
    df[found["term"].to_numpy()] = found["df"].to_numpy()
    return Statistics(idf_of(df, n), float(mean or 1))


def _named(rows: DataFrame) -> DataFrame:
    """``rows`` with ``h``, a hash of the row, ``m``, which tells equal rows apart, and ``chance``, a number below 2^20 by both."""
    named = rows.withColumns({"h": F.xxhash64("key", "tokens", "terms", "counts"), "m": F.monotonically_increasing_id()})
    return named.withColumn("chance", F.pmod(F.xxhash64("h", "m"), F.lit(1 << 20)))


def table_router(rows: DataFrame, known: Statistics, n: int, sample: int = SAMPLE) -> Router:
    """Fitted on about ``sample`` of the ``n`` documents, chosen by hash; never on more than twice as many."""
    some = _named(rows).where(F.col("chance") < F.lit(int(min(1.0, sample / max(n, 1)) * (1 << 20)) + 1))
    found = some.select("h", "terms", "counts", "wide", "tokens").limit(2 * sample).collect()
    return fitted(known, [(*terms_of(r.terms, r.counts, r.wide), r.tokens) for r in sorted(found, key=lambda r: (r.h, r.tokens))])


def routes(rows: DataFrame, router: Router, borders: list[tuple] | None = None) -> DataFrame:
    """Rows of :func:`_named` with ``route`` (centroid and minimum hashes) and ``part`` (how many borders lie at or before their place)."""
    borders = borders or []
    shared = rows.sparkSession.sparkContext.broadcast((router.known.idf, router.known.mean, router.centroids, borders))
    held: list = []

    @F.arrow_udf("route array<int>, part int")
    def route(terms: pa.Array, counts: pa.Array, wide: pa.Array, tokens: pa.Array, h: pa.Array, m: pa.Array) -> pa.Array:
        if not held:
            idf, mean, centroids, known = shared.value
            held.extend([Router(Statistics(idf, mean), centroids), known])
        columns = zip(terms.to_pylist(), counts.to_pylist(), wide.to_pylist(), tokens.to_pylist(), strict=True)
        found = [held[0].route(*terms_of(t, c, w), n) for t, c, w, n in columns]
        parts = [bisect_right(held[1], (*r, x, y)) for r, x, y in zip(found, h.to_pylist(), m.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array(found, pa.list_(pa.int32())), pa.array(parts, pa.int32())], ["route", "part"])

    return rows.withColumn("_r", route("terms", "counts", "wide", "tokens", "h", "m")).select("*", "_r.route", "_r.part").drop("_r")


def task_borders(rows: DataFrame, router: Router, tasks: int, n: int) -> list[tuple]:
    """Where the sorted rows are cut into tasks, by some :data:`BORDER_ROWS` rows a task, chosen by hash."""
    if tasks < 2:
        return []
    some = _named(rows).where(F.col("chance") < F.lit(int(min(1.0, BORDER_ROWS * tasks / n) * (1 << 20)) + 1))
    places = sorted((*r.route, r.h, r.m) for r in routes(some, router).select("route", "h", "m").collect())
    return [places[len(places) * k // tasks] for k in range(1, tasks)] if len(places) >= tasks else places


def pack(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, shard_docs: int = SHARD_DOCS, shard_bytes: int = SHARD_BYTES, sample: int = SAMPLE
) -> DataFrame:
    """Pieces: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = written(encoded(docs, tokenizer, key, text, window), "encoded")
    known = table_statistics(rows)
    shared = rows.sparkSession.sparkContext.broadcast((known.idf, known.mean))
    n = rows.count()
    router = table_router(rows, known, n, sample)
    tasks = min(TASKS, max(1, -(-n // (TASK_SHARDS * shard_docs))))
    borders = task_borders(rows, router, tasks, n)
    placed = routes(_named(rows), router, borders).repartitionById(len(borders) + 1, "part").sortWithinPartitions("route", "h", "m")
    kind = rows.schema["key"].dataType.simpleString()
    fields = ["key", "tokens", "full", "rest", "wide", "terms", "counts"]

    def run(batches):
        sequence, own = TaskContext.get().partitionId() << 40, Statistics(*shared.value)
        shard, size, key_type = [], 0, None

        def told():
            nonlocal sequence
            pieces, sequence = pack_shard(shard, sequence, own, window)
            for at in range(0, len(pieces), 50_000):
                columns = zip(*pieces[at : at + 50_000], strict=True)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, [key_type, *[pa.int64()] * 6], strict=True)], names=OUT)

        for batch in batches:
            key_type = batch.schema.field("key").type
            for row in zip(*(batch.column(c).to_pylist() for c in fields), strict=True):
                shard.append(row)
                size += len(row[2]) + len(row[3]) + len(row[5]) + len(row[6])
                if len(shard) >= shard_docs or size >= shard_bytes:
                    yield from told()
                    shard, size = [], 0
        if shard:
            yield from told()

    out = placed.select(*fields).mapInArrow(run, f"key {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("key", key)


OUT = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
