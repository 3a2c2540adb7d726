"""Byte-level BPE by the ranks of a tokenizer file: encoding and decoding.

Pre-tokenisation uses no regular expression.  Each code point is mapped to a
symbol (its class, with a look ahead of at most two code points); every symbol
is a function from the automaton's states to its states.  Functions compose
associatively, so the state before each code point comes from a blocked scan
over all texts of a batch at once, and (state, symbol) says where pieces begin.
Pieces are merged pair by pair, with a cache; token lengths give the byte
offsets that decoding needs.

Defined results: a null or empty text has no tokens.  Texts of any length are
taken whole: a batch is bounded in bytes, a longer text is a batch of its own.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.llm.shared import or_empty, small_batches

#: Symbols: classes of code points, and what white space or an apostrophe leads to.
LETTER, NUMBER, OTHER, SPACE_BEFORE, WHITE, WHITE_LAST, SHORT, LONG = range(8)
#: States: what has just been read.
CUT, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_WHITE, ONE_LEFT, TWO_LEFT = range(8)
#: The code points of Unicode's White_Space property.
WHITE_SPACE = [0x20, *range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What after an apostrophe is a piece of its own with it.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]
BLOCK, CHUNK_BYTES, CACHE_ENTRIES, CACHED_BYTES = 64, 2 << 20, 300_000, 128


@cache
def class_table() -> np.ndarray:
    """Symbol of each code point as far as it alone says it."""
    first = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    table = np.full(0x110000, OTHER, np.uint8)
    table[np.array([x == "L" for x in first])] = LETTER
    table[np.array([x == "N" for x in first])] = NUMBER
    table[WHITE_SPACE] = WHITE
    return table


@cache
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a piece begins) by symbol and state; symbols from 8 on begin a text."""
    to = np.zeros((16, 8), np.uint8)
    begins = np.ones((16, 8), bool)
    for symbol, state in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
        to[symbol] = state
        begins[symbol, [state, AFTER_SPACE]] = False
    to[LETTER, [ONE_LEFT, TWO_LEFT]] = CUT, ONE_LEFT
    begins[LETTER, [ONE_LEFT, TWO_LEFT]] = False
    for symbol, state in ((SHORT, ONE_LEFT), (LONG, TWO_LEFT)):
        to[symbol] = state
        to[symbol, [IN_OTHERS, AFTER_SPACE]] = IN_OTHERS
        begins[symbol, [IN_OTHERS, AFTER_SPACE]] = False
    to[SPACE_BEFORE] = AFTER_SPACE
    to[WHITE_LAST] = CUT
    to[WHITE] = IN_WHITE
    begins[WHITE, IN_WHITE] = False
    to[8:] = to[:8, [CUT]]
    return to, begins


def symbols_of(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The symbol of each code point of texts that lie end to end and begin at ``starts``."""
    n = len(points)
    out = class_table()[points]
    white = out == WHITE
    last = np.zeros(n, bool)  # of its text
    last[starts[starts > 0] - 1] = True
    last[n - 1] = True
    before_black = np.zeros(n, bool)
    before_black[:-1] = white[:-1] & ~white[1:]
    before_black &= ~last
    out[before_black] = WHITE_LAST
    out[before_black & (points == 0x20)] = SPACE_BEFORE
    at = np.flatnonzero((points == 0x27) & ~last)
    if len(at):
        one = points[at + 1]
        two = np.where(last[at + 1], 0, points[np.minimum(at + 2, n - 1)])
        for ending in ENDINGS:
            if len(ending) == 1:
                out[at[one == ord(ending)]] = SHORT
            else:
                out[at[(one == ord(ending[0])) & (two == ord(ending[1]))]] = LONG
    out[starts] += 8
    return out


def states_before(symbols: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The automaton's state before each symbol.

    Blocks of symbols are composed to functions side by side; a doubling scan
    over the blocks' functions gives each block's first state; a last pass
    goes through the blocks from there.
    """
    n = len(symbols)
    m = -(-n // BLOCK)
    lanes = np.zeros(m * BLOCK, np.uint8)
    lanes[:n] = symbols
    lanes = np.ascontiguousarray(lanes.reshape(m, BLOCK).T)
    flat = to.ravel()
    base = lanes.astype(np.int16) * 8
    functions = np.tile(np.arange(8, dtype=np.uint8), (m, 1))
    for row in base:
        functions = flat[row[:, None] + functions]
    reach = 1
    while reach < m:  # functions[i]: from the first symbol of block i - 2 * reach + 1 to the end of block i
        both = np.take_along_axis(functions[reach:], functions[:-reach].astype(np.intp), 1)
        functions = np.concatenate([functions[:reach], both])
        reach *= 2
    state = np.zeros(m, np.uint8)
    state[1:] = functions[:-1, CUT]
    out = np.empty((BLOCK, m), np.uint8)
    for k, row in enumerate(base):
        out[k] = state
        state = flat[row + state]
    return out.T.ravel()[:n]


def piece_starts(data: bytes, starts: np.ndarray) -> np.ndarray:
    """Byte offsets at which the pieces of UTF-8 texts begin that lie end to end in ``data``; empty texts left out."""
    raw = np.frombuffer(data, np.uint8)
    heads = np.flatnonzero((raw & 0xC0) != 0x80)
    points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), "<u4")
    symbols = symbols_of(points, np.searchsorted(heads, starts))
    to, begins = automaton()
    state = states_before(symbols, to)
    return heads[begins.ravel()[symbols.astype(np.int16) * 8 + state]]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece: the pair of the lowest rank is merged first, of equals the leftmost."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    after = list(range(1, n + 1))  # of a part's start, the start of the next
    before = list(range(-1, n))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = bytearray(b"\1" * (n + 1))
    while heap:
        _, i, end = heapq.heappop(heap)
        middle = after[i]
        if not alive[i] or middle >= n or after[middle] != end:
            continue  # one of the two has changed meanwhile
        alive[middle] = 0
        after[i] = end
        before[end] = i
        if end < n and (r := ranks.get(piece[i : after[end]])) is not None:
            heapq.heappush(heap, (r, i, after[end]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:end])) is not None:
            heapq.heappush(heap, (r, p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Cache(dict):
    """Values of pieces; when it is full, what hasn't been asked for since it was last full is forgotten."""

    def __init__(self, make, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, piece):
        value = self.old.pop(piece, None)
        if value is None:
            value = self.make(piece)
        if len(piece) <= CACHED_BYTES:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[piece] = value
        return value


class Encoder:
    """Encodes batches of texts; kept once for each tokenizer file in a Python worker."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.ids = Cache(lambda piece: np.array(merged(piece, self.ranks), "<u4").tobytes())
        size = max(self.ranks.values()) + 1
        self.lengths = np.zeros(size, np.int64)
        for token, rank in self.ranks.items():
            self.lengths[rank] = len(token)
        self.places = np.concatenate([[0], np.cumsum(self.lengths)])
        flat = bytearray(int(self.places[-1]))
        for token, rank in self.ranks.items():
            flat[self.places[rank] : self.places[rank] + len(token)] = token
        self.bytes = np.frombuffer(bytes(flat), np.uint8)

    def encode_batch(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each UTF-8 text, as little-endian unsigned 32-bit integers."""
        out = [b""] * len(texts)
        for group in grouped(texts):
            full = [i for i in group if texts[i]]
            if not full:
                continue
            data = b"".join([texts[i] for i in full])
            ends = np.cumsum([len(texts[i]) for i in full])
            starts = np.concatenate([[0], ends[:-1]])
            cuts = piece_starts(data, starts)
            firsts = np.searchsorted(cuts, starts).tolist() + [len(cuts)]
            cuts = cuts.tolist() + [len(data)]
            ids = self.ids
            for k, i in enumerate(full):
                a, b = firsts[k], firsts[k + 1]
                out[i] = b"".join([ids[data[x:y]] for x, y in zip(cuts[a:b], cuts[a + 1 : b + 1], strict=True)])
        return out

    def offsets(self, ids: bytes) -> np.ndarray:
        """Byte offset of each token in its text, and the text's length."""
        return np.concatenate([[0], np.cumsum(self.lengths[np.frombuffer(ids, "<u4")])])

    def decode(self, ids: bytes) -> bytes:
        tokens = np.frombuffer(ids, "<u4")
        at = self.offsets(ids)
        shift = np.repeat(self.places[tokens] - at[:-1], self.lengths[tokens])
        return self.bytes[shift + np.arange(at[-1])].tobytes()


def grouped(texts: list[bytes], most: int | None = None):
    """Indices of texts of about ``most`` bytes together, :data:`CHUNK_BYTES` unless given."""
    most = most or CHUNK_BYTES
    group, size = [], 0
    for i, text in enumerate(texts):
        if group and size + len(text) > most:
            yield group
            group, size = [], 0
        group.append(i)
        size += len(text)
    if group:
        yield group


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens and ``ids`` (little-endian unsigned 32-bit) of each row's whole text.

    ``tokenizer`` is the path of a rank file that every executor can open.
    """
    small_batches(docs.sparkSession)

    @F.arrow_udf("binary")
    def ids_of(column: pa.Array) -> pa.Array:
        texts = [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
        return pa.array(encoder(tokenizer).encode_batch(texts), pa.binary())

    coded = docs.select(F.col(key), ids_of(or_empty(text)).alias("ids"))
    return coded.select(key, F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def decode(coded: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """``coded`` with ``decoded``: the bytes that its ids stand for."""

    @F.arrow_udf("binary")
    def bytes_of(column: pa.Array) -> pa.Array:
        own = encoder(tokenizer)
        return pa.array([None if x is None else own.decode(x) for x in column.to_pylist()], pa.binary())

    return coded.withColumn("decoded", bytes_of(F.col(ids)))


