"""Exact token counts at every prefix of a text, by dynamic programming.

A text falls into units (white space with what follows it) whose tokens don't
depend on what comes after them.  Within a unit, the last token of each prefix
is found from the last tokens of shorter prefixes: of the tokens that end
there, the one that may follow the last token of what is left (both, encoded
together, come out as these two).  The count is that of the shorter prefix
plus one.  A text's table holds the step of the count at each character, so
that any truncation or budget question is a running sum, not a new encoding.

Defined results: a null or empty text has no tokens and an empty table.
Strings of special tokens in a text count as the library counts them by
default: one token each.
"""

from __future__ import annotations

import json
import struct
from functools import cache
from operator import sub

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.llm.byte_bpe import Cache
from wireloom.llm.shared import or_empty, small_batches

#: How the byte-level pre-tokeniser splits.
PIECE = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: White space with what follows it; an apostrophe after a plain space begins no ending.
UNIT = regex.compile(r"""\s*+\p{L}++|\s*+\p{N}++|(?:\s*[^\S ])?(?:'s|'t|'re|'ve|'m|'ll|'d)|\s*+[^\s\p{L}\p{N}]++|\s++""")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Prefix tables by the merges of a byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        letters = byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.vocabulary = {as_bytes(t) for t in told["model"]["vocab"]}
        merges = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
        self.ranks = {(as_bytes(a), as_bytes(b)): i for i, (a, b) in enumerate(merges)}
        #: Of each token the rank of the merge that makes it (-1: none) and its two parts.
        self.made = {t: (-1, t, t) for t in self.vocabulary if len(t) == 1}
        for (x, y), rank in self.ranks.items():
            self.made.setdefault(x + y, (rank, x, y))
        # a token that encodes to others never comes up
        self.vocabulary = {t for t, (rank, x, y) in self.made.items() if rank < 0 or self._stay(x, y, rank)}
        self.longest = max(map(len, self.vocabulary))
        special = [t["content"] for t in told.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.follows: dict[tuple[bytes, bytes], bool] = {}
        self.steps = Cache(self._steps)
        self.alone = Cache(lambda piece: self._prefixes(piece)[-1])

    def _stay(self, a: bytes, b: bytes, limit: int) -> bool:
        """Whether no merge below ``limit`` joins the ends of two tokens where they meet.

        The merges inside the two are undone from the last one back; what
        stands at the border then must not have merged before that one.  Of
        equal ranks the leftmost merge goes first.
        """
        ranks, made = self.ranks, self.made
        while True:
            if ranks.get((a, b), limit) < limit:
                return False
            (rank_a, _, end), (rank_b, head, _) = made[a], made[b]
            if rank_a > rank_b:
                limit, a = rank_a, end
            elif rank_b >= 0:
                limit, b = rank_b + 1, head
            else:
                return True

    def _may_follow(self, a: bytes, b: bytes) -> bool:
        if not a:
            return True
        found = self.follows.get((a, b))
        if found is None:
            if len(self.follows) > 1_000_000:
                self.follows.clear()
            found = self.follows[a, b] = self._stay(a, b, len(self.ranks))
        return found

    def _prefixes(self, piece: bytes) -> list[int]:
        """Token counts of the first 0, 1, 2, ... bytes of one piece."""
        vocabulary, follow, known = self.vocabulary, self._may_follow, self.follows
        last, counts = [b""], [0]
        for end in range(1, len(piece) + 1):
            for start in range(max(0, end - self.longest), end):
                token = piece[start:end]
                if token in vocabulary:
                    fits = known.get((last[start], token))
                    if fits is None:
                        fits = follow(last[start], token)
                    if fits:
                        last.append(token)
                        counts.append(counts[start] + 1)
                        break
            else:
                raise ValueError(f"no token ends piece {piece[:end]!r}")
        return counts

    def _of(self, text: str) -> int:
        return sum(self.alone[p.encode()] for p in PIECE.findall(text))

    def _counts(self, unit: str) -> list[int]:
        """Token counts of the first 1, 2, ... characters of a unit."""
        body = unit.lstrip()
        white = len(unit) - len(body)
        if unit.isascii() and unit[:1] == " " and white == 1 and body:
            return self._prefixes(unit.encode())[1:]
        out = self._prefixes(unit[:white].encode())[1:] if white else []
        if white:  # by characters: white space may take several bytes
            ends = np.cumsum([len(c.encode()) for c in unit[:white]]) - 1
            out = [out[e] for e in ends]
        if not body:
            return out
        if body[0] == "'":  # an ending that isn't whole yet splits in another way
            return out + [self._of(unit[: white + k]) for k in range(1, len(body) + 1)]
        joined = white and unit[white - 1] == " "
        # the last white space character stands alone, or belongs to what follows
        before = sum(self.alone[w.encode()] for w in (unit[: max(0, white - 1)], "" if joined else unit[max(0, white - 1) : white]) if w)
        piece = (" " if joined else "") + body
        data = piece.encode()
        counts = self._prefixes(data)
        ends = range(1 + bool(joined), len(data) + 1) if len(data) == len(piece) else np.cumsum([len(c.encode()) for c in piece])[bool(joined) :]
        return out + [before + counts[e] for e in ends]

    def _steps(self, unit: str) -> bytes:
        counts = self._counts(unit)
        return struct.pack(f"<{len(counts)}h", counts[0], *map(sub, counts[1:], counts))

    def table(self, text: str) -> bytes:
        """The step of the token count at each character, as little-endian 16-bit integers."""
        if self.special is None or not self.special.search(text):
            steps = self.steps
            return b"".join([steps[u] for u in UNIT.findall(text)])
        out, at = [], 0
        for m in self.special.finditer(text):
            out.append(self.table_of_plain(text[at : m.start()]))
            units = UNIT.findall(text[at : m.start()])
            tail = units[-1] if units else ""
            full = self._of(tail)
            counts = [self._of(tail + m[0][:k]) - full for k in range(1, len(m[0]))] + [1]
            out.append(np.diff(counts, prepend=0).astype("<i2").tobytes())
            at = m.end()
        out.append(self.table_of_plain(text[at:]))
        return b"".join(out)

    def table_of_plain(self, text: str) -> bytes:
        return b"".join([self.steps[u] for u in UNIT.findall(text)])


def counts_at(table: bytes) -> np.ndarray:
    """Token counts of the first 0, 1, 2, ... characters."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(table, "<i2"), dtype=np.int64)])


def cut_for(table: bytes, budget: int) -> int:
    """Characters of the longest prefix that has ``budget`` tokens at most."""
    return int(np.flatnonzero(counts_at(table) <= budget)[-1])


@cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_tables(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes and ``token_steps``, the prefix table of each row's whole text.

    ``tokenizer`` is the path of a ``tokenizers`` file that every executor can open.
    """
    small_batches(docs.sparkSession)

    @F.arrow_udf("binary")
    def table_of(column: pa.Array) -> pa.Array:
        own = counter(tokenizer)
        return pa.array([own.table(x or "") for x in column.to_pylist()], pa.binary())

    whole = docs.select(F.col(key), or_empty(text).alias("_text"))
    return whole.select(key, F.octet_length("_text").cast("long").alias("n_bytes"), table_of("_text").alias("token_steps"))


def budget_facts(table: Column, budget: int) -> Column:
    """Struct from a prefix table: all tokens, and the characters that fit into ``budget`` tokens."""
    kind = pa.struct([("n_tokens", pa.int64()), ("fitting_chars", pa.int64())])

    @F.arrow_udf("n_tokens bigint, fitting_chars bigint")
    def facts(column: pa.Array) -> pa.Array:
        out = []
        for x in column.to_pylist():
            counts = counts_at(x)
            n = int(counts[-1])
            fits = len(counts) - 1 if n <= budget else int(np.flatnonzero(counts <= budget)[-1])
            out.append({"n_tokens": n, "fitting_chars": fits})
        return pa.array(out, kind)

    return facts(table)
