"""Media columns: ISO base media containers.

``probe`` walks the nested boxes of a container, decodes the sample tables (also
compact sizes and movie fragments) and returns codec, duration, dimensions and
the byte ranges of the key frames; it never decodes a sample.  Of several tracks
the first video track that has samples is told of, else the first that has
samples, else the first.  ``store`` writes a payload losslessly as a track of
uncompressed 8-bit grey frames of 8 x 8 pixels, so that a frame is 64 bytes.

Tables are never unrolled beyond what the file can hold: counts that a corrupt
or hostile table only claims cost nothing.

Defined results: ``probe`` gives null for null; bytes that aren't a container,
or one whose tables are cut short, give a row with what could be read, 0
samples and no key frames.  Samples that don't lie inside the file are counted in
``n_missing`` and have no ranges; such a payload can't be read back and is null.
A null or empty text is stored as one zero frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.llm.shared import or_empty, small_batches

FRAME, SIDE, TIMESCALE, KEY_EVERY = 64, 8, 25, 16
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
INFO = pa.struct(
    [
        ("codec", pa.string()),
        ("width", pa.int32()),
        ("height", pa.int32()),
        ("duration_s", pa.float64()),
        ("n_samples", pa.int64()),
        ("n_missing", pa.int64()),
        ("handler", pa.string()),
        ("n_tracks", pa.int32()),
        ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
    ]
)


def _box(kind: bytes, *body: bytes) -> bytes:
    size = 8 + sum(map(len, body))
    if size < 1 << 32:
        return struct.pack(">I4s", size, kind) + b"".join(body)
    return struct.pack(">I4sQ", 1, kind, size + 8) + b"".join(body)


def _full(kind: bytes, *body: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *body)


def pad(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of a frame."""
    return data + bytes(max(FRAME, -(-len(data) // FRAME) * FRAME) - len(data))


def store(data: bytes) -> bytes:
    """A container with one video track whose frames are the padded ``data``, 64 bytes each."""
    payload = pad(data)
    n = len(payload) // FRAME
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2", b"mp41")

    def moov(offset: int) -> bytes:
        entry = _box(
            b"raw ",
            bytes(6) + struct.pack(">H", 1) + bytes(16) + struct.pack(">HHIIIH", SIDE, SIDE, 72 << 16, 72 << 16, 0, 1),
            bytes(32) + struct.pack(">Hh", 40, -1),
        )
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, 1)),
            _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            _full(b"stsc", struct.pack(">IIII", 1, 1, n, 1)),
            _full(b"stsz", struct.pack(">II", FRAME, n)),
            _full(b"co64", struct.pack(">IQ", 1, offset)),
        )
        minf = _box(
            b"minf",
            _full(b"vmhd", bytes(8), flags=1),
            _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))),
            stbl,
        )
        mdia = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, n, 0x55C4, 0)),
            _full(b"hdlr", bytes(4), b"vide", bytes(12), b"\0"),
            minf,
        )
        tkhd = _full(
            b"tkhd",
            struct.pack(">IIIII", 0, 0, 1, 0, n) + bytes(16) + MATRIX + struct.pack(">II", SIDE << 16, SIDE << 16),
            flags=7,
        )
        mvhd = _full(
            b"mvhd",
            struct.pack(">IIIIIH", 0, 0, TIMESCALE, n, 0x10000, 0x100) + bytes(10) + MATRIX + bytes(24) + struct.pack(">I", 2),
        )
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    body = _box(b"mdat", payload)
    first = len(head) + len(moov(0)) + len(body) - len(payload)
    return head + moov(first) + body


def boxes(data: memoryview, start: int, end: int):
    """(kind, body start, body end) of the boxes between two offsets; stops at a size that can't be."""
    while start + 8 <= end:
        size, kind, body = *struct.unpack_from(">I4s", data, start), start + 8
        if size == 1:
            if start + 16 > end:
                return
            size, body = struct.unpack_from(">Q", data, start + 8)[0], start + 16
        stop = end if size == 0 else start + size
        if stop < body or stop > end:
            return
        yield bytes(kind), body, stop
        start = stop


def _walk(data: memoryview) -> tuple[list[dict], list[dict], dict[int, tuple[int, int]]]:
    """Tracks (places of the boxes under each), track fragments in order (with the ``moof``'s start and their runs), and the defaults by track."""
    tracks: list[dict] = []
    fragments: list[dict] = []
    defaults: dict[int, tuple[int, int]] = {}
    todo = deque([(0, len(data), 0, None)])
    while todo:
        start, end, moof, owner = todo.popleft()
        for kind, body, stop in boxes(data, start, end):
            own, at = owner, moof
            if kind == b"trak":
                own = {}
                tracks.append(own)
            elif kind == b"moof":
                at = start if start < body else 0
            elif kind == b"traf":
                own = {"moof": moof, "runs": []}
                fragments.append(own)
            if kind in NESTED:
                todo.append((body, stop, at, own))
            elif kind == b"trex" and stop - body >= 24:
                defaults[struct.unpack_from(">I", data, body + 4)[0]] = (body, stop)
            elif kind == b"trun" and own is not None and "runs" in own:
                own["runs"].append((body, stop))
            elif own is not None:
                own.setdefault(kind, (body, stop))
            start = stop
    return tracks, fragments, defaults


def _table(data: memoryview, at: tuple[int, int] | None, columns: int, kind: str = ">u4", skip: int = 8) -> np.ndarray:
    """The entries of a table box, as many as are there."""
    if at is None or at[1] - at[0] < skip:
        return np.zeros((0, columns), np.int64)
    said = struct.unpack_from(">I", data, at[0] + skip - 4)[0]
    n = min(said, (at[1] - at[0] - skip) // (np.dtype(kind).itemsize * columns))
    return np.frombuffer(data, kind, n * columns, at[0] + skip).astype(np.int64).reshape(n, columns)


def _sizes(data: memoryview, track: dict) -> tuple[int, np.ndarray | int]:
    """Number of samples and their sizes (one number where all are the same), as far as the table is there."""
    if (at := track.get(b"stsz")) and at[1] - at[0] >= 12:
        same, n = struct.unpack_from(">II", data, at[0] + 4)
        if same:
            return n, same
        sizes = _table(data, at, 1, skip=12)[:, 0]
        return len(sizes), sizes
    if (at := track.get(b"stz2")) and at[1] - at[0] >= 12:
        bits, n = data[at[0] + 7], struct.unpack_from(">I", data, at[0] + 8)[0]
        if bits == 4:
            raw = np.frombuffer(data[at[0] + 12 : at[1]], np.uint8)
            sizes = np.stack([raw >> 4, raw & 15], 1).ravel()[:n].astype(np.int64)
        elif bits in (8, 16):
            sizes = _table(data, at, 1, f">u{bits // 8}", skip=12)[:, 0]
        else:
            sizes = np.zeros(0, np.int64)
        return len(sizes), sizes
    return 0, np.zeros(0, np.int64)


def sample_places(data: memoryview, track: dict) -> tuple[np.ndarray, np.ndarray]:
    """Byte offset and size of each sample, from the sample-to-chunk, size and chunk-offset tables."""
    none = np.zeros(0, np.int64)
    n, sizes = _sizes(data, track)
    chunks = _table(data, track.get(b"co64"), 1, ">u8") if b"co64" in track else _table(data, track.get(b"stco"), 1)
    runs = _table(data, track.get(b"stsc"), 3)
    if not n or not len(chunks) or not len(runs):
        return none, none
    n = min(n, len(data))  # a sample of one byte at least
    first = np.maximum.accumulate(np.append(runs[:, 0] - 1, len(chunks)).clip(0, len(chunks)))
    each = np.zeros(len(chunks), np.int64)  # chunks before the first run hold nothing
    each[first[0] :] = np.repeat(np.minimum(runs[:, 1], n), np.diff(first))
    ends = np.cumsum(each)
    n = min(n, int(ends[-1]))
    sizes = np.full(n, sizes, np.int64) if isinstance(sizes, int) else sizes[:n]
    chunk = np.searchsorted(ends, np.arange(n), "right")  # a chunk holds the samples up to its end
    before = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    starts = np.concatenate([[0], ends])[chunk]
    return chunks[chunk, 0] + before - before[starts], sizes


def fragment_samples(data: memoryview, fragment: dict, defaults: dict, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Offsets, sizes, durations and key marks of one track fragment's samples; ``at``: where data go on without a base of its own."""
    none = np.zeros(0, np.int64)
    head = fragment.get(b"tfhd")
    if not head or head[1] - head[0] < 8:
        return none, none, none, none.astype(bool), at
    flags, track = struct.unpack_from(">II", data, head[0])
    flags &= 0xFFFFFF
    known = [1, 0, 0, 0]  # description, duration, size, flags
    if found := defaults.get(track):
        known = list(struct.unpack_from(">4I", data, found[0] + 8))
    place, base = head[0] + 8, fragment["moof"] if flags & 0x20000 or at < 0 else at
    for bit, width, slot in ((1, 8, None), (2, 4, 0), (8, 4, 1), (16, 4, 2), (32, 4, 3)):
        if flags & bit and place + width <= head[1]:
            value = struct.unpack_from(">Q" if width == 8 else ">I", data, place)[0]
            place += width
            if slot is None:
                base = min(value, 1 << 62)
            else:
                known[slot] = value
    out, go_on = [], base
    for start, stop in fragment["runs"]:
        if stop - start < 8:
            continue
        marks, n = struct.unpack_from(">II", data, start)
        marks &= 0xFFFFFF
        place, first_flags = start + 8, None
        if marks & 1 and place + 4 <= stop:
            go_on = base + struct.unpack_from(">i", data, place)[0]
            place += 4
        if marks & 4 and place + 4 <= stop:
            first_flags = struct.unpack_from(">I", data, place)[0]
            place += 4
        columns = [b for b in (0x100, 0x200, 0x400, 0x800) if marks & b]
        n = min(n, (stop - place) // (4 * len(columns)) if columns else len(data) // max(known[2], 1))
        table = np.frombuffer(data, ">u4", n * len(columns), place).astype(np.int64).reshape(n, len(columns)) if n and columns else np.zeros((n, 0), np.int64)
        take = lambda bit, slot: table[:, columns.index(bit)] if bit in columns else np.full(n, known[slot], np.int64)  # noqa: B023, E731
        sizes, marked = take(0x200, 2), take(0x400, 3).copy()
        if first_flags is not None and n:
            marked[0] = first_flags
        out.append((go_on + np.concatenate([[0], np.cumsum(sizes)])[:-1], sizes, take(0x100, 1), marked & 0x10000 == 0))
        go_on += int(sizes.sum())
    if not out:
        return none, none, none, none.astype(bool), go_on
    return *(np.concatenate(x) for x in zip(*out, strict=True)), go_on


def _number(data: memoryview, track: dict) -> int | None:
    if not (at := track.get(b"tkhd")) or at[1] - at[0] < 24:
        return None
    return struct.unpack_from(">I", data, at[0] + (20 if data[at[0]] == 1 else 12))[0]


def read_tracks(data: bytes) -> list[dict]:
    """Of each track: what :func:`probe` tells, and offsets and sizes of its samples."""
    view = memoryview(data)
    tracks, fragments, defaults = _walk(view)
    out = []
    for track in tracks:
        info = {"codec": None, "width": None, "height": None, "duration_s": None, "handler": None}
        if (at := track.get(b"hdlr")) and at[1] - at[0] >= 12:
            info["handler"] = bytes(view[at[0] + 8 : at[0] + 12]).decode("latin-1")
        if (at := track.get(b"stsd")) and at[1] - at[0] >= 16:
            info["codec"] = bytes(view[at[0] + 12 : at[0] + 16]).decode("latin-1")
            if at[1] - at[0] >= 44 and info["handler"] in (None, "vide"):
                info["width"], info["height"] = struct.unpack_from(">HH", view, at[0] + 40)
        offsets, sizes = sample_places(view, track)
        keys = np.zeros(len(sizes), bool)
        if b"stss" in track:
            marked = _table(view, track[b"stss"], 1)[:, 0] - 1
            keys[marked[(marked >= 0) & (marked < len(sizes))]] = True
        else:
            keys[:] = True
        ticks = _table(view, track.get(b"stts"), 2)
        lasting = float((ticks[:, 0].astype(float) * ticks[:, 1]).sum())
        number, go_on = _number(view, track), {}
        for f in fragments:
            head = f.get(b"tfhd")
            if number is None or not head or head[1] - head[0] < 8 or struct.unpack_from(">I", view, head[0] + 4)[0] != number:
                continue
            o, s, d, k, go_on[f["moof"]] = fragment_samples(view, f, defaults, go_on.get(f["moof"], -1))
            offsets, sizes, keys, lasting = np.concatenate([offsets, o]), np.concatenate([sizes, s]), np.concatenate([keys, k]), lasting + float(d.sum())
        if (at := track.get(b"mdhd")) and at[1] - at[0] >= 24:
            scale = struct.unpack_from(">I", view, at[0] + (20 if view[at[0]] == 1 else 12))[0]
            info["duration_s"] = lasting / scale if scale else None
        there = (offsets >= 0) & (offsets <= len(data) - sizes)
        out.append(info | {"offsets": offsets, "sizes": sizes, "keys": keys, "there": there})
    return out


def _chosen(tracks: list[dict]) -> dict | None:
    order = lambda t: (not len(t["sizes"]), t["handler"] != "vide")
    return min(tracks, key=order) if tracks else None


def probe(data: bytes) -> dict:
    """Codec, size, duration and key-frame byte ranges of the chosen track."""
    tracks = read_tracks(data)
    nothing = {"codec": None, "width": None, "height": None, "duration_s": None, "handler": None, "n_samples": 0, "n_missing": 0, "keyframes": []}
    if (best := _chosen(tracks)) is None:
        return nothing | {"n_tracks": 0}
    at = np.flatnonzero(best["keys"] & best["there"])
    ranges = zip(best["offsets"][at].tolist(), best["sizes"][at].tolist(), strict=True)
    return {k: best[k] for k in ("codec", "width", "height", "duration_s", "handler")} | {
        "n_samples": int(best["there"].sum()),
        "n_missing": int((~best["there"]).sum()),
        "n_tracks": len(tracks),
        "keyframes": [{"start": a, "length": b} for a, b in ranges],
    }


def read_payload(data: bytes) -> bytes | None:
    """The bytes of all samples of the chosen track, in order, or null if some aren't in the file; runs that lie together are copied at once."""
    best = _chosen(read_tracks(data))
    if best is None or not len(best["sizes"]):
        return b""
    if not best["there"].all():
        return None
    view, offsets, sizes = memoryview(data), best["offsets"], best["sizes"]
    cut = np.flatnonzero(np.concatenate([[True], offsets[1:] != offsets[:-1] + sizes[:-1]]))
    ends = np.append(cut[1:], len(sizes)) - 1
    return b"".join(view[a : b + c] for a, b, c in zip(offsets[cut].tolist(), offsets[ends].tolist(), sizes[ends].tolist(), strict=True))


def media_columns(frame: DataFrame, media: str = "media") -> DataFrame:
    """``frame`` with a struct ``media_info`` of :data:`INFO` for its binary column ``media``."""
    small_batches(frame.sparkSession)

    @F.arrow_udf("codec string, width int, height int, duration_s double, n_samples bigint, n_missing bigint, handler string, n_tracks int, keyframes array<struct<start:bigint,length:bigint>>")
    def info(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else probe(x) for x in column.to_pylist()], INFO)

    return frame.withColumn("media_info", info(F.col(media)))


def text_to_media(text: Column) -> Column:
    """Binary column: the stored form of each text; a null text is empty."""

    @F.arrow_udf("binary")
    def stored(column: pa.Array) -> pa.Array:
        return pa.array([store(x or b"") for x in column.cast(pa.large_binary()).to_pylist()], pa.binary())

    return stored(text)


def payload_facts(media: Column) -> Column:
    """Struct of the bytes that are read back: length, digest and the CRC of the last frame."""
    kind = pa.struct([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64())])

    @F.arrow_udf("payload_bytes bigint, payload_sha256 string, tail_crc32 bigint")
    def facts(column: pa.Array) -> pa.Array:
        out = []
        for x in column.to_pylist():
            p = None if x is None else read_payload(x)
            out.append(None if p is None else {"payload_bytes": len(p), "payload_sha256": hashlib.sha256(p).hexdigest(), "tail_crc32": zlib.crc32(p[-FRAME:])})
        return pa.array(out, kind)

    return facts(media)


def text_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes and the container ``media`` of each row's whole text."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col(key), or_empty(text).alias("_text"))
    return own.select(key, F.octet_length("_text").cast("long").alias("n_bytes"), text_to_media(F.col("_text")).alias("media"))
