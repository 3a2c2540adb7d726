"""Pages and frames of files: one row for each, without decoding a pixel.

TIFF frames are found by walking the directories, PDF pages by their page
objects (plain files and those whose objects lie in deflated streams); other
pictures have one page.  Files that can't be read have none.
"""

from __future__ import annotations

import re
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PAGE = re.compile(rb"/Type\s*/Page(?![A-Za-z])")
_STREAM = re.compile(rb"/Type\s*/ObjStm.*?stream\r?\n", re.S)
#: Frames and directory entries that a file may name, so that a loop of directories ends.
MOST_FRAMES, MOST_ENTRIES = 100_000, 4096
#: Bytes that one deflated stream may unfold to.
MOST_BYTES = 64 << 20


def tiff_frames(data: bytes) -> list[tuple[int | None, int | None]]:
    """(width, height) of each frame, in the order of the directories."""
    if data[:4] not in (b"II*\0", b"MM\0*"):
        return []
    end = "<" if data[:2] == b"II" else ">"
    at, seen, out = struct.unpack_from(end + "I", data, 4)[0], set(), []
    while at and at not in seen and at + 2 <= len(data) and len(out) < MOST_FRAMES:
        seen.add(at)
        n = min(struct.unpack_from(end + "H", data, at)[0], MOST_ENTRIES)
        sides: dict[int, int] = {}
        for k in range(n):
            place = at + 2 + 12 * k
            if place + 12 > len(data):
                return out
            tag, kind = struct.unpack_from(end + "HH", data, place)
            if tag in (256, 257):
                sides[tag] = struct.unpack_from(end + ("H" if kind == 3 else "I"), data, place + 8)[0]
        out.append((sides.get(256), sides.get(257)))
        after = at + 2 + 12 * n
        at = struct.unpack_from(end + "I", data, after)[0] if after + 4 <= len(data) else 0
    return out


def pdf_pages(data: bytes) -> int:
    if not data.startswith(b"%PDF"):
        return 0
    n = len(_PAGE.findall(data))
    for m in _STREAM.finditer(data):
        try:
            n += len(_PAGE.findall(zlib.decompressobj().decompress(data[m.end() :], MOST_BYTES)))
        except zlib.error:
            continue
    return n


def jpeg_size(data: bytes) -> tuple[int | None, int | None]:
    """(width, height) by the frame header; nulls where there is none."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data) and data[at] == 0xFF:
        kind, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", data, at + 5)
            return width, height
        at += 2 + max(size, 2)
    return None, None


def expanded(data: bytes) -> list[tuple[int, str, int | None, int | None]]:
    """(page from 1, kind, width, height) of one file's pages."""
    if frames := tiff_frames(data):
        return [(i, "tiff", w, h) for i, (w, h) in enumerate(frames, 1)]
    if n := pdf_pages(data):
        return [(i, "pdf", None, None) for i in range(1, n + 1)]
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return [(1, "png", *struct.unpack_from(">II", data, 16))]
    if data[:2] == b"\xff\xd8":
        return [(1, "jpeg", *jpeg_size(data))]
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return [(1, "gif", *struct.unpack_from("<HH", data, 6))]
    if data[:2] == b"BM" and len(data) >= 26:
        width, height = struct.unpack_from("<ii", data, 18)
        return [(1, "bmp", width, abs(height))]
    return []


def pages(files: DataFrame, max_pages: int | None = None, page_numbers: list[int] | None = None) -> DataFrame:
    """(path, page, kind, width, height) from (path, content) rows; of each file the first ``max_pages`` of those in ``page_numbers``."""

    def run(batches):
        for batch in batches:
            rows = [(p, *page) for p, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True) for page in expanded(data or b"")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "page", "kind", "width", "height"])

    found = files.select("path", "content").mapInArrow(run, "path string, page int, kind string, width bigint, height bigint")
    if page_numbers is not None:
        found = found.where(F.col("page").isin(page_numbers))
        # of the asked pages the first ones: numbers are dense, so that a place among them is a count
        asked = sorted(set(page_numbers))[: max_pages or None]
        return found.where(F.col("page").isin(asked))
    return found.where(F.col("page") <= max_pages) if max_pages else found


def first_page(files: DataFrame) -> DataFrame:
    """The first page of each file; a file without pages is an error."""
    one = pages(files, 1)
    told = files.select("path").join(one, "path", "left")
    return told.withColumn("kind", F.when(F.col("page").isNull(), F.raise_error(F.concat(F.lit("no pages in "), "path"))).otherwise(F.col("kind")))
