"""Records inside binary files, as rows (path, ord, type, offset, size, payload), by mapInArrow.

Every parser is bounded by its input: a length that points outside ends the walk with a 'truncated' record, and no
record's declared size is trusted for memory. Malformed input never raises; it gives the records before the fault.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

Record = tuple[str, int, int, bytes]
SCHEMA = "path string, ord int, type string, offset long, size long, payload binary"
ZIP_BUDGET, IFD_CAP = 128 << 20, 4096
#: Records, and bytes of their payloads, that a worker gathers before it hands them on.
GATHERED, GATHERED_BYTES = 1000, 1 << 20


def png_chunks(data: bytes) -> Iterator[Record]:
    at = 8 if data[:8] == b"\x89PNG\r\n\x1a\n" else len(data)
    while at + 8 <= len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        kind = data[at + 4 : at + 8].decode("latin-1")
        if at + 12 + n > len(data):
            yield "truncated", at, len(data) - at, b""
            return
        yield kind, at, n + 12, data[at + 8 : at + 8 + n]
        at += n + 12
        if kind == "IEND":
            if at < len(data):
                yield "trailing", at, len(data) - at, data[at:]
            return
    if at < len(data):
        yield "truncated", at, len(data) - at, b""


def png_text(kind: str, payload: bytes) -> tuple[str, str] | None:
    """Key and value of a PNG text chunk; None for other chunks and broken ones."""
    try:
        key, rest = payload.split(b"\0", 1)
        if kind == "tEXt":
            return key.decode("latin-1"), rest.decode("latin-1")
        if kind == "zTXt":
            return key.decode("latin-1"), zlib.decompressobj().decompress(rest[1:], 1 << 20).decode("latin-1")
        if kind == "iTXt":
            packed, body = rest[0], rest[2:].split(b"\0", 2)[2]
            return key.decode("latin-1"), (zlib.decompressobj().decompress(body, 1 << 20) if packed else body).decode("utf-8", "replace")
    except (ValueError, IndexError, zlib.error):
        pass
    return None


def jpeg_segments(data: bytes) -> Iterator[Record]:
    at = 2 if data[:2] == b"\xff\xd8" else len(data)
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker in (0x01, *range(0xD0, 0xD8)):
            at += 2
            continue
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        if marker == 0xD9:
            return
        if n < 2 or at + 2 + n > len(data):
            yield "truncated", at, len(data) - at, b""
            return
        name = f"APP{marker - 0xE0}" if 0xE0 <= marker <= 0xEF else {0xFE: "COM", 0xDA: "SOS"}.get(marker, f"{marker:02X}")
        yield name, at, n + 2, data[at + 4 : at + 2 + n]
        if marker == 0xDA:
            return
        at += 2 + n
    if at < len(data):
        yield "truncated", at, len(data) - at, b""


def riff_chunks(data: bytes) -> Iterator[Record]:
    """Chunks of WebP and WAV files; 'mismatch' where the declared size isn't the file's."""
    if data[:4] != b"RIFF" or len(data) < 12:
        return
    end = min(len(data), int.from_bytes(data[4:8], "little") + 8)
    if int.from_bytes(data[4:8], "little") + 8 != len(data):
        yield "mismatch", 4, 4, b""
    at = 12
    while at + 8 <= end:
        n = int.from_bytes(data[at + 4 : at + 8], "little")
        if at + 8 + n > len(data):
            yield "truncated", at, len(data) - at, b""
            return
        yield data[at : at + 4].decode("latin-1"), at, n + 8, data[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)


def iso_boxes(data: bytes, at: int = 0, end: int | None = None, above: str = "", depth: int = 0) -> Iterator[Record]:
    """Boxes with their path, such as moov/udta; 64-bit sizes; containers are walked inside."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        n, head = int.from_bytes(data[at : at + 4], "big"), 8
        name = above + data[at + 4 : at + 8].decode("latin-1")
        if n == 1 and at + 16 <= end:
            n, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        elif n == 0:
            n = end - at
        if n < head or at + n > end:
            yield f"{above}truncated", at, end - at, b""
            return
        inner = data[at + 4 : at + 8] in (b"moov", b"udta", b"meta", b"trak", b"mdia", b"ilst") and depth < 8
        yield name, at, n, b"" if inner else data[at + head : at + n]
        if inner:
            yield from iso_boxes(data, at + head + 4 * (data[at + 4 : at + 8] == b"meta"), at + n, name + "/", depth + 1)
        at += n


def gif_blocks(data: bytes) -> Iterator[Record]:
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        return
    table = lambda flags: 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    at = 13 + table(data[10])

    def parts(at: int) -> tuple[bytes, int] | None:
        out = []
        while at < len(data):
            n = data[at]
            if not n:
                return b"".join(out), at + 1
            if at + 1 + n > len(data):
                return None
            out.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        return None

    while at < len(data):
        lead = data[at]
        if lead == 0x3B:
            if at + 1 < len(data):
                yield "trailing", at + 1, len(data) - at - 1, data[at + 1 :]
            return
        if lead == 0x21 and at + 2 <= len(data):
            name, body = {0xFE: "comment", 0xFF: "application", 0xF9: "control", 0x01: "text"}.get(data[at + 1] if at + 1 < len(data) else 0, "extension"), at + 2
        elif lead == 0x2C and at + 10 <= len(data):
            name, body = "image", at + 11 + table(data[at + 9])
        else:
            name, body = "", 0
        found = parts(body) if name else None
        if not found:
            yield "truncated", at, len(data) - at, b""
            return
        yield name, at, found[1] - at, b"" if name == "image" else found[0]
        at = found[1]


def tiff_tags(data: bytes) -> Iterator[Record]:
    """Tags of all directories of a TIFF or BigTIFF file, type 'ifd/tag'; a directory is visited once."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    version = struct.unpack(order + "H", data[2:4])[0] if order and len(data) >= 8 else 0
    if version not in (42, 43) or len(data) < (8 if version == 42 else 16):
        return
    big = version == 43
    word, count, entry = ("Q", "Q", 20) if big else ("I", "H", 12)
    read = lambda f, at: struct.unpack_from(order + f, data, at)[0] if at + struct.calcsize(f) <= len(data) else 0
    todo, seen = [read(word, 8 if big else 4)], set()
    width = {kind: int(n) for kind, n in enumerate("0112481124848400888")}  # bytes of an item by its type
    while todo and len(seen) < IFD_CAP:
        at = todo.pop(0)
        if not at or at in seen or at >= len(data):
            continue
        seen.add(at)
        n = read(count, at)
        body = at + struct.calcsize("=" + count)
        for i in range(min(n, (len(data) - body) // entry)):
            e = body + i * entry
            tag, kind, items = read("H", e), read("H", e + 2), read(word, e + 4)
            size, slot = width.get(kind, 1) * items, e + (12 if big else 8)
            where = slot if size <= (8 if big else 4) else read(word, slot)
            if where + size > len(data):
                yield "truncated", e, entry, b""
                continue
            if tag in (34665, 34853, 40965, 330) and items:
                todo += [read(word, where + j * (8 if big else 4)) for j in range(min(items, 64))]
            yield f"{at}/{tag}", where, size, data[where : where + size]
        todo.append(read(word, body + n * entry))


def bmp_extent(data: bytes) -> Iterator[Record]:
    """The header's extent, and what trails it."""
    if data[:2] != b"BM" or len(data) < 54:
        return
    size, pixels, width, height, bits, packed, image = struct.unpack_from("<I4xI4xii2xHII", data, 2)
    row = (abs(width) * bits + 31) // 32 * 4
    end = pixels + (image if packed else row * abs(height))
    yield "bitmap", 0, min(end, len(data)), b""
    if end > len(data):
        yield "truncated", 0, len(data), b""
    elif end < len(data):
        yield "trailing", end, len(data) - end, data[end:]


def id3_frames(data: bytes) -> Iterator[Record]:
    """Frames of an ID3v2.2, 2.3 or 2.4 tag at the start of the file."""
    if data[:3] != b"ID3" or len(data) < 10:
        return
    version, flags = data[3], data[5]
    safe = lambda b: sum((x & 127) << 7 * (len(b) - 1 - i) for i, x in enumerate(b))
    end, at = min(len(data), 10 + safe(data[6:10])), 10
    if flags & 0x40 and version >= 3:
        at += safe(data[10:14]) if version == 4 else 4 + int.from_bytes(data[10:14], "big")
    head = 6 if version == 2 else 10
    while at + head <= end and data[at]:
        name = data[at : at + (3 if version == 2 else 4)].decode("latin-1")
        raw = data[at + 3 : at + 6] if version == 2 else data[at + 4 : at + 8]
        n = safe(raw) if version == 4 else int.from_bytes(raw, "big")
        if at + head + n > end:
            yield "truncated", at, end - at, b""
            return
        yield name, at, head + n, data[at + head : at + head + n]
        at += head + n


def zip_members(data: bytes, budget: int = ZIP_BUDGET) -> Iterator[Record]:
    """Members in order of the directory, decompressed within one budget of real bytes for the archive."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if info.is_dir():
                    continue
                if info.flag_bits & 1:
                    yield f"encrypted:{info.filename}", info.header_offset, info.file_size, b""
                    continue
                with z.open(info) as f:
                    body = f.read(budget + 1)
                budget -= len(body)
                if budget < 0:
                    yield "over budget", info.header_offset, info.file_size, b""
                    return
                yield info.filename, info.header_offset, len(body), body
    except (zipfile.BadZipFile, zlib.error, EOFError, OSError, RuntimeError, NotImplementedError, ValueError):
        yield "broken", 0, len(data), b""


PARSERS: dict[str, Callable[[bytes], Iterator[Record]]] = {
    "png": png_chunks, "jpeg": jpeg_segments, "webp": riff_chunks, "wav": riff_chunks, "avif": iso_boxes, "heic": iso_boxes, "mp4": iso_boxes,
    "gif": gif_blocks, "tiff": tiff_tags, "bmp": bmp_extent, "mp3": id3_frames, "zip": zip_members,
}


def gathering(parse: Callable[[bytes], Iterator[Record]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (path, content) to batches of records: of many small files together, of a large one a part at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("path", pa.string()), ("ord", pa.int32()), ("type", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("payload", pa.binary())])
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)
        for batch in batches:
            rows, held = [], 0
            for path, content in zip(*(c.cast(t) for c, t in zip(batch.columns, (pa.string(), pa.binary())))):
                if not content.is_valid:
                    continue
                name = path.as_py()
                for i, r in enumerate(parse(content.as_py())):
                    rows.append((name, i, *r))
                    held += len(r[3])
                    if len(rows) >= GATHERED or held >= GATHERED_BYTES:
                        yield pack(rows)
                        rows, held = [], 0
            if rows:
                yield pack(rows)

    return run


def records(df: DataFrame, parser: str, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """The records of every file of df under one of PARSERS. Null contents have none."""
    return df.select(df[path_col].cast("string").alias("path"), df[content_col].alias("content")).mapInArrow(gathering(PARSERS[parser]), SCHEMA)
