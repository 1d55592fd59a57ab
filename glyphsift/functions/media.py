"""Provenance metadata in images, audio, video, office packages and PDF: inspection, and removal without touching content."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable
from html import escape, unescape

import pandas as pd
from pyspark.sql import functions as F

from ..sources import binary
from . import layer_a

C2PA = (b"c2pa", b"c2ma", b"jumb", b"cai:", b"contentauth", b"contentcredentials")
HINTS = (b"aigc", b"ai generated", b"algorithmicmedia", b"anthropic", b"c2pa", b"claude", b"contentcredentials", b"dcterms:provenance", b"digitalsourcetype", b"generated by", b"openai", b"synthid")
PRODUCTS = re.compile(
    rb"\b(?:adobe firefly|bing image creator|chatgpt|clipdrop|craiyon|dall-e|deepai|dreamstudio|firefly|flux|gemini|gpt-[45]|grok|ideogram|imagen|kling|leonardo[. ]ai|luma|midjourney|nightcafe|novelai|qwen|recraft|runway|sdxl|sora|stable diffusion|tensorart|veo)\b",
    re.I,
)
GENERATOR_KEYS = ("creator", "parameters", "software")
REPORT = "format string, has_c2pa boolean, has_ai_metadata boolean, findings array<string>"
CLEANED = "content binary, actions array<string>"
Found = tuple[bool, bool, list[str]]


def hits(blob: bytes, markers: tuple[bytes, ...] = HINTS) -> list[str]:
    low = blob.lower()
    return [m.decode() for m in markers if m in low]


def sniff(data: bytes) -> str:
    brand = data[8:12]
    if data[4:8] == b"ftyp":
        head = data[8 : max(16, min(int.from_bytes(data[:4], "big"), 64))]
        return "avif" if re.search(b"avi[fso]", head) else "heic" if re.search(b"hei[cxmsf]|hev[cx]|m(?:if|sf)1", head) else "mp4"
    for name, magics in {"png": [b"\x89PNG\r\n\x1a\n"], "jpeg": [b"\xff\xd8"], "gif": [b"GIF87a", b"GIF89a"], "tiff": [b"II*\0", b"MM\0*", b"II+\0", b"MM\0+"], "bmp": [b"BM"], "mp3": [b"ID3"], "pdf": [b"%PDF"], "zip": [b"PK\x03\x04"]}.items():
        if any(data.startswith(m) for m in magics):
            return name
    if data[:4] == b"RIFF" and brand in (b"WEBP", b"WAVE"):
        return "webp" if brand == b"WEBP" else "wav"
    return "mp3" if data[:1] == b"\xff" and len(data) > 1 and data[1] & 0xE0 == 0xE0 else "unknown"


def _named(kind: str, label: str, payload: bytes) -> list[str]:
    return [f"{label}: {kind} marker: {h}" for h in hits(payload)[:8]]


def _png(data: bytes) -> Found:
    c2pa, out = False, []
    for kind, _, _, body in binary.png_chunks(data):
        if kind.lower() in ("cabx", "c2pa", "jumb", "jumd"):
            c2pa = True
            out.append(f"PNG chunk {kind}")
        elif text := binary.png_text(kind, body):
            key, value = text
            raw = f"{key} {value}".encode("utf-8", "replace")
            named = [PRODUCTS.search(raw)[0].decode("latin-1")] if key.lower() in GENERATOR_KEYS and PRODUCTS.search(raw) else []
            if found := hits(raw) + named:
                out.append(f"PNG {kind}: {key}: " + ", ".join(found[:8]))
        elif kind == "eXIf":
            out += _named("exif", "PNG eXIf", body)
        elif kind == "truncated":
            out.append("truncated chunk")
    return c2pa, any(x.startswith("PNG") for x in out), out


def _jpeg(data: bytes) -> Found:
    c2pa, out = False, []
    for kind, _, _, body in binary.jpeg_segments(data):
        if kind == "APP11":
            c2pa = True
            out.append("JPEG APP11 segment (JUMBF)")
        elif kind.startswith("APP") or kind == "COM":
            out += _named("xmp" if b"ns.adobe.com/xap" in body[:64] else "exif" if body[:4] == b"Exif" else "text", f"JPEG {kind}", body)
        elif kind == "truncated":
            out.append("bad segment length")
    return c2pa, any("JPEG" in x for x in out), out


def _chunks(walk: Callable, label: str, quiet: tuple[str, ...]) -> Callable[[bytes], Found]:
    """An inspector of chunk formats: every chunk but the content is searched."""

    def run(data: bytes) -> Found:
        c2pa, out = False, []
        for kind, _, _, body in walk(data):
            name = kind.rsplit("/", 1)[-1]
            if name.strip().lower() in ("c2pa", "jumb") or (name == "uuid" and hits(body[:64], C2PA)):
                c2pa = True
                out.append(f"C2PA-related manifest in {label} {name}")
            elif name in ("truncated", "mismatch"):
                out.append(f"{label} {name}: not fully inspected")
            elif name not in quiet:
                out += _named("xmp" if b"xmp" in body[:200].lower() else "meta", f"{label} {kind.strip()}", body)
        return c2pa, any("marker" in x or "manifest" in x for x in out), out

    return run


XML_PARTS = re.compile(r"^(?:docProps/|customXml/|meta\.xml$|META-INF/|.*\.(?:opf|rels)$)")


def _zip(data: bytes) -> Found:
    c2pa, ai, out, custom = False, False, [], 0
    for name, _, _, body in binary.zip_members(data):
        if name in ("broken", "over budget"):
            out.append(f"not fully inspected: {name}")
        elif name.startswith("encrypted:"):
            out.append(f"not fully inspected: {name}")
        elif name.startswith("customXml/"):
            custom += 1
        if XML_PARTS.match(name) and (found := hits(body)):
            ai = True
            out.append(f"meta: {name}: " + ", ".join(found[:8]))
            c2pa |= bool(hits(body, C2PA[:1]))
        elif re.search(r"(?:^|/)media/|^Pictures/|\.(?:png|jpe?g|webp|gif)$", name):
            own = inspect(body)
            c2pa, ai = c2pa | own[1], ai | own[2]
            out += [f"{name}: {x}" for x in own[3]]
    return c2pa, ai, out + ([f"customXml parts: {custom}"] if custom else [])


def _pdf(data: bytes) -> Found:
    outside = re.sub(rb"(?s)\bstream\r?\n.*?\bendstream\b", b"", data)
    packets = re.findall(rb"(?s)<x:xmpmeta\b.*?</x:xmpmeta>", data)
    out = [f"pdf-structured:ai:{h}" for h in hits(outside)] + [f"pdf-structured:ai:{h}" for p in packets for h in hits(p)]
    out = list(dict.fromkeys(out)) + (["xmp packet present"] if packets else [])
    return bool(hits(outside + b"".join(packets), C2PA[:1])), any(":ai:" in x for x in out), out


INSPECTORS: dict[str, Callable[[bytes], Found]] = {
    "png": _png, "jpeg": _jpeg, "zip": _zip, "pdf": _pdf, "webp": _chunks(binary.riff_chunks, "WebP", ("VP8 ", "VP8L", "ALPH", "ANMF")), "wav": _chunks(binary.riff_chunks, "WAV", ("data",)),
    "gif": _chunks(binary.gif_blocks, "GIF", ("image",)), "tiff": _chunks(binary.tiff_tags, "TIFF", ()), "bmp": _chunks(binary.bmp_extent, "BMP", ()), "mp3": _chunks(binary.id3_frames, "ID3", ("APIC",)),
} | dict.fromkeys(("avif", "heic", "mp4"), _chunks(binary.iso_boxes, "ISO", ("mdat", "free")))


def inspect(data: bytes) -> tuple[str, bool, bool, list[str]]:
    """(format, has_c2pa, has_ai_metadata, findings); a bare byte match anywhere is the weakest finding."""
    kind = sniff(data)
    if kind not in INSPECTORS:
        return kind, False, False, [f"unsupported format: {kind}"]
    c2pa, ai, out = INSPECTORS[kind](data)
    if not c2pa and kind not in ("zip", "pdf") and (loose := hits(data, C2PA)):
        out = [*out, "byte-scan C2PA markers: " + ", ".join(loose)]
    return kind, c2pa, ai or c2pa, out[:30]


def _drop(kind: str, body: bytes, metadata: bool, keep_plain: bool) -> bool:
    return metadata and (not keep_plain or bool(hits(body)) or bool(PRODUCTS.search(body)))


def _clean_png(data: bytes, keep: bool) -> tuple[bytes, list[str]]:
    out, actions = [data[:8]], []
    for kind, at, size, body in binary.png_chunks(data):
        text = binary.png_text(kind, body)
        raw = " ".join(text).encode("utf-8", "replace") if text else body
        if kind.lower() in ("cabx", "c2pa", "jumb", "jumd", "trailing") or _drop(kind, raw, kind in ("tEXt", "zTXt", "iTXt", "eXIf", "tIME"), keep):
            actions.append(f"drop PNG {kind}")
        else:
            out.append(data[at : at + size])
    return b"".join(out), actions


def _clean_jpeg(data: bytes, keep: bool) -> tuple[bytes, list[str]]:
    out, actions, last = [], [], 0
    for kind, at, size, body in binary.jpeg_segments(data):
        if kind == "APP11" or _drop(kind, body, kind in ("APP1", "APP13", "COM"), keep):
            actions.append(f"drop JPEG {kind}")
            out.append(data[last:at])
            last = at + size
    return b"".join([*out, data[last:]]), actions


def _clean_riff(data: bytes, keep: bool) -> tuple[bytes, list[str]]:
    body, actions, dropped = [data[8:12]], [], set()
    for kind, at, size, payload in binary.riff_chunks(data):
        if kind == "mismatch":
            continue
        if kind == "truncated":
            return data, []  # nothing is cut from a file that can't be read whole
        if kind.lower() in ("c2pa", "jumb") or _drop(kind, payload, kind in ("EXIF", "XMP ", "LIST", "id3 ", "ID3 ", "iXML", "bext"), keep):
            actions.append(f"drop {kind.strip()}")
            dropped.add(kind)
        else:
            body.append(data[at : at + size] + b"\0" * (size & 1))
    flags = 8 * ("EXIF" in dropped) | 4 * ("XMP " in dropped)
    body = [b[:8] + bytes([b[8] & ~flags]) + b[9:] if b[:4] == b"VP8X" and len(b) > 8 else b for b in body]
    whole = b"".join(body)
    return (b"RIFF" + struct.pack("<I", len(whole)) + whole, actions) if actions else (data, [])


def _clean_iso(data: bytes, keep: bool) -> tuple[bytes, list[str]]:
    """Boxes become free space of the same size: offsets into the file stay true."""
    out, actions = bytearray(data), []
    for kind, at, size, body in binary.iso_boxes(data):
        name = kind.rsplit("/", 1)[-1]
        manifest = name in ("c2pa", "jumb") or (name == "uuid" and bool(hits(body[:64], C2PA)))
        if manifest or _drop(kind, data[at : at + size], kind == "moov/udta" or name in ("uuid", "XMP_"), keep):
            head = 16 if int.from_bytes(data[at : at + 4], "big") == 1 else 8
            out[at + 4 : at + 8] = b"free"
            out[at + head : at + size] = bytes(size - head)
            actions.append(f"free {kind}")
    return bytes(out), actions


def _clean_gif(data: bytes, keep: bool) -> tuple[bytes, list[str]]:
    out, actions, last = [], [], 0
    for kind, at, size, body in binary.gif_blocks(data):
        xmp = kind == "application" and not body.startswith((b"NETSCAPE", b"ANIMEXTS"))
        if kind == "trailing" or _drop(kind, body, kind == "comment" or xmp, keep):
            actions.append(f"drop GIF {kind}")
            out.append(data[last:at])
            last = at + size
    return b"".join([*out, data[last:]]), actions


def _clean_tiff(data: bytes, keep: bool) -> tuple[bytes, list[str]]:
    """Values of software, artist, host, XMP, IPTC and manifest tags become zeros in place, unless a kept value overlaps them."""
    rows = [(int(k.split("/")[1]), at, size, body) for k, at, size, body in binary.tiff_tags(data) if "/" in k]
    gone = [r for r in rows if r[0] == 52545 or _drop("", r[3], r[0] in (270, 305, 315, 316, 700, 33723), keep)]
    kept = [(at, at + size) for tag, at, size, body in rows if (tag, at, size, body) not in gone]
    out, actions = bytearray(data), []
    for tag, at, size, _ in gone:
        if not any(lo < at + size and at < hi for lo, hi in kept):
            out[at : at + size] = bytes(size)
            actions.append(f"blank TIFF tag {tag}")
    return bytes(out), actions


def _clean_id3(data: bytes, keep: bool) -> tuple[bytes, list[str]]:
    if data[:3] != b"ID3" or len(data) < 10:
        return data, []
    out, actions = bytearray(data), []
    for kind, at, size, body in binary.id3_frames(data):
        if _drop(kind, body, kind in ("TSSE", "TENC", "TXXX", "COMM", "PRIV", "GEOB", "TSS", "TEN", "TXX", "COM"), keep):
            head = 6 if data[3] == 2 else 10
            out[at + head : at + size] = bytes(size - head)
            actions.append(f"blank ID3 {kind}")
    return bytes(out), actions


#: Parts whose text runs are cleaned of invisible carriers: documents, sheets, slides, shared strings, chapters.
TEXT_PART = re.compile(r"^(?:word/(?:document|header\d*|footer\d*|footnotes|endnotes|comments)|xl/sharedStrings|xl/worksheets/[^/]+|ppt/(?:slides|notesSlides)/[^/]+|content)\.xml$|\.(?:xhtml|html?)$", re.I)
_RUN = re.compile(r">([^<]+)<")
_REFERENCE = re.compile(r"&#(?:[xX][0-9a-fA-F]{1,6}|\d{1,7});")


def clean_run(raw: str) -> str:
    """A text run without invisible carriers, those written as character references too; else as it was."""
    text = decode_entities(raw) if "&#" in raw else raw
    if not any(True for _ in layer_a.scan(text, spaces=False)):
        return raw
    new = layer_a.clean(text, spaces=False)[0]
    return encode_entities(new) if text is not raw else new


def _clean_runs(body: bytes, name: str) -> bytes:
    try:
        xml = body.decode("utf-8")
    except UnicodeDecodeError:
        return body
    if xml.isascii() and not _REFERENCE.search(xml):
        return body
    skip = r"(?is)<(?:script|style)\b.*?</(?:script|style)\s*>"
    kept = [m.span() for m in re.finditer(skip, xml)] if name.lower().endswith(("html", "htm")) else []
    inside = lambda at: any(lo <= at < hi for lo, hi in kept)
    return _RUN.sub(lambda m: m[0] if inside(m.start()) else f">{clean_run(m[1])}<", xml).encode()


FIELDS = "creator lastModifiedBy title subject description keywords category Application AppVersion Company Manager"


def _clean_zip(data: bytes, keep: bool) -> tuple[bytes, list[str]]:
    """Office packages: custom XML goes with the relationships and types that name it; document properties are blanked."""
    try:
        src = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, ValueError):
        return data, []
    out, actions, budget = io.BytesIO(), [], binary.ZIP_BUDGET
    try:
        with src, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as dst:
            gone = {i.filename for i in src.infolist() if i.filename.startswith("customXml/") or i.filename == "docProps/custom.xml"}
            for info in src.infolist():
                if info.flag_bits & 1:
                    return data, []
                if info.filename in gone:
                    actions.append(f"drop {info.filename}")
                    continue
                with src.open(info) as f:
                    body = f.read(budget + 1)
                budget -= len(body)
                if budget < 0:
                    return data, []
                new = body
                if info.filename.endswith(".opf"):
                    new = re.sub(rb"(?is)<(?:opf:)?meta\b[^>]*(?:name|property)\s*=\s*[\"'](?:[\w-]+:)?(?:generator|software)[\"'][^>]*?(?:/>|>[^<]*</(?:opf:)?meta\s*>)", b"", body)
                    new = re.sub(rb"(?is)<(dc:contributor|dc:creator)\b[^>]*>([^<]*)</\1\s*>", lambda m: b"" if hits(m[2]) or PRODUCTS.search(m[2]) else m[0], new)
                elif info.filename.startswith("docProps/") or info.filename == "meta.xml":
                    tags = "|".join(FIELDS.split()) + "|generator|initial-creator"
                    new = re.sub(rf"(<(?:\w+:)?({tags})\b[^>]*>)[^<]*(</)".encode(), rb"\1\3", body)
                elif gone and info.filename.endswith((".rels", "[Content_Types].xml")):
                    names = b"|".join(re.escape(n.encode()) for n in sorted(gone))
                    new = re.sub(rb"<(?:Relationship|Override)\b[^>]*?(?:Target|PartName)\s*=\s*[\"'](?:\.\./|/)?(?:" + names + rb")[\"'][^>]*/>", b"", body)
                elif TEXT_PART.search(info.filename):
                    new = _clean_runs(body, info.filename)
                elif sniff(body) in CLEANERS and sniff(body) not in ("zip", "pdf"):
                    new, own = CLEANERS[sniff(body)](body, keep)
                    actions += [f"{info.filename}: {a}" for a in own]
                if new != body and not actions[-1:] == [f"blank {info.filename}"]:
                    actions.append(f"blank {info.filename}")
                method = zipfile.ZIP_STORED if info.filename == "mimetype" else zipfile.ZIP_DEFLATED
                dst.writestr(zipfile.ZipInfo(info.filename, info.date_time), new, method)
    except (zipfile.BadZipFile, zlib.error, EOFError, OSError, RuntimeError, NotImplementedError, ValueError):
        return data, []
    return (out.getvalue(), actions) if actions else (data, [])


def _clean_bmp(data: bytes, keep: bool) -> tuple[bytes, list[str]]:
    """What follows the pixels goes, and the size in the header is set anew."""
    for kind, at, _, body in binary.bmp_extent(data):
        if kind == "trailing" and body and _drop(kind, body, True, keep):
            return data[:2] + struct.pack("<I", at) + data[6:at], [f"drop BMP trailing ({len(body)} bytes)"]
    return data, []


_PACKET = re.compile(rb"(?is)<\?xpacket begin.*?<\?xpacket end[^?]*\?>")


def _clean_pdf(data: bytes, keep: bool) -> tuple[bytes, list[str]]:
    """XMP packets outside compressed streams become blanks of the same length: offsets of the file stay true."""
    gone = [m.span() for m in _PACKET.finditer(data) if _drop("", m[0], True, keep)]
    out = bytearray(data)
    for lo, hi in gone:
        out[lo:hi] = b" " * (hi - lo)
    return bytes(out), ["blank PDF XMP packet"] * len(gone)


CLEANERS: dict[str, Callable[[bytes, bool], tuple[bytes, list[str]]]] = {
    "png": _clean_png, "jpeg": _clean_jpeg, "webp": _clean_riff, "wav": _clean_riff, "gif": _clean_gif, "tiff": _clean_tiff, "mp3": _clean_id3, "zip": _clean_zip, "bmp": _clean_bmp, "pdf": _clean_pdf,
} | dict.fromkeys(("avif", "heic", "mp4"), _clean_iso)


def clean(data: bytes, keep_plain: bool = False) -> tuple[bytes, list[str]]:
    """data without provenance metadata, and what was done; with keep_plain, only metadata that names a generator goes.

    Formats without a cleaner, and files that can't be read whole, come back as they are.
    """
    kind = sniff(data)
    return CLEANERS[kind](data, keep_plain) if kind in CLEANERS else (data, [])


def decode_entities(xml: str) -> str:
    """Character references and the five named entities as characters; other names stay."""
    return re.sub(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|amp|lt|gt|quot|apos);", lambda m: unescape(m[0]), xml)


def encode_entities(text: str) -> str:
    return escape(text, quote=False)


def inspect_udf():
    @F.pandas_udf(REPORT)
    def report(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([inspect(bytes(c)) if c is not None else (None,) * 4 for c in contents], columns=["format", "has_c2pa", "has_ai_metadata", "findings"])

    return report


def clean_udf(keep_plain: bool = False):
    @F.pandas_udf(CLEANED)
    def cleaned(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([clean(bytes(c), keep_plain) if c is not None else (None, None) for c in contents], columns=["content", "actions"])

    return cleaned
