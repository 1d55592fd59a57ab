"""Queries over files made from documents: PNG chunks, ZIP members, media audits, data URIs, detectors."""

import base64
import io
import struct
import zipfile
import zlib

import pandas as pd
from pyspark.sql import functions as F

from ..functions import detectors, embedded, formats, markup, media
from ..operators import audit
from ..sources import binary, files
from ..sources.tables import table

Q: dict = {}
SQL: dict = {}


def add(name, run, sql=None):
    Q[name] = run
    if sql:
        SQL[name] = sql


def _png(text: str, n: int) -> bytes:
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    extra = chunk(b"tEXt", b"Software\0Midjourney") if n % 3 == 0 else chunk(b"caBX", b"manifest") if n % 3 == 1 else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"tEXt", b"Comment\0" + text.encode()) + extra + chunk(b"IEND", b"")


def _zip(text: str, n: int) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", text)
        if n % 2:
            z.writestr("docProps/core.xml", "<cp><dc:creator>OpenAI</dc:creator></cp>")
    return out.getvalue()


def _files(spark, sf, make):
    @F.pandas_udf("binary")
    def content(texts: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([make(t or "", int(i)) for t, i in zip(texts, ids)], dtype=object)

    docs = table(spark, sf, "documents").where("doc_id is not null")
    return docs.select(F.col("doc_id").cast("string").alias("path"), content("text", "doc_id").alias("content"))


add("png_chunks", lambda s, d: binary.records(_files(s, d, _png), "png").groupBy("type").agg(F.count("*").alias("n"), F.sum(F.length("payload")).alias("bytes")), """
select 'IHDR' as type, count(*) n, count(*) * 13 bytes from documents union all select 'IEND', count(*), 0 from documents
union all select 'tEXt', count(*) + count(*) filter (doc_id % 3 = 0), sum(8 + octet_length(encode(text))) + 19 * count(*) filter (doc_id % 3 = 0) from documents
union all select 'caBX', count(*), count(*) * 8 from documents where doc_id % 3 = 1""")
add("zip_members", lambda s, d: binary.records(_files(s, d, _zip), "zip").select("path", F.col("type").alias("member"), "size"), """
select doc_id::varchar path, 'word/document.xml' as member, octet_length(encode(text)) size from documents union all select doc_id::varchar, 'docProps/core.xml', 40 from documents where doc_id % 2 = 1""")
add("media_inspect", lambda s, d: _files(s, d, _png).select("path", media.inspect_udf()("content").alias("r")).select("path", "r.format", "r.has_c2pa", "r.has_ai_metadata"), "select doc_id::varchar path, 'png' as format, doc_id % 3 = 1 has_c2pa, doc_id % 3 = 1 or doc_id % 3 = 0 has_ai_metadata from documents")
add("media_clean_reinspect", lambda s, d: _files(s, d, _png).select("path", media.clean_udf()("content")["content"].alias("c")).select("path", media.inspect_udf()("c").alias("r")).select("path", "r.has_c2pa", "r.has_ai_metadata"), "select doc_id::varchar path, false has_c2pa, false has_ai_metadata from documents")
add("package_inspect", lambda s, d: _files(s, d, _zip).select("path", media.inspect_udf()("content").alias("r")).select("path", "r.has_ai_metadata", F.concat_ws("|", "r.findings").alias("findings")), "select doc_id::varchar path, doc_id % 2 = 1 has_ai_metadata, case when doc_id % 2 = 1 then 'meta: docProps/core.xml: openai' else '' end findings from documents")


def _audit(spark, sf):
    rows = _files(spark, sf, _png).select("path", media.inspect_udf()("content").alias("r"))
    return audit.summary(audit.with_confidence(rows.select("path", F.lit("image").alias("kind"), "r.has_c2pa", "r.has_ai_metadata", F.lit(0).alias("suspicious_total"), "r.findings")))


add("media_audit_summary", _audit, """select count(*) total, count(*) filter (doc_id % 3 = 1) with_c2pa, count(*) filter (doc_id % 3 < 2) with_ai_metadata, 0::bigint with_suspicious_text, count(*) filter (doc_id % 3 < 2) actionable_files,
count(*) filter (doc_id % 3 = 1) confirmed, count(*) filter (doc_id % 3 = 0) probable, 0::bigint informational, 0::bigint likely_false_positive from documents""")
add("classify_files", lambda s, d: _files(s, d, _png).select("path", formats.classify(F.concat("path", F.when(F.col("path").cast("long") % 2 == 0, ".txt").otherwise("")), F.col("content")).alias("kind")), "select doc_id::varchar path, case when doc_id % 2 = 0 then 'text' else 'image' end kind from documents")
add("data_uris", lambda s, d: table(s, d, "documents").select("doc_id", F.explode(markup.data_uris(F.concat(F.lit('<img src="data:image/png;base64,'), F.base64(F.encode("text", "UTF-8")), F.lit('">')))).alias("u")).select("doc_id", "u.mime", F.length("u.payload").alias("bytes")), "select doc_id, 'image/png' mime, octet_length(encode(text)) bytes from documents where text <> ''")
add("sitemap_urls", lambda s, d: table(s, d, "pages").select("page_id", F.explode(files.sitemap_urls(F.concat(F.lit("<urlset><url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url></urlset>")))).alias("loc")), "select page_id, url loc from pages")
add("vendor_detector", lambda s, d: table(s, d, "documents").select("doc_id", detectors.run("vendor", F.col("text")).alias("r")).select("doc_id", "r.detector", "r.available"), "select doc_id, 'vendor' detector, false available from documents")
add("cleaned_names", lambda s, d: table(s, d, "documents").select("doc_id", files.cleaned_name(F.concat(F.lit("a.b/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".txt").otherwise(""))).alias("name")), "select doc_id, case when doc_id % 2 = 0 then 'a.b/' || doc_id || '.cleaned.txt' else 'a.b/' || doc_id || '.cleaned' end as name from documents")


# Files of every kind, made in memory from documents: by the residue of the id, one that says what made it.
def _jpeg(_: str) -> bytes:
    segment = lambda marker, body: b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body
    return b"\xff\xd8" + segment(0xE1, b"Exif\0\0made with OpenAI") + segment(0xDB, bytes(65)) + b"\xff\xda" + struct.pack(">H", 2) + b"\x11\x22\xff\xd9"


def _riff(form: bytes, *chunks: tuple[bytes, bytes]) -> bytes:
    body = form + b"".join(k + struct.pack("<I", len(b)) + b + b"\0" * (len(b) & 1) for k, b in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _gif(_: str) -> bytes:
    note = b"generated by OpenAI"
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"!\xfe" + bytes([len(note)]) + note + b"\0" + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\0" + b";"


def _tiff(_: str) -> bytes:
    value = b"OpenAI image tool\0"
    return b"II*\0" + struct.pack("<IH", 8, 1) + struct.pack("<HHII", 305, 2, len(value), 26) + struct.pack("<I", 0) + value


def _bmp(_: str) -> bytes:
    head = struct.pack("<IHHI", 58, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0)
    return b"BM" + head + bytes(4) + b"made by openai"


def _box(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body) + 8) + kind + body


def _mp4(_: str) -> bytes:
    return _box(b"ftyp", b"isom\0\0\0\0") + _box(b"moov", _box(b"udta", _box(b"name", b"tool: OpenAI"))) + _box(b"mdat", b"payload")


def _mp3(_: str) -> bytes:
    frame = b"TXXX" + struct.pack(">I", 15) + b"\0\0" + b"\0tool\0OpenAI v1"
    return b"ID3\x03\0\0" + bytes([0, 0, 0, len(frame)]) + frame + b"\xff\xfb\x90\0"


def _package(*parts: tuple[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts:
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def _pdf(_: str) -> bytes:
    return b"%PDF-1.4\n1 0 obj\n<< /Length 9 >>\nstream\nc2pa aigc\nendstream\n<?xpacket begin='x'?><x:xmpmeta>tool OpenAI</x:xmpmeta><?xpacket end='w'?>\n%%EOF"


def _inner_png() -> str:
    return base64.b64encode(_png("x", 0)).decode()


#: Name, what makes the file, its kind, whether it has C2PA or other provenance metadata, and invisible carriers in it.
KINDS = (
    ("a.txt", lambda t: ("zero\u200bwidth " + t).encode(), "text", False, False, 1),
    ("a.png", lambda t: _png(t, 1), "png", True, True, 0),
    ("a.jpg", _jpeg, "jpeg", False, True, 0),
    ("a.webp", lambda t: _riff(b"WEBP", (b"VP8 ", bytes(10)), (b"EXIF", b"made with OpenAI")), "webp", False, True, 0),
    ("a.gif", _gif, "gif", False, True, 0),
    ("a.tif", _tiff, "tiff", False, True, 0),
    ("a.bmp", _bmp, "bmp", False, True, 0),
    ("a.wav", lambda t: _riff(b"WAVE", (b"data", bytes(8)), (b"LIST", b"INFOISFTOpenAI")), "wav", False, True, 0),
    ("a.mp4", _mp4, "mp4", False, True, 0),
    ("a.mp3", _mp3, "mp3", False, True, 0),
    ("a.html", lambda t: f'<html><meta name="generator" content="ChatGPT"><p>{t}&nbsp;\u00ad</p></html>'.encode(), "html", False, True, 1),
    ("a.htm", lambda t: f'<html><img src="data:image/png;base64,{_inner_png()}"></html>'.encode(), "html", False, True, 0),
    ("a.md", lambda t: f"---\ntitle: x\ngenerator: gpt\n---\n{t}\u2060".encode(), "markdown", False, True, 1),
    ("a.svg", lambda t: b"<svg><metadata>openai</metadata></svg>", "svg", False, True, 0),
    ("a.docx", lambda t: _package(("word/document.xml", "<w:t>a</w:t>"), ("docProps/core.xml", "<cp><dc:creator>OpenAI</dc:creator></cp>")), "docx", False, True, 0),
    ("a.epub", lambda t: _package(("mimetype", "application/epub+zip"), ("content.opf", '<package><meta name="generator" content="openai tool"/></package>')), "epub", False, True, 0),
    ("a.pdf", _pdf, "pdf", False, True, 0),
    ("a.bin", lambda t: b"\x01\x02\x03 nothing known", "unknown", False, False, 0),
)


def _kinds(spark, sf):
    @F.pandas_udf("binary")
    def content(ids: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([KINDS[i % len(KINDS)][1](t or "") for i, t in zip(ids, texts)], dtype=object)

    name = F.get(F.array(*[F.lit(k[0]) for k in KINDS]), (F.col("doc_id") % len(KINDS)).cast("int"))
    docs = table(spark, sf, "documents").where("doc_id is not null")
    return docs.select(F.concat(F.col("doc_id").cast("string"), F.lit("/"), name).alias("path"), content("doc_id", "text").alias("content"))


_case = lambda at, show: f"case doc_id % {len(KINDS)} " + " ".join(f"when {i} then {show(k[at])}" for i, k in enumerate(KINDS)) + " end"
_str, _bool = "'{}'".format, lambda b: str(b).lower()
add("file_items", lambda s, d: audit.file_items(_kinds(s, d)).select("path", "kind", "has_c2pa", "has_ai_metadata", "suspicious_total"),
    f"select doc_id || '/' || {_case(0, _str)} path, {_case(2, _str)} kind, {_case(3, _bool)} has_c2pa, {_case(4, _bool)} has_ai_metadata, {_case(5, str)}::int suspicious_total from documents where doc_id is not null")
_CLEANABLE = ("png", "jpeg", "webp", "gif", "tiff", "bmp", "wav", "mp4", "mp3", "docx", "epub", "pdf")
_cleanable = " or ".join(f"doc_id % {len(KINDS)} = {i}" for i, k in enumerate(KINDS) if k[2] in _CLEANABLE)
add("file_clean_reinspect", lambda s, d: (lambda f: f.where(F.regexp_extract("path", r"\.(\w+)$", 1).isin("png", "jpg", "webp", "gif", "tif", "bmp", "wav", "mp4", "mp3", "docx", "epub", "pdf")).select("path", media.clean_udf()("content")["content"].alias("c")).select("path", media.inspect_udf()("c").alias("r")).select("path", "r.has_c2pa", "r.has_ai_metadata"))(_kinds(s, d)),
    f"select doc_id || '/' || {_case(0, _str)} path, false has_c2pa, false has_ai_metadata from documents where {_cleanable}")
add("embedded_images_cleaned", lambda s, d: (lambda f: f.where(F.col("path").endswith(".htm")).select("path", embedded.clean_udf()(F.decode("content", "UTF-8")).alias("c")).select("path", F.size("c.actions").alias("actions"), F.size(embedded.inspect_udf()("c.text")["findings"]).alias("left_over")))(_kinds(s, d)),
    f"select doc_id || '/a.htm' path, 1 actions, 0 left_over from documents where doc_id % {len(KINDS)} = 11")


def _runs(spark, sf):
    """Word documents whose text runs hold carriers, as characters or references, cleaned: the text that is left."""

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, ids: pd.Series) -> pd.Series:
        out = []
        for t, i in zip(texts, ids):
            run = "".join(c for c in t if c not in "<>&")
            part = f"<w:p><w:t>{run[:5]}{('\u200b', '&#x200B;', '&#8203;', '')[i % 4]}{run[5:]}</w:t></w:p>"
            data, _ = media.clean(_package(("word/document.xml", part), ("docProps/core.xml", "<cp><dc:creator>x</dc:creator></cp>")))
            out.append(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml").decode()[10:-12])
        return pd.Series(out, dtype=object)

    docs = table(spark, sf, "documents").where("doc_id is not null and text is not null")
    return docs.select("doc_id", F.md5(cleaned("text", "doc_id").cast("binary")).alias("digest"))


add("package_text_runs", _runs, "select doc_id, md5(regexp_replace(text, '[<>&]', '', 'g')) digest from documents where text is not null")


def _batches(spark, sf):
    rows = table(spark, sf, "documents").select((F.col("doc_id") % 40).alias("id"), F.col("doc_id").cast("int").alias("ord"), F.lit("a.md").alias("name"), F.encode(F.col("doc_id").cast("string"), "UTF-8").alias("content"), F.when(F.col("doc_id") % 5 == 0, "bad").alias("error"))
    body = files.batch_response(rows).select("id", F.from_json("body", "files array<struct<name:string,file:string,error:string>>")["files"].alias("f"))
    return body.select("id", F.size("f").alias("entries"), F.size(F.filter("f", lambda x: x["error"].isNotNull())).alias("errors"), F.unbase64(F.col("f")[0]["file"]).cast("string").alias("first"))


add("batch_responses", _batches, "select doc_id % 40 id, count(*)::int entries, count(*) filter (doc_id % 5 = 0)::int errors, min(doc_id)::varchar as first from documents group by 1")
