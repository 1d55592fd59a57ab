import io
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from glyphsift.functions import detectors, media
from test_sources import PNG, chunk

JPEG = b"\xff\xd8\xff\xe0\x00\x06JFIF\xff\xeb\x00\x0cJUMBc2pa--\xff\xe1\x00\x10Exif\0\0 OpenAI \xff\xfe\x00\x07plain\xff\xda\x00\x02body\xff\xd9"


def riff(kind, *parts):
    body = kind + b"".join(k + struct.pack("<I", len(b)) + b + b"\0" * (len(b) & 1) for k, b in parts)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def box(kind, body):
    return struct.pack(">I", len(body) + 8) + kind + body


WEBP = riff(b"WEBP", (b"VP8X", b"\x0c" + b"\0" * 9), (b"VP8 ", b"pixels"), (b"EXIF", b"made by Claude"), (b"XMP ", b"odd"))
WAV = riff(b"WAVE", (b"fmt ", b"\0" * 16), (b"LIST", b"INFOISFTSynthID"), (b"data", b"sound"))
MP4 = box(b"ftyp", b"isom") + box(b"moov", box(b"mvhd", b"x" * 9) + box(b"udta", b"Generated by OpenAI")) + box(b"uuid", b"c2pa manifest") + box(b"mdat", b"frames")
GIF = b"GIF89a" + b"\1\0\1\0\0\0\0" + b"!\xfe\x06OpenAI\0" + b"!\xff\x0bNETSCAPE2.0\x03\x01\0\0\0" + b",\0\0\0\0\1\0\1\0\0\x02\x01\x44\0;"
TIFF = b"II*\0" + struct.pack("<IHHHIIHHIII", 8, 2, 305, 2, 7, 38, 256, 3, 1, 5, 0) + b"OpenAI\0"
ID3 = b"ID3\x03\0\0\0\0\0\x19" + b"TSSE" + (7).to_bytes(4, "big") + b"\0\0" + b"\0OpenAI" + b"\0" * 8 + b"audio"


def docx():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", '<Types><Override PartName="/customXml/item1.xml" ContentType="x"/><Override PartName="/word/document.xml" ContentType="y"/></Types>')
        z.writestr("docProps/core.xml", "<cp><dc:creator>Claude</dc:creator><dc:date>1</dc:date></cp>")
        z.writestr("customXml/item1.xml", "<x>c2pa</x>")
        z.writestr("word/_rels/document.xml.rels", '<R><Relationship Id="r1" Target="../customXml/item1.xml"/><Relationship Id="r2" Target="styles.xml"/></R>')
        z.writestr("word/document.xml", "<w>text</w>")
        z.writestr("word/media/image1.png", PNG)
    return out.getvalue()


FILES = {"png": (PNG, True), "jpeg": (JPEG, True), "webp": (WEBP, False), "wav": (WAV, False), "mp4": (MP4, True), "gif": (GIF, False), "tiff": (TIFF, False), "mp3": (ID3, False), "zip": (docx(), True)}


@pytest.mark.parametrize("kind", FILES)
def test_marks_are_found_and_go(kind):
    data, c2pa = FILES[kind]
    got = media.inspect(data)
    assert (got[0], got[1], got[2]) == (kind, c2pa, True), got
    cleaned, actions = media.clean(data)
    assert actions and media.inspect(cleaned)[1:3] == (False, False), (actions, media.inspect(cleaned))
    assert media.clean(cleaned)[0] == cleaned or kind in ("tiff", "mp3", "mp4", "zip")


def test_content_stays():
    assert b"body\xff\xd9" in media.clean(JPEG)[0] and b"pixels" in media.clean(WEBP)[0] and b"sound" in media.clean(WAV)[0]
    assert media.clean(WEBP)[0][20] == 0  # the header no longer announces metadata
    for data in (MP4, TIFF, ID3):
        assert len(media.clean(data)[0]) == len(data)
    assert media.clean(MP4)[0].endswith(b"frames") and b"NETSCAPE" in media.clean(GIF)[0]
    with zipfile.ZipFile(io.BytesIO(media.clean(docx())[0])) as z:
        names = z.namelist()
        assert "word/document.xml" in names and not any(n.startswith("customXml") for n in names)
        assert z.read("docProps/core.xml") == b"<cp><dc:creator></dc:creator><dc:date>1</dc:date></cp>"
        assert b"r1" not in z.read("word/_rels/document.xml.rels") and b"r2" in z.read("word/_rels/document.xml.rels")
        assert b"customXml" not in z.read("[Content_Types].xml") and b"document" in z.read("[Content_Types].xml")


def test_plain_metadata_can_stay():
    plain = b"\x89PNG\r\n\x1a\n" + chunk(b"tEXt", b"Title\0My holiday") + chunk(b"tEXt", b"Software\0Midjourney v6") + chunk(b"IEND", b"")
    kept, actions = media.clean(plain, keep_plain=True)
    assert b"holiday" in kept and b"Midjourney" not in kept and actions == ["drop PNG tEXt"]
    assert media.inspect(chunk and plain)[3] == ["PNG tEXt: Software: Midjourney"]
    assert not media.inspect(b"\x89PNG\r\n\x1a\n" + chunk(b"tEXt", b"Comment\0I met Sora") + chunk(b"IEND", b""))[2]


def test_pdf_and_loose_bytes():
    pdf = b"%PDF-1.7\n1 0 obj << /Creator (Anthropic) >>\nstream\nOpenAI c2pa\nendstream\n"
    assert media.inspect(pdf)[3] == ["pdf-structured:ai:anthropic"]
    assert media.inspect(pdf + b"<x:xmpmeta>digitalSourceType</x:xmpmeta>")[3][-1] == "xmp packet present"
    assert media.inspect(WEBP[:20] + b"c2pa")[3][-1] == "byte-scan C2PA markers: c2pa"
    assert media.inspect(b"text") == ("unknown", False, False, ["unsupported format: unknown"])


def test_broken_files_come_back_whole():
    rng = random.Random(0)
    for data, _ in FILES.values():
        for _ in range(30):
            cut = data[: rng.randint(0, len(data))] + rng.randbytes(rng.randint(0, 5))
            media.inspect(cut)
            media.clean(cut)
    assert media.clean(b"PK\x03\x04nonsense") == (b"PK\x03\x04nonsense", [])


def test_entities():
    assert media.decode_entities("a &amp; &#x200b;&#65;&nbsp;&lt;") == "a & ​A&nbsp;<"
    assert media.encode_entities("a<b>&c") == "a&lt;b&gt;&amp;c"


def test_columns(spark):
    df = spark.createDataFrame([(PNG,), (None,)], "content binary")
    got = df.select(media.inspect_udf()("content").alias("r"), media.clean_udf()("content").alias("c")).collect()
    assert got[0].r.format == "png" and got[0].c.actions and got[1].r.format is None


def test_detectors(spark):
    def broken(_):
        raise RuntimeError("no model")

    detectors.register("broken", broken)
    detectors.register("gumbel", detectors.keyed("k"))
    try:
        df = spark.createDataFrame([("a b c d e f g",), (None,)], "t string").withColumn("r", detectors.run_all(F.col("t")))
        rows = df.select("r", F.size(detectors.available(F.col("r"))).alias("n"), detectors.evaluator(F.col("r")).alias("e")).collect()
        by = {r.detector: r for r in rows[0].r}
        assert by["broken"].error == "RuntimeError: no model" and not by["vendor"].available and by["gumbel"].p_value > 0
        assert rows[0].n == 1 and rows[0].e == "gumbel" and rows[1].r == [None] * 3
    finally:
        detectors.unregister("broken")
        detectors.unregister("gumbel")


def test_bmp_and_pdf_are_cleaned_in_place():
    from glyphsift.plans import binary_queries as made

    bmp = made._bmp("")
    out, actions = media.clean(bmp)
    assert out == bmp[:2] + (58).to_bytes(4, "little") + bmp[6:58] and len(actions) == 1
    assert media.clean(out) == (out, [])
    pdf = made._pdf("")
    out, actions = media.clean(pdf)
    assert len(out) == len(pdf) and b"OpenAI" not in out and b"c2pa aigc" in out and actions == ["blank PDF XMP packet"]


def test_text_runs_of_packages():
    assert media.clean_run("a&#x200B;b &amp; c") == "ab &amp; c"
    assert media.clean_run("plain &amp; &#65;") == "plain &amp; &#65;"
    assert media.clean_run("na\u00a0me\u200b") == "na\u00a0me"
    xml = "<w:p a='\u200b'><w:t>x\u200by</w:t></w:p>"
    assert media._clean_runs(xml.encode(), "word/document.xml").decode() == "<w:p a='\u200b'><w:t>xy</w:t></w:p>"
    page = "<p>a\u200bb</p><script>x\u200b</script>"
    assert media._clean_runs(page.encode(), "c1.xhtml").decode() == "<p>ab</p><script>x\u200b</script>"


def test_images_in_text():
    import base64
    from urllib.parse import quote

    from glyphsift.functions import embedded
    from glyphsift.plans import binary_queries as made

    png = base64.b64encode(made._png("x", 1)).decode()
    page = f"<img src='data:image/png;base64,{png[:40]}\n{png[40:]}'> <i style='url(data:image/svg+xml,{quote('<svg><metadata>openai</metadata></svg>')})'> data:image/png;base64,!!"
    c2pa, ai, found = embedded.inspect(page)
    assert c2pa and ai and any(f.startswith("embedded data:image/png: PNG chunk caBX") for f in found) and "embedded data:image/svg+xml: svg <metadata> present" in found
    new, actions = embedded.clean(page)
    assert len(actions) == 2 and embedded.inspect(new) == (False, False, []) and embedded.clean(new) == (new, [])
