"""What a file is: magic bytes, binary guard, routing by extension, kind of a fetched URL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First bytes in hexadecimal, and what has them.
MAGIC = {
    "zip": "504B0304 504B0506 504B0708", "pdf": "255044462D", "png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "gif": "474946383761 474946383961",
    "bmp": "424D", "tiff": "49492A00 4D4D002A", "riff": "52494646", "ogg": "4F676753", "gzip": "1F8B", "bzip2": "425A68", "xz": "FD377A585A00",
    "7z": "377ABCAF271C", "rar": "526172211A07", "elf": "7F454C46", "class": "CAFEBABE", "ole": "D0CF11E0A1B11AE1",
    "sqlite": "53514C69746520666F726D6174203300", "psd": "38425053", "woff": "774F4646 774F4632", "font": "0001000000 4F54544F",
}
SNIFF_BYTES, CONTROL_SHARE, SIZE_CAP = 8192, 0.05, 256 << 20
EXTENSIONS = {
    "image": "avif bmp gif heic heif jpeg jpg png tif tiff webp",
    "container": "docx epub htm html markdown md mdx odt pdf pptx svg xlsx",
    "text": "css csv go js json py rs text toml txt yaml yml",
    "av": "m4a m4v mov mp3 mp4 wav",
}
#: Kinds of URL paths by extension, for those whose kind isn't the extension itself.
URL_KINDS = {"jpg": "jpeg", "heif": "heic", "tif": "tiff", "mov": "mp4", "m4a": "mp4", "htm": "html", "md": "markdown", "txt": "text"}
URL_SAME = "avif bmp docx epub gif heic html jpeg markdown mp3 mp4 odt pdf png pptx svg tiff wav webp xlsx"
HEIC = ["heic", "heix", "hevc", "hevx", "mif1", "msf1"]


def starts(content: Column, *magic: str) -> Column:
    """Whether binary content begins with one of some byte strings, in hexadecimal."""
    head = F.hex(F.substring(content, 1, 16))
    out = F.lit(False)
    for m in magic:
        out = out | head.startswith(m)
    return out


def binary_reason(content: Column) -> Column:
    """Why content isn't text: its magic, 'nul', 'control'; null for text and for no bytes."""
    head = F.substring(content, 1, SNIFF_BYTES)
    # Bytes as Latin-1 characters: one character a byte.
    chars = F.decode(head, "ISO-8859-1")
    n = F.length(head)
    out = F.when(n == 0, None)
    for name, magic in MAGIC.items():
        out = out.when(starts(content, *magic.split()), name)
    controls = F.regexp_count(chars, F.lit(r"[\x01-\x08\x0e-\x1a\x1c-\x1f]"))
    return out.when(F.regexp_count(chars, F.lit(r"\x00")) > 0, "nul").when(controls / n > CONTROL_SHARE, "control")


def image_format(content: Column) -> Column:
    text = lambda a, n: F.decode(F.substring(content, a, n), "ISO-8859-1")
    brand = text(9, 4)
    ftyp = text(5, 4) == "ftyp"
    return (
        F.when(starts(content, MAGIC["png"]), "png").when(starts(content, "FFD8"), "jpeg")
        .when(starts(content, MAGIC["riff"]) & (brand == "WEBP"), "webp")
        .when(ftyp & brand.isin("avif", "avis"), "avif").when(ftyp & brand.isin(*HEIC), "heic")
        .when(starts(content, *MAGIC["gif"].split()), "gif")
        .when(starts(content, *MAGIC["tiff"].split(), "49492B00", "4D4D002B"), "tiff").when(starts(content, "424D"), "bmp")
    )


def av_format(content: Column) -> Column:
    text = lambda a, n: F.decode(F.substring(content, a, n), "ISO-8859-1")
    return F.when(starts(content, MAGIC["riff"]) & (text(9, 4) == "WAVE"), "wav").when((text(5, 4) == "ftyp"), "mp4").when(starts(content, "494433") | F.hex(F.substring(content, 1, 2)).rlike("^FF[EF]"), "mp3")


def container_format(content: Column, ext: Column) -> Column:
    head = F.lower(F.trim(F.decode(F.substring(content, 1, 2000), "ISO-8859-1")))
    known = ext.isin(*EXTENSIONS["container"].split())
    return F.when(known, F.when(ext == "htm", "html").when(ext.isin("md", "mdx"), "markdown").otherwise(ext)).when(starts(content, MAGIC["pdf"]), "pdf").when(head.contains("<svg"), "svg").when(head.rlike("^<!doctype html|<html"), "html").when(starts(content, "504B0304"), "zip")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def classify(path: Column, content: Column) -> Column:
    """text, image, container, av or unknown: by extension, else by the first bytes."""
    ext = extension(path)
    out = F.when(F.lit(False), None)
    for kind, names in EXTENSIONS.items():
        out = out.when(ext.isin(*names.split()), kind)
    return out.when(image_format(content).isNotNull(), "image").when(av_format(content).isNotNull(), "av").when(container_format(content, ext).isNotNull(), "container").otherwise("unknown")


def kind_by_content_type(content_type: Column) -> Column:
    ct = F.trim(F.split(F.lower(F.coalesce(content_type, F.lit(""))), ";")[0])
    sub = F.split(ct, "/")[1]
    office = F.when(ct.contains("wordprocessingml"), "docx").when(ct.endswith("spreadsheetml.sheet"), "xlsx").when(ct.endswith("presentationml.presentation"), "pptx")
    return (
        F.when(ct.contains("html"), "html").when(ct.contains("svg"), "svg").when(office.isNotNull(), office)
        .when(ct.contains("opendocument.text"), "odt").when(ct.contains("markdown"), "markdown").when(ct == "text/plain", "text")
        .when(ct == "application/pdf", "pdf").when(ct == "application/epub+zip", "epub")
        .when(ct.startswith("image/") & sub.isin(*"avif bmp gif heic jpeg png tiff webp".split()), sub).when(ct == "image/heif", "heic")
        .when(ct.isin("audio/mp4", "audio/x-m4a", "video/mp4", "video/quicktime"), "mp4")
        .when(ct.isin("audio/x-wav", "audio/wav"), "wav").when(ct.isin("audio/mp3", "audio/mpeg"), "mp3")
    )


def kind_by_url(url: Column) -> Column:
    ext = F.lower(F.regexp_extract(F.regexp_replace(url, "[?#].*$", ""), r"/[^/]*\.([A-Za-z0-9]+)$", 1))
    out = F.when(ext.isin(*URL_SAME.split()), ext)
    for name, kind in URL_KINDS.items():
        out = out.when(ext == name, kind)
    return out


def kind_by_text(body: Column) -> Column:
    """Of a body that decoded as text: svg, html or text."""
    start = F.lower(F.left(body, F.lit(2000)))
    tagged = F.regexp_replace(F.left(start, F.lit(100)), r"^\s+", "").startswith("<")
    return F.when(tagged & F.left(start, F.lit(500)).contains("svg"), "svg").when(start.contains("<html") | tagged, "html").otherwise("text")


def guess_kind(url: Column, body: Column, content_type: Column | None = None) -> Column:
    """The kind of a fetched page: content type, then path, then body."""
    known = kind_by_content_type(content_type) if content_type is not None else F.lit(None).cast("string")
    return F.coalesce(known, kind_by_url(url), kind_by_text(body))
