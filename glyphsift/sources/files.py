"""Reading files, request bodies, sitemaps and corpora; writing reports."""

from __future__ import annotations

import gzip
import io
import ipaddress
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats

#: Folders that a directory audit passes over, beside those whose name begins with a dot.
SKIPPED = ("__pycache__", "build", "dist", "node_modules", "target", "venv")
BATCH_LIMIT, SITEMAP_CAP, PAGE_CAP, PAGE_DEPTH = 50, 64 << 20, 200, 3


def _tree(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)


def below(spark: SparkSession, path: Column, root: str) -> Column:
    """The part of a path below root, whatever folders root itself lies in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = fs.makeQualified(at).toString().rstrip("/")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    return F.substr(plain(path), F.lit(len(re.sub("^file:/+", "file:/", whole)) + 1))


def read_tree(spark: SparkSession, root: str, size_cap: int = formats.SIZE_CAP) -> DataFrame:
    """(path, length, content) of the files below root of at most size_cap bytes; skipped folders below it are left out.

    The size filter reaches the file listing, so larger files are never opened. Spark itself passes over files and
    folders that begin with a dot or an underscore.
    """
    files = _tree(spark, root).where(F.col("length") <= size_cap)
    skipped = below(spark, F.col("path"), root).rlike("/(?:" + "|".join(SKIPPED) + r"|\.[^/]+)/")
    return files.where(~skipped).select("path", "length", "content")


def too_large(spark: SparkSession, root: str, size_cap: int = formats.SIZE_CAP) -> DataFrame:
    """(path, reason) of the files that read_tree() leaves out for their size, without reading them."""
    return _tree(spark, root).where(F.col("length") > size_cap).select("path", F.lit("too large").alias("reason"))


def read_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select("path", "length", "content")


def as_text(files: DataFrame) -> DataFrame:
    """files with text and error: the text of valid UTF-8 that doesn't look binary, else why there is none."""
    reason = formats.binary_reason(F.col("content"))
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    error = F.when(reason.isNotNull(), F.concat(F.lit("binary: "), reason)).when(~valid, "invalid utf-8")
    return files.withColumn("error", error).withColumn("text", F.when(F.col("error").isNull(), F.col("content").cast("string")))


def read_corpus(spark: SparkSession, folder: str, limit: int | None = None, cap: int = 64 << 10) -> DataFrame:
    """(path, text) of the non-empty .txt files of a folder, at most cap bytes each, in order of their paths."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).where(F.col("length") <= cap)
    texts = files.select("path", F.col("content").cast("string").alias("text")).where(F.trim("text") != "").orderBy("path")
    return texts if limit is None else texts.limit(limit)


def batch_items(requests: DataFrame, id_col: str = "id", body_col: str = "body") -> DataFrame:
    """(id, ord, name, content, error) of each entry of JSON bodies {"files": [{"file": base64, "name": ...}]}.

    A body that isn't such JSON, has no files or more than BATCH_LIMIT is one row with an error; so is a bad entry.
    """
    kind = "struct<files:array<struct<file:string,name:string>>>"
    parsed = requests.select(F.col(id_col).alias("id"), F.from_json(F.col(body_col), kind)["files"].alias("f"))
    n = F.coalesce(F.size("f"), F.lit(0))
    whole = F.when(F.col("f").isNull(), "files must be a list").when(n == 0, "files is empty").when(n > BATCH_LIMIT, "too many files")
    bad = parsed.where(whole.isNotNull()).select("id", F.lit(None).cast("int").alias("ord"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("binary").alias("content"), whole.alias("error"))
    rows = parsed.where(whole.isNull()).select("id", F.posexplode("f").alias("ord", "e"))
    content = F.try_to_binary(F.col("e.file"), F.lit("base64"))
    good = rows.select("id", "ord", "e.name", content.alias("content"), F.when(F.col("e.file").isNull(), "file is missing").when(content.isNull(), "file is not base64").alias("error"))
    return good.unionByName(bad)


def sitemap_urls(xml: Column) -> Column:
    """The <loc> values of a sitemap; null where it declares a document type or an entity, or is too large."""
    safe = ~xml.rlike("(?i)<!(?:doctype|entity)") & (F.length(xml) <= SITEMAP_CAP)
    return F.when(safe, F.transform(F.xpath(xml, F.lit('//*[local-name()="loc"]/text()')), lambda x: F.trim(x)))


def plain_sitemap_udf():
    """The text of a sitemap file, unpacked where it is gzip; null where it isn't readable or unpacks beyond SITEMAP_CAP."""

    def unpack(data: bytes) -> str | None:
        if data[:2] == b"\x1f\x8b":
            try:
                data = gzip.GzipFile(fileobj=io.BytesIO(data)).read(SITEMAP_CAP + 1)
            except (OSError, EOFError):
                return None
        return data.decode("utf-8", "replace") if len(data) <= SITEMAP_CAP else None

    @F.pandas_udf("string")
    def plain(contents: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else unpack(bytes(c)) for c in contents], dtype=object)

    return plain


def sitemaps_in_robots(robots: Column) -> Column:
    """The sitemaps that a robots.txt names, each once, in order."""
    lines = F.regexp_extract_all(robots, F.lit(r"(?im)^[ \t]*sitemap[ \t]*:[ \t]*(\S+)"), F.lit(1))
    return F.array_distinct(lines)


def is_public_address_udf():
    """Whether a numeric address is a public one; addresses of other machines behind IPv4-mapped forms count as those.

    Null for what isn't an address.
    """

    def public(host: str) -> bool | None:
        try:
            address = ipaddress.ip_address(host.strip("[]").split("%", 1)[0])
        except ValueError:
            return None
        return (getattr(address, "ipv4_mapped", None) or address).is_global

    @F.pandas_udf("boolean")
    def checked(hosts: pd.Series) -> pd.Series:
        return pd.Series([None if h is None else public(h) for h in hosts], dtype=object)

    return checked


def is_sitemap_index(xml: Column) -> Column:
    return xml.rlike(r"(?is)^\s*(?:<\?xml.*?\?>)?\s*(?:<!--.*?-->\s*)*<(?:\w+:)?sitemapindex\b")


def same_site(url: Column, root: Column) -> Column:
    """One host, and one scheme or a step up from http to https."""
    part = lambda u, p: F.lower(F.try_parse_url(u, F.lit(p)))
    scheme = (part(url, "PROTOCOL") == part(root, "PROTOCOL")) | ((part(root, "PROTOCOL") == "http") & (part(url, "PROTOCOL") == "https"))
    return F.coalesce(scheme & (part(url, "HOST") == part(root, "HOST")), F.lit(False))


def collect_urls(sitemaps: DataFrame, root: str, depth: int = PAGE_DEPTH, most: int = PAGE_CAP) -> DataFrame:
    """Page URLs reached from the sitemap at root through fetched sitemaps (url, xml), each once, at most ``most``."""
    spark = sitemaps.sparkSession
    found = sitemaps.select("url", is_sitemap_index(F.col("xml")).alias("is_index"), F.explode(sitemap_urls(F.col("xml"))).alias("loc"))
    found = found.where(same_site(F.col("loc"), F.lit(root)))
    level, seen, pages = spark.createDataFrame([(root,)], "url string"), spark.createDataFrame([(root,)], "url string"), None
    for _ in range(depth + 1):
        here = found.join(level, "url", "left_semi")
        own = here.where(~F.col("is_index")).select(F.col("loc").alias("url"))
        pages = own if pages is None else pages.union(own)
        level = here.where("is_index").select(F.col("loc").alias("url")).distinct().join(seen, "url", "left_anti")
        seen = seen.union(level)
    return pages.distinct().orderBy("url").limit(most)


def cleaned_name(path: Column) -> Column:
    """a/b.txt as a/b.cleaned.txt."""
    return F.when(path.rlike(r"/[^/]*\.[^/.]+$|^[^/]*\.[^/.]+$"), F.regexp_replace(path, r"\.([^/.]+)$", r".cleaned.$1")).otherwise(F.concat(path, F.lit(".cleaned")))


def write_report(df: DataFrame, folder: str, kind: str = "json") -> None:
    """df as JSON lines, quoted CSV, text or Parquet, in a new folder: an existing one raises."""
    writer = df.write.mode("errorifexists")
    {"json": writer.json, "text": writer.text, "parquet": writer.parquet, "csv": lambda f: writer.option("header", True).option("quoteAll", True).csv(f)}[kind](folder)


def batch_response(results: DataFrame) -> DataFrame:
    """(id, body): the JSON answer to each batch of results (id, ord, name, content, error), entries in their order.

    Contents travel in base64, entries that failed with their error; a batch that failed as a whole has that alone.
    """
    entry = F.struct(F.col("ord"), F.col("name"), F.base64("content").alias("file"), F.col("error"))
    rows = results.groupBy("id").agg(F.array_sort(F.collect_list(entry)).alias("e"), F.max(F.when(F.col("ord").isNull(), F.col("error"))).alias("whole"))
    body = F.to_json(F.struct(F.transform("e", lambda x: F.struct(x["name"].alias("name"), x["file"].alias("file"), x["error"].alias("error"))).alias("files")))
    return rows.select("id", F.when(F.col("whole").isNotNull(), F.to_json(F.struct(F.col("whole").alias("error")))).otherwise(body).alias("body"))


#: The options that a request may set, and their kinds.
OPTIONS = {"nfkc": "boolean", "confusables": "boolean", "spaces": "boolean", "strip_glue": "boolean", "strip_bidi": "boolean"}


def allowed_options(options: Column) -> Column:
    """Of a map of options (name to text), the known ones with true or false for a value; the others go."""
    good = F.map_filter(options, lambda k, v: k.isin(*OPTIONS) & F.lower(v).isin("true", "false"))
    return F.transform_values(good, lambda k, v: F.lower(v) == "true")


def markdown_report(summary: DataFrame, title: str = "Benchmark") -> str:
    """A small summary table as Markdown."""
    head = f"# {title}\n\n| " + " | ".join(summary.columns) + " |\n|" + "-|" * len(summary.columns)
    show = lambda x: "" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x).replace("|", "\\|")
    return "\n".join([head, *("| " + " | ".join(map(show, r)) + " |" for r in summary.collect())]) + "\n"
