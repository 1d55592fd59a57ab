"""Provenance marks in HTML, Markdown front matter, SVG and data URIs: regular expressions, no document tree."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import embedded

AI_NAME = r"aigc|ai[-_ ]?generated|anthropic|c2pa|claude|content.?credential|digital.?source|gemini|generator|openai|provenance|synthid"
VENDOR = r"anthropic|chatgpt|claude|copilot|dall.?e|gemini|midjourney|openai|stable.?diffusion|synthid"
HINTS = r"contentcredentials|digitalsourcetype|algorithmicmedia|ai generated|generated by|c2pa|aigc"
META_TAG = r"(?i)<meta\b[^>]*>"
DATA_AI = r"""(?i)\bdata-ai[-\w]*\s*=\s*["'][^'"]*["']"""
JSON_LD = r"""(?is)<script\b[^>]*\btype\s*=\s*["']application/ld\+json["'][^>]*>.*?</script>"""
NAME_IS_GENERATOR = r"""(?i)\b(?:name|property|generator)\s*=\s*["']generator["']"""
DATA_URI = r"""(?i)data:image/[a-z0-9.+-]+(?:;[^\s"'<>),]+)*,[a-z0-9+/=%\s]+"""
KEY = r"(?m)^([-.\w]+)[ \t]*:.*$"
FRONT_MATTER = r"\A---\r?\n([\s\S]*?)\r?\n---(?:\r?\n|\z)"
#: Front-matter keys that tell of a generator.
KEYS = (
    "ai", "model", "llm", "claude", "gemini", "openai", "c2pa", "synthid", "anthropic", "generator", "provenance", "createdwith", "created_with",
    "ai-generated", "ai_generated", "contentcredentials", "content_credentials", "digitalsourcetype", "digital_source_type",
)


def _has(t: Column, pattern: str) -> Column:
    return t.rlike("(?i)" + pattern)


def meta_tags(html: Column) -> Column:
    """Array of (tag, cms, ai, c2pa) of the meta tags."""
    one = lambda tag: F.struct(
        tag.alias("tag"),
        (cms := tag.rlike(NAME_IS_GENERATOR) & ~_has(tag, VENDOR)).alias("cms"),
        (~cms & _has(tag, f"{AI_NAME}|{HINTS}")).alias("ai"),
        _has(tag, r"c2pa|content.?credential").alias("c2pa"),
    )
    return F.transform(F.regexp_extract_all(html, F.lit(META_TAG), F.lit(0)), one)


def json_ld(html: Column) -> Column:
    """The JSON-LD blocks that tell of a generator."""
    return F.filter(F.regexp_extract_all(html, F.lit(JSON_LD), F.lit(0)), lambda b: _has(b, f"{AI_NAME}|digitalsourcetype|softwareagent|trainedalgorithmicmedia"))


def data_ai(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(DATA_AI), F.lit(0))


def html_findings(html: Column) -> Column:
    tags = meta_tags(html)
    said = F.transform(F.filter(tags, lambda m: m["cms"] | m["ai"]), lambda m: F.concat(F.when(m["cms"], "info: cms generator: ").otherwise("meta: "), F.left(m["tag"], F.lit(120))))
    blocks = F.transform(json_ld(html), lambda _: F.lit("json-ld provenance-like block"))
    return F.concat(said, blocks, F.transform(data_ai(html), lambda a: F.concat(F.lit("attr: "), F.left(a, F.lit(80)))))


def html_has_c2pa(html: Column) -> Column:
    return F.exists(meta_tags(html), lambda m: m["c2pa"]) | F.exists(json_ld(html), lambda b: _has(b, "c2pa|contentcredential"))


def html_has_ai(html: Column) -> Column:
    return F.exists(meta_tags(html), lambda m: m["ai"]) | (F.size(json_ld(html)) > 0) | (F.size(data_ai(html)) > 0)


def clean_html(html: Column) -> Column:
    """html without AI meta tags, JSON-LD provenance and data-ai attributes; a CMS generator stays."""
    drop = F.concat(F.transform(F.filter(meta_tags(html), lambda m: m["ai"]), lambda m: m["tag"]), json_ld(html))
    out = F.aggregate(F.array_distinct(drop), html, lambda acc, x: F.replace(acc, x, F.lit("")))
    return F.regexp_replace(out, r"\s*" + DATA_AI.replace("(?i)", "(?i:") + ")", "")


def clean_html_all(html: Column) -> Column:
    """clean_html(), and the images inside as data URIs cleaned: (text, actions)."""
    return embedded.clean_udf()(clean_html(html))


def front_matter(text: Column) -> Column:
    """The front-matter block, or an empty string."""
    return F.regexp_extract(text, FRONT_MATTER, 1)


def front_matter_keys(text: Column) -> Column:
    """Array of (key, ai, ai_value) of the top-level keys."""
    lines = F.regexp_extract_all(front_matter(text), F.lit(KEY), F.lit(0))
    key = lambda line: F.regexp_extract(line, r"^([-.\w]+)", 1)
    return F.transform(lines, lambda x: F.struct(key(x).alias("key"), (F.lower(key(x)).isin(*KEYS) | _has(key(x), AI_NAME)).alias("ai"), _has(F.regexp_extract(x, r"^[^:]*:([\s\S]*)$", 1), AI_NAME).alias("ai_value")))


def markdown_findings(text: Column) -> Column:
    said = F.transform(front_matter_keys(text), lambda k: F.array(F.when(k["ai"], F.concat(F.lit("frontmatter key: "), k["key"])), F.when(k["ai_value"], F.concat(F.lit("frontmatter value hit on "), k["key"]))))
    return F.array_compact(F.flatten(said))


def clean_markdown_text(text: str) -> str:
    """text without front-matter keys that tell of a generator, nor what is nested below them."""
    import re

    found = re.match(FRONT_MATTER.replace(r"\z", r"\Z"), text)
    if not found:
        return text
    kept, dropping = [], False
    for line in found[1].splitlines():
        key = re.match(r"([-.\w]+)\s*:(.*)", line)
        nested = not line.strip() or line.lstrip().startswith("#") or line[0] in " \t-"
        if not nested:
            dropping = bool(key) and (key[1].lower() in KEYS or bool(re.search(AI_NAME, key[1], re.I) or re.search(AI_NAME, key[2], re.I)))
        if not dropping:
            kept.append(line)
    block, body = "\n".join(kept).strip("\n"), text[found.end() :]
    return f"---\n{block}\n---\n{body}" if block else body.lstrip("\n")


def clean_markdown_udf():
    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else clean_markdown_text(t) for t in texts], dtype=object)

    return cleaned


SVG_DROPS = (r"(?is)<(?:\w+:)?(metadata|xmpmeta|RDF)\b[^>]*>.*?</(?:\w+:)?\1\s*>", rf"(?is)<!--(?:(?!-->).)*?(?:{AI_NAME})(?:(?!-->).)*?-->", r"""(?i)\s+(?:\w+:)?generator\s*=\s*(?:"[^"]*"|'[^']*')""")


def svg_findings(svg: Column) -> Column:
    return F.array_compact(F.array(
        F.when(_has(svg, r"<metadata\b"), "svg <metadata> present"),
        F.when(_has(svg, r"xmpmeta|<rdf:RDF\b"), "xmp packet present in svg"),
        F.when(svg.rlike(SVG_DROPS[1]), "marker: svg comment"),
        F.when(svg.rlike(SVG_DROPS[2]), "attr: svg generator"),
    ))


def clean_svg(svg: Column) -> Column:
    for pattern in SVG_DROPS:
        svg = F.regexp_replace(svg, pattern, "")
    return svg


def data_uris(text: Column) -> Column:
    """Array of (mime, payload) of base64 image URIs; a payload that isn't base64 is null."""
    uris = F.filter(F.regexp_extract_all(text, F.lit(DATA_URI), F.lit(0)), lambda u: F.lower(u).contains(";base64,"))
    return F.transform(uris, lambda u: F.struct(F.regexp_extract(F.lower(u), "^data:([^;,]+)", 1).alias("mime"), F.try_to_binary(F.regexp_replace(F.regexp_extract(u, r",([\s\S]*)$", 1), r"\s", ""), F.lit("base64")).alias("payload")))
