"""Documents and pages with carriers put in by id, in both dialects: the plain tables have none of what is looked for."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import table

CARRIERS = (0x200B, 0xAD, 0x202E, 0xE0041, 0xFEFF, 0xA0, 0x3000, 0xE000, 0xFDD0, 0x430, 0xFF21)
PHRASE = " Furthermore, it is important to note the rich tapestry of ideas, a testament to a paradigm shift."
FENCE = "\n```\nsome code here. More code.\n```\nDone with it."
HEADS = (
    '<meta name="generator" content="WordPress 6.4">', '<meta name="generator" content="ChatGPT"><meta property="ai-generated" content="true">',
    '<script type="application/ld+json">{"digitalSourceType": "trainedAlgorithmicMedia"}</script>', '<div data-ai-model="x" data-ai="y"></div>',
    '<meta name="provenance" content="c2pa">', "",
)


def documents(spark, sf_dir: str) -> DataFrame:
    """documents with text seeded: a carrier, or none, for each residue of the id; phrases and a fence for some."""
    docs = table(spark, sf_dir, "documents")
    k = (F.lit(10) + F.col("doc_id") % 7).cast("int")
    carrier = F.coalesce(F.get(F.array(*[F.lit(chr(c)) for c in CARRIERS]), (F.col("doc_id") % (len(CARRIERS) + 1)).cast("int")), F.lit(""))
    text = F.concat(F.left("text", k), carrier, F.substr("text", k + 1))
    text = F.concat(text, F.when(F.col("doc_id") % 5 == 0, PHRASE).otherwise(""), F.when(F.col("doc_id") % 11 == 0, FENCE).otherwise(""))
    return docs.withColumn("text", text)


def pages(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages")
    head = F.get(F.array(*map(F.lit, HEADS)), (F.col("page_id") % len(HEADS)).cast("int"))
    return rows.withColumn("html", F.concat(head, F.col("html")))


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_CASES = " ".join(f"when {i} then chr({c})" for i, c in enumerate(CARRIERS))
DOCUMENTS_SQL = f"""docs as (
  select doc_id, lang, source, n_chars,
    left(text, 10 + doc_id % 7) || case doc_id % {len(CARRIERS) + 1} {_CASES} else '' end || substr(text, 11 + doc_id % 7)
    || case when doc_id % 5 = 0 then {_quote(PHRASE)} else '' end || case when doc_id % 11 = 0 then {_quote(FENCE)} else '' end as text
  from documents
)"""
PAGES_SQL = f"""pgs as (
  select page_id, url, case page_id % {len(HEADS)} {" ".join(f"when {i} then {_quote(h)}" for i, h in enumerate(HEADS))} end || html as html from pages
)"""
