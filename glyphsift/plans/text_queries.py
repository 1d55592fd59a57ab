"""Stylometry, Layer A and version-comparison queries."""

from pyspark.sql import functions as F

from ..functions import compare, gumbel, layer_a, phrases, text
from ..functions.layer_a import KIND_CLASSES, LOOK_ALIKES, SPACE_CHARS
from ..operators import stylometry as st
from ..sources.tables import table
from . import seeded
from .seeded import DOCUMENTS_SQL

W = text.WORD.replace("'", "''")
Q: dict = {}
SQL: dict = {}

WORDS_SQL = rf"list_transform(regexp_extract_all(text, '{W}'), lambda w: lower(w))"
SENTS_SQL = r"""
  unf as (select doc_id, text, array_to_string(list_filter(string_split(regexp_replace(regexp_replace(text, '\r\n|[\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]', chr(10), 'g'), '(?m)^[ \t]*```[^\n]*$', chr(2), 'g'), chr(2)), lambda p, i: i % 2 = 1), chr(10)) u from docs),
  sent as (select doc_id, text, list_filter(list_transform(string_split(regexp_replace(regexp_replace(u, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') s from unf)
"""
LENGTHS_SQL = rf"list_filter(list_transform(s, lambda x: len(regexp_extract_all(x, '{W}'))), lambda n: n > 0)"
PHRASE_WEIGHT_SQL = " + ".join(f"len(regexp_extract_all(text, '(?i){p.replace(chr(39), chr(39) * 2)}')) * {round(w * 10)}" for _, w, _, p in phrases.PHRASES)
MATTR_SQL = """case when len(w) = 0 then 0.0 when len(w) <= 50 then len(list_distinct(w)) / len(w)
  else list_sum(list_transform(range(1, len(w) - 48), lambda i: len(list_distinct(w[i:i + 49])))) ::bigint / (50 * (len(w) - 49)) end"""
STYLE_SQL = f"""with {DOCUMENTS_SQL}, {SENTS_SQL.strip()},
m as (select doc_id, {WORDS_SQL} w, {LENGTHS_SQL} l, len(s) sentence_count, ({PHRASE_WEIGHT_SQL}) / 10.0 phrase_weight from sent),
n as (select doc_id, len(w) word_count, sentence_count, phrase_weight, {MATTR_SQL} d,
  case when len(l) >= 2 and len(w) >= 30 then list_stddev_samp(l) / list_avg(l) end cv, case when len(w) < 30 then 0.0 else phrase_weight / (len(w) / 100.0) end g from m),
b as (select *, case when cv < 0.25 then 0.95 when cv < 0.35 then 0.80 when cv < 0.45 then 0.50 when cv < 0.55 then 0.25 else 0.05 end bs,
  case when g >= 2 then 1.0 when g >= 1 then 0.75 when g >= 0.5 then 0.45 when g > 0 then 0.20 else 0.0 end gs, case when d between 0.68 and 0.76 then 0.4 else 0.1 end ds from n),
c as (select *, case when word_count < 30 then 0.0 else greatest(0.0, least(1.0, (case when cv is null then (gs * 0.45 + ds * 0.10) / 0.55 else bs * 0.45 + gs * 0.45 + ds * 0.10 end)::double
  * case when word_count < 100 then 0.4 + 0.6 * ((word_count - 30) / 70.0) else 1.0 end)) end score from b),
scored as (select doc_id, word_count, sentence_count, round(cv, 4) burstiness_cv, round(d, 4) lexical_diversity, round(g, 4) ai_ngram_density, round(score, 4) score,
  case when score >= 0.75 then 'HIGH' when score >= 0.5 then 'MEDIUM' when score >= 0.25 then 'LOW' else 'CLEAN' end confidence_level, case when word_count < 30 then 'insufficient_length' else 'ok' end status from c)
"""


def add(name, run, sql=None):
    Q[name] = run
    if sql:
        SQL[name] = sql


def _scored(spark, sf):
    out = st.stylometry(seeded.documents(spark, sf).select("doc_id", "text"))
    r = lambda c: F.round(c, 4).alias(c)
    return out.select("doc_id", "word_count", "sentence_count", r("burstiness_cv"), r("lexical_diversity"), r("ai_ngram_density"), r("score"), "confidence_level", "status")


add("stylometry_score", _scored, STYLE_SQL + "select * from scored")
add("stylometry_tiers", lambda s, d: _scored(s, d).groupBy("confidence_level", "status").agg(F.count("*").alias("n")), STYLE_SQL + "select confidence_level, status, count(*) n from scored group by all")
add("word_count", lambda s, d: seeded.documents(s, d).select("doc_id", text.word_count(F.col("text")).alias("words")), f"with {DOCUMENTS_SQL} select doc_id, len(regexp_extract_all(text, '{W}')) words from docs")
add("sentence_count", lambda s, d: seeded.documents(s, d).select("doc_id", F.size(text.sentences(F.col("text"))).alias("sentences")), f"with {DOCUMENTS_SQL}, {SENTS_SQL} select doc_id, len(s) sentences from sent")


def _burstiness(spark, sf):
    docs = seeded.documents(spark, sf).select("doc_id", text.sentences(F.col("text")).alias("s")).select("doc_id", text.sentence_lengths(F.col("s")).alias("l"))
    mean, cv = text.mean_and_cv(F.col("l"))
    return docs.select("doc_id", F.round(mean, 6).alias("mean_words"), F.round(cv, 6).alias("cv"))


add("burstiness_cv", _burstiness, f"with {DOCUMENTS_SQL}, {SENTS_SQL}, m as (select doc_id, {LENGTHS_SQL} l from sent) select doc_id, round(case when len(l) > 0 then list_avg(l) else 0.0 end, 6) mean_words, round(case when len(l) >= 2 then list_stddev_samp(l) / list_avg(l) end, 6) cv from m")
add("mattr_50", lambda s, d: table(s, d, "documents").select("doc_id", F.round(st.mattr("text"), 6).alias("mattr")), f"with m as (select doc_id, {WORDS_SQL} w from documents) select doc_id, round({MATTR_SQL}, 6) mattr from m")
add("phrase_density", lambda s, d: seeded.documents(s, d).select("doc_id", (phrases.weight(F.col("text")) / 10).alias("weight")), f"with {DOCUMENTS_SQL} select doc_id, ({PHRASE_WEIGHT_SQL}) / 10.0::double weight from docs")


def _phrase_hits(spark, sf):
    m = seeded.documents(spark, sf).select(F.explode(phrases.matches(F.col("text"))).alias("m"))
    return m.groupBy(F.col("m.phrase").alias("phrase")).agg(F.sum("m.count").alias("hits"))


add("phrase_hits", _phrase_hits, f"with {DOCUMENTS_SQL}, h as (" + " union all ".join(f"select {seeded._quote(lb)} phrase, sum(len(regexp_extract_all(text, '(?i){p.replace(chr(39), chr(39) * 2)}'))) hits from docs" for lb, _, _, p in phrases.PHRASES) + ") select phrase, hits from h where hits > 0")
add("fence_stripped_text", lambda s, d: seeded.documents(s, d).select("doc_id", F.length(text.unfenced(F.col("text"))).alias("chars")), f"with {DOCUMENTS_SQL}, {SENTS_SQL} select doc_id, length(u) chars from unf")

# Layer A, native
_count_sql = ", ".join(f"len(regexp_extract_all(text, '{c}')) as {k}" for k, c in KIND_CLASSES.items())
add("char_kind_counts", lambda s, d: (lambda docs: docs.select("doc_id", *[c.alias(k) for k, c in layer_a.kind_counts(F.col("text")).items()]))(seeded.documents(s, d)), f"with {DOCUMENTS_SQL} select doc_id, {_count_sql} from docs")


def _kinds_by_lang(spark, sf):
    docs = seeded.documents(spark, sf)
    return docs.groupBy("lang").agg(*[F.sum(c).alias(k) for k, c in layer_a.kind_counts(F.col("text")).items()])


add("strip_kind_by_lang", _kinds_by_lang, f"with {DOCUMENTS_SQL}, c as (select lang, {_count_sql} from docs) select lang, " + ", ".join(f"sum({k}) as {k}" for k in KIND_CLASSES) + " from c group by lang")


def _suspicious(spark, sf):
    docs = seeded.documents(spark, sf)
    return docs.select("doc_id", layer_a.suspicious_total(F.col("text")).alias("suspicious_total"))


add("layer_a_suspicious_total", _suspicious, f"with {DOCUMENTS_SQL} select doc_id, " + " + ".join(f"len(regexp_extract_all(text, '{c}'))" for c in KIND_CLASSES.values()) + " as suspicious_total from docs")
ANY_CLASS = "|".join(KIND_CLASSES.values())


def _hits(spark, sf):
    found = seeded.documents(spark, sf).select("doc_id", F.explode(layer_a.places_udf()("text")).alias("h"))
    return found.select("doc_id", "h.pos", "h.ch")


_chars_sql = f"""with {DOCUMENTS_SQL}, ch as (select doc_id, unnest(string_split(text, '')) ch, generate_subscripts(string_split(text, ''), 1) - 1 pos from docs),
hits as (select doc_id, pos, ch from ch where regexp_matches(ch, '{ANY_CLASS}')) """
add("top_codepoints", lambda s, d: _hits(s, d).groupBy("ch").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs")).select(F.expr("hex(encode(ch, 'UTF-8'))").alias("utf8"), "n", "docs"), _chars_sql + "select hex(encode(ch)) utf8, count(*) n, count(distinct doc_id) docs from hits group by ch")
add("first_offsets", lambda s, d: _hits(s, d).groupBy("doc_id", F.expr("hex(encode(ch, 'UTF-8'))").alias("utf8")).agg(F.count("*").alias("n"), F.concat_ws(",", F.transform(F.slice(F.sort_array(F.collect_list("pos")), 1, 10), lambda x: x.cast("string"))).alias("offsets")), _chars_sql + "select doc_id, hex(encode(ch)) utf8, count(*) n, array_to_string(list_sort(list(pos))[1:10], ',') offsets from hits group by doc_id, ch")
_sp, _la = ("".join(f"|| chr({ord(c)})" for c in SPACE_CHARS)[2:], "".join(f"|| chr({ord(c)})" for c in LOOK_ALIKES[0])[2:])
add("clean_spaces", lambda s, d: seeded.documents(s, d).select("doc_id", F.md5(layer_a.clean_spaces(F.col("text")).cast("binary")).alias("digest")), f"with {DOCUMENTS_SQL} select doc_id, md5(translate(text, {_sp}, repeat(' ', {len(SPACE_CHARS)}))) digest from docs")
add("clean_confusables", lambda s, d: seeded.documents(s, d).select("doc_id", F.md5(layer_a.clean_confusables(F.col("text")).cast("binary")).alias("digest")), f"with {DOCUMENTS_SQL} select doc_id, md5(translate(text, {_la}, '{LOOK_ALIKES[1]}')) digest from docs")
_free_sql = "translate(regexp_replace(text, '" + layer_a.cp.regex_class(layer_a.cp.STRIPPED) + f"', '', 'g'), {_sp}, repeat(' ', {len(SPACE_CHARS)}))"
add("clean_context_free", lambda s, d: seeded.documents(s, d).select("doc_id", F.length(layer_a.clean_context_free(F.col("text"))).alias("chars"), F.md5(layer_a.clean_context_free(F.col("text")).cast("binary")).alias("digest")), f"with {DOCUMENTS_SQL} select doc_id, length({_free_sql}) chars, md5({_free_sql}) digest from docs")


def _reinspect(spark, sf):
    docs = seeded.documents(spark, sf).select("doc_id", layer_a.clean_context_free(F.col("text")).alias("text"))
    return docs.agg(F.count("*").alias("docs"), F.sum(layer_a.suspicious_total(F.col("text"))).alias("left_over"))


add("clean_reinspect_zero", _reinspect, f"with {DOCUMENTS_SQL}, c as (select {_free_sql} as text from docs) select count(*) docs, sum(" + " + ".join(f"len(regexp_extract_all(text, '{c}'))" for c in KIND_CLASSES.values()) + ") left_over from c")
#: Residue of the id, code point, label, kind and confidence of the carriers that inspection reports.
CARRIER_HITS = (
    (0, "U+200B ZERO WIDTH SPACE (Cf)", "zwj_family"), (1, "U+00AD SOFT HYPHEN (Cf)", "strip"), (2, "U+202E RIGHT-TO-LEFT OVERRIDE (Cf)", "bidi"),
    (3, "U+E0041 TAG LATIN CAPITAL LETTER A (Cf)", "tag_chars"), (4, "U+FEFF ZERO WIDTH NO-BREAK SPACE (Cf)", "zwj_family"), (5, "U+00A0 NO-BREAK SPACE (Zs)", "space"),
    (6, "U+3000 IDEOGRAPHIC SPACE (Zs)", "space"), (7, "U+E000 UNKNOWN (Co)", "private_use"), (8, "U+FDD0 UNKNOWN (Cn)", "noncharacter"),
)
_hit_rows = ", ".join(f"({r}, {seeded.CARRIERS[r]}, '{label}', '{kind}', '{'informational' if kind == 'space' else 'probable'}')" for r, label, kind in CARRIER_HITS)
_gone, _space = layer_a.cp.regex_class(layer_a.cp.STRIPPED), layer_a.cp.regex_class(layer_a.cp.SPACES)
add("layer_a_inspect", lambda s, d: seeded.documents(s, d).select("doc_id", F.explode(layer_a.inspect_udf()("text")).alias("h")).select("doc_id", "h.codepoint", "h.label", "h.count", "h.kind", "h.confidence"),
    f"select doc_id, v.cp::int codepoint, v.label as label, 1 as count, v.kind as kind, v.confidence as confidence from documents join (values {_hit_rows}) v(r, cp, label, kind, confidence) on doc_id % {len(seeded.CARRIERS) + 1} = v.r where text is not null")
# Beside the carriers that the ids put in, context plays no part: the exact scan comes to what the free one does.
add("clean_text_exact", lambda s, d: seeded.documents(s, d).select("doc_id", layer_a.clean_udf()("text").alias("c")).select("doc_id", "c.output_length", "c.removed_count", "c.replaced_count", F.md5(F.col("c.text").cast("binary")).alias("digest")),
    f"with {DOCUMENTS_SQL} select doc_id, length({_free_sql})::int output_length, len(regexp_extract_all(text, '{_gone}'))::int removed_count, len(regexp_extract_all(text, '{_space}'))::int replaced_count, md5({_free_sql}) digest from docs")
add("nfkc_clean", lambda s, d: seeded.documents(s, d).select("doc_id", layer_a.clean_udf(nfkc=True, confusables=True)("text").alias("c")).select("doc_id", "c.nfkc_changed", "c.output_length"),
    f"with {DOCUMENTS_SQL}, c as (select doc_id, translate({_free_sql}, {_la}, '{LOOK_ALIKES[1]}') x from docs) select doc_id, nfc_normalize(x) <> x nfkc_changed, length(nfc_normalize(x))::int output_length from c")


def _in_context(spark, sf):
    """Carriers where what stands beside them speaks for them, and the same where it doesn't: (doc_id, case, kept)."""
    docs = table(spark, sf, "documents").select("doc_id", F.left("text", F.lit(20)).alias("t"))
    case = F.lit(None)
    for i, (before, carrier, after, _) in enumerate(CONTEXTS):
        case = F.when(F.col("doc_id") % len(CONTEXTS) == i, F.concat(F.col("t"), F.lit(" " + before + carrier + after))).otherwise(case)
    wanted = F.get(F.array(*[F.lit(c) for _, c, _, _ in CONTEXTS]), (F.col("doc_id") % len(CONTEXTS)).cast("int"))
    cleaned = docs.select("doc_id", wanted.alias("c"), layer_a.clean_udf()(case)["text"].alias("x"))
    return cleaned.select("doc_id", F.col("x").contains(F.col("c")).alias("kept"))


#: What stands before a carrier, the carrier, what stands after it, and whether it stays.
CONTEXTS = (
    ("\u0646\u0645\u06cc", "\u200c", "\u062e\u0648\u0627\u0647\u0645", True), ("abc", "\u200c", "def", False),
    ("\u0915\u094d", "\u200d", "\u0937", True), ("\U0001f468", "\u200d", "\U0001f469", True), ("a", "\u200d", "\U0001f469", False),
    ("\u845b", "\U000e0100", "", True), ("a", "\U000e0100", "", False), ("\u1820", "\u180b", "", True),
    ("\U0001f3f4\U000e0067\U000e0062", "\U000e0065", "\U000e006e\U000e0067\U000e007f", True), ("x", "\U000e0065", "y", False),
    ("\u2764", "\ufe0f", "", True), ("a", "\ufe0f", "", False), ("\u202aab", "\u202c", "", True), ("ab", "\u202c", "", False), ("\u05d0", "\u200f", "", True),
)
_kept_sql = " ".join(f"when {i} then {str(keeps).lower()}" for i, (_, _, _, keeps) in enumerate(CONTEXTS))
add("carriers_in_context", _in_context, f"select doc_id, case doc_id % {len(CONTEXTS)} {_kept_sql} end kept from documents where text is not null")

# Versions of a text
def _pairs(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    changed = F.concat(F.regexp_replace("text", "the ", "this "), F.when(F.col("doc_id") % 3 == 0, " 42 https://a.example/x").otherwise(""))
    base = F.concat("text", F.when(F.col("doc_id") % 2 == 0, " 42 7 https://a.example/x").otherwise(""))
    return docs.select("doc_id", base.alias("a"), changed.alias("b"))


_pairs_sql = "pairs as (select doc_id, text || case when doc_id % 2 = 0 then ' 42 7 https://a.example/x' else '' end a, replace(text, 'the ', 'this ') || case when doc_id % 3 = 0 then ' 42 https://a.example/x' else '' end b from documents)"
_tok = r"regexp_extract_all(lower({}), '[a-z0-9]+')"
_div_sql = f"""{_pairs_sql}, t as (select doc_id, a, b, {_tok.format('a')} ta, {_tok.format('b')} tb from pairs),
g as (select *, list_distinct(list_transform(range(1, len(ta)), lambda i: ta[i] || ' ' || ta[i + 1])) x, list_distinct(list_transform(range(1, len(tb)), lambda i: tb[i] || ' ' || tb[i + 1])) y from t),
divergence as (select doc_id, a, b, case when len(ta) = 0 and len(tb) = 0 then 0.0 when len(ta) = 0 or len(tb) = 0 then 1.0 when len(list_distinct(x || y)) = 0 then 0.0
  else 1.0 - len(list_intersect(x, y)) / len(list_distinct(x || y)) end lexical_divergence from g)"""
add("lexical_divergence_pairs", lambda s, d: _pairs(s, d).select("doc_id", F.round(compare.lexical_divergence(F.col("a"), F.col("b")), 6).alias("lexical_divergence")), f"with {_div_sql} select doc_id, round(lexical_divergence, 6) lexical_divergence from divergence")
_kept = "case when len(list_distinct({0})) = 0 then 1.0 else len(list_intersect(list_distinct({0}), {1})) / len(list_distinct({0})) end"
_num, _url = [_kept.format(f"regexp_extract_all(a, '{p}')", f"regexp_extract_all(b, '{p}')") for p in ("[0-9]+", r"https?://[^\s]+")]
add("numbers_preserved", lambda s, d: _pairs(s, d).select("doc_id", F.round(compare.numbers_preserved(F.col("a"), F.col("b")), 6).alias("kept")), f"with {_pairs_sql} select doc_id, round({_num}, 6) kept from pairs")
add("urls_preserved", lambda s, d: _pairs(s, d).select("doc_id", F.round(compare.urls_preserved(F.col("a"), F.col("b")), 6).alias("kept")), f"with {_pairs_sql} select doc_id, round({_url}, 6) kept from pairs")


def _quality(spark, sf):
    q = _pairs(spark, sf).select("doc_id", compare.quality(F.col("a"), F.col("b")).alias("q"))
    r = lambda c: F.round(F.col(f"q.{c}"), 6).alias(c)
    return q.select("doc_id", r("lexical_divergence"), r("length_ratio"), r("numbers_preserved"), r("urls_preserved"), "q.tokens_in", "q.tokens_out")


add("quality_struct", _quality, f"with {_div_sql} select doc_id, round(lexical_divergence, 6) lexical_divergence, round(length(b) / greatest(length(a), 1), 6) length_ratio, round({_num}, 6) numbers_preserved, round({_url}, 6) urls_preserved, greatest(1, length(a) // 4)::int tokens_in, greatest(1, length(b) // 4)::int tokens_out from divergence")


def _best(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("a"))
    cands = docs.withColumn("idx", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    b = F.when(F.col("idx") == 0, F.col("a")).when(F.col("idx") == 1, F.replace(F.col("a"), F.lit("the "), F.lit("this "))).otherwise(F.left("a", F.lit(40)))
    best = compare.best_candidate(cands.withColumn("b", b), "doc_id", "idx", "a", "b")
    return best.select("doc_id", "idx", F.round("selection_score", 6).alias("selection_score"))


add("best_candidate", _best, f"""with pairs as (select doc_id, text a, i idx, case i when 0 then text when 1 then replace(text, 'the ', 'this ') else left(text, 40) end b from documents, (values (0), (1), (2)) v(i)),
{_div_sql.split('pairs as ')[1].split('), ', 1)[1].replace('doc_id, a, b', 'doc_id, idx, a, b').replace('select doc_id, a, b,', 'select doc_id, idx, a, b,')},
s as (select doc_id, idx, lexical_divergence - case when length(b) / greatest(length(a), 1) > 2 or length(b) / greatest(length(a), 1) < 0.5 then 0.15 else 0.0 end s from divergence),
r as (select *, row_number() over (partition by doc_id order by s desc, idx) n from s) select doc_id, idx, round(s, 6) selection_score from r where n = 1""")

# Keyed watermark replay
add("token_ids", lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(gumbel.tokens(F.col("text"))).alias("pos", "tok")).select("doc_id", "pos", gumbel.token_hex(F.col("tok")).alias("id_hex")), "select doc_id, generate_subscripts(t, 1)::int - 1 pos, substr(sha256(unnest(t)), 1, 16) id_hex from (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') t from documents)")
add("token_digest", lambda s, d: table(s, d, "documents").select("doc_id", gumbel.tokens(F.col("text")).alias("t")).select("doc_id", F.array_size("t").alias("tokens"), F.sha2(F.array_join(F.transform("t", gumbel.token_hex), ""), 256).alias("digest")), "select doc_id, len(t)::int tokens, sha256(array_to_string(list_transform(t, lambda x: substr(sha256(x), 1, 16)), '')) digest from (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') t from documents)")
add("gumbel_masking_counts", lambda s, d: gumbel.masking(table(s, d, "documents"), "doc_id", "text"), r"""
with t as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') w from documents),
c as (select doc_id, len(w) n, list_transform(range(5, len(w) + 1), lambda i: array_to_string(w[i - 4:i - 1], ' ')) ctx from t)
select doc_id, n tokens_total, least(4, n) skipped_no_context, (len(ctx) - len(list_distinct(ctx))) skipped_repeated, len(list_distinct(ctx)) counted from c""")
KEY = "glyphsift-example-key"
_pads = [bytes(b ^ x for b in KEY.encode().ljust(64, b"\0")).hex() for x in (0x36, 0x5C)]
_flip = lambda x: f"(xor(unhex(seed || repeat('0', 64))::bit, unhex(repeat('{x}', 64))::bit)::blob)"
#: HMAC by its definition, and the tail of the gamma distribution as a sum of logarithms.
_replay_sql = rf"""with t as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') w from documents where text is not null),
h as (select doc_id, list_transform(w, lambda x: left(sha256(x), 16)) h from t),
c as (select doc_id, h, unnest(range(5, len(h) + 1)) i from h),
f as (select doc_id, array_to_string(h[i - 4:i - 1], '') ctx, arg_min(h[i], i) tok from c group by all),
s as (select doc_id, tok, sha256(unhex('{_pads[1]}') || unhex(sha256(unhex('{_pads[0]}') || unhex(ctx)))) seed from f),
u as (select doc_id, (('0x' || left(sha256({_flip('5C')} || unhex(sha256({_flip('36')} || unhex(tok)))), 16))::ubigint::double + 0.5) / 18446744073709551616.0 u from s),
g as (select doc_id, count(*) n, sum(-ln(1 - least(u, 1 - 1.1102230246251565e-16))) s from u group by doc_id),
p as (select t.doc_id, len(w)::int tokens_total, coalesce(n, 0)::int counted, case when n is null then 1.0 else least(1.0, list_sum(list_transform(range(0, n), lambda k: exp(k * ln(s) - lgamma(k + 1) - s)))) end p from t left join g using (doc_id))
select doc_id, tokens_total, counted, round(p, 6) p_value, counted > 0 and p < 1e-6 is_watermarked from p"""
add("gumbel_p_value", lambda s, d: table(s, d, "documents").where("text is not null").select("doc_id", gumbel.detect_udf(KEY)("text").alias("r")).select("doc_id", "r.tokens_total", "r.counted", F.round("r.p_value", 6).alias("p_value"), "r.is_watermarked"), _replay_sql)
