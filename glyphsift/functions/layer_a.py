"""Invisible and look-alike characters: native context-free counts, and the exact scan as Arrow UDFs."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import codepoints as cp

SPACE_CHARS = "".join(chr(c) for lo, hi in cp.SPACES for c in range(lo, hi + 1))
LOOK_ALIKES = "".join(map(chr, cp.CONFUSABLES)), "".join(cp.CONFUSABLES.values())
#: Anything that the exact scan could report or change; other texts skip it.
SUSPECT = cp.regex_class(cp.STRIPPED, cp.SPACES) + r"|\p{Cf}|" + cp.regex_class(tuple((c, c) for c in sorted(cp.CONFUSABLES)))
HIT = "array<struct<codepoint:int,label:string,count:int,kind:string,confidence:string,sample_offsets:array<int>>>"
CLEANED = "text string, input_length int, output_length int, removed map<string,int>, replaced map<string,int>, removed_count int, replaced_count int, nfkc_changed boolean"


# Native and free of context: what a character is, not where it stands.


def exclusive_kinds() -> dict[str, cp.Ranges]:
    """The kinds with the ranges that no kind before them has."""
    out, taken = {}, set()
    for kind, rs in cp.KINDS:
        own = []
        for lo, hi in rs:
            if hi - lo > 5000:  # the private-use planes meet no other kind
                own.append((lo, hi))
                continue
            own += [(c, c) for c in range(lo, hi + 1) if c not in taken]
            taken |= set(range(lo, hi + 1))
        out[kind] = _joined(own)
    return out


def _joined(points: list[tuple[int, int]]) -> cp.Ranges:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(points):
        if out and out[-1][1] == lo - 1:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return tuple(out)


KIND_CLASSES = {k: cp.regex_class(rs) for k, rs in exclusive_kinds().items()} | {"space": cp.regex_class(cp.SPACES)}


#: Characters below all but two suspect ones: most of any Latin text goes in one cheap pass.
PLAIN_RUN = r"[\x00-\x9f\xa1-\xac\xae-\x{34E}]+"


def odd_characters(t: Column) -> Column:
    """t without runs of plain characters: what of it can be suspect at all, in order."""
    return F.regexp_replace(t, PLAIN_RUN, "")


def kind_counts(t: Column) -> dict[str, Column]:
    odd = odd_characters(t)
    return {k: F.regexp_count(odd, F.lit(c)) for k, c in KIND_CLASSES.items()}


def suspicious_total(t: Column) -> Column:
    return F.regexp_count(odd_characters(t), F.lit("|".join(KIND_CLASSES.values())))


def is_suspect(t: Column) -> Column:
    """Whether the exact scan could report or change anything."""
    return odd_characters(t).rlike(SUSPECT)


def clean_spaces(t: Column) -> Column:
    return F.translate(t, SPACE_CHARS, " " * len(SPACE_CHARS))


def clean_confusables(t: Column) -> Column:
    return F.translate(t, *LOOK_ALIKES)


def clean_context_free(t: Column) -> Column:
    """Every strippable character goes, and spaces become plain, whatever stands beside them.

    Runs of plain characters are taken whole, and a text without spaces of the kind isn't looked through for them.
    """
    stripped = F.regexp_replace(t, f"({PLAIN_RUN}+)|{cp.regex_class(cp.STRIPPED)}", "$1")
    return F.when(odd_characters(t).rlike(cp.regex_class(cp.SPACES)), clean_spaces(stripped)).otherwise(stripped)


# The exact scan: one decision a character, from its neighbours and the text kept so far.

_GLUE = tuple(sorted((*cp.VARIATION, *cp.ranges("200C-200D"), *cp.TAG_CHARS, *cp.KHMER_VOWELS, *cp.HANGUL_FILLERS)))
_FLAG = re.compile("\U0001f3f4([\U000e0020-\U000e007e]+\U000e007f)")
_FAST = re.compile(r"[\x00-\x9f\xa1-\xac\xae-\u02ff]*")


def _paired(text: str) -> set[int]:
    """Places of embeddings and the PDFs that close them; a PDF that closes an override isn't one."""
    out: set[int] = set()
    stack: list[tuple[str, int]] = []
    for m in re.finditer("[\u202a-\u202e]", text):
        if m[0] != "\u202c":
            stack.append((m[0], m.start()))
        elif stack:
            opener, at = stack.pop()
            if opener in "\u202a\u202b":
                out |= {at, m.start()}
    return out


def _letter(c: int, block: cp.Ranges) -> bool:
    return cp.contains(block, c) and unicodedata.category(chr(c))[0] == "L"


def _script(c: int) -> int | None:
    if unicodedata.category(chr(c))[0] in "LM":
        for i, block in enumerate(cp.JOINING):
            if cp.contains(block, c):
                return i
    return None


def _bound(c: int, before: int | None, after: int | None, base: int | None, in_flag: bool) -> bool:
    """Whether an invisible character belongs to what stands beside it; base is the last kept character that isn't glue."""
    if before is not None:
        if cp.contains(cp.CJK, before) and (cp.contains(cp.VS_SUPPLEMENT, c) or 0xFE00 <= c <= 0xFE0D):
            return True
        if cp.contains(cp.MONGOLIAN_FVS, c) and cp.contains(cp.MONGOLIAN_BASE, before):
            return True
        if c in (0xFE0E, 0xFE0F) and cp.contains(cp.EMOJI_BASE, before):
            return True
    if c == 0x200D and base is not None and after is not None and cp.contains(cp.EMOJI_BASE, base) and cp.contains(cp.EMOJI_BASE, after):
        return True
    if c in (0x200C, 0x200D) and before is not None and after is not None:
        own = _script(before)
        if own is not None and own == _script(after):
            return True
    if in_flag or cp.contains(cp.ORTHOGRAPHIC_CF, c):
        return True
    if base is not None:
        if cp.contains(cp.MONGOLIAN_FVS, c) and _letter(base, cp.MONGOLIAN_BASE):
            return True
        if cp.contains(cp.KHMER_VOWELS, c) and _letter(base, cp.KHMER_BLOCK):
            return True
        if cp.contains(cp.HANGUL_FILLERS, c) and cp.contains(cp.HANGUL_JAMO, base):
            return True
    for controls, script in cp.LAYOUT:
        if cp.contains(controls, c):
            return any(x is not None and cp.contains(script, x) for x in (before, after))
    return False


def scan(text: str, *, spaces: bool = True, confusables: bool = False, strip_glue: bool = False, strip_bidi: bool = False):
    """(place, character, replacement, kind) of each character that doesn't stay as it is; the replacement may be ''."""
    flags = {i for m in _FLAG.finditer(text) for i in range(m.start(1), m.end(1))}
    pairs = set() if strip_bidi else _paired(text)
    base: int | None = None
    i, n = 0, len(text)
    while i < n:
        end = _FAST.match(text, i).end()
        if end > i:
            base, i = ord(text[end - 1]), end
            continue
        c = ord(text[i])
        before, after = ord(text[i - 1]) if i else None, ord(text[i + 1]) if i + 1 < n else None
        kept, out, kind = True, text[i], None
        if not strip_bidi and (i in pairs or cp.contains(cp.PRESERVABLE_BIDI, c)):
            pass
        elif not strip_glue and _bound(c, before, after, base, i in flags):
            pass
        elif kind := cp.strip_kind(c):
            kept, out = False, ""
        elif spaces and text[i] in SPACE_CHARS:
            out, kind = " ", "space"
        elif confusables and c in cp.CONFUSABLES:
            out, kind = cp.CONFUSABLES[c], "confusable"
        elif unicodedata.category(text[i]) == "Cf" and text[i] not in SPACE_CHARS:
            kept, out, kind = False, "", "other_cf"
        if kind:
            yield i, text[i], out, kind
        if kept and (kind or not cp.contains(_GLUE, c)):
            base = ord(out)
        i += 1


_ANY = re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in _joined([r for _, rs in cp.KINDS for r in rs] + [*cp.SPACES])) + "]")


def places_udf():
    """Place and character of whatever suspicious_total() counts, in order."""

    @F.pandas_udf("array<struct<pos:int,ch:string>>")
    def places(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [{"pos": m.start(), "ch": m[0]} for m in _ANY.finditer(t)] for t in texts], dtype=object)

    return places


def label(ch: str) -> str:
    return f"U+{ord(ch):04X} {unicodedata.name(ch, 'UNKNOWN')} ({unicodedata.category(ch)})"


def inspect(text: str, aggressive: bool = False, strip_glue: bool = False) -> list[tuple]:
    """Hits by code point and kind, the most frequent first. Bidirectional controls and spaces are always reported."""
    places: dict = {}
    for i, ch, _, kind in scan(text, confusables=aggressive, strip_glue=strip_glue, strip_bidi=True):
        places.setdefault((ord(ch), kind), []).append(i)
    order = sorted(places.items(), key=lambda hit: (-len(hit[1]), hit[0]))
    return [(c, label(chr(c)), len(at), kind, "informational" if kind == "space" else "probable", at[:10]) for (c, kind), at in order]


def clean(text: str, nfkc: bool = False, confusables: bool = False, spaces: bool = True, strip_glue: bool = False, strip_bidi: bool = False) -> tuple:
    """The cleaned text and what was done, in the order of CLEANED."""
    removed, replaced, parts, last = Counter(), Counter(), [], 0
    for i, ch, out, _ in scan(text, spaces=spaces, confusables=confusables, strip_glue=strip_glue, strip_bidi=strip_bidi):
        parts += [text[last:i], out]
        last = i + 1
        (replaced if out else removed)[label(ch)] += 1
    result = "".join([*parts, text[last:]])
    changed = False
    if nfkc and not unicodedata.is_normalized("NFKC", result):
        normal = unicodedata.normalize("NFKC", result)
        changed = True
        ops = SequenceMatcher(None, result, normal, autojunk=False).get_opcodes()
        replaced["NFKC_normalize"] += sum(b - a for op, a, b, _, _ in ops if op != "equal") or 1
        result = normal
    return result, len(text), len(result), dict(removed), dict(replaced), sum(removed.values()), sum(replaced.values()), changed


def inspect_udf(**options):
    @F.pandas_udf(HIT)
    def hits(texts: pd.Series) -> pd.Series:
        keys = ("codepoint", "label", "count", "kind", "confidence", "sample_offsets")
        return pd.Series([None if t is None else [dict(zip(keys, h)) for h in inspect(t, **options)] for t in texts], dtype=object)

    return hits


def clean_udf(**options):
    @F.pandas_udf(CLEANED)
    def cleaned(texts: pd.Series) -> pd.DataFrame:
        names = [c.split(" ")[0] for c in CLEANED.split(", ")]
        return pd.DataFrame([clean(t, **options) if t is not None else (None,) * 8 for t in texts], columns=names).astype({"text": object})

    return cleaned
