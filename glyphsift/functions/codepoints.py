"""Code-point classes as sorted ranges, and the regular-expression classes made from them."""

from __future__ import annotations

from bisect import bisect_right

Ranges = tuple[tuple[int, int], ...]


def ranges(spec: str) -> Ranges:
    """'00AD 200B-200F' as inclusive ranges."""
    out = []
    for part in spec.split():
        lo, _, hi = part.partition("-")
        out.append((int(lo, 16), int(hi or lo, 16)))
    return tuple(sorted(out))


def contains(rs: Ranges, cp: int) -> bool:
    i = bisect_right(rs, (cp, 0x110000)) - 1
    return i >= 0 and rs[i][0] <= cp <= rs[i][1]


def regex_class(*groups: Ranges) -> str:
    """A character class that Java and RE2 both read."""
    return "[" + "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for rs in groups for a, b in rs) + "]"


TAG_CHARS = ranges("E0001-E007F")
NONCHARACTER = tuple(sorted((*ranges("FDD0-FDEF"), *((p << 16 | 0xFFFE, p << 16 | 0xFFFF) for p in range(17)))))
RESERVED = ranges("2065 E0000 FFF0-FFF8 E0080-E00FF E01F0-E0FFF")
VS_SUPPLEMENT = ranges("E0100-E01EF")
MONGOLIAN_FVS = ranges("180B-180D 180F")
VARIATION = tuple(sorted((*VS_SUPPLEMENT, *ranges("FE00-FE0F"), *MONGOLIAN_FVS)))
BIDI = ranges("061C 200E-200F 202A-202E 2066-2069")
PRESERVABLE_BIDI = ranges("061C 200E-200F 2066-2069")
ZERO_WIDTH = ranges("180E 200B-200D 2060 FEFF")
PRIVATE_USE = ranges("E000-F8FF F0000-FFFFD 100000-10FFFD")
OTHER_STRIP = ranges("00AD 034F 115F-1160 17B4-17B5 2061-2064 206A-206F 3164 FFA0 FFF9-FFFB")
SPACES = ranges("00A0 1680 2000-200A 202F 205F 3000")
KHMER_VOWELS = ranges("17B4-17B5")
HANGUL_FILLERS = ranges("115F-1160 3164 FFA0")
ORTHOGRAPHIC_CF = ranges("0600-0605 06DD 070F 08E2 110BD 110CD")
EMOJI_BASE = ranges("0023 002A 0030-0039 00A9 00AE 2122 2190-27BF 2B00-2BFF 3030 303D 3297 3299 1F000-1FAFF")
CJK = ranges("3400-4DBF 4E00-9FFF F900-FAFF 20000-323AF")
MONGOLIAN_BASE = ranges("1800-18AF")
KHMER_BLOCK = ranges("1780-17FF")
HANGUL_JAMO = ranges("1100-11FF 3131-318E A960-A97C D7B0-D7C6 FFA1-FFDC")
JOINING = (ranges("0600-08FF"), ranges("0900-0DFF"), ranges("0F00-109F"), ranges("1780-17FF"), ranges("1800-18AF"))
LAYOUT = ((ranges("13430-1343F"), ranges("13000-143FF")), (ranges("1BCA0-1BCA3"), ranges("1BC00-1BCA3")), (ranges("1D173-1D17A"), ranges("1D100-1D1FF")))

#: Kinds of stripped code points; a code point has the first kind that it fits.
KINDS: tuple[tuple[str, Ranges], ...] = (
    ("tag_chars", TAG_CHARS),
    ("noncharacter", NONCHARACTER),
    ("reserved_ignorable", RESERVED),
    ("variation_selector", VARIATION),
    ("bidi", BIDI),
    ("zwj_family", ZERO_WIDTH),
    ("private_use", PRIVATE_USE),
    ("strip", OTHER_STRIP),
)
STRIPPED = tuple(sorted(r for _, rs in KINDS for r in rs))

_CYRILLIC = dict(zip(map(ord, "АВЕКМНОРСТХаеорсухі"), "ABEKMHOPCTXaeopcyxi"))  # look-alikes, Cyrillic on the left
_WIDE = {base + i: chr(ascii_ + i) for base, ascii_ in ((0xFF21, 65), (0xFF41, 97)) for i in range(26)}
CONFUSABLES: dict[int, str] = _CYRILLIC | _WIDE


def strip_kind(cp: int) -> str | None:
    """The kind of a code point that cleaning strips where nothing speaks for it; None for others."""
    for kind, rs in KINDS:
        if contains(rs, cp):
            return kind
    return None
