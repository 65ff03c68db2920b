"""The character chain in SQL, for checking analyzers against another engine.

The tables are written out here on their own, by what characters become.
"""

from __future__ import annotations

# What each of the characters on the right becomes.
BECOMES = {
    "|": "¦", "~": "˜", "0": "⁰₀", "1": "₁ⅰ", "2": "₂", "3": "₃", "4": "₄", "5": "₅", "6": "₆", "7": "₇", "8": "₈", "9": "₉",
    "a": "ªàáâãāăąάα", "b": "β♭", "c": "çćĉċčｃ", "d": "ðďđδ∂", "e": "èéêëēĕėęěȩεηẽｅ", "f": "ƒ", "g": "ĝğġģǧγгḡ", "h": "ĥ",
    "i": "ìíîïĩīĭįıιіｉ", "j": "ĵ", "k": "ķĸǩκк", "l": "ļľłλｌ", "m": "µμｍ", "n": "ñńņňν", "o": "ºòóôõōŏőơωо", "p": "πϖ",
    "r": "ŕŗřρ", "s": "śŝşšςσсṣｓ", "t": "ţťɛτ", "u": "ùúûũūŭůűųưυ", "x": "ξ", "y": "üýÿŷ", "z": "źżžζ", "æ": "äǣ", "ø": "ö",
    "aa": "å", "ss": "ß", "th": "þθ", "oe": "œ", "ph": "φϕ", "ch": "χ", "ps": "ψ", "ie": "є", "tm": "™",
}
# Signs that read as a blank and digits.
DIGITS = {" 1": "¹", " 2": "²", " 3": "³", " 4": "⁴", " 5": "⁵", " 6": "⁶", " 7": "⁷", " 8": "⁸", " 9": "⁹", "1 4": "¼", "1 2": "½"}
# Fixed values by code point: characters that become a blank.
BLANKS = [*map(ord, "+,-./;='"), 0xA0, 0xAC, 0xAD, 0xB1, 0xB7, 0xD7, 0x387, 0x2007, 0x2009, 0x2010, 0x2013, 0x2014, 0x2015, 0x2016, 0x2020, 0x2021, 0x2022, 0x2026, 0x2027, 0x2033, 0x2034,
          0x207B, 0x208A, 0x208B, 0x2102, 0x2192, 0x2193, 0x2194, 0x2212, 0x2217, 0x2219, 0x222B, 0x2237, 0x2248, 0x2264, 0x2265, 0x2282, 0x22C5, 0x2501, 0x3000, 0x3002, 0xFF0D]
# Fixed values by code point: characters that vanish.
DROPPED = [*map(ord, '!"():<>?[]_`{}'), 0x7F, 0x80, *range(0x81, 0x8B), 0x8C, 0x8D, 0x8E, 0x91, 0x92, 0x93, *range(0x96, 0x9B), 0x9C, 0x9D, 0x9E, 0x9F, 0xA1, 0xA8, 0xA9, 0xAB, 0xAE, 0xAF,
           0xB4, 0xB6, 0xB8, 0xBB, 0xBF, 0x1F9, 0x2B9, 0x2BA, 0x2BB, 0x2BE, 0x2BF, 0x2C6, 0x2C7, *range(0x2D8, 0x2DC), 0x2DD, 0x300, 0x301, 0x302, 0x303, 0x304, 0x305, 0x306, 0x307, 0x308, 0x309,
           0x30A, 0x30B, 0x30C, 0x310, 0x313, 0x315, 0x31C, 0x323, 0x324, 0x325, 0x326, 0x327, 0x328, 0x32E, 0x332, 0x333, 0x37E, 0x44A, 0x44C, 0x2018, 0x2019, 0x201C, 0x201D, 0x201E, 0x2032,
           0x20DE, 0x3001, 0x3009, 0x300A, 0x300B, 0x300C, 0x300D, 0xE000, 0xE001, 0xE002, 0xE00D, 0xE010, 0xFE20, 0xFE21, 0xFF02, 0xFF08, 0xFF09, 0xFF0C, 0xFF1A, 0xFF1B, 0xFF1F, 0xFFFD]
TOKENS = {"c++": "cplusplus", "c#": "csharp", "c* algebra": "cstaralgebra", "c*-algebra": "cstaralgebra", ".net": "dotnet"}
SPACES = r"[\s\x0B\x1C-\x1F\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}]+"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _chars(codes: list[int]) -> str:
    return "".join(map(chr, codes))


def _replaced(out: str, table: dict[str, str]) -> str:
    for new, olds in table.items():
        for old in olds:
            out = f"replace({out}, {_q(old)}, {_q(new)})"
    return out


def _bare(column: str) -> str:
    out = f"translate({column}, {_q(_chars(DROPPED))}, '')"
    return _replaced(f"translate({out}, {_q(_chars(BLANKS))}, {_q(' ' * len(BLANKS))})", DIGITS)


def plain(column: str) -> str:
    """Lower case without punctuation."""
    return _bare(f"lower({column})")


def fold(column: str, first: str = "{}") -> str:
    """The full chain."""
    out = first.format(f"lower({column})")
    for a, b in TOKENS.items():
        out = f"replace({out}, {_q(a)}, {_q(b)})"
    one = [(old, new) for new, olds in BECOMES.items() for old in olds if len(new) == 1]
    out = f"translate({out}, {_q(''.join(a for a, _ in one))}, {_q(''.join(b for _, b in one))})"
    return _bare(_replaced(out, {new: olds for new, olds in BECOMES.items() if len(new) > 1}))


def _split(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{SPACES}'), lambda t: t <> '')"


def tokens(column: str) -> str:
    return _split(plain(column))


def folded(column: str) -> str:
    return _split(fold(column))


def free_text(column: str) -> str:
    return _split(fold(column, "regexp_replace({}, ' (og|and|und) ', ' & ', 'g')"))
