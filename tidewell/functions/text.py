"""Analyzers as column expressions: character rules, token rules, tokenisers and field types."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token rules, applied before characters are mapped.
TOKEN_RULES = (("c++", "cplusplus"), ("c#", "csharp"), ("c* algebra", "cstaralgebra"), ("c*-algebra", "cstaralgebra"), (".net", "dotnet"))
# Words of free text that read as an ampersand between blanks.
AND_WORDS = ("og", "and", "und")
# Letters and signs, and what each becomes.
CHARACTERS = (
    "¦:| ª:a µ:m º:o ß:ss à:a á:a â:a ã:a ä:æ å:aa ç:c è:e é:e ê:e ë:e ì:i í:i î:i ï:i ð:d ñ:n ò:o ó:o ô:o õ:o ö:ø ù:u ú:u û:u ü:y ý:y þ:th ÿ:y "
    "ā:a ă:a ą:a ć:c ĉ:c ċ:c č:c ď:d đ:d ē:e ĕ:e ė:e ę:e ě:e ĝ:g ğ:g ġ:g ģ:g ĥ:h ĩ:i ī:i ĭ:i į:i ı:i ĵ:j ķ:k ĸ:k ļ:l ľ:l ł:l ń:n ņ:n ň:n ō:o ŏ:o ő:o œ:oe "
    "ŕ:r ŗ:r ř:r ś:s ŝ:s ş:s š:s ţ:t ť:t ũ:u ū:u ŭ:u ů:u ű:u ų:u ŷ:y ź:z ż:z ž:z ƒ:f ơ:o ư:u ǣ:æ ǧ:g ǩ:k ȩ:e ɛ:t ˜:~ "
    "ά:a α:a β:b γ:g δ:d ε:e ζ:z η:e θ:th ι:i κ:k λ:l μ:m ν:n ξ:x π:p ρ:r ς:s σ:s τ:t υ:u φ:ph χ:ch ψ:ps ω:o ϕ:ph ϖ:p г:g к:k о:o с:s є:ie і:i "
    "ḡ:g ṣ:s ẽ:e ⁰:0 ₀:0 ₁:1 ₂:2 ₃:3 ₄:4 ₅:5 ₆:6 ₇:7 ₈:8 ₉:9 ™:tm ⅰ:1 ∂:d ♭:b ｃ:c ｅ:e ｉ:i ｌ:l ｍ:m ｓ:s"
)
# Characters that vanish.
VOID = (
    "_:()\"[]?ʹ!<̣̈ʻ̲}{̨́̄̌̇ˇʾ̀̊̆’ʺ»«′̃\x96”©¿̂`̧̦⃞“︠︡˘´¡\x93®̜̋̕"
    "\x9c̤¸̳¨\x91˙̮̉\x84\x80˚\x92¯\x7f（）《》˛¶ь\x97‘ʿ̥\x9a\x85\x82ъ、，̅\x9d\x86̐\x99\x8a\x9eˆ\x8c̓？\x8e\x87ǹ；＂\x88;"
    "\x9f：\x89˝「\x83\x81„\x98�〉」\x8d>"
)
# Characters that become a blank (the asterisk stays: it stands for truncation), and numbers after one.
BLANK = "-.,/';+= \xa0–†—\xad×·→−±。•…⋅⁻¬₋‡　₊·↔≈″‐∫∗↓－≥―━≤ ∷⊂∙‖‧‴ℂ"
NUMBERS = "³: 3;²: 2;¼:1 4;¹: 1;⁹: 9;⁴: 4;⁶: 6;½:1 2;⁸: 8;⁵: 5;⁷: 7"
#: White space that divides tokens.
SPACES = r"[\s\x0B\x1C-\x1F\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}]+"

_LETTERS = [tuple(x.split(":")) for x in CHARACTERS.split(" ")]
_ONE = [(a, b) for a, b in _LETTERS if len(b) == 1]
_MORE = [(a, b) for a, b in _LETTERS if len(b) > 1] + [tuple(x.split(":")) for x in NUMBERS.split(";")]


def _as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def token_rules(c: Column, rules=TOKEN_RULES) -> Column:
    return reduce(lambda x, rule: F.replace(x, F.lit(rule[0]), F.lit(rule[1])), rules, c)


def plain(c: Column | str) -> Column:
    """Characters dropped or made blank, letters as they are."""
    return _without_numbers(F.translate(_as_column(c), BLANK + VOID, " " * len(BLANK)), [r for r in _MORE if " " in r[1]])


def _without_numbers(c: Column, rules: list) -> Column:
    # Their characters are rare: texts without any aren't searched for each.
    replaced = reduce(lambda x, rule: F.replace(x, F.lit(rule[0]), F.lit(rule[1])), rules, c)
    return F.when(c.rlike("[" + "".join(a for a, _ in rules) + "]"), replaced).otherwise(c)


def transliterate(c: Column | str) -> Column:
    """Letters by their readings in plain ones, and other characters dropped or made blank.

    No rule's result holds another rule's character, so one pass for single results and one for each of the
    longer ones are as good as one for all.
    """
    narrow = F.translate(_as_column(c), "".join(a for a, _ in _ONE) + BLANK + VOID, "".join(b for _, b in _ONE) + " " * len(BLANK))
    return _without_numbers(narrow, _MORE)


def fold(c: Column | str) -> Column:
    """The full character chain: lower case, token rules, then characters."""
    return transliterate(token_rules(F.lower(_as_column(c))))


def split_blank(c: Column) -> Column:
    return F.filter(F.split(c, SPACES), lambda t: t != "")


def standard(c: Column | str) -> Column:
    """Lower case without punctuation; letters stay."""
    return split_blank(plain(F.lower(_as_column(c))))


def folded(c: Column | str) -> Column:
    """Tokens of the full chain."""
    return split_blank(fold(c))


def free_text(c: Column | str) -> Column:
    """The full chain, in which the words for `and` are an ampersand."""
    ampersand = F.regexp_replace(F.lower(_as_column(c)), " (?:" + "|".join(AND_WORDS) + ") ", " & ")
    return split_blank(transliterate(token_rules(ampersand)))


def keyword(c: Column | str) -> Column:
    """One token: underscores are blanks, and the standard tokens are joined by single blanks."""
    return F.array(F.array_join(standard(F.replace(_as_column(c), F.lit("_"), F.lit(" "))), " "))


def verbatim(c: Column | str) -> Column:
    return F.array(_as_column(c))


def lower_case(c: Column | str) -> Column:
    return F.filter(F.split(F.lower(_as_column(c)), " "), lambda t: t != "")


def letters_only(c: Column | str) -> Column:
    """Lower-cased runs of letters."""
    return F.filter(F.split(F.lower(_as_column(c)), r"\P{L}+"), lambda t: t != "")


def number(c: Column | str) -> Column:
    """An identifier without its separators; not a numeric value."""
    return F.array(F.translate(_as_column(c), "-_:/\\", ""))


def symbols_removed(c: Column | str) -> Column:
    """A sort key of letters only."""
    return F.regexp_replace(F.lower(_as_column(c)), r"[^\p{L}]", "")


def separated(values: Column | str, analyzer: Callable[[Column], Column] = standard) -> Column:
    """Tokens of a multi-valued field as (value, token): phrases can't cross values."""
    return F.flatten(F.transform(_as_column(values), lambda v, i: F.transform(analyzer(v), lambda t: F.struct(i.alias("value"), t.alias("token")))))


#: The field types and their analyzers.
ANALYZERS: dict[str, Callable] = {
    "default": standard,
    "freetext": free_text,
    "text": standard,
    "keyword": keyword,
    "storedkeyword": keyword,
    "verbatim": verbatim,
    "storedverbatim": verbatim,
    "lowercase": lower_case,
    "sortkey": lambda c: F.array(symbols_removed(c)),
    "number": number,
    "date": letters_only,
    "folded": folded,
    "stored": lambda c: F.array().cast("array<string>"),
}


def per_field(kinds: dict[str, str], default: str = "default") -> Callable[[str, Column], Column]:
    """An analyzer that chooses by field name."""
    return lambda field, c: ANALYZERS[kinds.get(field, default)](c)
