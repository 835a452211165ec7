"""Query-word and key normalisation as column expressions.

Every rule is a character mapping over Unicode; the tables follow from the layout of the kana blocks and from
canonical decomposition. A style struct says which rules an index applies.
"""

from __future__ import annotations

import unicodedata as ud
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from .jis import CHARS, row

HIRAGANA = "".join(map(chr, range(0x3041, 0x3097)))
KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))
BOTH = HIRAGANA + KATAKANA
WIDE_SPACE = "　"
LONG = "ー"
#: Marks that the mark rule deletes, and ASCII whose full-width form isn't a fixed distance away.
MARKS = "・‐’−"
ASCII_EXCEPTIONS = {'"': "”", "'": "’", "-": "−", "`": "‘", "~": "〜", " ": WIDE_SPACE}
HALF_EXCEPTIONS = {"ﾞ": "゛", "ﾟ": "゜"}
#: Kana by the vowel that lengthens them.
VOWELS = {
    "あ": "ぁあかがさざただなはばぱまゃやらゎわゕ",
    "い": "ぃいきぎしじちぢにひびぴみりゐ",
    "う": "ぅうくぐすずっつづぬふぶぷむゅゆるゔ",
    "え": "ぇえけげせぜてでねへべぺめれゑゖ",
    "お": "ぉおこごそぞとどのほぼぽもょよろを",
    "ん": "ん",
}


def to_katakana(s: str) -> str:
    return s.translate({ord(h): k for h, k in zip(HIRAGANA, KATAKANA, strict=True)})


def in_both(pairs: dict[str, str]) -> dict[str, str]:
    """A mapping of hiragana, for katakana as well."""
    return pairs | {to_katakana(a): to_katakana(b) for a, b in pairs.items()}


def without_mark(mark: str) -> dict[str, str]:
    """Kana that decompose into a base and the combining mark, with the base."""
    return {c: d[0] for c in BOTH if len(d := ud.normalize("NFD", c)) == 2 and d[1] == mark}


ASCII_WIDE = {chr(c): chr(c + 0xFEE0) for c in range(0x21, 0x7F)} | ASCII_EXCEPTIONS
HALF_KANA = {chr(c): ud.normalize("NFKC", chr(c)) for c in range(0xFF61, 0xFFA0)} | HALF_EXCEPTIONS
UPPER_WIDE = {chr(c + 0x20): chr(c) for c in range(0xFF21, 0xFF3B)}
UPPER_LATIN = {chr(c): chr(c - 0x20) for c in [*range(0x61, 0x7B), *range(0xE0, 0xF7), *range(0xF8, 0xFF)]}
SOKUON = in_both({"っ": "つ"})
YOUON = in_both({"ゃ": "や", "ゅ": "ゆ", "ょ": "よ", "ゎ": "わ"} | dict(zip("ゕゖ", "かけ", strict=True)))
SMALL_VOWELS = in_both(dict(zip("ぁぃぅぇぉ", "あいうえお", strict=True)))
DAKUTEN = without_mark("゙") | in_both({"ゃ": "や", "ゅ": "ゆ", "ょ": "よ"})
HANDAKUTEN = without_mark("゚")
KATA_TO_HIRA = dict(zip(KATAKANA, HIRAGANA, strict=True))
HIRA_TO_KATA = dict(zip(HIRAGANA, KATAKANA, strict=True))
#: Each kana with the vowel that a long-vowel mark after it becomes.
LENGTHENS = {c: v for v, cs in VOWELS.items() for c in cs} | {to_katakana(c): to_katakana(v) for v, cs in VOWELS.items() for c in cs}

Rule = Callable[[Column], Column]


def mapped(table: dict[str, str]) -> Rule:
    return lambda s: F.translate(s, "".join(table), "".join(table.values()))


def deleted(chars: str) -> Rule:
    return lambda s: F.translate(s, chars, "")


def long_vowels(s: Column) -> Column:
    """A long-vowel mark becomes the vowel of the kana before it; runs repeat it; after others it stays."""
    for vowel in dict.fromkeys(LENGTHENS.values()):
        chars = "".join(c for c, v in LENGTHENS.items() if v == vowel)
        s = F.regexp_replace(s, f"(?<=[{chars}]{LONG}{{0,126}}){LONG}", vowel)
    return s


upper_wide, upper_latin, marks = mapped(UPPER_WIDE), mapped(UPPER_LATIN), deleted(MARKS)
sokuon, youon, small_vowels = mapped(SOKUON), mapped(YOUON), mapped(SMALL_VOWELS)
dakuten, handakuten = mapped(DAKUTEN), mapped(HANDAKUTEN)
to_hira, to_kata = mapped(KATA_TO_HIRA), mapped(HIRA_TO_KATA)
no_space, no_long_vowel = deleted(WIDE_SPACE), deleted(LONG)

#: What encodes as an ASCII character besides that character itself.
ASCII_TWINS = {"¥": "＼", "‾": "〜"}
TO_WIDE = ASCII_WIDE | HALF_KANA | ASCII_TWINS


def full_width(s: Column) -> Column:
    """ASCII and half-width katakana in full width, tabs as spaces, no space at either end.

    Null if nothing is left, if it is longer than 127 characters, or if JIS X 0208 lacks one of its characters.
    """
    wide = F.translate(F.translate(s, "\t", " "), "".join(TO_WIDE), "".join(TO_WIDE.values()))
    bare = F.regexp_replace(wide, f"^{WIDE_SPACE}+|{WIDE_SPACE}+$", "")
    return F.when((F.length(bare) > 0) & (F.length(bare) <= 127) & (F.translate(bare, CHARS, "") == ""), bare)


def latin(s: Column) -> Column:
    """Trimmed Latin-1 text; null if it holds other characters, is empty or longer than 255."""
    bare = F.regexp_replace(s, "^[ \t]+|[ \t]+$", "")
    return F.when((F.length(bare) > 0) & (F.length(bare) <= 255) & bare.rlike("^[\\x{00}-\\x{FF}]*$"), bare)


#: Row 3 of the character set holds digits and letters, rows 4 and 5 kana. Row 1 holds symbols, the long-vowel mark
#: among them, which decide nothing. None of them has a meaning of its own in a pattern.
ALPHA, KANA, NEUTRAL = f"[{row(3)}]", f"[{row(4)}{row(5)}]", f"[{row(1)}]"


def word_class(s: Column) -> Column:
    """alphabet, kana or other: symbols of row 1 count for nothing, and mixed or bare-symbol words are other."""
    alpha, kana = s.rlike(ALPHA), s.rlike(KANA)
    rest = F.length(F.regexp_replace(s, f"{ALPHA}|{KANA}|{NEUTRAL}", "")) > 0
    return F.when(kana & ~alpha & ~rest, "kana").when(alpha & ~kana & ~rest, "alphabet").otherwise("other")


#: The rules in their fixed order: style field, and what each of its values does.
PIPELINE: list[tuple[str, dict[int, Rule]]] = [
    ("space", {2: no_space}),
    ("katakana", {0: to_hira, 2: to_kata}),
    ("lower", {0: upper_wide}),
    ("mark", {2: marks}),
    ("long_vowel", {0: long_vowels, 2: no_long_vowel}),
    ("double_consonant", {0: sokuon}),
    ("contracted_sound", {0: youon}),
    ("small_vowel", {0: small_vowels}),
    ("voiced_consonant", {0: dakuten}),
    ("p_sound", {0: handakuten}),
]
CONVERT, ASIS, DELETE = 0, 1, 2
#: What kana indexes fold when their own flags don't apply, and what others do.
KANA_STYLE = {"space": DELETE, "katakana": CONVERT, "lower": CONVERT, "mark": DELETE, "long_vowel": CONVERT} | dict.fromkeys(
    ("double_consonant", "contracted_sound", "small_vowel", "voiced_consonant", "p_sound"), CONVERT
)
PLAIN_STYLE = dict.fromkeys(KANA_STYLE, ASIS) | {"space": DELETE, "lower": CONVERT, "mark": ASIS}


def canonical(s: Column, style: dict[str, int]) -> Column:
    """The pipeline for a style that is known beforehand."""
    for field, does in PIPELINE:
        if (rule := does.get(style[field])) is not None:
            s = rule(s)
    return s


def _chosen(x: Column, value: Column, does: dict[int, Rule]) -> Column:
    out = x
    for number, rule in does.items():
        out = F.when(value == number, rule(x)).otherwise(out)
    return out


def _named(s: Column, step: Rule) -> Column:
    """step(s), where s is computed once, however often the step uses it."""
    return F.element_at(F.transform(F.array(s), lambda x: step(x)), 1)


def canonical_by(s: Column, style: Column) -> Column:
    """The pipeline for a style struct that differs from row to row.

    Each step names what the step before gives, so that the expression grows with the number of rules, not with its powers.
    """
    for field, does in PIPELINE:
        step = partial(_chosen, value=style[field], does=does)
        s = _named(s, step)
    return s
