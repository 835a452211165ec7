"""Presentation of decoded text as column expressions."""

from __future__ import annotations

import re
import unicodedata as ud
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL = {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)} | {"　": " "}
OVERLINE = "̅"
#: Letters and digits of any script, and the marks that count as parts of a word.
IN_WORD = r"[\p{L}\p{Nd}\p{Nl}\p{No}'’\-−ー]"


def _class_of(fits: Callable[[str], object], top: int = 0x20000) -> list[tuple[int, int]]:
    """Ranges of the characters below ``top`` that fit, from the Unicode data."""
    out: list[tuple[int, int]] = []
    for c in range(top):
        if fits(chr(c)):
            if out and out[-1][1] == c - 1:
                out[-1] = (out[-1][0], c)
            else:
                out.append((c, c))
    return out


def _pattern(ranges: list[tuple[int, int]], most: int = 8) -> str:
    """A character class in which every group of ranges stands behind the range that spans it.

    A class is tried range by range, so that a character outside, a plain letter above all, is told by one comparison.
    """
    if len(ranges) <= most:
        return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"
    step = -(-len(ranges) // most)
    groups = [ranges[i : i + step] for i in range(0, len(ranges), step)]
    inner = "".join(f"[\\x{{{g[0][0]:X}}}-\\x{{{g[-1][1]:X}}}&&{_pattern(g, most)}]" for g in groups)
    return f"[\\x{{{ranges[0][0]:X}}}-\\x{{{ranges[-1][1]:X}}}&&[{inner}]]"


#: Characters that take two columns, wide and full-width; those that combine and take none; digits of all kinds.
WIDE = _pattern([*_class_of(lambda c: ud.east_asian_width(c) in "WF"), (0x20000, 0x3FFFD)])
COMBINING = _pattern(_class_of(ud.combining))
DIGIT = _pattern(_class_of(str.isdigit))


def fold_width(s: Column) -> Column:
    """Full-width ASCII and the wide space in half width; compatibility forms of other kinds stay."""
    return F.translate(s, "".join(FULL), "".join(FULL.values()))


def drop_media(s: Column) -> Column:
    """Sound and image markers with the blanks before them, and the whole line where one begins it."""
    return F.regexp_replace(s, r"(?m)^[ \t　]*<(?:sound|image)=[^:>]*:[^>]*>\n?|[ \t　]*<(?:sound|image)=[^:>]*:[^>]*>", "")


def pitch_accent(s: Column) -> Column:
    """Overlines for pitch: from ┏ to ┓; a ┓ alone marks the word before it. A character outside words ends a span."""

    def step(acc: Column, ch: Column) -> Column:
        opens, closes = ch == "┏", ch == "┓"
        ends_word = ~ch.rlike(IN_WORD)
        back = F.regexp_replace(acc["out"], rf"({IN_WORD})(?={IN_WORD}*$)", f"$1{OVERLINE}")
        out = (
            F.when(opens, acc["out"])
            .when(closes & ~acc["high"], back)
            .when(closes, acc["out"])
            .when(acc["high"] & ~ends_word, F.concat(acc["out"], ch, F.lit(OVERLINE)))
            .otherwise(F.concat(acc["out"], ch))
        )
        high = F.when(opens, True).when(closes | ends_word, False).otherwise(acc["high"])
        return F.struct(out.alias("out"), high.alias("high"))

    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("high"))
    marked = F.aggregate(F.split(s, ""), start, step, lambda acc: acc["out"])
    return F.when(s.rlike("[┏┓]"), marked).otherwise(s)


def readable(s: Column) -> Column:
    return pitch_accent(drop_media(fold_width(s)))


def display_width(s: Column) -> Column:
    """Columns on a terminal: characters of a combining class none, wide and full-width ones two."""
    bare = F.regexp_replace(s, COMBINING, "")
    return F.length(bare) + F.regexp_count(bare, F.lit(WIDE))


def _fitting(s: Column, columns: int) -> Column:
    """The beginning that fits: the characters whose running width stays within the columns.

    A wide character gets a second sign behind it, so that all that count are one column each and one pattern takes
    them; a wide one whose second sign is left behind doesn't fit.
    """
    head = lambda x: F.regexp_extract(x, f"^(?s:{COMBINING}*+.){{0,{columns}}}+{COMBINING}*+", 0)
    wide = f"((?!{COMBINING}){WIDE})"
    # No character that counts takes less than a column, so that the rest of a long text isn't looked at.
    fits = F.regexp_replace(head(F.regexp_replace(head(s), wide, "$1\x00")), wide + r"\z", "")
    return F.regexp_replace(fits, wide + r"\x00", "$1")


def truncate(s: Column, columns: int) -> Column:
    """The longest beginning that fits; a wide character is never split."""
    if columns <= 0:
        return F.lit("")
    # Characters are two columns at most, so that short texts need no count.
    return F.when(F.length(s) * 2 <= columns, s).otherwise(_fitting(s, columns))


def pad(s: Column, columns: int) -> Column:
    """Truncated, then filled with spaces to the number of columns."""
    filled = lambda cut: F.concat(cut, F.repeat(F.lit(" "), F.greatest(F.lit(columns) - display_width(cut), F.lit(0))))
    # In an array, so that it is cut once for both its uses.
    return F.element_at(F.transform(F.array(truncate(s, columns)), filled), 1)


def hit_line(rank: Column, heading: Column, page: Column, offset: Column) -> Column:
    flat = F.regexp_replace(F.trim(F.regexp_replace(heading, "\n", " ")), "^$", "")
    return F.format_string("%3d. %s    [%d:%d]", rank.cast("int"), flat, page.cast("long"), offset.cast("int"))


def parsed_position(s: Column) -> Column:
    """struct(page, offset), of nulls where the text isn't two whole numbers round a colon."""
    parts = F.split(s, ":", 2)
    page, offset = F.get(parts, F.lit(0)).try_cast("long"), F.get(parts, F.lit(1)).try_cast("long")
    ok = page.isNotNull() & offset.isNotNull()
    return F.struct(F.when(ok, page).alias("page"), F.when(ok, offset).alias("offset"))


#: What a title says of a dictionary's kind, the first match counting.
CATEGORIES = {"百": ["百科", "ペディア", "ブリタニカ", "encyclop"], "英": ["英和", "和英", "英英", "英語", "thesaurus", "dictionary", "roget"]}


#: What a title that says nothing stands for.
DEFAULT = "国"


def title_category(title: Column) -> Column:
    folded = F.translate(fold_width(title), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = F.lit(DEFAULT)
    for category, words in reversed(CATEGORIES.items()):
        out = F.when(folded.rlike("|".join(map(re.escape, words))), category).otherwise(out)
    return out


SUBSCRIPTS = str.maketrans("0123456789", "₀₁₂₃₄₅₆₇₈₉")


def subscript(s: Column) -> Column:
    """Digits as subscript digits, those that have none as they are; other text in parentheses; nothing for nothing."""
    digits = F.translate(s, "0123456789", "0123456789".translate(SUBSCRIPTS))
    return F.when(s == "", "").when(s.rlike(f"^{DIGIT}+$"), digits).otherwise(F.concat(F.lit("("), s, F.lit(")")))


def wrap_lines(s: Column, columns: int) -> Column:
    """Lines of at most so many columns, greedily: words that aren't wide stay whole unless longer than a line.

    Blank lines stay, and a space that still fits at a line's end is kept.
    """
    pieces = F.regexp_extract_all(s, F.lit(rf"\n|{WIDE}|(?:(?!{WIDE})[^\s])+|[^\S\n]"), F.lit(0))

    # Widths are taken once, of pieces, and a line's is carried.
    sized = F.transform(pieces, lambda piece: F.struct(piece.alias("piece"), display_width(piece).alias("width")))

    def step(acc: Column, x: Column) -> Column:
        piece, width = x["piece"], x["width"]
        line, lines = acc["line"], acc["lines"]
        fits = width <= F.lit(columns) - acc["used"]
        blank = piece.rlike(r"^\s$") & (piece != "\n")
        # A piece longer than a line is cut at every full line; characters that aren't wide take one column.
        cut = F.regexp_extract_all(piece, F.lit(f".{{1,{columns}}}"), F.lit(0))
        long = width > F.lit(columns)
        new_lines = (
            F.when(piece == "\n", F.concat(lines, F.array(line)))
            .when(fits, lines)
            .when(blank, F.concat(lines, F.array(line)))
            .when(long & (line == ""), F.concat(lines, F.slice(cut, 1, F.size(cut) - 1)))
            .when(long, F.concat(lines, F.array(line), F.slice(cut, 1, F.size(cut) - 1)))
            .otherwise(F.concat(lines, F.array(line)))
        )
        new_line = F.when(piece == "\n", "").when(fits, F.concat(line, piece)).when(blank, "").when(long, F.element_at(cut, -1)).otherwise(piece)
        used = F.when(piece == "\n", 0).when(fits, acc["used"] + width).when(blank, 0).when(long, display_width(F.element_at(cut, -1))).otherwise(width)
        return F.struct(new_lines.alias("lines"), new_line.alias("line"), used.alias("used"))

    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"), F.lit(0).alias("used"))
    return F.aggregate(sized, start, step, lambda acc: F.concat(acc["lines"], F.array(acc["line"])))
