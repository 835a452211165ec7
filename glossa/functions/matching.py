"""Match predicates between index keys and query words, and the wildcard syntax."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import to_kata


def prefix(key: Column, word: Column) -> Column:
    return F.startswith(key, word)


def exact(key: Column, word: Column) -> Column:
    """Equal but for NULs that fill the key."""
    return F.regexp_replace(key, "\\x{00}+$", "") == word


def exact_latin(key: Column, word: Column) -> Column:
    return F.rtrim(key) == word


def kana_prefix(key: Column, word: Column) -> Column:
    """Prefix where hiragana and katakana of one cell are equal."""
    return F.startswith(to_kata(key), to_kata(word))


def kana_exact(key: Column, word: Column) -> Column:
    return exact(to_kata(key), to_kata(word))


def selected(kind: Column, latin_book: Column, kana_index: Column, key: Column, word: Column) -> Column:
    """The predicate of a row: Latin books compare bytes, kana indexes fold, and members of a group always fold."""
    return F.when(latin_book, prefix(key, word)).when(kana_index | (kind == "member"), kana_prefix(key, word)).otherwise(prefix(key, word))


def parsed_pattern(text: Column) -> Column:
    """struct(word, backward, error): a leading star asks for suffixes, a trailing one changes nothing."""
    bare = F.regexp_replace(text, "^[ \t　]+|[ \t　]+$", "")
    lead, trail = F.startswith(bare, F.lit("*")), F.endswith(bare, F.lit("*"))
    only_stars = bare.rlike(r"^\*{1,2}$")
    both = lead & trail & ~only_stars
    word = F.when(only_stars, "").otherwise(F.trim(F.regexp_replace(bare, r"^\*|\*$", "")))
    return F.struct(
        F.when(~both, word).alias("word"),
        F.when(~both, lead).alias("backward"),
        F.when(both, F.lit("stars at both ends")).alias("error"),
    )
