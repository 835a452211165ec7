"""Private-use characters: mapping tables, their layers, and their use in text. Rows: narrow, code, replacement."""

from __future__ import annotations

import unicodedata as ud

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.codes import cell_after, gaiji_name

SCHEMA = "narrow boolean, code long, replacement string"


def run(rows: DataFrame, *by: str) -> DataFrame:
    """Characters on consecutive cells. rows: ``by``, narrow, start, characters; the result: ``by``, narrow, code, replacement."""
    each = rows.select(*by, "narrow", "start", F.posexplode(F.split("characters", "")).alias("i", "replacement")).where("replacement <> ''")
    return each.select(*by, "narrow", cell_after(F.col("start").cast("long"), F.col("i")).alias("code"), "replacement")


@F.pandas_udf(StringType())
def composed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: ud.normalize("NFC", x), na_action="ignore")


def accents(rows: DataFrame, *by: str) -> DataFrame:
    """Letters with a combining mark, composed, on consecutive cells. rows: ``by``, narrow, start, letters, mark."""
    each = run(rows.withColumnRenamed("letters", "characters"), *by, "mark")
    return each.select(*by, "narrow", "code", composed(F.concat("replacement", "mark")).alias("replacement"))


def series(rows: DataFrame, *by: str) -> DataFrame:
    """Pairs of a hexadecimal code and a replacement, separated by white space. rows: ``by``, narrow, text."""
    parts = F.split(F.trim("text"), r"\s+")
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(parts) / 2).cast("int") - 1), lambda i: F.struct(F.get(parts, i * 2).alias("code"), F.get(parts, i * 2 + 1).alias("replacement")))
    each = rows.where(F.size(parts) >= 2).select(*by, "narrow", F.explode(pairs).alias("p"))
    return each.select(*by, "narrow", F.conv("p.code", 16, 10).cast("long").alias("code"), "p.replacement")


def both_widths(table: DataFrame) -> DataFrame:
    """Each row for narrow and wide codes."""
    return table.select(F.explode(F.array(F.lit(True), F.lit(False))).alias("narrow"), "code", "replacement")


def leaked(table: DataFrame, first: int) -> DataFrame:
    """The rows from a code on, under the other width as well."""
    return table.where(F.col("code") >= first).select((~F.col("narrow")).alias("narrow"), "code", "replacement")


def resolved(layers: DataFrame, by: tuple[str, ...] = ("narrow", "code")) -> DataFrame:
    """The replacement of the highest layer for each code; an empty one prints nothing and still counts."""
    return layers.groupBy(*by).agg(F.max_by("replacement", "layer").alias("replacement"), F.max("layer").alias("layer"))


def replaced(uses: DataFrame, table: DataFrame) -> DataFrame:
    """uses (narrow, code, ...) with ``shown``: the replacement, or a tag with the name where none is known.

    A mapping table is a few thousand rows: Spark broadcasts it below its threshold.
    """
    out = uses.join(table.select("narrow", "code", "replacement"), ["narrow", "code"], "left")
    tag = F.concat(F.lit("<gaiji="), gaiji_name(F.col("narrow"), F.col("code")), F.lit(">"))
    return out.withColumn("shown", F.coalesce("replacement", tag)).withColumn("known", F.col("replacement").isNotNull())


def unmapped(uses: DataFrame, table: DataFrame) -> DataFrame:
    """Codes in use without a replacement, with the number of uses."""
    return uses.groupBy("narrow", "code").agg(F.count(F.lit(1)).alias("uses")).join(table, ["narrow", "code"], "left_anti")


def ambiguous(table: DataFrame) -> DataFrame:
    """Rows whose replacement holds a symbol of ambiguous width, which terminals disagree on; letters are exempt."""
    chars = [chr(c) for c in range(0x10000) if ud.east_asian_width(chr(c)) == "A" and not ud.category(chr(c)).startswith(("L", "M", "C"))]
    spans, begin = [], 0
    for i in range(1, len(chars) + 1):
        if i == len(chars) or ord(chars[i]) != ord(chars[i - 1]) + 1:
            spans.append(f"\\x{{{ord(chars[begin]):X}}}-\\x{{{ord(chars[i - 1]):X}}}")
            begin = i
    return table.where(F.col("replacement").rlike("[" + "".join(spans) + "]"))


def latest(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The last row of each key: what a file says later replaces what it said before."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(order).desc()))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
