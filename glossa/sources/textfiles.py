"""Line files: mapping tables of private characters, appendices and order files. Rows: path, line_no, line."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lines_of(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The numbered lines of small files, each read whole."""
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", "\r?\n", -1)).alias("line_no", "line"))


#: The character sets of appendices, in the order in which they are tried.
CHARSETS = ("iso2022_jp", "euc_jp", "utf-8")


def decoded_lines(spark: SparkSession, paths: str | list[str], charsets: tuple[str, ...] = CHARSETS) -> DataFrame:
    """The numbered lines of small files, in the first of the character sets that their bytes are valid in; none valid is an error."""

    @F.pandas_udf("string")
    def decoded(content: pd.Series) -> pd.Series:
        def one(data: bytes) -> str:
            for name in charsets:
                try:
                    return data.decode(name)
                except UnicodeDecodeError:
                    continue
            raise ValueError(f"none of {', '.join(charsets)}")

        return content.map(one)

    files = spark.read.format("binaryFile").load(paths).select("path", decoded("content").alias("value"))
    return files.select("path", F.posexplode(F.split("value", "\r\n?|\n", -1)).alias("line_no", "line"))


def appendix_of(subbooks: DataFrame, listing: DataFrame) -> DataFrame:
    """subbook, path, found, error: each subbook's own appendix file. subbooks: subbook, book, directory, where (a directory or a
    file, null for the directory ``appendix`` beside the book); listing: directory, name, of files.

    A file is its own answer. In a directory the file is named like the subbook's directory and stands in it, else in the directory
    there that is named like the book, else in any directory there; of those several are an error, as one can't choose. No case counts.
    """
    beside = F.concat(F.regexp_replace("book", "/[^/]*/?$", ""), F.lit("/appendix"))
    asked = subbooks.select("subbook", "directory", F.lower(F.regexp_extract("book", "([^/]*)/?$", 1)).alias("paired"), F.regexp_replace(F.coalesce("where", beside), "/+$", "").alias("where"))
    files = listing.select(F.lower("name").alias("file"), F.col("directory").alias("home"), F.concat_ws("/", "directory", "name").alias("path"))
    named = asked.join(files.where("file LIKE '%.app'"), F.col("file") == F.concat(F.lower("directory"), F.lit(".app")))
    inside = F.when(F.col("home") == F.col("where"), "").when(F.startswith("home", F.concat("where", F.lit("/"))), F.expr("lower(substring(home, length(`where`) + 2))"))
    near = F.when(F.col("inside") == "", 1).when(F.col("inside") == F.col("paired"), 2).when(~F.contains("inside", F.lit("/")), 3)
    ranked = named.withColumn("inside", inside).select("subbook", near.alias("near"), "path").where("near IS NOT NULL")
    itself = asked.join(files, F.col("where") == F.col("path")).select("subbook", F.lit(0).alias("near"), "path")
    each = ranked.unionByName(itself).groupBy("subbook", "near").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n"))
    best = each.groupBy("subbook").agg(F.min(F.struct("near", "path", "n")).alias("x"))
    one = (F.col("x.near") < 3) | (F.col("x.n") == 1)
    error = F.when(F.col("x").isNull(), "no appendix").when(~one, "several appendices")
    return asked.select("subbook").join(best, "subbook", "left").select("subbook", F.when(one, F.col("x.path")).alias("path"), F.coalesce("x.n", F.lit(0)).alias("found"), error.alias("error"))


def gaiji_map(lines: DataFrame) -> DataFrame:
    """path, line_no, narrow, code, replacement, error: h or z, four hexadecimal digits, white space, the replacement.

    Nothing after the code means an empty replacement; blank lines and those that begin with # are skipped. What
    follows the code is the replacement to its end, a # in it too.
    """
    rows = lines.where(~F.trim("line").rlike("^(#|$)"))
    pattern = r"^\s*([hz])([0-9A-Fa-f]{4})(?:\s+(.*?))?\s*$"
    ok = F.col("line").rlike(pattern)
    take = lambda i: F.regexp_extract("line", pattern, i)
    return rows.select(
        "path",
        "line_no",
        F.when(ok, take(1) == "h").alias("narrow"),
        F.when(ok, F.conv(take(2), 16, 10).cast("long")).alias("code"),
        F.when(ok, take(3)).alias("replacement"),
        F.when(~ok, F.concat(F.lit("line "), (F.col("line_no") + 1).cast("string"))).alias("error"),
    )


def order_file(lines: DataFrame) -> DataFrame:
    """name, rank: a path's last part on each line, without comments."""
    bare = F.trim(F.regexp_replace("line", "#.*$", ""))
    name = F.regexp_extract(F.regexp_replace(bare, "/+$", ""), "([^/]*)$", 1)
    rows = lines.select("path", "line_no", name.alias("name")).where("name <> ''")
    return rows.select("name", (F.row_number().over(Window.partitionBy("path").orderBy("line_no")) - 1).cast("long").alias("rank"))


DIRECTIVE = r"^\s*(begin\s+(?:narrow|wide)|end|character-code|stop-code|range-start|range-end|0[xX][0-9A-Fa-f]+)(?:\s+(.*?))?\s*$"


def appendix(lines: DataFrame) -> DataFrame:
    """path, line_no, kind, narrow, code, argument, text, error of appendix files.

    kind: stop, char, charset, or error; the block of a character is the last one begun and not ended above it.
    """
    rows = lines.where(~F.col("line").rlike(r"^#|^\s*$"))
    word, rest = F.regexp_extract("line", DIRECTIVE, 1), F.coalesce(F.regexp_extract("line", DIRECTIVE, 2), F.lit(""))
    rows = rows.withColumns({"word": F.regexp_replace(F.lower(word), r"\s+", " "), "rest": rest})
    block = F.when(F.col("word") == "begin narrow", "narrow").when(F.col("word") == "begin wide", "wide").when(F.col("word") == "end", "")
    above = F.last(block, True).over(Window.partitionBy("path").orderBy("line_no"))
    rows = rows.withColumn("block", F.coalesce(above, F.lit("")))
    stop = r"^(0[xX][0-9A-Fa-f]+|[0-9]+)\s+(0[xX][0-9A-Fa-f]+|[0-9]+)$"
    number = lambda s: F.when(F.lower(s).rlike("^0x"), F.conv(F.substring(s, 3, 16), 16, 10)).otherwise(s).cast("long")
    is_char, is_stop = F.col("word").rlike("^0x"), F.col("word") == "stop-code"
    good_stop = is_stop & F.col("rest").rlike(stop)
    good_char = is_char & (F.col("block") != "")
    error = F.when(F.col("word") == "", "unknown directive").when(is_char & ~good_char, "character outside a block").when(is_stop & ~good_stop, "bad stop code")
    return rows.select(
        "path",
        "line_no",
        F.when(error.isNotNull(), "error").when(is_stop, "stop").when(is_char, "char").when(F.col("word") == "character-code", "charset").alias("kind"),
        F.when(good_char, F.col("block") == "narrow").alias("narrow"),
        F.when(good_stop, number(F.regexp_extract("rest", stop, 1))).when(good_char, F.conv(F.substring("word", 3, 16), 16, 10).cast("long")).alias("code"),
        F.when(good_stop, number(F.regexp_extract("rest", stop, 2))).alias("argument"),
        F.when(good_char | (F.col("word") == "character-code"), F.col("rest")).alias("text"),
        error.alias("error"),
    ).where("kind IS NOT NULL")
