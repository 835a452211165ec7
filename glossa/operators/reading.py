"""The order in which dictionaries are consulted, and what kind each one is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.present import DEFAULT, fold_width, title_category


def headword_size(indexes: DataFrame) -> DataFrame:
    """subbook, size: pages of the headword indexes; backward ones don't count."""
    own = F.when(F.startswith(F.col("name"), F.lit("word_")), F.col("end_page") - F.col("start_page") + 1).otherwise(0)
    return indexes.groupBy("subbook").agg(F.sum(own).cast("long").alias("size"))


def content_category(headings: DataFrame, n: int = 8) -> DataFrame:
    """subbook, category: 英 where most of the first n headings are in the letters A to Z alone, null where half or fewer are.

    headings: subbook, ord, heading, of the as-is index; each task keeps n rows a subbook before the shuffle.
    """
    from .lookup import limited

    others = F.regexp_replace(fold_width(F.col("heading")), "[A-Za-z]", "")
    latin = ((F.length(others) < F.length("heading")) & ~others.rlike(r"\p{L}")).cast("int")
    first = limited(headings, ["subbook"], n)
    return first.groupBy("subbook").agg(F.when(F.avg(latin) > 0.5, "英").alias("category"))


def category(books: DataFrame, headings: DataFrame) -> DataFrame:
    """subbook, category: what the title says; where it says nothing, what the first headings are written in. books: subbook, title."""
    said = title_category(F.col("title"))
    silent = said == DEFAULT
    own = content_category(headings).withColumnRenamed("category", "own")
    return books.join(own, "subbook", "left").select("subbook", F.when(silent, F.coalesce("own", said)).otherwise(said).alias("category"))


def as_typed(books: DataFrame, typed: DataFrame) -> DataFrame:
    """The books that someone named, with ``place``: the order is theirs. typed: name, place, numbered as they were given."""
    return books.join(typed, "name")


def category_rank(category: Column) -> Column:
    return F.when(category == "英", 0).when(category == "国", 1).when(category == "百", 2).otherwise(3)


def ranked(books: DataFrame, order: DataFrame) -> DataFrame:
    """books (name, category, size) with ``rank`` of the order file (name, rank), those not listed last."""
    n = order.count()  # the lines of a file that people write
    return books.join(order, "name", "left").withColumn("rank", F.coalesce("rank", F.lit(n)))


def reading_order(books: DataFrame) -> list[Column]:
    """What to sort books by: order file, kind, then the larger headword index first."""
    return [F.col("rank"), category_rank(F.col("category")), F.col("size").desc(), F.col("name")]
