"""References between entries and menu trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import written


def references(pages: DataFrame, page_id: str = "page_id", body: str = "html") -> DataFrame:
    """page_id, nth, target: the links of each page in their order."""
    found = F.regexp_extract_all(F.coalesce(F.col(body), F.lit("")), F.lit('href="([^"]*)"'), F.lit(1))
    return pages.select(page_id, F.posexplode(found).alias("nth", "target"))


def followed(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """refs joined to the entries that they name; targets: target, location."""
    return refs.join(targets, "target")


def followed_first(refs: DataFrame, uses: DataFrame) -> DataFrame:
    """refs joined to the first location that uses their target. uses: target, location, any number of rows for a target.

    Only what some reference names is grouped: the uses meet the distinct targets before they are counted out.
    """
    asked = written(refs.select("target").distinct(), "targets")
    first = uses.join(asked, "target", "left_semi").groupBy("target").agg(F.min("location").alias("location"))
    return followed(refs, first)


def reachable(edges: DataFrame, starts: DataFrame, most_steps: int | None = None) -> DataFrame:
    """start, node, depth: all nodes that can be reached from each start, itself at depth 0, with the fewest steps. edges: source, target; starts: node.

    Each round follows the nodes found by the last one and keeps those that their start hasn't met, so links may run in circles. Rounds
    are written, and a pair of start and node is met once; the walk ends when a round finds nothing, or after ``most_steps``.
    """
    links = written(edges.select(F.col("source").alias("at"), F.col("target").alias("to")).where("at IS NOT NULL AND to IS NOT NULL").distinct(), "links")
    found = frontier = written(starts.select(F.col("node").alias("start"), "node").where("node IS NOT NULL").distinct().withColumn("depth", F.lit(0)), "reached")
    depth = 0
    while depth != most_steps and not frontier.isEmpty():
        depth += 1
        ahead = frontier.join(links, F.col("node") == F.col("at")).select("start", F.col("to").alias("node")).distinct()
        new = ahead.join(found.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(depth))
        frontier = written(new, "reached")
        found = found.unionByName(frontier)
    return found


def menu_tree(edges: DataFrame, roots: DataFrame, deepest: int = 100) -> DataFrame:
    """node, label, level, path of a tree walked from its roots. edges: parent, node, label; roots: node, label.

    A level is one join of the frontier with the edges, written before the next, so that rows have no limit.
    More than ``deepest`` levels below the roots, as in a cycle, are an error.
    """
    steps = edges.select(F.col("parent").alias("up"), F.col("node").alias("to"), F.col("label").alias("name"))
    frontier = written(roots.select("node", "label", F.lit(0).alias("level"), F.col("label").alias("path")), "menu")
    found = frontier
    while not frontier.isEmpty():
        below = frontier.join(steps, F.col("node") == F.col("up"))
        below = below.select(F.col("to").alias("node"), F.col("name").alias("label"), (F.col("level") + 1).alias("level"), F.concat("path", F.lit(" > "), "name").alias("path"))
        frontier = written(below, "menu")
        deepest -= 1
        if deepest < 0 and not frontier.isEmpty():
            raise ValueError("the menu is deeper than allowed, or has a cycle")
        found = found.unionByName(frontier)
    return found


def without_target(candidates: DataFrame) -> DataFrame:
    """Menu lines whose target is null: labels and leaf words."""
    return candidates.where(F.col("target").isNull())
