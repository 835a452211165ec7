"""Connected components of a table of links by repeated minimum labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable. links: a, b (longs, a <> b), in either direction, repeated or not.

    Each round a node takes the smallest label of its neighbours and then that label's own label; rounds are
    written to the shared folder and go on until no label changes. Minima are taken in each task before the
    shuffle, so a node with very many links is no burden.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("of")).agg(F.min("label").alias("near"))
        low = labels.join(near, labels["node"] == near["of"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("low"))
        up = labels.select(F.col("node").alias("at"), F.col("label").alias("up"))
        new = written(low.join(up, F.col("low") == F.col("at")).select("node", "old", F.least("low", "up").alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            return labels


def merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """parts (node, label) after links (a, b) between their nodes; components meet by their labels alone."""
    at = lambda side, name: parts.select(F.col("node").alias(side), F.col("label").alias(name))
    edges = links.join(at("a", "x"), "a").join(at("b", "y"), "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    edges = written(edges, "edges")
    if edges.isEmpty():
        return parts
    up = connected_components(edges).select(F.col("node").alias("label"), F.col("label").alias("up"))
    return written(parts.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label")), "parts")
