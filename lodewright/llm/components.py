"""Connected components of a link table, by contraction in the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewright.storage import materialize


def stars(parents: DataFrame) -> DataFrame:
    """Follow parents (v, p) until every p is its own parent; paths halve each turn."""
    while True:
        above = parents.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        jumped = materialize(parents.join(above, "p", "left").select("v", F.coalesce("pp", "p").alias("to"), "p"), "jumped")
        parents = jumped.select("v", F.col("to").alias("p"))
        if jumped.filter("to <> p").isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """v, label for every vertex of ``links`` (a, b): the smallest vertex of its component.

    Each turn points every vertex to its smallest neighbour (a partial minimum before the
    shuffle, however many neighbours there are), follows the pointers to their ends, and
    goes on with the links that remain between the ends.
    """
    edges = materialize(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = stars(materialize(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("p")), "parents"))
        if labels is None:
            labels = parents.select("v", F.col("p").alias("label"))
        else:
            moved = parents.select(F.col("v").alias("label"), "p")
            labels = materialize(labels.join(moved, "label", "left").select("v", F.coalesce("p", "label").alias("label")), "labels")
        ends = edges.join(parents.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a").join(parents.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
        edges = materialize(ends.filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
        if edges.isEmpty():
            return labels
