"""Property graphs as two DataFrames: nodes (id, label, props) and edges (source, target, label)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewright.storage import materialize


def node_id(label: str, value: Column) -> Column:
    """Label:id; an id that has a colon already stays."""
    v = value.cast("string")
    return F.when(F.instr(v, ":") > 0, v).otherwise(F.concat(F.lit(f"{label}:"), v))


def label_of(field: str) -> str:
    """patient_id names a Patient; nothing names a Node."""
    name = field.removesuffix("_id").removesuffix("key")
    return "".join(p.capitalize() for p in name.split("_")) or "Node"


@dataclass
class Graph:
    """``links`` may hold the edges as they were read, some of them more than once: walks need no distinct ones."""

    nodes: DataFrame
    edges: DataFrame
    links: DataFrame | None = None

    def _walked(self) -> DataFrame:
        return self.edges if self.links is None else self.links

    def neighbors(self, node: str) -> DataFrame:
        """id of every node one edge away, either way, sorted."""
        out = self._walked().filter(F.col("source") == node).select(F.col("target").alias("id"))
        back = self._walked().filter(F.col("target") == node).select(F.col("source").alias("id"))
        return out.unionByName(back).distinct().orderBy("id")

    def path(self, start: str, end: str, depth: int) -> list[str]:
        """A shortest path of at most ``depth`` edges, either way; empty without one. Frontiers stay in the cluster."""
        if not self.nodes.filter(F.col("id") == start).limit(1).count():
            return []
        edges = self._walked()
        both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
        reached = self.nodes.filter(F.col("id") == start).select("id", F.array("id").alias("path")).limit(1)
        frontier = reached
        for step in range(depth + 1):
            if hit := frontier.filter(F.col("id") == end).orderBy("path").first():
                return hit["path"]
            if step == depth:
                break
            ahead = frontier.join(both, frontier["id"] == both["source"]).groupBy("target").agg(F.min("path").alias("path"))
            fresh = ahead.join(reached, ahead["target"] == reached["id"], "left_anti").select(F.col("target").alias("id"), F.concat("path", F.array("target")).alias("path"))
            frontier = materialize(fresh, "frontier")
            if frontier.isEmpty():
                return []
            reached = reached.unionByName(frontier)
        return []

    def traverse(self, start: str, label: str | None, depth: int) -> DataFrame:
        """id, depth of nodes reached along edges of a label; the start itself at depth 0 only if no step is taken."""
        edges = self._walked().filter(F.col("label") == label) if label else self._walked()
        if depth == 0:
            return self.nodes.filter(F.col("id") == start).select("id", F.lit(0).alias("depth")).limit(1)
        frontier, reached = None, None
        for d in range(1, depth + 1):
            step = edges.filter(F.col("source") == start) if frontier is None else edges.join(frontier, edges["source"] == frontier["id"])
            fresh = step.select(F.col("target").alias("id")).distinct()
            fresh = fresh.join(reached, "id", "left_anti") if reached is not None else fresh
            frontier = materialize(fresh.withColumn("depth", F.lit(d)), "frontier")
            reached = frontier if reached is None else reached.unionByName(frontier)
            if frontier.isEmpty():
                break
        return reached

    def verify(self, other: Graph) -> DataFrame:
        """what, row of every node or edge that one graph has and the other lacks."""
        found = None
        for what, a, b in (("node", self.nodes.select("id"), other.nodes.select("id")), ("edge", self.edges, other.edges)):
            shown = lambda df: df.select(F.to_json(F.struct("*")).alias("row"))
            for side, x, y in (("missing", a, b), ("extra", b, a)):
                rows = shown(x).exceptAll(shown(y)).select(F.lit(f"{side} {what}").alias("what"), "row")
                found = rows if found is None else found.unionByName(rows)
        return found


def build(nodes: list[tuple[DataFrame, str, str]], edges: list[tuple[DataFrame, str, str, str, str, str]]) -> Graph:
    """nodes: (rows, id column, label); edges: (rows, source column, source label, target column, target label, edge label). Ends without a node get one."""
    made, ends, linked = None, None, None
    for rows, ident, label in nodes:
        part = rows.select(ident).distinct().select(node_id(label, F.col(ident)).alias("id"), F.lit(label).alias("label"))
        made = part if made is None else made.unionByName(part)
    for rows, source, source_label, target, target_label, label in edges:
        kept = rows.filter(F.col(source).isNotNull() & F.col(target).isNotNull())
        part = kept.select(node_id(source_label, F.col(source)).alias("source"), node_id(target_label, F.col(target)).alias("target"), F.lit(label).alias("label"))
        linked = part if linked is None else linked.unionByName(part)
        for column, of in ((source, source_label), (target, target_label)):  # one id of the rows' own type, before it becomes text
            end = kept.select(column).distinct().select(node_id(of, F.col(column)).alias("id")).select("id", F.substring_index("id", ":", 1).alias("label"))
            ends = end if ends is None else ends.unionByName(end)
    return Graph((made.unionByName(ends) if made is not None else ends).distinct(), linked.distinct(), linked)
