"""Approximate nearest neighbours by inner product: a robust-pruned directed graph in each shard.

Equal vectors make one node that knows its smallest ids. Nodes are dealt to shards of
bounded size; each shard's vectors get one more component, so that largest inner product
becomes smallest distance. A graph is built in batches: a greedy beam search from the
medoid over the graph so far proposes neighbours, pruning keeps a proposal unless one
already kept is nearer to it by the factor ``alpha``, and the links back are pruned alike.
A query is searched in every shard with a beam; the nodes found are scored in double
precision on the original vectors and the shards' best are merged.

Graphs work on single-precision copies of vectors, scaled by their shard's longest, so
that no finite vector overflows there. Queries come in blocks of bounded size, and equal
query vectors are searched once. The index is a written table (a row for each node), so
it can be kept and searched again.

Defined cases: vectors that are null, zero, of another length than most (or than ``dim``,
if that is given) or that hold null or non-finite components take no part; rows without
an id take none; repeated rows count once, rows of one id with different vectors are
candidates each, none of them for a query of that id, whose own vectors are asked each;
equal vectors score alike and ties go to the smaller id; fewer candidates than ``k`` are
all returned; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodewright.llm.fingerprint import small_or_shuffled
from lodewright.storage import materialize

#: Nodes of a shard at most (a node takes about a kilobyte at 64 dimensions) and, where there are cores for more shards, at least; queries of a block.
SHARD_NODES, LEAST_NODES = 262_144, 8_192
BLOCK_QUERIES = 65_536
DEGREE, BUILD_BEAM, ALPHA, BEAM, PROPOSALS, BATCH = 32, 48, 1.2, 96, 64, 256


def usable(vector: str, dim: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0)


class Graph:
    """Vectors ``x`` (scaled, float32, with one more component), neighbours (-1: none) and the entry node."""

    def __init__(self, x: np.ndarray, neighbours: np.ndarray | None = None, entry: int = 0):
        largest = float(np.abs(x).max(initial=0)) or 1.0
        x = x.astype(np.float64) / largest
        norms = (x**2).sum(axis=1)
        self.x = np.hstack([x, np.sqrt(np.maximum(0, norms.max(initial=0) - norms))[:, None]]).astype(np.float32)
        self.squares = (self.x**2).sum(axis=1)
        self.neighbours = neighbours if neighbours is not None else np.full((len(x), DEGREE), -1, dtype=np.int32)
        self.entry = entry

    @staticmethod
    def queries(q: np.ndarray) -> np.ndarray:
        """Query vectors scaled, which changes no order, with one more component of zero."""
        largest = np.abs(q).max(axis=1, initial=0, keepdims=True)
        return np.hstack([q / np.where(largest > 0, largest, 1), np.zeros((len(q), 1))]).astype(np.float32)

    def distances(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances (less each query's own square) of rows of ids (queries x many)."""
        return self.squares[ids] - 2 * np.einsum("bd,bnd->bn", q, self.x[ids], optimize=True)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of each query's beam, nearest first; -1 and infinity where it is not full."""
        rows = np.arange(len(q))
        seen = np.zeros((len(q), len(self.x)), dtype=bool)
        ids = np.full((len(q), beam), -1, dtype=np.int32)
        found = np.full((len(q), beam), np.inf, dtype=np.float32)
        done = np.ones((len(q), beam), dtype=bool)
        ids[:, 0], found[:, 0], done[:, 0] = self.entry, self.distances(q, np.full((len(q), 1), self.entry))[:, 0], False
        seen[:, self.entry] = True
        active = rows
        while len(active):
            at = np.where(done[active], np.inf, found[active]).argmin(axis=1)
            open_ = ~done[active, at]
            active, at = active[open_], at[open_]
            if not len(active):
                break
            done[active, at] = True
            near = self.neighbours[ids[active, at]]
            new = (near >= 0) & ~seen[active[:, None], near]
            r, c = np.nonzero(new)
            seen[active[r], near[r, c]] = True
            d = np.where(new, self.distances(q[active], np.maximum(near, 0)), np.inf).astype(np.float32)
            every_ids, every_d = np.hstack([ids[active], near]), np.hstack([found[active], d])
            every_done = np.hstack([done[active], ~new])
            best = np.argpartition(every_d, beam - 1, axis=1)[:, :beam]
            k = np.arange(len(active))[:, None]
            ids[active], found[active], done[active] = every_ids[k, best], every_d[k, best], every_done[k, best] | np.isinf(every_d[k, best])
        order = found.argsort(axis=1, kind="stable")
        found = np.take_along_axis(found, order, axis=1)
        return np.where(np.isinf(found), -1, np.take_along_axis(ids, order, axis=1)), found

    def prune(self, points: np.ndarray, proposals: np.ndarray) -> np.ndarray:
        """Neighbours kept for each point among its proposals (-1: none)."""
        bad = (proposals < 0) | (proposals == points[:, None])
        ordered = np.sort(np.where(bad, -1, proposals), axis=1)
        bad = (ordered < 0) | np.hstack([np.zeros((len(points), 1), dtype=bool), ordered[:, 1:] == ordered[:, :-1]])
        ids = np.maximum(ordered, 0)
        own = np.where(bad, np.inf, self.distances(self.x[points], ids) + self.squares[points][:, None])
        order = own.argsort(axis=1)[:, :PROPOSALS]
        ids, own = np.take_along_axis(ids, order, axis=1), np.take_along_axis(own, order, axis=1)
        v = self.x[ids]
        between = self.squares[ids][:, :, None] + self.squares[ids][:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
        alive = np.isfinite(own)
        kept = np.full((len(points), DEGREE), -1, dtype=np.int32)
        n, rows = np.zeros(len(points), dtype=np.int64), np.arange(len(points))
        for i in range(ids.shape[1]):
            take = alive[:, i] & (n < DEGREE)
            kept[rows[take], n[take]] = ids[take, i]
            n += take
            alive &= ~(take[:, None] & (ALPHA**2 * between[:, i, :] <= own))
            alive[:, i] = False
        return kept

    def link_back(self, points: np.ndarray) -> None:
        """Add links from the new neighbours of ``points`` to them; lists that overflow are pruned."""
        r, c = np.nonzero(self.neighbours[points] >= 0)
        to, source = self.neighbours[points][r, c], points[r]
        order = np.argsort(to, kind="stable")
        to, source = to[order], source[order]
        targets, first, counts = np.unique(to, return_index=True, return_counts=True)
        width = min(int(counts.max(initial=0)), 4 * PROPOSALS)
        added = np.full((len(targets), width), -1, dtype=np.int32)
        place = np.arange(len(to)) - np.repeat(first, counts)
        fits = place < width
        added[np.repeat(np.arange(len(targets)), counts)[fits], place[fits]] = source[fits]
        both = np.hstack([self.neighbours[targets], added])
        degree = (both >= 0).sum(axis=1)
        few = degree <= DEGREE
        packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)
        self.neighbours[targets[few]] = packed[few][:, :DEGREE]
        for i in range(0, int((~few).sum()), BATCH):
            part = np.flatnonzero(~few)[i : i + BATCH]
            self.neighbours[targets[part]] = self.prune(targets[part], both[part])

    def build(self, seed: int = 1) -> Graph:
        n = len(self.x)
        mean = self.x.mean(axis=0)
        self.entry = int(((self.x - mean) ** 2).sum(axis=1).argmin())
        order = np.random.default_rng(seed).permutation(n).astype(np.int32)
        order = np.concatenate([[self.entry], order[order != self.entry]]).astype(np.int32)
        at, size = 1, 1
        while at < n:
            points = order[at : at + size]
            found, _ = self.search(self.x[points], BUILD_BEAM)
            self.neighbours[points] = self.prune(points, found)
            self.link_back(points)
            at += size
            size = min(2 * size, BATCH, max(1, n // 20))
        return self


def _rows(df: DataFrame, ident: str, vector: str, dim: int) -> DataFrame:
    """id, vector (doubles; zero without a sign) of the usable rows."""
    doubles = F.transform(vector, lambda x: x.cast("double") + F.lit(0.0))
    return df.filter(usable(vector, dim) & F.col(ident).isNotNull()).select(F.col(ident).cast("long").alias("id"), doubles.alias("vector"))


def classes(vectors: DataFrame, ident: str, vector: str, ids: int, dim: int) -> DataFrame:
    """node (smallest id), vector, ids (the ``ids`` smallest) for each distinct vector.

    Repeated rows go first, and ranks are cut off within each task before they meet, so
    equal vectors never gather.
    """
    rows = _rows(vectors, ident, vector, dim).groupBy("vector", "id").agg(F.lit(1).alias("one")).drop("one")
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).filter(F.col("_r") <= ids)
    return first.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.element_at("ids", 1).alias("node"), "vector", "ids")


def _usual_length(vectors: DataFrame, vector: str) -> int:
    """The length of most vectors, of several the smallest."""
    sizes = vectors.filter(F.size(vector) > 0).groupBy(F.size(vector).alias("n")).agg(F.count("*").alias("rows"))
    first = sizes.orderBy(F.col("rows").desc(), "n").first()
    return first["n"] if first else 0


def build_index(vectors: DataFrame, ident: str, vector: str, k: int, dim: int | None = None, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """A written table: shard, node, at (its number in the shard), entry, vector, ids, neighbours."""
    dim = dim or _usual_length(vectors, vector)
    nodes = materialize(classes(vectors, ident, vector, k + 1, dim), "ann-nodes")
    n, lanes = nodes.count(), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(-(-n // shard_nodes), min(lanes, n // LEAST_NODES), 1)
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int"))

    def build(f: pd.DataFrame) -> pd.DataFrame:
        f = f.iloc[np.lexsort((f["node"], f["vector"].map(lambda v: v.tobytes())))].reset_index(drop=True)
        graph = Graph(np.stack(f["vector"].to_numpy())).build()
        return f.assign(at=np.arange(len(f)), entry=graph.entry, neighbours=list(graph.neighbours))

    schema = "node long, vector array<double>, ids array<long>, shard int, at int, entry int, neighbours array<int>"
    return materialize(dealt.groupBy("shard").applyInPandas(build, schema), "ann-index")


def search_index(index: DataFrame, queries: DataFrame, ident: str, vector: str, k: int, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each query, itself left out."""
    width = index.select(F.size("vector").alias("n")).first()
    asked = _rows(queries, ident, vector, width["n"] if width else 0).withColumnRenamed("id", "query_id").distinct()
    asked = materialize(asked.withColumns({"k1": F.xxhash64(F.lit(1), "vector"), "k2": F.xxhash64(F.lit(2), "vector")}), "ann-queries")
    # nodes that an id may take up beside those looked for: as many as it has vectors
    several = asked.groupBy("query_id").agg(F.count("*").alias("own")).filter("own > 1")
    wide = asked.join(small_or_shuffled(materialize(several, "ann-several")), "query_id", "left").groupBy("k1", "k2", "vector").agg(F.max(F.coalesce("own", F.lit(1))).alias("own"))
    distinct = materialize(wide, "ann-distinct")
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    blocks = max(1, -(-distinct.count() // BLOCK_QUERIES))
    block = F.pmod(F.xxhash64(F.lit(5), "k1"), F.lit(blocks)).cast("int")
    sent = distinct.select("k1", "k2", "own", F.col("vector").alias("query"), block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    held = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "at", "entry", "vector", "ids", "neighbours")

    def look(nodes: pd.DataFrame, asked_: pd.DataFrame) -> pd.DataFrame:
        out = {"k1": [], "k2": [], "own": [], "score": [], "ids": []}
        if len(nodes) and len(asked_):
            nodes = nodes.sort_values("at", ignore_index=True)
            exact, ids = np.stack(nodes["vector"].to_numpy()).astype(np.float64), nodes["ids"].to_numpy()
            graph = Graph(exact, np.stack(nodes["neighbours"].to_numpy()).astype(np.int32), int(nodes["entry"].iloc[0]))
            for own, same in asked_.groupby("own"):
                wanted = k + int(own)
                for i in range(0, len(same), BATCH):
                    part = same.iloc[i : i + BATCH]
                    q = np.stack(part["query"].to_numpy()).astype(np.float64)
                    found, _ = graph.search(graph.queries(q), max(beam, wanted))
                    scores = np.where(found >= 0, np.einsum("bd,bnd->bn", q, exact[np.maximum(found, 0)]), -np.inf)
                    best = np.argsort(-scores, axis=1, kind="stable")[:, :wanted]
                    for row, (k1, k2) in enumerate(zip(part["k1"], part["k2"], strict=True)):
                        for j in best[row]:
                            if found[row, j] >= 0:
                                for name, value in zip(out, (k1, k2, own, scores[row, j], ids[found[row, j]]), strict=True):
                                    out[name].append(value)
        return pd.DataFrame(out)

    each = held.groupBy("shard", "block").cogroup(sent.groupBy("shard", "block")).applyInPandas(look, "k1 long, k2 long, own long, score double, ids array<long>")
    ranked = each.withColumn("_r", F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.col("score").desc(), F.element_at("ids", 1)))).filter(F.col("_r") <= F.col("own") + k)
    named = F.flatten(F.transform(F.collect_list(F.struct("score", "ids")), lambda c: F.transform(c["ids"], lambda i: F.struct((-c["score"]).alias("far"), i.alias("vec_id")))))
    best = ranked.groupBy("k1", "k2").agg(F.slice(F.array_sort(named), F.lit(1), F.max("own").cast("int") + k).alias("found"))  # k + own nodes of k + 1 ids at most
    joined = asked.select("query_id", "k1", "k2").join(small_or_shuffled(materialize(best, "ann-found")), ["k1", "k2"])
    others = F.slice(F.filter("found", lambda c: c["vec_id"] != F.col("query_id")), 1, k)
    return joined.select("query_id", F.posexplode(others).alias("p", "c")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("c.vec_id").alias("vec_id"), (-F.col("c.far")).alias("score"))
