"""Maintained cubes: dimension cells with additive measures, distinct counts and percentiles that merge.

A cube keeps its mergeable parts (counts, sums, minima, HyperLogLog and KLL sketches), so
that rolling up, merging shards and adding later rows never need the base rows again.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of the registers of a distinct sketch, and the share of rows above which cells are no summary.
HLL_BITS = 14
GRAIN = 0.5


@dataclass
class Cube:
    """The parts of a cube and how to read them."""

    name: str
    parts: DataFrame
    dimensions: list[str]
    sums: list[str] = field(default_factory=list)
    distinct: list[str] = field(default_factory=list)
    percentiles: list[str] = field(default_factory=list)
    position: int | None = None

    def relation(self) -> DataFrame:
        """dimensions, count, sum_/avg_/min_/max_ of sums, distinct_ and p50_/p90_/p99_ columns."""
        shown = [*self.dimensions, "count"]
        shown += [c for m in self.sums for c in (F.col(f"sum_{m}"), (F.col(f"sum_{m}") / F.col(f"n_{m}")).alias(f"avg_{m}"), F.col(f"min_{m}"), F.col(f"max_{m}"))]
        shown += [F.hll_sketch_estimate(f"hll_{d}").alias(f"distinct_{d}") for d in self.distinct]
        shown += [F.kll_sketch_get_quantile_double(F.col(f"kll_{p}"), F.lit(q)).alias(f"p{int(q * 100)}_{p}") for p in self.percentiles for q in (0.5, 0.9, 0.99)]
        return self.parts.select(*shown)

    def rebuilt(self, parts: DataFrame, **changes) -> Cube:
        return Cube(**{**self.__dict__, "parts": parts, **changes})


def create(name: str, rows: DataFrame, dimensions: list[str], sums: list[str] = (), distinct: list[str] = (), percentiles: list[str] = (), force: bool = False, position: str | None = None) -> Cube:
    """Build a cube. Cells about as many as rows are refused unless ``force``."""
    if not force:
        seen = rows.agg(F.approx_count_distinct(F.struct(*dimensions)).alias("cells"), F.count("*").alias("rows")).first()
        if seen["rows"] > 1000 and seen["cells"] > GRAIN * seen["rows"]:
            raise ValueError(f"cube {name}: {seen['cells']} cells for {seen['rows']} rows; use force")
    aggregates = [F.count("*").alias("count")]
    for m in sums:
        aggregates += [F.sum(m).alias(f"sum_{m}"), F.count(m).alias(f"n_{m}"), F.min(m).alias(f"min_{m}"), F.max(m).alias(f"max_{m}")]
    aggregates += [F.hll_sketch_agg(d, HLL_BITS).alias(f"hll_{d}") for d in distinct]
    aggregates += [F.kll_sketch_agg_double(F.col(p).cast("double")).alias(f"kll_{p}") for p in percentiles]
    at = rows.agg(F.max(position)).first()[0] if position else None
    return Cube(name, rows.groupBy(*dimensions).agg(*aggregates), list(dimensions), list(sums), list(distinct), list(percentiles), at)


def _merged(cube: Cube, parts: DataFrame, dimensions: list[str]) -> DataFrame:
    aggregates = [F.sum("count").alias("count")]
    for m in cube.sums:
        aggregates += [F.sum(f"sum_{m}").alias(f"sum_{m}"), F.sum(f"n_{m}").alias(f"n_{m}"), F.min(f"min_{m}").alias(f"min_{m}"), F.max(f"max_{m}").alias(f"max_{m}")]
    aggregates += [F.hll_union_agg(f"hll_{d}", F.lit(True)).alias(f"hll_{d}") for d in cube.distinct]
    aggregates += [F.kll_merge_agg_double(f"kll_{p}").alias(f"kll_{p}") for p in cube.percentiles]
    return parts.groupBy(*dimensions).agg(*aggregates)


def merge(a: Cube, b: Cube) -> Cube:
    """Cells of two shards together; the position is the earlier one. Unlike shapes are refused."""
    if (a.dimensions, a.sums, a.distinct, a.percentiles) != (b.dimensions, b.sums, b.distinct, b.percentiles):
        raise ValueError("cubes to merge must have the same dimensions and measures")
    position = None if a.position is None or b.position is None else min(a.position, b.position)
    return a.rebuilt(_merged(a, a.parts.unionByName(b.parts), a.dimensions), position=position)


def prefix(n: int):
    return lambda c: F.substring(c, 1, n)


def segment(separator: str, depth: int):
    return lambda c: F.substring_index(c, separator, depth)


def bucket(n: int):
    return lambda c: (F.floor(c / n) * n).cast("bigint")


def keep(c: Column) -> Column:
    return c


#: Drops the dimension.
WHOLE = None


def rollup(cube: Cube, levels: dict, name: str | None = None) -> Cube:
    """A coarser cube from the cells alone: each named dimension goes through its level, or away with WHOLE."""
    left = [d for d in cube.dimensions if d not in levels or levels[d] is not WHOLE]
    moved = cube.parts.withColumns({d: levels[d](F.col(d)) for d in left if d in levels})
    return cube.rebuilt(_merged(cube, moved, left), name=name or cube.name, dimensions=left)


def refresh(cube: Cube, rows: DataFrame, position: str) -> Cube:
    """Apply the rows after the cube's position."""
    tail = rows.filter(F.col(position) > F.lit(cube.position)) if cube.position is not None else rows
    added = create(cube.name, tail, cube.dimensions, cube.sums, cube.distinct, cube.percentiles, True, position)
    return cube.rebuilt(_merged(cube, cube.parts.unionByName(added.parts), cube.dimensions), position=cube.position if added.position is None else added.position)


def status(cubes: list[Cube], collection: str, source: DataFrame, position: str) -> DataFrame:
    """name, collection, dimensions, measures, projection_position, source_position, lag_events, cells, source_rows of each cube."""
    at = source.agg(F.max(position).alias("at"), F.count("*").alias("n")).first()
    rows = []
    for c in cubes:
        lag = source.filter(F.col(position) > F.lit(c.position)).count() if c.position is not None else at["n"]
        measures = [f"sum({m})" for m in c.sums] + [f"count(distinct {d})" for d in c.distinct] + [f"percentiles({p})" for p in c.percentiles]
        rows.append((c.name, collection, ", ".join(c.dimensions), ", ".join(measures), c.position, at["at"], lag, c.parts.count(), at["n"]))
    return source.sparkSession.createDataFrame(rows, "name string, collection string, dimensions string, measures string, projection_position long, source_position long, lag_events long, cells long, source_rows long")


def bottom_k_percentile(rows: DataFrame, dimensions: list[str], value: str, ident: str, q: float, k: int = 1024) -> DataFrame:
    """Nearest-rank percentile of the ``k`` rows with the smallest hash of their id in each cell: exact up to ``k`` rows."""
    from pyspark.sql import Window

    near = rows.filter(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy(*dimensions).orderBy(F.xxhash64(ident), ident))).filter(F.col("_r") <= k)
    listed = F.array_sort(F.collect_list(value))
    return near.groupBy(*dimensions).agg(listed.alias("_v")).select(*dimensions, F.element_at("_v", F.greatest(F.lit(1), F.ceil(F.size("_v") * q).cast("int"))).alias(f"p{int(q * 100)}_{value}"))


def h3_parent(resolution: int):
    """A level that takes H3 cells to their parents."""
    from lodewright.operators import spatial

    return lambda c: spatial.h3_parent(c, resolution)
