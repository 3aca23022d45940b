"""Geofences: enter, dwell and exit of moving assets, in batch by windows and in a stream by kept state."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _inside(x: str, y: str) -> Column:
    return F.coalesce(F.col(x).between(F.col("x0"), F.col("x1")) & F.col(y).between(F.col("y0"), F.col("y1")), F.lit(False))


def transitions(points: DataFrame, fences: DataFrame) -> DataFrame:
    """asset, fence, at, event, seconds. points: asset, at (seconds), x, y and perhaps seq; fences: fence, x0, y0, x1, y1.

    Enter at the first point inside, dwell (seconds since) at later ones, exit (seconds)
    at the first outside. Points and fences meet in grid cells as large as the largest
    fence, a point in its own cell and in that of the point before it. Points of one second follow ``seq`` (without it, x and y).
    """
    order = ["at", *(["seq"] if "seq" in points.columns else []), "x", "y"]
    widest = fences.agg(F.max(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).first()[0] or 0.0
    g = float(widest) or 1.0
    at = lambda x, y: F.struct(F.floor(x / g).alias("i"), F.floor(y / g).alias("j"))
    w = Window.partitionBy("asset").orderBy(*order)
    moved = points.select("asset", *order, F.lag("x").over(w).alias("px"), F.lag("y").over(w).alias("py"))
    here, there = at(F.col("x"), F.col("y")), at(F.col("px"), F.col("py"))
    cells = F.explode(F.when(F.col("px").isNull(), F.array(here)).otherwise(F.array_distinct(F.array(here, there))))
    span = lambda low, high: F.sequence(F.floor(F.col(low) / g), F.floor(F.col(high) / g))
    covered = F.explode(F.flatten(F.transform(span("x0", "x1"), lambda i: F.transform(span("y0", "y1"), lambda j: F.struct(i.alias("i"), j.alias("j"))))))
    pairs = moved.withColumn("cell", cells).join(fences.withColumn("cell", covered), "cell")
    own = here["i"].between(F.floor(F.col("x0") / g), F.floor(F.col("x1") / g)) & here["j"].between(F.floor(F.col("y0") / g), F.floor(F.col("y1") / g))
    once = pairs.filter((F.col("cell") == here) | ~own)  # a fence in both cells counts in the point's own
    marked = once.withColumns({"inside": _inside("x", "y"), "before": _inside("px", "py")}).filter("inside OR before")
    since = F.last(F.when(F.col("inside") & ~F.col("before"), F.col("at")), ignorenulls=True).over(Window.partitionBy("asset", "fence").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    event = F.when(F.col("inside") & ~F.col("before"), "enter").when(F.col("inside"), "dwell").otherwise("exit")
    found = marked.select("asset", "fence", "at", event.alias("event"), (F.col("at") - since).alias("seconds"))
    return found.withColumn("seconds", F.when(F.col("event") == "enter", 0).otherwise(F.col("seconds")).cast("long"))


def stream(points: DataFrame, fences: list[tuple[str, float, float, float, float]]) -> DataFrame:
    """The same over a stream: for each asset, when it entered which fence."""

    def step(key, batches, state):
        entered = json.loads(state.get[0]) if state.exists else {}
        out = []
        for p in pd.concat(list(batches)).sort_values("at").itertuples():
            for name, x0, y0, x1, y1 in fences:
                inside = x0 <= p.x <= x1 and y0 <= p.y <= y1
                if inside and name not in entered:
                    entered[name] = int(p.at)
                    out.append((key[0], name, p.at, "enter", 0))
                elif inside:
                    out.append((key[0], name, p.at, "dwell", p.at - entered[name]))
                elif name in entered:
                    out.append((key[0], name, p.at, "exit", p.at - entered.pop(name)))
        state.update((json.dumps(entered),))
        yield pd.DataFrame(out, columns=["asset", "fence", "at", "event", "seconds"])

    return points.groupBy("asset").applyInPandasWithState(step, "asset string, fence string, at long, event string, seconds long", "state string", "append", "NoTimeout")
