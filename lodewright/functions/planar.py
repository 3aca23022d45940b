"""Planar geometry as structs of doubles: points (x, y), boxes (high, low), circles (center, radius), segments (a, b), lines (A, B, C), paths and polygons (arrays of points)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodewright.functions.pg import col


def point(x, y) -> Column:
    return F.struct(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))


def box(a, b) -> Column:
    a, b = col(a), col(b)
    return F.struct(point(F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"])).alias("high"), point(F.least(a["x"], b["x"]), F.least(a["y"], b["y"])).alias("low"))


def circle(center, radius) -> Column:
    return F.struct(col(center).alias("center"), col(radius).cast("double").alias("radius"))


def segment(a, b) -> Column:
    return F.struct(col(a).alias("a"), col(b).alias("b"))


def plus(a, b) -> Column:
    return point(col(a)["x"] + col(b)["x"], col(a)["y"] + col(b)["y"])


def minus(a, b) -> Column:
    return point(col(a)["x"] - col(b)["x"], col(a)["y"] - col(b)["y"])


def times(a, b) -> Column:
    """Complex product: scales and turns."""
    a, b = col(a), col(b)
    return point(a["x"] * b["x"] - a["y"] * b["y"], a["x"] * b["y"] + a["y"] * b["x"])


def over(a, b) -> Column:
    a, b = col(a), col(b)
    n = b["x"] * b["x"] + b["y"] * b["y"]
    return point((a["x"] * b["x"] + a["y"] * b["y"]) / n, (a["y"] * b["x"] - a["x"] * b["y"]) / n)


def distance(a, b) -> Column:
    """<-> between points."""
    return F.hypot(col(a)["x"] - col(b)["x"], col(a)["y"] - col(b)["y"])


def slope(a, b) -> Column:
    dx = col(b)["x"] - col(a)["x"]
    return F.when(dx == 0, F.lit(float("inf"))).otherwise((col(b)["y"] - col(a)["y"]) / dx)


def width(b) -> Column:
    return col(b)["high"]["x"] - col(b)["low"]["x"]


def height(b) -> Column:
    return col(b)["high"]["y"] - col(b)["low"]["y"]


def box_area(b) -> Column:
    return width(b) * height(b)


def box_center(b) -> Column:
    return point((col(b)["high"]["x"] + col(b)["low"]["x"]) / 2, (col(b)["high"]["y"] + col(b)["low"]["y"]) / 2)


def box_has(b, p) -> Column:
    b, p = col(b), col(p)
    return p["x"].between(b["low"]["x"], b["high"]["x"]) & p["y"].between(b["low"]["y"], b["high"]["y"])


def boxes_overlap(a, b) -> Column:
    a, b = col(a), col(b)
    return (a["low"]["x"] <= b["high"]["x"]) & (b["low"]["x"] <= a["high"]["x"]) & (a["low"]["y"] <= b["high"]["y"]) & (b["low"]["y"] <= a["high"]["y"])


def box_intersection(a, b) -> Column:
    """a # b, null where they are apart."""
    a, b = col(a), col(b)
    found = F.struct(point(F.least(a["high"]["x"], b["high"]["x"]), F.least(a["high"]["y"], b["high"]["y"])).alias("high"), point(F.greatest(a["low"]["x"], b["low"]["x"]), F.greatest(a["low"]["y"], b["low"]["y"])).alias("low"))
    return F.when(boxes_overlap(a, b), found)


def bound_box(a, b) -> Column:
    a, b = col(a), col(b)
    return F.struct(point(F.greatest(a["high"]["x"], b["high"]["x"]), F.greatest(a["high"]["y"], b["high"]["y"])).alias("high"), point(F.least(a["low"]["x"], b["low"]["x"]), F.least(a["low"]["y"], b["low"]["y"])).alias("low"))


def circle_area(c) -> Column:
    return F.pi() * col(c)["radius"] * col(c)["radius"]


def circle_has(c, p) -> Column:
    return distance(col(c)["center"], p) <= col(c)["radius"]


def diameter(c) -> Column:
    return col(c)["radius"] * 2


def segment_length(s) -> Column:
    return distance(col(s)["a"], col(s)["b"])


def segment_center(s) -> Column:
    return point((col(s)["a"]["x"] + col(s)["b"]["x"]) / 2, (col(s)["a"]["y"] + col(s)["b"]["y"]) / 2)


def is_horizontal(s) -> Column:
    return col(s)["a"]["y"] == col(s)["b"]["y"]


def is_vertical(s) -> Column:
    return col(s)["a"]["x"] == col(s)["b"]["x"]


def _turn(a, b, c) -> Column:
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def segments_parallel(s, t) -> Column:
    s, t = col(s), col(t)
    return (s["b"]["x"] - s["a"]["x"]) * (t["b"]["y"] - t["a"]["y"]) == (s["b"]["y"] - s["a"]["y"]) * (t["b"]["x"] - t["a"]["x"])


def segments_perpendicular(s, t) -> Column:
    s, t = col(s), col(t)
    return (s["b"]["x"] - s["a"]["x"]) * (t["b"]["x"] - t["a"]["x"]) + (s["b"]["y"] - s["a"]["y"]) * (t["b"]["y"] - t["a"]["y"]) == 0


def on_segment(p, s) -> Column:
    p, s = col(p), col(s)
    return (_turn(s["a"], s["b"], p) == 0) & p["x"].between(F.least(s["a"]["x"], s["b"]["x"]), F.greatest(s["a"]["x"], s["b"]["x"])) & p["y"].between(F.least(s["a"]["y"], s["b"]["y"]), F.greatest(s["a"]["y"], s["b"]["y"]))


def segments_meet(s, t) -> Column:
    """?#"""
    s, t = col(s), col(t)
    d1, d2, d3, d4 = _turn(s["a"], s["b"], t["a"]), _turn(s["a"], s["b"], t["b"]), _turn(t["a"], t["b"], s["a"]), _turn(t["a"], t["b"], s["b"])
    proper = (F.signum(d1) * F.signum(d2) < 0) & (F.signum(d3) * F.signum(d4) < 0)
    return proper | on_segment(t["a"], s) | on_segment(t["b"], s) | on_segment(s["a"], t) | on_segment(s["b"], t)


def segment_point_distance(s, p) -> Column:
    """<-> of a segment and a point; the closest point (##) is ``closest``."""
    return distance(closest(s, p), p)


def closest(s, p) -> Column:
    s, p = col(s), col(p)
    dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
    n = dx * dx + dy * dy
    t = F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p["x"] - s["a"]["x"]) * dx + (p["y"] - s["a"]["y"]) * dy) / n)))
    return point(s["a"]["x"] + t * dx, s["a"]["y"] + t * dy)


def _edges(points: Column, closed: bool) -> Column:
    n = F.size(points)
    following = F.concat(F.slice(points, F.lit(2), n - 1), F.slice(points, 1, 1))
    pairs = F.arrays_zip(points.alias("a"), following.alias("b"))
    return pairs if closed else F.slice(pairs, F.lit(1), n - 1)


def path_length(points, closed: bool = False) -> Column:
    return F.aggregate(_edges(col(points), closed), F.lit(0.0), lambda s, e: s + F.hypot(e["a"]["x"] - e["b"]["x"], e["a"]["y"] - e["b"]["y"]))


def polygon_area(points) -> Column:
    return F.abs(F.aggregate(_edges(col(points), True), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def polygon_has(points, p) -> Column:
    """Inside, counting crossings of a ray to the right, or on the border."""
    p = col(p)

    def touches(found: Column, e: Column) -> Column:
        a, b = e["a"], e["b"]
        turn = (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])
        within = p["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & p["y"].between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
        return found | ((turn == 0) & within)

    def crosses(n: Column, e: Column) -> Column:
        a, b = e["a"], e["b"]
        straddles = (a["y"] > p["y"]) != (b["y"] > p["y"])
        right = p["x"] < (b["x"] - a["x"]) * (p["y"] - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]
        return n + F.when(straddles & right, 1).otherwise(0)

    edges = _edges(col(points), True)
    return (F.aggregate(edges, F.lit(0), crosses) % 2 == 1) | F.aggregate(edges, F.lit(False), touches)


def polygon_box(points) -> Column:
    xs, ys = F.transform(col(points), lambda q: q["x"]), F.transform(col(points), lambda q: q["y"])
    return F.struct(point(F.array_max(xs), F.array_max(ys)).alias("high"), point(F.array_min(xs), F.array_min(ys)).alias("low"))
