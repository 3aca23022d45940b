"""Geometry as WKT text (lon/lat, SRID 4326): codecs, predicates, measures, grids, joins, rasters and routes."""

from __future__ import annotations

import heapq
import json
import math
import re
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewright.storage import materialize

from lodewright.functions.pg import col

RADIUS = 6371008.8
KINDS = {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT", 5: "MULTILINESTRING", 6: "MULTIPOLYGON", 7: "GEOMETRYCOLLECTION"}


# ---- codecs: a geometry is (kind, nested coordinates)
def parse_wkt(text: str) -> tuple[str, list]:
    text = text.strip()
    if m := re.match(r"SRID=(\d+);(.*)$", text, re.S):
        if m[1] not in ("0", "4326"):
            raise ValueError("only SRID 4326 is supported")
        text = m[2].strip()
    m = re.match(r"([A-Za-z]+)\s*(EMPTY|\(.*\))$", text, re.S)
    if not m or m[1].upper() not in KINDS.values():
        raise ValueError(f"no geometry: {text[:40]!r}")
    kind, body = m[1].upper(), m[2]
    if body == "EMPTY":
        return kind, []
    if kind == "GEOMETRYCOLLECTION":
        parts, depth, start = [], 0, 1
        for i, c in enumerate(body[1:-1], 1):
            depth += (c == "(") - (c == ")")
            if c == "," and not depth:
                parts.append(body[start:i])
                start = i + 1
        return kind, [parse_wkt(p) for p in [*parts, body[start:-1]]]
    pairs = re.sub(r"(-?[\d.eE+-]+)\s+(-?[\d.eE+-]+)(\s+-?[\d.eE+-]+)*", lambda p: "[" + ",".join(p[0].split()) + "]", body)
    value = json.loads(pairs.replace("(", "[").replace(")", "]"))
    if kind == "POINT":
        value = value[0]
    if kind == "MULTIPOINT":
        value = [v[0] if isinstance(v[0], list) else v for v in value]
    flat = value if kind == "POINT" else list(_points((kind, value)))
    if len(flat if kind == "POINT" else flat[0]) > 2:
        raise ValueError("Z and M coordinates are not supported")
    return kind, value


def _points(g: tuple[str, list]):
    kind, c = g
    if kind == "GEOMETRYCOLLECTION":
        for part in c:
            yield from _points(part)
    elif c and not isinstance(c[0], list):
        yield c
    else:
        for part in c:
            yield from _points((kind, part))


def _number(x: float) -> str:
    return repr(int(x)) if x == int(x) and abs(x) < 1e15 else repr(float(x))


def to_wkt(g: tuple[str, list]) -> str:
    kind, c = g
    if not c:
        return f"{kind} EMPTY"
    if kind == "GEOMETRYCOLLECTION":
        return f"{kind}({','.join(map(to_wkt, c))})"

    def shown(v) -> str:
        return " ".join(map(_number, v)) if not isinstance(v[0], list) else "(" + ",".join(map(shown, v)) + ")"

    return f"{kind}({shown(c)})" if kind == "POINT" else f"{kind}{shown(c)}"


def to_wkb(g: tuple[str, list], srid: int | None = None) -> bytes:
    kind, c = g
    code = next(k for k, v in KINDS.items() if v == kind)
    head = struct.pack("<BI", 1, code | (0x20000000 if srid else 0)) + (struct.pack("<I", srid) if srid else b"")
    line = lambda pts: struct.pack("<I", len(pts)) + b"".join(struct.pack("<dd", *p) for p in pts)
    if kind == "POINT":
        return head + struct.pack("<dd", *(c or (math.nan, math.nan)))
    if kind == "LINESTRING":
        return head + line(c)
    if kind == "POLYGON":
        return head + struct.pack("<I", len(c)) + b"".join(map(line, c))
    parts = c if kind == "GEOMETRYCOLLECTION" else [(kind.removeprefix("MULTI"), p) for p in c]
    return head + struct.pack("<I", len(parts)) + b"".join(map(to_wkb, parts))


def parse_wkb(data: bytes) -> tuple[str, list]:
    at = 0

    def take(fmt: str):
        nonlocal at
        out = struct.unpack_from(order + fmt, data, at)
        at += struct.calcsize(order + fmt)
        return out

    def one() -> tuple[str, list]:
        nonlocal at, order
        order = "<" if data[at] else ">"
        at += 1
        code = take("I")[0]
        if code & 0xC0000000 or 1000 <= (code & 0xFFFF) < 4000:
            raise ValueError("Z and M coordinates are not supported")
        if code & 0x20000000 and take("I")[0] not in (0, 4326):
            raise ValueError("only SRID 4326 is supported")
        kind = KINDS[code & 0xFF]
        pairs = lambda: [list(take("dd")) for _ in range(take("I")[0])]
        if kind == "POINT":
            p = list(take("dd"))
            return kind, [] if math.isnan(p[0]) else p
        if kind == "LINESTRING":
            return kind, pairs()
        if kind == "POLYGON":
            return kind, [pairs() for _ in range(take("I")[0])]
        parts = [one() for _ in range(take("I")[0])]
        return kind, parts if kind == "GEOMETRYCOLLECTION" else [p[1] for p in parts]

    order = "<"
    return one()


def to_geojson(g: tuple[str, list]) -> str:
    names = {v: v.title().replace("string", "String").replace("Multip", "MultiP").replace("Multil", "MultiL").replace("collection", "Collection") for v in KINDS.values()}

    def shown(x) -> dict:
        return {"type": names[x[0]], "geometries": [shown(p) for p in x[1]]} if x[0] == "GEOMETRYCOLLECTION" else {"type": names[x[0]], "coordinates": x[1]}

    return json.dumps(shown(g), separators=(",", ":"))


def parse_geojson(text: str) -> tuple[str, list]:
    def read(x) -> tuple[str, list]:
        return (x["type"].upper(), [read(p) for p in x["geometries"]]) if x["type"] == "GeometryCollection" else (x["type"].upper(), x["coordinates"])

    return read(json.loads(text))


# ---- measures on the sphere
def haversine(a, b) -> float:
    x1, y1, x2, y2 = map(math.radians, (*a, *b))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * RADIUS * math.asin(min(1.0, math.sqrt(h)))


def _polygons(g) -> list:
    kind, c = g
    return [c] if kind == "POLYGON" and c else c if kind == "MULTIPOLYGON" else [p for x in c for p in _polygons(x)] if kind == "GEOMETRYCOLLECTION" else []


def _lines(g) -> list:
    kind, c = g
    if kind == "LINESTRING":
        return [c] if c else []
    if kind == "MULTILINESTRING":
        return c
    return [r for p in _polygons(g) for r in p] + ([ln for x in c for ln in _lines(x) if x[0].endswith("LINESTRING")] if kind == "GEOMETRYCOLLECTION" else [])


def _ring_area(ring) -> float:
    total = 0.0
    for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
        total += math.radians(x2 - x1) * (2 + math.sin(math.radians(y1)) + math.sin(math.radians(y2)))
    return abs(total) * RADIUS * RADIUS / 2


def area(g) -> float:
    return sum(_ring_area(p[0]) - sum(map(_ring_area, p[1:])) for p in _polygons(g))


def length(g) -> float:
    return sum(haversine(a, b) for ln in ([] if _polygons(g) else _lines(g)) for a, b in zip(ln, ln[1:], strict=False))


def perimeter(g) -> float:
    return sum(haversine(a, b) for p in _polygons(g) for r in p for a, b in zip(r, r[1:], strict=False))


def centroid(g) -> tuple[str, list]:
    if polygons := _polygons(g):
        sx = sy = total = 0.0
        for rings in polygons:
            for i, r in enumerate(rings):
                cx = cy = a = 0.0
                for (x1, y1), (x2, y2) in zip(r, r[1:], strict=False):
                    k = x1 * y2 - x2 * y1
                    a, cx, cy = a + k, cx + (x1 + x2) * k, cy + (y1 + y2) * k
                sign = (1 if i == 0 else -1) * (1 if a > 0 else -1)
                sx, sy, total = sx + sign * cx / 3, sy + sign * cy / 3, total + sign * a
        return "POINT", [sx / total, sy / total]
    if lines := _lines(g):
        parts = [(math.dist(a, b), [(a[0] + b[0]) / 2, (a[1] + b[1]) / 2]) for ln in lines for a, b in zip(ln, ln[1:], strict=False)]
        total = sum(d for d, _ in parts) or 1.0
        return "POINT", [sum(d * m[k] for d, m in parts) / total for k in (0, 1)]
    pts = list(_points(g))
    return "POINT", [sum(p[k] for p in pts) / len(pts) for k in (0, 1)] if pts else []


def envelope(g) -> tuple[float, float, float, float]:
    pts = list(_points(g))
    return min(p[0] for p in pts), min(p[1] for p in pts), max(p[0] for p in pts), max(p[1] for p in pts)


def hull(g) -> tuple[str, list]:
    pts = sorted({tuple(p) for p in _points(g)})
    if len(pts) < 3:
        return ("POINT", list(pts[0])) if len(pts) == 1 else ("LINESTRING", [list(p) for p in pts])

    def half(points):
        out = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    ring = half(pts)[:-1] + half(pts[::-1])[:-1]
    return "POLYGON", [[list(p) for p in [*ring, ring[0]]]]


def simplify(g, tolerance: float) -> tuple[str, list]:
    def line(pts):
        if len(pts) < 3:
            return pts
        a, b = pts[0], pts[-1]
        n = math.dist(a, b)
        far = [math.dist(a, p) if n == 0 else abs((b[0] - a[0]) * (a[1] - p[1]) - (a[0] - p[0]) * (b[1] - a[1])) / n for p in pts[1:-1]]
        k = max(range(len(far)), key=far.__getitem__)
        return [a, b] if far[k] <= tolerance else line(pts[: k + 2])[:-1] + line(pts[k + 1 :])

    kind, c = g
    if kind == "LINESTRING":
        return kind, line(c)
    if kind == "MULTILINESTRING":
        return kind, [line(x) for x in c]
    ring = lambda r: line(r[: len(r) // 2 + 1])[:-1] + line(r[len(r) // 2 :])
    if kind == "POLYGON":
        return kind, [ring(r) for r in c]
    return (kind, [[ring(r) for r in p] for p in c]) if kind == "MULTIPOLYGON" else g


def buffer(g, metres: float, sides: int = 32) -> tuple[str, list]:
    """A circle of ``sides`` corners about each point."""
    if g[0] not in ("POINT", "MULTIPOINT"):
        raise ValueError("buffer takes points")

    def ring(p):
        out = []
        for k in range(sides):
            t = 2 * math.pi * k / sides
            out.append([p[0] + math.degrees(metres * math.cos(t) / (RADIUS * math.cos(math.radians(p[1])))), p[1] + math.degrees(metres * math.sin(t) / RADIUS)])
        return [*out, out[0]]

    rings = [[ring(p)] for p in _points(g)]
    return ("POLYGON", rings[0]) if len(rings) == 1 else ("MULTIPOLYGON", rings)


# ---- predicates
def _turn(a, b, c) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _on(p, a, b) -> bool:
    return _turn(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def _where(p, rings) -> int:
    """1 inside, 0 on the edge, -1 outside a polygon with holes."""
    inside = False
    for r in rings:
        for a, b in zip(r, r[1:], strict=False):
            if _on(p, a, b):
                return 0
            if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
                inside = not inside
    return 1 if inside else -1


def _place(p, g) -> int:
    """1 in the interior, 0 on the boundary, -1 outside."""
    found = -1
    for rings in _polygons(g):
        found = max(found, _where(p, rings))
    kind, c = g
    for ln in [] if _polygons(g) else _lines(g):
        for a, b in zip(ln, ln[1:], strict=False):
            if _on(p, a, b):
                ends = ln[0] != ln[-1] and p in (ln[0], ln[-1])
                found = max(found, 0 if ends else 1)
    if kind in ("POINT", "MULTIPOINT"):
        found = max(found, 1 if any(list(p) == list(q) for q in _points(g)) else -1)
    return found


def _segments(g):
    return [(a, b) for ln in _lines(g) for a, b in zip(ln, ln[1:], strict=False)]


def _cuts(a, b, c, d) -> list[float]:
    """Places along a-b where c-d meets it."""
    t1, t2 = _turn(c, d, a), _turn(c, d, b)
    out = []
    if t1 != t2:
        t = t1 / (t1 - t2)
        p = [a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])]
        if 0 <= t <= 1 and min(c[0], d[0]) - 1e-12 <= p[0] <= max(c[0], d[0]) + 1e-12 and min(c[1], d[1]) - 1e-12 <= p[1] <= max(c[1], d[1]) + 1e-12:
            out.append(t)
    elif t1 == 0:
        k = 0 if abs(b[0] - a[0]) >= abs(b[1] - a[1]) else 1
        out += [(q[k] - a[k]) / (b[k] - a[k]) for q in (c, d) if b[k] != a[k] and 0 <= (q[k] - a[k]) / (b[k] - a[k]) <= 1]
    return out


def _samples(g, other) -> list[int]:
    """Places of representative points of g's lines (cut where they meet the other) and corners, relative to the other."""
    found = [_place(p, other) for p in _points(g)]
    for a, b in _segments(g):
        at = sorted({0.0, 1.0, *(t for c, d in _segments(other) for t in _cuts(a, b, c, d))})
        found += [_place([a[0] + (s + t) / 2 * (b[0] - a[0]), a[1] + (s + t) / 2 * (b[1] - a[1])], other) for s, t in zip(at, at[1:], strict=False) if t - s > 1e-12]
    return found


def _meets(a, b) -> bool:
    return any(s >= 0 for s in (*_samples(a, b), *_samples(b, a))) or any(_cuts(p, q, r, s) for p, q in _segments(a) for r, s in _segments(b))


def _inner(g) -> list:
    """A point inside each polygon, by halving a line across it."""
    out = []
    for rings in _polygons(g):
        x0, y0, x1, y1 = envelope(("POLYGON", rings))
        for k in (0.5, 0.37, 0.71, 0.13):
            y = y0 + k * (y1 - y0)
            xs = sorted(a[0] + (y - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) for r in rings for a, b in zip(r, r[1:], strict=False) if (a[1] > y) != (b[1] > y))
            if len(xs) > 1:
                out.append([(xs[0] + xs[1]) / 2, y])
                break
    return out


def _dim(g) -> int:
    return 2 if _polygons(g) else 1 if _lines(g) else 0


def _inside_share(a, b) -> tuple[bool, bool]:
    """Whether some interior of a lies in b's interior, and some outside b."""
    places = _samples(a, b) if _dim(a) < 2 else [*(_place(p, b) for p in _inner(a)), *(s for s in _samples(a, b) if s != 0)]
    return any(s > 0 for s in places), any(s < 0 for s in places)


def within(a, b) -> bool:
    inner, outer = _inside_share(a, b)
    return bool(_points_of(a)) and not outer and (inner or _dim(a) == _dim(b) == 2 and all(_place(p, b) >= 0 for p in _points(a)))


def _points_of(g) -> list:
    return list(_points(g))


def covers(a, b) -> bool:
    return bool(_points_of(b)) and all(s >= 0 for s in _samples(b, a)) and all(_place(p, a) >= 0 for p in _inner(b))


def interiors_meet(a, b) -> bool:
    if _dim(a) == 2 and _dim(b) == 2:
        return any(_place(p, b) > 0 for p in _inner(a)) or any(_place(p, a) > 0 for p in _inner(b)) or any(s > 0 for s in (*_samples(a, b), *_samples(b, a)))
    if _dim(a) == 1 and _dim(b) == 1:
        return any(s > 0 for s in _samples(a, b)) or any(0 < t < 1 for p, q in _segments(a) for r, s in _segments(b) for t in _cuts(p, q, r, s))
    low, high = (a, b) if _dim(a) <= _dim(b) else (b, a)
    return any(s > 0 for s in _samples(low, high))


PREDICATES = {
    "intersects": _meets,
    "disjoint": lambda a, b: not _meets(a, b),
    "within": within,
    "contains": lambda a, b: within(b, a),
    "covers": covers,
    "coveredby": lambda a, b: covers(b, a),
    "touches": lambda a, b: _meets(a, b) and not interiors_meet(a, b),
    "equals": lambda a, b: covers(a, b) and covers(b, a),
    "overlaps": lambda a, b: _dim(a) == _dim(b) and interiors_meet(a, b) and not covers(a, b) and not covers(b, a),
    "crosses": lambda a, b: interiors_meet(a, b) and (_dim(a) != _dim(b) and not covers(b, a) and not covers(a, b) or _dim(a) == _dim(b) == 1 and not any(s > 0 for s in _samples(a, b)[len(_points_of(a)) :])),
}


def predicate(name: str, a, b) -> Column:
    """ST_<name> of two WKT columns; boxes that are apart are told so without looking closer."""
    test = PREDICATES[name]

    @F.pandas_udf("boolean")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        known: dict[str, tuple] = {}

        def read(t: str):
            if t not in known:
                known[t] = parse_wkt(t)
            return known[t]

        return pd.Series([None if p is None or q is None else bool(test(read(p), read(q))) for p, q in zip(x, y, strict=True)])

    return run(col(a), col(b))


def _udf(kind: str, f):
    def call(g) -> Column:
        @F.pandas_udf(kind)
        def run(x: pd.Series) -> pd.Series:
            return x.map(lambda t: None if t is None else f(parse_wkt(t)))

        return run(col(g))

    return call


st_area, st_length, st_perimeter = _udf("double", area), _udf("double", length), _udf("double", perimeter)
st_centroid, st_convexhull, st_astext = (_udf("string", lambda g, f=f: to_wkt(f(g))) for f in (centroid, hull, lambda g: g))
st_asbinary, st_asewkb = _udf("binary", to_wkb), _udf("binary", lambda g: to_wkb(g, 4326))
st_asgeojson = _udf("string", to_geojson)
st_envelope = _udf("array<double>", lambda g: list(envelope(g)))


def st_buffer(g, metres: float) -> Column:
    return _udf("string", lambda x: to_wkt(buffer(x, metres)))(g)


def st_simplify(g, tolerance: float) -> Column:
    return _udf("string", lambda x: to_wkt(simplify(x, tolerance)))(g)


def st_geomfromwkb(b) -> Column:
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else to_wkt(parse_wkb(bytes(v))))

    return run(col(b))


def st_geomfromgeojson(s) -> Column:
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else to_wkt(parse_geojson(v)))

    return run(col(s))


# ---- built-in expressions for points
def st_point(lon, lat) -> Column:
    return F.concat(F.lit("POINT("), col(lon).cast("string"), F.lit(" "), col(lat).cast("string"), F.lit(")"))


def metres(lon1, lat1, lon2, lat2) -> Column:
    x1, y1, x2, y2 = (F.radians(col(c)) for c in (lon1, lat1, lon2, lat2))
    h = F.pow(F.sin((y2 - y1) / 2), 2) + F.cos(y1) * F.cos(y2) * F.pow(F.sin((x2 - x1) / 2), 2)
    return 2 * RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def cell(lon, lat, degrees: float) -> Column:
    """A grid cell (not H3): column and row of a square of ``degrees``."""
    return F.concat_ws(":", F.floor(col(lon) / degrees), F.floor(col(lat) / degrees))


#: Pairs of a cell that one task compares.
PAIRS = 4_000_000


def within_distance_join(a: DataFrame, b: DataFrame, ident_a: str, ident_b: str, distance: float) -> DataFrame:
    """Pairs of points (lon, lat) no more than ``distance`` metres apart: equal grid cells meet, neighbours are sent along.

    Rows are as high as the distance; a row's columns are at least as wide as it reaches at
    the row's edge that is nearer the pole, and the last meets the first at 180 degrees.
    Cells with more than PAIRS pairs are dealt to several tasks, and the number of tasks
    follows the pairs, since a few bytes of points can make many pairs.
    """
    high = math.degrees(distance / RADIUS)
    row = F.floor(F.col("lat") / high)
    edge = lambda r: F.least(F.lit(90.0), F.greatest(F.abs(r * high), F.abs((r + 1) * high)))
    reach = lambda r: math.sin(min(math.pi / 2, distance / RADIUS)) / F.greatest(F.lit(1e-12), F.cos(F.radians(edge(r))))
    columns = lambda r: F.when(reach(r) >= 1, 1).otherwise(F.greatest(F.lit(1), F.floor(360 / (F.degrees(F.asin(reach(r))) * 1.000001)))).cast("long")
    column = lambda x, r: F.floor((F.pmod(F.col(x) + 180, F.lit(360.0)) / 360) * columns(r))
    left = a.select(F.col(ident_a).alias("a"), F.col("lon").alias("ax"), F.col("lat").alias("ay"), F.explode(F.array(row - 1, row, row + 1)).alias("r"))
    left = left.withColumn("c", F.explode(F.array_distinct(F.array(*(F.pmod(column("ax", F.col("r")) + k, columns(F.col("r"))) for k in (-1, 0, 1))))))
    right = b.select(F.col(ident_b).alias("b"), F.col("lon").alias("bx"), F.col("lat").alias("by"), row.alias("r"))
    right = right.withColumn("c", column("bx", F.col("r")))
    number = lambda df, n: df.groupBy("r", "c").agg(F.count("*").alias(n))
    met = number(left, "n").join(number(right, "m"), ["r", "c"]).select("r", "c", (F.col("n").cast("double") * F.col("m") / PAIRS).alias("parts"))
    most = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lanes = min(max(most, math.ceil(met.agg(F.sum("parts")).first()[0] or 0)), 50 * most)  # one row
    hot = met.filter("parts > 1").select("r", "c", F.ceil("parts").cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    left = left.join(hot, ["r", "c"], "left").withColumn("part", F.pmod(F.xxhash64("a", "ax", "ay"), parts).cast("int")).drop("parts")
    right = right.join(hot, ["r", "c"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    keys = ["r", "c", "part"]
    found = left.repartition(lanes, *keys).join(right.repartition(lanes, *keys), keys).withColumn("metres", metres("ax", "ay", "bx", "by"))
    return found.filter(F.col("metres") <= distance).select("a", "b", "metres")


def spatial_join(points: DataFrame, areas: DataFrame, geom: str, degrees: float, name: str = "intersects") -> DataFrame:
    """Rows of ``points`` and ``areas`` (both with WKT in ``geom``) for which a predicate holds: boxes meet in grid cells, then the shapes are tested."""
    sides = []
    for df, end in ((points, "_a"), (areas, "_b")):
        boxed = df.select(*(F.col(c).alias(c + end) for c in df.columns), st_envelope(geom).alias("_e"))
        cells = F.explode(F.flatten(F.transform(F.sequence(F.floor(F.col("_e")[0] / degrees), F.floor(F.col("_e")[2] / degrees)), lambda x: F.transform(F.sequence(F.floor(F.col("_e")[1] / degrees), F.floor(F.col("_e")[3] / degrees)), lambda y: F.struct(x.alias("x"), y.alias("y"))))))
        sides.append(boxed.select("*", cells.alias("_cell"), F.col("_e").alias("_e" + end)).drop("_e"))
    a, b = sides
    near = a.join(b, "_cell").filter((F.col("_e_a")[0] <= F.col("_e_b")[2]) & (F.col("_e_b")[0] <= F.col("_e_a")[2]) & (F.col("_e_a")[1] <= F.col("_e_b")[3]) & (F.col("_e_b")[1] <= F.col("_e_a")[3]))
    first = F.struct(F.greatest(F.floor(F.col("_e_a")[0] / degrees), F.floor(F.col("_e_b")[0] / degrees)).alias("x"), F.greatest(F.floor(F.col("_e_a")[1] / degrees), F.floor(F.col("_e_b")[1] / degrees)).alias("y"))
    once = near.filter(F.col("_cell") == first).drop("_cell", "_e_a", "_e_b")  # each pair in the first cell that both have
    return once.filter(predicate(name, geom + "_a", geom + "_b"))


# ---- raster and routes
def raster_sample(grid: list[list[float]], x0: float, y0: float, step: float, lon, lat) -> Column:
    """Bilinear value of a grid (rows from y0 upward) at points; null outside. The grid is small and goes along as a literal."""
    flat, w, h = F.array(*(F.lit(float(v)) for r in grid for v in r)), len(grid[0]), len(grid)
    gx, gy = (col(lon) - x0) / step, (col(lat) - y0) / step
    i, j = F.least(F.floor(gx), F.lit(w - 2)).cast("int"), F.least(F.floor(gy), F.lit(h - 2)).cast("int")
    at = lambda a, b: F.element_at(flat, (b * w + a + 1).cast("int"))
    fx, fy = gx - i, gy - j
    value = at(i, j) * (1 - fx) * (1 - fy) + at(i + 1, j) * fx * (1 - fy) + at(i, j + 1) * (1 - fx) * fy + at(i + 1, j + 1) * fx * fy
    return F.when((gx >= 0) & (gy >= 0) & (gx <= w - 1) & (gy <= h - 1), value)


def shortest_paths(edges: list[tuple[str, str, float]], start: str, two_way: bool = True) -> dict[str, tuple[float, list[str]]]:
    """Cost and path from ``start`` to every node of a road graph."""
    near: dict[str, list[tuple[str, float]]] = {}
    for a, b, cost in edges:
        near.setdefault(a, []).append((b, cost))
        if two_way:
            near.setdefault(b, []).append((a, cost))
    done: dict[str, tuple[float, list[str]]] = {}
    heap = [(0.0, [start])]
    while heap:
        cost, path = heapq.heappop(heap)
        if path[-1] not in done:
            done[path[-1]] = (cost, path)
            for b, c in near.get(path[-1], []):
                if b not in done:
                    heapq.heappush(heap, (cost + c, [*path, b]))
    return done


def travel_time(edges: list[tuple[str, str, float]], start, end) -> Column:
    """Cost between two node columns over a road graph of a checked size, which goes along with the function; ``travel_times`` takes a table of any size."""
    if len(edges) > 1_000_000:
        raise ValueError("road graph too large to send along: use travel_times")

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known = {s: shortest_paths(edges, s) for s in a.dropna().unique()}
        out = []
        for x, y in zip(a, b, strict=True):
            if x is not None and y is not None and y not in known[x]:
                raise ValueError(f"no route from {x} to {y}")
            out.append(None if x is None or y is None else known[x][y][0])
        return pd.Series(out, dtype="float64")

    return run(col(start), col(end))


def travel_times(roads: DataFrame, starts: DataFrame, two_way: bool = True) -> DataFrame:
    """start, node, cost of the cheapest way from each start (start) to every node of a road table (a, b, cost >= 0) of any size.

    Each turn only nodes that became cheaper send their cost along their roads.
    """
    edges = roads.select("a", "b", "cost")
    edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "cost")) if two_way else edges
    edges = materialize(edges.groupBy("a", "b").agg(F.min("cost").alias("cost")), "roads")
    known = fresh = materialize(starts.select("start", F.col("start").alias("node"), F.lit(0.0).alias("cost")).distinct(), "reached")
    while not fresh.isEmpty():
        sent = fresh.join(edges.withColumnRenamed("cost", "_way"), F.col("node") == F.col("a")).groupBy("start", F.col("b").alias("node")).agg(F.min(F.col("cost") + F.col("_way")).alias("_cost"))
        better = materialize(sent.join(known, ["start", "node"], "left").filter("cost IS NULL OR _cost < cost").select("start", "node", F.col("_cost").alias("cost")), "fresh")
        known = materialize(known.unionByName(better).groupBy("start", "node").agg(F.min("cost").alias("cost")), "reached")
        fresh = better
    return known


def isochrone(edges: list[tuple[str, str, float]], start: str, limit: float) -> list[tuple[str, float]]:
    return sorted((n, c) for n, (c, _) in shortest_paths(edges, start).items() if c <= limit)


# ---- overlays of polygons, cut at every crossing and put together again
def _inside_half(p, q, a, b) -> tuple[bool, bool]:
    return _turn(a, b, p) >= 0, _turn(a, b, q) >= 0


def _signed(ring) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2


def _pieces(g, other) -> list[tuple[tuple, tuple, int]]:
    """Directed edges of g (interior to the left), cut at the other's, with their place relative to the other: 1, 0 same way, 2 opposite way, -1."""
    theirs = {(tuple(a), tuple(b)) for a, b in _directed(other)}
    out = []
    for a, b in _directed(g):
        at = sorted({0.0, 1.0, *(round(t, 12) for c, d in _segments(other) for t in _cuts(a, b, c, d))})
        points = [(round(a[0] + t * (b[0] - a[0]), 10), round(a[1] + t * (b[1] - a[1]), 10)) for t in at]
        for p, q in zip(points, points[1:], strict=False):
            if p != q:
                middle = [(p[0] + q[0]) / 2, (p[1] + q[1]) / 2]
                place = _place(middle, other)
                if place == 0:
                    along = any(abs(_turn(c, d, middle)) < 1e-9 and (d[0] - c[0]) * (q[0] - p[0]) + (d[1] - c[1]) * (q[1] - p[1]) > 0 for c, d in theirs if min(c[0], d[0]) - 1e-9 <= middle[0] <= max(c[0], d[0]) + 1e-9 and min(c[1], d[1]) - 1e-9 <= middle[1] <= max(c[1], d[1]) + 1e-9)
                    place = 0 if along else 2
                out.append((p, q, place))
    return out


def _directed(g) -> list:
    out = []
    for rings in _polygons(g):
        for i, r in enumerate(rings):
            forward = (_signed(r) > 0) == (i == 0)
            r = r if forward else r[::-1]
            out += list(zip(r, r[1:], strict=False))
    return out


def overlay(a, b, how: str) -> tuple[str, list]:
    """union, intersection or difference of two (multi)polygons."""
    if not _polygons(a) or not _polygons(b):
        raise ValueError("overlays take polygons")
    mine, theirs = _pieces(a, b), _pieces(b, a)
    keep_a = {"union": (-1, 0), "intersection": (1, 0), "difference": (-1, 2)}[how]
    keep_b = {"union": (-1,), "intersection": (1,), "difference": (1,)}[how]
    edges = [(p, q) for p, q, w in mine if w in keep_a] + [(q, p) if how == "difference" else (p, q) for p, q, w in theirs if w in keep_b]
    ahead: dict[tuple, list] = {}
    for p, q in edges:
        ahead.setdefault(p, []).append(q)
    rings = []
    while ahead:
        start = next(iter(ahead))
        ring, at, before = [start], start, None
        while True:
            choices = ahead[at]
            if len(choices) > 1 and before is not None:  # the sharpest turn to the left keeps rings simple
                back = math.atan2(before[1] - at[1], before[0] - at[0])
                choices.sort(key=lambda q: (back - math.atan2(q[1] - at[1], q[0] - at[0])) % (2 * math.pi))
            nxt = choices.pop(0)
            if not choices:
                del ahead[at]
            before, at = at, nxt
            ring.append(at)
            if at == start:
                break
            if at not in ahead:
                ring = []
                break
        if len(ring) > 3:
            slim = [p for i, p in enumerate(ring[:-1]) if abs(_turn(ring[i - 1] if i else ring[-2], p, ring[i + 1])) > 1e-12]
            if len(slim) > 2:
                rings.append([list(p) for p in [*slim, slim[0]]])
    shells, holes = [r for r in rings if _signed(r) > 0], [r for r in rings if _signed(r) < 0]
    polygons = [[s, *(h for h in holes if _where([(h[0][0] + h[1][0]) / 2, (h[0][1] + h[1][1]) / 2], [s]) >= 0)] for s in shells]
    return ("POLYGON", polygons[0] if polygons else []) if len(polygons) < 2 else ("MULTIPOLYGON", polygons)


def st_overlay(a, b, how: str) -> Column:
    @F.pandas_udf("string")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else to_wkt(overlay(parse_wkt(p), parse_wkt(q), how)) for p, q in zip(x, y, strict=True)])

    return run(col(a), col(b))


def relate(a, b) -> str:
    """Which of the named predicates hold, in alphabetical order."""
    return ",".join(n for n in sorted(PREDICATES) if PREDICATES[n](a, b))


# ---- tiles, rasters, places
def tile_of(lon, lat, zoom: int) -> tuple[Column, Column]:
    """Web-Mercator tile column and row of points."""
    n = float(2**zoom)
    y = (1 - F.log(F.tan(F.radians(col(lat))) + 1 / F.cos(F.radians(col(lat)))) / F.pi()) / 2 * n
    return F.floor((col(lon) + 180) / 360 * n).cast("int"), F.floor(y).cast("int")


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        out.append(n & 127 | (128 if n > 127 else 0))
        n >>= 7
        if not n:
            return bytes(out)


def _field(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def encode_tile(layer: str, points: list[tuple[int, int, int]], extent: int = 4096) -> bytes:
    """A vector tile with one layer of points (id, x, y in tile units)."""
    zig = lambda v: (v << 1) ^ (v >> 63)
    features = b""
    for ident, x, y in points:
        geometry = b"".join(map(_varint, (9, zig(x), zig(y))))
        features += _field(2, _varint(1 << 3) + _varint(ident) + _varint(3 << 3) + _varint(1) + _field(4, geometry))
    body = _field(1, layer.encode()) + features + _varint(5 << 3) + _varint(extent) + _varint(15 << 3) + _varint(2)
    return _field(3, body)


def tiles(points: DataFrame, ident: str, zoom: int, layer: str = "points", extent: int = 4096, most: int = 100_000) -> DataFrame:
    """x, y, part, features, tile of every tile that has points (lon, lat).

    Points of a tile are dealt to parts of about ``most``, each a whole tile message;
    messages may be put one after the other, so a crowded tile never gathers in one task.
    """
    x, y = tile_of("lon", "lat", zoom)
    n = float(2**zoom)
    px = F.floor(((F.col("lon") + 180) / 360 * n - F.col("x")) * extent).cast("int")
    py = F.floor(((1 - F.log(F.tan(F.radians("lat")) + 1 / F.cos(F.radians("lat"))) / F.pi()) / 2 * n - F.col("y")) * extent).cast("int")
    placed = points.withColumns({"x": x, "y": y}).select("x", "y", F.struct(F.col(ident).cast("long").alias("id"), px.alias("px"), py.alias("py")).alias("p"))
    parts = placed.groupBy("x", "y").agg(F.ceil(F.count("*") / most).alias("parts"))
    dealt = placed.join(parts, ["x", "y"]).withColumn("part", F.pmod(F.xxhash64("p"), F.col("parts")).cast("int"))
    counted = dealt.groupBy("x", "y", "part").agg(F.count("*").alias("features"), F.sort_array(F.collect_list("p")).alias("ps"))

    @F.pandas_udf("binary")
    def encode(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: encode_tile(layer, [(int(p["id"]), int(p["px"]), int(p["py"])) for p in r], extent))

    return counted.select("x", "y", "part", "features", encode("ps").alias("tile"))


def raster_slope(grid: list[list[float]], step: float, row: int, column: int) -> float:
    """Steepness in degrees at a cell, by central differences (one-sided at the rim)."""
    h, w = len(grid), len(grid[0])
    x0, x1, y0, y1 = max(0, column - 1), min(w - 1, column + 1), max(0, row - 1), min(h - 1, row + 1)
    dx = (grid[row][x1] - grid[row][x0]) / ((x1 - x0) * step)
    dy = (grid[y1][column] - grid[y0][column]) / ((y1 - y0) * step)
    return math.degrees(math.atan(math.hypot(dx, dy)))


def zonal_mean(grid: list[list[float]], x0: float, y0: float, step: float, zone) -> Column:
    """Mean of the cells whose middle lies in each zone (WKT), null without one."""

    @F.pandas_udf("double")
    def run(zones: pd.Series) -> pd.Series:
        def one(text):
            g = parse_wkt(text)
            found = [v for j, r in enumerate(grid) for i, v in enumerate(r) if _place([x0 + i * step, y0 + j * step], g) >= 0]
            return sum(found) / len(found) if found else None

        return zones.map(lambda t: None if t is None else one(t))

    return run(col(zone))


def travel_matrix(edges: list[tuple[str, str, float]], starts: list[str], ends: list[str]) -> list[tuple[str, str, float | None]]:
    return [(s, e, found[e][0] if e in found else None) for s in starts for found in [shortest_paths(edges, s)] for e in ends]


def optimize_route(edges: list[tuple[str, str, float]], start: str, stops: list[str]) -> tuple[float, list[str]]:
    """A round of all stops: nearest first, then pairs of legs are turned while that helps."""
    cost = {a: {b: c for b, (c, _) in shortest_paths(edges, a).items()} for a in (start, *stops)}
    order, left = [start], set(stops)
    while left:
        nearest = min(sorted(left), key=lambda b: cost[order[-1]].get(b, math.inf))
        order.append(nearest)
        left.remove(nearest)
    total = lambda o: sum(cost[a].get(b, math.inf) for a, b in zip(o, o[1:], strict=False))
    better = True
    while better:
        better = False
        for i in range(1, len(order) - 1):
            for j in range(i + 1, len(order)):
                turned = order[:i] + order[i : j + 1][::-1] + order[j + 1 :]
                if total(turned) < total(order) - 1e-12:
                    order, better = turned, True
    return total(order), order


def geocode(places: DataFrame, name: str, text: str, k: int = 5) -> DataFrame:
    """The ``k`` places whose names share most words with ``text``; of equals the shorter name first."""
    words = [w for w in re.findall(r"\w+", text.lower()) if w]
    own = F.array_distinct(F.regexp_extract_all(F.lower(F.col(name)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    score = F.size(F.array_intersect(own, F.array(*map(F.lit, words)))) / F.lit(max(1, len(words)))
    return places.withColumn("score", score).filter("score > 0").orderBy(F.col("score").desc(), F.length(name), name).limit(k)


def reverse_geocode(places: DataFrame, lon: float, lat: float, k: int = 1) -> DataFrame:
    """The ``k`` nearest places (lon, lat) with their distance in metres."""
    return places.withColumn("metres", metres(F.lit(lon), F.lit(lat), "lon", "lat")).orderBy("metres", *[c for c in places.columns if c not in ("lon", "lat")]).limit(k)


# ---- H3 cell names (15 hexadecimal digits): what can be told from the name alone
def h3_resolution(cell) -> Column:
    return F.conv(F.substring(col(cell), 2, 1), 16, 10).cast("int")


def h3_parent(cell, resolution: int) -> Column:
    """The cell of a coarser resolution that holds this one: finer digits are filled with sevens; a finer resolution is an error."""
    number = F.conv(col(cell), 16, 10).cast("bigint")
    fill = (1 << (3 * (15 - resolution))) - 1
    cleared = number.bitwiseAND(F.lit(~(0xF << 52)))
    parent = cleared.bitwiseOR(F.lit(resolution << 52)).bitwiseOR(F.lit(fill))
    finer = F.raise_error(F.lit("parent resolution is finer than the cell's")).cast("string")
    return F.when(h3_resolution(cell) < resolution, finer).otherwise(F.lower(F.hex(parent)))
