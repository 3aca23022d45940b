"""Queries that SQL cannot say, held against plain Python over the same tables."""

import collections
import heapq
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodewright.operators import fulltext
from lodewright.plans import catalog
from lodewright.streaming.broker import Queue

QUERIES = catalog.queries()


def rows(spark, sf, table):
    return [r.asDict() for r in spark.read.parquet(f"{sf}/{table}.parquet").collect()]


def test_multisets(spark, sf):
    for r in QUERIES["fn_multisets"](spark, sf).collect():
        k = r["n_nationkey"]
        a, b = collections.Counter([k % 2, k % 2, k % 3]), collections.Counter([k % 2, 1])
        assert collections.Counter(r["u"]) == a + b and collections.Counter(r["i"]) == a & b and collections.Counter(r["e"]) == a - b


def test_sketches(spark, sf):
    cells = collections.defaultdict(list)
    for r in rows(spark, sf, "lineitem"):
        cells[r["l_returnflag"], r["l_linestatus"], r["l_shipdate"].strftime("%Y-%m")].append((r["l_suppkey"], r["l_extendedprice"]))
    found = QUERIES["cube_sketches"](spark, sf).collect()
    assert len(found) == len(cells)
    for r in found:
        own = cells[r["l_returnflag"], r["l_linestatus"], r["month"]]
        distinct, prices = len({s for s, _ in own}), sorted(p for _, p in own)
        assert abs(r["distinct_l_suppkey"] - distinct) <= max(1, 0.05 * distinct)
        assert r["p50_l_extendedprice"] == prices[math.ceil(len(prices) / 2) - 1]  # cells of fewer rows than the sketch are exact
    orders = collections.defaultdict(list)
    for r in rows(spark, sf.replace("sf0.001", "sf0.01"), "orders"):
        orders[r["o_orderpriority"]].append(r["o_totalprice"])
    for r in QUERIES["cube_sketch_percentile"](spark, sf.replace("sf0.001", "sf0.01")).collect():
        own = np.array(orders[r["o_orderpriority"]])
        assert len(own) > 1024 and abs((own <= r["p50_o_totalprice"]).mean() - 0.5) < 0.06


def test_path(spark, sf):
    near = collections.defaultdict(set)
    for r in rows(spark, sf, "orders"):
        near[f"Customer:{r['o_custkey']}"].add(f"Order:{r['o_orderkey']}")
    for r in rows(spark, sf, "lineitem"):
        near[f"Order:{r['l_orderkey']}"].add(f"Part:{r['l_partkey']}")
    for a in list(near):
        for b in list(near[a]):
            near[b].add(a)
    far, edge = {"Customer:7": 0}, ["Customer:7"]
    while edge:
        edge = [b for a in edge for b in near[a] if b not in far and far.setdefault(b, far[a] + 1)]
    (r,) = QUERIES["graph_path"](spark, sf).collect()
    assert r["hops"] == far["Customer:4"] == len(r["path"]) - 1 and r["path"][0] == "Customer:7" and r["path"][-1] == "Customer:4"
    assert all(b in near[a] for a, b in zip(r["path"], r["path"][1:], strict=False))


def test_travel_time(spark, sf):
    near = collections.defaultdict(list)
    for a, b, cost in [(i, (i * 3 + 1) % 25, 1.0 + i % 4) for i in range(25)] + [(i, i + 1, 5.0) for i in range(24)]:
        near[a].append((b, cost))
        near[b].append((a, cost))
    best, heap = {}, [(0.0, 0)]
    while heap:
        cost, a = heapq.heappop(heap)
        if a not in best:
            best[a] = cost
            for b, more in near[a]:
                heapq.heappush(heap, (cost + more, b))
    assert {r["n_nationkey"]: r["cost"] for r in QUERIES["spatial_travel_time"](spark, sf).collect()} == {k: best[k] for k in range(25)}


def ring(wkt):
    return [tuple(map(float, p.split())) for p in re.search(r"\(\(([^)]*)\)", wkt)[1].split(",")]


def test_measures(spark, sf):
    found = QUERIES["spatial_measures"](spark, sf).collect()
    assert len(found) == 25
    for r in found:
        k = r["n_nationkey"] + 1
        whole = 6371.0088**2 * math.radians(k) * math.sin(math.radians(10))
        assert r["km2"] == pytest.approx(whole, rel=0.02)
        x, y = map(float, re.findall(r"-?[0-9.]+", r["centre"]))
        assert abs(x - k / 2) < 0.1 and abs(y - 5) < 0.1
        assert sorted(set(ring(r["again"]))) == [(0, 0), (0, 10), (k, 0), (k, 10)] and '"Polygon"' in r["geojson"]


def test_shapes(spark, sf):
    for r in QUERIES["spatial_shapes"](spark, sf).collect():
        assert r["area"] == pytest.approx(math.pi * 1000**2, rel=0.03)
        hull, simple = ring(r["hull"]), ring(r["simple"])
        turns = [(b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0]) for a, b, c in zip(hull, hull[1:], [*hull[2:], hull[1]], strict=False)]
        assert (all(t > 0 for t in turns) or all(t < 0 for t in turns)) and hull[0] == hull[-1] and len(simple) <= len(hull) + 1


def test_english(spark, sf):
    want = set()
    stems = {fulltext.stem("rights"), fulltext.stem("reserved")}
    for r in rows(spark, sf, "documents"):
        words = {fulltext.stem(w) for w in re.findall(r"[^\W]+", (r["text"] or "").lower()) if w not in fulltext.STOP}
        if stems <= words:
            want.add(r["doc_id"])
    assert {r["doc"] for r in QUERIES["fts_english"](spark, sf).collect()} == want and want


def test_broker(spark, sf):
    queues, counts = {}, collections.defaultdict(collections.Counter)
    for r in sorted(rows(spark, sf, "events"), key=lambda r: r["event_id"]):
        kind = {"click": "publish", "view": "publish", "purchase": "publish", "signup": "consume"}.get(r["event_type"], "ack")
        name, now, worker = f"q{r['user_id'] % 10}", r["event_id"], f"w{r['user_id'] % 2}"
        q, n = queues.setdefault(name, Queue()), counts[name]
        if kind == "publish":
            q.publish(r["props"], now)
            n["published"] += 1
        elif kind == "consume":
            dead = len(q.dead)
            for m in q.consume(worker, now, 2):
                n["delivered"] += 1
                n["redelivered"] += m["attempts"] > 1
            n["dead"] += len(q.dead) - dead
        else:
            try:
                q.ack(worker, [math.floor(r["value"] % 5)], now)
                n["acked"] += 1
            except ValueError:
                pass
    for r in QUERIES["broker_replay"](spark, sf).collect():
        n = counts[r["queue"]]
        assert all(r[k] == n[k] for k in ("published", "delivered", "redelivered", "acked", "dead")) and r["lag"] == n["published"] - n["acked"] - n["dead"]


def test_hashed_search_finds_nine_in_ten(spark, sf):
    """As registered, over ids divisible by 50 of a larger table, the query itself not counted."""
    larger = sf.replace("sf0.001", "sf0.01")
    v = rows(spark, larger, "embeddings")
    x, ids = np.array([r["embedding"] for r in v], dtype=float), np.array([r["vec_id"] for r in v])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = collections.defaultdict(set)
    for r in QUERIES["vector_hashed"](spark, larger).collect():
        found[r["query"]].add(r["vec_id"])
    recall = []
    for q in np.flatnonzero(ids % 50 == 0):
        best = set(ids[np.argsort(-(x @ x[q]), kind="stable")[:5]]) - {ids[q]}
        recall.append(len(found[ids[q]] & best) / len(best))
    assert np.mean(recall) >= 0.9


def test_distances_across_180_degrees(spark):
    from lodewright.operators import spatial

    rng = np.random.default_rng(6)
    a = [(i, float(rng.uniform(-180, 180)), float(rng.uniform(-90, 90))) for i in range(150)] + [(200, 179.95, 0.0), (201, 10.0, 89.9), (202, -180.0, -60.0)]
    b = [(i, float(rng.uniform(-180, 180)), float(rng.uniform(-90, 90))) for i in range(150)] + [(200, -179.95, 0.0), (201, -170.0, 89.9), (202, 180.0, -60.0)]

    def metres(p, q):
        (x1, y1), (x2, y2) = (tuple(map(math.radians, t[1:])) for t in (p, q))
        return 2 * 6371008.8 * math.asin(min(1, math.sqrt(math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2)))

    left, right = spark.createDataFrame(a, "i long, lon double, lat double"), spark.createDataFrame(b, "j long, lon double, lat double")
    for far in (50_000, 1_500_000, 9_000_000):
        got = {(r["a"], r["b"]) for r in spatial.within_distance_join(left, right, "i", "j", far).collect()}
        assert got == {(p[0], q[0]) for p in a for q in b if metres(p, q) <= far}


def test_hash_against_plain_python(spark):
    from lodewright.functions import pg

    low = 0xFFFFFFFF
    turned = lambda x, k: ((x << k) | (x >> (32 - k))) & low

    def slow(text, seed):
        data = text.encode()
        w = dict.fromkeys("abc", (0x9E3779B9 + len(data) + 3923095) & low)

        def mix():
            for changed, other, by, grown, adds in pg.MIX:
                old = w[grown] + w[adds]
                w[changed] = ((w[changed] - w[other]) & low) ^ turned(w[other], by)
                w[grown] = old & low

        if seed:
            w["a"], w["b"] = (w["a"] + (seed >> 32)) & low, (w["b"] + (seed & low)) & low
            mix()
        while len(data) >= 12:
            for n, at in zip("abc", (0, 4, 8), strict=True):
                w[n] = (w[n] + int.from_bytes(data[at : at + 4], "little")) & low
            mix()
            data = data[12:]
        for n, at, shift in (("a", 0, 0), ("b", 4, 0), ("c", 8, 8)):
            w[n] = (w[n] + (int.from_bytes(data[at : at + 4], "little") << shift)) & low
        for changed, by, turn in pg.FINAL:
            w[changed] = ((w[changed] ^ w[by]) - turned(w[by], turn)) & low
        found = (w["b"] << 32) | w["c"]
        return found - (1 << 64) if found >> 63 else found

    texts = ["", "a", "tenant:key", "x" * 11, "x" * 12, "x" * 13, "Ünïcödé " * 9]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for seed in (0, 42, (1 << 64) - 1):
        assert [r[0] for r in df.select(pg.hash_text_extended("t", seed)).collect()] == [slow(t, seed) for t in texts]


def test_bitmaps(spark):
    a, b = {0, -5, 1, 8, 32767, 32768, 100_000}, {8, 9, 32768, 70_000, -5}
    bits = [fulltext.bitmap(spark.createDataFrame([(x,) for x in s], "doc long")) for s in (a, b)]
    assert {r[0] for r in fulltext.members(fulltext.intersection(*bits)).collect()} == a & b
    assert {r[0] for r in fulltext.members(fulltext.union(*bits)).collect()} == a | b


def test_cover_density():
    places = [(1, "a", 0.1), (4, "b", 0.1), (5, "a", 1.0), (9, "c", 0.4)]
    assert fulltext._covers(places[:3], {"a", "b"}) == pytest.approx(2 / 20 / 3 + 2 / 11)
    assert fulltext._covers([p for p in places if p[1] != "b"], {"a", "c"}) == pytest.approx(2 / 3.5 / 4) and fulltext._covers([], {"z"}) == 0


def read_tile(data):
    """Layers of a vector tile, read field by field: name, extent and (id, x, y) of the points."""

    def varint(b, at):
        value, shift = 0, 0
        while True:
            value |= (b[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if b[at - 1] < 128:
                return value, at

    def fields(b):
        at = 0
        while at < len(b):
            tag, at = varint(b, at)
            if tag & 7 == 2:
                size, at = varint(b, at)
                yield tag >> 3, b[at : at + size]
                at += size
            else:
                value, at = varint(b, at)
                yield tag >> 3, value

    layers = []
    for _, layer in fields(bytes(data)):
        own = list(fields(layer))
        points = []
        for _, feature in (f for f in own if f[0] == 2):
            parts = dict(fields(feature))
            numbers, at = [], 0
            while at < len(parts[4]):
                n, at = varint(parts[4], at)
                numbers.append(n)
            assert parts[3] == 1 and numbers[0] == 9
            points.append((parts[1], *((n >> 1) ^ -(n & 1) for n in numbers[1:])))
        layers.append((dict(own)[1].decode(), dict(own)[5], points))
    return layers


def test_tiles_read_back(spark):
    from lodewright.operators import spatial

    rng = np.random.default_rng(2)
    rows = [(i, float(rng.uniform(-180, 180)), float(rng.uniform(-80, 80))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, lon double, lat double")
    for most in (1000, 20):
        got = {}
        for r in spatial.tiles(df, "id", 2, most=most).collect():
            for name, extent, points in read_tile(r["tile"]):
                assert (name, extent, len(points)) == ("points", 4096, r["features"])
                for i, x, y in points:
                    got[i] = (r["x"], r["y"], x, y)
        want = {}
        for i, lon, lat in rows:
            fx, fy = (lon + 180) / 360 * 4, (1 - math.log(math.tan(math.radians(lat)) + 1 / math.cos(math.radians(lat))) / math.pi) / 2 * 4
            want[i] = (int(fx), int(fy), int((fx - int(fx)) * 4096), int((fy - int(fy)) * 4096))
        assert got == want


def test_travel_times_of_a_table(spark):
    from lodewright.operators import spatial

    rng = np.random.default_rng(4)
    roads = [(f"n{a}", f"n{b}", float(c)) for a, b, c in zip(rng.integers(0, 40, 90), rng.integers(0, 40, 90), rng.integers(1, 20, 90), strict=True)]
    found = spatial.travel_times(spark.createDataFrame(roads, "a string, b string, cost double"), spark.createDataFrame([("n0",), ("n5",)], "start string")).collect()
    for start in ("n0", "n5"):
        want = {n: c for n, (c, _) in spatial.shortest_paths(roads, start).items()}
        assert {r["node"]: r["cost"] for r in found if r["start"] == start} == want
