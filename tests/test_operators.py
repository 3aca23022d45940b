import collections
import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lodewright.operators import changes, cubes, fulltext, graph, hierarchy, spatial, temporal, vectors


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# ---- cubes
@pytest.fixture(scope="module")
def sales(spark):
    return spark.range(400).select((F.col("id") % 2).alias("region"), (F.col("id") % 4).alias("category"), (F.col("id") % 15).alias("host"), (F.col("id") * 1.5).alias("price"), F.col("id").alias("receipt"))


def test_cube_laws(spark, sales):
    make = lambda df: cubes.create("c", df, ["region", "category"], ["price"], ["host"], ["price"], position="receipt")
    whole = make(sales)
    merged = cubes.merge(make(sales.filter("receipt < 150")), make(sales.filter("receipt >= 150")))
    shown = lambda c: rows(c.relation().select("region", "category", "count", "sum_price", "avg_price", "distinct_host"), "region", "category")
    assert shown(whole) == shown(merged) and merged.position == 149
    coarse = cubes.rollup(whole, {"category": cubes.WHOLE})
    native = cubes.create("n", sales, ["region"], ["price"], ["host"], ["price"])
    assert rows(coarse.relation().select("region", "count", "sum_price", "distinct_host"), "region") == rows(native.relation().select("region", "count", "sum_price", "distinct_host"), "region")
    assert abs(coarse.relation().first()["p50_price"] - 299) < 20
    old = make(sales.filter("receipt < 100"))
    assert shown(cubes.refresh(old, sales, "receipt")) == shown(whole)
    with pytest.raises(ValueError, match="same dimensions"):
        cubes.merge(whole, native)


def test_cube_refuses_cells_as_many_as_rows(spark):
    df = spark.range(5000).select("id", F.lit(1).alias("x"))
    with pytest.raises(ValueError, match="force"):
        cubes.create("bad", df, ["id"], ["x"])
    assert cubes.create("ok", df, ["id"], ["x"], force=True).parts.count() == 5000


# ---- full text
@pytest.fixture(scope="module")
def pages(spark):
    docs = spark.createDataFrame([(1, "The quick brown fox jumps"), (2, "quick quick foxes are brown"), (3, "lazy dogs sleep"), (4, ""), (5, None)], "id int, body string")
    return docs, fulltext.postings(docs, "id", "body"), fulltext.postings(docs, "id", "body", "english")


@pytest.mark.parametrize(
    ("query", "found"),
    [("quick & brown", [1, 2]), ("quick <-> brown", [1]), ("quick <2> fox", [1]), ("fox:*", [1, 2]), ("!quick", [3, 4, 5]), ("lazy | fox", [1, 3]), ("quick & !fox", [2]), ("!(quick | lazy)", [4, 5])],
)
def test_matching(pages, query, found):
    docs, posted, _ = pages
    assert [r[0] for r in rows(fulltext.match(docs, posted, "id", fulltext.parse(query)), "doc")] == found


def test_english_stems_and_ranks(pages):
    docs, _, posted = pages
    assert [r[0] for r in rows(fulltext.match(docs, posted, "id", fulltext.plain("the foxes", "english")), "doc")] == [1, 2]
    assert [fulltext.stem(w) for w in ("foxes", "running", "hopping", "relational", "cats", "caresses", "happiness")] == ["fox", "run", "hop", "relat", "cat", "caress", "happi"]
    ranked = dict(rows(fulltext.ts_rank(pages[1], ["quick"])))
    assert ranked[1] == pytest.approx(0.1 / 1.6449341) and ranked[2] == pytest.approx(0.1 * 1.25 / 1.6449341)
    halved = dict(rows(fulltext.ts_rank(pages[1], ["quick"], 2)))
    assert halved[1] == pytest.approx(ranked[1] / 5)
    assert rows(fulltext.bm25(pages[1], ["quick"], 1))[0][0] == 2
    with pytest.raises(ValueError):
        fulltext.parse("a &")


# ---- vectors
def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, [0.0, 0.0])], "id int, v array<float>")
    assert [r[0] for r in rows(vectors.top_k(v, "id", "v", [1.0, 0.1], 3))] == [1, 2, 3]
    assert rows(vectors.top_k(v, "id", "v", [0.0, 1.0], 1, "dot")) == [(3, 2.0)]
    assert dict(rows(vectors.top_k(v, "id", "v", [1.0, 0.0], 4)))[4] == 0.0
    with pytest.raises(ValueError):
        vectors.top_k(v, "id", "v", [], 1)
    with pytest.raises(Exception, match="dimensions differ"):
        vectors.top_k(v, "id", "v", [1.0], 1).collect()


# ---- graph
def test_graph(spark):
    visits = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "y")], "visit_id int, patient_id string, doctor_id string")
    g = graph.build([], [(visits, "visit_id", "Visit", "patient_id", "Patient", "of"), (visits, "visit_id", "Visit", "doctor_id", "Doctor", "with")])
    assert [r[0] for r in rows(g.neighbors("Patient:a"))] == ["Visit:1", "Visit:2"]
    assert g.path("Patient:a", "Patient:b", 4) == ["Patient:a", "Visit:2", "Doctor:y", "Visit:3", "Patient:b"] and g.path("Patient:a", "Patient:b", 3) == []
    assert g.path("Patient:a", "Patient:a", 0) == ["Patient:a"] and g.path("Patient:zz", "Patient:a", 3) == []
    assert rows(g.traverse("Visit:1", "of", 2), "id") == [("Patient:a", 1)] and rows(g.traverse("Visit:1", None, 0)) == [("Visit:1", 0)]
    assert g.verify(g).count() == 0 and graph.label_of("patient_id") == "Patient"


def test_connect_by(spark):
    t = spark.createDataFrame([(1, None, "r"), (2, 1, "b"), (3, 1, "a"), (4, 2, "c")], "id int, up int, name string")
    found = rows(hierarchy.connect_by(t, "id", "up", F.col("up").isNull(), siblings=["name"]).select("id", "level"))
    assert found == [(1, 1), (3, 2), (2, 2), (4, 3)]
    loop = spark.createDataFrame([(1, 2), (2, 1)], "id int, up int")
    with pytest.raises(ValueError, match="CONNECT BY loop"):
        hierarchy.connect_by(loop, "id", "up", F.col("id") == 1)
    assert rows(hierarchy.connect_by(loop, "id", "up", F.col("id") == 1, nocycle=True).select("id", "level", "iscycle")) == [(1, 1, 0), (2, 2, 1)]


# ---- time
def test_history(spark):
    log = spark.createDataFrame([("a", 10, "U", 1), ("a", 20, "U", 2), ("a", 30, "D", 2), ("b", 15, "U", 9)], "k string, at long, op string, v int")
    h = temporal.history(log, "k", "at", "op", ["v"])
    assert rows(temporal.as_of(h, 25), "k") == [("a", 2), ("b", 9)] and rows(temporal.as_of(h, 30), "k") == [("b", 9)] and rows(temporal.flashback(h, 12)) == [("a", 1)]
    assert rows(temporal.versions_between(h, 15, 40), "k", "versions_operation", "versions_startscn") == [("a", 2, 30, None, "D"), ("a", 1, None, 20, "U"), ("a", 2, 20, 30, "U"), ("b", 9, 15, None, "U")]


def test_series_and_batch(spark):
    raw = spark.createDataFrame([("r1", 5, json.dumps({"metric": "hr", "value": 3, "device_id": "d"})), ("r2", None, json.dumps({"metric": "hr", "value": "4"})), ("r3", None, json.dumps({"timestamp": 9, "metric": "hr", "value": 7.5})), ("r4", None, None)], "id string, ts long, meta string")
    b = temporal.analytics_batch(raw, "id", "ts", "meta")
    assert rows(b.select("record_id", "timestamp", "value", "metadata_json"), "record_id")[1:] == [("r2", None, None, json.dumps({"metric": "hr", "value": "4"})), ("r3", 9, 7.5, raw.collect()[2]["meta"]), ("r4", None, None, "{}")]
    assert rows(temporal.series_summary(b, 5, 9, "hr")) == [(2, 3.0, 7.5, 5.25)] and rows(temporal.series_summary(b, 100, 200)) == [(0, None, None, None)]
    assert temporal.checksum(raw, ["id"]).first() == temporal.checksum(raw.repartition(3), ["id"]).first() != temporal.checksum(raw.limit(3), ["id"]).first()


# ---- writes
def test_writes(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    s = spark.createDataFrame([(2, "B"), (3, "C"), (3, "D")], "id int, x string")
    assert len(rows(changes.insert_on_conflict(t, s, ["id"]), "id")) == 3 and rows(changes.insert_on_conflict(t, s, ["id"]), "id")[1] == (2, "b")
    assert rows(changes.insert_on_conflict(t, s, ["id"]), "id")[2] == (3, "C")
    assert rows(changes.insert_on_conflict(t, s.filter("x <> 'D'"), ["id"], {"x": F.col("excluded_x")}, F.col("x") == "zzz"), "id")[1] == (2, "b")
    with pytest.raises(Exception, match="second time"):
        changes.insert_on_conflict(t, s, ["id"], {"x": F.col("excluded_x")}).collect()
    loose = spark.createDataFrame([(None, "n"), (None, "n")], "id int, x string")
    assert changes.insert_on_conflict(t, loose, ["id"]).count() == 4
    left, gone = changes.returning(t, F.col("id") == 2)
    assert rows(left) == [(1, "a")] and rows(gone) == [(2, "b")]
    assert rows(changes.merge_update(t, s.limit(1), ["id"], {"x": F.col("s_x")}), "id") == [(1, "a"), (2, "B")]
    with pytest.raises(Exception, match="second time"):
        changes.merge_update(t.unionByName(spark.createDataFrame([(3, "c")], "id int, x string")), s, ["id"], {"x": F.col("s_x")}).collect()
    bad = spark.createDataFrame([(1, 5, 1), (1, None, 9), (None, -2, None)], "id int, n int, ref int")
    parent = spark.createDataFrame([(1,)], "pk int")
    assert sorted(rows(changes.violations(bad, ["id"], [["id"]], {"positive": F.col("n") > 0}, [("ref", parent, "pk")]))) == [("check positive", 1), ("foreign key ref", 1), ("not null id", 1), ("unique id", 2)]
    spans = spark.createDataFrame([(1, "r", 0, 10), (2, "r", 5, 7), (3, "r", 10, 12), (4, "s", 0, 99)], "id int, room string, lo int, hi int")
    assert rows(changes.exclusion_violations(spans, ["room"], "lo", "hi", "id")) == [(2,)]
    with pytest.raises(Exception, match="no partition"):
        t.select(changes.range_partition(F.col("id"), [("low", None, 2)])).collect()


# ---- spatial
SQUARE, INNER, APART, EDGE = "POLYGON((0 0,10 0,10 10,0 10,0 0))", "POLYGON((2 2,4 2,4 4,2 4,2 2))", "POLYGON((20 0,30 0,30 10,20 10,20 0))", "POLYGON((10 0,20 0,20 10,10 10,10 0))"
HALF = "POLYGON((5 5,15 5,15 15,5 15,5 5))"


@pytest.mark.parametrize(
    ("name", "a", "b", "want"),
    [
        ("intersects", SQUARE, INNER, True), ("intersects", SQUARE, APART, False), ("disjoint", SQUARE, APART, True), ("within", INNER, SQUARE, True), ("within", SQUARE, INNER, False), ("touches", SQUARE, EDGE, True), ("touches", SQUARE, HALF, False), ("overlaps", SQUARE, HALF, True),
        ("overlaps", SQUARE, INNER, False), ("covers", SQUARE, INNER, True), ("equals", SQUARE, "POLYGON((10 0,10 10,0 10,0 0,10 0))", True), ("crosses", "LINESTRING(-5 5,5 5)", SQUARE, True), ("crosses", "LINESTRING(1 1,2 2)", SQUARE, False), ("intersects", "POINT(10 5)", SQUARE, True),
        ("within", "POINT(10 5)", SQUARE, False), ("coveredby", "POINT(10 5)", SQUARE, True), ("touches", "POINT(10 5)", SQUARE, True), ("crosses", "LINESTRING(0 0,2 2)", "LINESTRING(0 2,2 0)", True), ("contains", SQUARE, "LINESTRING(1 1,2 2)", True),
    ],
)
def test_predicates(name, a, b, want):
    assert spatial.PREDICATES[name](spatial.parse_wkt(a), spatial.parse_wkt(b)) is want


@pytest.mark.parametrize("text", ["POINT(1 2.5)", "LINESTRING(0 0,1 1)", SQUARE, "MULTIPOINT(1 2,3 4)", "MULTIPOLYGON(((0 0,1 0,1 1,0 0)))", "GEOMETRYCOLLECTION(POINT(1 2),LINESTRING(0 0,1 1))", "POINT EMPTY"])
def test_codecs_round_trip(text):
    g = spatial.parse_wkt(text)
    assert spatial.to_wkt(g) == text and spatial.to_wkt(spatial.parse_wkb(spatial.to_wkb(g))) == text and spatial.to_wkt(spatial.parse_wkb(spatial.to_wkb(g, 4326))) == text
    if "EMPTY" not in text:
        assert spatial.to_wkt(spatial.parse_geojson(spatial.to_geojson(g))) == text


def test_codecs_refuse():
    for bad in ("SRID=3857;POINT(1 2)", "POINT(1 2 3)", "CIRCLE(1 2)"):
        with pytest.raises(ValueError):
            spatial.parse_wkt(bad)


def test_measures_and_routes():
    degree = spatial.parse_wkt("POLYGON((0 0,1 0,1 1,0 1,0 0))")
    assert spatial.area(degree) == pytest.approx(1.2364e10, rel=2e-3) and spatial.centroid(degree)[1] == [0.5, 0.5]
    assert spatial.haversine((0, 0), (1, 0)) == pytest.approx(111195, rel=1e-4)
    assert spatial.hull(spatial.parse_wkt("MULTIPOINT(0 0,2 0,1 1,2 2,0 2)"))[1][0][:-1] == [[0, 0], [2, 0], [2, 2], [0, 2]]
    assert spatial.simplify(spatial.parse_wkt("LINESTRING(0 0,1 0.01,2 0)"), 0.1)[1] == [[0, 0], [2, 0]]
    assert spatial.area(spatial.buffer(spatial.parse_wkt("POINT(10 50)"), 1000)) == pytest.approx(3.1416e6, rel=0.02)
    roads = [("a", "b", 2.0), ("b", "c", 2.0), ("a", "c", 5.0)]
    assert spatial.shortest_paths(roads, "a")["c"] == (4.0, ["a", "b", "c"]) and spatial.isochrone(roads, "a", 2.5) == [("a", 0.0), ("b", 2.0)]


@pytest.mark.parametrize(
    ("other", "how", "area"),
    [(HALF, "union", 175), (HALF, "intersection", 25), (HALF, "difference", 75), (INNER, "difference", 96), (INNER, "intersection", 4), (INNER, "union", 100), (EDGE, "union", 200), (EDGE, "intersection", 0), (APART, "union", 200), (APART, "difference", 100), (SQUARE, "difference", 0), (SQUARE, "union", 100)],
)
def test_overlays(other, how, area):
    a, b = spatial.parse_wkt(SQUARE), spatial.parse_wkt(other)
    found = spatial.overlay(a, b, how)
    planar = sum(abs(spatial._signed(p[0])) - sum(abs(spatial._signed(h)) for h in p[1:]) for p in spatial._polygons(found))
    assert planar == pytest.approx(area)
    with pytest.raises(ValueError):
        spatial.overlay(spatial.parse_wkt("POINT(1 1)"), b, how)


def test_tiles_routes_rasters(spark):
    tile = spatial.encode_tile("l", [(7, 10, 20)])
    assert tile[0] == 0x1A and b"l" in tile
    roads = [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 5.0)]
    assert spatial.travel_matrix(roads, ["a"], ["c", "zz"]) == [("a", "c", 2.0), ("a", "zz", None)]
    assert spatial.optimize_route(roads, "a", ["c", "b"]) == (2.0, ["a", "b", "c"])
    assert spatial.raster_slope([[0.0, 1.0, 2.0]] * 3, 1.0, 1, 1) == pytest.approx(45.0)
    with pytest.raises(Exception, match="no route"):
        spark.range(1).select(spatial.travel_time(roads, F.lit("a"), F.lit("zz"))).collect()


def test_hashed_search_finds_most(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    near = vectors.lsh_top_k(e, e.filter("vec_id < 30"), "vec_id", "embedding", "vec_id", "embedding", 5, 64, bits=4, tables=12)
    exact = vectors.batch_top_k(e, e.filter("vec_id < 30"), "vec_id", "embedding", "vec_id", "embedding", 5)
    assert near.join(exact, ["query", "vec_id"], "left_semi").count() > 0.5 * exact.count()


def test_hashed_search_sends_no_pairs_and_holds_against_codes(spark):
    draw = random.Random(3)
    rows = [(i, [draw.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(300, None), (301, [1.0] * 7 + [None]), (302, [float("nan")] * 8), (303, [0.0] * 8)]
    v = spark.createDataFrame(rows, "i long, v array<float>").repartition(3)
    asked = v.filter("i % 7 = 0")
    found = vectors.lsh_top_k(v, asked, "i", "v", "i", "v", 4, 8, bits=4, tables=3, block=11)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    whole = v.filter("i < 300 OR i = 303").select("i", "v", vectors.hyperplane_codes(F.col("v"), 8, 4, 3).alias("codes"))
    coded = {r["i"]: r["codes"] for r in whole.collect()}
    pairs = asked.filter("i < 300").select(F.col("i").alias("query"), F.col("v").alias("q")).crossJoin(whole).select("query", "i", vectors.cosine(F.col("v"), F.col("q")).alias("score")).collect()
    near = collections.defaultdict(list)
    for p in pairs:
        if any(a == b for a, b in zip(coded[p["query"]], coded[p["i"]], strict=True)):
            near[p["query"]].append((-p["score"], p["i"]))
    want = {(q, i, -s, n) for q, hits in near.items() for n, (s, i) in enumerate(sorted(hits)[:4], 1)}
    assert {(r["query"], r["i"], r["score"], r["rank"]) for r in found.collect()} == want and len(want) > 150
    with pytest.raises(Exception, match="vector dimensions differ"):
        vectors.lsh_top_k(v.union(spark.createDataFrame([(999, [1.0])], v.schema)), asked, "i", "v", "i", "v", 4, 8).collect()


@pytest.mark.parametrize("config", ["simple", "english"])
def test_postings_group_tokens_within_rows(spark, config):
    """Repeated, missing and null ids and texts, two fields; tokens are not shuffled one by one."""
    texts = [(1, "The foxes, the FOX", "a fox"), (1, "fox again", None), (2, None, "foxes"), (None, "x fox", ""), (3, "", "!"), (4, "b " * 500 + "a", "b")]
    posted = fulltext.postings(spark.createDataFrame(texts, "i long, t string, h string"), "i", {"D": "t", "A": "h"}, config)
    plan = posted._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(doc#\w+, term", plan) and "hashpartitioning(doc" in plan
    want = collections.defaultdict(list)
    for doc, *own in texts:
        for label, text in zip("DA", own, strict=True):
            for n, w in enumerate(re.findall(r"\w+", (text or "").lower()), 1):
                if config == "simple" or w not in fulltext.STOP:
                    want[doc, fulltext.stem(w) if config == "english" else w, label].append(n)
    got = posted.collect()
    assert {(r["doc"], r["term"], r["weight"]): (r["tf"], r["positions"]) for r in got} == {k: (len(v), sorted(v)) for k, v in want.items()} and len(got) == len(want)


@pytest.mark.parametrize("config", ["simple", "english"])
def test_postings_shuffle_texts_alone(spark, config):
    """Texts are shuffled once and as they are; words are stemmed and grouped after that, outside expressions, over many small batches; repeated ids."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "2k")
    try:
        texts = [(i % 150, " ".join(f"{'running foxes the ran'.split()[(i * j) % 4]} w{(i + j * j) % 23}_" for j in range(i % 60))) for i in range(400)]
        posted = fulltext.postings(spark.createDataFrame(texts, "i int, t string"), "i", "t", config)
        plan = posted._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "term" not in plan.split("Exchange", 1)[1] and "sort_array" not in plan and spark.conf.get(key) == "2k"
        want = collections.defaultdict(list)
        for doc, text in texts:
            for n, w in enumerate(text.split(), 1):
                if config == "simple" or w not in fulltext.STOP:
                    want[doc, fulltext.stem(w) if config == "english" else w].append(n)
        got = posted.collect()
        assert {(r["doc"], r["term"]): (r["tf"], r["positions"]) for r in got} == {k: (len(v), sorted(v)) for k, v in want.items()} and len(got) == len(want)
        spark.conf.set(key, "1g")
        fulltext.postings(posted.select("doc", "term"), "doc", "term", config)
        assert spark.conf.get(key) == str(8 << 20)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@pytest.mark.parametrize("fields, config", [("t", "simple"), ("t", "english"), ({"D": "t", "A": "h"}, "simple")])
def test_parts_of_an_index_follow_its_texts(spark, tmp_path, monkeypatch, fields, config):
    """A million bytes of copies in a file of a few thousand: as many parts as their texts ask for, though the file is small; a text that is null, and no row at all."""
    monkeypatch.setattr(fulltext, "LANE_BYTES", 1 << 16)
    copies = spark.range(1000).select("id", F.when(F.col("id") != 7, F.lit("running foxes " * 75)).alias("t"), F.lit("a title").alias("h"))
    copies.coalesce(1).write.parquet(str(tmp_path / "copies"))
    docs = spark.read.parquet(str(tmp_path / "copies"))
    assert sum(f.stat().st_size for f in (tmp_path / "copies").glob("*.parquet")) < fulltext.LANE_BYTES
    posted = fulltext.postings(docs, "id", fields, config)
    assert posted.rdd.getNumPartitions() == -(-(999 * 1050 + 1000 * 7 * (fields != "t")) // fulltext.LANE_BYTES)
    assert posted.groupBy(F.spark_partition_id()).count().count() > 8 and posted.filter("weight = 'D'").select(F.sum("tf")).first()[0] == 999 * 150
    assert fulltext.postings(docs.filter("id < 0"), "id", fields, config).collect() == []


def test_members_of_sparse_sets_take_no_look_at_each_bit(spark):
    """One document in each of 3,000 buckets, at both ends of pieces and bytes."""
    ids = [n * 32768 + (n * 511) % 32768 for n in range(-10, 3000)]
    bits = fulltext.bitmap(spark.createDataFrame([(i,) for i in ids], "doc long"))
    begun = time.monotonic()
    assert sorted(r[0] for r in fulltext.members(bits).collect()) == sorted(ids) and time.monotonic() - begun < 20


def test_graph_walks_and_nodes_need_no_distinct_edges(spark):
    links = spark.createDataFrame([(1, 10), (1, 10), (2, 10), (2, None), (3, 11)], "a long, b long")
    g = graph.build([(spark.createDataFrame([(1,), (1,), (9,)], "k long"), "k", "A")], [(links, "a", "A", "b", "B", "has")])
    plan = g.nodes._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(source#\w+, target", plan)
    assert g.links.count() == 4 and g.edges.count() == 3 and "Exchange" not in g.links._jdf.queryExecution().executedPlan().toString()
    assert rows(g.nodes, "id") == [("A:1", "A"), ("A:2", "A"), ("A:3", "A"), ("A:9", "A"), ("B:10", "B"), ("B:11", "B")]
    assert g.path("A:1", "A:2", 2) == ["A:1", "B:10", "A:2"] and g.path("A:1", "A:3", 4) == [] and rows(g.neighbors("B:10")) == [("A:1",), ("A:2",)]


def test_page_cursor_counts_frequencies_once(spark, sf):
    from lodewright.plans import catalog

    assert all("frequencies" in f for f in catalog.queries()["fts_page_cursor"](spark, sf).inputFiles())


def test_points_of_one_cell_are_dealt_to_tasks(spark, monkeypatch):
    """One crowded place, repeated ids among its points; pairs are those of a plain loop, each once, from several tasks."""
    monkeypatch.setattr(spatial, "PAIRS", 500)
    a = [(i % 90, 8.0 + i * 1e-5, 50.0) for i in range(100)]
    b = [(i, 8.0, 50.0 + i * 1e-5) for i in range(60)]
    df = lambda rows, k: spark.createDataFrame(rows, f"{k} long, lon double, lat double")
    got = spatial.within_distance_join(df(a, "i"), df(b, "j"), "i", "j", 50)
    parts = got.withColumn("task", F.spark_partition_id()).collect()
    want = sorted((i, j) for i, x, y in a for j, u, v in b if spatial.haversine((x, y), (u, v)) <= 50)
    assert sorted((r["a"], r["b"]) for r in parts) == want and len({r["task"] for r in parts}) > 2
