"""Further queries: views, functions, exports, overlays, tiles, routes, places, hashing search and row policies."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewright.functions import jsons, pg
from lodewright.operators import changes, spatial, temporal, vectors
from lodewright.plans.catalog import register
from lodewright.plans.scalars import read
from lodewright.plans.special import METRES, PLACE, _places
from lodewright.sources import files
from lodewright.storage import materialize, shared_dir


# ---- views and functions
@register("SELECT n_name AS nation, n_regionkey + 100 AS region_code FROM nation WHERE n_regionkey <> 2")
def view_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    read(spark, sf_dir, "nation").createOrReplaceTempView("nation_base")
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW nation_view (nation, region_code) AS SELECT n_name, n_regionkey + 100 FROM nation_base WHERE n_regionkey <> 2")
    return spark.table("nation_view")


@register("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey")
def view_materialized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")), "matview")


@register("SELECT p_partkey, p_retailprice * 1.25 + p_size AS priced FROM part")
def function_sql_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION priced(price DOUBLE, size INT) RETURNS DOUBLE RETURN price * 1.25 + size")
    read(spark, sf_dir, "part").createOrReplaceTempView("part_base")
    return spark.sql("SELECT p_partkey, priced(p_retailprice, p_size) AS priced FROM part_base")


@register("SELECT r_regionkey, n_name FROM region JOIN nation ON n_regionkey = r_regionkey")
def function_sql_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    read(spark, sf_dir, "nation").createOrReplaceTempView("nation_base")
    read(spark, sf_dir, "region").createOrReplaceTempView("region_base")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION nations_of(r INT) RETURNS TABLE (name STRING) RETURN SELECT n_name FROM nation_base WHERE n_regionkey = r")
    return spark.sql("SELECT r_regionkey, f.name AS n_name FROM region_base, LATERAL nations_of(r_regionkey) f")


@register("SELECT n_nationkey, unnest(range(0, n_nationkey % 4))::INT AS i FROM nation")
def function_python_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.udtf(returnType="i int")
    class Count:
        def eval(self, n: int):
            for i in range(n % 4):
                yield (i,)

    spark.udtf.register("count_up", Count)
    read(spark, sf_dir, "nation").createOrReplaceTempView("nation_base")
    return spark.sql("SELECT n_nationkey, c.i FROM nation_base, LATERAL count_up(n_nationkey) c")


@register("SELECT l_returnflag, round(sum(l_quantity * l_discount) / sum(l_discount), 6) AS weighted FROM lineitem GROUP BY l_returnflag")
def function_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = F.sum(F.col("l_quantity") * F.col("l_discount")) / F.sum("l_discount")
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(weighted, 6).alias("weighted"))


@register("SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN c_name ELSE substr(c_name, 1, 3) || '***' END AS c_name, NULL::DOUBLE AS c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 0 AND (c_nationkey = 3 OR c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1))")
def policy_row_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permissive policies are ORed, restrictive ones ANDed, for a role; masks replace fields."""
    from lodewright.operators.policies import Policies

    near = read(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    rules = Policies()
    rules.permit("clerk", F.col("c_nationkey") == 3)
    rules.permit("clerk", near, ["c_nationkey"])
    rules.permit("auditor", F.lit(True))
    rules.restrict("clerk", F.col("c_acctbal") > 0)
    rules.mask("clerk", "c_acctbal", F.lit(None))
    rules.mask("clerk", "c_name", F.when(F.col("c_nationkey") == 3, F.col("c_name")).otherwise(F.concat(F.substring("c_name", 1, 3), F.lit("***"))))
    return rules.read(read(spark, sf_dir, "customer"), "clerk").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


# ---- reading and writing
@register("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def copy_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    files.copy_to(read(spark, sf_dir, "nation"), path)
    return files.copy_from(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@register("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey > 12")
def export_json_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/json-{uuid.uuid4().hex}"
    files.export_json(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path, "n_nationkey", 12)
    return spark.read.schema("n_nationkey int, n_name string").json(path)


@register("SELECT count(*) AS rows FROM orders")
def sidecar_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    a, b = temporal.checksum(o, ["o_orderkey"]), temporal.checksum(o.repartition(3), ["o_orderkey"])
    return a.join(b, ["rows", "sha256"]).select("rows")


@register("SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT r_regionkey + 100, r_name FROM region UNION ALL SELECT s_suppkey + 1000, s_name FROM supplier WHERE s_acctbal > 0")
def insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INSERT ... SELECT, twice, into a written table."""
    path = f"{shared_dir(spark)}/target-{uuid.uuid4().hex}"
    read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")).write.parquet(path)
    spark.read.parquet(path).createOrReplaceTempView("insert_target")
    for table, select in (("region", "SELECT r_regionkey + 100L, r_name FROM insert_source"), ("supplier", "WITH big AS (SELECT * FROM insert_source WHERE s_acctbal > 0) SELECT s_suppkey + 1000L, s_name FROM big")):
        read(spark, sf_dir, table).createOrReplaceTempView("insert_source")
        files.insert_into(spark, path, spark.sql(select))
    return spark.read.parquet(path)


@register("SELECT count(*) FILTER (WHERE o_totalprice > 300000) AS deleted, round(sum(o_totalprice) FILTER (WHERE o_totalprice > 300000), 2) AS total, count(*) FILTER (WHERE NOT o_totalprice > 300000) AS rest FROM orders")
def cte_data_modifying(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WITH gone AS (DELETE ... RETURNING *) SELECT ... FROM gone: the returned rows feed the query, the rest is the new table."""
    left, gone = changes.returning(read(spark, sf_dir, "orders"), F.col("o_totalprice") > 300000)
    both = gone.select(F.lit(True).alias("gone"), "o_totalprice").unionByName(left.select(F.lit(False).alias("gone"), "o_totalprice"))
    return both.agg(F.count(F.when(F.col("gone"), 1)).alias("deleted"), F.round(F.sum(F.when(F.col("gone"), F.col("o_totalprice"))), 2).alias("total"), F.count(F.when(~F.col("gone"), 1)).alias("rest"))


@register("SELECT s_suppkey, round(s_acctbal * 1.1, 4) AS s_acctbal FROM supplier WHERE s_nationkey < 5")
def write_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UPDATE ... RETURNING."""
    _, changed = changes.returning(read(spark, sf_dir, "supplier"), F.col("s_nationkey") < 5, {"s_acctbal": F.col("s_acctbal") * 1.1})
    return changed.select("s_suppkey", F.round("s_acctbal", 4).alias("s_acctbal"))


@register("SELECT CASE WHEN o_totalprice < 100000 THEN 'low' ELSE 'high' END AS \"_from\", CASE WHEN p < 100000 THEN 'low' ELSE 'high' END AS \"_to\", count(*) AS n FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS p FROM orders) GROUP BY ALL")
def write_row_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that an UPDATE takes from one partition to another."""
    part = changes.range_partition(F.col("o_totalprice"), [("low", None, 100000)], "high")
    return changes.moved(read(spark, sf_dir, "orders"), part, F.col("o_orderstatus") == "F", {"o_totalprice": F.col("o_totalprice") * 2}).groupBy("_from", "_to").agg(F.count("*").alias("n"))


@register("SELECT o_orderkey FROM (SELECT *, max(hi) OVER (PARTITION BY o_custkey ORDER BY lo, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT o_orderkey, o_custkey, epoch(o_orderdate) AS lo, epoch(o_orderdate) + 8640000 AS hi FROM orders)) WHERE lo < before")
def write_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that would violate an exclusion of overlapping hundred days of one customer."""
    start = F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("double")
    return changes.exclusion_violations(read(spark, sf_dir, "orders").withColumns({"lo": start, "hi": start + 8640000}), ["o_custkey"], "lo", "hi", "o_orderkey")


@register("SELECT n_nationkey, n_regionkey AS r, 'none' AS tag FROM nation")
def json_populate_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a JSON object over a base record."""
    j = F.to_json(F.struct(F.col("n_regionkey").alias("r")))
    made = F.from_json(j, "r int, tag string")
    return read(spark, sf_dir, "nation").select("n_nationkey", F.coalesce(made["r"], F.lit(0)).alias("r"), F.coalesce(made["tag"], F.lit("none")).alias("tag"))


@register("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE CAST(json_extract(props, '$.k') AS INT) BETWEEN 10 AND 12")
def json_index_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by a cheap test on the text, then the exact path."""
    near = read(spark, sf_dir, "events").filter(F.col("props").contains('"k"'))
    return near.filter(jsons.path_exists("props", "$ ? (@.k >= 10 && @.k <= 12)")).select("event_id", jsons.get_text("props", "k").alias("k"))


@register("SELECT n_nationkey, '0190163d-8694-7' || lpad(lower(to_hex(n_nationkey)), 3, '0') || '-8000-000000000001' AS u, 7 AS version FROM nation")
def fn_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("{0190163D86947"), F.lpad(F.hex("n_nationkey"), 3, "0"), F.lit("8000000000000001}"))
    return read(spark, sf_dir, "nation").select("n_nationkey", pg.uuid_canonical(raw).alias("u"), pg.uuid_version(raw).alias("version"))


@register("SELECT o_orderstatus, round(sum(units)::DOUBLE / 100, 2) AS exact FROM (SELECT o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS units FROM orders) GROUP BY o_orderstatus")
def agg_exact_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = F.round(F.col("o_totalprice") * 100).cast("decimal(38,0)")
    return read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.round(F.sum(units).cast("double") / 100, 2).alias("exact"))


@register("SELECT l_returnflag, round(regr_slope(p, q), 6) AS slope FROM (SELECT DISTINCT l_returnflag, l_extendedprice AS p, l_quantity AS q FROM lineitem) GROUP BY l_returnflag")
def agg_regr_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity").distinct()
    return pairs.groupBy("l_returnflag").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 6).alias("slope"))


# ---- vectors, places and shapes
@register()
def vector_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return vectors.lsh_top_k(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding", "vec_id", "embedding", 5, 64)


@register("SELECT n_nationkey, greatest(0, least(n_nationkey + 5, 20) - greatest(n_nationkey, 8))::DOUBLE * 4 AS shared FROM nation WHERE least(n_nationkey + 5, 20) > greatest(n_nationkey, 8)")
def spatial_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planar areas of intersections of two rectangles, from the corners of the overlay."""
    k = F.col("n_nationkey")
    ring = lambda x0, x1: F.concat(F.lit("POLYGON(("), x0, F.lit(" 0,"), x1, F.lit(" 0,"), x1, F.lit(" 4,"), x0, F.lit(" 4,"), x0, F.lit(" 0))"))
    shared = spatial.st_overlay(ring(k, k + 5), ring(F.lit(8), F.lit(20)), "intersection")
    rows = read(spark, sf_dir, "nation").select("n_nationkey", spatial.st_envelope(F.when(shared.endswith("EMPTY"), None).otherwise(shared)).alias("e"))
    return rows.filter("e IS NOT NULL").select("n_nationkey", ((F.col("e")[2] - F.col("e")[0]) * (F.col("e")[3] - F.col("e")[1])).alias("shared"))


@register(f"SELECT CAST(floor((lon + 180) / 360 * 16) AS INT) AS x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 16) AS INT) AS y, count(*) AS features FROM ({PLACE.format('c_custkey', 'customer')}) GROUP BY ALL")
def spatial_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spatial.tiles(_places(spark, sf_dir, "customer", "c_custkey"), "c_custkey", 4)
    return found.filter(F.length("tile") > 0).groupBy("x", "y").agg(F.sum("features").alias("features"))


@register(f"SELECT c_custkey, round({METRES}, 3) AS metres FROM ({PLACE.format('c_custkey', 'customer')}) b, (SELECT -20.0 AS lon, 35.0 AS lat) a ORDER BY metres, c_custkey LIMIT 3")
def spatial_reverse_geocode(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spatial.reverse_geocode(_places(spark, sf_dir, "customer", "c_custkey"), -20.0, 35.0, 3)
    return found.select("c_custkey", F.round("metres", 3).alias("metres"))


@register("SELECT n_nationkey FROM nation WHERE n_name = 'NATION_7'")
def spatial_geocode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.geocode(read(spark, sf_dir, "nation"), "n_name", "7").select("n_nationkey")


@register("SELECT r_regionkey, CAST(r_regionkey + 1.0 AS DOUBLE) AS mean FROM region")
def spatial_zonal_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = [[float(x) for x in range(8)] for _ in range(4)]
    k = F.col("r_regionkey")
    zone = F.concat(F.lit("POLYGON(("), k, F.lit(" 0,"), k + 2, F.lit(" 0,"), k + 2, F.lit(" 3,"), k, F.lit(" 3,"), k, F.lit(" 0))"))
    return read(spark, sf_dir, "region").select("r_regionkey", spatial.zonal_mean(grid, 0.0, 0.0, 1.0, zone).alias("mean"))


@register("""
WITH k AS (SELECT c_custkey AS k, 1 + c_custkey % 4 AS cost FROM customer WHERE c_custkey < (SELECT max(c_custkey) FROM customer)), ends AS (SELECT c_custkey AS node, coalesce((SELECT sum(cost) FROM k WHERE k < c_custkey), 0) AS at FROM customer)
SELECT s.node AS start, e.node, abs(s.at - e.at)::DOUBLE AS cost FROM ends s, ends e WHERE s.node IN (1, 7, 12) AND abs(s.at - e.at) <= 40
""")
def spatial_travel_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs along a road through all customers (and some longer ways round) from three of them, up to 40."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    top = c.agg(F.max("k")).first()[0]
    near = c.filter(F.col("k").between(0, 60) & (F.col("k") < top))  # costs of one at least: nodes within 40 of the starts
    line = near.select(F.col("k").alias("a"), (F.col("k") + 1).alias("b"), (1.0 + F.col("k") % 4).alias("cost"))
    longer = near.filter(F.col("k") + 3 <= top).select(F.col("k").alias("a"), (F.col("k") + 3).alias("b"), F.lit(50.0).alias("cost"))
    starts = spark.createDataFrame([(1,), (7,), (12,)], "start long")
    return spatial.travel_times(line.unionByName(longer), starts).filter("cost <= 40")


@register("SELECT CAST(sum(CAST(n_nationkey AS BIGINT)) AS BIGINT) AS total, 'even' AS kind FROM nation WHERE n_nationkey % 2 = 0")
def function_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A procedure with a loop and a condition, as a SQL script."""
    read(spark, sf_dir, "nation").createOrReplaceTempView("nation_base")
    return spark.sql("""
        BEGIN
          DECLARE i INT DEFAULT 0;
          DECLARE total BIGINT DEFAULT 0;
          WHILE i < 25 DO
            IF i % 2 = 0 THEN SET total = total + (SELECT max(n_nationkey) FROM nation_base WHERE n_nationkey = i); END IF;
            SET i = i + 1;
          END WHILE;
          SELECT total AS total, 'even' AS kind;
        END
    """)


# ---- further rows of the inventory
@register("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 350000")
def join_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides in tables bucketed by the key: the join needs no exchange."""
    tag = uuid.uuid4().hex[:8]
    for name, table, key in (("o", "orders", "o_custkey"), ("c", "customer", "c_custkey")):
        files.bucketed(read(spark, sf_dir, table), f"bucketed_{name}_{tag}", key, 8)
    o, c = spark.table(f"bucketed_o_{tag}"), spark.table(f"bucketed_c_{tag}")
    return o.filter("o_totalprice > 350000").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@register("SELECT n_nationkey, (n_nationkey // 7)::INT AS page FROM nation")
def cursor_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FETCH 7 until nothing is left: each page goes on behind the last key, and only that key comes to the driver."""
    found = None
    for n, page in enumerate(files.pages(read(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey", 7)):
        part = page.withColumn("page", F.lit(n))
        found = part if found is None else found.unionByName(part)
    return found


@register("SELECT o_orderkey, CAST(round(o_totalprice, 2) * 3 AS DOUBLE) AS total, CAST(round_even(CAST(o_orderkey % 97 AS DOUBLE) * 3 * 100 / 8, 0) AS BIGINT) AS share FROM orders")
def fn_exact_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.round("o_totalprice", 2)
    share = pg.prorate(F.col("o_orderkey") % 97, F.lit(3), F.lit(8), 2)
    return read(spark, sf_dir, "orders").select("o_orderkey", pg.exact_list_sum(F.array(price, price, price), 2).cast("double").alias("total"), share.cast("long").alias("share"))


@register("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 2")
def composite_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = read(spark, sf_dir, "nation").select(F.struct("*").alias("t"))
    return whole.filter("t.n_regionkey = 2").select("t.*")


@register("SELECT s_suppkey, round(sqrt((s_nationkey - 12.0) ** 2 + (s_suppkey % 10 - 4.0) ** 2), 6) AS d FROM supplier ORDER BY d, s_suppkey LIMIT 5")
def sort_nearest_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodewright.functions import planar

    d = planar.distance(planar.point("s_nationkey", F.col("s_suppkey") % 10), planar.point(F.lit(12), F.lit(4)))
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.round(d, 6).alias("d")).orderBy("d", "s_suppkey").limit(5)


SQUARES = "SELECT n_nationkey AS k, n_nationkey AS x0, n_nationkey + 2 + n_nationkey % 3 AS x1, n_regionkey % 2 AS y0, 3 + n_nationkey % 2 AS y1 FROM nation"
COVERS = "a.x0 <= b.x0 AND a.x1 >= b.x1 AND a.y0 <= b.y0 AND a.y1 >= b.y1"
COVERED = "b.x0 <= a.x0 AND b.x1 >= a.x1 AND b.y0 <= a.y0 AND b.y1 >= a.y1"
INSIDE = "a.x1 > b.x0 AND b.x1 > a.x0 AND a.y1 > b.y0 AND b.y1 > a.y0"


@register(f"SELECT a.k AS a, b.k AS b, NOT ({INSIDE}) AS touches, {COVERS} AND {COVERED} AS equals, {INSIDE} AND NOT ({COVERS}) AND NOT ({COVERED}) AS overlaps, {COVERS} AS covers, {COVERED} AS coveredby, {COVERS} AS contains, {COVERED} AS within, false AS crosses, false AS disjoint FROM ({SQUARES}) a, ({SQUARES}) b WHERE a.x1 >= b.x0 AND b.x1 >= a.x0 AND a.y1 >= b.y0 AND b.y1 >= a.y0")
def spatial_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All predicates on the pairs of rectangles whose boxes meet in a grid."""
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    x0, x1, y0, y1 = k, k + 2 + k % 3, r % 2, 3 + k % 2
    corners = ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))
    ring = F.concat(F.lit("POLYGON(("), F.concat_ws(",", *(F.concat_ws(" ", x, y) for x, y in corners)), F.lit("))"))
    n = read(spark, sf_dir, "nation").select(k.alias("k"), ring.alias("geom"))
    pairs = spatial.spatial_join(n, n, "geom", 4.0)
    tests = ("touches", "equals", "overlaps", "covers", "coveredby", "contains", "within", "crosses", "disjoint")
    return pairs.select(F.col("k_a").alias("a"), F.col("k_b").alias("b"), *(spatial.predicate(p, "geom_a", "geom_b").alias(p) for p in tests))


@register()
def spatial_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spatial.st_point(F.col("n_nationkey") * 1.0, F.col("n_regionkey") * 1.0)
    rows = read(spark, sf_dir, "nation").withColumn("circle", spatial.st_buffer(p, 1000.0))
    return rows.select("n_nationkey", F.round(spatial.st_area("circle"), 0).alias("area"), spatial.st_convexhull("circle").alias("hull"), spatial.st_simplify("circle", 0.005).alias("simple"), spatial.st_asewkb("circle").alias("ewkb"))


@register("SELECT user_id, arg_max(floor(value), event_id) AS lon, arg_max(event_id % 80, event_id)::DOUBLE AS lat FROM events WHERE event_id <= 400 GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def spatial_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The geometry that each record had at a time."""
    e = read(spark, sf_dir, "events").withColumns({"op": F.when(F.col("event_type") == "error", "D").otherwise("U"), "scn": F.col("event_id"), "geom": spatial.st_point(F.floor("value").cast("double"), (F.col("event_id") % 80).cast("double"))})
    at = temporal.as_of(temporal.history(e, "user_id", "scn", "op", ["geom"]), 400)
    return at.withColumn("box", spatial.st_envelope("geom")).select("user_id", F.col("box")[0].alias("lon"), F.col("box")[1].alias("lat"))


@register("SELECT event_id, epoch_us(ts) AS scn, ts AS again FROM events")
def temporal_scn(spark: SparkSession, sf_dir: str) -> DataFrame:
    scn = temporal.to_scn(F.col("ts"))
    return read(spark, sf_dir, "events").select("event_id", scn.alias("scn"), temporal.from_scn(scn).alias("again"))


@register("SELECT 'missing edge' AS what, count(*) AS n FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders) WHERE o_orderkey > 2000 HAVING count(*) > 0")
def graph_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodewright.operators import graph

    o = read(spark, sf_dir, "orders")
    make = lambda rows: graph.build([(o, "o_custkey", "Customer"), (o, "o_orderkey", "Order")], [(rows, "o_custkey", "Customer", "o_orderkey", "Order", "placed")])
    return make(o).verify(make(o.filter("o_orderkey <= 2000"))).groupBy("what").agg(F.count("*").alias("n"))


@register("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def live_hot_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodewright.streaming import live

    view = live.HotView(lambda: read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")), lambda: (sf_dir,))
    view.read()
    return view.read()


@register("SELECT user_id, min(v) AS least, max(v) AS most, round(avg(v), 9) AS mean, count(*) AS n FROM (SELECT user_id, value AS v FROM events) GROUP BY user_id")
def series_array_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary of a vector of values in each row."""
    listed = read(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("value")).alias("v"))
    return listed.select("user_id", F.array_min("v").alias("least"), F.array_max("v").alias("most"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.size("v"), 9).alias("mean"), F.size("v").cast("long").alias("n"))


@register()
def fts_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodewright.operators import fulltext

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return fulltext.match(docs, fulltext.index(docs, "doc_id", "text", "english").postings, "doc_id", fulltext.plain("rights reserved", "english"))


@register("SELECT n_nationkey, n_nationkey * 2 AS twice FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier) ORDER BY n_nationkey LIMIT 10")
def front_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several rewrites in one text."""
    from lodewright.plans.front import sql

    text = "SELECT DISTINCT ON (n_nationkey) n_nationkey, n_nationkey * 2 AS twice FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE 1 = ANY(array(1, 2)) ORDER BY n_nationkey, s_suppkey FETCH FIRST 10 ROWS ONLY"
    return sql(spark, text, {"nation": read(spark, sf_dir, "nation"), "supplier": read(spark, sf_dir, "supplier")})


@register("SELECT n_nationkey, 9 AS res, '8828308281fffff' AS parent, '8428309ffffffff' AS coarse FROM nation")
def spatial_h3_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.lit("8928308280fffff")
    return read(spark, sf_dir, "nation").select("n_nationkey", spatial.h3_resolution(cell).alias("res"), spatial.h3_parent(cell, 8).alias("parent"), spatial.h3_parent(cell, 4).alias("coarse"))
