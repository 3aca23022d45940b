"""Scalar-function queries: numbers, text, dates, arrays, JSON, ranges, geometry, networks and XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewright.functions import jsons, net, pg, planar, ranges, xml
from lodewright.plans.catalog import register, register_sql


def both(name: str, text: str) -> None:
    register_sql(name, text, text)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- numbers
both("fn_arithmetic", "SELECT p_partkey, p_size + 3 AS a, p_size - 50 AS b, p_size * 2 AS c, p_size % 7 AS d, -p_size AS e, abs(p_size - 25) AS f FROM part")
both("fn_transcendental", "SELECT p_partkey, round(sqrt(p_size), 9) AS s, round(cbrt(p_size), 9) AS c, round(exp(p_size / 50.0), 9) AS e, round(ln(p_size), 9) AS l, round(power(p_size, 1.5), 6) AS p, CAST(ceil(p_retailprice) AS BIGINT) AS up, CAST(floor(p_retailprice) AS BIGINT) AS down, round(p_retailprice, 1) AS r FROM part")


@register("SELECT o_orderkey, CAST(o_orderkey // 7 AS BIGINT) AS div, CAST(-(o_custkey // 4) AS BIGINT) AS neg, trunc(o_totalprice * 10) / 10 AS cut, round(log10(o_totalprice), 9) AS lg FROM orders")
def fn_integer_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", pg.int_div("o_orderkey", F.lit(7)).alias("div"), pg.int_div(-F.col("o_custkey"), F.lit(4)).alias("neg"), pg.trunc("o_totalprice", 1).alias("cut"), F.round(pg.log10("o_totalprice"), 9).alias("lg"))


# ---- text
both("fn_case_and_length", "SELECT n_nationkey, lower(n_name) AS lo, upper(n_name) AS up, CAST(length(n_name) AS BIGINT) AS len, CAST(bit_length(n_name) AS BIGINT) AS bits, reverse(n_name) AS rev, repeat(n_name, 2) AS rep FROM nation")
both("fn_pad_and_trim", "SELECT n_nationkey, lpad(n_name, 12, '*') AS l, rpad(n_name, 12, '-') AS r, ltrim(concat('  ', n_name)) AS lt, rtrim(concat(n_name, '  ')) AS rt, trim(concat(' ', n_name, ' ')) AS t, left(n_name, 3) AS lf, right(n_name, 3) AS rg FROM nation")
both("fn_translate_replace", "SELECT p_partkey, translate(p_brand, '#1', '_x') AS t, replace(p_type, 'BRASS', 'GOLD') AS r FROM part")
both("fn_split_part", "SELECT p_partkey, split_part(p_type, ' ', 1) AS a, split_part(p_type, ' ', -1) AS z, concat_ws('/', p_brand, p_type) AS j FROM part")


@register("SELECT p_partkey, position('e' IN p_name)::INT AS pos, substring(p_name, 3, 4) AS sub, substring(p_name, 1, 2) AS early, regexp_replace(p_type, '([A-Z])([A-Z]+)', '\\2\\1') AS once, regexp_replace(p_name, 'e', 'E', 'g') AS every, regexp_extract(p_brand, '#(\\d)(\\d)', 2) AS second FROM part")
def fn_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = pg.regexp_match("p_brand", r"#(\d)(\d)")
    return read(spark, sf_dir, "part").select("p_partkey", F.instr("p_name", "e").alias("pos"), pg.substring("p_name", 3, 4).alias("sub"), pg.substring("p_name", -1, 4).alias("early"), pg.regexp_replace("p_type", r"([A-Z])([A-Z]+)", r"\2\1").alias("once"), pg.regexp_replace("p_name", "e", "E", "g").alias("every"), F.coalesce(F.try_element_at(m, F.lit(2)), F.lit("")).alias("second"))


@register("SELECT n_nationkey, array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS cap, n_nationkey || ': \"' || replace(n_name, '\"', '\"\"') || '\" ''' || n_name || '''' AS shown FROM nation")
def fn_initcap_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "nation")
    return rows.select("n_nationkey", pg.initcap("n_name").alias("cap"), pg.format_text("%s: %I %L", "n_nationkey", "n_name", "n_name").alias("shown"))


@register("SELECT n_nationkey, unnest(string_split(n_name, 'I')) AS piece FROM nation")
def fn_split_to_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select("n_nationkey", F.explode(pg.string_to_array("n_name", "I")).alias("piece"))


@register("""
WITH w AS (SELECT n_nationkey, n_regionkey, unnest(list_filter(regexp_split_to_array(lower(n_name), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS word FROM nation),
t AS (SELECT n_nationkey, n_regionkey, unnest([substr('  ' || word || ' ', i, 3) for i in range(1, len(word) + 2)]) AS gram FROM w), g AS (SELECT n_nationkey, n_regionkey, list_distinct(list(gram)) AS t FROM t GROUP BY ALL)
SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 5) AS alike FROM g a JOIN g b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey
""")
def fn_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("x"), "n_regionkey"), n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("y"), "n_regionkey")
    return a.join(b, "n_regionkey").filter("a < b").select("a", "b", F.round(pg.similarity("x", "y").cast("double"), 5).alias("alike"))


@register("SELECT n_nationkey, hex(n_name) AS h, CAST(base64(encode(n_name)) AS VARCHAR) AS b, chr(955 + n_nationkey) AS c, md5(n_name) AS m FROM nation")
def fn_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select("n_nationkey", F.hex(F.col("n_name")).alias("h"), F.base64(F.col("n_name").cast("binary")).alias("b"), pg.chr_(F.col("n_nationkey") + 955).alias("c"), F.md5("n_name").alias("m"))


# ---- dates
both("fn_date_parts", "SELECT o_orderkey, CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS y, CAST(EXTRACT(MONTH FROM o_orderdate) AS INT) AS m, CAST(EXTRACT(DAY FROM o_orderdate) AS INT) AS d, CAST(EXTRACT(QUARTER FROM o_orderdate) AS INT) AS q, CAST(EXTRACT(WEEK FROM o_orderdate) AS INT) AS w FROM orders")


@register("SELECT event_id, date_trunc('hour', ts) AS hour, date_trunc('month', ts)::TIMESTAMP AS month, ts + INTERVAL 36 HOUR AS later, ts + INTERVAL 1 MONTH AS next_month, time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '2000-01-01') AS bin FROM events")
def fn_date_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("ts")
    return read(spark, sf_dir, "events").select("event_id", F.date_trunc("hour", t).cast("timestamp_ntz").alias("hour"), F.date_trunc("month", t).cast("timestamp_ntz").alias("month"), (t + F.expr("INTERVAL '36' HOUR")).alias("later"), (t + F.expr("INTERVAL '1' MONTH")).alias("next_month"), pg.date_bin("15 minutes", "ts", "2000-01-01").alias("bin"))


@register("SELECT o_orderkey, CAST(datepart('year', a) AS INT) AS years, CAST(datepart('month', a) AS INT) AS months, last_day(CAST(o_orderdate AS DATE)) AS month_end, strftime(o_orderdate, '%Y/%m/%d %H:%M') AS shown FROM (SELECT *, age(TIMESTAMP '2030-01-01', date_trunc('day', o_orderdate)) AS a FROM orders)")
def fn_age_to_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = pg.age_parts(F.lit("2030-01-01").cast("timestamp_ntz"), F.date_trunc("day", "o_orderdate"))
    return read(spark, sf_dir, "orders").select("o_orderkey", age["years"].alias("years"), age["months"].alias("months"), F.last_day("o_orderdate").alias("month_end"), pg.to_char("o_orderdate", "YYYY/MM/DD HH24:MI").alias("shown"))


@register("SELECT o_orderkey, CASE WHEN d = last_day(d) THEN last_day((d + INTERVAL 1 MONTH)::DATE) ELSE (d + INTERVAL 1 MONTH)::DATE END AS next_month, (d - CAST((day(d) - 1) % 7 AS INT))::DATE AS w, (d - CAST((dayofyear(d) - 1) % 7 AS INT))::DATE AS ww, (d - CAST(dayofweek(d) AS INT))::DATE AS sunday, date_trunc('week', d)::TIMESTAMP AS iso, make_date(CAST((year(d) - 1) // 100 * 100 + 1 AS BIGINT), 1, 1) AS cc FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)")
def fn_oracle_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    return read(spark, sf_dir, "orders").select("o_orderkey", pg.add_months_keep_end(d, 1.9).alias("next_month"), pg.trunc_date(d, "W").alias("w"), pg.trunc_date(d, "WW").alias("ww"), pg.trunc_date(d, "D").alias("sunday"), pg.trunc_date("o_orderdate", "IW").cast("timestamp_ntz").alias("iso"), pg.trunc_date("o_orderdate", "CC").alias("cc"))




# ---- arrays
@register("SELECT p_partkey, len(w)::INT AS n, w[1] AS first_word, list_position(w, 'x') AS pos, array_to_string(w[2:3], '+') AS mid, list_contains(w, 'green') AS has, array_to_string(list_append(w, '!'), ' ') AS more FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)")
def fn_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.split("p_name", " ")
    return read(spark, sf_dir, "part").select("p_partkey", pg.array_length(w).alias("n"), F.element_at(w, 1).alias("first_word"), F.nullif(F.array_position(w, "x"), F.lit(0)).cast("int").alias("pos"), F.array_join(pg.array_slice(w, 2, 3), "+").alias("mid"), pg.contains(w, F.array(F.lit("green"))).alias("has"), F.array_join(F.array_append(w, "!"), " ").alias("more"))


@register("SELECT n_nationkey, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS u, array_to_string(list_sort(list_intersect(a, b)), ',') AS i, list_has_any(a, b) AS o, '{' || array_to_string(a, ',') || '}' AS shown FROM (SELECT n_nationkey, [n_nationkey % 3, n_nationkey % 5] AS a, [n_regionkey, 1] AS b FROM nation)")
def fn_array_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.array(F.col("n_nationkey") % 3, F.col("n_nationkey") % 5), F.array("n_regionkey", F.lit(1))
    return read(spark, sf_dir, "nation").select("n_nationkey", F.array_join(F.array_sort(F.array_union(a, b)), ",").alias("u"), F.array_join(F.array_sort(F.array_intersect(a, b)), ",").alias("i"), pg.overlaps(a, b).alias("o"), pg.array_text(a).alias("shown"))


@register()
def fn_multisets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.array(F.col("n_nationkey") % 2, F.col("n_nationkey") % 2, F.col("n_nationkey") % 3), F.array(F.col("n_nationkey") % 2, F.lit(1))
    return read(spark, sf_dir, "nation").select("n_nationkey", pg.multiset_union(a, b).alias("u"), pg.multiset_intersect(a, b).alias("i"), pg.multiset_except(a, b).alias("e"))


# ---- JSON
@register("SELECT event_id, json_extract_string(props, '$.k') AS k, json_exists(props, '$.k') AS has, json_type(props, '$') = 'OBJECT' AS obj, CAST(json_extract(props, '$.k') AS INT) > 50 AS big FROM events")
def fn_json_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", jsons.get_text("props", "k").alias("k"), jsons.has_key("props", "k").alias("has"), (jsons.type_of("props") == "object").alias("obj"), jsons.path_match("props", "$.k > 50").alias("big"))


@register("SELECT conv_id, turn, json_object('role', role, 'n', length(text))::VARCHAR AS j FROM conversations")
def fn_json_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct("role", F.length("text").alias("n"))).alias("j"))


@register("SELECT n_nationkey, i AS ord, v AS item FROM (SELECT n_nationkey, unnest(['a' || n_nationkey, 'b', 'c']) AS v, generate_subscripts(['a', 'b', 'c'], 1)::INT AS i FROM nation)")
def fn_json_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = F.to_json(F.array(F.concat(F.lit("a"), "n_nationkey"), F.lit("b"), F.lit("c")))
    return read(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(jsons.elements(j)).alias("p", "item")).select("n_nationkey", (F.col("p") + 1).alias("ord"), "item")


@register("SELECT n_nationkey, 'key' AS key, CAST(n_nationkey AS VARCHAR) AS value FROM nation UNION ALL SELECT n_nationkey, 'name', n_name FROM nation")
def fn_json_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = F.to_json(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")))
    return read(spark, sf_dir, "nation").select("n_nationkey", F.explode(jsons.pairs(j)))


@register("SELECT n_nationkey, n_regionkey = 1 AS c, n_regionkey > 2 AS f FROM nation")
def fn_json_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = F.to_json(F.struct(F.struct(F.col("n_regionkey").alias("r"), F.array("n_nationkey").alias("keys")).alias("at")))
    return read(spark, sf_dir, "nation").select("n_nationkey", jsons.contains(j, '{"at": {"r": 1}}').alias("c"), jsons.path_exists(j, "$.at ? (@.r > $least)", {"least": 2}).alias("f"))


@register("SELECT n_regionkey, unnest(range(0, 3))::INT AS id, n_regionkey * unnest(range(0, 3))::INT AS v FROM (SELECT DISTINCT n_regionkey FROM nation)")
def fn_json_recordset(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = F.to_json(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(i.alias("id"), (F.col("n_regionkey") * i).alias("v"))))
    return read(spark, sf_dir, "nation").select("n_regionkey").distinct().select("n_regionkey", F.inline(F.from_json(j, "array<struct<id:int,v:int>>")))


# ---- ranges
@register("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey * 4 < b.n_nationkey + 3 AND b.n_nationkey < a.n_regionkey * 4 + 5")
def range_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    left = n.select("n_nationkey", (F.col("n_regionkey") * 4).alias("lo"), (F.col("n_regionkey") * 4 + 5).alias("hi"))
    right = n.select("n_nationkey", F.col("n_nationkey").alias("lo"), (F.col("n_nationkey") + 3).alias("hi"))
    return ranges.overlap_join(left, right, "lo", "hi", 5.0).select(F.col("n_nationkey_l").alias("a"), F.col("n_nationkey_r").alias("b"))


@register("SELECT n_nationkey, n_nationkey BETWEEN 5 AND 11 AS has, n_nationkey < 12 AND n_nationkey + 4 > 5 AS meets, CASE WHEN greatest(n_nationkey, 5) < least(n_nationkey + 4, 12) THEN '[' || greatest(n_nationkey, 5) || ',' || least(n_nationkey + 4, 12) || ')' ELSE 'empty' END AS shared, '[' || least(n_nationkey, 5) || ',' || greatest(n_nationkey + 4, 12) || ')' AS merged FROM nation")
def fn_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ranges.make(F.col("n_nationkey"), F.col("n_nationkey") + 3, "[]", discrete=True)
    b = ranges.make(F.lit(5), F.lit(12))
    return read(spark, sf_dir, "nation").select("n_nationkey", ranges.has(b, F.col("n_nationkey")).alias("has"), ranges.overlaps(a, b).alias("meets"), ranges.text(ranges.intersect(a, b)).alias("shared"), ranges.text(ranges.merge(a, b)).alias("merged"))


# ---- geometry, networks, XML
@register("SELECT n_nationkey, round(sqrt((n_nationkey - 3) ** 2 + (n_regionkey - 1) ** 2), 9) AS d, n_nationkey BETWEEN 2 AND 9 AND n_regionkey BETWEEN 0 AND 3 AS inside, (n_nationkey - 3) ** 2 + (n_regionkey - 1) ** 2 <= 16 AS round_in, n_nationkey + n_regionkey <= 10 AND n_nationkey >= 0 AND n_regionkey >= 0 AS tri FROM nation")
def fn_planar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "nation").withColumn("p", planar.point("n_nationkey", "n_regionkey"))
    q = planar.point(F.lit(3), F.lit(1))
    triangle = F.array(planar.point(F.lit(0), F.lit(0)), planar.point(F.lit(10), F.lit(0)), planar.point(F.lit(0), F.lit(10)))
    return rows.select("n_nationkey", F.round(planar.distance("p", q), 9).alias("d"), planar.box_has(planar.box(planar.point(F.lit(9), F.lit(0)), planar.point(F.lit(2), F.lit(3))), "p").alias("inside"), planar.circle_has(planar.circle(q, F.lit(4)), "p").alias("round_in"), planar.polygon_has(triangle, "p").alias("tri"))


@register("SELECT s_suppkey, '10.0.' || s_nationkey || '.0/24' AS net, 24 AS bits, s_nationkey = 3 AS inside, '10.0.' || s_nationkey || '.255/24' AS last FROM supplier")
def fn_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.concat(F.lit("10.0."), "s_nationkey", F.lit("."), F.col("s_suppkey") % 200, F.lit("/24"))
    rows = read(spark, sf_dir, "supplier").withColumn("a", a)
    return rows.select("s_suppkey", net.network("a").alias("net"), net.masklen("a").alias("bits"), net.within_or_equal("a", F.lit("10.0.3.0/24")).alias("inside"), net.broadcast("a").alias("last"))


@register("SELECT n_nationkey, '<nation id=\"' || n_nationkey || '\"><name>' || n_name || '</name><region>' || n_regionkey || '</region></nation>' AS doc, n_name AS name FROM nation")
def fn_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = xml.element("nation", xml.forest(name="n_name", region="n_regionkey"), attributes={"id": "n_nationkey"})
    return read(spark, sf_dir, "nation").withColumn("doc", doc).select("n_nationkey", "doc", F.element_at(xml.xpath("doc", "/nation/name/text()"), 1).alias("name"))


@register("SELECT r_regionkey, i AS place, n_name AS name, n_nationkey AS key FROM (SELECT r_regionkey, n_name, n_nationkey, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey)::INT AS i FROM region JOIN nation ON n_regionkey = r_regionkey)")
def fn_xmltable(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "nation").withColumn("x", xml.element("n", xml.forest(name="n_name"), attributes={"key": "n_nationkey"}))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "x"))), lambda s: s["x"]), "")
    docs = rows.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.concat(F.lit("<all>"), listed, F.lit("</all>")).alias("doc"))
    return xml.table(docs, "doc", "/all/n", {"name": ("string", "name"), "key": ("int", "@key")}, "place").drop("doc")


@register("SELECT n_nationkey, power(n_nationkey + 1, 5)::DECIMAL(38, 0)::BIGINT AS p, 1 AS one, '[1:3]' AS dims FROM nation")
def fn_power_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole powers of decimals without rounding."""
    return read(spark, sf_dir, "nation").select("n_nationkey", pg.power_exact(F.col("n_nationkey") + 1, 5).cast("long").alias("p"), pg.power_exact("n_nationkey", 0).cast("int").alias("one"), pg.array_dims(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("dims"))


#: Hashes of texts with seeds 0 and -1, and their partitions of seven.
HASHES = (("", -6939563903564495251, -5142811166230430645, 1), ("tenant:key", 2119148298895563973, -5005703973338175090, 1), ("abcdefghijkl", -7556637188122330412, -3669402583748189229, 3), ("abcdefghijklmnopqrstu", 7996419909667933074, -2291028065551762409, 2), ("雪é", 550074847648507964, 3653323685410488478, 4))


@register("SELECT * FROM (VALUES " + ", ".join(f"('{t}', {a}::BIGINT, {b}::BIGINT, {p})" for t, a, b, p in HASHES) + ") v(text, zero, negative, part)")
def fn_hash_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodewright.operators import changes

    rows = spark.createDataFrame([(t,) for t, *_ in HASHES], "text string")
    return rows.select("text", pg.hash_text_extended("text", 0).alias("zero"), pg.hash_text_extended("text", -1).alias("negative"), changes.hash_partition(F.col("text"), 7).alias("part"))
