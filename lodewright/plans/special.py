"""Cubes, full text, vectors, graphs, temporal, spatial and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewright.operators import changes, cubes, fulltext, graph, hierarchy, spatial, temporal, vectors
from lodewright.plans.catalog import register
from lodewright.plans.scalars import read
from lodewright.storage import materialize, shared_dir
from lodewright.streaming import broker, events, geofence, live


# ---- cubes
def _sales(spark: SparkSession, sf_dir: str) -> cubes.Cube:
    rows = read(spark, sf_dir, "lineitem").withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    return cubes.create("sales", rows, ["l_returnflag", "l_linestatus", "month"], ["l_quantity"], ["l_suppkey"], ["l_extendedprice"])


@register("SELECT l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m') AS month, count(*) AS count, sum(l_quantity) AS sum_l_quantity, round(avg(l_quantity), 6) AS avg_l_quantity, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem GROUP BY ALL")
def cube_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _sales(spark, sf_dir).relation()
    return r.select("l_returnflag", "l_linestatus", "month", "count", "sum_l_quantity", F.round("avg_l_quantity", 6).alias("avg_l_quantity"), F.col("min_l_quantity").alias("least"), F.col("max_l_quantity").alias("most"))


@register("SELECT l_returnflag, strftime(l_shipdate, '%Y') AS month, count(*) AS count, sum(l_quantity) AS sum_l_quantity FROM lineitem GROUP BY ALL")
def cube_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    coarse = cubes.rollup(_sales(spark, sf_dir), {"l_linestatus": cubes.WHOLE, "month": cubes.prefix(4)})
    return coarse.relation().select("l_returnflag", "month", "count", "sum_l_quantity")


@register("SELECT o_orderstatus, count(*) AS count, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def cube_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    a, b = (cubes.create("o", o.filter(F.col("o_orderkey") % 2 == k), ["o_orderstatus"], ["o_totalprice"], ["o_custkey"], position="o_orderkey") for k in (0, 1))
    return cubes.merge(a, b).relation().select("o_orderstatus", "count", F.round("sum_o_totalprice", 2).alias("total"))


@register("SELECT o_orderstatus, count(*) AS count FROM orders GROUP BY ALL")
def cube_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    old = cubes.create("o", o.filter("o_orderkey <= 500"), ["o_orderstatus"], ["o_totalprice"], position="o_orderkey")
    return cubes.refresh(old, o, "o_orderkey").relation().select("o_orderstatus", "count")


@register()
def cube_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sales(spark, sf_dir).relation().select("l_returnflag", "l_linestatus", "month", "distinct_l_suppkey", "p50_l_extendedprice")


@register("SELECT 'sales' AS name, 'orders' AS collection, 'o_orderstatus' AS dimensions, 'sum(o_totalprice)' AS measures, 500 AS projection_position, max(o_orderkey) AS source_position, count(*) FILTER (WHERE o_orderkey > 500) AS lag_events, count(DISTINCT o_orderstatus) FILTER (WHERE o_orderkey <= 500) AS cells, count(*) AS source_rows FROM orders")
def cube_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    c = cubes.create("sales", o.filter("o_orderkey <= 500"), ["o_orderstatus"], ["o_totalprice"], position="o_orderkey")
    return cubes.status([c], "orders", o, "o_orderkey").withColumn("projection_position", F.col("projection_position").cast("int"))


@register()
def cube_sketch_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median of each priority from the sketch of 1,024 rows, over all orders."""
    return cubes.bottom_k_percentile(read(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", "o_orderkey", 0.5)


# ---- full text
WORDS = "(SELECT doc_id AS doc, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM documents)"


def _indexed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, fulltext.Index]:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return docs, fulltext.index(docs, "doc_id", "text")


@register(f"SELECT doc, term, count(*) AS tf FROM {WORDS} WHERE term IN ('the', 'that', 'que') GROUP BY ALL")
def fts_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir)[1].postings.filter(F.col("term").isin("the", "that", "que")).select("doc", "term", "tf")


@register(f"SELECT doc FROM {WORDS} GROUP BY doc HAVING bool_or(term = 'the') AND (bool_or(term = 'worthless') OR bool_or(starts_with(term, 'idio'))) AND NOT bool_or(term = 'que')")
def fts_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, index = _indexed(spark, sf_dir)
    return fulltext.match(docs, index.postings, "doc_id", fulltext.parse("the & (worthless | idio:*) & !que"))


@register("SELECT doc_id AS doc FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])of[^\\p{L}\\p{N}_]+the([^\\p{L}\\p{N}_]|$)')")
def fts_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, index = _indexed(spark, sf_dir)
    return fulltext.match(docs, index.postings, "doc_id", fulltext.phrase("of the"))


BM25 = f"""
WITH w AS {WORDS}, dl AS (SELECT doc, count(*) AS dl FROM w GROUP BY doc), s AS (SELECT count(*) AS n, greatest(1.0, avg(dl)) AS a FROM dl),
tf AS (SELECT doc, term, count(*) AS tf FROM w WHERE term IN ('worthless', 'the', 'und') GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score FROM tf JOIN df USING (term) JOIN dl USING (doc), s GROUP BY doc
"""


@register(BM25)
def fts_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _indexed(spark, sf_dir)[1]
    return fulltext.bm25(index.postings, ["worthless", "the", "und"], lengths=index.lengths).withColumn("score", F.round("score", 6))


@register(f"SELECT * FROM ({BM25}) ORDER BY score DESC, doc LIMIT 10")
def fts_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _indexed(spark, sf_dir)[1]
    return fulltext.bm25(index.postings, ["worthless", "the", "und"], 10, lengths=index.lengths).withColumn("score", F.round("score", 6))


@register("""
WITH f AS (SELECT page_id AS doc, 'A' AS weight, unnest(regexp_extract_all(lower(url), '[\\p{L}\\p{N}_]+')) AS term FROM pages UNION ALL SELECT page_id, 'D', unnest(regexp_extract_all(lower(html), '[\\p{L}\\p{N}_]+')) FROM pages),
l AS (SELECT doc, weight, count(*) AS len FROM f GROUP BY ALL), n AS (SELECT count(DISTINCT doc) AS n FROM f), m AS (SELECT weight, greatest(1.0, sum(len) / (SELECT n FROM n)) AS a FROM l GROUP BY weight),
t AS (SELECT doc, term, weight, count(*) AS tf FROM f WHERE term IN ('the', 'com') GROUP BY ALL), d AS (SELECT term, count(DISTINCT doc) AS df FROM t GROUP BY term),
w AS (SELECT doc, term, sum(CASE weight WHEN 'A' THEN 3.0 ELSE 1.0 END * tf / (0.25 + 0.75 * len / a)) AS wtf FROM t JOIN l USING (doc, weight) JOIN m USING (weight) GROUP BY ALL)
SELECT doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * wtf * 2.2 / (1.2 + wtf)), 6) AS score FROM w JOIN d USING (term), n GROUP BY doc
""")
def fts_bm25f(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = fulltext.index(read(spark, sf_dir, "pages"), "page_id", {"A": "url", "D": "html"})
    return fulltext.bm25f(index.postings, ["the", "com"], lengths=index.lengths).withColumn("score", F.round("score", 6))


@register(f"SELECT doc, round(0.1 * list_sum([1.0 / (i * i) for i in range(1, count(*) + 1)]) / 1.6449341, 6) AS score FROM {WORDS} WHERE term = 'worthless' GROUP BY doc")
def fts_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.ts_rank(_indexed(spark, sf_dir)[1].postings, ["worthless"]).withColumn("score", F.round("score", 6))


@register(f"SELECT doc, round(0.1 * list_sum([1.0 / (i * i) for i in range(1, n + 1)]) / 1.6449341 / (1 + ln(dl)), 6) AS score FROM (SELECT doc, count(*) AS dl, count(*) FILTER (WHERE term = 'worthless') AS n FROM {WORDS} GROUP BY doc) WHERE n > 0")
def fts_rank_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _indexed(spark, sf_dir)[1]
    return fulltext.ts_rank(index.postings, ["worthless"], 1, lengths=index.lengths).withColumn("score", F.round("score", 6))


@register(f"""
WITH p AS (SELECT doc_id AS doc, generate_subscripts(w, 1) AS pos, unnest(w) AS term FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents)),
m AS (SELECT *, lead(pos) OVER o AS next_pos, lead(term) OVER o AS next_term FROM p WHERE term IN ('of', 'the') WINDOW o AS (PARTITION BY doc ORDER BY pos))
SELECT doc, round(sum(0.1 / (next_pos - pos)), 6) AS score FROM m WHERE term <> next_term GROUP BY doc
""")
def fts_rank_cd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cover density of two words: each stretch between neighbours of different words."""
    return fulltext.ts_rank_cd(_indexed(spark, sf_dir)[1].postings, ["of", "the"]).withColumn("score", F.round("score", 6))


@register(f"SELECT doc FROM {WORDS} GROUP BY doc HAVING bool_or(term = 'the') AND (bool_or(term = 'worthless') OR bool_or(term = 'und'))")
def fts_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of documents as bitmaps, joined and intersected."""
    posted = _indexed(spark, sf_dir)[1].postings
    of = lambda word: fulltext.bitmap(posted.filter(F.col("term") == word))
    return fulltext.members(fulltext.intersection(of("the"), fulltext.union(of("worthless"), of("und"))))


@register(f"SELECT doc, count(*) AS tf, 'B' AS weight FROM {WORDS} WHERE term = 'worthless' GROUP BY doc")
def fts_setweight(spark: SparkSession, sf_dir: str) -> DataFrame:
    posted = _indexed(spark, sf_dir)[1].postings.filter("term = 'worthless'")
    return fulltext.setweight(posted, "B").select("doc", "tf", "weight")


@register("SELECT term, weight, n FROM (SELECT term, 'D' AS weight, count(*) AS n FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(lower(html), '[\\p{L}\\p{N}_]+')) AS term FROM pages) GROUP BY term) ORDER BY n DESC, term LIMIT 20")
def fts_page_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of five terms each, every one from the last key of the page before, by falling document frequency."""
    counted = fulltext.index(read(spark, sf_dir, "pages"), "page_id", "html").postings.groupBy("term", "weight").agg(F.count("*").alias("n"))  # a posting is one document
    counted = materialize(counted, "frequencies")
    found, last = None, None
    for _ in range(4):
        rest = counted if last is None else counted.filter((F.col("n") < last["n"]) | ((F.col("n") == last["n"]) & (F.col("term") > last["term"])))
        page = rest.orderBy(F.col("n").desc(), "term").limit(5)
        last = page.orderBy("n", F.col("term").desc()).first()
        if last is None:
            break
        found = page if found is None else found.unionByName(page)
    return found


# ---- vectors
QUERY = [1.0 if i % 3 == 0 else -0.5 for i in range(64)]
LITERAL = "[" + ", ".join(map(str, QUERY)) + "]::DOUBLE[64]"


@register(f"SELECT vec_id, round(array_cosine_similarity(embedding::DOUBLE[64], {LITERAL}), 9) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")
def vector_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_k(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", QUERY, 10).withColumn("score", F.round("score", 9))


@register(f"SELECT vec_id, round(array_inner_product(embedding::DOUBLE[64], {LITERAL}), 9) AS score FROM embeddings WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 10")
def vector_dot_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_k(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", QUERY, 10, "dot", F.col("label") == 3).withColumn("score", F.round("score", 9))


@register(f"SELECT vec_id, round(1 - array_cosine_similarity(embedding::DOUBLE[64], {LITERAL}), 9) AS far, round(-array_inner_product(embedding::DOUBLE[64], {LITERAL}), 9) AS inner_, round(array_distance(embedding::DOUBLE[64], {LITERAL}), 9) AS apart FROM embeddings")
def vector_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three distances by their operators."""
    from lodewright.plans.front import sql

    q = f"'[{','.join(map(str, QUERY))}]'::vector(64)"
    return sql(spark, f"SELECT vec_id, round(embedding <=> {q}, 9) AS far, round(embedding <#> {q}, 9) AS inner_, round(embedding <-> {q}, 9) AS apart FROM embeddings", {"embeddings": read(spark, sf_dir, "embeddings")})


@register(f"SELECT vec_id, round(array_distance(embedding::DOUBLE[64], {LITERAL}), 9) AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 10")
def vector_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_k(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", QUERY, 10, "l2").select("vec_id", F.round(-F.col("score"), 9).alias("distance"))


@register("SELECT query, vec_id, round(score, 9) AS score, rank FROM (SELECT q.vec_id AS query, v.vec_id, array_cosine_similarity(v.embedding::DOUBLE[64], q.embedding::DOUBLE[64]) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, v.vec_id)::INT AS rank FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0) WHERE rank <= 5")
def vector_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return vectors.batch_top_k(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding", "vec_id", "embedding", 5).withColumn("score", F.round("score", 9))


# ---- graph
def _graph(spark: SparkSession, sf_dir: str) -> graph.Graph:
    o, l = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return graph.build([(read(spark, sf_dir, "customer"), "c_custkey", "Customer")], [(o, "o_custkey", "Customer", "o_orderkey", "Order", "placed"), (l, "l_orderkey", "Order", "l_partkey", "Part", "holds")])


@register("SELECT label, count(*) AS n FROM (SELECT 'Customer' AS label, c_custkey AS id FROM customer UNION SELECT 'Customer', o_custkey FROM orders UNION SELECT 'Order', o_orderkey FROM orders UNION SELECT 'Order', l_orderkey FROM lineitem UNION SELECT 'Part', l_partkey FROM lineitem) GROUP BY label")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).nodes.groupBy("label").agg(F.count("*").alias("n"))


@register("SELECT DISTINCT id FROM (SELECT 'Customer:' || o_custkey AS id FROM orders WHERE o_orderkey = 7 UNION ALL SELECT 'Part:' || l_partkey FROM lineitem WHERE l_orderkey = 7)")
def graph_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).neighbors("Order:7")


@register("WITH o AS (SELECT DISTINCT o_orderkey FROM orders WHERE o_custkey = 7) SELECT 'Order:' || o_orderkey AS id, 1 AS depth FROM o UNION ALL SELECT DISTINCT 'Part:' || l_partkey, 2 FROM lineitem JOIN o ON l_orderkey = o_orderkey")
def graph_traverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).traverse("Customer:7", None, 2)


@register()
def graph_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _graph(spark, sf_dir).path("Customer:7", "Customer:4", 4)
    return spark.createDataFrame([(len(found) - 1, found)], "hops int, path array<string>")


@register("WITH RECURSIVE t(k, level, path) AS (SELECT n_nationkey, 1, [n_nationkey] FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, level + 1, list_append(path, n.n_nationkey) FROM t JOIN nation n ON (n.n_nationkey - 1) // 3 = t.k AND n.n_nationkey > 0) SELECT k AS n_nationkey, level, array_to_string(path, '/') AS path, 0 AS iscycle FROM t")
def hierarchy_connect_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").withColumn("boss", F.when(F.col("n_nationkey") > 0, F.floor((F.col("n_nationkey") - 1) / 3)).cast("int"))
    return hierarchy.connect_by(n.select("n_nationkey", "boss"), "n_nationkey", "boss", F.col("n_nationkey") == 0, siblings=["n_nationkey"]).select("n_nationkey", "level", F.array_join("path", "/").alias("path"), "iscycle")


# ---- time and versions
def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumns({"op": F.when(F.col("event_type") == "error", "D").otherwise("U"), "scn": F.col("event_id")})
    return temporal.history(e, "user_id", "scn", "op", ["value"])


@register("SELECT user_id, arg_max(value, event_id) AS value FROM events WHERE event_id <= 600 GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def temporal_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.as_of(_versions(spark, sf_dir), 600)


@register("""
WITH v AS (SELECT user_id, value, event_id AS s, CASE WHEN event_type = 'error' THEN event_id ELSE lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) END AS e, CASE WHEN event_type = 'error' THEN 'D' ELSE 'U' END AS op FROM events)
SELECT user_id, value, CASE WHEN s >= 300 THEN s END AS versions_startscn, CASE WHEN op <> 'D' AND e <= 500 THEN e END AS versions_endscn, op AS versions_operation FROM v WHERE s <= 500 AND (e IS NULL OR e > 300 OR (op = 'D' AND s >= 300))
""")
def temporal_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.versions_between(_versions(spark, sf_dir), 300, 500)


@register("SELECT o_orderkey, o_orderdate, e.value AS asof_value FROM (SELECT *, o_custkey % 50 AS k FROM orders) o LEFT JOIN LATERAL (SELECT value FROM events WHERE user_id % 50 = o.k AND ts - INTERVAL 9000 DAY <= o.o_orderdate ORDER BY ts DESC, value DESC LIMIT 1) e ON true")
def join_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", (F.col("o_custkey") % 50).alias("k"))
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("k"), (F.col("ts") - F.expr("INTERVAL '9000' DAY")).alias("at"), "value")
    return temporal.as_of_join(o, e, "k", "o_orderdate", "at", ["value"]).drop("k")


@register("SELECT user_id, arg_max(value, event_id) AS value FROM events WHERE event_id <= 700 GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def temporal_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "RecordCreated").when(F.col("event_type") == "error", "RecordDeleted").otherwise("RecordUpdated")
    e = read(spark, sf_dir, "events").withColumns({"kind": kind, "offset": F.col("event_id")})
    return temporal.snapshot_at(e, "user_id", "event_id", "kind", "value", 700)


@register("SELECT user_id, arg_max(event_type, event_id) AS event_type, count(*) AS events FROM events GROUP BY user_id")
def temporal_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.fold_last(read(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@register("SELECT count(*) AS count, min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg FROM events WHERE event_id BETWEEN 100 AND 800 AND event_type = 'click' AND user_id = 7")
def series_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = F.to_json(F.struct(F.col("user_id").cast("string").alias("device_id"), F.col("event_type").alias("metric"), "value"))
    batch = temporal.analytics_batch(read(spark, sf_dir, "events").withColumn("meta", meta), "event_id", "event_id", "meta")
    return temporal.series_summary(batch, 100, 800, "click", "7").withColumn("avg", F.round("avg", 6))


# ---- writes
@register("SELECT c_custkey, CASE WHEN n IS NULL THEN c_acctbal ELSE c_acctbal + n END AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def write_update_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return changes.update_from(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), n, ["c_custkey"], {"c_acctbal": F.col("c_acctbal") + F.col("s_n")}, ["n"])


@register("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def write_delete_using(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = read(spark, sf_dir, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return changes.delete_using(read(spark, sf_dir, "customer").select("c_custkey"), big, ["c_custkey"])


@register("SELECT n_nationkey, CASE WHEN n_nationkey >= 20 THEN lower(n_name) ELSE n_name END AS n_name FROM nation UNION ALL SELECT n_nationkey + 25, lower(n_name) FROM nation WHERE n_nationkey < 5")
def write_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    new = n.filter("n_nationkey >= 20").select("n_nationkey", F.lower("n_name").alias("n_name")).unionByName(n.filter("n_nationkey < 5").select((F.col("n_nationkey") + 25).alias("n_nationkey"), F.lower("n_name").alias("n_name")))
    return changes.insert_on_conflict(n, new, ["n_nationkey"], {"n_name": F.col("excluded_n_name")})


@register("SELECT r_regionkey, CASE WHEN r_regionkey < 3 THEN r_name || '!' ELSE r_name END AS r_name FROM region")
def write_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "region")
    return changes.merge_update(r, r.filter("r_regionkey < 3").select("r_regionkey", F.concat("r_name", F.lit("!")).alias("r_name")), ["r_regionkey"], {"r_name": F.col("s_r_name")})


@register("SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 300000 THEN 'mid' ELSE 'rest' END AS part, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS list FROM orders")
def write_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", changes.range_partition(F.col("o_totalprice"), [("low", None, 100000), ("mid", 100000, 300000)], "rest").alias("part"), changes.list_partition(F.col("o_orderstatus"), {"done": ["F"], "open": ["O"]}, "other").alias("list"))


@register("SELECT 'check price' AS \"constraint\", count(*) AS rows FROM orders WHERE o_totalprice <= 5000 UNION ALL SELECT 'unique o_custkey', sum(n)::BIGINT FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1)")
def write_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return changes.violations(o, ["o_orderkey"], [["o_custkey"]], {"price": F.col("o_totalprice") > 5000}, [("o_custkey", read(spark, sf_dir, "customer"), "c_custkey")])


@register("SELECT field, nulls, least, most FROM (SELECT 'n_name' AS field, 0 AS nulls, min(n_name) AS least, max(n_name) AS most FROM nation UNION ALL SELECT 'n_regionkey', 0, min(n_regionkey)::VARCHAR, max(n_regionkey)::VARCHAR FROM nation)")
def analyze_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.statistics(read(spark, sf_dir, "nation"), ["n_name", "n_regionkey"]).select("field", F.col("nulls").cast("int").alias("nulls"), F.col("min").alias("least"), F.col("max").alias("most"))


# ---- spatial
def _places(spark: SparkSession, sf_dir: str, table: str, key: str) -> DataFrame:
    k = F.col(key)
    return read(spark, sf_dir, table).select(k, ((k * 37) % 360 - 180 + (k % 10) / 10).alias("lon"), ((k * 17) % 120 - 60 + (k % 7) / 7).alias("lat"))


PLACE = "SELECT {0}, ({0} * 37) % 360 - 180 + ({0} % 10) / 10 AS lon, ({0} * 17) % 120 - 60 + ({0} % 7) / 7 AS lat FROM {1}"
METRES = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2))))"


@register(f"SELECT a.s_suppkey AS a, b.c_custkey AS b, round({METRES}, 3) AS metres FROM ({PLACE.format('s_suppkey', 'supplier')}) a JOIN ({PLACE.format('c_custkey', 'customer')}) b ON {METRES} <= 300000")
def spatial_dwithin_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _places(spark, sf_dir, "supplier", "s_suppkey"), _places(spark, sf_dir, "customer", "c_custkey")
    return spatial.within_distance_join(a, b, "s_suppkey", "c_custkey", 300_000).withColumn("metres", F.round("metres", 3))


@register(f"SELECT a.c_custkey, b.r_regionkey FROM ({PLACE.format('c_custkey', 'customer')}) a JOIN region b ON a.lon BETWEEN b.r_regionkey * 40 - 100.05 AND b.r_regionkey * 40 - 70.05 AND a.lat BETWEEN -20.05 AND 30.05")
def spatial_contains_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _places(spark, sf_dir, "customer", "c_custkey").select("c_custkey", spatial.st_point("lon", "lat").alias("geom"))
    x0, x1 = (F.col("r_regionkey") * 40 - k for k in (100.05, 70.05))
    ring = F.concat(F.lit("POLYGON(("), *(p for x, y in ((x0, "-20.05"), (x1, "-20.05"), (x1, "30.05"), (x0, "30.05"), (x0, "-20.05")) for p in (x.cast("string"), F.lit(f" {y},"))))
    areas = read(spark, sf_dir, "region").select("r_regionkey", F.concat(F.rtrim(ring, F.lit(",")), F.lit("))")).alias("geom"))
    return spatial.spatial_join(points, areas, "geom", 10.0).select(F.col("c_custkey_a").alias("c_custkey"), F.col("r_regionkey_b").alias("r_regionkey"))


@register(f"SELECT CAST(floor(lon / 10) AS BIGINT) || ':' || CAST(floor(lat / 10) AS BIGINT) AS cell, count(*) AS n FROM ({PLACE.format('c_custkey', 'customer')}) GROUP BY 1")
def spatial_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, sf_dir, "customer", "c_custkey").groupBy(spatial.cell("lon", "lat", 10.0).alias("cell")).agg(F.count("*").alias("n"))


@register(f"SELECT c_custkey FROM ({PLACE.format('c_custkey', 'customer')}) b, (SELECT 10.0 AS lon, 20.0 AS lat) a ORDER BY {METRES}, c_custkey LIMIT 7")
def spatial_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _places(spark, sf_dir, "customer", "c_custkey")
    return p.orderBy(spatial.metres(F.lit(10.0), F.lit(20.0), "lon", "lat"), "c_custkey").limit(7).select("c_custkey")


@register()
def spatial_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("n_nationkey") + 1).cast("string")
    g = F.concat(F.lit("POLYGON((0 0,"), k, F.lit(" 0,"), k, F.lit(" 10,0 10,0 0))"))
    rows = read(spark, sf_dir, "nation").withColumn("g", g)
    return rows.select("n_nationkey", F.round(spatial.st_area("g") / 1e6, 3).alias("km2"), spatial.st_centroid("g").alias("centre"), spatial.st_geomfromwkb(spatial.st_asbinary("g")).alias("again"), spatial.st_asgeojson("g").alias("geojson"))


@register()
def spatial_travel_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    roads = [(f"n{i}", f"n{(i * 3 + 1) % 25}", 1.0 + i % 4) for i in range(25)] + [(f"n{i}", f"n{i + 1}", 5.0) for i in range(24)]
    return read(spark, sf_dir, "nation").select("n_nationkey", spatial.travel_time(roads, F.lit("n0"), F.concat(F.lit("n"), "n_nationkey")).alias("cost"))


@register("SELECT n_nationkey, CAST((n_nationkey % 4) * 1.0 + (n_regionkey % 3) * 10.0 + 0.5 + 5.0 AS DOUBLE) AS height FROM nation")
def spatial_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = [[x + 10.0 * y for x in range(6)] for y in range(6)]
    x, y = F.col("n_nationkey") % 4 + 0.5, F.col("n_regionkey") % 3 + 0.5
    return read(spark, sf_dir, "nation").select("n_nationkey", spatial.raster_sample(grid, 0.0, 0.0, 1.0, x, y).alias("height"))


# ---- streams
def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _checkpoint(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


@register("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = events.windowed(_stream(spark, sf_dir), "ts", "1 hour", None, ["event_type"], None, n=F.count("*"))
    name = "t" + uuid.uuid4().hex
    return events.run_to_end(counted, name, "complete", _checkpoint(spark)).select("start", "event_type", "n")


def _in_files(spark: SparkSession, sf_dir: str) -> str:
    """Events of even ids in a first file, the others in two later ones."""
    path = f"{shared_dir(spark)}/late-{uuid.uuid4().hex}"
    e = read(spark, sf_dir, "events")
    for k, test in enumerate(("event_id % 2 = 0", "event_id % 4 = 1", "event_id % 4 = 3")):
        e.filter(test).coalesce(1).write.mode("append").parquet(f"{path}/part={k}")
    return path


@register("""
WITH w AS (SELECT max(ts) - INTERVAL 2 DAY AS mark FROM events WHERE event_id % 2 = 0), b AS (SELECT event_id, time_bucket(INTERVAL '1 hour', ts) AS start FROM events)
SELECT start, count(*) AS n FROM b, w WHERE event_id % 4 <> 3 OR start + INTERVAL 1 HOUR > date_trunc('milliseconds', mark) GROUP BY start
""")
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts under a watermark of two days: rows of the third file that come later than the first one allows are dropped."""
    schema = read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{_in_files(spark, sf_dir)}/part=*")
    counted = events.windowed(stream, "ts", "1 hour", None, [], "2 days", n=F.count("*"))
    told = events.run_to_end(counted, "late" + uuid.uuid4().hex, "update", _checkpoint(spark))
    return told.groupBy(F.col("start").cast("timestamp_ntz").alias("start")).agg(F.max_by("n", "batch").alias("n"))


@register("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def live_subscription(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grouped query kept up to date over three batches; its changes, netted, are the result."""
    path = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(read(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 1).parquet(f"{_in_files(spark, sf_dir)}/part=*")
    emit = lambda changed: changed.write.mode("overwrite").parquet(f"{path}/changes/seq={uuid.uuid4().hex}")
    live.subscribe_grouped(stream, ["event_type"], {"total": F.col("value")}, path, _checkpoint(spark), emit).awaitTermination()
    sign = F.when(F.col("change") == "+", 1).otherwise(-1)
    netted = spark.read.parquet(f"{path}/changes").groupBy("event_type").agg(F.sum(sign * F.col("n")).alias("n"), F.sum(sign * F.col("total")).alias("total"))
    return netted.select("event_type", "n", F.round("total", 4).alias("total"))


@register("SELECT CAST(w AS TIMESTAMP) AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY w")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.windowed(read(spark, sf_dir, "events"), "ts", "1 hour", "30 minutes", [], None, n=F.count("*")).select("start", "n")


@register("SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.sessions(read(spark, sf_dir, "events"), "ts", "6 hours", ["user_id"], n=F.count("*"))


@register("SELECT event_id FROM events WHERE event_id > 900")
def stream_read_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.read_since(read(spark, sf_dir, "events"), 900, order="event_id").select("event_id")


@register("SELECT event_id FROM events")
def stream_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "value")
    return events.import_events(e.filter("event_id < 600"), e.filter("event_id > 400"), "event_id").select("event_id")


@register("SELECT 2::BIGINT AS commit_seq, '-' AS change, event_type, n FROM (SELECT event_type, count(*) AS n FROM events WHERE event_id <= 500 GROUP BY 1) UNION ALL SELECT 2, '+', event_type, count(*) FROM events GROUP BY 1, 2, 3")
def live_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    count = lambda rows: rows.groupBy("event_type").agg(F.count("*").alias("n"))
    return live.changes(count(e.filter("event_id <= 500")), count(e), 2)


@register()
def broker_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    ops = e.select(
        F.concat(F.lit("q"), F.col("user_id") % 10).alias("queue"), F.lit("g").alias("consumer"), F.col("event_id").alias("offset"), F.when(F.col("event_type").isin("click", "view", "purchase"), "publish").when(F.col("event_type") == "signup", "consume").otherwise("ack").alias("op"),
        F.col("event_id").alias("now"), F.concat(F.lit("w"), F.col("user_id") % 2).alias("worker"), F.floor(F.col("value") % 5).cast("long").alias("seq"), F.col("props").alias("payload"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("long").alias("delay"), F.lit(2).cast("long").alias("batch"),
    )
    return broker.group_info(broker.replay(ops))


@register("""
WITH o AS (SELECT *, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 1 ELSE 0 END AS pub, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS purge FROM events),
s AS (SELECT *, sum(pub) OVER (PARTITION BY user_id % 10 ORDER BY event_id) - 1 AS seq, sum(purge) OVER (PARTITION BY user_id % 10 ORDER BY event_id DESC) AS later FROM o)
SELECT 'q' || user_id % 10 AS queue, count(*) FILTER (WHERE pub = 1) AS published, count(*) FILTER (WHERE pub = 1 AND later > 0) AS purged FROM s GROUP BY 1
""")
def broker_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishing with a purge now and then: what was published before the last purge is gone."""
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("click", "view", "purchase"), "publish").when(F.col("event_type") == "error", "purge")
    nothing = lambda t: F.lit(None).cast(t)
    ops = e.withColumn("op", kind).filter("op IS NOT NULL").select(
        F.concat(F.lit("q"), F.col("user_id") % 10).alias("queue"), F.lit("g").alias("consumer"), F.col("event_id").alias("offset"), "op", F.col("event_id").alias("now"), F.lit("w").alias("worker"),
        nothing("long").alias("seq"), F.col("props").alias("payload"), nothing("string").alias("key"), nothing("long").alias("delay"), nothing("long").alias("batch"),
    )
    n = lambda x: F.count(F.when(F.col("event") == x, 1))
    return broker.replay(ops).groupBy("queue").agg(n("published").alias("published"), n("purged").alias("purged"))


@register("""
WITH p AS (SELECT user_id AS asset, f.fence, floor(epoch(ts))::BIGINT AS "at", event_id, value BETWEEN lo AND hi AS inside FROM events, (VALUES ('low', 0.0, 40.0), ('mid', 30.0, 70.0)) f(fence, lo, hi)),
m AS (SELECT *, coalesce(lag(inside) OVER (PARTITION BY asset, fence ORDER BY "at"), false) AS before FROM p), e AS (SELECT *, last_value(CASE WHEN inside AND NOT before THEN "at" END IGNORE NULLS) OVER (PARTITION BY asset, fence ORDER BY "at" ROWS UNBOUNDED PRECEDING) AS since FROM m)
SELECT asset, fence, "at", CASE WHEN inside AND NOT before THEN 'enter' WHEN inside THEN 'dwell' ELSE 'exit' END AS event, CASE WHEN inside AND NOT before THEN 0 ELSE "at" - since END AS seconds FROM e WHERE inside OR before
""")
def geofence_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("asset"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"), F.col("value").alias("x"), F.lit(0.0).alias("y"))
    fences = spark.createDataFrame([("low", 0.0, -1.0, 40.0, 1.0), ("mid", 30.0, -1.0, 70.0, 1.0)], "fence string, x0 double, y0 double, x1 double, y1 double")
    return geofence.transitions(e, fences)
