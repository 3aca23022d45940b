"""Relational queries: scans, predicates, joins, aggregates, windows, sorts, set operations and CTEs.

``both`` holds texts that DuckDB runs as they are; ``pair`` those it spells otherwise.
"""

from __future__ import annotations

from lodewright.plans.catalog import register_sql


def both(name: str, text: str) -> None:
    register_sql(name, text, text)


def pair(name: str, spark: str, duck: str) -> None:
    register_sql(name, spark, duck)


# ---- scans
both("scan_full", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
both("scan_time_range", "SELECT event_id, user_id, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'")
both("scan_pk_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 7, 32, 999999999)")
both("scan_pk_page", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 50")
both("scan_suffix_range", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_orderkey = 3 AND l_linenumber BETWEEN 1 AND 4 AND l_quantity > 5")
both("scan_ordered_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10")
both("scan_hash_equality", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
both("scan_partial_predicate", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000 AND o_orderpriority IS NOT NULL")
both("scan_substring", "SELECT doc_id FROM documents WHERE lower(text) LIKE '%ereded%'")
both("scan_count_star", "SELECT count(*) AS n FROM lineitem")
both("scan_values", "SELECT n, s FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS g(n, s)")
both("scan_table_body", "SELECT count(*) AS n, min(r_name) AS first_name FROM (TABLE region) r")
pair("scan_generate_series", "SELECT CAST(g.n * g.n AS BIGINT) AS square FROM generate_series(1, 20, 3) AS g(n)", "SELECT g.n * g.n AS square FROM generate_series(1, 20, 3) AS g(n)")
pair("scan_unnest_ordinality", "SELECT p.p_partkey, x.ord, x.word FROM part p, unnest(string_to_array(p.p_name, ' ')) WITH ORDINALITY AS x(word, ord)", "SELECT p_partkey, generate_subscripts(w, 1)::INT AS ord, unnest(w) AS word FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)")
pair("scan_unnest_several", "SELECT p.p_partkey, x.a, x.b FROM part p, unnest(string_to_array(p.p_name, ' '), string_to_array(p.p_type, ' ')) AS x(a, b)", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS a, unnest(string_split(p_type, ' ')) AS b FROM part")
pair("scan_generate_subscripts", "SELECT p.p_partkey, x.s FROM part p, generate_subscripts(string_to_array(p.p_name, ' '), 1, true) AS x(s)", "SELECT p_partkey, unnest(range(len(string_split(p_name, ' ')), 0, -1))::INT AS s FROM part")
pair("scan_dual", "SELECT 1 + 1 AS two FROM DUAL", "SELECT 1 + 1 AS two")
both("scan_time_summary", "SELECT count(*) AS n, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean FROM events WHERE event_type = 'purchase'")

# ---- projection and predicates
both("project_aliases", "SELECT n.n_name AS name, n.n_regionkey + 1 AS next_region, n.* FROM nation AS n")
both("filter_three_valued", "SELECT count(*) AS n FROM (SELECT nullif(n_regionkey, 2) AS r FROM nation) t WHERE NOT (r = 1) OR (r IS NULL AND r > 0)")
both("filter_truth_tests", "SELECT k, (k > 2) IS TRUE AS t, (k > 2) IS NOT TRUE AS nt, (k > 2) IS FALSE AS f, (k > 2) IS NOT FALSE AS nf, (k > 2) IS NULL AS u FROM (SELECT nullif(n_regionkey, 3) AS k FROM nation) x")
both("filter_distinct_from", "SELECT n_name FROM nation WHERE nullif(n_regionkey, 1) IS DISTINCT FROM 2 AND nullif(n_regionkey, 3) IS NOT DISTINCT FROM NULL")
both("filter_between", "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.06 AND l_quantity NOT BETWEEN 10 AND 45")
both("filter_in_list", "SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9) AND p_brand NOT IN ('Brand#11', 'Brand#12')")
both("filter_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
both("filter_not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
both("filter_not_in_nulls", "SELECT count(*) AS n FROM nation WHERE n_regionkey NOT IN (SELECT nullif(r_regionkey, 4) FROM region)")
both("filter_exists", "SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity > 49)")
both("filter_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')")
both("filter_scalar_subquery", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS top FROM customer c WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
pair("filter_any_all", "SELECT n_name FROM nation WHERE n_regionkey = ANY('{1,3}'::int[]) AND n_nationkey > ALL(ARRAY[2, 5]) AND n_name LIKE ANY (ARRAY['%1%', '%2%', 'N%'])", "SELECT n_name FROM nation WHERE n_regionkey = ANY([1, 3]) AND n_nationkey > 2 AND n_nationkey > 5 AND (n_name LIKE '%1%' OR n_name LIKE '%2%' OR n_name LIKE 'N%')")
pair("filter_tuple_between", "SELECT n_nationkey FROM nation WHERE (n_regionkey, n_nationkey) BETWEEN (1, 10) AND (3, 15)", "SELECT n_nationkey FROM nation WHERE (n_regionkey > 1 OR (n_regionkey = 1 AND n_nationkey >= 10)) AND (n_regionkey < 3 OR (n_regionkey = 3 AND n_nationkey <= 15))")
pair("filter_like", "SELECT p_partkey FROM part WHERE p_name LIKE '%e%' AND p_brand ILIKE 'brand#1_' AND p_type NOT LIKE '%!%%' ESCAPE '!'", "SELECT p_partkey FROM part WHERE p_name LIKE '%e%' AND p_brand ILIKE 'brand#1_' AND NOT (p_type LIKE '%!%%' ESCAPE '!')")
pair("filter_regex", "SELECT p_partkey FROM part WHERE p_brand ~ '#[12][34]$' AND p_type !~* 'brass'", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '#[12][34]$') AND NOT regexp_matches(p_type, 'brass', 'i')")
both("project_case", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS status, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'medium' END AS size FROM orders")
both("project_null_functions", "SELECT n_nationkey, coalesce(nullif(n_regionkey, 1), -1) AS c, greatest(n_regionkey, nullif(n_nationkey, 3), 2) AS g, least(nullif(n_regionkey, 0), 4) AS l FROM nation")
pair("filter_row_values", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE struct(l_orderkey, l_linenumber) < struct(5L, 3) AND struct(l_orderkey, l_linenumber) >= struct(2L, 1)", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey < 5 OR (l_orderkey = 5 AND l_linenumber < 3)) AND (l_orderkey > 2 OR (l_orderkey = 2 AND l_linenumber >= 1))")
both("filter_contradiction", "SELECT n_name FROM nation WHERE n_regionkey = 1 AND n_regionkey = 2")
pair("filter_json", "SELECT event_id FROM events WHERE (props ->> 'k')::int = 42", "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) = 42")
pair("filter_json_keys", "SELECT count(*) FILTER (WHERE props ? 'k') AS one, count(*) FILTER (WHERE props ?| ARRAY['k', 'z']) AS any_key, count(*) FILTER (WHERE props ?& ARRAY['k', 'z']) AS all_keys, count(*) FILTER (WHERE props @> '{}') AS every FROM events", "SELECT count(*) FILTER (WHERE json_exists(props, '$.k')) AS one, count(*) FILTER (WHERE json_exists(props, '$.k') OR json_exists(props, '$.z')) AS any_key, count(*) FILTER (WHERE json_exists(props, '$.k') AND json_exists(props, '$.z')) AS all_keys, count(*) AS every FROM events")
pair("filter_json_containment", "SELECT event_id FROM events WHERE props @> '{\"k\": 7}' OR props -> 'k' = '9'", "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS INT) IN (7, 9)")
pair("filter_masked_quotes", "SELECT n_nationkey, ' FROM DUAL' AS a, 'LIMIT NULL' AS b, 'x ~ y::int (+)' AS c /* FETCH FIRST ROW ONLY */ FROM nation -- DUAL", "SELECT n_nationkey, ' FROM DUAL' AS a, 'LIMIT NULL' AS b, 'x ~ y::int (+)' AS c FROM nation")
pair("project_casts", "SELECT o_orderkey, o_orderkey::text AS t, o_totalprice::int8 AS whole, '7'::int4 + 1 AS eight, o_orderdate::date AS day FROM orders", "SELECT o_orderkey, o_orderkey::VARCHAR AS t, trunc(o_totalprice)::BIGINT AS whole, 8 AS eight, o_orderdate::DATE AS day FROM orders")
pair("project_nvl_decode", "SELECT n_nationkey, NVL(nullif(n_regionkey, 0), 9) AS v, NVL2(nullif(n_regionkey, 3), 'some', 'none') AS w, DECODE(nullif(n_regionkey, 4), 1, 'one', 2, 'two', NULL, 'null', 'many') AS d FROM nation", "SELECT n_nationkey, coalesce(nullif(n_regionkey, 0), 9) AS v, CASE WHEN n_regionkey = 3 THEN 'none' ELSE 'some' END AS w, CASE n_regionkey WHEN 1 THEN 'one' WHEN 2 THEN 'two' WHEN 4 THEN 'null' ELSE 'many' END AS d FROM nation")
pair("project_time_zones", "SELECT event_id, ts AT TIME ZONE 'America/New_York' AS instant, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tokyo' AS there FROM events", "SELECT event_id, timezone('America/New_York', ts) AT TIME ZONE 'UTC' AS instant, ts + INTERVAL 9 HOUR AS there FROM events")
pair("project_intervals", "SELECT event_id, ts + make_interval(days => 2, hours => 3) AS a, ts + INTERVAL '1' DAY * 3 AS b, ts + NUMTODSINTERVAL(90, 'MINUTE') AS c, ts + NUMTOYMINTERVAL(2, 'MONTH') AS d, ts - INTERVAL '6' HOUR / 4 AS e FROM events", "SELECT event_id, ts + INTERVAL 51 HOUR AS a, ts + INTERVAL 3 DAY AS b, ts + INTERVAL 90 MINUTE AS c, ts + INTERVAL 2 MONTH AS d, ts - INTERVAL 90 MINUTE AS e FROM events")
pair("project_regexp_substr", "SELECT p_partkey, REGEXP_SUBSTR(p_type, '[A-Z]+', 1, 2) AS second, REGEXP_SUBSTR(p_brand, '(brand)#([0-9])', 1, 1, 'i', 2) AS digit, array_join(regexp_split_to_array(p_type, ' +'), '|') AS parts FROM part", "SELECT p_partkey, regexp_extract_all(p_type, '[A-Z]+')[2] AS second, nullif(regexp_extract(p_brand, '(?i)(brand)#([0-9])', 2), '') AS digit, array_to_string(regexp_split_to_array(p_type, ' +'), '|') AS parts FROM part")
pair("project_bytes", "SELECT n_nationkey, encode(n_name, 'hex') AS h, encode(decode('6869', 'hex'), 'base64') AS b, CAST(HEXTORAW('4142') AS STRING) AS raw, RAWTOHEX(n_name) AS up FROM nation", "SELECT n_nationkey, lower(hex(n_name)) AS h, 'aGk=' AS b, 'AB' AS raw, hex(n_name) AS up FROM nation")
pair("project_array_bounds", "SELECT p_partkey, array_lower(w, 1) AS lo, array_upper(w, 1) AS hi, array_dims(w) AS dims, cardinality(w) AS n, array_join(w[2:3], '+') AS mid, w @> ARRAY['x'] AS has, w && ARRAY['red', 'green'] AS meets FROM (SELECT p_partkey, string_to_array(p_name, ' ') AS w FROM part) t", "SELECT p_partkey, 1 AS lo, len(w)::INT AS hi, '[1:' || len(w) || ']' AS dims, len(w)::INT AS n, array_to_string(w[2:3], '+') AS mid, list_contains(w, 'x') AS has, list_has_any(w, ['red', 'green']) AS meets FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)")

# ---- joins
both("join_inner", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 250000")
both("join_comma", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
both("join_left", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 200000 GROUP BY c.c_custkey")
both("join_right", "SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P'")
both("join_full", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM (SELECT * FROM nation WHERE n_regionkey < 3) a FULL JOIN (SELECT * FROM nation WHERE n_regionkey > 1) b ON a.n_nationkey = b.n_nationkey")
both("join_full_theta", "SELECT a.r_regionkey AS a, b.r_regionkey AS b FROM region a FULL JOIN region b ON a.r_regionkey > b.r_regionkey + 2")
both("join_cross", "SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b")
both("join_theta", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
both("join_lateral", "SELECT r.r_name, t.n_name FROM region r, LATERAL (SELECT n_name, n_nationkey FROM nation n WHERE n.n_regionkey = r.r_regionkey ORDER BY n_nationkey LIMIT 2) t")
both("join_lateral_left", "SELECT s.s_suppkey, t.q FROM supplier s LEFT JOIN LATERAL (SELECT max(l_quantity) AS q FROM lineitem l WHERE l.l_suppkey = s.s_suppkey) t ON true")
both("join_nested", "SELECT c.c_custkey, n.n_name, r.r_name FROM customer c LEFT JOIN (nation n JOIN region r ON n.n_regionkey = r.r_regionkey) ON c.c_nationkey = n.n_nationkey")
both("join_using", "SELECT n_nationkey, x.n_name AS other FROM nation JOIN (SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1) x USING (n_nationkey)")
pair("join_semi", "SELECT p_partkey FROM part LEFT SEMI JOIN lineitem ON p_partkey = l_partkey AND l_quantity >= 50", "SELECT p_partkey FROM part SEMI JOIN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50) ON p_partkey = l_partkey")
pair("join_anti", "SELECT p_partkey FROM part LEFT ANTI JOIN lineitem ON p_partkey = l_partkey AND l_quantity >= 50", "SELECT p_partkey FROM part ANTI JOIN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50) ON p_partkey = l_partkey")
both("join_typed_key", "SELECT count(*) AS n FROM (SELECT CAST(n_regionkey AS DECIMAL(10, 2)) AS k FROM nation) a JOIN (SELECT CAST(r_regionkey AS DECIMAL(12, 4)) AS k FROM region) b ON a.k = b.k")
pair("join_oracle_plus", "SELECT c.c_custkey, o.o_orderkey, n.n_name FROM customer c, orders o, nation n WHERE c.c_custkey = o.o_custkey (+) AND o.o_totalprice (+) > 200000 AND c.c_nationkey = n.n_nationkey (+) AND n.n_regionkey(+) = 1 AND c.c_acctbal > 0", "SELECT c.c_custkey, o.o_orderkey, n.n_name FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000 LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey AND n.n_regionkey = 1 WHERE c.c_acctbal > 0")
both("join_four_tables", "SELECT n.n_name, CAST(count(*) AS BIGINT) AS lines, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE l.l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY n.n_name")

# ---- aggregates
pair("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, sum(DISTINCT l_linenumber) AS line_sum, round(avg(DISTINCT l_quantity), 6) AS mean FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS line_sum, round(avg(DISTINCT l_quantity), 6) AS mean FROM lineitem GROUP BY l_returnflag")
both("agg_bool", "SELECT o_orderpriority, bool_and(o_totalprice > 1000) AS every_one, bool_or(o_totalprice > 400000) AS any_one FROM orders GROUP BY o_orderpriority")
pair("agg_string", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
pair("agg_array", "SELECT n_regionkey, array_join(transform(sort_array(collect_list(struct(n_nationkey, n_name))), x -> x.n_name), '|') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(array_agg(n_name ORDER BY n_nationkey), '|') AS names FROM nation GROUP BY n_regionkey")
pair("agg_json", "SELECT n_regionkey, to_json(transform(sort_array(collect_list(struct(n_nationkey, n_name))), x -> x.n_name)) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(to_json(list(n_name ORDER BY n_nationkey)) AS VARCHAR) AS names FROM nation GROUP BY n_regionkey")
pair("agg_xml", "SELECT n_regionkey, listagg(concat('<n>', n_name, '</n>'), '') WITHIN GROUP (ORDER BY n_name) AS doc FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg('<n>' || n_name || '</n>', '' ORDER BY n_name) AS doc FROM nation GROUP BY n_regionkey")
both("agg_regr_slope", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_slope(l_tax, l_discount) FILTER (WHERE l_linenumber = 1), 9) AS first_slope FROM lineitem GROUP BY l_returnflag")
pair("agg_percentiles", "SELECT o_orderpriority, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY o_totalprice), 4) AS q1, percentile_disc(0.5) WITHIN GROUP (ORDER BY o_totalprice) AS median, mode() WITHIN GROUP (ORDER BY o_orderstatus) AS common FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, quantile_disc(o_totalprice, 0.5) AS median, (SELECT o_orderstatus FROM orders i WHERE i.o_orderpriority = o.o_orderpriority GROUP BY o_orderstatus ORDER BY count(*) DESC, o_orderstatus LIMIT 1) AS common FROM orders o GROUP BY o_orderpriority")
both("agg_filter", "SELECT l_linestatus, count(*) FILTER (WHERE l_quantity > 25) AS many, round(sum(l_tax) FILTER (WHERE l_returnflag = 'R'), 4) AS tax FROM lineitem GROUP BY l_linestatus")
both("agg_ordinals", "SELECT l_shipdate < TIMESTAMP '1995-01-01' AS early, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2")
both("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15 AND max(o_totalprice) > 100000")
both("agg_having_alone", "SELECT count(*) AS n FROM orders HAVING count(*) > 10")
pair("agg_empty", "SELECT count(*) AS n, sum(n_nationkey) AS s, max(n_name) AS m, bool_and(n_nationkey > 0) AS b FROM nation WHERE n_nationkey < 0", "SELECT count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS s, max(n_name) AS m, bool_and(n_nationkey > 0) AS b FROM nation WHERE n_nationkey < 0")
both("agg_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
both("agg_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
both("agg_distinct_on_nested", "WITH firsts AS (SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey) SELECT o_custkey % 10 AS digit, count(*) AS n, max(o_orderkey) AS last FROM firsts GROUP BY 1")
both("agg_distinct_on_limit", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey DESC, o_totalprice, o_orderkey LIMIT 7")
both("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
both("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
both("agg_rollup", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
both("agg_conditional", "SELECT o_orderstatus, CASE WHEN count(*) > 100 THEN round(avg(o_totalprice), 4) ELSE 0 END AS mean FROM orders GROUP BY o_orderstatus")
both("agg_moments", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS dev, round(var_pop(l_quantity), 6) AS spread, round(corr(l_quantity, l_extendedprice), 6) AS together FROM lineitem GROUP BY l_returnflag")
pair("agg_exact_units", "SELECT l_returnflag, CAST(sum(CAST(l_extendedprice * 100 AS DECIMAL(20, 0))) AS DECIMAL(38, 0)) AS cents FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(sum(CAST(l_extendedprice * 100 AS DECIMAL(20, 0))) AS DECIMAL(38, 0)) AS cents FROM lineitem GROUP BY l_returnflag")

# ---- windows
both("window_ranks", "SELECT n_nationkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY n_regionkey ORDER BY length(n_name)) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY n_regionkey ORDER BY length(n_name)) AS BIGINT) AS dr, CAST(ntile(3) OVER w AS BIGINT) AS nt, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)")
both("window_running", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS running, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
pair("window_lag_lead", "SELECT event_id, lag(value, 2, -1.0) OVER w AS back, lead(nullif(value, 0)) IGNORE NULLS OVER w AS ahead FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", "SELECT event_id, lag(value, 2, -1.0) OVER w AS back, lead(nullif(value, 0) IGNORE NULLS) OVER w AS ahead FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
both("window_values", "SELECT event_id, first_value(value) OVER w AS f, last_value(value) OVER w AS l, nth_value(value, 2) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
both("window_rows_frame", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS near FROM events")
both("window_range_number", "SELECT n_nationkey, count(*) OVER (ORDER BY n_nationkey RANGE BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS near FROM nation")
both("window_range_interval", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS day_before FROM events")
both("window_groups", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS peers FROM orders")
pair("window_inherited", "SELECT o_orderkey, CAST(row_number() OVER (w ORDER BY o_orderkey DESC) AS BIGINT) AS rn FROM orders WINDOW w AS (PARTITION BY o_custkey)", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders")
both("window_over_groups", "SELECT o_orderstatus, round(sum(sum(o_totalprice)) OVER (ORDER BY o_orderstatus), 2) AS running FROM orders GROUP BY o_orderstatus")

# ---- sorts and limits
both("sort_nulls", "SELECT n_nationkey, nullif(n_regionkey, 2) AS r FROM nation ORDER BY r DESC NULLS FIRST, n_nationkey LIMIT 12")
both("sort_ordinal_offset", "SELECT p_partkey, p_retailprice FROM part ORDER BY 2 DESC, 1 LIMIT 20 OFFSET 5")
pair("sort_fetch_first", "SELECT s_suppkey FROM supplier ORDER BY s_acctbal DESC, s_suppkey OFFSET 2 ROWS FETCH FIRST 5 ROWS ONLY", "SELECT s_suppkey FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 5 OFFSET 2")
pair("sort_limit_null", "SELECT r_name FROM region ORDER BY r_name LIMIT NULL", "SELECT r_name FROM region")
pair("sort_rownum", "SELECT n_nationkey FROM (SELECT n_nationkey, n_regionkey FROM nation ORDER BY n_nationkey) WHERE n_regionkey <> 1 AND ROWNUM < 4", "SELECT n_nationkey FROM nation WHERE n_regionkey <> 1 ORDER BY n_nationkey LIMIT 3")
pair("sort_collate", "SELECT max(lower(n_name) COLLATE \"C\") AS top, count(DISTINCT (CASE WHEN n_nationkey % 2 = 0 THEN upper(n_name) ELSE lower(n_name) END) COLLATE UNICODE_CI) AS n FROM nation", "SELECT max(lower(n_name)) AS top, count(DISTINCT lower(n_name)) AS n FROM nation")
pair("hierarchy_generator", "SELECT LEVEL AS level FROM DUAL CONNECT BY LEVEL <= 30", "SELECT i::INT AS level FROM range(1, 31) t(i)")
pair("hierarchy_connect_by_text", "SELECT LEVEL AS level, n_nationkey, SYS_CONNECT_BY_PATH(n_nationkey, '/') AS path FROM (tree) WHERE n_nationkey <> 3 START WITH boss IS NULL CONNECT BY PRIOR n_nationkey = boss ORDER SIBLINGS BY n_nationkey".replace("(tree)", "boss_tree"), "WITH RECURSIVE t(k, level, path) AS (SELECT n_nationkey, 1, '/' || n_nationkey FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, level + 1, path || '/' || n.n_nationkey FROM t JOIN nation n ON (n.n_nationkey - 1) // 3 = t.k AND n.n_nationkey > 0) SELECT level, k AS n_nationkey, path FROM t WHERE k <> 3")
both("sort_top_expression", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount), 2) AS net FROM lineitem ORDER BY l_extendedprice * (1 - l_discount) DESC, l_orderkey, l_linenumber, l_partkey LIMIT 25")
both("sort_top_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) t WHERE r <= 3")

# ---- set operations and CTEs
both("set_union", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")
both("set_union_all", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
both("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
both("set_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier")
both("set_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
both("set_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
both("set_ordered", "(SELECT n_name AS name FROM nation UNION SELECT r_name FROM region) ORDER BY 1 LIMIT 8")
both("cte_several", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), top(k) AS (SELECT o_custkey FROM big WHERE total > 1000000) SELECT c_name FROM customer JOIN top ON c_custkey = k")
both("cte_recursive", "WITH RECURSIVE steps(n, v) AS (SELECT 1, 1 UNION ALL SELECT n + 1, v * 2 FROM steps WHERE n < 12) SELECT n, v FROM steps")
pair("hierarchy_levels", "WITH RECURSIVE tree(k, level, path) AS (SELECT n_nationkey, 1, CAST(n_nationkey AS STRING) FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, t.level + 1, concat(t.path, '/', CAST(n.n_nationkey AS STRING)) FROM tree t JOIN nation n ON n.n_nationkey IN (t.k * 2 + 1, t.k * 2 + 2)) SELECT k, level, path FROM tree", "WITH RECURSIVE tree(k, level, path) AS (SELECT n_nationkey, 1, CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, t.level + 1, t.path || '/' || CAST(n.n_nationkey AS VARCHAR) FROM tree t JOIN nation n ON n.n_nationkey IN (t.k * 2 + 1, t.k * 2 + 2)) SELECT k, level, path FROM tree")

# ---- headline
TOP_NATIONS = """
SELECT n_name, ship_year, revenue, place FROM (
    SELECT n_name, ship_year, revenue, CAST(rank() OVER (PARTITION BY ship_year ORDER BY revenue DESC) AS BIGINT) AS place
    FROM (
        SELECT n.n_name, CAST(EXTRACT(YEAR FROM l.l_shipdate) AS INT) AS ship_year, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
        WHERE l.l_shipdate >= TIMESTAMP '1993-01-01' GROUP BY n.n_name, CAST(EXTRACT(YEAR FROM l.l_shipdate) AS INT)
    ) sums
) ranked WHERE place <= 5
"""
both("top_nations_by_year", TOP_NATIONS)
both(
    "tpch_pricing_summary",
    """
    SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
           round(avg(l_quantity), 6) AS avg_qty, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus
    """,
)
