import pytest

from lodewright.plans.front import rewrite, sql


def got(spark, text, **tables):
    return [tuple(r) for r in sql(spark, text, tables).collect()]


@pytest.fixture
def t(spark):
    return spark.createDataFrame([(1, "a", 10), (1, "b", 30), (2, "c", None), (2, "d", 5), (3, "e", 7)], "k int, name string, v int")


def test_generate_series(spark):
    assert got(spark, "SELECT * FROM generate_series(1, 5, 2)") == [(1,), (3,), (5,)]
    assert got(spark, "SELECT n FROM generate_series(3, 1) g(n)") == []
    assert got(spark, "SELECT n FROM generate_series(5, 1, -2) AS g(n) WHERE n > 1") == [(5,), (3,)]


def test_any_and_all(spark, t):
    assert got(spark, "SELECT name FROM t WHERE v = ANY(array(5, 7)) ORDER BY name", t=t) == [("d",), ("e",)]
    assert got(spark, "SELECT 3 < ALL(array(4, 5)), 3 = ANY(array(1, CAST(NULL AS INT))), 1 = ANY(array())") == [(True, None, False)]


def test_distinct_on(spark, t):
    assert got(spark, "SELECT DISTINCT ON (k) k, name FROM t ORDER BY k, v DESC", t=t) == [(1, "b"), (2, "c"), (3, "e")]
    with pytest.raises(ValueError, match="must match"):
        rewrite("SELECT DISTINCT ON (k) k FROM t ORDER BY v")


@pytest.mark.parametrize(("predicate", "ids"), [("= 1", [1]), ("= 2", []), ("<= 2", [1, 2]), ("< 3", [1, 2]), ("> 1", []), (">= 2", []), (">= 1", [1, 2, 3]), ("> 0", [1, 2, 3]), ("<> 2", [1]), ("<> 1", [])])
def test_rownum(spark, predicate, ids):
    assert [r[0] for r in got(spark, f"SELECT id FROM (SELECT id FROM (VALUES (1), (2), (3)) v(id) ORDER BY id) WHERE ROWNUM {predicate}")] == ids


def test_groups_frames_and_inheritance(spark, t):
    found = got(spark, "SELECT name, count(*) OVER (ORDER BY k GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM t ORDER BY name", t=t)
    assert found == [("a", 2), ("b", 2), ("c", 4), ("d", 4), ("e", 3)]
    found = got(spark, "SELECT name, row_number() OVER (w ORDER BY name DESC) AS n FROM t WINDOW w AS (PARTITION BY k) ORDER BY name", t=t)
    assert found == [("a", 2), ("b", 1), ("c", 2), ("d", 1), ("e", 1)]


def test_outer_plus_dual_and_limits(spark, t):
    u = spark.createDataFrame([(1, "x")], "k int, w string")
    assert got(spark, "SELECT a.name, b.w FROM t a, u b WHERE a.k = b.k (+) AND a.v > 6 ORDER BY 1", t=t, u=u) == [("a", "x"), ("b", "x"), ("e", None)]
    assert got(spark, "SELECT 1 + 1 FROM DUAL") == [(2,)]
    assert len(got(spark, "SELECT k FROM t LIMIT NULL", t=t)) == 5
    assert got(spark, "SELECT name FROM t ORDER BY name OFFSET 1 ROWS FETCH NEXT 2 ROWS ONLY", t=t) == [("b",), ("c",)]


def test_date_bin(spark):
    assert str(got(spark, "SELECT date_bin(INTERVAL '15' MINUTE, TIMESTAMP_NTZ '2024-03-01 10:44:59', TIMESTAMP_NTZ '2024-03-01 00:00:00')")[0][0]) == "2024-03-01 10:30:00"


def test_versions(spark):
    v = spark.createDataFrame([(1, "old", 10, 20), (1, "new", 20, None), (2, "only", 15, None)], "id int, x string, start_scn long, end_scn long")
    assert got(spark, "SELECT id, x FROM v AS OF SCN 12", v=v) == [(1, "old")]
    assert got(spark, "SELECT id, x FROM v FOR SYSTEM_TIME AS OF 20 ORDER BY id", v=v) == [(1, "new"), (2, "only")]
    assert got(spark, "SELECT x, versions_startscn, versions_endscn FROM v VERSIONS BETWEEN SCN 12 AND 30 ORDER BY x", v=v) == [("new", 20, None), ("old", None, 20), ("only", 15, None)]


def test_quoted_text_is_left_alone(spark, t):
    assert got(spark, "SELECT ' FROM DUAL', 'LIMIT NULL', 'it''s ~ (+) a->b ::int', 'back\\slash', E'tab\\tend', $$don't -- touch$$ -- a comment ' FROM DUAL\n FROM /* FETCH FIRST /* nested */ ROW ONLY */ DUAL") == [
        (" FROM DUAL", "LIMIT NULL", "it's ~ (+) a->b ::int", "back\\slash", "tab\tend", "don't -- touch")
    ]
    assert got(spark, 'SELECT k AS "limit null" FROM t WHERE name = \'a\'', t=t) == [(1,)]


def test_distinct_on_at_any_depth(spark, t):
    assert got(spark, "SELECT DISTINCT ON (k) k, name FROM t ORDER BY k DESC, v DESC LIMIT 2", t=t) == [(3, "e"), (2, "c")]
    assert got(spark, "SELECT count(*) FROM (SELECT DISTINCT ON (k) k, name FROM t ORDER BY k, name) x", t=t) == [(3,)]
    assert got(spark, "WITH d AS (SELECT DISTINCT ON (k) k, name FROM t ORDER BY k, name DESC) SELECT name FROM d WHERE k > 1 ORDER BY name", t=t) == [("d",), ("e",)]
    rows = spark.range(1000).selectExpr("CAST(id % 100 AS INT) AS k", "CAST(id AS INT) AS v")
    assert got(spark, "SELECT DISTINCT ON (k) k, v FROM r ORDER BY k DESC, v DESC LIMIT 3", r=rows) == [(99, 999), (98, 998), (97, 997)]


def test_rownum_among_other_terms(spark):
    three = "(SELECT v FROM (VALUES (3), (2), (1)) x(v))"
    cases = {"2 >= ROWNUM": [3, 2], "v <> 3 AND ROWNUM <= 1": [2], "ROWNUM >= 1 AND ROWNUM < 3": [3, 2], "ROWNUM <= 0": [], "ROWNUM <= -1": [], "v BETWEEN 1 AND 2 AND ROWNUM < 5": [2, 1]}
    for predicate, want in cases.items():
        assert [r[0] for r in got(spark, f"SELECT v FROM {three} q WHERE {predicate}")] == want
    assert [r[0] for r in got(spark, f"SELECT v FROM {three} q WHERE ROWNUM <= 2 ORDER BY v")] == [2, 3]
    assert got(spark, f"SELECT count(*) FROM (SELECT v FROM {three} q WHERE ROWNUM < 3) z") == [(2,)]


def test_outer_plus_over_three_tables(spark):
    a = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "id int, x int")
    b = spark.createDataFrame([(1, 7), (2, 8)], "id int, c int")
    c = spark.createDataFrame([(7, "seven")], "id int, name string")
    text = "SELECT a.id, b.c, c.name FROM a, b, c WHERE a.id = b.id (+) AND b.c = c.id(+) AND a.x < 30 ORDER BY 1"
    assert got(spark, text, a=a, b=b, c=c) == [(1, 7, "seven"), (2, 8, None)]


def test_operators(spark, t):
    j = spark.createDataFrame([(1, '{"a": {"b": "x", "n": 5}, "tags": ["p", "q"]}'), (2, '{"a": {"b": "y"}}')], "id int, j string")
    assert got(spark, "SELECT id FROM j WHERE j -> 'a' ->> 'b' = 'x'", j=j) == [(1,)]
    assert got(spark, "SELECT j -> 'a' -> 'b', j #>> '{tags,1}', (j -> 'a' ->> 'n')::int + 1 FROM j ORDER BY id", j=j) == [('"x"', "q", 6), ('"y"', None, None)]
    assert got(spark, """SELECT id FROM j WHERE j @> '{"tags": ["q"]}'""", j=j) == [(1,)]
    assert got(spark, """SELECT id FROM j WHERE j::jsonb @> '{"a": {"b": "y"}}'::jsonb""", j=j) == [(2,)]
    assert got(spark, "SELECT id, j ? 'tags', j ?| ARRAY['x', 'a'], j ?& ARRAY['a', 'tags'] FROM j ORDER BY id", j=j) == [(1, True, True, True), (2, False, True, False)]
    assert got(spark, "SELECT name FROM t WHERE name ~ '^[ab]$' AND name !~ 'b' OR name ~* 'E' ORDER BY 1", t=t) == [("a",), ("e",)]
    assert got(spark, "SELECT name ILIKE ANY (ARRAY['A%', 'B%']), name LIKE ALL ('{a,%}'::text[]) FROM t ORDER BY name LIMIT 2", t=t) == [(True, True), (True, False)]
    assert got(spark, "SELECT ARRAY[1,2,3] @> ARRAY[2], ARRAY[1,2] && ARRAY[3], ARRAY[2] <@ ARRAY[1,2], (ARRAY[5,6,7,8])[2:3]") == [(True, False, True, [6, 7])]
    assert got(spark, "SELECT round('[1,0]'::vector <=> '[1,1]'::vector, 6), '[3,4]'::vector <-> '[0,0]'::vector, ARRAY[1,2] <#> ARRAY[3,4]") == [(0.292893, 5.0, -11.0)]
    assert got(spark, "SELECT (k, v) BETWEEN (1, 20) AND (2, 5) FROM t ORDER BY name", t=t) == [(False,), (True,), (True,), (True,), (False,)]
    assert got(spark, "SELECT '12'::int8 + 1, 1.5::numeric(5,2)::text, 'x'::varchar(3), '{1,2}'::int[]") == [(13, "1.50", "x", [1, 2])]


def test_other_functions(spark):
    assert got(spark, "SELECT NVL(NULL, 3), NVL2(NULL, 'a', 'b'), DECODE(NULL, 1, 'x', NULL, 'n', 'z'), DECODE(5, 1, 'x', 'z')") == [(3, "b", "n", "z")]
    assert got(spark, "SELECT REGEXP_SUBSTR('one two three', '[a-z]+', 1, 2), REGEXP_SUBSTR('a1b22', '([a-z])(\\d+)', 1, 2, 'i', 2), regexp_split_to_array('a, b,c', ',\\s*')") == [("two", "22", ["a", "b", "c"])]
    assert got(spark, "SELECT encode(decode('6869', 'hex'), 'base64'), CAST(HEXTORAW('4142') AS STRING), RAWTOHEX('AB'), array_upper(ARRAY[4,5], 1), array_dims(ARRAY[4,5]), array_lower(array(), 1)") == [("aGk=", "AB", "4142", 2, "[1:2]", None)]
    assert str(got(spark, "SELECT TIMESTAMP_NTZ '2024-07-01 12:00:00' + make_interval(days => 2, hours => 3)")[0][0]) == "2024-07-03 15:00:00"
    assert [str(x) for x in got(spark, "SELECT DATE '2024-01-31' + NUMTOYMINTERVAL(1, 'MONTH'), TIMESTAMP_NTZ '2024-01-01 00:00:00' + NUMTODSINTERVAL(90, 'MINUTE')")[0]] == ["2024-02-29", "2024-01-01 01:30:00"]
    found = got(spark, "SELECT TIMESTAMP_NTZ '2024-07-01 12:00:00' AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC', timezone('Asia/Tokyo', '2024-07-01 12:00:00'::timestamptz)")[0]
    assert [str(x) for x in found] == ["2024-07-01 16:00:00", "2024-07-01 21:00:00"]
    assert got(spark, 'SELECT x FROM (VALUES (\'b\'), (\'A\'), (\'a\')) v(x) ORDER BY x COLLATE "C"') == [("A",), ("a",), ("b",)]
    assert got(spark, 'SELECT x FROM (VALUES (\'b\'), (\'A\'), (\'a\')) v(x) ORDER BY x COLLATE "en_US"') == [("a",), ("A",), ("b",)]
    assert got(spark, "SELECT SYSDATE <= SYSTIMESTAMP::timestamp, SYSDATE > TIMESTAMP_NTZ '2020-01-01 00:00:00'") == [(True, True)]


def test_unnest(spark):
    d = spark.createDataFrame([(1, ["a", "b"], [5, 6, 7]), (2, [], [8])], "id int, w array<string>, n array<int>")
    assert got(spark, "SELECT d.id, x.word, x.ord FROM d, unnest(d.w) WITH ORDINALITY AS x(word, ord) ORDER BY 1, 3", d=d) == [(1, "a", 1), (1, "b", 2)]
    assert got(spark, "SELECT d.id, x.a, x.b FROM d, unnest(d.w, d.n) AS x(a, b) ORDER BY 1, 3", d=d) == [(1, "a", 5), (1, "b", 6), (1, None, 7), (2, None, 8)]
    assert got(spark, "SELECT d.id, s.i FROM d, generate_subscripts(d.n, 1, true) AS s(i)", d=d) == [(1, 3), (1, 2), (1, 1), (2, 1)]
    assert got(spark, "SELECT unnest(ARRAY[1, 2]) AS x") == [(1,), (2,)]


def test_connect_by(spark):
    n = spark.createDataFrame([(1, None, "root"), (2, 1, "b"), (3, 1, "a"), (4, 3, "leaf")], "id int, boss int, name string")
    text = "SELECT LEVEL, name, SYS_CONNECT_BY_PATH(id, '/') AS p FROM n WHERE name <> 'root' START WITH boss IS NULL CONNECT BY PRIOR id = boss ORDER SIBLINGS BY name"
    assert got(spark, text, n=n) == [(2, "a", "/1/3"), (3, "leaf", "/1/3/4"), (2, "b", "/1/2")]
    assert got(spark, "SELECT LEVEL FROM DUAL CONNECT BY LEVEL <= 3") == [(1,), (2,), (3,)]
    assert got(spark, "SELECT sum(x) FROM (SELECT LEVEL * 2 AS x FROM DUAL CONNECT BY LEVEL < 4) s") == [(12,)]
