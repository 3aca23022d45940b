import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lodewright.functions import jsons, net, pg, planar, ranges, xml


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_numbers(spark):
    assert one(spark, pg.int_div(F.lit(-7), F.lit(2)), pg.trunc(F.lit(-1.29), 1), pg.log10(F.lit(1000.0))) == (-3, -1.2, pytest.approx(3.0))
    assert float(one(spark, pg.prorate(F.lit(1), F.lit(1), F.lit(8), 2))[0]) == 12.0
    assert str(one(spark, pg.exact_list_sum(F.array(F.lit("0.1").cast("decimal(10,1)"), F.lit("0.2").cast("decimal(10,1)")), 1))[0]) == "0.3"


def test_text(spark):
    assert one(spark, pg.initcap(F.lit("ab-cd éF_x")), pg.substring(F.lit("hello"), -1, 4), pg.substring(F.lit("hello"), 3)) == ("Ab-Cd Éf_X", "he", "llo")
    assert one(spark, pg.regexp_replace(F.lit("aXbX"), "x", "-", "i"), pg.regexp_replace(F.lit("aXbX"), "X", "-", "g"), pg.regexp_replace(F.lit("ab12"), r"([a-z])(\d)", r"\2\1")) == ("a-bX", "a-b-", "a1b2")
    assert one(spark, pg.regexp_match(F.lit("k=v"), "(.)=(.)"), pg.regexp_match(F.lit("k"), "="), pg.string_to_array(F.lit(""), ","), pg.string_to_array(F.lit("a.b."), ".")) == (["k", "v"], None, [], ["a", "b", ""])
    assert one(spark, pg.format_text("%s %I %L%%", F.lit("a"), F.lit("B c"), F.lit("it's")), pg.format_text("%L", F.lit(None))) == ("a \"B c\" 'it''s'%", "NULL")
    assert one(spark, pg.similarity(F.lit("word"), F.lit("two words")))[0] == pytest.approx(4 / 11)
    assert one(spark, pg.chr_(F.lit(300)), pg.split_part(F.lit("a,b,c"), ",", -1)) == ("Ĭ", "c")


def test_dates(spark):
    d = lambda s: F.lit(s).cast("timestamp_ntz")
    assert tuple(one(spark, pg.age_parts(d("2024-03-01"), d("2023-01-31")))[0]) == (1, 1, 1)
    assert one(spark, pg.add_months_keep_end(F.to_date(F.lit("2024-02-29")), 1), pg.add_months_keep_end(F.to_date(F.lit("2024-01-30")), 1)) == (date(2024, 3, 31), date(2024, 2, 29))
    assert one(spark, pg.trunc_date(d("2024-05-15"), "W"), pg.trunc_date(d("2024-05-15"), "CC"), pg.to_char(d("2024-05-15 13:02:03"), "DD MON YYYY HH24:MI:SS")) == (date(2024, 5, 15), date(2001, 1, 1), "15 May 2024 13:02:03")
    assert one(spark, pg.add_days(d("2024-01-01"), F.lit(1.5)))[0] == datetime(2024, 1, 2, 12)


def test_arrays(spark):
    a = F.array(F.lit(1), F.lit(1), F.lit(2), F.lit(None).cast("int"))
    b = F.array(F.lit(1), F.lit(3))
    assert one(spark, pg.multiset_intersect(a, b), pg.multiset_except(a, b), pg.array_slice(a, 0, 2), pg.array_length(F.array())) == ([1], [1, 2, None], [1, 1], None)
    assert one(spark, pg.array_text(F.array(F.lit("a b"), F.lit(None), F.lit(""), F.lit('q"'), F.lit("z"))))[0] == '{"a b",NULL,"","q\\"",z}'
    u = F.lit("{0190163D-8694-739B-AEA5-966C26F8AD91}")
    assert one(spark, pg.uuid_version(u), pg.uuid_canonical(u)) == (7, "0190163d-8694-739b-aea5-966c26f8ad91") and one(spark, pg.uuid_timestamp(u))[0].year == 2024


DOC = json.dumps({"a": {"b": [1, 2, {"c": "xyz"}]}, "n": None, "t": True, "list": [{"p": 5, "q": "one"}, {"p": 12, "q": "two"}]})


@pytest.mark.parametrize(
    ("path", "found"),
    [
        ("$.a.b[0]", [1]), ("$.a.b[last].c", ["xyz"]), ("$.list[*] ? (@.p > 6).q", ["two"]), ("$.list.p", [5, 12]), ("$.a.b.size()", [3]), ("$.a.b[0 to 1]", [1, 2]), ("$.none", []), ("$.list[*] ? (@.q starts with \"o\").p", [5]),
        ('$.list[*] ? (@.q like_regex "^T" flag "i").p', [12]), ("$.a.b[0] + 3 * 2", [7]), ("$.list[*] ? (exists(@.p) && !(@.p == 5)).q", ["two"]), ("$.t", [True]), ("$.n", [None]), ("$.a.type()", ["object"]), ("$.list[*].p ? (@ > $low)", [12]),
    ],
)
def test_jsonpath(path, found):
    assert jsons.JsonPath(path).query(json.loads(DOC), {"low": 6}) == found


def test_jsonpath_strict_and_errors(spark):
    with pytest.raises(LookupError):
        jsons.JsonPath("strict $.none").query({"a": 1})
    with pytest.raises(ValueError):
        jsons.JsonPath("$.a ?? 1")
    j = F.lit(DOC)
    assert one(spark, jsons.path_exists(j, "$.list ? (@.p == 5)"), jsons.path_match(j, "$.t == true"), jsons.path_query_first(j, "$.list[1]"), jsons.path_exists(j, "strict $.x", silent=True)) == (True, True, '{"p":12,"q":"two"}', None)


def test_json_containment_and_keys(spark):
    j = F.lit(DOC)
    assert one(spark, jsons.contains(j, '{"list": [{"p": 12}]}'), jsons.contains(j, '{"a": {"b": [3]}}'), jsons.contains(F.lit("[1, 2]"), "2"), jsons.has_any(j, ["zz", "t"]), jsons.has_all(j, ["zz", "t"])) == (True, False, True, True, False)
    assert one(spark, jsons.get_text(j, "a", "b", 2, "c"), jsons.type_of(F.lit(" [1]"))) == ("xyz", "array")


def test_ranges(spark):
    r = lambda lo, hi, b="[)": ranges.make(F.lit(lo), F.lit(hi), b)
    assert one(spark, ranges.overlaps(r(1, 5), r(5, 9)), ranges.overlaps(r(1, 5, "[]"), r(5, 9)), ranges.adjacent(r(1, 5), r(5, 9)), ranges.contains(r(1, 9), r(2, 3)), ranges.contains(r(1, 9), r(3, 3))) == (False, True, True, True, True)
    assert one(spark, ranges.text(ranges.intersect(r(1, 5), r(3, 9))), ranges.text(ranges.merge(r(1, 2), r(7, 9))), ranges.text(ranges.intersect(r(1, 3), r(5, 9))), ranges.text(ranges.union(r(1, 5), r(5, 9, "[]")))) == ("[3,5)", "[1,9)", "empty", "[1,9]")
    assert one(spark, ranges.text(ranges.make(F.lit(1), F.lit(4), "(]", discrete=True)), ranges.has(ranges.make(F.lit(None).cast("int"), F.lit(4)), F.lit(-99))) == ("[2,5)", True)
    with pytest.raises(Exception, match="contiguous"):
        one(spark, ranges.union(r(1, 2), r(5, 6)))


def test_multiranges(spark):
    r = lambda lo, hi: ranges.make(F.lit(lo), F.lit(hi))
    m = ranges.multi(F.array(r(7, 9), r(1, 3), r(2, 5), r(5, 6), r(4, 4)))
    other = ranges.multi(F.array(r(0, 2), r(8, 12)))
    assert one(spark, ranges.multi_text(m), ranges.multi_text(ranges.multi_union(m, other)), ranges.multi_text(ranges.multi_intersect(m, other)), ranges.multi_has(m, F.lit(5)), ranges.multi_has(m, F.lit(6))) == ("{[1,6),[7,9)}", "{[0,6),[7,12)}", "{[1,2),[8,9)}", True, False)


def test_exact_sums(spark):
    big = "9999999999999999999999999.99"
    df = spark.createDataFrame([(big,)] * 7 + [("-0.01",)], "s string").select(F.col("s").cast("decimal(38,10)").alias("x"))
    assert df.agg(pg.exact_sum_units("x", 2)).first()[0] == str(7 * 999999999999999999999999999 - 1)
    small = spark.createDataFrame([("-3.5",), ("1.25",)], "s string").select(F.col("s").cast("decimal(38,10)").alias("x"))
    assert small.agg(pg.exact_sum_units("x", 2)).first()[0] == "-225" and small.limit(0).agg(pg.exact_sum_units("x", 2)).first()[0] == "0"
    with pytest.raises(Exception, match="finer"):
        small.agg(pg.exact_sum_units("x", 1)).collect()
    with pytest.raises(Exception, match="null"):
        small.unionByName(small.limit(1).select(F.lit(None).cast("decimal(38,10)").alias("x"))).agg(pg.exact_sum_units("x", 2)).collect()


def test_networks(spark):
    a, b = F.lit("192.168.1.5/24"), F.lit("192.168.0.0/16")
    assert one(spark, net.network(a), net.broadcast(a), net.netmask(a), net.hostmask(a), net.host(a), net.masklen(a), net.family(F.lit("::1"))) == ("192.168.1.0/24", "192.168.1.255/24", "255.255.255.0", "0.0.0.255", "192.168.1.5", 24, 6)
    assert one(spark, net.within(a, b), net.within(b, b), net.within_or_equal(b, b), net.overlap(a, b), net.merge(a, F.lit("192.168.2.1/24")), net.add(a, 10), net.set_masklen(a, 16)) == (True, False, True, True, "192.168.0.0/22", "192.168.1.15/24", "192.168.1.5/16")
    assert one(spark, net.invert(F.lit("255.255.0.1")), net.bit_and(a, F.lit("255.255.0.0")), net.difference(F.lit("10.0.0.9"), F.lit("10.0.0.2")), net.mac_trunc(F.lit("12:34:56:78:90:ab")), net.mac_to_eui64(F.lit("00:34:56:78:90:ab"))) == ("0.0.255.254", "192.168.0.0", 7, "12:34:56:00:00:00", "02:34:56:ff:fe:78:90:ab")


def test_planar(spark):
    p = lambda x, y: planar.point(F.lit(x), F.lit(y))
    s, t = planar.segment(p(0, 0), p(4, 4)), planar.segment(p(0, 4), p(4, 0))
    square = F.array(p(0, 0), p(4, 0), p(4, 4), p(0, 4))
    assert one(spark, planar.segments_meet(s, t), planar.segments_perpendicular(s, t), planar.segments_parallel(s, t), planar.on_segment(p(2, 2), s), planar.segment_length(planar.segment(p(0, 0), p(3, 4)))) == (True, True, False, True, 5.0)
    assert one(spark, planar.polygon_area(square), planar.polygon_has(square, p(1, 3)), planar.polygon_has(square, p(5, 3)), planar.path_length(square, True), planar.path_length(square)) == (16.0, True, False, 16.0, 12.0)
    b1, b2 = planar.box(p(0, 0), p(2, 2)), planar.box(p(1, 1), p(3, 3))
    assert one(spark, planar.boxes_overlap(b1, b2), planar.box_area(planar.box_intersection(b1, b2)), planar.diameter(planar.circle(p(0, 0), F.lit(2))), planar.segment_point_distance(s, p(0, 4))) == (True, 1.0, 4.0, pytest.approx(8**0.5))
    assert tuple(one(spark, planar.times(p(1, 2), p(3, 4)))[0]) == (-5.0, 10.0)


def test_xml(spark):
    doc = xml.element("a", xml.forest(b=F.lit("1<2"), c=F.lit(None).cast("string")), attributes={"k": F.lit('"q"'), "z": F.lit(None).cast("string")})
    assert one(spark, doc, xml.element("e"), xml.comment(F.lit("x")), xml.instruction("php", F.lit("y"))) == ('<a k="&quot;q&quot;"><b>1&lt;2</b></a>', "<e/>", "<!--x-->", "<?php y?>")
    assert one(spark, xml.xpath(doc, "/a/b/text()"), xml.xpath(doc, "/a/@k"), xml.xpath(F.lit('<r xmlns:n="u"><n:x>1</n:x></r>'), "/r/n:x/text()", {"n": "u"}), xml.is_document(F.lit("<a/><b/>"))) == (["1<2"], ['"q"'], ["1"], False)
