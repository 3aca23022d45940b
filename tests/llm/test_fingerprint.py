import hashlib
import re
import unicodedata

from pyspark.sql import functions as F

from lodewright.llm import fingerprint as fp


def canon(t):
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())
    return re.sub(r"\s+", " ", folded).strip()


def check(rows, found):
    ordered = sorted(rows, key=lambda r: -r[0])
    prints = {}
    for k, (doc, text) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        g = found[doc]
        assert (g["n_chars"], g["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert g["near_edited"] == float(canon(text) == canon(edited)) and g["near_next"] == float(canon(text) == canon(after))
        for t, f in ((text, g["fingerprint"]), (edited, g["edited_fingerprint"])):
            assert prints.setdefault(canon(t), f) == f
    assert len(set(prints.values())) == len(prints)


def test_against_python(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check(rows, {r["doc_id"]: r for r in fp.edited_fingerprints(docs).collect()})


def test_colliding_digests_are_told_apart(docs):
    weak = lambda c: (F.length(c).cast("long") % 5, F.lit(0).cast("long"))
    few = docs.filter("doc_id < 60")
    check([(r["doc_id"], r["text"]) for r in few.collect()], {r["doc_id"]: r for r in fp.edited_fingerprints(few, weak).collect()})
    classes = {r["doc_id"]: r["fingerprint"] for r in fp.exact_classes(few, "doc_id", "text", weak).collect()}
    texts = {r["doc_id"]: canon(r["text"]) for r in few.collect()}
    assert len(set(classes.values())) == len(set(texts.values()))


def test_odd_rows(odd, none):
    found = fp.edited_fingerprints(odd).collect()
    assert len(found) == 11
    by = {r["doc_id"]: r for r in found}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] and by[1]["near_next"] == 0.0
    assert by[5]["fingerprint"] == by[6]["fingerprint"] == by[7]["fingerprint"]
    assert by[7]["near_next"] == 1.0
    assert fp.edited_fingerprints(none).count() == 0 and fp.exact_classes(none, "doc_id", "text").count() == 0


def test_ranges_by_two_looks(spark):
    import bisect

    for n in (0, 1, 2, 7, 50):
        bounds = [float(3 * i) for i in range(n)]
        found = spark.range(-5, 170).select("id", fp._range_of(F.col("id").cast("double"), bounds).alias("r")).collect()
        assert all(r["r"] == bisect.bisect_right(bounds, r["id"]) for r in found)


def test_repeated_and_null_ids(spark):
    """Rows that share a doc_id, with equal and with different texts, and rows without one: each by its own text, with any digest."""
    texts = ["Alpha  beta", "alpha beta", "Other words here", "", None, "x" * 50, "Alpha  beta"]
    rows = [(i, t) for i in (1, 1, 2, None, None) for t in texts] + [(5, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    weak = lambda c: (F.length(c).cast("long") % 3, F.lit(0).cast("long"))
    for lanes in (fp.xx_lanes, weak):
        found = fp.edited_fingerprints(df, lanes).collect()
        assert len(found) == len(rows) and sorted(str((r["doc_id"], r["n_chars"])) for r in found) == sorted(str((i, len(t or ""))) for i, t in rows)
        classes = fp.exact_classes(df, "doc_id", "text", lanes).collect()
        assert len({r["fingerprint"] for r in classes}) == len({canon(t) for t in texts} | {canon("one")}) == len({r["fingerprint"] for r in found})


def test_following_keeps_other_columns(spark):
    df = spark.createDataFrame([(i, f"t{i}", i * 2, "a", "b") for i in range(40)] + [(None, "tn", 0, "a", "b")], "doc_id long, text string, _range int, next_text string, closer string")
    found = fp.following(df, "doc_id", ["text"])
    assert found.columns == ["doc_id", "text", "_range", "closer", "next_text"]
    want = {f"t{i}": f"t{i - 1}" for i in range(1, 40)} | {"t0": "tn", "tn": "t39"}
    assert {r["text"]: r["next_text"] for r in found.collect()} == want


def test_long_text(spark):
    long = "Straße und Wasser  " * 60_000  # over a million characters
    df = spark.createDataFrame([(1, long), (2, long.upper().replace("SS", "ß")), (3, "a")], "doc_id long, text string")
    check([(r["doc_id"], r["text"]) for r in df.collect()], {r["doc_id"]: r for r in fp.edited_fingerprints(df).collect()})
