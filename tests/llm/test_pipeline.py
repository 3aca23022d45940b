import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from lodewright.llm import langid, mixing, ngram_join
from lodewright.llm.text import held_out
from lodewright.storage import materialize

TOKENS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_stages_by_hand(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    one = materialize(cp.language_id(spark, docs, sf))
    told = {r["doc_id"]: r["rejected"] for r in langid.identify(docs, langid.train(docs, ~held_out("doc_id", 4, 2))).collect()}
    assert {r["doc_id"] for r in one.collect()} == {i for i, gone in told.items() if not gone} and one.columns == columns
    two = materialize(cp.near_duplicates(spark, one, sf))
    classes = {r["doc_id"]: r["class_id"] for r in ngram_join.jaccard_classes(one).collect()}
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(set(classes.values())) and two.columns == columns
    three = materialize(cp.surrogates(spark, two, sf))
    assert three.columns == columns and three.count() == two.count() and three.filter("n_chars <> length(text)").count() == 0
    four = materialize(cp.source_mixing(spark, three, sf))
    assert sorted(r["doc_id"] for r in four.collect()) == sorted(r["doc_id"] for r in mixing.mix(three).filter("kept").collect()) and four.columns == columns
    five = cp.best_fit_packing(spark, four, sf)
    assert five.select("doc_id").distinct().count() == four.count()
    end = five.groupBy("sequence_id").agg(F.max(F.col("offset") + F.col("length")).alias("e"), F.sum("length").alias("s"))
    assert end.filter("e <> s OR s > 4096").count() == 0
    whole = cp.run(spark, sf)
    assert whole.count() == five.count() and [s for s, _ in cp.STAGES] == ["language ID", "n-gram Jaccard join", "PII", "mixing sources to target weights", "best-fit packing"]


def test_odd_rows_through_all_stages(spark, odd, none):
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for docs in (plain, odd):
        columns = docs.columns
        one = materialize(cp.language_id(spark, docs, ""))
        ids = [r["doc_id"] for r in one.collect()]
        assert one.columns == columns and {5, 6, 7, 8} <= set(ids) and not {1, 2, 9} & set(ids) and ids.count(6) == 2
        two = materialize(cp.near_duplicates(spark, one, ""))
        left = sorted(r["doc_id"] for r in two.collect())
        assert two.columns == columns and left == sorted(set(ids) - {6, 7})
        three = materialize(cp.surrogates(spark, two, ""))
        texts = {r["doc_id"]: r["text"] for r in two.collect()}
        new = {r["doc_id"]: r["text"] for r in three.collect()}
        assert three.columns == columns and all(new[i] == texts[i] for i in texts if i != 3) and (3 not in new or "jo.doe" not in new[3])
        four = materialize(cp.source_mixing(spark, three, ""))
        assert four.columns == columns and {r["doc_id"] for r in four.collect()} <= set(new)
        five = cp.best_fit_packing(spark, three, "")
        tokens = {i: len(TOKENS.encode(t, add_special_tokens=False).ids) + 1 for i, t in new.items()}
        assert {r["doc_id"]: r["n"] for r in five.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == tokens
    for _, stage in cp.STAGES:
        none = materialize(stage(spark, none, ""))
        assert none.count() == 0


def test_missing_and_repeated_ids_lose_no_document(spark):
    """Documents that differ, some without an id and some that share one, and copies of them; what is written in the middle of it is not read by name."""
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("lang = 'en' AND length(text) > 200").dropDuplicates(["text"]).orderBy("doc_id").limit(40)
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for k, r in enumerate(base.collect())]
    docs = spark.createDataFrame(rows + rows[:9], "doc_id long, text string, lang string, source string, n_chars long")
    one = materialize(cp.language_id(spark, docs, ""))
    two = materialize(cp.near_duplicates(spark, one, ""))
    classes = ngram_join.classed_rows(one).select("class_id").distinct().count()
    assert two.count() == classes == two.select("text").distinct().count() and classes > 20
    three = materialize(cp.surrogates(spark, two, ""))
    assert three.count() == classes
    four = materialize(cp.source_mixing(spark, three, ""))
    kept = sum(r["kept"] for r in mixing.mix(three).collect())
    assert four.count() == kept > 0


def test_whole_run_is_the_stages_one_by_one(spark, sf):
    """Every piece of the run belongs to a document that the stages keep, found again by plain Python from its tokens."""
    spark.conf.set("spark.lodewright.pii.key", "a key")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf))
    want = {}
    for r in docs.collect():
        ids = np.array([*TOKENS.encode(r["text"], add_special_tokens=False).ids, 1], dtype="<u4")
        for i, at in enumerate(range(0, len(ids), 4096)):
            want[r["doc_id"], i] = (at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes()))
    found = cp.run(spark, sf).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in found} == want and len(found) == len(want)
