import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodewright.llm import langid, queries, quality, toxicity
from lodewright.llm.text import bounded_sample, held_out, labelled


def rest(doc, n):
    return zlib.crc32(str(doc).encode()) % n


@pytest.fixture(scope="module")
def larger():
    return "/root/testdata/sf0.01"


def scored(spark, larger, name, label):
    found = queries.queries()[name](spark, larger).collect()
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{larger}/documents.parquet").count()
    assert len(found) == docs and all(0 <= r["score"] <= 1 for r in found)
    assert all(r["held_out"] == (rest(r["doc_id"], 5) == 0) for r in found)
    return [(r["predicted"], labels[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in labels]


def test_quality_held_out(spark, larger):
    pairs = scored(spark, larger, "op4_quality_classifier", "quality")
    assert np.mean([p == y for p, y in pairs]) > 0.95


def test_toxicity_held_out(spark, larger):
    pairs = scored(spark, larger, "op10_toxicity", "toxic")
    assert np.mean([p == y for p, y in pairs]) > 0.93 and np.mean([p == 0 for p, y in pairs if y == 0]) > 0.97


def test_language_held_out(spark, larger):
    found = {r["doc_id"]: r for r in queries.queries()["op8_language_id"](spark, larger).collect()}
    docs = spark.read.parquet(f"{larger}/documents.parquet").collect()
    assert len(found) == len(docs) and all(found[r["doc_id"]]["held_out"] == (rest(r["doc_id"], 4) == 2) for r in docs)
    assert np.mean([found[r["doc_id"]]["lang_pred"] == r["lang"] for r in docs if found[r["doc_id"]]["held_out"]]) > 0.96


def test_language_odd_rows(odd, none):
    learned = langid.train(odd, F.lit(True))
    found = {r["doc_id"]: r for r in langid.identify(odd, learned).collect()}
    assert [found[i]["lang_pred"] for i in (1, 2, 9)] == ["und"] * 3 and found[1]["rejected"] and found[8]["lang_pred"] == "en"
    assert langid.identify(none, learned).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, langid.train(none, F.lit(True))).collect()} == {"und"}


def test_repeats_count_every_adjacent_pair():
    at = quality.NAMES.index("repeats")
    for size in (0, 1, 2, 199, 200, 201, 400, 1001):  # twice a passage of odd and of even length
        words = [f"w{i * i % 977}" for i in range(size)] * 2
        pairs = Counter(zip(words, words[1:], strict=False))
        assert quality.statistics(" ".join(words))[at] == pytest.approx(sum(v for v in pairs.values() if v > 1) / max(1, len(words) - 1))


def test_letters():
    assert [bool(langid.letters(t)) for t in ("a", "Ω", "本", "12 ² ½ ___ !?", "", " \n")] == [True, True, True, False, False, False]


def test_scores_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 1), (5, 1, None), (6, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")
    stats = quality.features(odd)
    forest = quality.fit(stats, labels, "quality", F.lit(True))
    got = quality.score(stats, forest).collect()
    assert len(got) == 11 and all(0 <= r["score"] <= 1 for r in got)
    model = toxicity.fit(odd, labels, "toxic", F.lit(True), min_docs=1)
    got = toxicity.score(odd, model).collect()
    assert len(got) == 11 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(quality.features(none), forest).count() == 0 and toxicity.score(none, model).count() == 0
    bare = toxicity.fit(odd, labels.limit(0), "toxic", F.lit(True))
    assert all(r["score"] < 1e-9 for r in toxicity.score(odd, bare).collect())
    assert quality.score(stats, quality.fit(stats, labels.limit(0), "quality", F.lit(True))).first()["score"] == 0.5


def test_trees_separate_what_a_line_cannot():
    rng = np.random.default_rng(1)
    x = rng.random((800, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    forest = quality.grow(x, y)
    assert ((forest.probability(x) > 0.5) == y).mean() > 0.97
    slow = []
    for row in x[:20]:
        total = forest.bias
        for f, t, v in zip(forest.feature, forest.threshold, forest.value, strict=True):
            at = 0
            for _ in range(forest.depth):
                at = 2 * at + 1 + int(row[f[at]] > t[at])
            total += v[at - (2**forest.depth - 1)]
        slow.append(total)
    assert np.allclose(slow, forest.margin(x[:20]))


def test_chunks_hold_every_ngram(monkeypatch):
    text = "abcdefghij " * 30
    whole = np.unique(np.concatenate(list(toxicity.slots(text))))
    monkeypatch.setattr(toxicity, "CHUNK", 50)
    assert (np.unique(np.concatenate(list(toxicity.slots(text)))) == whole).all()


def test_sample_is_bounded(docs, spark):
    n = docs.count()
    assert 20 < bounded_sample(docs, 50).count() <= 50 and bounded_sample(docs, 10_000).count() == n
    assert docs.filter(held_out("doc_id", 5, 0)).count() == sum(rest(r["doc_id"], 5) == 0 for r in docs.collect())
    same = spark.range(500).select(F.lit(3).cast("long").alias("doc_id"), F.lit("one text").alias("text"))
    twice = spark.createDataFrame([(3, 1)] * 40 + [(3, 0), (None, 1)], "doc_id long, toxic int")
    assert labelled(same, twice, "toxic", F.lit(True), 60).count() == 60
    assert {r["_label"] for r in labelled(same, twice, "toxic", F.lit(True), 10_000).collect()} == {0, 1}
    nulls = spark.createDataFrame([(None,), (4,)], "doc_id long").select("doc_id", held_out("doc_id", 5, 0).alias("h")).collect()
    assert [r["h"] for r in nulls] == [True, rest(4, 5) == 0]


def slow_statistics(text):
    """The statistics one by one."""
    import math

    text = text or ""
    if not text:
        return [0.0] * len(quality.NAMES)
    data, words, lines = text.encode(), text.split(), [x for x in text.split("\n") if x.strip()]
    kinds = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "\t\n\r ", None, ".;:", ",'\"-()", "!?", "|", "#$%&*@^~=+<>{}[]\\_/`"]
    share = [sum(b >= 128 for b in data) if k is None else sum(chr(b) in k for b in data) for k in kinds]
    share.append(len(data) - sum(share))
    w, k = max(1, len(words)), max(1, len(lines))
    mean = sum(map(len, words)) / len(words) if words else 0
    pairs = Counter(zip(words, words[1:], strict=False))
    return [
        math.log1p(len(data)), math.log1p(len(words)), math.log1p(len(lines)), *(x / len(data) for x in share),
        mean, math.sqrt(sum((len(x) - mean) ** 2 for x in words) / len(words)) if words else 0, sum(len(x) > 14 for x in words) / w, sum(len(x) < 4 for x in words) / w,
        math.log1p(sum(map(len, lines)) / len(lines)) if lines else 0, sum(len(x) < 30 for x in lines) / k, 1 - len(set(lines)) / k, len(set(words)) / w, max(Counter(words).values(), default=0) / w,
        len(zlib.compress(data, 1)) / len(data), sum(v for v in pairs.values() if v > 1) / max(1, len(words) - 1), sum(x[0].isupper() for x in words) / w, sum(x.rstrip()[-1] in ".!?" for x in lines) / k,
    ]


def test_statistics_one_by_one(docs, odd):
    for df in (docs, odd):
        for r in quality.features(df.select("doc_id", "text", F.col("text").alias("whole"))).collect():
            assert r["stats"] == pytest.approx(slow_statistics(r["whole"]), rel=1e-5, abs=1e-6)


def slow_slots(text):
    """The n-grams of a text, hashed one character at a time."""
    import re

    text = text or ""
    text = f" {re.sub(' +', ' ', ''.join(c if c.isalnum() and not c.isdigit() else ' ' for c in text.lower()))} "
    found = set()
    for at in range(len(text)):
        h = 0x811C9DC5
        for n in range(1, max(toxicity.SIZES) + 1):
            if at + n > len(text):
                break
            h = ((h ^ ord(text[at + n - 1])) * 0x01000193) % 2**32
            if n in toxicity.SIZES:
                found.add((((h ^ (h >> 15)) * 0x2C1B3C6D) % 2**32) >> (32 - toxicity.HASH_BITS))
    return found


def test_toxicity_against_plain_python(spark):
    """Ratios and scores of a small table, counted with sets."""
    import math

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 3000").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = {r["doc_id"]: slow_slots(r["text"] or "") for r in docs.collect()}
    known = [(rows[r["doc_id"]], r["toxic"]) for r in labels.collect() if r["doc_id"] in rows and r["toxic"] is not None]
    n = Counter(y for _, y in known)
    counts = {y: Counter(s for found, k in known for s in found if k == y) for y in (0, 1)}
    want = {}
    for s in set(counts[0]) | set(counts[1]):
        t, c = counts[1][s] + 1, counts[0][s] + 1
        z = math.log(t / (n[1] + 2)) - math.log(c / (n[0] + 2))
        if counts[0][s] + counts[1][s] >= 3 and abs(z) >= math.sqrt(1 / t - 1 / (n[1] + 2) + 1 / c - 1 / (n[0] + 2)):
            want[s] = z
    sample = docs.join(labels.filter("toxic IS NOT NULL"), "doc_id").select("text", F.col("toxic").alias("_label"))
    got = {r["slot"]: r["ratio"] for r in toxicity.ratios(sample, "_label", 3, 1.0).collect()}
    assert got == pytest.approx(want) and any(v < 0 for v in want.values()) and any(v > 0 for v in want.values())
    model = toxicity.fit(docs, labels, "toxic", F.lit(True), min_z=2.0)
    for r in toxicity.score(docs, model).collect():
        margin = model.bias + sum(float(model.weights[s]) for s in rows[r["doc_id"]])
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-margin)), rel=1e-4)


def test_logistic_reaches_the_least_loss():
    rng = np.random.default_rng(3)
    x = [np.flatnonzero(rng.random(12) < 0.4).astype(np.int32) for _ in range(300)]
    y = np.array([float(rng.random() < 1 / (1 + np.exp(2 - 3 * (3 in r) - 2 * (5 in r)))) for r in x])
    scale = np.linspace(-2, 2, 12) + 0.1
    theta, bias = toxicity.logistic(x, y, scale, 3000, 1e-3)
    dense = np.zeros((300, 12))
    for i, r in enumerate(x):
        dense[i, r] = scale[r]
    p = 1 / (1 + np.exp(-(bias + dense @ theta)))
    assert np.abs(dense.T @ (p - y) / 300 + 1e-3 * theta / 300).max() < 2e-3 and abs((p - y).mean()) < 2e-3


def test_language_against_plain_python(spark):
    """Dictionaries and choices of a small table, with a compressor for each text."""
    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    learned = langid.train(docs, F.lit(True), sample_docs=10_000, dict_bytes=3_000)
    rows, seen = docs.collect(), {}
    for lang in {r["lang"] for r in rows}:
        counts = Counter()
        for text in {r["text"] for r in rows if r["lang"] == lang}:
            words = langid.letters(text).split()
            counts.update({" ".join(words[i : i + 2]) for i in range(max(1, len(words) - 1))} - {""})
        chosen, size = [], 0
        for pair in sorted(counts, key=lambda k: (-counts[k], k.encode())):
            size += len(pair.encode()) + 1
            if size >= 3_000:
                break
            chosen.append(pair)
        seen[lang] = f" {' '.join(reversed(chosen))} ".encode()
    assert learned == seen
    each = {lang: zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for lang, d in seen.items()}
    found = {r["doc_id"]: r for r in langid.identify(docs, learned).collect()}
    for r in rows[:60]:
        data = langid.letters(r["text"]).encode()
        sizes = {}
        for lang, d in each.items():
            d.precompute_compress(compression_params=langid.PARAMETERS)
            blocks = [v for i in range(0, len(data), 4096) for v in langid.views(data[i : i + 4096])]
            sizes[lang] = sum(len(zstandard.ZstdCompressor(compression_params=langid.PARAMETERS, dict_data=d).compress(b)) for b in blocks)
        assert found[r["doc_id"]]["lang_pred"] == min(sorted(sizes), key=sizes.get)


def test_views_of_blocks():
    assert langid.views(b" a bb ccc ", 1) == [b" a bb ccc "]
    assert langid.views(b" a bb ccc ", 1000) == [b" a bb ccc ", b"a bb ccc ", b"bb ccc ", b"ccc "]
    block = b" ".join([b"word"] * 100)
    assert len(langid.views(block, 2 * len(block))) == 2 and langid.views(block, 2 * len(block))[1] == b" ".join([b"word"] * 51)


def test_ties(spark):
    """Languages with equal dictionaries: the first in the alphabet, margin 0, rejected. Equal texts score alike."""
    same = b" the word and the other "
    docs = spark.createDataFrame([(1, "the word and"), (2, "the word and"), (None, "the word and")], "doc_id long, text string")
    assert {(r["lang_pred"], r["score"], r["rejected"]) for r in langid.identify(docs, {"bb": same, "aa": same}).collect()} == {("aa", 0.0, True)}
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert len({r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels, "toxic", F.lit(True), min_docs=1)).collect()}) == 1
