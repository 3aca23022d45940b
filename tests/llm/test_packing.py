import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodewright.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, found, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for doc, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for i, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[doc, i, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    end = Counter()
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == end[r["sequence_id"]]
        end[r["sequence_id"]] += r["length"]
    assert max(end.values()) <= capacity
    return len(end), -(-sum(r["length"] for r in found) // capacity)


def test_all_documents(docs):
    used, least = check([(r["doc_id"], r["text"]) for r in docs.collect()], packing.pack_documents(docs, PATH).collect(), 4096)
    assert used <= least + 1


def test_small_capacity_and_odd_rows(odd, none):
    check([(r["doc_id"], r["text"]) for r in odd.collect()], packing.pack_documents(odd, PATH, 64).collect(), 64)
    assert packing.pack_documents(none, PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_words_tokenize_as_whole_texts(texts):
    tokens = packing.word_tokens(PATH)
    whole = tokens.whole.encode_batch(texts, add_special_tokens=False)
    assert [f.tolist() for f in tokens.encode_batch(pa.array(texts, pa.string()))] == [w.ids for w in whole]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), min_size=1))
def test_program_places_every_piece(histogram):
    chosen = packing.solve(histogram, 50, rounds=8)
    used = Counter()
    for times, holds in chosen:
        assert times > 0 and sum(n * k for n, k in holds) <= 50
        for n, k in holds:
            used[n] += times * k
    assert used == Counter(histogram)
    assert sum(t for t, _ in chosen) <= 1.02 * sum(t for t, _ in packing.best_fit(histogram, 50)) + 1


def test_program_beats_best_fit_where_that_is_poor():
    histogram = {26: 0, 21: 6, 17: 6, 12: 6, 13: 0, 38: 0}
    histogram = {n: x for n, x in histogram.items() if x}
    assert sum(t for t, _ in packing.solve(histogram, 50)) == 6


def test_knapsack_is_exact():
    best, _ = packing.knapsack(np.array([3.0, 4.0, 5.0]), np.array([2, 3, 4]), 9)
    assert best[9] == pytest.approx(13.0)


def test_other_columns_and_null_ids(spark):
    rows = [(None, 0, 5, 1, "a"), (None, 0, 5, 1, "a"), (3, 0, 9, 2, "b"), (3, 0, 9, 3, "b"), (4, 1, 2, 4, "c")]
    df = spark.createDataFrame(rows, "doc_id long, piece int, length long, offset int, _salt string")
    found = packing.pack(df, 10)
    assert found.columns == ["doc_id", "piece", "length", "_salt", "sequence_id", "offset"]
    end = Counter()
    for r in sorted(found.collect(), key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == end[r["sequence_id"]]
        end[r["sequence_id"]] += r["length"]
    assert len(end) == 4 and max(end.values()) <= 10 and sum(end.values()) == 30
