import collections
import itertools
import re

import numpy as np
import pyarrow as pa
import pytest

from lodewright.llm import components, ngram_join
from lodewright.llm.shingles import shingle_sets


def shingles(t):
    w = re.findall(r"[^\W_]+", (t or "").lower())
    return frozenset(zip(*(w[i:] for i in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    shared = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            shared[x].append(i)
    both = collections.Counter(p for ids in shared.values() for p in itertools.combinations(sorted(ids), 2))
    near, root = collections.defaultdict(set), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in both.items():
        if n / (len(sets[a]) + len(sets[b]) - n) >= 0.8 - 1e-12:
            near[a].add(b)
            near[b].add(a)
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (find(i), len(near[i]), len({sets[b] for b in near[i]} - {sets[i]})) for i in sets}


def check(df):
    want = brute([(r["doc_id"], r["text"]) for r in df.collect()])
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_texts"]) for r in ngram_join.jaccard_classes(df).collect()}
    assert got == want


def test_documents(docs):
    check(docs)


@pytest.fixture(scope="module")
def crowd(spark):
    """A crowd of near copies of one text, copies among them, and others that share a long passage."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(2000)]
    base = list(rng.choice(words, 120))
    rows = []
    for i in range(260):
        t = list(base)
        for _ in range(int(rng.integers(0, 4))):
            t[int(rng.integers(0, 120))] = str(rng.choice(words))
        rows.append((i, " ".join(t), "en", "s", 0))
    for i in range(260, 300):
        rows.append((i, " ".join([*base[:40], *rng.choice(words, 20)]), "en", "s", 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_crowd_in_one_block_and_in_many(crowd, monkeypatch):
    check(crowd)
    monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", 40)
    monkeypatch.setattr(ngram_join, "COLUMNS", 64)
    check(crowd)


def test_odd_rows(odd, none):
    found = sorted((r["doc_id"], r["class_id"], r["copy_id"], r["n_links"], r["n_texts"]) for r in ngram_join.jaccard_classes(odd).collect())
    by = {f[0]: f[1:] for f in found}
    assert len(found) == 11 and by[1] == (1, 1, 0, 0) and by[2] == (2, 2, 0, 0)
    assert by[5] == by[6] == by[7] == (5, 5, 3, 0) and by[4] == (4, 4, 0, 0)
    assert ngram_join.jaccard_classes(none).count() == 0


def repeated(spark):
    """Rows that share a doc_id and differ in text, rows without doc_id, repeated rows, and groups that one doc_id would name."""
    words = [f"w{i}" for i in range(60)]
    a, b, c = " ".join(words), " ".join(words[:59] + ["x"]), " ".join(f"v{i}" for i in range(60))
    d, e = c + " z", " ".join(f"u{i}" for i in range(30))
    rows = [(1, e), (2, a), (1, b), (3, c), (1, d), (1, d), (1, None), (1, ""), (None, a), (None, e), (None, None), (None, None), (9, "nothing like it"), (9, "nor like this one here")]
    return spark.createDataFrame([(i, t, "en", "s", 0, n, "x") for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, row int, r1 string"), rows


def test_repeated_and_null_ids(spark):
    df, rows = repeated(spark)
    want = brute(list(enumerate(t for _, t in rows)))
    found = ngram_join.classed_rows(df).collect()
    assert len(found) == len(rows)
    classes, texts = collections.defaultdict(list), collections.defaultdict(list)
    for (i, t), (root, n, m) in zip(rows, want.values(), strict=True):
        classes[root].append((i, n, m))
    for r in found:
        texts[r["class_id"]].append((r["doc_id"], r["n_links"], r["n_texts"]))
    assert sorted(map(repr, key_of(classes))) == sorted(map(repr, key_of(texts)))
    left = ngram_join.first_of_each(df)
    assert left.columns == df.columns and left.count() == len(classes)
    kept = collections.Counter(r["row"] for r in left.collect())
    roots = {n: root for n, (root, _, _) in enumerate(want.values())}
    assert sorted(roots[n] for n in kept) == sorted(classes)
    for n in kept:
        own = [rows[k][0] for k, root in roots.items() if root == roots[n] and rows[k][0] is not None]
        assert rows[n][0] == (min(own) if own else None)


def key_of(groups):
    return [sorted(g, key=repr) for g in groups.values()]


def test_one_of_each_group_stays(docs):
    classes = {r["doc_id"]: r["class_id"] for r in ngram_join.jaccard_classes(docs).collect()}
    assert sorted(r["doc_id"] for r in ngram_join.first_of_each(docs).collect()) == sorted(set(classes.values()))


def test_banding_reaches_recall():
    for threshold in (0.5, 0.8, 0.95):
        bands, rows = ngram_join.banding(threshold, 0.999, 400)
        assert 1 - (1 - threshold**rows) ** bands >= 0.999


def test_common_counts_by_product_and_by_pair():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 90, n).astype(np.uint64)) for n in (5, 40, 80, 1, 60, 30)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = ngram_join.common(sets, sets)
    assert all(got[i, j] == want[i][j] for i in range(6) for j in range(6) if i != j)
    assert ngram_join.common(sets[:2], sets[3:5]).tolist() == [r[3:5] for r in want[:2]]


def test_shingles_of_short_and_empty_texts():
    sets = shingle_sets(pa.array(["a b c d e f", "A, b. c d!e F", "a b", None, "", "...", "b a"]))
    assert [len(s) for s in sets] == [2, 2, 1, 0, 0, 0, 1] and (sets[0] == sets[1]).all() and sets[2][0] != sets[6][0]


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(0, 40)]
    star = [(100 + i, 100) for i in range(1, 30)]
    found = {r["v"]: r["label"] for r in components.components(spark.createDataFrame([*path, *star, (7, 7)], "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
