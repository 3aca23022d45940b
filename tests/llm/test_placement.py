import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from lodewright.llm import ann, mixing, sharding

SHARDS = [f"s{i}" for i in range(11)]


def slow_table(shards, slots):
    digests = [hashlib.md5(s.encode()).digest() for s in shards]
    order = [[(int.from_bytes(d[:8], "big") + j * (int.from_bytes(d[8:], "big") % (slots - 1) + 1)) % slots for j in range(slots)] for d in digests]
    table, at = [None] * slots, 0
    while None in table:
        table[next(s for s in order[at % len(shards)] if table[s] is None)] = at % len(shards)
        at += 1
    return table


def test_lookup_table():
    table = sharding.lookup_table(SHARDS, 503)
    assert table == slow_table(SHARDS, 503) and max(Counter(table).values()) - min(Counter(table).values()) <= 1
    fewer = sharding.lookup_table(SHARDS[:-1], 503)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True))
    assert moved < 503 * 0.3
    weighted = Counter(sharding.lookup_table(["a", "b"], 503, {"a": 3}))
    assert 2.8 < weighted[0] / weighted[1] < 3.2
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 503)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 500)


def test_places(docs, odd, none):
    table = sharding.lookup_table(SHARDS, 503)
    for df, n in ((docs, docs.count()), (odd, 11), (none, 0)):
        found = sharding.place(df, "doc_id", SHARDS, 503).collect()
        assert len(found) == n
        for r in found:
            slot = int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16) % 503
            assert (r["slot"], r["shard"]) == (slot, table[slot])


def test_placement_in_sql(spark, sf):
    import duckdb

    from lodewright.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(queries.oracle_sql()["op6_sharding"]).fetchall())
    assert sorted(map(tuple, queries.queries()["op6_sharding"](spark, sf).collect())) == want


def cells_of(seed=3):
    rng = np.random.default_rng(seed)
    rows = [(s, g, t, int(rng.integers(1, 5000))) for s in "abc" for g in ("en", "fr") for t in ("x", "y", "z")]
    return pd.DataFrame(rows, columns=["source", "lang", "topic", "tokens"])


def shares(cells, rate, d):
    kept = cells["tokens"] * rate
    return (kept.groupby(cells[d]).sum() / kept.sum()).to_dict()


TARGETS = {"source": {"a": 0.2, "b": 0.3, "c": 0.5}, "lang": {"en": 0.6, "fr": 0.4}, "topic": {"x": 0.5, "y": 0.25, "z": 0.25}}


def test_expected_tokens_meet_given_marginals(spark):
    cells = cells_of()
    frame = spark.createDataFrame(cells)
    ways = [{tuple(r[:3]): r["rate"] for r in mixing.rates(frame, TARGETS, 0.4, driver_cells=n).collect()} for n in (0, 100)]
    assert all(abs(ways[0][k] - ways[1][k]) < 1e-6 for k in ways[1])
    rate = np.array([ways[1][tuple(k)] for k in cells[["source", "lang", "topic"]].to_numpy().tolist()])
    assert 0 < rate.min() and rate.max() <= 1
    for d, t in TARGETS.items():
        got = shares(cells, rate, d)
        assert all(abs(got[k] - v) < 1e-3 for k, v in t.items())
    assert abs((rate * cells["tokens"]).sum() / cells["tokens"].sum() - 0.4) < 1e-3


def test_scarce_targets_lower_what_is_kept():
    cells = cells_of()
    cells.loc[cells["source"] == "a", "tokens"] //= 50
    present = {d: cells.groupby(d)["tokens"].sum().astype(float).to_dict() for d in mixing.DIMENSIONS}
    rate, off = mixing.rake_array(cells, mixing._goals(present, TARGETS, 0.9, 0.7))
    assert off < mixing.TOLERANCE
    for d, t in TARGETS.items():
        assert all(abs(shares(cells, rate, d)[k] - v) < 2e-3 for k, v in t.items())
    assert (rate * cells["tokens"]).sum() < 0.3 * cells["tokens"].sum()


def test_default_shares():
    present = np.array([0.9, 0.07, 0.02, 0.01])
    found = mixing.default_shares(present, 0.7, 0.7)
    assert abs(found.sum() - 1) < 1e-9 and (found <= 0.95 * present / 0.7 + 1e-12).all() and (found[1:] > present[1:]).all() and found[0] < 0.9
    assert np.allclose(mixing.default_shares(present, 1.0, 0.7), present)


def test_fitting_that_stays_off_says_so(spark):
    cells = spark.createDataFrame([("a", "en", "x", 100), ("b", "fr", "x", 100)], "source string, lang string, topic string, tokens long")
    with pytest.warns(UserWarning, match="off its targets"):
        mixing.rates(cells, {"source": {"a": 0.2, "b": 0.8}, "lang": {"en": 0.8, "fr": 0.2}, "topic": {"x": 1.0}})


def test_mix_by_hand(docs, odd, none):
    """Every document's rate from plain loops over its cell, its fate, and the marginals of what is expected."""
    import re

    found = mixing.mix(docs).collect()
    texts = {r["doc_id"]: r for r in docs.collect()}
    cells = {}
    for r in found:
        words = len(re.findall(r"[^\W_]+", texts[r["doc_id"]]["text"]))
        assert r["tokens"] == words and (r["source"], r["lang"]) == (texts[r["doc_id"]]["source"], texts[r["doc_id"]]["lang"]) and 0 < r["rate"] <= 1
        cells[r["source"], r["lang"], r["topic"]] = cells.get((r["source"], r["lang"], r["topic"]), 0) + words
    total, goal = sum(cells.values()), []
    keep = 0.7 * mixing.LESS ** round(np.log(sum(r["tokens"] * r["rate"] for r in found) / total / 0.7) / np.log(mixing.LESS))  # cells are few here, so less may be kept
    assert keep > 0.3
    for d in range(3):
        names = sorted({c[d] for c in cells})
        held = np.array([sum(n for c, n in cells.items() if c[d] == name) for name in names]) / total
        goal.append(dict(zip(names, mixing.default_shares(held, keep, 0.7) * keep * total, strict=True)))
    factor = [dict.fromkeys(g, 1.0) for g in goal]
    for _ in range(300):
        for d in range(3):
            for name in goal[d]:
                now = sum(n * min(1.0, factor[0][c[0]] * factor[1][c[1]] * factor[2][c[2]]) for c, n in cells.items() if c[d] == name)
                factor[d][name] *= goal[d][name] / now if now else 1.0
    for r in found:
        assert r["rate"] == pytest.approx(min(1.0, factor[0][r["source"]] * factor[1][r["lang"]] * factor[2][r["topic"]]), abs=0.02)
    for d, name in enumerate(mixing.DIMENSIONS):
        for value, want in goal[d].items():
            assert abs(sum(r["tokens"] * r["rate"] for r in found if r[name] == value) - want) < 2e-3 * total
    assert len({r["topic"] for r in found}) > 3
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in found if r["kept"])
    assert mixing.mix(odd).count() == 11 and mixing.mix(none).count() == 0 and mixing.sample(none).count() == 0
    same = [r["kept"] for r in mixing.mix(odd).collect() if r["doc_id"] == 6]
    assert same in ([True, True], [False, False]) and mixing.sample(odd).columns == odd.columns


def test_rows_without_id_are_drawn_each(spark):
    rows = spark.createDataFrame([(None, f"text number {i} of many", "en", "s") for i in range(200)], "doc_id long, text string, lang string, source string")
    assert 100 < mixing.mix(rows, keep=0.7).filter("kept").count() < 180


def exact(x, ids, q, k):
    s = x.astype(float) @ x[q].astype(float)
    s[q] = -np.inf
    return ids[np.lexsort((ids, -s))[:k]]


def test_recall_and_order(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    found = ann.search_index(ann.build_index(v, "vec_id", "embedding", 20), v.filter("vec_id % 20 = 0"), "vec_id", "embedding", 20).toPandas()
    rows = v.orderBy("vec_id").collect()
    x, ids = np.array([r["embedding"] for r in rows], dtype=np.float32), np.array([r["vec_id"] for r in rows])
    recall = []
    for q, own in found.groupby("query_id"):
        own = own.sort_values("rank")
        at = int(np.flatnonzero(ids == q)[0])
        assert own["rank"].tolist() == list(range(1, 21)) and q not in own["vec_id"].tolist()
        assert np.allclose(own["score"], [float(x[at].astype(float) @ x[np.flatnonzero(ids == i)[0]].astype(float)) for i in own["vec_id"]], atol=1e-12)
        assert list(zip(-own["score"], own["vec_id"], strict=True)) == sorted(zip(-own["score"], own["vec_id"], strict=True))
        recall.append(len(set(own["vec_id"]) & set(exact(x, ids, at, 20))) / 20)
    assert np.mean(recall) >= 0.9


def test_graph_recall_with_unlike_norms():
    rng = np.random.default_rng(4)
    x = (rng.standard_normal((3000, 16)) * rng.uniform(0.2, 3, (3000, 1))).astype(np.float32)
    g = ann.Graph(x).build()
    q = rng.standard_normal((100, 16)).astype(np.float32)
    found, _ = g.search(g.queries(q), 64)
    best = np.argsort(-(q @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(f[:10]) & set(b)) / 10 for f, b in zip(found, best, strict=True)]) > 0.9
    assert (g.neighbours >= 0).sum(axis=1).max() <= ann.DEGREE


def test_copies_and_bad_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(60, [0.5, 0.5]), (61, None), (62, [0.0, 0.0]), (63, [nan, 1.0]), (64, [inf, 1.0]), (65, [1.0, None]), (66, [1.0, 2.0, 3.0]), (80, [0.9, 0.1])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = ann.search_index(ann.build_index(v, "vec_id", "embedding", 20), v.filter("vec_id % 20 = 0"), "vec_id", "embedding", 20).toPandas()
    assert sorted(found["query_id"].unique()) == [0, 20, 40, 60, 80]
    assert found[found["query_id"] == 0].sort_values("rank")["vec_id"].tolist() == list(range(1, 21))
    assert found[found["query_id"] == 80].sort_values("rank")["vec_id"].tolist() == list(range(20))
    few = spark.createDataFrame([(0, [1.0, 1.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert ann.search_index(ann.build_index(few, "vec_id", "embedding", 20), few, "vec_id", "embedding", 20).count() == 2
    none = v.limit(0)
    assert ann.search_index(ann.build_index(none, "vec_id", "embedding", 20), none, "vec_id", "embedding", 20).count() == 0


def answers(spark, rows, schema="vec_id long, embedding array<double>", step=20):
    v = spark.createDataFrame(rows, schema)
    found = ann.search_index(ann.build_index(v, "vec_id", "embedding", 20), v.filter(f"vec_id % {step} = 0"), "vec_id", "embedding", 20).collect()
    return {q: [(r["vec_id"], r["score"]) for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])] for q in {r["query_id"] for r in found}}


def by_hand(rows, step=20, k=20):
    """Every distinct row of another id, by its inner product."""
    each = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) == 2 and any(v) and all(x is not None and abs(x) < float("inf") for x in v)}
    return {i: sorted(((j, float(np.dot(v, w))) for j, w in each if j != i), key=lambda c: (-c[1], c[0]))[:k] for i, v in each if i % step == 0}


def test_repeated_ids_lose_nothing(spark):
    rng = np.random.default_rng(8)
    rows = [(0, [1.0, 0.0])] * 25 + [(7, [0.99, 0.1])] * 40 + [(i, [float(x) for x in rng.standard_normal(2)]) for i in range(100, 160)]
    got, want = answers(spark, rows), by_hand(rows)
    assert set(got) == set(want) and all(len(got[q]) == 20 for q in got)
    assert all([c[0] for c in got[q]] == [c[0] for c in want[q]] and np.allclose([c[1] for c in got[q]], [c[1] for c in want[q]], atol=1e-12) for q in want)


def test_one_id_with_many_vectors(spark):
    rng = np.random.default_rng(9)
    rows = [(0, [1.0, 0.001 * i]) for i in range(30)] + [(i, [float(x) for x in rng.standard_normal(2)]) for i in range(101, 140)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.search_index(ann.build_index(v, "vec_id", "embedding", 20), v.filter("vec_id = 0"), "vec_id", "embedding", 20)
    assert found.count() == 30 * 20 and found.filter("vec_id = 0").count() == 0


def test_odd_first_row_and_wide_range(spark):
    rows = [(0, [1.0, 2.0, 3.0]), (None, [5.0, 5.0])] + [(i, [float(i), 1.0 / i]) for i in range(1, 60)]
    got, want = answers(spark, rows), by_hand(rows)
    assert got == {q: [(j, pytest.approx(x, abs=1e-12)) for j, x in c] for q, c in want.items()} and len(got) == 2
    huge = [(i, [1e100 * (i + 1), -1e90 * i]) for i in range(30)]
    assert [c[0] for c in answers(spark, huge, step=40)[0]] == list(range(29, 9, -1))
    close = [(i, [1.0 + i * 1e-12, 0.0]) for i in range(30)]  # apart in double precision alone
    assert answers(spark, close, step=40)[0][0][1] > 1.0 and len(answers(spark, close, step=40)[0]) == 20
