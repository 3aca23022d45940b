"""N-gram Jaccard join: MinHash banding, then verification on full shingle sets.

1. Every whole text becomes its set of five-word shingles. Texts with equal sets form a
   class of copies; one row for a class goes on (counted in partial sums).
2. A class has a MinHash signature cut into bands; ``banding`` chooses bands and rows for
   the wanted recall at the threshold. Classes that agree in a band are candidates.
3. Bands of one candidate group mostly repeat each other, so buckets are joined under
   their smallest member, the hub. All pairs under a hub are verified in blocks of
   bounded size: a block pair counts common shingles by a matrix product and returns a
   row for each class, never for each pair. A pair that meets under several hubs counts
   under the smallest.
4. Links found make groups (connected components, contracted in the cluster).

Result: a row for each row of documents: doc_id, class_id (smallest doc_id of its group),
copy_id (smallest doc_id with an equal shingle set), n_links (other rows at or above the
threshold), n_texts (different sets among them). No cap on buckets, partners or texts.

Rows are told apart by a number of their own, sets by 128-bit hashes, so neither needs
doc_id. Defined cases: null and empty texts, and texts without a letter or digit, have
no shingles and link to nothing; a text of fewer than five words has one shingle of
them all; repeated rows link to each other as copies do; rows that share a doc_id are
classed by their own texts, and where one doc_id would name several groups (or none is
there) all but the first get a negative class_id; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewright.llm.components import components
from lodewright.llm.fingerprint import small_or_shuffled
from lodewright.llm.shingles import WORDS, shingle_sets
from lodewright.llm.text import in_batches
from lodewright.storage import materialize

THRESHOLD = 0.8
RECALL = 0.9995
MAX_HASHES = 160
#: Members and bytes of shingles in a block.
BLOCK_MEMBERS = 512
BLOCK_BYTES = 16 << 20
#: Bytes of shingles that a task verifies.
TASK_BYTES = 64 << 20
COLUMNS = 4096


def banding(threshold: float, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows for which ``recall`` at the threshold needs no more than ``most`` hashes."""
    needed = lambda rows: max(1, math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))) if threshold < 1 else 1
    best = (needed(1), 1)
    for rows in range(2, most + 1):
        if threshold**rows < 1e-9:
            break
        if needed(rows) * rows <= most:
            best = (needed(rows), rows)
    return best


class MinHash:
    """Signatures by multiplication with odd 32-bit numbers, and a 64-bit hash for each band."""

    def __init__(self, bands: int, rows: int, seed: int = 20_240_101):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.factors = (rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
        self.shifts = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32)[:, None]

    def band_hashes(self, shingles: np.ndarray) -> np.ndarray:
        low = ((shingles ^ (shingles >> np.uint64(32))) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        least = np.full(len(self.factors), 0xFFFFFFFF, dtype=np.uint32)
        for i in range(0, len(low), 512):
            mixed = self.factors * low[None, i : i + 512] + self.shifts
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x2C1B3C6D)
            np.minimum(least, mixed.min(axis=1), out=least)
        return np.array([xxhash.xxh3_64_intdigest(least[i : i + self.rows].tobytes(), seed=i) for i in range(0, len(least), self.rows)], dtype=np.uint64).view(np.int64)


def _row_keys() -> list[Column]:
    """Two hashes that tell rows of different doc_id or text apart."""
    return [F.xxhash64(F.lit(i), "doc_id", "text").alias(f"r{i}") for i in (1, 2)]


def _set_keys(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) for s in sets], dtype=np.uint64).reshape(-1, 2).view(np.int64)


def signatures(docs: DataFrame, bands: int, rows: int, words: int = WORDS) -> DataFrame:
    """doc_id, r1, r2 (hashes of the row), n (shingles), k1, k2 (hashes of the set), bands (array of longs)."""

    def run(batches):
        minhash = MinHash(bands, rows)
        for batch in batches:
            sets = shingle_sets(batch.column(1), words)
            keys = _set_keys(sets)
            known: dict[tuple, np.ndarray] = {}
            found = [np.zeros(0, dtype=np.int64)] * len(sets)
            for i, (s, k) in enumerate(zip(sets, map(tuple, keys.tolist()), strict=True)):
                if len(s):
                    if k not in known:
                        known[k] = minhash.band_hashes(s)
                    found[i] = known[k]
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, dtype=np.int64)))
            sizes = pa.array(np.array([len(s) for s in sets], dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(2), batch.column(3), sizes, pa.array(np.ascontiguousarray(keys[:, 0])), pa.array(np.ascontiguousarray(keys[:, 1])), listed], names=["doc_id", "r1", "r2", "n", "k1", "k2", "bands"]
            )

    return in_batches(docs.select("doc_id", "text", *_row_keys()), run, "doc_id long, r1 long, r2 long, n long, k1 long, k2 long, bands array<long>")


def sets_of(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """r1, r2, shingles (binary, sorted 64-bit numbers) for rows (text, r1, r2)."""

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(0), words)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([s.tobytes() for s in sets], pa.binary())], names=["r1", "r2", "shingles"])

    return in_batches(docs.select("text", "r1", "r2"), run, "r1 long, r2 long, shingles binary")


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements of every set on the left with every one on the right (``right`` may be ``left``)."""
    if len(left) * len(right) <= 16:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left], dtype=np.float32).reshape(len(left), len(right))
    every = left if right is left else [*left, *right]
    flat, rows = np.concatenate(every), np.repeat(np.arange(len(every)), [len(s) for s in every])
    values, columns, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts > 1
    number = np.cumsum(shared) - 1
    keep = shared[columns]
    rows, columns = rows[keep], number[columns[keep]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    found = np.zeros((len(left), len(right)), dtype=np.float32)
    for start in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(columns, [start, start + COLUMNS])
        x = np.zeros((len(every), min(COLUMNS, int(shared.sum()) - start)), dtype=np.float32)
        x[rows[a:b], columns[a:b] - start] = 1
        found += x[: len(left)] @ (x if right is left else x[len(left) :]).T
    return found


def verify(hub: int, left: list[tuple], right: list[tuple], threshold: float) -> list[tuple]:
    """(rep, root, texts, docs) for the members that link. Members: (rep, hubs, docs, shingles); ``right`` is ``left`` within a block."""
    within = right is left
    a, b = ([m[3] for m in side] for side in (left, right))
    both = common(a, a if within else b)
    sizes_a, sizes_b = (np.array([len(s) for s in side], dtype=np.float32) for side in (a, b))
    linked = both >= threshold * (sizes_a[:, None] + sizes_b[None, :] - both) - 1e-3
    if within:
        np.fill_diagonal(linked, False)
    counted = linked
    smaller_a, smaller_b = ([m[1][m[1] < hub] for m in side] for side in (left, right))
    if any(map(len, smaller_a)) and any(map(len, smaller_b)):
        counted = linked & (common(smaller_a, smaller_a if within else smaller_b) == 0)
    weight_a, weight_b = (np.array([m[2] for m in side], dtype=np.float64) for side in (left, right))
    reps = np.array([m[0] for m in left] + ([] if within else [m[0] for m in right]), dtype=np.int64)
    texts = np.concatenate([counted.sum(axis=1), [] if within else counted.sum(axis=0)])
    docs = np.concatenate([counted @ weight_b, [] if within else weight_a @ counted])
    label_a = np.array([m[0] for m in left], dtype=np.int64)
    label_b = label_a if within else np.array([m[0] for m in right], dtype=np.int64)
    far = np.iinfo(np.int64).max
    while True:
        new_a = np.minimum(label_a, np.where(linked, label_b[None, :], far).min(axis=1, initial=far))
        new_b = new_a if within else np.minimum(label_b, np.where(linked, new_a[:, None], far).min(axis=0, initial=far))
        if (new_a == label_a).all() and (new_b == label_b).all():
            break
        label_a, label_b = new_a, new_b
    roots = label_a if within else np.concatenate([label_a, label_b])
    return [(int(r), int(t), int(x), int(d)) for r, t, x, d in zip(reps, roots, texts, docs, strict=True) if x or r != t]


def links(members: DataFrame, threshold: float) -> DataFrame:
    """rep, root, texts, docs from rows (hub, low, high, side, rep, hubs, docs, shingles) dealt and sorted by the first three, a unit. Side 0: left, 1: right, 2: within."""
    names = ("hub", "low", "high", "side", "rep", "hubs", "docs", "shingles")

    def run(batches):
        unit, rows = None, []

        def done():
            if not rows:
                return []
            sides = [[m[1:] for m in rows if m[0] == side] for side in (0, 1, 2)]
            left = sides[2] or sides[0]
            return verify(unit[0], left, left if sides[2] else sides[1], threshold) if left else []

        def out(found):
            columns = list(zip(*found, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["rep", "root", "texts", "docs"])

        for batch in batches:
            found = []
            named = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for hub, low, high, side, rep, hubs, docs, shingles in zip(*(named[n].to_pylist() for n in names), strict=True):
                if (hub, low, high) != unit:
                    found += done()
                    unit, rows = (hub, low, high), []
                rows.append((side, rep, np.array(hubs, dtype=np.int64), docs, np.frombuffer(shingles, dtype=np.uint64)))
            yield out(found)
        yield out(done())

    return in_batches(members.select(*names), run, "rep long, root long, texts long, docs long")


def classed_rows(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL) -> DataFrame:
    """row (its number), doc_id, r1, r2, class_id, copy_id, n_links, n_texts, grouped (whether anything else is in its class)."""
    spark = docs.sparkSession
    bands, rows = banding(threshold, recall)
    signed = materialize(signatures(docs, bands, rows, words).withColumn("row", F.monotonically_increasing_id()), "signatures")
    # a class is known by the number of one of its rows
    classes = materialize(signed.filter("n > 0").groupBy("k1", "k2").agg(F.min("row").alias("rep"), F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.max("n").alias("n")), "classes")
    firsts = signed.select(F.col("row").alias("rep"), "bands").filter("size(bands) > 0").join(classes.select("rep"), "rep", "left_semi")
    banded = materialize(firsts.select("rep", F.posexplode("bands").alias("band", "value")).select("rep", F.xxhash64("band", "value").alias("bucket")), "bands")
    buckets = banded.groupBy("bucket").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).filter("hub < last").select("bucket", "hub")
    members = materialize(banded.join(small_or_shuffled(materialize(buckets, "buckets")), "bucket").select("hub", "rep").distinct(), "hub-members")
    weights = materialize(classes.select("rep", F.col("copies").alias("docs"), "n").join(members.select("rep").distinct(), "rep", "left_semi"), "weights")
    weighed = members.join(small_or_shuffled(weights), "rep")
    blocks = F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK_MEMBERS), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int")
    sized = materialize(weighed.groupBy("hub").agg(blocks.alias("blocks")), "hub-blocks")
    hubs = weighed.groupBy("rep").agg(F.array_sort(F.collect_list("hub")).alias("hubs"), F.first("docs").alias("docs"), F.first("n").alias("n"))  # at most one hub a band
    block = F.pmod(F.xxhash64(F.lit(3), F.col("rep"), F.col("hub")), F.col("blocks")).cast("int")
    dealt = members.join(small_or_shuffled(sized), "hub").withColumn("block", block)
    # (low, high): a unit for each pair of blocks of a hub, and one within each block
    dealt = dealt.select("hub", "rep", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    placed = materialize(dealt.select("hub", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), side.alias("side"), "rep").join(hubs, "rep"), "units")
    involved = materialize(signed.select(F.col("row").alias("rep"), "r1", "r2").join(small_or_shuffled(weights.select("rep")), "rep", "left_semi"), "involved")
    sets = sets_of(docs.select("text", *_row_keys()).join(small_or_shuffled(involved.select("r1", "r2")), ["r1", "r2"], "left_semi"), words)
    own = sets.join(small_or_shuffled(involved), ["r1", "r2"]).dropDuplicates(["rep"]).select("rep", "shingles")  # repeated rows have equal hashes
    volume = placed.agg(F.sum("n")).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-volume * 8 // TASK_BYTES))
    unit = ("hub", "low", "high")
    found = materialize(links(placed.join(own, "rep").repartition(partitions, *unit).sortWithinPartitions(*unit), threshold), "jaccard-links")
    counted = found.groupBy("rep").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("linked"))
    labelled = components(found.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    return _named(signed.drop("bands"), classes, counted, labelled)


def _named(signed: DataFrame, classes: DataFrame, counted: DataFrame, labelled: DataFrame) -> DataFrame:
    """Every row with its class; only classes of several rows, with links or with a doc_id that occurs again are looked up."""
    told = classes.join(counted, "rep", "left").join(labelled.withColumnRenamed("v", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    repeated = materialize(signed.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").select("doc_id"), "repeated-ids")
    linked = materialize(told.filter("texts IS NOT NULL").select("label", "first").groupBy("label").agg(F.min("first").alias("name"), F.count("*").alias("sets")), "groups")
    told = told.join(small_or_shuffled(linked), "label", "left").withColumn("name", F.coalesce("name", "first"))
    grouped = (F.col("copies") > 1) | F.col("texts").isNotNull()
    if repeated.isEmpty():
        told = told.filter(grouped).withColumns({"class_id": F.col("name"), "copy_id": F.col("first")})
        apart = F.col("doc_id")
    else:
        again = small_or_shuffled(repeated)
        claims = lambda by, name: told.select(F.col(name).alias("doc_id"), by).join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(by).alias(f"{by}_owner")).withColumnRenamed("doc_id", name)
        told = told.join(claims("label", "name"), "name", "left").join(claims("rep", "first"), "first", "left")
        owned = lambda by, name: F.when(F.col(name).isNull() | (F.col(f"{by}_owner") < F.col(by)), -1 - F.col(by)).otherwise(F.col(name))
        told = told.withColumns({"class_id": owned("label", "name"), "copy_id": owned("rep", "first")}).filter(grouped | F.col("first").isNull() | F.col("rep_owner").isNotNull())
        signed = signed.join(again.withColumn("again", F.lit(True)), "doc_id", "left")
        apart = F.when((F.col("n") == 0) & (F.col("again") | F.col("doc_id").isNull()), -1 - F.col("row")).otherwise(F.col("doc_id"))
    told = materialize(told.select("k1", "k2", "class_id", "copy_id", "copies", "texts", "linked", F.coalesce(F.col("sets") > 1, F.lit(False)).alias("several")), "classes-told")
    joined = signed.join(small_or_shuffled(told), ["k1", "k2"], "left")
    return joined.select(
        "row", "doc_id", "r1", "r2",
        F.coalesce("class_id", apart).alias("class_id"),
        F.coalesce("copy_id", apart).alias("copy_id"),
        F.when(F.col("n") > 0, F.coalesce("linked", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).otherwise(0).cast("long").alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_texts"),
        F.coalesce((F.col("copies") > 1) | F.col("several"), F.lit(False)).alias("grouped"),
    )


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, copy_id, n_links, n_texts for every row of ``docs`` (doc_id, text)."""
    return classed_rows(docs, threshold, words, recall).select("doc_id", "class_id", "copy_id", "n_links", "n_texts")


def first_of_each(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest doc_id (null last)."""
    grouped = materialize(classed_rows(docs, threshold, words, recall).filter("grouped").select("row", "doc_id", "r1", "r2", "class_id"), "grouped-rows")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    chosen = grouped.groupBy("class_id").agg(F.min(order)["row"].alias("row")).select("row", F.lit(True).alias("chosen"))
    fates = grouped.join(chosen, "row", "left").groupBy("r1", "r2").agg(F.max(F.coalesce("chosen", F.lit(False))).alias("stays"), F.count("*").alias("rows"))
    fates = materialize(fates.filter("NOT stays OR rows > 1"), "fates")
    names = ["r1", "r2", "stays"]
    taken = {c.lower() for c in docs.columns}
    inner = {n: n if n not in taken else next(f"{n}_{i}" for i in range(len(taken) + 1) if f"{n}_{i}" not in taken) for n in names}
    keyed = docs.withColumns({inner[k]: v for k, v in zip(("r1", "r2"), _row_keys(), strict=True)})
    marked = keyed.join(small_or_shuffled(fates.select(*(F.col(n).alias(inner[n]) for n in names))), [inner["r1"], inner["r2"]], "left")
    stays = F.col(inner["stays"])
    left = marked.filter(stays.isNull())
    again = fates.filter("stays")
    if not again.isEmpty():  # of rows that are equal in doc_id and text one stays
        left = left.unionByName(marked.filter(stays).dropDuplicates([inner["r1"], inner["r2"]]))
    return left.select(*docs.columns)
