"""Document fingerprints: canonical exact digests, with DataFrame functions alone.

A text is normalised (Unicode compatibility composition, full case folding, then
composition again), runs of white space become one blank and the ends are trimmed. Two
lanes of xxhash64 over the canonical text make a 128-bit digest. Texts with equal digests
meet in a bucket, where their canonical bytes are compared (by grouping on them); should
a bucket hold different texts, the second and later ones in byte order get a suffix.
So fingerprints are equal exactly when canonical texts are.

Digests are counted in partial sums before a shuffle, and only texts whose digest occurs
more than once are read again, each once, so a group of copies of any size leaves one row
for each task. Nothing but counts and range bounds reaches the driver.

Defined cases: null counts as empty; empty texts share one fingerprint; rows that repeat
a key, with equal or different texts, are each kept and fingerprinted by their own text;
a null key comes after all others in descending order; an empty table gives an empty
result; columns of other names pass through, and none used inside can clash with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodewright.storage import bytes_of, materialize

#: Bytes in memory, as estimated from rows and files, that a table which is broadcast may take.
BROADCAST_BYTES = 64 << 20

#: Bytes of a table's files in a range of its order.
RANGE_BYTES = 16 << 20

Lanes = Callable[[Column], tuple[Column, Column]]


def canonical(text: Column) -> Column:
    """Normalised, case-folded text with single blanks; null as empty."""

    def composed(c: Column) -> Column:
        return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))

    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(composed(folded), r"[\s\p{Z}]+", " "))


def xx_lanes(text: Column) -> tuple[Column, Column]:
    """Two xxhash64 values that differ by what is hashed before the text."""
    return F.xxhash64(F.lit("lane 1"), text), F.xxhash64(F.lit("lane 2"), text)


def digest(low: Column, high: Column) -> Column:
    """32 hexadecimal digits."""
    return F.lower(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in (low, high))))


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A hint to broadcast a written table (or a selection of its rows) that is small in bytes; a larger one is left to a shuffle join."""
    rows = df.count()
    small = rows * 24 * max(1, len(df.columns)) <= limit and bytes_of(df) * 4 <= limit
    return F.broadcast(df) if small else df


def row_keys(*columns: str) -> list[Column]:
    """Two hashes that tell rows apart by these columns."""
    return [F.xxhash64(F.lit(f"row {i}"), *columns) for i in (1, 2)]


def ordinals(hashed: DataFrame, keys: list[str], members: Callable[[DataFrame], DataFrame], lanes: Lanes = xx_lanes) -> DataFrame:
    """Byte comparison inside buckets of equal digests.

    hashed: ``keys`` (hashes that name a text), h1, h2 (written already). members(wanted):
    ``keys`` and text of those wanted, each once. Gives ``keys``, ordinal for texts that
    share a digest with a different text and come after the first of them; without
    collisions it is empty.
    """
    shared = materialize(hashed.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2"), "shared-digests")
    wanted = materialize(hashed.join(small_or_shuffled(shared), ["h1", "h2"], "left_semi").select(*keys).distinct(), "shared-keys")
    texts = members(wanted).withColumn("canon", canonical(F.col("text")))
    low, high = lanes(F.col("canon"))
    hashed_texts = texts.select(*keys, low.alias("h1"), high.alias("h2"), "canon")
    different = hashed_texts.groupBy("h1", "h2", "canon").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1")
    collided = materialize(different.select("h1", "h2"), "collisions")
    if collided.isEmpty():
        return hashed.select(*keys, F.lit(1).alias("ordinal")).limit(0)
    own = hashed_texts.join(collided, ["h1", "h2"])
    each = own.select("h1", "h2", "canon").distinct()
    order = each.withColumn("ordinal", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("canon")) - 1)  # different texts of one digest: never many
    return materialize(own.join(order, ["h1", "h2", "canon"]).filter("ordinal > 0").groupBy(*keys).agg(F.max("ordinal").alias("ordinal")), "ordinals")


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """r1, r2, text of the ``wanted`` (r1, r2), each once, from rows (r1, r2, text)."""
    return rows.join(small_or_shuffled(wanted), ["r1", "r2"], "left_semi").groupBy("r1", "r2", "text").agg(F.lit(1).alias("one")).drop("one")


def exact_classes(docs: DataFrame, key: str, text: str, lanes: Lanes = xx_lanes) -> DataFrame:
    """key, fingerprint for every row of ``docs``."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    one, two = row_keys("key", "text")
    rows = rows.withColumns({"r1": one, "r2": two})
    low, high = lanes(F.col("canon"))
    hashed = materialize(rows.select("key", "r1", "r2", canonical(F.col("text")).alias("canon")).select("key", "r1", "r2", low.alias("h1"), high.alias("h2")), "digests")
    found = ordinals(hashed, ["r1", "r2"], lambda wanted: _texts(rows.select("r1", "r2", "text"), wanted), lanes)
    return hashed.join(found, ["r1", "r2"], "left").select(F.col("key").alias(key), suffixed(digest(F.col("h1"), F.col("h2")), F.col("ordinal")).alias("fingerprint"))


def suffixed(found: Column, ordinal: Column) -> Column:
    return F.when(F.coalesce(ordinal, F.lit(0)) > 0, F.concat_ws("-", found, ordinal.cast("string"))).otherwise(found)


def _range_of(value: Column, bounds: list[float]) -> Column:
    """How many bounds (sorted) a value reaches: first among every k-th of them, then within one stretch, so about twice their root is compared."""
    if not bounds:
        return F.lit(0)
    k = max(1, round(len(bounds) ** 0.5))
    reached = lambda few: F.size(F.filter(few, lambda b: b <= value))
    stretch = reached(F.array(*map(F.lit, bounds[k - 1 :: k]))) if len(bounds) >= k else F.lit(0)
    return stretch * k + reached(F.slice(F.array(*map(F.lit, bounds)), stretch * k + 1, F.lit(k)))


def following(docs: DataFrame, order: str, carried: list[str]) -> DataFrame:
    """Each row with ``next_*`` columns of the row after it in descending ``order``; the first follows the last (earlier columns of these names give way).

    Rows are dealt to ranges of ``order`` (bounds from approximate quantiles), as many as
    the bytes of the table's files ask for; a copy of the row that starts the next range
    closes each range, so no range needs another. Rows of equal order follow each other by a
    hash of what is carried.
    """
    spark = docs.sparkSession
    docs = docs.drop(*(f"next_{c}" for c in carried))
    size = bytes_of(docs)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES) if size < 1 << 60 else 1)
    bounds = sorted(set(docs.select(order).stat.approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.25 / ranges))) if ranges > 1 else []
    value = lambda c: F.col("row").getField(c)
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    held = docs.select(F.struct(*quoted).alias("row"))
    ranged = held.withColumn("range", F.when(value(order).isNull(), -1).otherwise(_range_of(value(order).cast("double"), bounds)))
    heads = {r["range"]: r["head"] for r in ranged.groupBy("range").agg(F.max(value(order)).alias("head")).collect()}  # a row for each range
    if not heads:
        return docs.select("*", *(F.col(c).alias(f"next_{c}") for c in carried))
    falling = sorted(heads, reverse=True)
    after = [(heads[nxt], at) for at, nxt in zip(falling, [*falling[1:], falling[0]], strict=True)]
    kind = docs.schema[order].dataType
    pairs = F.array(*(F.struct(F.lit(head).cast(kind).alias("head"), F.lit(at).alias("closes")) for head, at in after))
    closing = F.broadcast(spark.range(1).select(F.inline(pairs)))  # a row for each range
    tie = F.xxhash64(*(value(c) for c in carried))
    # of rows that share the head's order the one that comes first by the tie closes the range before
    heading = ranged.join(closing, value(order).eqNullSafe(F.col("head"))).groupBy("closes").agg(F.min_by("row", tie).alias("row")).select("row", F.col("closes").alias("range"))
    every = ranged.withColumn("closer", F.lit(False)).unionByName(heading.withColumn("closer", F.lit(True))).repartition(ranges, "range")  # as many tasks as ranges, about
    window = Window.partitionBy("range").orderBy("closer", value(order).desc_nulls_last(), tie)
    led = every.select("row", "closer", *(F.lead(value(c)).over(window).alias(f"next_{c}") for c in carried))
    return led.filter("NOT closer").select("row.*", *(f"next_{c}" for c in carried))


def edited_text(text: Column, following_text: Column) -> Column:
    """``text`` with its last third of code points replaced by as many (or all) from the start of the following text."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(following_text, F.lit(1), third))


def edited_fingerprints(docs: DataFrame, lanes: Lanes = xx_lanes) -> DataFrame:
    """Fingerprints of every text of ``docs`` (doc_id, text) and of its edited text, and how alike they are."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    one, two = row_keys("doc_id", "text")
    rows = rows.withColumns({"r1": one, "r2": two})
    low, high = lanes(F.col("canon"))
    hashed = rows.withColumn("canon", canonical(F.col("text"))).select("doc_id", "r1", "r2", "text", low.alias("h1"), high.alias("h2"))
    chained = following(hashed, "doc_id", ["text", "h1", "h2", "r1", "r2"])
    edited = chained.withColumn("edited", edited_text(F.col("text"), F.col("next_text"))).withColumn("canon", canonical(F.col("edited")))
    small = edited.select("doc_id", "r1", "r2", "next_r1", "next_r2", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "h1", "h2", low.alias("e1"), high.alias("e2"), "next_h1", "next_h2")
    base = materialize(small, "edited-digests")

    keys, pair = ["r1", "r2", "s1", "s2"], ["r1", "r2", "next_r1", "next_r2"]
    own = base.select("r1", "r2", F.lit(None).cast("long").alias("s1"), F.lit(None).cast("long").alias("s2"), "h1", "h2")
    other = base.select("r1", "r2", F.col("next_r1").alias("s1"), F.col("next_r2").alias("s2"), F.col("e1").alias("h1"), F.col("e2").alias("h2"))

    def members(wanted: DataFrame) -> DataFrame:
        single = rows.select("r1", "r2", "text")
        plain = _texts(single, materialize(wanted.filter("s1 IS NULL").select("r1", "r2"), "wanted-plain")).select("r1", "r2", F.lit(None).cast("long").alias("s1"), F.lit(None).cast("long").alias("s2"), "text")
        pairs = wanted.filter("s1 IS NOT NULL")
        first = _texts(single, materialize(pairs.select("r1", "r2").distinct(), "wanted-first"))
        second = _texts(single, materialize(pairs.select(F.col("s1").alias("r1"), F.col("s2").alias("r2")).distinct(), "wanted-second"))
        both = pairs.join(first, ["r1", "r2"]).join(second.select(F.col("r1").alias("s1"), F.col("r2").alias("s2"), F.col("text").alias("next_text")), ["s1", "s2"])
        return plain.unionByName(both.select(*keys, edited_text(F.col("text"), F.col("next_text")).alias("text")))

    found = ordinals(own.unionByName(other), keys, members, lanes)
    prints = base.withColumns({"fingerprint": digest(F.col("h1"), F.col("h2")), "edited_fingerprint": digest(F.col("e1"), F.col("e2")), "next_fingerprint": digest(F.col("next_h1"), F.col("next_h2"))})
    if not found.isEmpty():
        plain = found.filter("s1 IS NULL").select("r1", "r2", "ordinal")
        edits = found.filter("s1 IS NOT NULL").select("r1", "r2", F.col("s1").alias("next_r1"), F.col("s2").alias("next_r2"), "ordinal")
        after = plain.select(F.col("r1").alias("next_r1"), F.col("r2").alias("next_r2"), "ordinal")
        for column, extra, on in (("fingerprint", plain, pair[:2]), ("edited_fingerprint", edits, pair), ("next_fingerprint", after, pair[2:])):
            prints = prints.join(extra, on, "left").withColumn(column, suffixed(F.col(column), F.col("ordinal"))).drop("ordinal")
    alike = lambda a, b: (F.col(a) == F.col(b)).cast("double")
    return prints.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", alike("fingerprint", "edited_fingerprint").alias("near_edited"), alike("fingerprint", "next_fingerprint").alias("near_next")
    )
