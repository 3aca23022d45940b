"""Writes as new versions of a table: insert, update from, delete using, upsert, merge, partitions and constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def update_from(target: DataFrame, source: DataFrame, keys: list[str], sets: dict[str, Column], order: list[str]) -> DataFrame:
    """Rows with a match get ``sets`` (source columns as s_<name>); of several matches the first in ``order`` wins."""
    first = source.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")
    named = first.select(*keys, *(F.col(c).alias(f"s_{c}") for c in first.columns if c not in keys), F.lit(True).alias("_hit"))
    joined = target.join(named, keys, "left")
    return joined.select(*(F.when(F.col("_hit"), sets[c]).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in target.columns))


def delete_using(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(source.select(*keys), keys, "left_anti").select(*target.columns)


def insert_on_conflict(target: DataFrame, rows: DataFrame, keys: list[str], update: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """Insert new keys; existing ones stay or get ``update`` (new values as excluded_<name>) where ``where``.

    Of new rows with equal keys the first in the order of all their fields counts when
    nothing is updated; with ``update`` they are an error. A null key meets no other.
    """
    rest = [c for c in rows.columns if c not in keys]
    counted = rows.dropna(subset=keys).groupBy(*keys).agg(F.min(F.struct(*rest, F.lit(0).alias("_"))).alias("_row"), F.count("*").alias("_n"))
    if update:
        twice = F.raise_error(F.lit("ON CONFLICT DO UPDATE command cannot affect row a second time"))
        counted = counted.withColumn("_n", F.when(F.col("_n") > 1, twice.cast("long")).otherwise(F.col("_n"))).filter("_n > 0")
    loose = rows.filter(" OR ".join(f"`{k}` IS NULL" for k in keys))
    once = counted.select(*keys, *(F.col("_row").getField(c).alias(c) for c in rest)).unionByName(loose.select(*keys, *rest))
    new = once.select(*keys, *(F.col(c).alias(f"excluded_{c}") for c in rows.columns if c not in keys), F.lit(True).alias("_new"))
    both = target.withColumn("_old", F.lit(True)).join(new, keys, "full")
    change = F.col("_old") & F.col("_new") & (where if where is not None else F.lit(True)) if update else F.lit(False)
    out = []
    for c in target.columns:
        old = F.col(c)
        fresh = F.col(c) if c in keys else F.col(f"excluded_{c}")
        kept = F.when(change, update[c]).otherwise(old) if update and c in update else old
        out.append(F.when(F.col("_old").isNull(), fresh).otherwise(kept).alias(c))
    return both.select(*out)


def returning(target: DataFrame, test: Column, sets: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(new table, RETURNING rows) of a DELETE where ``test`` holds, or with ``sets`` of an UPDATE."""
    hit = F.coalesce(test, F.lit(False))
    if sets is None:
        return target.filter(~hit), target.filter(hit)
    new = {c: v.cast(target.schema[c].dataType) for c, v in sets.items()}
    changed = target.filter(hit).select(*(new[c].alias(c) if c in new else F.col(c) for c in target.columns))
    return target.filter(~hit).unionByName(changed), changed


def moved(target: DataFrame, partition: Column, test: Column, sets: dict[str, Column]) -> DataFrame:
    """An UPDATE of a partitioned table: every row with its partition before and after it (``_from``, ``_to``)."""
    hit = F.coalesce(test, F.lit(False))
    before = target.withColumn("_from", partition)
    after = before.select(*(F.when(hit, sets[c]).otherwise(F.col(c)).cast(target.schema[c].dataType).alias(c) if c in sets else F.col(c) for c in target.columns), "_from")
    return after.withColumn("_to", partition)


def merge_update(target: DataFrame, source: DataFrame, keys: list[str], sets: dict[str, Column]) -> DataFrame:
    """MERGE ... WHEN MATCHED THEN UPDATE; a target row matched twice is an error."""
    counted = source.groupBy(*keys).agg(*(F.first(c).alias(f"s_{c}") for c in source.columns if c not in keys), F.count("*").alias("_n"))
    joined = target.join(counted, keys, "left")
    twice = F.when(F.col("_n") > 1, F.raise_error(F.lit("MERGE command cannot affect row a second time")))
    return joined.select(*(F.when(F.col("_n") > 1, twice.cast(target.schema[c].dataType)).when(F.col("_n") == 1, sets[c]).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in target.columns))


def range_partition(value: Column, bounds: list[tuple[str, object, object]], default: str | None = None) -> Column:
    """The partition [from, to) of a value; outside all: the default, or an error."""
    found = None
    for name, low, high in bounds:
        test = (F.lit(low).isNull() | (value >= F.lit(low))) & (F.lit(high).isNull() | (value < F.lit(high)))
        found = F.when(test, name) if found is None else found.when(test, name)
    return found.otherwise(F.lit(default) if default else F.raise_error(F.lit("no partition of relation found for row")))


def list_partition(value: Column, lists: dict[str, list], default: str | None = None) -> Column:
    found = None
    for name, values in lists.items():
        test = value.isin(*[v for v in values if v is not None]) | (value.isNull() if None in values else F.lit(False))
        found = F.when(F.coalesce(test, F.lit(False)), name) if found is None else found.when(F.coalesce(test, F.lit(False)), name)
    return found.otherwise(F.lit(default) if default else F.raise_error(F.lit("no partition of relation found for row")))


def hash_partition(value: Column, modulus: int) -> Column:
    """The remainder that a text key's partition has: its seeded hash, combined as for one key column."""
    from lodewright.functions import pg

    seed = 0x7A5B22367996DCFD
    hashed = pg.hash_text_extended(value, seed)
    # two's complement sums of longs wrap in Java's bitwise functions only, so the constant is added in decimals
    return F.when(value.isNull(), F.lit(0)).otherwise(pg.unsigned_remainder(pg.wrapped_sum(hashed, 0x49A0F4DD15E5A8E3), modulus)).cast("int")


def violations(df: DataFrame, not_null: list[str] = (), unique: list[list[str]] = (), checks: dict[str, Column] | None = None, references: list[tuple[str, DataFrame, str]] = ()) -> DataFrame:
    """constraint, rows of each violated constraint; a CHECK passes on unknown, UNIQUE ignores nulls."""
    counts = [F.sum(F.col(c).isNull().cast("long")).alias(f"not null {c}") for c in not_null] + [F.sum(F.coalesce(~t, F.lit(False)).cast("long")).alias(f"check {n}") for n, t in (checks or {}).items()]
    found = None
    if counts:
        one = df.agg(*counts)
        found = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("constraint"), F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias("rows")) for c in one.columns))).alias("x")).select("x.*")
    for keys in unique:
        extra = df.dropna(subset=keys).groupBy(*keys).count().filter("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows")).select(F.lit("unique " + ", ".join(keys)).alias("constraint"), "rows")
        found = extra if found is None else found.unionByName(extra)
    for column, parent, key in references:
        lost = df.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti").agg(F.count("*").alias("rows")).select(F.lit(f"foreign key {column}").alias("constraint"), "rows")
        found = lost if found is None else found.unionByName(lost)
    return found.filter("rows > 0")


def exclusion_violations(df: DataFrame, keys: list[str], low: str, high: str, ident: str) -> DataFrame:
    """Ids whose [low, high) overlaps an earlier row of equal keys: one pass in order, no pairs."""
    w = Window.partitionBy(*keys).orderBy(low, ident).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_end", F.max(high).over(w)).filter(F.col(low) < F.col("_end")).select(ident)


def statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, nulls, distinct, min, max of each column, in one pass."""
    aggregates = [x for c in columns for x in (F.sum(F.col(c).isNull().cast("long")).alias(f"{c}|nulls"), F.approx_count_distinct(c).alias(f"{c}|distinct"), F.min(c).cast("string").alias(f"{c}|min"), F.max(c).cast("string").alias(f"{c}|max"))]
    one = df.agg(*aggregates)
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("field"), *(F.col(f"`{c}|{k}`").alias(k) for k in ("nulls", "distinct", "min", "max"))) for c in columns))))
