"""Version history, flashback, event replay and time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN = ("RecordCreated", "RecordUpdated")


def to_scn(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_scn(scn: Column) -> Column:
    return F.timestamp_micros(scn).cast("timestamp_ntz")


def history(events: DataFrame, key: str, at: str, op: str, values: list[str]) -> DataFrame:
    """Versions (key, values, start_scn, end_scn, operation) from a change log; a delete is a version that ends at once."""
    w = Window.partitionBy(key).orderBy(at)
    later = F.lead(at).over(w)
    return events.select(key, *values, F.col(at).alias("start_scn"), F.when(F.col(op) == "D", F.col(at)).otherwise(later).alias("end_scn"), F.col(op).alias("operation"))


def as_of(versions: DataFrame, scn) -> DataFrame:
    """Rows as they were at ``scn``: start <= scn < end."""
    at = scn if isinstance(scn, Column) else F.lit(scn)
    return versions.filter((F.col("start_scn") <= at) & (F.col("end_scn").isNull() | (at < F.col("end_scn")))).drop("start_scn", "end_scn", "operation")


def versions_between(versions: DataFrame, low: int, high: int) -> DataFrame:
    """Versions alive in [low, high], with versions_startscn (null if older) and versions_endscn (null while current and for deletes)."""
    alive = versions.filter((F.col("start_scn") <= high) & (F.col("end_scn").isNull() | (F.col("end_scn") > low) | ((F.col("operation") == "D") & (F.col("start_scn") >= low))))
    return alive.select(
        *(c for c in versions.columns if c not in ("start_scn", "end_scn", "operation")),
        F.when(F.col("start_scn") >= low, F.col("start_scn")).alias("versions_startscn"),
        F.when((F.col("operation") != "D") & (F.col("end_scn") <= high), F.col("end_scn")).alias("versions_endscn"),
        F.col("operation").alias("versions_operation"),
    )


def flashback(versions: DataFrame, scn: int) -> DataFrame:
    """The table as it becomes when it is taken back to ``scn``."""
    return as_of(versions, scn)


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, values: list[str]) -> DataFrame:
    """Every left row with the latest right values at or before its time: one shuffle on the key, no pairs.

    Of right rows with equal times the one with the largest values wins.
    """
    rows = left.select(F.col(key), F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(F.struct(*values).alias("v")).schema["v"].dataType).alias("_v"))
    seen = right.select(F.col(key), F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.struct(*values).alias("_v"))
    w = Window.partitionBy(key).orderBy("_at", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.unionByName(seen).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1")
    return filled.select("_row.*", *(F.col(f"_v.{v}").alias(f"asof_{v}") for v in values))


def snapshot_at(events: DataFrame, key: str, at: str, kind: str, payload: str, when) -> DataFrame:
    """key, payload of every record alive at ``when``, by its last event (offset breaks ties)."""
    last = events.filter(F.col(at) <= when).groupBy(key).agg(F.max_by(F.struct(kind, payload), F.struct(at, "offset")).alias("e"))
    return last.filter(F.col(f"e.{kind}").isin(*OPEN)).select(key, F.col(f"e.{payload}").alias(payload))


def fold_last(events: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """An event projection: the last payload of each key and the number of its events."""
    return events.groupBy(key).agg(F.max_by(payload, order).alias(payload), F.count("*").alias("events"))


def analytics_batch(records: DataFrame, ident: str, timestamp: str, metadata: str) -> DataFrame:
    """record_id, timestamp, device_id, user_id, metric, value, metadata_json; missing or mistyped fields are null."""
    get = lambda k: F.get_json_object(metadata, f"$.{k}")
    raw = F.try_variant_get(F.try_parse_json(metadata), "$.timestamp", "bigint")
    number = F.when(get("value").rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$") & ~F.col(metadata).rlike(r'"value"\s*:\s*"'), get("value").try_cast("double"))
    return records.select(
        F.col(ident).cast("string").alias("record_id"), F.coalesce(F.col(timestamp), raw).alias("timestamp"), get("device_id").alias("device_id"), get("user_id").alias("user_id"), get("metric").alias("metric"), number.alias("value"), F.coalesce(F.col(metadata), F.lit("{}")).alias("metadata_json")
    )


def series_summary(batch: DataFrame, low=None, high=None, metric: str | None = None, device: str | None = None) -> DataFrame:
    """count, min, max, avg over [low, high]; rows without a timestamp never match."""
    rows = batch
    if low is not None or high is not None:
        rows = rows.filter(F.col("timestamp").isNotNull())
    for test in ((F.col("timestamp") >= low) if low is not None else None, (F.col("timestamp") <= high) if high is not None else None, (F.col("metric") == metric) if metric else None, (F.col("device_id") == device) if device else None):
        rows = rows.filter(test) if test is not None else rows
    return rows.agg(F.count("value").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("avg"))


def checksum(df: DataFrame, order: list[str]) -> DataFrame:
    """rows, sha256 over row digests that are added, so neither order nor partitions matter."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    low = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    high = F.conv(F.substring(row, 16, 15), 16, 10).cast("decimal(38,0)")
    return df.select(low.alias("l"), high.alias("h")).agg(F.count("*").alias("rows"), F.sha2(F.concat_ws("|", F.count("*"), F.sum("l"), F.sum("h")), 256).alias("sha256"))
