"""Event streams: reading, replaying, windows with watermarks, and projections kept by a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType, TimestampNTZType


def read_since(log: DataFrame, offset: int, stream: str | None = None, order: str = "offset") -> DataFrame:
    """Events after an offset, in order."""
    rows = log.filter(F.col(order) > offset)
    return (rows.filter(F.col("stream") == stream) if stream else rows).orderBy(order)


def subscribe(spark: SparkSession, path: str, schema: StructType, handler: Callable[[DataFrame, int], None], checkpoint: str, name_filter: str = "*.parquet") -> StreamingQuery:
    """Run ``handler`` on every micro-batch of new files until there are none left; restarts go on from the checkpoint."""
    source = spark.readStream.schema(schema).option("pathGlobFilter", name_filter).parquet(path)
    return source.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def import_events(known: DataFrame, arriving: DataFrame, ident: str = "id") -> DataFrame:
    """Events of both, each id once; known ones win."""
    return known.unionByName(arriving.join(known.select(ident), ident, "left_anti").dropDuplicates([ident]).select(*known.columns))


def timed(stream: DataFrame, at: str, delay: str | None) -> DataFrame:
    """The stream with a watermark, which needs a timestamp with a zone (the session's)."""
    if delay is None:
        return stream
    zoned = stream.withColumn(at, F.col(at).cast("timestamp")) if isinstance(stream.schema[at].dataType, TimestampNTZType) else stream
    return zoned.withWatermark(at, delay)


def deduplicated(stream: DataFrame, ident: str, at: str, delay: str) -> DataFrame:
    """A stream without repeats of an id that come within the watermark."""
    return timed(stream, at, delay).dropDuplicatesWithinWatermark([ident])


def windowed(stream: DataFrame, at: str, size: str, slide: str | None, keys: list[str], delay: str | None, **aggregates) -> DataFrame:
    """Tumbling (no slide) or sliding windows: start, end, keys and aggregates. Without delay it is a batch."""
    rows = timed(stream, at, delay)
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return rows.groupBy(w.alias("w"), *keys).agg(*(v.alias(k) for k, v in aggregates.items())).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *aggregates)


def sessions(stream: DataFrame, at: str, gap: str, keys: list[str], delay: str | None = None, **aggregates) -> DataFrame:
    """Session windows that close after ``gap`` without an event."""
    rows = timed(stream, at, delay)
    found = rows.groupBy(F.session_window(at, gap).alias("w"), *keys).agg(*(v.alias(k) for k, v in aggregates.items()))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *aggregates)


def run_to_end(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Drain a stream into a written table beside its checkpoint and read it; of mode complete the last result counts, of update all changes with their ``batch``."""
    spark, path, seen = stream.sparkSession, f"{checkpoint}-{name}", []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        seen.append(number)

    query = stream.writeStream.queryName(name).outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if not seen:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{path}/batch={max(seen)}")
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).option("basePath", path).parquet(path)
    return rows if mode == "update" else rows.drop("batch")


def maintain_cube(stream: DataFrame, keys: list[str], measure: str, sign: str, path: str, checkpoint: str) -> StreamingQuery:
    """Keep count and sum by key in Parquet versions under ``path``: each batch adds (sign 1) or retracts (sign -1) its rows.

    The table of a batch is written under its number, so a batch that is run again writes the same.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        part = batch.groupBy(*keys).agg(F.sum(sign).alias("count"), F.sum(F.col(sign) * F.col(measure)).alias("sum"))
        if number:
            part = spark.read.parquet(f"{path}/batch={number - 1}").unionByName(part).groupBy(*keys).agg(F.sum("count").alias("count"), F.sum("sum").alias("sum")).filter("count > 0")
        part.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
