"""Live queries: changelogs of a query's result as its input changes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def changes(old: DataFrame | None, new: DataFrame, seq: int) -> DataFrame:
    """commit_seq, change and the row: lost rows as -, then new ones as +; repeats count."""
    added = new if old is None else new.exceptAll(old)
    lost = new.limit(0) if old is None else old.exceptAll(new)
    tagged = lambda df, sign: df.select(F.lit(seq).cast("long").alias("commit_seq"), F.lit(sign).alias("change"), "*")
    return tagged(lost, "-").unionByName(tagged(added, "+"))


def notifications(changed: DataFrame) -> DataFrame:
    return changed.select(F.to_json(F.struct("*")).alias("payload"))


def subscribe(stream: DataFrame, query: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, emit: Callable[[DataFrame], None]) -> StreamingQuery:
    """Run ``query`` over all rows so far after each batch and pass on what changed.

    Rows and results of batch n are kept under ``path`` by n, so a batch that is run again finds what it found before.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        rows = spark.read.schema(batch.schema).parquet(*(f"{path}/rows/batch={i}" for i in range(number + 1)))
        query(rows).write.mode("overwrite").parquet(f"{path}/result/batch={number}")
        new = spark.read.parquet(f"{path}/result/batch={number}")
        old = spark.read.parquet(f"{path}/result/batch={number - 1}") if number else None
        emit(changes(old, new, number))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def subscribe_grouped(stream: DataFrame, keys: list[str], sums: dict[str, Column], path: str, checkpoint: str, emit: Callable[[DataFrame], None]) -> StreamingQuery:
    """A grouped query (count ``n`` and ``sums``) kept up to date: a batch adds its own groups to the last result, and only groups it touches are compared.

    Results are kept under ``path`` by batch, so a batch that is run again finds what it found before.
    """
    totals = [F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in sums)]

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(v).alias(c) for c, v in sums.items())).write.mode("overwrite").parquet(f"{path}/part/batch={number}")
        part = spark.read.parquet(f"{path}/part/batch={number}")
        old = spark.read.parquet(f"{path}/result/batch={number - 1}") if number else part.limit(0)
        old.unionByName(part).groupBy(*keys).agg(*totals).write.mode("overwrite").parquet(f"{path}/result/batch={number}")
        touched = part.select(*keys)
        same = lambda a, b: reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in keys))
        new = spark.read.parquet(f"{path}/result/batch={number}")
        emit(changes(old.join(touched, same(old, touched), "left_semi"), new.join(touched, same(new, touched), "left_semi"), number))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class HotView:
    """A result that is kept until a version of its inputs changes."""

    def __init__(self, query: Callable[[], DataFrame], versions: Callable[[], tuple]):
        self.query, self.versions, self.seen, self.kept = query, versions, None, None

    def read(self) -> DataFrame:
        now = self.versions()
        if self.kept is None or now != self.seen:
            if self.kept is not None:
                self.kept.unpersist()
            self.kept, self.seen = self.query().cache(), now
        return self.kept
