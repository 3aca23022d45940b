"""Shared helpers for operators that read whole texts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewright.llm.fingerprint import small_or_shuffled
from lodewright.storage import materialize

#: Rows that are handled at a time, and bytes that a task sends to Python at a time: texts can be long.
BATCH_ROWS = 512
BATCH_BYTES = 4 << 20


def tidied(run: Callable) -> Callable:
    """A batch function that gives freed memory back to the system after each batch, so that a worker that waits holds little."""

    def each(batches):
        try:
            trim = ctypes.CDLL(None).malloc_trim
        except AttributeError:  # another C library
            trim = lambda n: 0
        for batch in run(batches):
            yield batch
            del batch
            pa.default_memory_pool().release_unused()
            trim(0)
        trim(0)

    return each


def in_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` over batches of ``BATCH_ROWS`` rows at most.

    The session's bound of bytes in a batch, which only limits memory, is lowered to
    ``BATCH_BYTES`` if it is higher or unset, for plans read it when they run.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    bound = df.sparkSession.conf.get(key, None)
    if not (bound and bound.isdigit() and int(bound) <= BATCH_BYTES):
        df.sparkSession.conf.set(key, str(BATCH_BYTES))

    def cut(batches):
        return run(b.slice(i, BATCH_ROWS) for b in batches for i in range(0, max(1, b.num_rows), BATCH_ROWS))

    return df.mapInArrow(tidied(cut), schema)


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """True for documents whose crc32(doc_id as text) mod ``modulus`` is ``remainder``; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus == remainder


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[str]:
    """The texts of a batch, null as empty."""
    for value in batch.column(batch.schema.get_field_index(column)):
        yield value.as_py() or ""


def bounded_sample(df: DataFrame, bound: int) -> DataFrame:
    """``bound`` rows at most, drawn by a hash of all their fields; all rows if there are fewer."""
    n, slots = df.count(), 1_000_003
    if n <= bound:
        return df
    drawn = F.xxhash64(F.lit(71), *df.columns)
    some = df.filter(F.pmod(drawn, F.lit(slots)) <= int(slots * min(1.0, 1.1 * bound / n)))
    return some.orderBy(drawn).limit(bound)  # rows that are equal in all fields may be many: each task keeps ``bound`` of them at most


def labelled(rows: DataFrame, labels: DataFrame, label: str, usable: Column, bound: int) -> DataFrame:
    """``bound`` rows at most of ``rows`` (doc_id, ...) with a 0 or 1 of ``labels`` (doc_id, label) as ``_label``.

    Labels are drawn before the join, repeated ones once, and rows after it again, for a doc_id may occur often.
    """
    known = labels.filter(usable & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("_label")).distinct()
    drawn = materialize(bounded_sample(known, bound), "labels-drawn")
    return bounded_sample(materialize(rows.join(small_or_shuffled(drawn), "doc_id"), "rows-labelled"), bound)
