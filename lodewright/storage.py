"""Intermediate tables in the folder that driver and executors share.

A written table cuts lineage and survives lost executors. Its place is the cluster's
``spark.checkpoint.dir``; only where that is unset (local tests) a folder is made here.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
#: Paths written by each open ``scratch``, the innermost last.
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder. Unset is allowed on a local master alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="lodewright-")
        spark.sparkContext.setCheckpointDir(_local[app])
    return _local[app]


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lodewright-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` as Parquet into the application's part of the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _open:
        _open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables materialised inside are deleted at the end, but for those handed to what this gives."""
    written: list[str] = []
    spared: set[str] = set()
    _open.append(written)

    def kept(df: DataFrame) -> DataFrame:
        spared.update(p for p in written if any(p in f for f in df.inputFiles()))
        return df

    try:
        yield kept
    finally:
        _open.remove(written)
        for path in written:
            if path not in spared:
                _delete(spark, path)


def bytes_of(df: DataFrame) -> int:
    """Bytes of the files that a written table (or a plain scan) reads; a plan that reads no file counts as unbounded."""
    spark = df.sparkSession
    files, total = df.inputFiles(), 0
    if not files:
        return 0 if df.isEmpty() else 1 << 62
    conf, make = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for f in files:
        place = make(f)
        total += place.getFileSystem(conf).getFileStatus(place).getLen()
    return total


def kept_table(spark: SparkSession, name: str, source: DataFrame, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that is built once for the files that ``source`` reads and stays until the application's shared folder goes."""
    files = sorted(source.inputFiles())
    conf, make = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    told = hashlib.sha256()
    for f in files:
        place = make(f)
        status = place.getFileSystem(conf).getFileStatus(place)
        told.update(f"{f}|{status.getLen()}|{status.getModificationTime()}".encode())
    path = f"{shared_dir(spark)}/lodewright-kept-{spark.sparkContext.applicationId}/{name}-{told.hexdigest()[:32]}"
    done = make(f"{path}/_SUCCESS")
    if not done.getFileSystem(conf).exists(done):
        build().write.mode("overwrite").option("parquet.block.size", str(8 << 20)).parquet(path)
    return spark.read.parquet(path)


def drop_intermediates(spark: SparkSession) -> None:
    """Delete all tables that this application materialised; results that still read them must be written before."""
    _delete(spark, _own_dir(spark))
