"""Reading and writing tables: Parquet, CSV with COPY's rules, JSON lines, cursors and resumable export."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewright.operators.temporal import checksum

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names or TABLES}


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """All tables as views of their names."""
    for name, df in load(spark, sf_dir, *names).items():
        df.createOrReplaceTempView(name)


def copy_from(spark: SparkSession, path: str, schema: str, header: bool = True, null: str = "", delimiter: str = ",") -> DataFrame:
    """COPY FROM ... CSV: the unquoted null text is null, blank lines are skipped, wrong rows stop the read."""
    return spark.read.csv(path, schema=schema, header=header, sep=delimiter, nullValue=null, emptyValue="", quote='"', escape='"', mode="FAILFAST", multiLine=True)


def copy_to(df: DataFrame, path: str, header: bool = True, null: str = "", delimiter: str = ",") -> None:
    df.write.mode("overwrite").csv(path, header=header, sep=delimiter, nullValue=null, emptyValue='""', quote='"', escape='"')


def export_json(df: DataFrame, path: str, key: str, after=None) -> None:
    """JSON lines in key order; ``after`` goes on behind a key."""
    rows = df.filter(F.col(key) > F.lit(after)) if after is not None else df
    rows.orderBy(key).write.mode("overwrite").json(path)


def pages(df: DataFrame, key: str, size: int) -> Iterator[DataFrame]:
    """A cursor over a unique, non-null key: pages of ``size`` rows in its order, each read behind the last key of the one before."""
    last = None
    while True:
        rest = df if last is None else df.filter(F.col(key) > F.lit(last))
        page = rest.orderBy(key).limit(size)
        top = page.agg(F.max(key)).first()[0]
        if top is None:
            return
        yield page
        last = top


def insert_into(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """INSERT INTO a written table: columns by position, cast to its own."""
    schema = spark.read.parquet(path).schema
    if len(rows.columns) != len(schema):
        raise ValueError("INSERT has more or fewer expressions than target columns")
    rows.toDF(*schema.names).select(*(F.col(f.name).cast(f.dataType) for f in schema)).write.mode("append").parquet(path)


def write_sidecar(df: DataFrame, path: str, order: list[str]) -> str:
    """Write a columnar copy and return its checksum."""
    df.write.mode("overwrite").parquet(path)
    return checksum(df, order).first()["sha256"]


def verify_sidecar(spark: SparkSession, path: str, order: list[str], sha256: str) -> bool:
    return checksum(spark.read.parquet(path), order).first()["sha256"] == sha256


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """A table whose joins and lookups on ``key`` need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
