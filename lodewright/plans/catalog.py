"""All registered queries of the engine and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracle: dict[str, str] = {}


def register(oracle: str | None = None) -> Callable[[Query], Query]:
    """Add a query under its function's name, with its DuckDB SQL where SQL can say it."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if oracle:
            _oracle[f.__name__] = oracle
        return f

    return add


def register_sql(name: str, spark_sql: str, oracle: str | None = None, tables: tuple[str, ...] = ()) -> None:
    """Add a query given as Spark SQL over the tables it names."""
    import re

    names = tables or tuple(sorted(set(re.findall(r"\b(region|nation|customer|supplier|part|orders|lineitem|events|documents|embeddings|pages|benchmark|labels|conversations)\b", spark_sql))))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from lodewright.plans.front import sql

        tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names}
        if "boss_tree" in spark_sql:  # nations in a tree of three children each
            nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
            tables["boss_tree"] = nation.selectExpr("n_nationkey", "CASE WHEN n_nationkey > 0 THEN CAST(floor((n_nationkey - 1) / 3) AS INT) END AS boss")
        return sql(spark, spark_sql, tables)

    run.__name__ = name
    _queries[name] = run
    if oracle:
        _oracle[name] = oracle


def _load() -> None:
    from lodewright.plans import extras, relational, scalars, special  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracle)
