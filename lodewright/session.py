"""Session construction with the settings the semantics depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "lodewright", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` overrides or adds settings.

    Master, memory and the shared checkpoint folder are the cluster's business and
    are left alone unless given.
    """
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
