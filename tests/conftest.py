import os

import pytest

os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lodewright import get_session, storage

    session = get_session(
        "tests", **{"spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    storage.drop_intermediates(session)
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
