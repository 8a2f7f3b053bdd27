import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from eventlake import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    spark = (
        session.builder("eventlake-tests")
        .master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.checkpoint.dir", str(shared))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def sensors(spark):
    from eventlake.operators.parse import with_event_time
    from tests.fixtures import SENSOR_ROWS

    rows = [(i, *r) for i, r in enumerate(SENSOR_ROWS)]
    df = spark.createDataFrame(rows, "seq bigint, id string, timestamp bigint, temperature double")
    return with_event_time(df)
