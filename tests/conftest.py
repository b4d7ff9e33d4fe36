import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from helixaudit.session import ship

    builder = SparkSession.builder.master("local[4]").appName("tests")
    for key, value in {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g"}.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()


TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    if not Path(TESTDATA).exists():
        pytest.skip("no test tables here")
    return TESTDATA
