import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    own = tempfile.mkdtemp(prefix="spark-")
    config = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.local.dir": own, "spark.checkpoint.dir": f"file://{own}/checkpoints", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}
    session = SparkSession.builder.master("local[4]").config(map=config).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
