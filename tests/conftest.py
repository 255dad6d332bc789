import os
import sys
from pathlib import Path

import pytest

HOME = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, HOME)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [HOME, os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    home = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", str(home / "warehouse")).config("spark.checkpoint.dir", str(home / "checkpoints")).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def tiny():
    return "/root/testdata/sf0.001"
