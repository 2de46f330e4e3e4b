import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.master("local[4]").appName("tests")
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")), "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")), "spark.ui.showConsoleProgress": "false"}
    for k, v in conf.items():
        builder = builder.config(k, v)
    s = builder.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Values of column expressions over one row of named columns."""
    from pyspark.sql import functions as F

    def run(*exprs, **values):
        row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, (list, tuple)) else F.array(*[F.lit(x) for x in v]).alias(k) for k, v in (values or {"_": 0}).items()])
        got = row.select(*[e.alias(f"c{i}") for i, e in enumerate(exprs)]).first()
        return tuple(got)

    return run
