"""The registered queries, by name, and the SQL each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from alertloom.plans.alert_view import ALERTS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, alert_view: bool = False):
    """Register a query, and the SQL it must equal if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {ALERTS_SQL} {sql}" if alert_view else sql
        return f

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder for streaming state and stores that every executor sees; a local one only for local masters."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="alertloom-")
    return f"{folder.rstrip('/')}/{name}"
