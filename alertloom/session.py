"""Session settings the plans rely on, and those that matter at scale."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Meaning: results depend on these two.
SEMANTIC = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true"}
#: Speed: runtime re-planning, split of skewed joins, partitions of a size that fits an executor's memory.
SCALE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


#: Records and bytes of an Arrow batch handed to Python; texts and reports are long.
ARROW_RECORDS, ARROW_BYTES = 500, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's bounds on Arrow batches; they count when a plan runs, so they stay."""
    for key, most in (("maxRecordsPerBatch", ARROW_RECORDS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).upper().rstrip("B")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def session(name: str = "alertloom", **conf: str) -> SparkSession:
    """A session with these settings; keyword values win (write dots as double underscores)."""
    builder = SparkSession.builder.appName(name)
    for k, v in (SEMANTIC | SCALE | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
