"""Live monitoring with Structured Streaming: event-time deduplication, snapshots, correlation and triggers.

Delivery: the deduplication state is in the checkpoint and sinks are idempotent by batch id, so a failed batch is
retried and counted once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import LongType, StructField, StructType

from alertloom.functions import net
from alertloom.operators import alerts as A
from alertloom.sources.growing import GrowingLines


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 5) -> DataFrame:
    """New Parquet files of a folder; at most `files_per_trigger` in a micro-batch bounds its size."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def read_alerts(spark: SparkSession, path: str, assets: net.Assets, **options: str) -> DataFrame:
    """Cleaned alerts of line files that grow (path is a pattern), with `ts`; lines that are no alert are left out."""
    spark.dataSource.register(GrowingLines)
    lines = spark.readStream.format("growing_lines").options(path=path, **options).load()
    raw = lines.select(F.trim("value").alias("json"), F.col("path").alias("archive_source")).filter(F.coalesce(F.get_json_object("json", "$").startswith("{"), F.lit(False)))
    return A.clean(raw, assets).withColumn("ts", F.col("timestamp").try_cast("timestamp")).drop("json")


def event_time(rows: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def with_hash(rows: DataFrame) -> DataFrame:
    return rows.withColumn("alert_hash", A.dedupe_hash(F.col("rule_id"), F.col("src_ip"), F.col("dest_ip"), F.col("rule_description"), F.date_format("ts", "yyyy-MM-dd HH:mm")))


def dedupe(rows: DataFrame, batch: bool = False) -> DataFrame:
    """One row per alert hash; in a stream the state of a hash ends with the watermark."""
    hashed = with_hash(rows)
    return hashed.dropDuplicates(["alert_hash"]) if batch else hashed.dropDuplicatesWithinWatermark(["alert_hash"])


def severe(rows: DataFrame, threshold: int = 8) -> DataFrame:
    return rows.observe("severity", F.count("*").alias("seen"), F.count_if(F.col("rule_level") < threshold).alias("dropped")).filter(F.col("rule_level") >= threshold)


def snapshots(rows: DataFrame, length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts per event-time window."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return rows.groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("rule_level") >= 8).alias("high"), F.count_if(F.col("rule_level") >= 12).alias("critical")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "high", "critical")


def correlated(rows: DataFrame, members: tuple[int, ...], hits: int, seconds: int) -> DataFrame:
    """(ts, src_ip, hits): the alerts at which a source has enough hits of some rules within the `seconds` up to the alert.

    Windows are twice as long as that and start every `seconds`, so each alert lies in the second half of just one window,
    which holds all it looks back on. A window keeps the times of one source's alerts, and ends with the watermark.
    """
    span = seconds * 1_000_000

    def trailing(times: pd.Series, starts: pd.Series) -> pd.Series:
        out = []
        for t, start in zip(times, starts, strict=True):
            t = np.sort(np.asarray(t, np.int64))
            n = np.searchsorted(t, t, "right") - np.searchsorted(t, t - span, "left")
            fired = np.flatnonzero((n >= hits) & (t >= start + span))
            out.append([{"at": int(t[i]), "hits": int(n[i])} for i in fired])
        return pd.Series(out)

    trailing.__annotations__ = {"times": pd.Series, "starts": pd.Series, "return": pd.Series}
    kept = rows.filter(F.col("rule_id").isin(*members) & F.col("src_ip").isNotNull())
    w = F.window("ts", f"{2 * seconds} seconds", f"{seconds} seconds")
    by = kept.groupBy(w.alias("w"), "src_ip").agg(F.collect_list(F.unix_micros("ts")).alias("times")).filter(F.size("times") >= hits)
    found = F.pandas_udf(trailing, "array<struct<at:long,hits:long>>")(F.col("times"), F.unix_micros(F.col("w.start")))
    return by.select("src_ip", F.explode(found).alias("f")).select(F.timestamp_micros("f.at").alias("ts"), "src_ip", "f.hits")


def trigger_record(batch: DataFrame, threshold: int = 8) -> DataFrame:
    """One row per micro-batch with severe alerts: counts, urgency and the first five hashes."""
    rows = batch.filter(F.col("rule_level") >= threshold)
    out = rows.agg(F.count("*").alias("alerts"), F.count_if(F.col("rule_level") >= 12).alias("critical"), F.max("rule_level").alias("max_level"), F.slice(F.array_sort(F.collect_set("alert_hash")), 1, 5).alias("first_hashes"))
    return out.filter("alerts > 0").withColumn("urgency", F.when(F.col("critical") > 0, "IMMEDIATE").otherwise("HIGH"))


@dataclass
class Monitor:
    """Start and stop of the monitoring query; `on_trigger(batch_id, record)` gets the trigger record of a batch.

    `source(spark, path)` gives the stream of alerts; without one, Parquet files of `schema` are read.
    """

    path: str
    schema: object
    checkpoint: str
    out: str
    threshold: int = 8
    interval: str = "10 seconds"
    on_trigger: Callable[[int, DataFrame], None] | None = None
    query: StreamingQuery | None = None
    source: Callable[[SparkSession, str], DataFrame] | None = None

    def start(self, spark: SparkSession, ready: bool = True, once: bool = False) -> StreamingQuery:
        if not ready:
            raise RuntimeError("the corpus has no embedded rows yet")
        if self.query is not None and self.query.isActive:
            raise RuntimeError("monitoring is running")
        alerts = self.source(spark, self.path) if self.source else read_stream(spark, self.path, self.schema)
        rows = severe(dedupe(event_time(alerts)), self.threshold)

        def body(batch: DataFrame, batch_id: int) -> None:
            # a retried batch overwrites its own folder: written once per batch id, and the record is made of what was written
            path = f"{self.out}/batch={batch_id}"
            batch.write.mode("overwrite").parquet(path)
            if self.on_trigger:
                self.on_trigger(batch_id, trigger_record(batch.sparkSession.read.schema(batch.schema).parquet(path), self.threshold))

        writer = rows.writeStream.foreachBatch(body).option("checkpointLocation", self.checkpoint)
        self.query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=self.interval)).start()
        return self.query

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()

    def update(self, interval_seconds: int | None = None, threshold: int | None = None) -> None:
        """New settings, in force from the next start."""
        if interval_seconds is not None:
            self.interval = f"{max(5, interval_seconds)} seconds"
        if threshold is not None:
            self.threshold = min(16, max(1, threshold))


class Statistics(StreamingQueryListener):
    """Batches, rows seen and dropped, and failures of the running queries."""

    def __init__(self):
        self.batches = self.rows = self.dropped = self.failures = 0

    def onQueryStarted(self, event):  # noqa: N802
        pass

    def onQueryProgress(self, event):  # noqa: N802
        p = event.progress
        self.batches += 1
        self.rows += p.numInputRows
        seen = p.observedMetrics.get("severity") if p.observedMetrics else None
        self.dropped += seen["dropped"] if seen else 0

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        self.failures += event.exception is not None


def run_to_table(rows: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All available input through a streaming query into Parquet beside its checkpoint, one folder for each batch.

    A retried batch overwrites its own folder. In mode "complete" the last batch is the result.
    """
    out, spark = f"{checkpoint}-out", rows.sparkSession

    def body(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    rows.writeStream.queryName(name).foreachBatch(body).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    p = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], rows.schema)
    written = spark.read.schema(StructType([*rows.schema.fields, StructField("batch", LongType())])).option("basePath", out).parquet(out)
    if mode == "complete":
        written = written.filter(F.col("batch") == written.agg(F.max("batch")).first()[0])
    return written.drop("batch")
