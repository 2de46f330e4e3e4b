"""Correlation of a stream's alerts by source with keyed state and event-time timers, in append mode.

Time is cut into stretches as long as a rule's time, as in the batch rule. An alert goes to the state of its rule, source and
stretch and, to be looked back on, to that of the next stretch. State is therefore one source's alerts of at most two stretches, and a
busy source is spread over as many tasks as it has stretches in flight. When the watermark has passed an alert, no earlier one can
arrive: a timer then decides it and emits it if enough hits lie within the rule's time before it. At the end of a stretch
its state is cleared.

Alerts later than the watermark allows are dropped by the engine before they reach the state; alerts within the delay count as if in order.
Rows without a source or a time don't correlate, repeated rows are hits each. What the watermark hasn't passed when a query stops stays in
the state and is decided after a restart. Needs the RocksDB state store (`configure`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from alertloom.operators import rules

OUT = "ts timestamp, event_id long, src_ip string, correlation_id int, correlation_level int, hits long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure(spark: SparkSession) -> None:
    """Keyed state with timers lives in RocksDB on the executors; it is checkpointed with the query."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Correlator(StatefulProcessor):
    """State of one (rule, source, stretch): its alerts' times and ids, and up to which time they are decided."""

    def __init__(self, table: tuple):
        self.rules = {number: (hits, seconds * 1_000_000, level) for number, _, hits, seconds, level, _ in table}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alerts = handle.getListState("alerts", "at long, event_id long")
        self.decided = handle.getValueState("decided", "upto long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        _, _, stretch = key
        span = self.rules[int(key[0])][1]
        end = (int(stretch) + 1) * span
        due = []
        for batch in rows:
            at = batch["at"].to_numpy(np.int64)
            self.alerts.appendList([(int(t), None if pd.isna(i) else int(i)) for t, i in zip(at, batch["event_id"], strict=True)])
            own = at[at >= int(stretch) * span]
            if len(own):
                due.append(int(own.min()) // 1000)
        # the oldest alert of this call is decided when the watermark is past it, with all that are passed by then; each decision
        # sets a timer for the next alert. The stretch's end clears the state
        for ms in {*sorted(due)[:1], end // 1000 + 1}:
            self.handle.registerTimer(ms)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        number, source, stretch = int(key[0]), key[1], int(key[2])
        hits, span, level = self.rules[number]
        begin, end = stretch * span, (stretch + 1) * span
        passed = min(timerValues.getCurrentWatermarkInMs() * 1000, end)
        before = self.decided.get()[0] if self.decided.exists() else begin
        found = pd.DataFrame(list(self.alerts.get()), columns=["at", "event_id"])
        if len(found):
            found = found.sort_values("at", kind="stable")
            at = found["at"].to_numpy(np.int64)
            n = np.searchsorted(at, at, "right") - np.searchsorted(at, at - span, "left")
            fired = (at >= before) & (at < passed) & (n >= hits)
            if fired.any():
                out = found[fired]
                yield pd.DataFrame({"ts": pd.to_datetime(out["at"], unit="us"), "event_id": out["event_id"].astype("Int64"), "src_ip": source, "correlation_id": number, "correlation_level": level, "hits": n[fired]})
        if passed >= end:
            self.alerts.clear()
            self.decided.clear()
        elif passed > before:
            self.decided.update((passed,))
            left = found["at"][found["at"] >= passed]
            if len(left):
                self.handle.registerTimer(int(left.min()) // 1000)
        yield pd.DataFrame()


def correlate_stream(alerts: DataFrame, table: tuple = rules.CORRELATION) -> DataFrame:
    """(ts, event_id, src_ip, correlation_id, correlation_level, hits) of a stream with a watermark on `ts`: what the batch rule gives."""
    at = F.unix_micros("ts")
    own = [F.when(F.col("rule_id").isin(*members), F.struct(F.lit(number).alias("rule"), F.lit(seconds * 1_000_000).cast("long").alias("span"))) for number, members, _, seconds, _, _ in table]
    rows = alerts.filter(F.col("src_ip").isNotNull() & F.col("ts").isNotNull())
    rows = rows.select("ts", at.alias("at"), F.col("event_id").cast("long").alias("event_id"), "src_ip", F.explode(F.array_compact(F.array(*own))).alias("r"))
    first = F.floor(F.col("at") / F.col("r.span"))
    rows = rows.select("ts", "at", "event_id", "src_ip", F.col("r.rule").alias("rule"), F.explode(F.array(first, first + 1)).alias("stretch"))
    return rows.groupBy("rule", "src_ip", "stretch").transformWithStateInPandas(Correlator(table), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
