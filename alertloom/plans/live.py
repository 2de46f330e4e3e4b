"""Streaming queries with keyed state and from growing files, over several files and restarts, and the SQL each must equal."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alertloom.operators import analytics as N
from alertloom.plans.alert_view import alerts
from alertloom.plans.registry import query, shared_folder
from alertloom.sources.growing import GrowingLines
from alertloom.streaming import correlation
from alertloom.streaming import monitor as M

#: Rules of the query below: (number, members, hits, seconds, level, text).
RULES = ((1, tuple(range(100000, 100300)), 2, 3600, 12, "pair"), (2, tuple(range(100000, 100150)), 3, 43200, 9, "triple"))
K = "CAST(json_extract_string(props, '$.k') AS INT)"
RULES_SQL = " UNION ALL ".join(
    f"""SELECT ts, event_id, src_ip, {n} AS correlation_id, {level} AS correlation_level, hits FROM (SELECT *, count(*) OVER (PARTITION BY src_ip ORDER BY ts
  RANGE BETWEEN INTERVAL {seconds} SECONDS PRECEDING AND CURRENT ROW) AS hits FROM a WHERE k < {len(members)}) WHERE hits >= {hits}"""
    for n, members, hits, seconds, level, _ in RULES
)


@query(f"""WITH a AS (SELECT ts, event_id, {K} AS k, '10.0.0.' || (user_id % 250 + 1) AS src_ip FROM events)
  SELECT * FROM ({RULES_SQL}) WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 600 SECONDS""")
def stream_correlation_state(spark, sf_dir):
    """Events in six files, read in two runs on one checkpoint: what keyed state has decided once the watermark is ten minutes behind the last."""
    correlation.configure(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    rows = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), (k + 100000).alias("rule_id"), F.concat(F.lit("10.0.0."), F.col("user_id") % 250 + 1).alias("src_ip"))
    low, high = rows.agg(F.min("ts"), F.max("ts")).first()
    name = f"state_{uuid4().hex[:12]}"
    folder, out = shared_folder(spark, f"{name}-in"), None
    for i in range(6):
        a, b = (low + (high - low) * j / 6 for j in (i, i + 1))
        upto = F.col("ts") <= F.lit(b) if i == 5 else F.col("ts") < F.lit(b)
        rows.filter((F.col("ts") >= F.lit(a)) & upto).coalesce(1).write.mode("append").parquet(folder)
        if i in (2, 5):
            live = M.event_time(M.read_stream(spark, folder, rows.schema, 1), delay="10 minutes")
            out = M.run_to_table(correlation.correlate_stream(live, RULES), f"{name}_{i}", shared_folder(spark, name))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, count(DISTINCT event_id) AS ids FROM events GROUP BY event_type")
def tailed_events(spark, sf_dir):
    """Events as line files, half of them appended after the first run: every line is read once."""
    spark.dataSource.register(GrowingLines)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "value")
    name = f"tailed_{uuid4().hex[:12]}"
    folder, out = shared_folder(spark, f"{name}-in"), None
    for i in range(2):
        events.filter(F.col("event_id") % 2 == i).select(F.to_json(F.struct("*"))).write.text(f"{folder}/{i}")
        lines = spark.readStream.format("growing_lines").option("path", f"{folder.removeprefix('file:').replace('//', '/')}/*/part-*.txt").option("bytes_per_task", 1 << 18).load()
        out = M.run_to_table(lines, f"{name}_{i}", shared_folder(spark, name))
    rows = out.select(F.from_json("value", events.schema).alias("e")).select("e.*")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.count_distinct("event_id").alias("ids"))


# --- distinct alerts of sliding windows --------------------------------------------------------------------------
HASH_SQL = "concat_ws('|', rule_id, coalesce(src_ip, ''), coalesce(dest_ip, ''))"


@query(f"""SELECT h.period, count(DISTINCT date_trunc('hour', a.ts)) AS periods, count(*) AS n, count(DISTINCT {HASH_SQL}) AS exact, true AS within
  FROM (SELECT DISTINCT date_trunc('hour', ts) AS period FROM alerts) h JOIN alerts a ON a.ts >= h.period - INTERVAL 23 HOURS AND a.ts < h.period + INTERVAL 1 HOUR GROUP BY h.period""", True)
def distinct_24h(spark, sf_dir):
    """Distinct alerts of 24 hours from 24 hourly sketches, beside the exact number; `within`: the estimate keeps its error bound."""
    a = alerts(spark, sf_dir).withColumn("k", F.concat_ws("|", "rule_id", F.coalesce("src_ip", F.lit("")), F.coalesce("dest_ip", F.lit(""))))
    slid = N.sliding_distinct(N.distinct_sketches(a, F.col("k")), 24)
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    # an alert's hour adds it to 24 windows, or to those before its next hour; the sum of what comes and goes is the number there
    hours = a.select("k", F.unix_timestamp(hour).alias("h")).distinct()
    until = F.least(F.col("h") + 24 * 3600, F.coalesce(F.lead("h").over(W.partitionBy("k").orderBy("h")), F.col("h") + 24 * 3600))
    steps = hours.withColumn("until", until).select(F.inline(F.array(F.struct(F.col("h").alias("at"), F.lit(1).alias("n")), F.struct(F.col("until").alias("at"), F.lit(-1).alias("n")))))
    steps = steps.groupBy("at").agg(F.sum("n").alias("n"))  # a row for each hour, so the running sum is short
    exact = steps.select(F.timestamp_seconds("at").alias("period"), F.sum("n").over(W.orderBy("at")).alias("exact"))
    within = F.abs(F.col("distinct") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * N.DISTINCT_ERROR)
    return slid.join(exact, "period").select(F.col("period").cast("timestamp_ntz").alias("period"), "periods", "n", "exact", within.alias("within"))
