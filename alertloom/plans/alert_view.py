"""A deterministic alert table over the driver's `events`, and the same as an SQL view.

It is synthetic: levels, rules and addresses are computed from event_id, user_id and props.k, so that every branch of
the address and direction logic occurs. Addresses come from private and documentation ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.functions import net

ASSETS = net.Assets(infrastructure=("203.0.113.0/24",), owned=("192.0.2.0/24",), internal=("10.0.0.0/8",))
PREFIX = {0: "10.0.0.", 1: "192.0.2.", 2: "198.51.100.", 3: "203.0.113."}


def _address(kind, host):
    out = F.lit(PREFIX[0])
    for k in (1, 2, 3):
        out = F.when(kind == k, PREFIX[k]).otherwise(out)
    return F.concat(out, host.cast("string"))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base alert columns, from a scan that reads five columns of events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    u5 = F.col("user_id") % 5
    src_kind = F.when(u5 == 4, 3).when(u5 == 3, 2).otherwise(u5)
    dest_kind = F.col("event_id") % 4
    return e.select(
        "event_id",
        "ts",
        (k % 17).alias("rule_level"),
        (k + 100000).alias("rule_id"),
        F.col("event_type").alias("rule_description"),
        F.when(F.col("event_id") % 97 != 0, _address(src_kind, F.col("user_id") % 250 + 1)).alias("src_ip"),
        _address(dest_kind, F.col("event_id") % 200 + 1).alias("dest_ip"),
        F.element_at(F.array(F.lit("TCP"), F.lit("UDP"), F.lit("icmp")), (F.col("user_id") % 3 + 1).cast("int")).alias("proto"),
        F.col("user_id"),
    )


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts with address contexts, direction, confidence and severity."""
    a = alerts(spark, sf_dir)
    # a generator holds filters above it back, which would otherwise repeat the parsing for every use of a context
    numbers = F.struct(net.ip_number(F.col("src_ip")).alias("src_n"), net.ip_number(F.col("dest_ip")).alias("dest_n"))
    a = a.select("*", F.inline(F.array(numbers)))
    a = a.withColumns({f"{s}_context": net.ip_context(F.col(f"{s}_ip"), ASSETS, F.col(f"{s}_n")) for s in ("src", "dest")})
    return a.withColumn("t", net.threat(F.col("src_context"), F.col("dest_context"), F.col("rule_level"))).select("*", "t.*", net.severity(F.col("rule_level")).alias("severity")).drop("t", "src_n", "dest_n")


ALERTS_SQL = """
alerts AS (
  SELECT event_id, ts, CAST(json_extract_string(props, '$.k') AS INT) % 17 AS rule_level,
         CAST(json_extract_string(props, '$.k') AS INT) + 100000 AS rule_id, event_type AS rule_description,
         CASE WHEN event_id % 97 <> 0 THEN
           CASE user_id % 5 WHEN 0 THEN '10.0.0.' WHEN 1 THEN '192.0.2.' WHEN 4 THEN '203.0.113.' ELSE '198.51.100.' END
           || CAST(user_id % 250 + 1 AS VARCHAR) END AS src_ip,
         CASE event_id % 4 WHEN 0 THEN '10.0.0.' WHEN 1 THEN '192.0.2.' WHEN 2 THEN '198.51.100.' ELSE '203.0.113.' END
           || CAST(event_id % 200 + 1 AS VARCHAR) AS dest_ip,
         CASE user_id % 3 WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP' ELSE 'icmp' END AS proto, user_id
  FROM events),
numbered AS (
  SELECT *, list_reduce(list_transform(string_split(src_ip, '.'), lambda x: CAST(x AS BIGINT)), lambda a, b: a * 256 + b) AS src_n,
            list_reduce(list_transform(string_split(dest_ip, '.'), lambda x: CAST(x AS BIGINT)), lambda a, b: a * 256 + b) AS dest_n
  FROM alerts),
contexts AS (
  SELECT *, CASE WHEN src_ip IS NULL THEN 'unknown' WHEN src_n BETWEEN 3405803776 AND 3405804031 THEN 'infrastructure'
                 WHEN src_n BETWEEN 3221225984 AND 3221226239 THEN 'owned' WHEN src_n BETWEEN 167772160 AND 184549375 THEN 'internal'
                 ELSE 'external' END AS src_context,
            CASE WHEN dest_ip IS NULL THEN 'unknown' WHEN dest_n BETWEEN 3405803776 AND 3405804031 THEN 'infrastructure'
                 WHEN dest_n BETWEEN 3221225984 AND 3221226239 THEN 'owned' WHEN dest_n BETWEEN 167772160 AND 184549375 THEN 'internal'
                 ELSE 'external' END AS dest_context
  FROM numbered),
enriched AS (
  SELECT *, CASE WHEN src_context = 'infrastructure' THEN 'infrastructure'
                 WHEN src_context IN ('internal', 'owned') AND dest_context = 'external' THEN 'outbound'
                 WHEN src_context = 'external' AND dest_context IN ('internal', 'owned') THEN 'inbound'
                 WHEN src_context IN ('internal', 'owned') AND dest_context IN ('internal', 'owned') THEN 'lateral'
                 WHEN dest_context = 'infrastructure' THEN 'inbound'
                 WHEN src_context = 'external' AND dest_context = 'external' THEN 'external' ELSE 'unknown' END AS threat_direction,
            CASE WHEN src_context = 'infrastructure' THEN 'low' WHEN rule_level >= 12 THEN 'high' WHEN rule_level >= 8 THEN 'medium' ELSE 'low' END AS confidence,
            src_context = 'infrastructure' AS is_infrastructure_alert,
            src_context IN ('internal', 'owned') AND dest_context IN ('external', 'internal', 'owned') AS is_internal_threat,
            src_context = 'external' AS is_external_threat,
            CASE WHEN rule_level >= 12 THEN 'Critical' WHEN rule_level >= 8 THEN 'High' WHEN rule_level >= 5 THEN 'Medium' ELSE 'Low' END AS severity
  FROM contexts)
"""
