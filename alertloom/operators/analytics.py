"""Breakdowns, counters, top lists, chart datasets, snapshots and trends over enriched alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alertloom.functions import net


def breakdown(alerts: DataFrame, column: str, name: str, default: str = "Unknown") -> DataFrame:
    """Rows per value, infrastructure rows included; absent values count under the default."""
    return alerts.groupBy(F.coalesce(F.col(column), F.lit(default)).alias(name)).agg(F.count("*").alias("n"))


def counters(alerts: DataFrame) -> DataFrame:
    """One row of conditional counts; rows of infrastructure sources count only as such."""
    rest = ~F.col("is_infrastructure_alert")
    way = lambda d: F.count_if(rest & (F.col("threat_direction") == d))
    return alerts.agg(
        F.count("*").alias("total"),
        F.count_if("is_infrastructure_alert").alias("infrastructure"),
        F.count_if(rest & F.col("is_internal_threat")).alias("internal"),
        F.count_if(rest & F.col("is_external_threat")).alias("external"),
        way("inbound").alias("inbound"),
        way("outbound").alias("outbound"),
        way("lateral").alias("lateral"),
    )


def top_values(alerts: DataFrame, column: str, where: Column, k: int, order: str = "event_id") -> DataFrame:
    """The k most frequent values; ties go to the one seen first."""
    by = alerts.filter(where & F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    return by.orderBy(F.desc("n"), "first_seen").limit(k)


def top_with_others(alerts: DataFrame, column: str, where: Column, k: int, order: str = "event_id") -> DataFrame:
    """The k most frequent values and one row "Others" with the remainder, if any is left."""
    by = alerts.filter(where & F.col(column).isNotNull()).groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    top = by.orderBy(F.desc("n"), "first_seen").limit(k).select("label", "n")
    total = by.agg(F.sum("n").alias("total"))
    rest = top.agg(F.sum("n").alias("shown")).join(total)  # one row each
    others = rest.select(F.lit("Others").alias("label"), (F.col("total") - F.col("shown")).alias("n")).filter("n > 0")
    return top.unionByName(others)


def timeline(alerts: DataFrame) -> DataFrame:
    """Points of the severity timeline: level 0 and rows without a time are left out."""
    return alerts.filter((F.col("rule_level") > 0) & F.col("ts").isNotNull()).select("event_id", "ts", "rule_level")


def geo_summary(alerts: DataFrame) -> DataFrame:
    """Counts by side and country over src_country and dest_country, infrastructure rows left out."""
    sides = F.explode(F.array(F.concat(F.lit("src_"), F.col("src_country")), F.concat(F.lit("dest_"), F.col("dest_country"))))
    return alerts.filter(~F.col("is_infrastructure_alert")).select(sides.alias("label")).filter("label is not null").groupBy("label").agg(F.count("*").alias("n"))


def severity_by_country(alerts: DataFrame) -> DataFrame:
    rows = alerts.filter(~F.col("is_infrastructure_alert") & F.col("src_country").isNotNull())
    return rows.groupBy(F.col("src_country").alias("country")).agg(F.count("*").alias("total"), F.count_if(F.col("rule_level") >= 8).alias("high"))


#: What is known of a located address.
GEO_FIELDS = ("country", "country_code", "city", "region", "region_code", "latitude", "longitude", "timezone", "postal_code", "accuracy_radius")


def geo_lookup(alerts: DataFrame, ranges: DataFrame, ip: str, out: str, fields: tuple[str, ...] = ("country",), public_only: bool = False) -> DataFrame:
    """Left range lookup of an address column in ranges(lo, hi, fields); ranges don't overlap.

    One field becomes the column `out`, several become a struct of that name; an address without a range has NULL, and so
    has one that is not public where only those are wanted. Ranges are cut at borders of 2^16 addresses, so the join is
    on equal leading halves and not a nested loop, a row meets only the ranges of its own half, and cutting adds at most
    65,536 rows to the ranges.
    """
    n = net.ip_number(F.col(ip))
    if public_only:
        n = F.when(net.is_public(F.col(ip)), n)
    cut = ranges.withColumn("half", F.explode(F.sequence(F.shiftright("lo", 16), F.shiftright("hi", 16))))
    found = F.col(fields[0]) if len(fields) == 1 else F.struct(*fields)
    cut = cut.select("half", F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), found.alias(out))
    left = alerts.withColumn("__n", n)
    on = (F.shiftright(F.col("__n"), 16) == F.col("half")) & F.col("__n").between(F.col("__lo"), F.col("__hi"))
    return left.join(cut, on, "left").drop("__n", "__lo", "__hi", "half")


def snapshots(alerts: DataFrame, every: str = "hour") -> DataFrame:
    """Total, high (critical included) and critical counts per period."""
    return alerts.groupBy(F.date_trunc(every, F.col("ts").cast("timestamp")).alias("period")).agg(F.count("*").alias("n"), F.count_if(F.col("rule_level") >= 8).alias("high"), F.count_if(F.col("rule_level") >= 12).alias("critical"))


def trend(snaps: DataFrame, hours: int) -> DataFrame:
    """For each snapshot, over it and those of the `hours` before: how many, mean, sums, maximum and the latest count.

    One window over all snapshots: they are one row an hour, some 8,800 a year, whatever the number of alerts.
    """
    seconds = F.unix_timestamp("period")
    w = W.partitionBy(F.lit(0)).orderBy(seconds).rangeBetween(-(hours - 1) * 3600, 0)
    return snaps.select("period", F.count("*").over(w).alias("snapshots"), F.avg("n").over(w).alias("avg_n"), F.sum("high").over(w).alias("high"), F.sum("critical").over(w).alias("critical"), F.max("n").over(w).alias("max_n"), F.last("n").over(w).alias("latest"))


#: Registers of the distinct-count sketches (2 to this power) and the bound that follows: four standard errors of 1.04 / sqrt(2**LOG_K).
LOG_K = 14
DISTINCT_ERROR = 4 * 1.04 / 2 ** (LOG_K / 2)


def distinct_sketches(alerts: DataFrame, value: Column, every: str = "hour") -> DataFrame:
    """(period, n, sketch): a mergeable sketch of the distinct values of each period, some kilobytes whatever their number.

    Also of a stream, with F.window for the period: sketches add up, so late periods may be written as further rows.
    """
    return alerts.groupBy(F.date_trunc(every, F.col("ts").cast("timestamp")).alias("period")).agg(F.count("*").alias("n"), F.hll_sketch_agg(value, F.lit(LOG_K)).alias("sketch"))


def sliding_distinct(sketches: DataFrame, hours: int = 24) -> DataFrame:
    """(period, periods, n, distinct) over each hour that has a row and the hours - 1 before it, from hourly sketches and no alerts.

    A row goes to the `hours` windows it belongs to, so a window merges that many rows; windows without an own row are left out. The
    estimate is within DISTINCT_ERROR of the exact number; small numbers are exact.
    """
    ahead = F.explode(F.sequence(F.lit(0), F.lit(hours - 1))).alias("ahead")
    spread = sketches.select("period", "n", "sketch", ahead)
    spread = spread.withColumn("window", F.timestamp_seconds(F.unix_timestamp("period") + F.col("ahead") * 3600))
    by = spread.groupBy("window").agg(F.count_if(F.col("ahead") == 0).alias("own"), F.count("*").alias("periods"), F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))
    return by.filter("own > 0").select(F.col("window").alias("period"), "periods", "n", "distinct")


def running(runs: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Running minimum, maximum and mean per key."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return runs.select(key, order, value, F.min(value).over(w).alias("run_min"), F.max(value).over(w).alias("run_max"), F.avg(value).over(w).alias("run_avg"))


def run_metrics(runs: DataFrame, value: str, ok: Column, order: str, last: int = 100) -> DataFrame:
    """Totals, success rate, and mean, least and greatest value of the last rows."""
    recent = runs.orderBy(F.desc(order)).limit(last).agg(F.avg(value).alias("avg_recent"), F.min(value).alias("min_recent"), F.max(value).alias("max_recent"), F.count("*").alias("recent"))
    total = runs.agg(F.count("*").alias("total"), F.count_if(ok).alias("ok"))
    return total.join(recent).withColumn("success_rate", F.when(F.col("total") > 0, F.col("ok") / F.col("total") * 100).otherwise(0.0))  # one row each


def last_rows(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The ring of the last n rows per key."""
    w = W.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    return rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def approvals(log: DataFrame) -> DataFrame:
    """One row of a log of report approvals (approved_at): how many, and when the last one was."""
    return log.agg(F.count("approved_at").alias("reports_approved"), F.max("approved_at").alias("last_approval_time"))
