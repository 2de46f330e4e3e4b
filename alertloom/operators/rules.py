"""Declarative detection and correlation rules over alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values: (rule, severity, signature pattern, signature ids, level, description). Order is by rule number.
DETECTION = (
    (100010, 1, "ET TROJAN.*Beacon|ET MALWARE.*C2|ET CNC", (), 16, "CRITICAL: Malware C2 beacon detected"),
    (100011, 1, "ET MALWARE.*Download|ET TROJAN.*Download", (), 16, "CRITICAL: Malware download detected"),
    (100012, 1, "ET EXPLOIT", (), 15, "CRITICAL: Exploit attempt"),
    (100013, 1, "ET MALWARE.*Certificate|ET TROJAN.*SSL", (), 15, "CRITICAL: Suspicious certificate activity"),
    (100020, 2, "ET WEB_SERVER", (), 12, "HIGH: Web server attack"),
    (100021, 2, "ET ATTACK_RESPONSE", (), 13, "HIGH: Attack response detected"),
    (100022, 2, "ET WEB_SERVER.*SQL", (), 11, "HIGH: SQL injection attempt"),
    (100023, 2, "ET POLICY.*User.*Agent|ET MALWARE.*User.*Agent", (), 10, "HIGH: Suspicious user agent"),
    (100030, 3, "ET POLICY", (), 6, "MEDIUM: Policy violation"),
    (100031, 3, "ET SCAN", (), 7, "MEDIUM: Network scanning"),
    (100032, 3, "ET DNS", (), 6, "MEDIUM: DNS suspicious activity"),
    (100033, 3, "ET POLICY.*External.*IP|ET INFO.*IP.*Lookup", (), 5, "MEDIUM: External IP lookup detected"),
    (100040, None, "ET ADWARE|ET PUP", (), 8, "MEDIUM: Adware or PUP detected"),
    (100041, None, "ET GAMES|ET POLICY.*Gaming", (), 4, "LOW: Gaming traffic detected"),
    (100042, None, "ET TOR|ET POLICY.*Tor", (), 9, "MEDIUM: TOR activity detected"),
    (100043, None, "ET POLICY.*URL.*Shortener", (), 5, "MEDIUM: URL shortener access"),
    (100044, None, "ET POLICY.*File.*Sharing|ET P2P", (), 6, "MEDIUM: File sharing activity"),
    (100050, None, None, (2027793, 2016568), 14, "CRITICAL: Known C2 beacon pattern"),
    (100051, None, None, (2022134, 2020493, 2029345, 2029346), 12, "HIGH: Bad certificate detected"),
    (100052, None, None, (2021997, 2047702, 2020716, 2036304, 2052027), 7, "MEDIUM: External IP lookup service"),
    (100004, 1, None, (), 10, "HIGH: Suricata Severity 1 Alert"),
    (100003, 2, None, (), 8, "MEDIUM: Suricata Severity 2 Alert"),
    (100005, 3, None, (), 5, "LOW: Suricata Severity 3 Alert"),
    (100002, None, None, (), 2, "Suricata Traffic"),
)
#: Fixed values: (rule, any of these rules, hits, seconds, level, description); hits share their source address.
CORRELATION = (
    (100060, (100010, 100011, 100012), 3, 300, 16, "CRITICAL: Multiple malware activities from same source"),
    (100061, (100031, 100020), 2, 1800, 14, "CRITICAL: Scan followed by web attack"),
    (100062, (100030,), 5, 600, 10, "HIGH: Multiple policy violations from same source"),
)


def classify(severity: Column, signature: Column, signature_id: Column) -> Column:
    """struct<rule_id, level, description> of the rule with the highest level that matches, the lower number on a tie."""
    text = F.coalesce(signature, F.lit(""))
    hits = []
    for rule, sev, pattern, ids, level, what in DETECTION:
        ok = F.lit(True)
        if sev is not None:
            ok = ok & (severity == sev)
        if pattern:
            ok = ok & text.rlike(pattern)
        if ids:
            ok = ok & signature_id.isin(*ids)
        described = F.when(text == "", what).otherwise(F.concat(F.lit(f"{what} - "), text))
        hits.append(F.when(ok, F.struct(F.lit(level).alias("level"), F.lit(-rule).alias("order"), described.alias("description"))))
    best = F.array_max(F.array_compact(F.array(*hits)))
    return F.struct((-best["order"]).alias("rule_id"), best["level"].alias("level"), best["description"].alias("description"))


def correlate(alerts: DataFrame, rules: tuple = CORRELATION, key: str = "src_ip", rule: str = "rule_id", ts: str = "ts") -> DataFrame:
    """Alerts at which a correlation fires: with the hits of its rules from the same source within the time before it.

    One window pass for each rule over that rule's own alerts only; rows without a source or a time don't correlate. Time is
    cut into stretches as long as the rule's time, and an alert stands in its own and, to be looked back on, in the next
    one, so a source that holds a large part of all alerts is spread over as many tasks as it has stretches.
    """
    out = None
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    for number, members, hits, seconds, level, what in rules:
        span = seconds * 1_000_000
        rows = alerts.filter(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(rule).isin(*members))
        own = F.floor(at / F.lit(span))
        rows = rows.withColumn("__stretch", F.explode(F.array(own, own + 1))).withColumn("__own", F.col("__stretch") == own)
        w = W.partitionBy(key, "__stretch").orderBy(at).rangeBetween(-span, 0)
        rows = rows.withColumn("hits", F.count("*").over(w)).filter(F.col("__own") & (F.col("hits") >= hits)).drop("__stretch", "__own")
        rows = rows.withColumns({"correlation_id": F.lit(number), "correlation_level": F.lit(level), "correlation": F.lit(what)})
        out = rows if out is None else out.unionByName(rows)
    return out
