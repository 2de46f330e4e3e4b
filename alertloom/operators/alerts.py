"""Alert-level operators: cleaning of raw records, identity, selection, paging and the texts built from an alert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alertloom.functions import net
from alertloom.functions import patterns as P


def text_or_null(c: Column) -> Column:
    return F.nullif(c.cast("string"), F.lit(""))


# --- cleaning --------------------------------------------------------------------------------------------------
#: Output context -> (field, JSON paths under the record, the first non-empty one counts).
CONTEXTS = {
    "http": (("hostname", "data.http.hostname"), ("protocol", "data.http.protocol"), ("method", "data.http.http_method"), ("url", "data.http.url"), ("user_agent", "data.http.http_user_agent", "data.http.user_agent"), ("status", "data.http.status"), ("length", "data.http.length")),
    "dns": (("query", "data.dns.query[0].rrname", "data.dns.rrname", "data.dns.query_name"), ("rrtype", "data.dns.query[0].rrtype", "data.dns.rrtype"), ("type", "data.dns.type"), ("rcode", "data.dns.rcode"), ("version", "data.dns.version")),
    "tls": (("sni", "data.tls.sni"), ("version", "data.tls.version"), ("subject", "data.tls.subject"), ("issuer", "data.tls.issuer", "data.tls.issuerdn"), ("ja3", "data.tls.ja3.hash", "data.tls.ja3"), ("ja3s", "data.tls.ja3s.hash", "data.tls.ja3s")),
    "email": (("from", "data.email.from"), ("to", "data.email.to"), ("subject", "data.email.subject"), ("attachment", "data.email.attachment"), ("mail_from_domain", "data.email.mail_from_domain"), ("url", "data.email.url")),
    "threat": (("actor", "data.threat.actor"), ("campaign", "data.threat.campaign"), ("confidence", "data.threat.confidence")),
    "ioc": (("domain", "data.ioc.domain"), ("ip", "data.ioc.ip"), ("url", "data.ioc.url"), ("hash", "data.ioc.hash")),
    "process": (("name", "data.process.name"), ("parent_process", "data.process.parent_process"), ("file", "data.process.file"), ("path", "data.process.path"), ("command_line", "data.process.command_line")),
    "flow": (("pkts_toserver", "data.flow.pkts_toserver"), ("pkts_toclient", "data.flow.pkts_toclient"), ("bytes_toserver", "data.flow.bytes_toserver"), ("bytes_toclient", "data.flow.bytes_toclient"), ("start", "data.flow.start")),
    "mitre": (("id", "rule.mitre.id[0]", "data.alert.metadata.mitre_technique_id[0]"), ("tactic", "rule.mitre.tactic[0]", "data.alert.metadata.mitre_tactic_name[0]"), ("technique", "rule.mitre.technique[0]", "data.alert.metadata.mitre_technique_name[0]")),
    "file": (("filename", "data.files[0].filename", "data.fileinfo.filename"), ("state", "data.files[0].state", "data.fileinfo.state"), ("md5", "data.files[0].md5", "data.fileinfo.md5"), ("sha1", "data.files[0].sha1", "data.fileinfo.sha1"), ("sha256", "data.files[0].sha256", "data.fileinfo.sha256"), ("size", "data.files[0].size", "data.fileinfo.size")),
    "smb": (("command", "data.smb.command"), ("share", "data.smb.share"), ("filename", "data.smb.filename"), ("disposition", "data.smb.disposition")),
    "modbus": (("function", "data.modbus.function"), ("unit_id", "data.modbus.unit_id"), ("address", "data.modbus.address"), ("quantity", "data.modbus.quantity")),
}
#: Output column -> paths; nested first, then the flat aliases of uploaded templates.
FIELDS = {
    "timestamp": ("timestamp", "time"),
    "rule_id": ("rule.id", "rule_id"),
    "rule_description": ("rule.description", "rule_description"),
    "alert_signature": ("data.alert.signature", "alert_signature", "signature"),
    "alert_category": ("data.alert.category", "alert_category"),
    "signature_id": ("data.alert.signature_id", "signature_id"),
    "src_ip": ("data.src_ip", "src_ip", "srcip"),
    "dest_ip": ("data.dest_ip", "dest_ip", "dstip"),
    "src_port": ("data.src_port", "src_port"),
    "dest_port": ("data.dest_port", "dest_port"),
    "proto": ("data.proto", "proto"),
    "app_proto": ("data.app_proto", "app_proto"),
    "event_type": ("data.event_type", "event_type"),
    "direction": ("data.direction", "direction"),
    "agent_name": ("agent.name",),
    "agent_ip": ("agent.ip",),
    "full_log": ("full_log",),
}


def _path(json: Column, *paths: str) -> Column:
    """First non-empty of some paths; a single object where a list is expected counts as its first element."""
    forms = [q for p in paths for q in dict.fromkeys((p, p.replace("[0]", "")))]
    return F.coalesce(*[text_or_null(F.get_json_object(json, f"$.{p}")) for p in forms])


def clean(raw: DataFrame, assets: net.Assets, json_col: str = "json") -> DataFrame:
    """Raw records (JSON text) to flat nullable columns and one struct per context; other columns are kept.

    `_source` wrappers are opened. Rows without rule description and signature don't survive. Empty values are NULL,
    and a context without any value is NULL.
    """
    body = F.coalesce(F.get_json_object(json_col, "$._source"), F.col(json_col))
    d = raw.withColumn("__body", body)
    j = F.col("__body")
    level = net.safe_int(_path(j, "rule.level", "rule_level"))
    out = d.withColumns({k: _path(j, *p) for k, p in FIELDS.items()} | {"rule_level": level})
    out = out.filter(F.col("rule_description").isNotNull() | F.col("alert_signature").isNotNull())
    contexts = {}
    for name, fields in CONTEXTS.items():
        s = F.struct(*[_path(j, *f[1:]).alias(f[0]) for f in fields])
        contexts[f"{name}_context"] = F.when(F.coalesce(*[s[f[0]] for f in fields]).isNotNull(), s)
    out = out.withColumns(contexts).drop("__body")
    out = out.withColumns({"__src": net.ip_number(F.col("src_ip")), "__dest": net.ip_number(F.col("dest_ip"))})
    out = out.withColumns({"src_ip_context": net.ip_context(F.col("src_ip"), assets, F.col("__src")), "dest_ip_context": net.ip_context(F.col("dest_ip"), assets, F.col("__dest"))}).drop("__src", "__dest")
    return out.withColumn("threat_classification", net.threat(F.col("src_ip_context"), F.col("dest_ip_context"), F.col("rule_level")))


# --- identity --------------------------------------------------------------------------------------------------
def alert_uuid(*fields: Column) -> Column:
    """md5 of trimmed, lower-case fields joined by pipes; NULL counts as empty."""
    return F.md5(F.concat_ws("|", *[F.lower(F.trim(F.coalesce(f.cast("string"), F.lit("")))) for f in fields]))


def dedupe_hash(rule_id: Column, src_ip: Column, dest_ip: Column, signature: Column, timestamp: Column) -> Column:
    """md5 of the fields that make an alert one alert, the time cut to its minute."""
    text = [F.coalesce(f.cast("string"), F.lit("")) for f in (rule_id, src_ip, dest_ip, signature)]
    return F.md5(F.concat_ws("|", *text, F.substring(F.coalesce(timestamp.cast("string"), F.lit("")), 1, 16)))


def first_seen(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = W.partitionBy(key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


# --- selection and paging --------------------------------------------------------------------------------------
def representatives(alerts: DataFrame, n: int = 12, order: str = "event_id") -> DataFrame:
    """The most severe, then latest alerts, one for each (rule, description, signature, addresses)."""
    fold = lambda c: F.lower(F.coalesce(F.col(c).cast("string"), F.lit("")))
    plain = lambda c: F.coalesce(F.col(c), F.lit(""))
    signature = [fold("alert_signature")] if "alert_signature" in alerts.columns else []
    ranked = [F.desc("rule_level"), F.desc("ts"), F.asc(order)]
    w = W.partitionBy(fold("rule_id"), fold("rule_description"), *signature, plain("src_ip"), plain("dest_ip")).orderBy(*ranked)
    return alerts.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n").orderBy(*ranked).limit(n)


def page(alerts: DataFrame, number: int, size: int, min_severity: int = 0, order: str = "event_id", most: int = 500) -> DataFrame:
    """A page, newest first; the filter runs before paging and everything costly should run after it."""
    number, size = max(1, number), min(max(1, size), most)
    rows = alerts.filter(F.col("rule_level") >= min_severity) if min_severity > 0 else alerts
    return rows.orderBy(F.desc(order)).offset((number - 1) * size).limit(size)


def adaptive_filter(alerts: DataFrame, automatic: bool, threshold: int = 8) -> dict:
    """Search filter chosen from the highest level: the threshold in automatic mode, else 5 from level 8 on."""
    top = alerts.agg(F.max("rule_level")).first()[0] or 0
    if automatic and top >= threshold:
        return {"min_severity": threshold}
    return {"min_severity": 5} if top >= 8 else {}


# --- texts of an alert -----------------------------------------------------------------------------------------
def behavior_tags(alert_text: Column, dest_port: Column, src_port: Column, way: Column) -> Column:
    """Up to eight tags of an alert, in the table's order."""
    text, port = F.lower(alert_text), F.coalesce(dest_port.cast("string"), F.lit(""))
    hit = {}
    for tag, (pattern, ports) in P.ALERT_TAGS.items():
        hit[tag] = text.rlike(f"(?U){pattern}") | (port.isin(*ports) if ports else F.lit(False))
    tags = [F.when(h, t) for t, h in hit.items()]
    tags += [
        F.when((way == "outbound") & (hit["possible_c2"] | hit["domain_or_tls_indicator"]), "compromised_asset_egress"),
        F.when((way == "inbound") & (hit["web_or_exploit_attempt"] | hit["reconnaissance_or_scanning"]), "external_to_protected_asset"),
        F.when(way == "lateral", "internal_lateral_activity"),
        *[F.when(port == p, t) for p, t in P.PORT_TAGS.items()],
    ]
    return F.slice(F.array_compact(F.array(*tags)), 1, 8)


def service_text(app_proto: Column, proto: Column, dest_port: Column, default: str) -> Column:
    service = F.coalesce(text_or_null(app_proto), text_or_null(proto), F.lit(default))
    return F.when(text_or_null(dest_port).isNotNull(), F.concat_ws("/", service, dest_port.cast("string"))).otherwise(service)


def response_focus(way: Column, infra: Column, tags: Column, src: Column, dest: Column, service: Column) -> Column:
    """Up to six response hints by direction and tags; an infrastructure source has one."""
    has = lambda *t: F.arrays_overlap(tags, F.array(*[F.lit(x) for x in t]))
    s, d = F.coalesce(text_or_null(src), F.lit("source")), F.coalesce(text_or_null(dest), F.lit("destination"))
    protected = F.coalesce(text_or_null(dest), F.lit("protected asset"))
    known = way.isin("inbound", "outbound", "lateral")
    items = [
        F.when(way == "inbound", F.concat(F.lit("Validate exposure and logs on destination "), protected, F.lit(" "), service, F.lit("."))),
        F.when((way == "inbound") & has("reconnaissance_or_scanning"), F.concat(F.lit("Rate-limit or block repeated external scanner "), s, F.lit(" if activity persists."))),
        F.when((way == "inbound") & has("web_or_exploit_attempt"), F.concat(F.lit("Review web/app logs and patch/harden affected service on "), d, F.lit("."))),
        F.when(way == "outbound", F.concat(F.lit("Investigate source asset "), s, F.lit(" as potentially compromised."))),
        F.when((way == "outbound") & has("possible_c2", "compromised_asset_egress"), F.concat(F.lit("Contain "), s, F.lit(" and review egress/DNS/TLS logs for C2."))),
        F.when((way == "outbound") & has("possible_exfiltration"), F.concat(F.lit("Check data transfer volume and sensitive file access from "), s, F.lit("."))),
        F.when(way == "lateral", F.concat(F.lit("Investigate internal path "), s, F.lit(" -> "), d, F.lit(" for lateral movement."))),
        F.when((way == "lateral") & has("smb_service_activity", "lateral_movement_candidate"), F.lit("Audit SMB/admin-share access, credentials, and endpoint process activity.")),
        F.when(~known, F.lit("Prioritize current alert fields and asset inventory before applying generic CTI remediation.")),
        F.when(has("malware_or_destructive_activity"), F.lit("Isolate affected endpoint(s) and preserve forensic evidence before remediation.")),
        F.when(has("credential_attack"), F.lit("Review authentication logs, lockouts, MFA status, and exposed remote access services.")),
        F.when(has("domain_or_tls_indicator"), F.lit("Search DNS/TLS/proxy logs for related domains, SNI, certificates, and repeated callbacks.")),
    ]
    only = F.array(F.lit("Suppress monitoring/noise infrastructure unless corroborated by destination compromise evidence."))
    return F.when(infra, only).otherwise(F.slice(F.array_compact(F.array(*items)), 1, 6))


def priority_reason(way: Column, infra: Column, level: Column) -> Column:
    return (
        F.when(infra, "Monitoring/noise infrastructure source; treat as low-priority unless corroborated by protected-asset activity.")
        .when(way == "outbound", F.format_string("Protected asset initiated external communication under alert level %d; investigate possible compromise, C2, or exfiltration.", level))
        .when(way == "inbound", F.format_string("External source targeted a protected asset under alert level %d; assess exploit attempt and exposed service risk.", level))
        .when(way == "lateral", F.format_string("Internal-to-internal alert under level %d; investigate post-compromise movement or policy violation.", level))
        .when(way == "external", "External-to-external traffic with no configured protected asset involvement; lower relevance unless rule context proves impact.")
        .otherwise("Insufficient IP direction context; rely on rule, signature, and IoC evidence for priority.")
    )


def directional_focus(way: Column, infra: Column, src: Column, dest: Column, service: Column) -> Column:
    s, d = F.coalesce(text_or_null(src), F.lit("unknown source")), F.coalesce(text_or_null(dest), F.lit("unknown destination"))
    join = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    return (
        F.when(infra, join("Source ", s, " is monitoring/noise infrastructure; suppress as noise unless the destination or payload shows independent compromise evidence."))
        .when(way == "inbound", join("Prioritize external source ", s, " as attacker/infrastructure and destination ", d, " ", service, " as the protected target."))
        .when(way == "outbound", join("Prioritize source ", s, " as the potentially compromised asset and destination ", d, " ", service, " as possible C2, exfiltration, or malicious service."))
        .when(way == "lateral", join("Treat ", s, " -> ", d, " as internal lateral movement or policy violation; do not infer public threat actor attribution from private IPs alone."))
        .when(way == "external", "Both endpoints appear outside configured protected inventory; keep relevance low unless the alert rule or payload explicitly ties it to owned assets.")
        .otherwise("Use rule, signature, service, and explicit IoCs to decide whether source or destination is more important.")
    )


def fingerprint(parts: dict[str, Column], cap: int = 8) -> Column:
    """k=v parts joined by pipes; empty ones are skipped, lists show their first values."""
    def show(name: str, c: Column, is_list: bool) -> Column:
        v = F.array_join(F.slice(c, 1, cap), ",") if is_list else c.cast("string")
        return F.when(F.nullif(v, F.lit("")).isNotNull(), F.concat(F.lit(f"{name}="), v))

    return F.concat_ws(" | ", *[show(k.rstrip("*"), c, k.endswith("*")) for k, c in parts.items()])


def labelled(parts: dict[str, Column]) -> Column:
    """"label: value" parts joined by " | ", empty values skipped: the text an alert is embedded as."""
    return F.concat_ws(" | ", *[F.when(text_or_null(c).isNotNull(), F.concat(F.lit(f"{k}: "), c.cast("string"))) for k, c in parts.items()])
