"""Queries on rows planted by id, so that the answers are known by construction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from alertloom.functions import net
from alertloom.functions import text as T
from alertloom.operators import alerts as A
from alertloom.operators import analytics as N
from alertloom.operators import audit as U
from alertloom.operators import corpus as C
from alertloom.operators import reporting as G
from alertloom.operators import reports as R
from alertloom.operators import search as S
from alertloom.plans.alert_view import ASSETS, alerts
from alertloom.plans.registry import documents, query, shared_folder
from alertloom.sources import readers
from alertloom.streaming import monitor as M


def _planted(spark, sf_dir, *sentences: str):
    """(doc_id, text): the sentence of doc_id modulo their number, {a} an address and {i} the id."""
    i = F.col("doc_id")
    said = F.element_at(F.array(*[F.lit(s) for s in sentences]), (i % len(sentences) + 1).cast("int"))
    address = F.concat(F.lit("198.51.100."), (i % 250 + 1).cast("string"))
    return documents(spark, sf_dir).select("doc_id", F.replace(F.replace(said, F.lit("{a}"), address), F.lit("{i}"), i.cast("string")).alias("text"))


@query("""SELECT doc_id, x.kind AS kind, x.value AS value FROM (SELECT doc_id, unnest([{'kind': 'ips', 'value': '198.51.100.' || (doc_id % 250 + 1)}, {'kind': 'domains', 'value': 'site' || doc_id || '.badnet.org'},
  {'kind': 'urls', 'value': 'https://site' || doc_id || '.badnet.org/a' || doc_id}, {'kind': 'emails', 'value': 'mail' || doc_id || '@post.badnet.org'}, {'kind': 'hashes', 'value': md5(CAST(doc_id AS VARCHAR))},
  {'kind': 'cves', 'value': 'CVE-2024-' || (10000 + doc_id % 10000)}, {'kind': 'mitre_techniques', 'value': 'T1059.' || (100 + doc_id % 900)}, {'kind': 'threat_actors', 'value': 'APT' || (doc_id % 40 + 1)}]) AS x FROM documents)""")
def planted_indicators(spark, sf_dir):
    i = F.col("doc_id")
    parts = F.concat(F.lit(", hash "), F.md5(i.cast("string").cast("binary")), F.lit(", cve-2024-"), 10000 + i % 10000, F.lit(" by T1059."), 100 + i % 900, F.lit(" of apt"), i % 40 + 1)
    plain = F.concat("text", parts)
    disguised = F.replace(F.replace(plain, F.lit("https"), F.lit("hxxps")), F.lit("."), F.lit("[.]"))
    rows = _planted(spark, sf_dir, "Address {a} spoke to https://site{i}.badnet.org/a{i} and mail{i}@post.badnet.org").select("doc_id", F.when(i % 2 == 0, plain).otherwise(disguised).alias("text"))
    found = rows.select("doc_id", F.inline(F.array(F.struct(T.artifacts(T.refang(F.col("text"))).alias("a")))))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"a.{k}").alias("values")) for k in T.EXTRACTORS])
    return found.select("doc_id", F.explode(kinds).alias("x")).select("doc_id", "x.kind", F.explode("x.values").alias("value"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'analysis_environment' WHEN 1 THEN 'remediation,ioc_listing,vulnerability' WHEN 2 THEN 'ttp_behavior' ELSE '' END AS labels,
  CASE doc_id % 4 WHEN 1 THEN 'web_or_exploit_attempt' WHEN 2 THEN 'lateral_movement_candidate,credential_attack' ELSE '' END AS tags FROM documents""")
def planted_labels(spark, sf_dir):
    rows = _planted(spark, sf_dir, "The sandbox detonation of the sample.", "Block the malicious ip and patch the exploit.", "Lateral movement over smb and rdp, then a stolen credential.", "Nothing of note.")
    return rows.select("doc_id", F.array_join(T.context_labels(F.col("text")), ",").alias("labels"), F.array_join(T.behavior_tags(F.col("text")), ",").alias("tags"))


@query("""SELECT doc_id, kind, CASE WHEN kind = 'ips' THEN '198.51.100.' || (doc_id % 250 + 1) ELSE 'host' || doc_id || '.badnet.org' END AS value, CASE doc_id % 4 WHEN 0 THEN 'malicious' WHEN 1 THEN 'victim'
  WHEN 2 THEN 'analysis_environment' ELSE 'unknown' END AS disposition FROM documents, (VALUES ('ips'), ('domains')) k(kind)""")
def planted_dispositions(spark, sf_dir):
    rows = _planted(spark, sf_dir, *[f"{said.format('{a}')}\n{said.format('host{i}.badnet.org')}" for said in ("The C2 server {} is malicious", "The victim {} was reached", "A sandbox run used {} here", "Please see {} there")])
    found = rows.select("doc_id", "text", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), f(F.col("text")).alias("values")) for k, f in (("ips", T.ips), ("domains", T.domains))])).alias("x"))
    found = found.select("doc_id", "text", "x.kind", F.explode("x.values").alias("value"))
    role = F.when(F.col("kind") == "ips", T.disposition(F.col("text"), F.col("value"), "ips")).otherwise(T.disposition(F.col("text"), F.col("value"), "domains"))
    return found.select("doc_id", "kind", "value", role.alias("disposition"))


def _rows(spark, sf_dir):
    """(doc_id, i): i is the id without null."""
    return documents(spark, sf_dir).select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("i"))


def _said(*parts: str | Column) -> Column:
    """Text and columns joined."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# --- alerts ------------------------------------------------------------------------------------------------------
@query("""SELECT event_id, CASE WHEN event_id % 8 <> 4 THEN 'rule ' || event_id % 50 END AS rule_description, CASE WHEN event_id % 8 = 4 THEN 'sig' WHEN event_id % 4 = 2 THEN 'flat' END AS alert_signature,
  CAST(event_id % 17 AS INT) AS rule_level, '10.0.0.' || (event_id % 250 + 1) AS src_ip, CASE WHEN event_id % 3 = 0 THEN '198.51.100.9' ELSE '192.0.2.9' END AS dest_ip, 'internal' AS src_ip_context,
  CASE WHEN event_id % 3 = 0 THEN 'external' ELSE 'owned' END AS dest_ip_context, CASE WHEN event_id % 3 = 0 THEN 'outbound' ELSE 'lateral' END AS direction,
  CASE WHEN event_id % 4 < 2 THEN 'host' || event_id || '.example' END AS dns_query, CASE WHEN event_id % 4 < 2 THEN 'T1059' END AS technique, event_id % 4 = 2 AS no_mitre FROM events WHERE event_id % 4 <> 3""")
def cleaned_alerts(spark, sf_dir):
    e = F.col("event_id")
    said = F.when(e % 8 == 4, _said('"","x":"')).otherwise(_said('"rule ', e % 50))
    peer = F.when(e % 3 == 0, "198.51.100.9").otherwise("192.0.2.9")
    signature = F.when(e % 8 == 4, '"alert":{"signature":"sig"},').otherwise("")
    dns = lambda x: F.when(e % 4 == 0, _said('[{"rrname":"', x, '"}]')).otherwise(_said('{"rrname":"', x, '"}'))
    nested = _said('{"rule":{"id":"7","level":', e % 17, ',"description":', said, '","mitre":{"id":["T1059"]}},"data":{', signature, '"src_ip":"10.0.0.', e % 250 + 1, '","dest_ip":"', peer, '","dns":{"query":', dns(_said("host", e, ".example")), "}}}")
    flat = _said('{"rule_id":7,"rule_level":"', e % 17, '","rule_description":"rule ', e % 50, '","signature":"flat","srcip":"10.0.0.', e % 250 + 1, '","dstip":"', peer, '"}')
    body = F.when(e % 4 == 0, nested).when(e % 4 == 1, _said('{"_source":', nested, "}")).when(e % 4 == 2, flat).otherwise('{"data":{"src_ip":"10.0.0.1"},"rule":{"description":""}}')
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", body.alias("json"))
    c = A.clean(raw, ASSETS)
    return c.select("event_id", "rule_description", "alert_signature", "rule_level", "src_ip", "dest_ip", "src_ip_context", "dest_ip_context", F.col("threat_classification.threat_direction").alias("direction"), F.col("dns_context.query").alias("dns_query"), F.col("mitre_context.id").alias("technique"), F.col("mitre_context").isNull().alias("no_mitre"))


@query("SELECT doc_id, unnest(CASE WHEN doc_id % 3 = 0 THEN ['1', '2'] ELSE [CAST(doc_id AS VARCHAR)] END) AS n FROM documents WHERE doc_id % 3 <> 2")
def expanded_envelopes(spark, sf_dir):
    i = F.col("doc_id")
    body = F.when(i % 3 == 0, '{"alerts":[{"n":1},{"n":2},"x"]}').when(i % 3 == 1, _said('{"n":', i, "}")).otherwise('{"alerts":[]}')
    return readers.expand_envelopes(documents(spark, sf_dir).select("doc_id", body.alias("json"))).select("doc_id", F.get_json_object("json", "$.n").alias("n"))


@query("""SELECT event_id, 'Rule: ' || rule_description || ' | Rule ID: ' || rule_id || coalesce(' | Source: ' || src_ip, '') || ' | Destination: ' || dest_ip || ' | Protocol: ' || proto AS body,
  '{"rule_level":' || rule_level || ',"rule_id":' || rule_id || ',"rule_description":"' || rule_description || '"' || coalesce(',"src_ip":"' || src_ip || '"', '') || ',"dest_ip":"' || dest_ip || '","proto":"' || proto || '"}' AS line,
  'rule=' || rule_id || coalesce(' | src=' || src_ip, '') || ' | peers=' || dest_ip || ',' || proto AS fingerprint FROM alerts""", True)
def alert_texts(spark, sf_dir):
    a = alerts(spark, sf_dir)
    parts = {"rule": F.col("rule_id"), "src": F.col("src_ip"), "none": F.lit(""), "peers*": F.array("dest_ip", "proto")}
    return a.select("event_id", G.alert_text(a).alias("body"), G.compact(a).alias("line"), A.fingerprint(parts).alias("fingerprint"))


@query("""SELECT count(*) AS alerts, count(*) FILTER (rule_level >= 12) AS critical, max(rule_level) AS max_level, list(h ORDER BY h)[1:5] AS first_hashes, 'IMMEDIATE' AS urgency FROM (SELECT min(rule_level) AS rule_level, h FROM
  (SELECT rule_level, md5(rule_id || '|' || coalesce(src_ip, '') || '|' || dest_ip || '|' || rule_description || '|' || strftime(ts, '%Y-%m-%d %H:%M')) AS h FROM alerts WHERE rule_level >= 8) GROUP BY h)""", True)
def trigger_record(spark, sf_dir):
    return M.trigger_record(M.dedupe(alerts(spark, sf_dir).filter("rule_level >= 8"), batch=True))


@query("SELECT event_id FROM alerts WHERE rule_level >= 5 AND ts >= TIMESTAMP '2024-01-10'", True)
def metadata_filtered(spark, sf_dir):
    a = alerts(spark, sf_dir)
    chosen = A.adaptive_filter(a, automatic=False)  # some level is 8 or more
    return S.metadata_filter(a.withColumn("severity", F.col("rule_level")), since=F.to_timestamp_ntz(F.lit("2024-01-10 00:00:00")), **chosen).select("event_id")


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ['reconnaissance_or_scanning', 'web_or_exploit_attempt', 'external_to_protected_asset'] WHEN 1 THEN ['possible_c2', 'compromised_asset_egress', 'dns_service_activity']
    WHEN 2 THEN ['malware_or_destructive_activity', 'lateral_movement_candidate', 'internal_lateral_activity', 'smb_service_activity'] ELSE [] END AS tags,
  CASE doc_id % 4 WHEN 0 THEN ['Validate exposure and logs on destination d' || doc_id || ' http/443.', 'Rate-limit or block repeated external scanner s if activity persists.', 'Review web/app logs and patch/harden affected service on d' || doc_id || '.']
    WHEN 1 THEN ['Investigate source asset s as potentially compromised.', 'Contain s and review egress/DNS/TLS logs for C2.']
    WHEN 2 THEN ['Investigate internal path s -> d' || doc_id || ' for lateral movement.', 'Audit SMB/admin-share access, credentials, and endpoint process activity.', 'Isolate affected endpoint(s) and preserve forensic evidence before remediation.']
    ELSE ['Prioritize current alert fields and asset inventory before applying generic CTI remediation.'] END AS focus FROM documents""")
def planted_focus(spark, sf_dir):
    d = _planted(spark, sf_dir, "Nmap scan, then SQL injection", "a C2 beacon", "Ransomware over SMB", "quiet")
    of = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("doc_id") % 4 + 1).cast("int"))
    way, port = of("inbound", "outbound", "lateral", "unknown"), of("443", "53", "445", "9")
    tags = A.behavior_tags(F.col("text"), port, F.lit(None).cast("string"), way)
    service = A.service_text(F.lit("http"), F.lit("tcp"), port, "service")
    return d.select("doc_id", tags.alias("tags"), A.response_focus(way, F.lit(False), tags, F.lit("s"), _said("d", F.col("doc_id")), service).alias("focus"))


# --- texts -------------------------------------------------------------------------------------------------------
@query("""SELECT doc_id, 'Head ' || doc_id || E'\nbold and link and code.' || E'\n' AS plain, '..' || '_' || doc_id || '_é.txt' AS ignored FROM documents""".replace(", '..' || '_' || doc_id || '_é.txt' AS ignored", ""))
def markdown_stripped(spark, sf_dir):
    text = _said("## Head ", F.col("doc_id"), "\n**bold** and [link](http://x.org/y) and `code`.\n```\nblock\n```")
    return documents(spark, sf_dir).select("doc_id", readers.strip_markdown(text).alias("plain"))


@query("""SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN 'café ' ELSE 'cafÿ ' END || doc_id AS text, 'a_b_' || doc_id || '.txt' AS name, doc_id % 2 = 0 AS tabular, 'x y ' || doc_id AS one_line, 'xz' AS no_nul,
  CAST(CASE WHEN doc_id % 3 = 0 THEN doc_id ELSE 0 END AS INT) AS number, [CAST(doc_id AS VARCHAR), 'B', 'c', '... 1 more'] AS shown FROM documents""")
def upload_values(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    content = F.when(F.col("doc_id") % 2 == 0, F.encode(F.concat(F.lit("café "), i), "UTF-8")).otherwise(F.concat(F.unhex(F.lit("636166FF20")), F.encode(i, "UTF-8")))
    page = F.when(F.col("doc_id") % 2 == 0, "Table of hosts\na | b | c\n1 | 2 | 3").otherwise("No such thing here")
    values = F.array(i, F.lit(" B "), F.lit("b"), F.lit(""), F.lit("c"), F.lit("C"), F.lit("d"))
    number = net.safe_int(F.when(F.col("doc_id") % 3 == 0, i).otherwise(F.lit("12x")))
    return documents(spark, sf_dir).select("doc_id", readers.decode_text(content).alias("text"), readers.safe_name(F.concat(F.lit("/up/../a b_"), i, F.lit(".txt"))).alias("name"), readers.looks_tabular(page).alias("tabular"), T.normalise(F.concat(F.lit("  x\n\ty  "), i, F.lit(" "))).alias("one_line"), T.strip_nul(F.lit("x\u0000z")).alias("no_nul"), number.alias("number"), T.capped(T.unique(values), 3).alias("shown"))


@query("""SELECT doc_id, doc_id % 2 = 0 AS address, true AS domain, true AS rule, false AS shorter, true AS signature, doc_id % 2 = 0 AS untyped, '...' || repeat('w ', 9) || 'and saw host' || doc_id || '.badnet.org' || rtrim(left(', rule R-' || doc_id || ' of ET SCAN-x' || repeat(' w', 30), 26)) || '...' AS evidence FROM documents""")
def exact_mentions(spark, sf_dir):
    i = F.col("doc_id")
    d = documents(spark, sf_dir).select("doc_id", _said(F.repeat(F.lit("w "), 30), "and saw host", i, "[.]badnet[.]org, rule R-", i, " of ET SCAN-x", F.repeat(F.lit(" w"), 30), F.when(i % 2 == 0, ". Then 198[.]51[.]100[.]7").otherwise(".")).alias("text"))
    t = F.col("text")
    term = _said("host", i, ".badnet.org")
    shown = T.snippet(T.refang(F.substring_index(t, ". Then", 1)), term, 26)
    return d.select("doc_id", T.contains_term(t, F.lit("198.51.100.7"), "ips").alias("address"), T.contains_term(t, term, "domains").alias("domain"), T.contains_term(t, _said("r-", i), "rule_ids").alias("rule"), T.contains_term(t, _said("ost", i, ".badnet.org"), "domains").alias("shorter"), T.contains_term(t, F.lit("et scan"), "alert_signatures").alias("signature"), T.contains_term(t, F.lit("198.51.100.7"), "source_ips").alias("untyped"), shown.alias("evidence"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'empty' WHEN 1 THEN 'low' ELSE 'high' END AS quality, CAST(CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 200 END AS INT) AS words,
  CASE doc_id % 3 WHEN 0 THEN 'low_text_density,few_extracted_words' WHEN 1 THEN 'low_text_density,image_heavy_pdf_no_ocr,few_extracted_words' ELSE '' END AS warnings FROM documents""")
def planted_quality(spark, sf_dir):
    d = _planted(spark, sf_dir, " ", "[IMAGES DETECTED: 4]", "word " * 200)
    q = T.extraction_quality(F.col("text"), F.lit(2))
    return d.select("doc_id", q.alias("q")).select("doc_id", "q.quality", F.col("q.words").cast("int").alias("words"), F.array_join("q.warnings", ",").alias("warnings"))


# --- reports and claims ------------------------------------------------------------------------------------------
@query("""SELECT CAST(doc_id AS VARCHAR) AS report_id, 'HIGH' AS threat_level, CAST(doc_id % 90 AS INT) AS total_alerts, 'Summary ' || doc_id || '.' AS executive_summary, ['first ' || doc_id, 'second'] AS key_findings,
  '198.51.100.' || (doc_id % 250 + 1) AS ip, 'LOW' AS severity, ['T1003', 'T1059.001'] AS techniques, ['Block it'] AS recommendations, 0::INT AS errors, true AS kept_appendix, true AS same_again FROM documents""")
def planted_reports(spark, sf_dir):
    i = F.col("doc_id")
    text = _said("# Report\n**Threat Level:** HIGH | **Total Alerts:** ", i % 90, "\n\n---\n\n## Executive Summary\n\nSummary ", i, ".\n\n## Key Findings\n\n- first ", i, "\n- second\n\n## Top Priority Threats\n\n| IP Address | Type | Severity | Count |\n|---|---|---|---|\n| 198.51.100.", i % 250 + 1, " | External | LOW | 3 |\n\n## MITRE ATT&CK Mapping\n\n- **T1059.001** - a\n- **T1003** - b\n\n## Immediate Actions Required\n\n1. Block it\n\n---\n\n**Analysis Complete**\n\n## Visual Threat Analysis\nchart ", i, "\n")
    first = R.parse_reports(documents(spark, sf_dir).select(i.cast("string").alias("report_id"), text.alias("markdown")))
    compared = ("executive_summary", "key_findings", "threat_level", "mitre_techniques", "appendix")
    # the record stays beside its own markdown, so nothing is joined or parsed once more for it
    written = first.select("report_id", R.serialise().alias("markdown"), F.size(R.errors_of()).alias("errors"), F.struct("total_alerts", "threats", "recommendations", *compared).alias("first"))
    again = R.parse_reports(written, keep=("errors", "first"))
    same = F.lit(True)
    for c in compared:
        same = same & (F.col(f"first.{c}") == F.col(c))
    t = F.get("first.threats", F.lit(0))
    kept = [F.col(f"first.{c}").alias(c) for c in ("threat_level", "total_alerts", "executive_summary", "key_findings")]
    return again.select("report_id", *kept, t["ip"].alias("ip"), t["severity"].alias("severity"), F.col("first.mitre_techniques").alias("techniques"), F.col("first.recommendations").alias("recommendations"), "errors", F.contains("first.appendix", F.concat(F.lit("chart "), "report_id")).alias("kept_appendix"), same.alias("same_again"))


@query("""SELECT doc_id, E'# Head\ntext ' || doc_id || E'\n\n---\n**Analysis Complete**\nReport generated: 2024-01-02 03:04:05\nThreat level: CRITICAL\nPriority actions: 5 identified' AS cleaned, '# Head ' || doc_id || E'\nbody' AS stripped FROM documents""")
def cleaned_reports(spark, sf_dir):
    i = F.col("doc_id")
    said = _said("# Head\n# Head\n   text ", i, "\n\nPlease let me know if you need more.")
    ended = _said("# Head ", i, "\nbody\n\n---\n\n## RAG Sources Used\n- x", i)
    return documents(spark, sf_dir).select("doc_id", R.clean_report(said, F.to_timestamp_ntz(F.lit("2024-01-02 03:04:05"))).alias("cleaned"), R.strip_appendix(ended).alias("stripped"))


@query("""SELECT doc_id, x.type AS type, x.value AS value, x.actions AS actions FROM (SELECT doc_id, unnest([{'type': 'ips', 'value': '198.51.100.' || (doc_id % 250 + 1), 'actions': 'block'},
  {'type': 'domains', 'value': 'host' || doc_id || '.badnet.org', 'actions': 'block,isolate'}]) AS x FROM documents WHERE doc_id % 2 = 0)""")
def remediation_targets(spark, sf_dir):
    d = _planted(spark, sf_dir, "Isolate host{i}.badnet.org and block {a} now. Watch mail.", "We saw host{i}.badnet.org and {a}. Block nothing.")
    return d.select("doc_id", F.inline(U.remediation_targets(F.col("text")))).withColumn("actions", F.array_join("actions", ","))


@query("""SELECT CAST(doc_id AS VARCHAR) AS report_id, unnest(CASE doc_id % 5 WHEN 0 THEN ['attribution=APT29', 'actors=APT29', 'weak_containment=', 'unobserved_targets=198.51.100.' || (doc_id % 250 + 1) || ' (block)']
  WHEN 1 THEN ['unknown_techniques=T9999', 'deprecated_techniques=T1059.001', 'unsupported_techniques=T9999'] WHEN 3 THEN ['non_actionable_targets=198.51.100.' || (doc_id % 250 + 1) || '=benign'] ELSE [] END) AS finding FROM documents""")
def audited_claims(spark, sf_dir):
    d = _planted(spark, sf_dir, "APT29 ran this. Block {a} now.", "T1059.001 was seen with T9999.", "The host was slow.", "Block {a} now.", " ").withColumn("report_id", F.col("doc_id").cast("string"))
    none, i = F.expr("cast(array() as array<string>)"), F.col("doc_id")
    address = _said("198.51.100.", i % 250 + 1)
    lists = {k: none for k in ("domains", "urls", "hashes", "actors", "tags")}
    current = d.select("report_id", F.when(i % 5 == 3, F.array(address)).otherwise(none).alias("ips"), F.array(F.lit("T1059.001")).alias("techniques"), *[v.alias(k) for k, v in lists.items()])
    roles = F.array(F.struct(F.lit("ips").alias("type"), address.alias("value"), F.lit("benign").alias("disposition")))
    evidence = d.filter(i % 5 == 3).select("report_id", F.lit("high").alias("evidence_strength"), none.alias("labels"), none.alias("tags"), F.lit(1).alias("overlap_count"), none.alias("actors"), none.alias("techniques"), none.alias("historical"), roles.alias("dispositions"), F.lit(False).alias("behavior_mismatch"))
    catalogue = spark.createDataFrame([("T1059.001", True), ("T1003", False)], "id string, deprecated boolean")
    found = U.claim_findings(d.select("report_id", F.col("text").alias("markdown")), evidence, current, catalogue)
    return found.select("report_id", F.explode("findings").alias("f")).select("report_id", F.concat("f.kind", F.lit("="), F.array_join("f.values", ",")).alias("finding"))


@query("""SELECT 'source' AS what, CASE WHEN doc_id % 4 = 0 THEN 'archive' ELSE 'custom_document' END AS label, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'strength', CASE WHEN doc_id % 3 = 0 THEN 'high' ELSE 'low' END, count(*) FROM documents GROUP BY 2
  UNION ALL SELECT 'reliability', CASE WHEN doc_id % 4 = 0 THEN 'local_security_telemetry' WHEN doc_id % 7 = 0 THEN 'analyst_approved_historical_report' ELSE 'uploaded_cti_document' END, count(*) FROM documents GROUP BY 2
  UNION ALL SELECT 'match_type', t, count(*) FROM (SELECT unnest(CASE WHEN doc_id % 2 = 0 THEN ['exact', 'lexical'] ELSE ['semantic'] END) AS t FROM documents) GROUP BY 2
  UNION ALL SELECT 'cautions', 'any', count(*) FROM documents WHERE NOT (doc_id % 4 = 0 AND doc_id % 2 = 0 AND doc_id % 3 = 0)""")
def retrieval_summary(spark, sf_dir):
    i = F.col("doc_id")
    types = F.when(i % 2 == 0, F.array(F.lit("exact"), F.lit("lexical"))).otherwise(F.array(F.lit("semantic")))
    d = documents(spark, sf_dir).select("doc_id", F.when(i % 4 == 0, "archive").otherwise("custom_document").alias("source"), types.alias("match_types"), F.when(i % 3 == 0, "high").otherwise("low").alias("evidence_strength"))
    none, no = F.expr("cast(array() as array<string>)"), F.lit(False)
    d = d.withColumn("source_reliability", S.reliability(F.col("source"), (i % 7 == 0) & (i % 4 != 0)))
    d = d.withColumn("retrieval_cautions", S.cautions(F.col("source"), F.col("match_types"), F.lit(1), none, no, no, F.lit("high"), none, F.col("evidence_strength")))
    return U.retrieval_summary(d)


@query("SELECT doc_id, CAST((doc_id % 2 = 0)::INT + (doc_id % 3 = 0)::INT + (doc_id % 5 = 0)::INT AS INT) AS hits FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0 OR doc_id % 5 = 0 ORDER BY hits DESC, doc_id LIMIT 4")
def fallback_search(spark, sf_dir):
    i = F.col("doc_id")
    text = F.concat_ws(" ", F.when(i % 2 == 0, "Alpha"), F.when(i % 3 == 0, "beta"), F.when(i % 5 == 0, "GAMMA"), F.lit("rest"))
    return S.keyword_fallback(documents(spark, sf_dir).select(i.alias("id"), text.alias("content")), "gamma alpha BETA alpha").select(F.col("id").alias("doc_id"), "hits")


# --- stores ------------------------------------------------------------------------------------------------------
@query("SELECT count(DISTINCT text) AS n_rows, count(DISTINCT text) AS n_keys, count(DISTINCT CASE WHEN hash_of % 2 = 0 THEN text END) AS embedded, 0::BIGINT AS added_again FROM (SELECT text, length(text) AS hash_of FROM documents)")
def ingested_store(spark, sf_dir):
    """Half of the rows, then all, then all again: each content is stored once; vectors are filled in afterwards."""
    import uuid

    path = shared_folder(spark, f"store_{uuid.uuid4().hex[:12]}")
    C.create_store(spark, path, "alert_hash string, content string, vector array<float>")
    rows = documents(spark, sf_dir).filter("text is not null").select("doc_id", C.content_hash(F.col("text")).alias("alert_hash"), F.col("text").alias("content"), F.lit(None).cast("array<float>").alias("vector"))
    C.append_new(rows.filter("doc_id % 2 = 0").drop("doc_id"), path, "alert_hash")
    C.append_new(rows.drop("doc_id"), path, "alert_hash")
    store = spark.read.parquet(path)
    added = C.new_rows(rows.drop("doc_id"), store, "alert_hash").agg(F.count("*").alias("added_again"))
    vectors = C.pending(store).filter("length(content) % 2 = 0").select("alert_hash", F.array(F.lit(1.0).cast("float")).alias("vector"))
    filled = C.back_fill(store, vectors, "alert_hash")
    return filled.agg(F.count("*").alias("n_rows"), F.count_distinct("alert_hash").alias("n_keys"), F.count("vector").alias("embedded")).join(added)  # one row each


@query("SELECT doc_id, doc_id % 3 <> 0 AS object FROM documents WHERE doc_id % 3 <> 0")
def ndjson_scan(spark, sf_dir):
    """Lines written and read back: blank and broken ones are left out, the source file is known."""
    import uuid

    path = shared_folder(spark, f"lines_{uuid.uuid4().hex[:12]}")
    i = F.col("doc_id")
    line = F.when(i % 3 == 0, F.when(i % 2 == 0, "").otherwise("{broken")).otherwise(_said('  {"n":', i, "}"))
    documents(spark, sf_dir).select(line.alias("value")).write.text(path)
    rows = readers.read_ndjson(spark, path)
    return rows.select(F.get_json_object("json", "$.n").cast("long").alias("doc_id"), F.contains("archive_source", F.lit("lines_")).alias("object"))


# --- addresses and lines -----------------------------------------------------------------------------------------
@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'owned' WHEN 1 THEN 'internal' WHEN 2 THEN 'external' ELSE 'infrastructure' END AS context FROM documents""")
def ipv6_context(spark, sf_dir):
    i = F.col("doc_id")
    low = F.lower(F.hex(i % 65536))
    ip = F.when(i % 4 == 0, F.concat(F.lit("2001:DB8::"), low)).when(i % 4 == 1, F.concat(F.lit("fd00:0:0:1::192.0.2."), (i % 250).cast("string"))).when(i % 4 == 2, F.concat(F.lit("2001:db9:0:0:0:0:0:"), low)).otherwise("::1")
    assets = net.Assets(infrastructure=("::1", "203.0.113.0/24"), owned=("2001:db8::/32", "192.0.2.0/24"), internal=("fd00::/8", "10.0.0.0/8"))
    return documents(spark, sf_dir).select("doc_id", net.ip_context(ip, assets).alias("context"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'City ' || (doc_id % 40 // 2) END AS city, CASE WHEN doc_id % 3 = 0 THEN 'C' || (doc_id % 40 % 7) END AS country_code, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 40 // 2 AS DOUBLE) END AS latitude FROM documents""")
def located_addresses(spark, sf_dir):
    """Half-open city ranges of 32,768 addresses; private addresses and those without a range have no place."""
    i = F.col("doc_id")
    k = F.col("id")
    lo = F.lit(45 << 24) + k * 32768
    fields = {"country": F.lit("Land"), "country_code": _said("C", k % 7), "city": _said("City ", F.floor(k / 2)), "region": F.lit("R"), "region_code": F.lit("r"), "latitude": F.floor(k / 2).cast("double"), "longitude": F.lit(1.5), "timezone": F.lit("UTC"), "postal_code": F.lit("0"), "accuracy_radius": F.lit(5)}
    ranges = spark.range(40).select(lo.alias("lo"), (lo + 32767).alias("hi"), *[v.alias(c) for c, v in fields.items()])
    ranges = ranges.unionByName(ranges.withColumns({"lo": F.lit(10 << 24).cast("long"), "hi": F.lit((11 << 24) - 1).cast("long")}).limit(1))
    number = i % 40 * 32768 + i % 32768
    quad = F.concat_ws(".", F.lit("45"), F.shiftright(number, 16).cast("string"), (F.shiftright(number, 8) % 256).cast("string"), (number % 256).cast("string"))
    d = documents(spark, sf_dir).select("doc_id", F.when(i % 3 == 0, quad).when(i % 3 == 1, "10.0.0.1").otherwise("46.0.0.1").alias("ip"))
    found = N.geo_lookup(d, ranges, "ip", "place", N.GEO_FIELDS, public_only=True)
    return found.select("doc_id", "place.city", "place.country_code", "place.latitude")


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Extracted CTI Artefacts | IPs: 198.51.100.' || (doc_id % 250 + 1) || ' | CVEs: CVE-2024-1111, CVE-2024-2222' ELSE '' END AS found,
  CASE WHEN doc_id % 2 = 0 THEN 'CTI Context Labels | b, A' ELSE '' END AS labels, 'CTI Behavior Tags | t' AS tags, 'CTI Artifact Disposition | malicious: ips:1, urls:u' || doc_id || ' | unknown: domains:d' AS roles FROM documents""")
def context_lines(spark, sf_dir):
    i = F.col("doc_id")
    d = _planted(spark, sf_dir, "Seen {a} with CVE-2024-1111 and cve-2024-2222 here", "nothing")
    labels = F.when(i % 2 == 0, F.array(F.lit("b"), F.lit("A"), F.lit("B"))).otherwise(F.expr("cast(array() as array<string>)"))
    role = lambda kind, value, as_: F.struct(F.lit(kind).alias("type"), value.alias("value"), F.lit(as_).alias("disposition"))
    roles = F.array(role("domains", F.lit("d"), "unknown"), role("ips", F.lit("1"), "malicious"), role("urls", _said("u", i), "malicious"))
    return d.select("doc_id", T.artifacts_line(T.artifacts(F.col("text"))).alias("found"), T.labels_line(labels).alias("labels"), T.tags_line(F.array(F.lit("t"))).alias("tags"), T.dispositions_line(roles).alias("roles"))


@query("SELECT count(*) AS reports_approved, max(ts) AS last_approval_time FROM events WHERE event_type = 'purchase'")
def approvals(spark, sf_dir):
    return N.approvals(spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type = 'purchase'").select(F.col("ts").alias("approved_at")))


# --- retrieval ---------------------------------------------------------------------------------------------------
@query("""SELECT 'f' || doc_id || '.md' AS filename, sha256(sha256('# Head ' || doc_id || E'\n\nBlock the malicious ip of host' || doc_id || '.badnet.org here.') || ':0:' || '# Head ' || doc_id || E'\n\nBlock the malicious ip of host' || doc_id || '.badnet.org here.') AS doc_hash,
  'Document: f' || doc_id || E'.md\nSection: Head ' || doc_id || E'\nCTI Context Labels | ioc_listing, remediation\n# Head ' || doc_id || E'\n\nBlock the malicious ip of host' || doc_id || '.badnet.org here.' AS content, 0::INT AS chunk_index,
  'host' || doc_id || '.badnet.org' AS domain, 'malicious' AS role FROM documents""")
def planted_chunks(spark, sf_dir):
    i = F.col("doc_id")
    d = documents(spark, sf_dir).select(_said("f", i, ".md").alias("filename"), _said("# Head ", i, "\n\nBlock the malicious ip of host", i, ".badnet.org here.").alias("text"))
    rows = C.chunk_rows(d)
    return rows.select("filename", "doc_hash", "content", "chunk_index", F.get_json_object("metadata", "$.artifacts.domains[0]").alias("domain"), F.get_json_object("metadata", "$.dispositions[0].disposition").alias("role"))


@query("""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 500 = 2 THEN 2 WHEN doc_id % 500 = 3 THEN 3 WHEN doc_id % 500 = 4 THEN 4 WHEN doc_id % 25 = 1 THEN 1 END AS kind FROM documents),
  f AS (SELECT * FROM (SELECT doc_id, 'exact' AS t, 1.15 AS s, row_number() OVER (ORDER BY doc_id) AS n FROM c WHERE kind IN (2, 4)
  UNION ALL SELECT doc_id, 'semantic', 1 / sqrt(1.25), row_number() OVER (ORDER BY doc_id) FROM c WHERE kind = 3
  UNION ALL SELECT doc_id, 'lexical', 0.3 + 0.2 / (1 + log2(CASE kind WHEN 1 THEN 3 ELSE 6 END)), row_number() OVER (ORDER BY kind, doc_id) FROM c WHERE kind IN (1, 4)) WHERE n <= 40)
  SELECT 0::BIGINT AS query_id, row_number() OVER (ORDER BY s DESC, id) AS rank, id, round(s, 6) AS score, match_types FROM (SELECT doc_id AS id, max(s) AS s, list_sort(list(t)) AS match_types FROM f GROUP BY doc_id) ORDER BY rank LIMIT 10""")
def planted_hybrid(spark, sf_dir):
    i = F.col("doc_id")
    text = F.when(i % 500 == 2, "saw 198[.]51[.]100[.]7 there").when(i % 500 == 4, "alpha beta 198.51.100.7").when((i % 25 == 1) & (i % 500 != 3), "word Beta ALPHA").otherwise("rest")
    vector = F.when(i % 500 == 3, F.array(F.lit(1.0), F.lit(0.5))).cast("array<float>")
    corpus = documents(spark, sf_dir).select(F.lit("custom_document").alias("source"), i.alias("id"), text.alias("content"), F.lit(None).cast("timestamp").alias("ts"), F.lit(0).alias("severity"), vector.alias("vector"))
    asked = spark.createDataFrame([(0, "alpha beta", [1.0, 0.0], [("ips", "198.51.100.7")])], "query_id long, query string, vector array<float>, terms array<struct<type:string,term:string>>")
    found = S.hybrid_search([corpus], asked, 10)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 6).alias("score"), "match_types")


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS evidence_strength, CASE WHEN doc_id % 4 < 2 THEN ['198.51.100.7'] ELSE [] END AS overlap, CASE WHEN doc_id % 4 = 3 THEN ['198.51.100.9'] ELSE [] END AS historical_only,
  doc_id % 4 IN (0, 2) AS behavior_mismatch, CASE doc_id % 4 WHEN 0 THEN 'uploaded_cti_document' ELSE 'local_security_telemetry' END AS source_reliability, doc_id % 4 = 1 AS not_attacker FROM documents""")
def planted_annotation(spark, sf_dir):
    i = F.col("doc_id")
    none = "cast(array() as array<string>)"
    d = _planted(spark, sf_dir, "The C2 server 198.51.100.7 is malicious", "The victim 198.51.100.7 was reached", "Lateral movement over smb and rdp", "Nothing on 198.51.100.9 of note").withColumnRenamed("text", "content")
    types = F.when(i % 4 == 1, F.array(F.lit("exact"))).otherwise(F.array(F.lit("semantic")))
    d = d.withColumns({"source": F.when(i % 4 == 0, "custom_document").otherwise("archive"), "score": F.lit(0.5), "match_types": types, "match_evidence": F.expr(none), "severity": F.lit(0), "human_validated": F.lit(False)})
    current = spark.range(1).select(F.array(F.lit("198.51.100.7")).alias("ips"), *[F.expr(none).alias(k) for k in ("domains", "urls", "hashes", "mitre_techniques")])
    out = G.annotate(d, current, ["web_or_exploit_attempt"])
    noted = F.array_contains("retrieval_cautions", "current overlap is marked benign, victim, or analysis-environment, not attacker infrastructure")
    return out.select("doc_id", "evidence_strength", "overlap", "historical_only", "behavior_mismatch", "source_reliability", noted.alias("not_attacker"))


# --- levels, quality and prompts of whole texts; ranking by what the stores hold --------------------------------------
@query("SELECT CAST(doc_id AS VARCHAR) AS report_id, CASE doc_id % 6 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'LOW' WHEN 2 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 4 THEN 'MEDIUM' ELSE 'LOW' END AS threat_level FROM documents")
def planted_levels(spark, sf_dir):
    """Two stated levels in different forms after each whole text: the highest of the forms' first ones."""
    i = F.col("doc_id")
    stated = F.element_at(F.array(*[F.lit(x) for x in ("Response Priority: LOW\nThreat Level: CRITICAL", "Threat Level: LOW\nThreat Level: HIGH", "**Threat Level:** MEDIUM\nResponse Priority: IMMEDIATE", "Threat level: HIGH\n**Threat Level:** LOW", "no level", "Response Priority: LOW")]), (i % 6 + 1).cast("int"))
    text = F.concat(F.lit("line\n" * 12), F.coalesce("text", F.lit("")), F.lit("\n"), stated)
    return R.parse_reports(documents(spark, sf_dir).select(i.cast("string").alias("report_id"), text.alias("markdown"))).select("report_id", "threat_level")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN 'high' ELSE 'empty' END AS quality FROM documents")
def blank_quality(spark, sf_dir):
    blank = F.element_at(F.array(F.lit(None).cast("string"), F.lit(" \n\t"), F.lit("\r\n\r\n"), F.lit("word")), (F.col("doc_id") % 4 + 1).cast("int"))
    return documents(spark, sf_dir).select("doc_id", T.extraction_quality(blank, F.lit(0))["quality"].alias("quality"))


@query("""WITH p AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), b AS (SELECT chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) AS blank)
  SELECT doc_id, sha256(CASE WHEN greatest(1, length(t) // 3) <= 1535 THEN t ELSE rtrim(t[1:3315], blank) || chr(10) || chr(10) || '[Prompt shortened: about ' || greatest(0, length(t) - 4115)
  || ' characters are left out.]' || chr(10) || chr(10) || ltrim(right(t, 800), blank) END) AS prompt_sha256 FROM p, b""")
def fitted_prompts(spark, sf_dir):
    """Every whole text as a prompt for a context of 2,048 tokens."""
    return documents(spark, sf_dir).select("doc_id", F.sha2(R.fit_prompt(F.coalesce("text", F.lit("")), 2048), 256).alias("prompt_sha256"))


@query("""SELECT doc_id AS id, round(1.0 + CASE doc_id // 100 % 3 WHEN 0 THEN 0 WHEN 1 THEN 0.25 ELSE 0.5 END, 3)::DOUBLE AS rank_score, CASE WHEN doc_id // 100 % 2 = 0 THEN 'analyst_approved_historical_report'
  ELSE 'local_security_telemetry' END AS source_reliability FROM (SELECT doc_id FROM documents WHERE doc_id % 100 = 1 ORDER BY doc_id LIMIT 10) ORDER BY CASE doc_id // 100 % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END DESC, doc_id LIMIT 5""")
def ranked_context(spark, sf_dir):
    """Rows alike in text, of which stored severity and validation decide rank and reliability."""
    i, none = F.col("doc_id"), F.lit(None).cast("string")
    age = F.floor(i / 100)
    d = documents(spark, sf_dir).select(F.lit("archive").alias("source"), i.alias("id"), F.when(i % 100 == 1, "alpha beta").otherwise("rest").alias("content"), F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("array<float>").alias("vector"), F.when(age % 3 == 0, 0).when(age % 3 == 1, 8).otherwise(12).alias("severity"), (age % 2 == 0).alias("human_validated"))
    a = alerts(spark, sf_dir).withColumns({"rule_description": F.lit("alpha beta"), "rule_id": F.lit(7), "src_ip": none, "dest_ip": none, "proto": none})
    out = G.context([d], a, lambda q: q.withColumn("vector", F.lit(None).cast("array<float>")), 5)
    return out.select("id", F.col("context_rank_score").alias("rank_score"), "source_reliability")


@query("""WITH a AS (SELECT doc_id AS id, 'archive' AS source, CASE doc_id // 100 % 3 WHEN 0 THEN 0 WHEN 1 THEN 8 ELSE 12 END AS severity FROM documents WHERE doc_id % 200 = 1),
  f AS (SELECT id, source, 1.0 + CASE severity WHEN 8 THEN 0.25 ELSE 0.5 END AS score FROM (SELECT * FROM a WHERE severity >= 8 ORDER BY id LIMIT 8)),
  d AS (SELECT doc_id AS id, 'custom_document' AS source, 1.09 AS score FROM documents WHERE doc_id % 100 = 2 ORDER BY doc_id LIMIT 8)
  SELECT id, source, score::DOUBLE AS rank_score FROM (SELECT * FROM f UNION ALL SELECT * FROM d) ORDER BY score DESC, id LIMIT 4""")
def urgent_ranked(spark, sf_dir):
    """Two corpora alike in text, retrieved apart and ranked together: the archive's severe rows, then documents."""
    i, none = F.col("doc_id"), F.lit(None).cast("string")
    age = F.floor(i / 100)

    def corpus(source: str, chosen: Column, severity: Column):
        return documents(spark, sf_dir).select(F.lit(source).alias("source"), i.alias("id"), F.when(chosen, "alpha beta").otherwise("rest").alias("content"), F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("array<float>").alias("vector"), severity.alias("severity"))

    archive = corpus("archive", i % 200 == 1, F.when(age % 3 == 0, 0).when(age % 3 == 1, 8).otherwise(12))
    a = alerts(spark, sf_dir).withColumns({"rule_description": F.lit("alpha beta"), "rule_id": F.lit(7), "src_ip": none, "dest_ip": none, "proto": none})
    out = G.urgent_context(corpus("custom_document", i % 100 == 2, F.lit(0)), archive, a, lambda q: q.withColumn("vector", F.lit(None).cast("array<float>")))
    return out.select("id", "source", F.col("context_rank_score").alias("rank_score"))
