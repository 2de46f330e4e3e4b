import json

from pyspark.sql import functions as F

from alertloom.functions import net
from alertloom.operators import alerts as A
from alertloom.operators import audit, corpus, reports, rules
from alertloom.operators import search as S
from alertloom.sources import readers

ASSETS = net.Assets(infrastructure=("203.0.113.0/24",), owned=("192.0.2.0/24",), internal=("10.0.0.0/8", "bad block"))


def test_contexts(one):
    ips = ["203.0.113.9", "192.0.2.1", "10.2.3.4", "8.8.8.8", "", None, "not an ip", "::1"]
    got = one(*[net.ip_context(F.lit(i).cast("string"), ASSETS) for i in ips])
    assert got == ("infrastructure", "owned", "internal", "external", "unknown", "unknown", "external", "external")


def test_levels(one):
    assert one(*[net.safe_int(F.lit(v).cast("string")) for v in ("7", None, "x", "7.5")]) == (7, 0, 0, 0)
    assert one(*[net.severity(F.lit(v)) for v in (12, 8, 5, 4)]) == ("Critical", "High", "Medium", "Low")


RAW = [
    {"_source": {"timestamp": "2024-05-01T10:00:00+0000", "rule": {"id": "100010", "level": "13", "description": "beacon", "mitre": {"id": ["T1071"]}}, "agent": {"name": "a"}, "data": {"src_ip": "10.0.0.5", "dest_ip": "8.8.8.8", "dest_port": 443, "dns": {"query": [{"rrname": "c2.example", "rrtype": "A"}]}, "tls": {"issuerdn": "CN=x"}, "fileinfo": {"md5": "d" * 32}}}},
    {"rule": {"level": None, "description": "flat"}, "srcip": "8.8.8.8", "dstip": "192.0.2.7", "alert_signature": "sig"},
    {"rule": {"description": ""}, "data": {}},
]


def test_clean(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text("\n".join(map(json.dumps, RAW)) + "\n\nnot json\n[1]\n" + json.dumps({"alerts": [RAW[0], 5]}) + "\n")
    rows = readers.expand_envelopes(readers.read_ndjson(spark, str(p)))
    got = A.clean(rows, ASSETS).orderBy("rule_description", "rule_level").collect()
    assert [r.rule_description for r in got] == ["beacon", "beacon", "flat"]
    b, f = got[0], got[2]
    assert (b.rule_level, b.dns_context.query, b.tls_context.issuer, b.file_context.md5, b.mitre_context.id) == (13, "c2.example", "CN=x", "d" * 32, "T1071")
    assert b.http_context is None and b.threat_classification.threat_direction == "outbound" and b.threat_classification.confidence == "high"
    assert (f.rule_level, f.src_ip, f.threat_classification.threat_direction) == (0, "8.8.8.8", "inbound")


def test_templates(spark, tmp_path):
    p = tmp_path / "t.json"
    for text, n in ((json.dumps(RAW[0]), 1), (json.dumps(RAW), 3), (json.dumps({"alerts": RAW}, indent=1), 3), ("﻿" + json.dumps(RAW[1]) + "\n" + json.dumps(RAW[2]), 2)):
        p.write_text(text)
        assert readers.read_template(spark, str(p)).count() == n


def test_archive_days():
    from datetime import date

    assert readers.archive_days("/b", 2, date(2024, 3, 1)) == ["/b/2024/Feb/ossec-archive-29.json", "/b/2024/Feb/ossec-archive-28.json"]


def test_archives_prefer_plain_files(spark, tmp_path):
    import gzip
    from datetime import date

    day = tmp_path / "2024" / "Feb"
    day.mkdir(parents=True)
    (day / "ossec-archive-29.json").write_text('{"a": 1}\n')
    with gzip.open(day / "ossec-archive-28.json.gz", "wt") as f:
        f.write('{"a": 2}\nbad\n')
    rows = readers.read_archives(spark, str(tmp_path), 3, date(2024, 3, 1))
    assert sorted(r.json for r in rows.collect()) == ['{"a": 1}', '{"a": 2}']
    assert readers.read_archives(spark, str(tmp_path / "none"), 2).count() == 0


def test_uploads(spark, tmp_path):
    for name, data in {"a.txt": "café".encode("latin-1"), "b.exe": b"MZ", "d.txt": b"MZ\x90\x00"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r["name"]: r.error for r in readers.read_uploads(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": None, "b.exe": "unsupported type", "d.txt": "refused content"}
    text = readers.read_uploads(spark, str(tmp_path)).filter("error is null").select(readers.decode_text(F.col("content")).alias("t")).first().t
    assert text == "café"


def test_tags_and_focus(one):
    tags = A.behavior_tags(F.lit("ET MALWARE c2 beacon over dns"), F.lit("443"), F.lit(None).cast("string"), F.lit("outbound"))
    assert one(tags)[0] == ["possible_c2", "malware_or_destructive_activity", "web_or_exploit_attempt", "malware_execution_candidate", "domain_or_tls_indicator", "compromised_asset_egress"]
    lateral = A.behavior_tags(F.lit("smb copy"), F.lit("445"), F.lit(None).cast("string"), F.lit("lateral"))
    assert one(lateral)[0] == ["lateral_movement_candidate", "internal_lateral_activity", "smb_service_activity"]
    focus = A.response_focus(F.lit("lateral"), F.lit(False), lateral, F.lit("10.0.0.1"), F.lit("10.0.0.2"), F.lit("tcp/445"))
    assert one(focus)[0] == ["Investigate internal path 10.0.0.1 -> 10.0.0.2 for lateral movement.", "Audit SMB/admin-share access, credentials, and endpoint process activity."]
    assert len(one(A.response_focus(F.lit("inbound"), F.lit(True), lateral, F.lit("a"), F.lit("b"), F.lit("s")))[0]) == 1


def test_rules(one):
    r = lambda s, sig, i=None: one(rules.classify(F.lit(s).cast("int"), F.lit(sig), F.lit(i).cast("long")))[0]
    assert r(1, "ET TROJAN x Beacon").rule_id == 100010
    assert r(None, "other", 2016568).level == 14
    assert r(2, "ET WEB_SERVER SQL").rule_id == 100020
    assert r(None, "nothing").rule_id == 100002


def test_correlation_window(spark):
    rows = [(i, f"2024-01-01 00:0{m}:00", "10.0.0.1", 100010) for i, m in enumerate((0, 2, 4, 9))] + [(9, "2024-01-01 00:01:00", None, 100010)]
    df = spark.createDataFrame(rows, "event_id int, t string, src_ip string, rule_id int").withColumn("ts", F.col("t").cast("timestamp"))
    got = rules.correlate(df).filter("correlation_id = 100060").collect()
    assert [(r.event_id, r.hits) for r in got] == [(2, 3)]


def test_evidence(one):
    a = lambda *x: F.array(*[F.lit(v) for v in x]) if x else F.expr("cast(array() as array<string>)")
    st = lambda types, n, mal=False, na=False: S.evidence_strength(a(*types), F.lit(n), F.lit(mal), F.lit(na))
    assert one(st(["exact"], 1), st(["exact"], 1, na=True), st(["semantic"], 1, mal=True), st(["lexical"], 1), st(["semantic"], 1), st(["semantic"], 2)) == ("high", "medium", "high", "medium", "low", "medium")
    notes = one(S.cautions(F.lit("custom_document"), a("semantic"), F.lit(0), a("analysis_environment"), F.lit(False), F.lit(True), F.lit("low"), a("few_extracted_words"), F.lit("low")))[0]
    assert len(notes) == 6 and notes[-1] == "source document extraction quality is low (few_extracted_words)"
    assert one(S.overlap(a("8.8.8.8", "Evil.example"), a("evil[.]example", "1.1.1.1")))[0] == ["evil[.]example"]


def test_aligned_behaviour_outranks_similarity(one):
    rank = lambda sim, over, dis: S.context_rank(F.array(F.lit("semantic")), F.lit(0), F.lit(sim), F.lit(1), F.lit(0), F.lit("custom_document"), F.lit(over), F.lit(dis))
    good, bad = one(rank(0.4, 2, False), rank(0.9, 0, True))
    assert good > bad


def test_weak_evidence_is_capped(spark):
    rows = [(1, "high", 3.0), (2, "low", 2.0), (3, "low", 1.0), (4, "medium", 0.5)]
    df = spark.createDataFrame(rows, "id int, evidence_strength string, score double")
    assert sorted(r.id for r in S.quality_cap(df, 4, [F.desc("score")]).collect()) == [1, 2, 4]
    weak = df.filter("evidence_strength = 'low'")
    assert sorted(r.id for r in S.quality_cap(weak, 4, [F.desc("score")]).collect()) == [2, 3]


def test_merge_does_not_depend_on_order(spark):
    rows = [(1, "a", 5, "x", 0.5, 0.5, None, ["semantic"], ["s"]), (1, "a", 5, "x", 1.25, None, None, ["exact"], ["e"]), (1, "a", 6, "y", 0.4, None, 0.1, ["lexical"], ["l"])]
    schema = "query_id int, source string, id int, content string, score double, semantic_score double, lexical_score double, match_types array<string>, match_evidence array<string>"
    for r in (rows, rows[::-1]):
        got = S.merge(spark.createDataFrame(r, schema)).orderBy("id").collect()
        assert [(g.id, g.score, g.match_types, sorted(g.match_evidence)) for g in got] == [(5, 1.25, ["exact", "semantic"], ["e", "s"]), (6, 0.4, ["lexical"], ["l"])]


def test_hybrid_search_finds_defanged_terms(spark):
    docs = spark.createDataFrame([("custom_document", 1, "c2 at evil[.]example today", None, 0, [1.0, 0.0]), ("custom_document", 2, "unrelated prose", None, 0, [0.0, 1.0])], "source string, id long, content string, ts timestamp, severity int, vector array<float>")
    q = spark.createDataFrame([(1, "unrelated prose", [1.0, 0.1], [("domains", "EVIL.example")])], "query_id long, query string, vector array<float>, terms array<struct<type:string,term:string>>")
    got = {r.id: r.match_types for r in S.hybrid_search([docs], q, 5).collect()}
    assert got == {1: ["exact", "semantic"], 2: ["lexical"]}


REPORT = "# CRITICAL report\n\n**Threat Level:** HIGH\n\n## 1. Executive Summary\nAPT99 used T1071 and T9999.\n\n## Key Findings\n- first\n- second\n\n## Top Threats\n| IP Address | Activity | Severity |\n|---|---|---|\n| 8.8.8.8 | beacon | Low |\n\n## MITRE ATT&CK Mapping\n- **T1071** - Web\n- T1059.001 - Shell\n\n## Recommendations\n1. Block 8.8.8.8 now.\n2. Monitor\n\n**Analysis Complete**\n\n---\n\n## Report QA Findings\n- x\n"


def test_report_parse_and_back(spark):
    df = spark.createDataFrame([("r", REPORT), ("e", "")], "report_id string, markdown string")
    p = {r.report_id: r for r in reports.parse_reports(df).withColumn("errors", reports.errors_of()).withColumn("back", reports.serialise()).collect()}
    r = p["r"]
    assert r.executive_summary == "APT99 used T1071 and T9999." and r.key_findings == ["first", "second"] and r.recommendations == ["Block 8.8.8.8 now.", "Monitor"]
    assert r.threats[0].ip == "8.8.8.8" and r.threat_level == "CRITICAL" and r.mitre_techniques == ["T1059.001", "T1071"]
    assert r.appendix.startswith("---") and r.errors == [] and "## Report QA Findings" in r.back
    assert "Executive summary is required" in p["e"].errors
    again = reports.parse(r.back)
    assert again["key_findings"] == r.key_findings and again["recommendations"] == r.recommendations


def test_appendices_are_stripped(one):
    body = one(reports.strip_appendix(F.col("m")), m=REPORT)[0]
    assert body.endswith("**Analysis Complete**") and "QA" not in body
    assert one(reports.strip_appendix(F.col("m")), m="plain") == ("plain",)


def test_clean_report(one):
    got = one(reports.clean_report(F.col("m"), F.to_timestamp(F.lit("2024-01-01 00:00:00"))), m="# A\n# A\n   text\nWould you like me to focus on this?")[0]
    assert got.startswith("# A\ntext") and "Would you" not in got and got.count("**Analysis Complete**") == 1


EVIDENCE = "report_id string, evidence_strength string, labels array<string>, behavior_mismatch boolean, overlap_count int, actors array<string>, techniques array<string>, historical array<string>, dispositions array<struct<type:string,value:string,disposition:string>>"
CURRENT = "report_id string, ips array<string>, domains array<string>, urls array<string>, hashes array<string>, techniques array<string>, actors array<string>"


def findings(spark, markdown, evidence, current=((), (), (), (), (), ())):
    r = spark.createDataFrame([("r", markdown)], "report_id string, markdown string")
    e = spark.createDataFrame([("r", *x) for x in evidence], EVIDENCE)
    c = spark.createDataFrame([("r", *map(list, current))], CURRENT)
    cat = spark.createDataFrame([("T1071", False), ("T1064", True)], "id string, deprecated boolean")
    return {f.kind: f["values"] for f in audit.claim_findings(r, e, c, cat).first().findings}


def test_claims(spark):
    weak = [("low", ["ttp_behavior"], False, 0, ["APT1"], ["T1071"], ["9.9.9.9"], [])]
    f = findings(spark, "APT1 is attributed to this. T1071 T1064 T9999. Block 9.9.9.9 now.", weak)
    assert set(f) == {"attribution", "actors", "unknown_techniques", "deprecated_techniques", "unsupported_techniques", "leaked_artifacts", "weak_containment", "unobserved_targets"}
    assert f["actors"] == ["APT1"] and f["unknown_techniques"] == ["T9999"] and f["deprecated_techniques"] == ["T1064"] and f["unobserved_targets"] == ["9.9.9.9 (block)"]
    strong = [("high", ["attribution", "ttp_behavior"], False, 1, ["APT1"], ["T1071"], [], [("ips", "9.9.9.9", "benign")])]
    f = findings(spark, "APT1 and APT2. T1071. Block 9.9.9.9 now.", strong, (["9.9.9.9"], [], [], [], [], []))
    assert f == {"actors": ["APT2"], "non_actionable_targets": ["9.9.9.9=benign"]}
    assert findings(spark, "  ", weak) == {}


def test_ingest_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "store")
    corpus.create_store(spark, path, corpus.CHUNKS)
    docs = spark.createDataFrame([(1, "a.txt", "# Indicators\n\n8.8.8.8 is malicious. 10.0.0.1 is the victim."), (2, "b.txt", "")], "doc_id long, filename string, text string")
    rows = corpus.chunk_rows(docs)
    assert corpus.append_new(rows, path, "doc_hash").count() >= 0
    n = spark.read.parquet(path).count()
    corpus.append_new(rows, path, "doc_hash")
    store = spark.read.parquet(path)
    assert store.count() == n == 1
    meta = json.loads(store.first().metadata)
    assert {d["value"]: d["disposition"] for d in meta["dispositions"]} == {"8.8.8.8": "malicious", "10.0.0.1": "victim"}
    vec = corpus.embed(corpus.pending(store).select("doc_hash", "content"), lambda ts: [[float(len(t)), 1.0] for t in ts], 2)
    filled = corpus.back_fill(store, vec, "doc_hash")
    assert corpus.status(spark.createDataFrame([], corpus.ARCHIVE), filled).first().asDict() == {"archive_rows": 0, "archive_embedded": 0, "chunk_rows": 1, "chunk_embedded": 1, "documents": 1, "ready": True}


def test_settings(tmp_path):
    import pytest

    p = tmp_path / "c.json"
    p.write_text('{"chunk_size": 700}')
    s = readers.Settings.load(str(p), {"ALERTLOOM_CHUNK_SIZE": "800", "ALERTLOOM_SIMILARITY_THRESHOLD": "0.3"})
    assert (s.chunk_size, s.similarity_threshold, s.chunk_overlap) == (800, 0.3, 50)
    with pytest.raises(ValueError):
        readers.Settings(chunk_overlap=900)
