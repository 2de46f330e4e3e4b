from pyspark.sql import functions as F

from alertloom.functions import net
from alertloom.operators import alerts as A
from alertloom.operators import audit, corpus, reporting, reports
from alertloom.operators import search as S
from alertloom.sources import readers
from test_alerts import ASSETS, RAW


def cleaned(spark, n=3):
    import json

    rows = [(i, json.dumps(RAW[i % 2])) for i in range(n)]
    return A.clean(spark.createDataFrame(rows, "event_id int, json string"), ASSETS).withColumn("ts", F.col("timestamp").try_cast("timestamp"))


def test_observed_and_terms(spark):
    a = cleaned(spark)
    now = reporting.current_artifacts(a).first()
    assert now.domains == ["c2.example"] and set(now.ips) == {"10.0.0.5", "8.8.8.8", "192.0.2.7"} and now.hashes == ["d" * 32]
    terms = {(r.type, r.term) for r in reporting.exact_terms(a).collect()}
    assert ("domains", "c2.example") in terms and ("alert_signatures", "sig") in terms
    q = reporting.focused_queries(a).orderBy("query_id").collect()
    assert len(q) == 3 and "c2.example" in q[0].query and "c2.example" in q[1].query
    assert [r.query for r in reporting.focused_queries(a.limit(0)).collect()] == [reporting.DEFAULT_QUERY]


def test_texts(spark):
    a = cleaned(spark, 1)
    row = a.select(reporting.alert_text(a).alias("t"), reporting.compact(a).alias("c")).first()
    assert row.t.startswith("Rule: beacon | Rule ID: 100010 | Source: 10.0.0.5") and "Domains: c2.example" in row.t
    assert '"rule_level":13' in row.c and "alert_signature" not in row.c
    fp = a.select(A.fingerprint({"rule": F.col("rule_id"), "none": F.lit(None), "ips*": F.array("src_ip", "dest_ip")}).alias("f")).first().f
    assert fp == "rule=100010 | ips=10.0.0.5,8.8.8.8"


def test_modes_and_names(spark):
    a = cleaned(spark)
    assert reporting.report_mode(a, True) == "urgent" and reporting.report_mode(a, False) == "standard"
    assert A.adaptive_filter(a, True) == {"min_severity": 8} and A.adaptive_filter(a, False) == {"min_severity": 5} and A.adaptive_filter(a.limit(0), True) == {}
    assert reporting.report_name("automatic", "x", True, 2) == "AUTO_CRITICAL_BATCH2_x.md" and reporting.report_name("approved", "x") == "APPROVED_x.md"


DOCS = "source string, id long, content string, score double, match_types array<string>, match_evidence array<string>, severity int, human_validated boolean"


def test_annotation_flow(spark):
    docs = spark.createDataFrame([
        ("custom_document", 1, "The C2 beacon used c2[.]example today", 1.15, ["exact"], ["e"], 0, False),
        ("custom_document", 2, "legitimate resolver 8.8.8.8 is benign", 1.15, ["exact"], ["e"], 0, False),
        ("archive", 3, "nothing in common", 0.9, ["semantic"], ["s"], 0, True),
    ], DOCS)
    a = cleaned(spark).withColumns({"is_infrastructure_alert": F.lit(False), "is_internal_threat": F.lit(True), "is_external_threat": F.lit(False), "threat_direction": F.lit("outbound")})
    got = {r.id: r for r in reporting.annotate(docs, reporting.current_artifacts(a), ["possible_c2"]).collect()}
    assert got[1].evidence_strength == "high" and got[1].overlap == ["c2.example"] and got[1].behavior_overlap == ["possible_c2"]
    assert got[2].evidence_strength == "medium" and got[3].evidence_strength == "low"
    assert got[3].source_reliability == "analyst_approved_historical_report" and "no exact current-alert IoC overlap" in got[3].retrieval_cautions
    rows = reporting.annotate(docs, reporting.current_artifacts(a), ["possible_c2"])
    summary = {(r.what, r.label): r.n for r in audit.retrieval_summary(rows).collect()}
    assert summary[("source", "custom_document")] == 2 and summary[("strength", "high")] == 1 and summary[("match_type", "exact")] == 2
    text = reporting.write_report(a, rows, lambda p: p)
    assert "[RAG-1] Source: custom_document | Strength: high" in text and "'total': 3" in text
    assert reporting.write_report(a, rows, lambda p: 1 / 0).startswith("# Report generation failed")


def test_filters_and_fallback(spark):
    c = spark.createDataFrame([(1, "alpha beta", [1.0], 9), (2, "beta", None, 3), (3, "gamma", [1.0], 3)], "id long, content string, vector array<float>, severity int")
    assert [r.id for r in S.metadata_filter(c, 5, embedded=True).collect()] == [1]
    assert [(r.id, r.hits) for r in S.keyword_fallback(c, "Alpha BETA").collect()] == [(1, 2), (2, 1)]


def test_listing_is_clamped(spark):
    files = spark.createDataFrame([(f"/r/AUTO_HIGH_{i}.md", i, 2048) for i in range(5)], "path string, modificationTime long, length long")
    assert [r.modificationTime for r in reports.listing(files, 9, 2).collect()] == [0]
    first = reports.listing(files, 1, 2).orderBy("n").collect()
    assert [(r.modificationTime, r.kind, r.size_kb, r.pages) for r in first] == [(4, "automatic", 2.0, 3), (3, "automatic", 2.0, 3)]


def test_small_helpers(one, spark, tmp_path):
    assert one(readers.strip_markdown(F.lit("## Head\n**bold** [link](http://x) `code`"))) == ("Head\nbold link code",)
    assert one(readers.safe_name(F.lit("../a b/" + "x" * 100 + ".md")))[0] == "x" * 80 + ".md"
    assert one(readers.looks_tabular(F.lit("Indicator table\na   b   c\nd   e   f")), readers.looks_tabular(F.lit("plain prose"))) == (True, False)
    # a context of 2,048 tokens leaves 1,535 or 4,605 characters: 3,315 of the head, 800 of the tail
    long = "h" * 4000 + " t" * 1000
    (cut, whole) = one(reports.fit_prompt(F.lit(long), 2048), reports.fit_prompt(F.lit("a" * 4605), 2048))
    assert whole == "a" * 4605 and cut.startswith("h" * 3315 + "\n\n[") and " 1885 characters" in cut and cut.endswith("]\n\n" + (" t" * 400)[1:])
    assert one(F.length(reports.fit_prompt(F.lit("b" * 5000), 2048, "s" * 3000)))[0] < 3000 and reports.prompt_room(100) == 3 * 768
    assert one(reports.token_estimate(F.lit("")), reports.token_estimate(F.lit(None)), reports.token_estimate(F.lit("abcdefg"))) == (1, 1, 2)
    assert one(net.is_public(F.lit("1.1.1.1"))) == (True,)
    p = tmp_path / "c.json"
    p.write_text('[{"id": "T1", "name": "Name One", "tactic": "x", "deprecated": true}, {"id": "T2", "name": "Two", "tactic": "y"}]')
    cat = readers.read_catalogue(spark, str(p))
    assert [r.id for r in reports.catalogue_search(cat, "name o").collect()] == ["T1"]


def test_store_is_dropped_only_when_confirmed(spark, tmp_path):
    import pytest

    path = str(tmp_path / "s")
    corpus.create_store(spark, path, corpus.ARCHIVE)
    corpus.create_store(spark, path, corpus.ARCHIVE)
    with pytest.raises(ValueError):
        corpus.drop_store(spark, path)
    corpus.drop_store(spark, path, confirm=True)
    assert not (tmp_path / "s").exists()
    rows = corpus.archive_rows(cleaned(spark).drop("ts"), F.col("rule_description"))
    corpus.create_store(spark, path, corpus.ARCHIVE)
    corpus.append_new(rows, path, "alert_hash")
    assert spark.read.parquet(path).filter("event_date = date'2024-05-01'").count() == 1


def test_artifacts_of_alerts_alike_are_counted_before_they_are_taken_apart(spark):
    rows = [(3, " B.x ", "a.x"), (1, "c.x", "C.X"), (2, "b.x", None), (3, " B.x ", "a.x"), (None, "z.x", ""), (4, "z.x", "d.x")]
    a = spark.createDataFrame(rows, "event_id long, src_ip string, dest_ip string")
    now = reporting.current_artifacts(a).first()
    assert now.ips == ["z.x", "c.x", "b.x", "a.x", "d.x"] and now.domains == []
    assert reporting.current_artifacts(a.select("event_id")).first().ips == []
    plan = reporting.current_artifacts(a)._jdf.queryExecution().optimizedPlan().toString()
    assert "kind#" in plan and "given#" in plan.split("Aggregate", 1)[1]
