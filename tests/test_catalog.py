"""Every registered query against its SQL on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from alertloom.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 6) + 0.0
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


def same_rows(df, sql, folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr([plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names)]) for r in res.fetchall())
    got = sorted(repr([plain(r[c]) for c in sorted(names)]) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same_rows(catalog.QUERIES[name](spark, SF), catalog.ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_runs(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.QUERIES["value_histogram"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in plan
    assert "ReadSchema: struct<event_type:string,props:string>" in plan


def test_reports_of_whole_texts(spark, tmp_path):
    from collections import Counter

    words = "word " * 100
    table = "| Indicator | Severity | Count |\n|---|---|---|\n| 198.51.100.7 | CRITICAL | 3 |"
    texts = [(1, f"{words}\nThreat Level: HIGH\nlast"), (2, f"{words}\n{table}"), (3, f"{words}\n## Technical Summary\nnot kept"), (-4, "short"), (None, "no id"), (5, "- x"), (5, "- y\n- z")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    row = "| 198.51.100.7 | External |  | Inbound |  | CRITICAL | High | 3 |\n"
    head = "## Top Priority Threats\n\n| IP Address | Type | Country | Direction | Activity | Severity | Confidence | Count |\n|------------|------|---------|-----------|----------|----------|------------|-------|\n"

    def report(doc_id, summary, level="MEDIUM", threats="", actions=2):
        text = f"#  Security Operations Center - Threat Analysis Report\n**Threat Level:** {level} | **Total Alerts:** 0\n\n---\n\n## Executive Summary\n\n{summary}\n\n## Key Findings\n\n- one\n- two\n\n{threats}"
        text += f"## Immediate Actions Required\n\n1. Block it\n\n---\n\n**Analysis Complete**\nThreat level: {level}\nPriority actions: {actions} identified\n"
        return doc_id, level, 2, 0, len(text)

    w = words.strip()
    want = [report("1", f"{w}\nThreat Level: HIGH\nlast", "HIGH"), report("2", w, "CRITICAL", head + row + "\n"), report("3", w), report("-4", "short"), report(None, "no id"), report("5", "- x", actions=3), report("5", "- y\n- z", actions=4)]
    assert Counter(map(tuple, catalog.QUERIES["report_round_trip"](spark, str(tmp_path)).collect())) == Counter(want)


def test_long_line_of_a_report_is_read_in_linear_time():
    import time

    from alertloom.operators import reports

    began = time.process_time()
    assert reports.section_of("word " * 20_000) == ("", "") and reports.section_of("word " * 20_000 + "mitre attack")[0] == "mitre"
    assert time.process_time() - began < 2


@pytest.mark.parametrize("name,mark,most", [("context_lines", "CVE-", 2), ("remediation_targets", "CVE-", 2), ("distinct_24h", "explode(sequence(0, 23", 1)])
def test_work_is_not_repeated_in_the_plan(spark, name, mark, most):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().analyzed().toString()
    assert plan.count(mark) <= most, plan.count(mark)


def test_labels_are_matched_once_for_filter_and_output(spark):
    plan = catalog.QUERIES["context_labels"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sandbox") == 1


def test_planted_reports_are_parsed_once_and_once_again_without_a_join(spark):
    plan = catalog.QUERIES["planted_reports"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("ArrowEvalPython") + plan.count("MapInPandas") == 2


def test_planted_reports_of_repeated_ids(spark, tmp_path):
    spark.createDataFrame([(7, "a"), (7, "b"), (8, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = catalog.QUERIES["planted_reports"](spark, str(tmp_path)).collect()
    assert sorted(r.report_id for r in rows) == ["7", "7", "8"] and all(r.same_again and r.kept_appendix and r.errors == 0 for r in rows)


def test_parsed_reports_keep_columns_and_null_texts(spark):
    from alertloom.operators import reports

    src = spark.createDataFrame([(1, None, ["x"], (2, "y")), (None, "Threat Level: LOW", None, None)], "report_id long, markdown string, a array<string>, s struct<n:int,t:string>")
    got = {r.report_id: (r.threat_level, r.appendix, r.a, r.s) for r in reports.parse_reports(src, keep=("a", "s")).collect()}
    assert got == {"1": ("MEDIUM", "", ["x"], (2, "y")), None: ("LOW", "", None, None)}


def test_every_section_pattern_holds_a_section_word():
    from alertloom.functions import patterns as P
    from alertloom.operators import reports

    lines = {"stop": "## **Analysis Complete**", "appendix": "RAG SOURCES USED", "executive_summary": "1. Executive Summary", "key_findings": "Key Findings:", "mitre": "MITRE ATT&CK", "recommendations": "Action required", "technical_summary": "Technical Summary", "threats": "Network threats"}
    assert set(lines) == set(P.REPORT_SECTIONS)
    assert {n: reports.section_of(line)[0] for n, line in lines.items()} == {n: n for n in lines}


def test_rule_before_an_appendix_is_found_in_linear_time(spark):
    import time

    from pyspark.sql import functions as F

    from alertloom.operators import reports

    long = "x\n" * 20_000
    src = spark.createDataFrame([(1, f"{long}--- \n\n## RAG Sources Used\n- y"), (2, f"{long}a ---\n\n## RAG Sources Used\n- y"), (3, "---\n## RAG Sources Used")], "i int, t string")
    began = time.time()
    got = [r[0] for r in src.orderBy("i").select(reports.appendix(F.col("t"))).collect()]
    assert got == ["---\n\n## RAG Sources Used\n- y", "## RAG Sources Used\n- y", "---\n\n## RAG Sources Used"]
    assert time.time() - began < 10


def test_context_reads_alerts_and_documents_once_more_after_retrieval(spark):
    plan = catalog.QUERIES["annotated_context"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 2, plan.count("Relation [")
