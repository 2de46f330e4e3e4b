import pytest
from pyspark.sql import functions as F

from alertloom.functions import chunk, net
from alertloom.functions import text as T

t = None


@pytest.fixture(autouse=True)
def text_column(spark):
    global t
    t = F.col("t")


def test_addresses_match_whole_and_valid(one):
    assert one(T.ips(t), t="hit 198.51.100.10, not 198.51.100.101x or 300.1.1.1 or 01.2.3.4; again 198.51.100.10")[0] == ["198.51.100.10"]


def test_an_address_is_not_found_inside_a_longer_one(one):
    assert one(T.contains_term(t, F.lit("198.51.100.10"), "ips"), t="seen 198.51.100.101 only") == (False,)
    assert one(T.contains_term(t, F.lit("198.51.100.10"), "ips"), t="seen 198[.]51[.]100[.]10 here") == (True,)


def test_public_test(one):
    ips = ["8.8.8.8", "10.1.1.1", "192.0.0.9", "192.0.0.8", "198.18.0.1", "224.0.0.1", "240.0.0.1", "x", ""]
    assert one(*[net.is_public(F.lit(i)) for i in ips]) == (True, False, True, False, False, True, False, False, False)


def test_urls_lose_trailing_punctuation_and_hosts_become_domains(one):
    u, d = one(T.urls(t), T.domains(t), t="see (https://Bad.example.net/a?b=1). mail x@corp.example.org file run.exe also evil.example")
    assert u == ["https://Bad.example.net/a?b=1"]
    assert d == ["bad.example.net", "evil.example"]


def test_hash_case_and_typed_ids(one):
    h = "AB" * 16
    got = one(T.hashes(t), T.cves(t), T.techniques(t), T.actors(t), t=f"{h} cve-2024-12345 t1059.001 apt28 TA0001")
    assert got == ([h.lower()], ["CVE-2024-12345"], ["T1059.001"], ["APT28", "TA0001"])


def test_unicode_neighbours_are_word_characters(one):
    assert one(T.ips(t), t="é10.1.1.1 und 10.1.1.2") == (["10.1.1.2"],)


def test_private_addresses_stay_out_of_the_context(one):
    got = one(T.for_context(T.artifacts(t)), T.artifacts(t), t="10.0.0.5 and 8.8.4.4")
    assert got[0]["ips"] == ["8.8.4.4"]
    assert got[1]["non_public_ips"] == ["10.0.0.5"]


def test_refang_and_variants(one):
    assert one(T.refang(t), t="hxxps[:]//evil[.]example(.)net") == ("https://evil.example.net",)
    v = T.variants("http://a.example")
    assert v[0] == "http://a.example" and "hxxp://a.example" in v and len(v) == len({x.lower() for x in v}) <= 24


def test_labels_rank_by_matches_then_name(one):
    got = one(T.context_labels(t), T.behavior_tags(t), t="Indicator list: sha256 hash. The victim sandbox. indicator")
    assert got[0][0] == "ioc_listing" and set(got[0]) == {"ioc_listing", "victim_infrastructure", "analysis_environment"}
    assert one(T.context_labels(t), t="exfiltration of phishing") == (["ttp_behavior"],)


def test_bare_stems_need_a_boundary(one):
    assert one(T.behavior_tags(t), t="enumeration") == ([],)


def test_dispositions_are_local_to_the_sentence(one):
    text = "The C2 beacon used 8.8.8.1 today. The victim host was 8.8.8.2; sandbox traffic to 8.8.8.3\nlegitimate resolver 8.8.8.4"
    kinds = [T.disposition(t, F.lit(f"8.8.8.{i}"), "ips") for i in (1, 2, 3, 4, 9)]
    assert one(*kinds, t=text) == ("malicious", "victim", "analysis_environment", "benign", "unknown")


def test_section_default_only_replaces_unknown(one):
    lab = F.array(F.lit("ioc_listing"), F.lit("remediation"))
    assert one(T.section_default(F.lit("unknown"), lab), T.section_default(F.lit("victim"), lab)) == ("remediation_reference", "victim")


def test_extraction_quality(one):
    q = T.extraction_quality
    assert one(q(t, F.lit(4)), t="[IMAGES DETECTED: 2] short [IMAGES DETECTED: 1]")[0]["warnings"] == ["low_text_density", "image_heavy_pdf_no_ocr", "few_extracted_words", "no_cti_artifacts_extracted"]
    assert one(q(t, F.lit(0)), t="fine")[0]["quality"] == "high"
    assert one(q(t, F.lit(1)), t="word " * 100)[0]["quality"] == "high"
    assert one(q(t, F.lit(1)), t="  ")[0]["quality"] == "empty"


def test_unique_keeps_the_first_spelling(one):
    assert one(T.unique(F.array(F.lit(" Ab"), F.lit("aB "), F.lit(""), F.lit("c1"), F.lit("1c")))) == (["Ab", "c1", "1c"],)


def test_snippet_and_caps(one):
    s = one(T.snippet(t, F.lit("needle"), 5), T.capped(F.array(*[F.lit(str(i)) for i in range(5)]), 3), t="aaaaaaaaaa  NEEDLE bbbbbbbbbb")
    assert s == ("...aaa NEEDLE bbbb...", ["0", "1", "2", "... 2 more"])


def test_window_chunks_cover_the_text(one):
    got = one(chunk.window_chunks(t, 10, 3), t="abcdefghijklmnopqrstuvwxyz")[0]
    assert got == chunk.windows("abcdefghijklmnopqrstuvwxyz", 10, 3)
    assert got[0] == "abcdefghij" and got[-1].endswith("z") and got[1][:3] == got[0][-3:]
    assert one(chunk.window_chunks(t, 10, 3), t="")[0] == []


def test_sentences_pack_and_long_ones_split():
    assert chunk.sentence_chunks("One. Two! Three?", 9, 0) == ["One. Two!", "Three?"]
    assert chunk.sentence_chunks("Ok. " + "x" * 25, 10, 2) == ["Ok.", "x" * 10, "x" * 10, "x" * 9]


def test_sections_carry_their_path():
    text = "# Report\n\n## Indicators\n\nhost 8.8.8.8 bad\n\n## Victim\n\nhost seen\n\n1.2 Timeline\n\nnoon"
    got = chunk.section_chunks(text, 40, 0)
    assert got[0][1] == "Report > Indicators" and got[0][2] == "Indicators"
    assert got[-1][1] == "Report > Timeline"
    assert chunk.heading("--- Page 3 ---") is None and chunk.heading("Analysis of a thing. And more") is None
    assert chunk.section_chunks("", 40, 0) == []


def test_paragraph_chunks_overlap_whole_parts():
    parts = ["a" * 30, "b" * 10, "c" * 30]
    got = chunk.paragraph_chunks("\n\n".join(parts), 45, 12)
    assert got == ["a" * 30 + "\n\n" + "b" * 10, "b" * 10 + "\n\n" + "c" * 30]


def test_chunk_table(spark):
    docs = spark.createDataFrame([(1, "One. Two."), (2, None), (3, " ")], "doc_id long, text string")
    rows = chunk.chunk_documents(docs, "sentences").collect()
    assert [(r.doc_id, r.chunk_index, r.text) for r in rows] == [(1, 0, "One. Two.")]


def test_long_texts_reach_python_in_small_batches(spark, tmp_path):
    from alertloom.functions import chunk
    from alertloom.operators import reports
    from alertloom.operators.text_index import TextIndex

    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    uses = {
        "chunks": lambda: chunk.chunk_documents(docs),
        "reports": lambda: reports.parse_reports(docs.selectExpr("doc_id AS report_id", "text AS markdown")),
        "postings": lambda: TextIndex.build(docs.selectExpr("'s' AS source", "doc_id AS id", "text AS content"), str(tmp_path)),
    }
    for name, use in uses.items():
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(256 << 20))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        use()
        assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 16 << 20, name
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500, name


def test_chunks_under_a_long_heading_leave_in_small_frames(spark, monkeypatch):
    import pandas as pd

    caught = []
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInPandas", lambda self, work, schema: caught.append(work) or self)
    chunk.chunk_documents(docs)
    text = "\n\n".join(["# " + "word " * 20_000, *["plain " * 190] * 20])
    frames = list(caught[0](iter([pd.DataFrame({"doc_id": range(5), "text": text})])))
    texts = ["text", "section_path", "section_heading"]
    assert max(int(f[c].str.len().sum()) for f in frames for c in texts) <= 16 << 20
    cs = chunk.section_chunks(text)
    assert pd.concat(frames).values.tolist() == [[i, k, len(cs), *c] for i in range(5) for k, c in enumerate(cs)]


@pytest.mark.parametrize("rows,each", [(1200, 100), (90, 400_000)])
def test_batches_in_python_keep_both_bounds(spark, rows, each):
    """Both kinds of step: chunks pass whole rows, reports a column."""
    from collections.abc import Iterator

    import pandas as pd

    from alertloom.session import small_batches

    def sizes(batches):
        for b in batches:
            yield pd.DataFrame({"n": [len(b)], "width": [int(b.text.str.len().sum())]})

    def size(batches):
        for b in batches:
            yield pd.Series([f"{len(b)} {int(b.str.len().sum())}"] * len(b))

    size.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(256 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    small_batches(spark)
    texts = spark.range(0, rows, 1, 1).select(F.repeat(F.lit("x"), each).alias("text"))
    whole = [(r.n, r.width) for r in texts.mapInPandas(sizes, "n long, width long").collect()]
    column = [tuple(map(int, r[0].split())) for r in texts.select(F.pandas_udf(size, "string")("text")).collect()]
    assert sum(n for n, _ in whole) == len(column) == rows
    assert all(n <= 500 and width <= (16 << 20) + each for n, width in whole + column)


@pytest.mark.parametrize("text", ["a b\n" * 50_000, "\n" * 200_000, "| a | b |\n" * 20_000, "## Executive Summary\nwell\n## MITRE ATT&CK\n" + "a b\n" * 50_000])
def test_a_report_of_many_short_lines_is_parsed_in_little_memory(text):
    import tracemalloc

    from alertloom.operators import reports

    reports.parse("a")  # patterns are compiled
    tracemalloc.start()
    record = reports.parse(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert record["threat_level"] == "MEDIUM" and record["executive_summary"] == ("well" if "well" in text else "")
    assert peak <= 3 * len(text)


def test_records_of_long_reports_leave_in_small_frames(spark, monkeypatch):
    import pandas as pd

    from alertloom.operators import reports

    caught, real = [], F.pandas_udf
    monkeypatch.setattr(F, "pandas_udf", lambda work, schema: caught.append(work) or real(work, schema))
    texts = [f"Threat Level: HIGH\n## Key Findings\n- item {i}\n" + "x" * 300_000 for i in range(10)]
    src = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "report_id long, markdown string").repartition(1)
    whole = reports.parse_reports(src).select("key_findings", "threat_level").collect()
    frames = list(caught[0](iter([pd.Series(texts)])))
    assert [len(f) for f in frames] == [4, 4, 2]
    assert pd.concat(frames).to_dict("records") == [reports.parse(t) for t in texts]
    assert sorted(r.key_findings[0] for r in whole) == sorted(f"item {i}" for i in range(10)) and {r.threat_level for r in whole} == {"HIGH"}


@pytest.mark.parametrize("text", ["HIGH SEVERITY", "a\r\nHIGH\x0bSEVERITY", "a\rb CRITICAL", "a\n" * 11 + "CRITICAL", "a\n" * 12 + "CRITICAL", "a\x85" * 12 + "CRITICAL", "\r\n" * 11 + "CRITICAL\n", ""])
def test_the_title_ends_where_its_lines_do(text):
    from alertloom.functions import patterns as P
    from alertloom.operators import reports

    title = "\n".join(text.splitlines()[: P.TITLE_LINES])
    said = "CRITICAL" if "CRITICAL" in title else "HIGH" if "SEVERITY" in title else "MEDIUM"
    assert reports.threat_level(text) == said


def test_remediation_targets_of_a_long_listing_are_all_found(spark):
    from alertloom.operators import audit

    said = "\n".join(f"Block 203.0.{i // 200}.{i % 200} here\nIsolate host{i}.badnet.org\nSeen idle{i}.badnet.org" for i in range(150))
    rows = spark.createDataFrame([(said,)], "t string").select(F.inline(audit.remediation_targets(t))).collect()
    want = [("ips", f"203.0.{i // 200}.{i % 200}", ["block"]) for i in range(150)] + [("domains", f"host{i}.badnet.org", ["isolate"]) for i in range(150)]
    assert sorted(map(tuple, rows)) == sorted(want)
    first = spark.createDataFrame([(said,)], "t string").select(F.inline(audit.remediation_targets(t, 40))).collect()
    assert [r.value for r in first if r.type == "ips"] == [v for k, v, _ in want if k == "ips"][:40]


def test_contexts_of_the_pieces_that_mention_a_value_equal_those_of_the_text(spark):
    import random

    r = random.Random(4)
    values = {"ips": "8.8.4.4", "domains": "kiss.badnet.org", "urls": "https://kiss.badnet.org/\u00df?k=1", "hashes": "a" * 32}
    words = [*values.values(), "\u212ai\u017fs.badnet.org", "https://KISS.badnet.org/\u1e9e?k=1", "18.8.4.4", "block", "x" * 130, ".", ";", "\n", ". ", "; ", ".\n", " ", " ", "\n "]
    texts = [("".join(r.choice(words) for _ in range(r.randint(1, 25))),) for _ in range(400)]
    for kind, value in values.items():
        v = F.lit(value)
        got = spark.createDataFrame(texts, "t string").select(T.contexts(t, v, kind, 20).alias("whole"), T.contexts(T.near(T.pieces(t), v), v, kind, 20).alias("near")).collect()
        assert [x.whole for x in got] == [x.near for x in got] and sum(len(x.whole) for x in got) > 20


def test_a_mention_at_the_start_of_a_line_has_nothing_of_the_line_before(one):
    assert one(T.contexts(F.lit("Block it\n8.8.4.4 was seen"), F.lit("8.8.4.4"), "ips"))[0] == ["8.8.4.4 was seen"]
