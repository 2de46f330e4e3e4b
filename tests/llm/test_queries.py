"""The registered queries on the smallest tables, against plain restatements or their SQL."""

import zlib

import brute
import duckdb
import pytest
import sentencepiece

from alertloom.llm import pii, secrets
from alertloom.llm import sentencepiece_trie as sp_trie
from alertloom.llm.queries import ORACLE_SQL, QUERIES
from test_catalog import same_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same_rows(QUERIES[name](spark, SF), ORACLE_SQL[name], SF)


def spans_of(text):
    return [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in text.split(",") if s)]


def test_op1(spark, docs):
    rows = QUERIES["op1_secret_scan"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute.secrets(docs[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in want) for k in secrets.BASE_KINDS)
        assert r.base_sha256 == brute.digest(want) and set(want) <= set(spans_of(r.spans))


def test_op2(spark, docs):
    rows = QUERIES["op2_sampled_splitters"](spark, SF).collect()
    assert len(rows) == len(docs) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    by = {}
    for r in rows:
        assert r.size == len(docs[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode())
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(40))


def test_op3(spark, docs):
    rows = QUERIES["op3_pii_boosting"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute.pii(docs[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in want) for k in pii.BASE_KINDS)
        assert r.base_sha256 == brute.digest(want) and set(want) <= set(spans_of(r.spans))


def test_op6(spark):
    rows = QUERIES["op6_toxicity_grammar"](spark, SF).collect()
    toxic = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall())
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [(r.predicted, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    assert sum(p == y for p, y in held) >= 0.9 * len(held)


def test_op9(spark, docs):
    lib = sentencepiece.SentencePieceProcessor(model_file=sp_trie.default_model())
    rows = QUERIES["op9_sentencepiece"](spark, SF).collect()
    assert len(rows) == len(docs) and all(list(r.ids) == lib.encode(docs[r.doc_id]) and r.round_trip for r in rows)


def test_op10(spark, docs):
    rows = QUERIES["op10_quality_votes"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.quality(docs[r.doc_id])
        assert not (r.base_failed and r.kept)
