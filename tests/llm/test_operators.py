"""Each operator against its plain restatement, and the defined edge cases."""

import base64
import json
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from alertloom.llm import chat, components, embed_dedup, mixing, neardup, pii, quality, secrets, sharding, toxicity
from alertloom.llm import sentencepiece_trie as sp_trie
from alertloom.llm.common import Scratch

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Clashing names that operators use inside.
EXTRA = ["size", "kept", "component_id", "block", "node", "u", "v", "bin", "votes", "ids", "range", "c", "d", "id"]


def documents(spark, texts, clash=True):
    rows = [(i if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1], "en", None if i % 7 == 0 else f"s{i % 3}", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    for c in EXTRA if clash else []:
        df = df.withColumn(c, F.lit("x"))
    return df


def awkward():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randint(1, 7)))
    long = " ".join(word() for _ in range(40_000))
    return [None, "", "   \n\t", "one", "a b c d", long, long, "x " * 3000, "Ünïcödé\x0bwords\x85here é\n\nline\nline"]


# --- secrets ---------------------------------------------------------------------------------------------------
def _der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")) + body


KEY = _der(0x30, _der(0x02, b"\0") + _der(0x30, _der(0x06, b"\x2a\x86\x48")) + _der(0x04, bytes(range(90))))


def test_secret_structures():
    b64 = base64.b64encode(KEY).decode()
    header = base64.urlsafe_b64encode(json.dumps({"alg": "HS256"}).encode()).decode().rstrip("=")
    body = base64.urlsafe_b64encode(json.dumps({"sub": "1"}).encode()).decode().rstrip("=")
    blob = lambda *p: base64.b64encode(b"".join(len(x).to_bytes(4, "big") + x for x in p)).decode()
    kinds = lambda t: {k for k, *_ in secrets.find_secrets(t)}
    assert "der" in kinds(f"see {b64} end")
    assert "der" not in kinds(base64.b64encode(KEY[:-1]).decode())
    assert "jwt" in kinds(f"Bearer {header}.{body}.abc") and "jwt" not in kinds(f"{body}.{header}.abc")
    assert "ssh" in kinds(blob(b"ssh-ed25519", bytes(32))) and "ssh" not in kinds(blob(b"nothing-here", bytes(32)))
    assert "pem" in kinds(f"-----BEGIN PRIVATE KEY-----\n{b64[:64]}\n{b64[64:]}\n-----END PRIVATE KEY-----")
    assert "pem" not in kinds("-----BEGIN PRIVATE KEY-----\nnothing\n-----END PRIVATE KEY-----")
    assert "hexkey" in kinds(KEY.hex()) and kinds("0" * 40) == {"hex"}


@pytest.mark.parametrize("seed", range(3))
def test_secret_base_spans(seed):
    r = random.Random(seed)
    bits = ["token", "TOKEN", "apikey", "api_key", "password", "paſſword", " ", "=", ":", '"', "'", "AKIA", "ABCDEF12", "0123abcd" * 4, "secret", "-x.y/", "é", "\n"]
    for _ in range(400):
        t = "".join(r.choice(bits) for _ in range(25))
        assert [s[:3] for s in secrets.find_secrets(t) if s[0] in secrets.BASE_KINDS] == brute.secrets(t)


def test_secret_rows(spark):
    got = secrets.scan_secrets(documents(spark, awkward() + ["token = abcdefgh1"])).collect()
    assert len(got) == 10 and [r.secrets for r in got if r.doc_id == 0] == [[]]
    out = secrets.redact_secrets(documents(spark, ["x token=abcdefgh1 y", None]))
    assert [r.text for r in out.orderBy("doc_id").collect()] == ["x [SECRET] y", None] and out.columns[-1] == "id"
    assert secrets.scan_secrets(documents(spark, [])).count() == 0


def _der_int(n):
    return _der(0x02, n.to_bytes(n.bit_length() // 8 + 1, "big"))


def _ssh(*fields):
    return b"".join(len(x).to_bytes(4, "big") + x for x in fields)


RSA = _der(0x30, _der(0x02, b"\0") + b"".join(_der_int(3**k) for k in range(60, 68)))
NAMED = _der(0x30, _der(0x06, b"\x2a\x86\x48") + _der(0x05, b""))
SSH_PUBLIC = _ssh(b"ssh-ed25519", bytes(32))
SSH_PRIVATE = b"openssh-key-v1\0" + _ssh(b"none", b"none", b"") + b"\0\0\0\1" + _ssh(SSH_PUBLIC, b"abcdabcd" + bytes(range(56)))
PRIVATE = {
    "rsa": RSA,
    "dsa": _der(0x30, b"".join(_der_int(n) for n in (0, 5**30, 7**20, 3**40, 2**70, 11**9))),
    "sec1": _der(0x30, _der(0x02, b"\1") + _der(0x04, bytes(32)) + _der(0xA0, _der(0x06, b"\x2a"))),
    "pkcs8": KEY,
    "encrypted": _der(0x30, NAMED + _der(0x04, bytes(48))),
    "openssh": SSH_PRIVATE,
}
NOT_PRIVATE = {
    "certificate": _der(0x30, _der(0x30, _der_int(5) + NAMED + bytes(0)) + NAMED + _der(0x03, bytes(64))),
    "public": _der(0x30, NAMED + _der(0x03, bytes(64))),
    "rsa public": _der(0x30, _der_int(3**200) + _der_int(65537)),
    "magic and junk": b"openssh-key-v1\0" + bytes(range(80)),
    "cut": SSH_PRIVATE[:-1],
    "unlike checks": SSH_PRIVATE.replace(b"abcdabcd", b"abcdabce"),
    "two values": RSA + b"\x05\0",
}


def test_only_private_keys_are_confirmed():
    b64 = lambda b: base64.b64encode(b).decode()
    confirmed = lambda t: {k for k, *_, sure in secrets.find_secrets(t) if sure}
    for name, b in PRIVATE.items():
        assert confirmed(b64(b)) == {"ssh" if name == "openssh" else "der"}, name
        assert "hexkey" in confirmed(b.hex()), name
        assert "pem" in confirmed(f"-----BEGIN PRIVATE KEY-----\n{b64(b)}\n-----END PRIVATE KEY-----"), name
    for name, b in NOT_PRIVATE.items():
        assert not confirmed(b64(b)) and not confirmed(b.hex()), name
        assert not confirmed(f"-----BEGIN PRIVATE KEY-----\n{b64(b)}\n-----END PRIVATE KEY-----"), name
    pem = "-----BEGIN ENCRYPTED PRIVATE KEY-----\n{}\n-----END ENCRYPTED PRIVATE KEY-----"
    assert not confirmed(pem.format(b64(b"hello world"))) and confirmed(pem.format(b64(PRIVATE["encrypted"]))) >= {"pem"} and not confirmed(pem.format(b64(PRIVATE["encrypted"][:-2]))) & {"pem"}
    old = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: {},{}\n\n{}\n-----END RSA PRIVATE KEY-----"
    assert "pem" in confirmed(old.format("AES-128-CBC", "0A" * 16, b64(bytes(64)))) and "pem" not in confirmed(old.format("AES-128-CBC", "0A" * 16, b64(bytes(63))))
    deep = b"\x04\0"
    for _ in range(40):
        deep = _der(0x30, deep)
    assert secrets.der_fits(deep) and not secrets.der_fits(deep[:-1])


def test_added_spans_are_found_where_they_were_put(spark):
    """Every way of writing a planted key, by its known place; the public ones are left alone."""
    r = random.Random(12)
    b64 = lambda b: base64.b64encode(b).decode()
    texts, want = [], []
    for i in range(60):
        name, b = r.choice([*PRIVATE.items(), *NOT_PRIVATE.items()])
        good = name in PRIVATE
        form = r.choice(["raw", "hex", "pem"])
        body = {"raw": b64(b), "hex": b.hex(), "pem": f"-----BEGIN PRIVATE KEY-----\n{b64(b)[:50]}\n{b64(b)[50:]}\n-----END PRIVATE KEY-----"}[form]
        before = "é word " * r.randint(0, 4) + "see: "
        texts.append(f"{before}{body} end")
        kind = {"raw": "ssh" if name == "openssh" else "der", "hex": "hexkey", "pem": "pem"}[form]
        want.append({(kind, len(before), len(before) + len(body))} if good else set())
    for x in secrets.scan_secrets(documents(spark, texts)).collect():
        got = {(s.kind, s.start, s.end) for s in x.secrets if s.confirmed and s.kind in secrets.ADDED_KINDS}
        assert {s for s in got if s[0] in {k for k, *_ in want[x.doc_id]} or not want[x.doc_id]} == want[x.doc_id], texts[x.doc_id]
    public = base64.b64encode(SSH_PUBLIC).decode()
    out = secrets.redact_secrets(documents(spark, [f"key {public} end", f"key {base64.b64encode(SSH_PRIVATE).decode()} end"])).orderBy("doc_id").collect()
    assert [x.text for x in out] == [f"key {public} end", "key [SECRET] end"]


def test_secrets_in_very_long_runs():
    import time

    for t in ["QUFB" * 500_000, "-----BEGIN PRIVATE KEY-----\n" * 30_000, "0123456789abcdef" * 100_000, "eyJ" + "a" * 10**6 + "." * 10, "-----BEGIN PRIVATE KEY-----\n" + "QUFB\n" * 200_000 + "-----END PRIVATE KEY-----"]:
        began = time.perf_counter()
        secrets.find_secrets(t)
        assert time.perf_counter() - began < 10


# --- sharding --------------------------------------------------------------------------------------------------
def test_shards(spark):
    r = random.Random(1)
    texts = ["copy"] * 700 + ["".join(r.choice("abcé") for _ in range(r.randint(0, 60))) for _ in range(1300)] + [None, ""]
    rows = sharding.shard(documents(spark, texts), shards=10, ranges_per_shard=4).collect()
    assert len(rows) == len(texts)
    by = {}
    for x in rows:
        t = texts[x.doc_id]
        assert x.size == (len(t.encode()) if t else 0) + 16 and x.text_crc32 == (None if t is None else zlib.crc32(t.encode()))
        by.setdefault(x.shard, []).append((x.slot, x.size))
    assert sorted(by) == list(range(10))
    assert all(sorted(s for s, _ in v) == list(range(len(v))) for v in by.values())
    sizes = [sum(z for _, z in v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 2 * max(z for v in by.values() for _, z in v)
    assert sharding.shard(documents(spark, [])).count() == 0
    assert sharding.shard(documents(spark, [(None, "a"), (None, "a"), (3, None)]), shards=2).count() == 3


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    calls = []
    real = sharding._cuts
    monkeypatch.setattr(sharding, "_cuts", lambda keys, w, step, n: (calls.append(n), real(keys, w, step, n) if len(calls) > 1 else [(5, 5)])[1])
    rows = sharding.shard(documents(spark, [f"t{i}" for i in range(500)]), shards=5, ranges_per_shard=4).collect()
    assert len(calls) > 1
    n = [sum(1 for x in rows if x.shard == k) for k in range(5)]
    assert max(n) - min(n) <= 3


def test_rows_repeated_whole_are_cut_like_others(spark):
    """A third of all rows without id and text, another third equal in both: sizes stay near equal, and reruns agree."""
    texts = [(None, None)] * 800 + [(7, "same text")] * 800 + [(i, f"text {i}") for i in range(800)]
    rows = sharding.shard(documents(spark, texts), shards=20, ranges_per_shard=4).collect()
    by = {}
    for x in rows:
        by.setdefault(x.shard, []).append((x.slot, x.size))
    assert len(rows) == 2400 and sorted(by) == list(range(20))
    assert all(sorted(s for s, _ in v) == list(range(len(v))) for v in by.values())
    sizes = [sum(z for _, z in v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 2 * max(z for v in by.values() for _, z in v)
    again = sharding.shard(documents(spark, texts[::-1]), shards=20, ranges_per_shard=4).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))


# --- personal data -----------------------------------------------------------------------------------------------
def test_pii_base_spans(spark):
    r = random.Random(2)
    bits = ["a.b", "@", "mail-1", ".com", "192.168.0.1", ".", "256", "4111111111111111", "4111 1111 1111 1111", "-", " ", "+1", "(234)", "555-1234", "+49 30 123456", "é", "\u0001", "x" * 50, "00", "1.2.3.4.5", "\U0001f600"]
    texts = ["".join(r.choice(bits) for _ in range(20)) for _ in range(600)] + awkward()
    for x in pii.find_pii(documents(spark, texts)).collect():
        want = brute.pii(texts[x.doc_id])
        got = [(k, s.start, s.end) for k in pii.BASE_KINDS for s in x[k]]
        assert got == want, texts[x.doc_id]


def test_pii_trees_choose_by_format_and_context(spark):
    texts = ["call me, phone: (030) 555-1234 today", "order 20240131123 shipped", "ssn 123-45-6789", "IBAN DE89 3704 0044 0532 0130 00", "write to jane [at] corp [dot] org", "version 1.2.3.4.5.6.7.8", "9807915762804490"]
    got = {x.doc_id: [k for k in pii.ADDED_KINDS if x[k]] for x in pii.find_pii(documents(spark, texts)).collect()}
    assert got[0] == ["digits"] and got[2] == ["digits"] and got[3][-1:] == ["account"] and got[4] == ["spelled"]
    assert got[1] == got[5] == got[6] == []


def test_pii_long_runs_do_not_overflow(spark):
    texts = ["1 " * 60_000, "+" + "1" * 60_000, "a" * 60_000 + "@", "1." * 60_000, "(1" * 30_000]
    assert pii.find_pii(documents(spark, texts)).count() == 5


# --- near-duplicates -----------------------------------------------------------------------------------------------
def variants(seed=5, bases=6, copies=30):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    out = []
    for b in range(bases):
        words = [r.choice(vocab) for _ in range(200)]
        for _ in range(copies):
            w = list(words)
            for _ in range(r.choice([0, 1, 2, 3, 4])):
                w[r.randrange(len(w))] = r.choice(vocab)
            out.append(" ".join(w) if r.random() < 0.5 else "\n".join(w).upper())
    r.shuffle(out)
    return out


@pytest.mark.parametrize("block_rows", [1500, 8])
def test_near_duplicates(spark, block_rows):
    texts = variants() + ["a b", "A  b", "one", "", None, " "]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.near_duplicates(documents(spark, texts), block_rows=block_rows).collect()}
    assert got == brute.near_duplicates(list(enumerate(texts)))


@pytest.mark.parametrize(("block_rows", "bucket_rows"), [(6, 3), (40, 1), (1500, 2)])
def test_large_blocks_and_buckets_lose_no_link(spark, block_rows, bucket_rows):
    texts = variants(11, 4, 60) + [f"w{i} " * 6 for i in range(20)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.near_duplicates(documents(spark, texts), block_rows=block_rows, bucket_rows=bucket_rows).collect()}
    assert got == brute.near_duplicates(list(enumerate(texts)))


def test_hubs_are_members_of_the_largest_groups():
    r = np.random.default_rng(2)
    base = r.integers(1, 1 << 62, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[i : 270 + i], r.integers(1, 1 << 62, 10, dtype=np.uint64)])) for i in range(20)] + [r.integers(1, 1 << 62, 280, dtype=np.uint64) for _ in range(15)]
    found = neardup.hubs_of(np.arange(35), sets, np.stack([neardup.signature(x) for x in sets]), 85, 1e-6)
    assert len(found) <= neardup.HUBS and set(found[: neardup.HUBS_OF_GROUP].tolist()) <= set(range(20))


def test_distinct_documents_are_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, "another text altogether"), (1, "another text altogether"), (None, text), (None, "x"), (None, "x"), (2, text + " end"), (3, None), (3, None), (3, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    for c in ["row_number", "component", "kept", "__id", "__rows", "n", "id"]:
        df = df.withColumn(c, F.lit("x"))
    out = neardup.distinct_documents(df)
    assert out.columns == df.columns
    assert sorted(((x.doc_id, x.text) for x in out.collect()), key=str) == sorted([(1, text), (1, "another text altogether"), (None, "x"), (3, None), (3, None), (3, "")], key=str)
    assert neardup.distinct_documents(df.limit(0)).count() == 0


def test_hot_keys_join_like_others(spark):
    from alertloom.llm import common

    left = spark.createDataFrame([(1, i) for i in range(3000)] + [(k, 0) for k in range(2, 50)] + [(99, 0)], "k long, x long")
    right = left.groupBy("k").agg(F.count("*").alias("n")).withColumn("y", F.col("k") * 2).filter("k <> 99")
    out = common.join_each(left, right, ["k"], "n", 3049)
    assert out.columns == ["k", "x", "y"] and out.count() == 3048 and out.filter("y <> 2 * k").count() == 0


def test_near_duplicates_edges(spark):
    df = documents(spark, [(7, "same text here"), (7, "same text here"), (9, "same text here"), (None, "same text here"), (3, None)])
    got = sorted(((x.doc_id, x.component_id, x.kept) for x in neardup.near_duplicates(df).collect()), key=str)
    assert got == [(3, 3, True), (7, 7, True), (7, 7, True), (9, 7, False), (None, None, True)]
    assert neardup.near_duplicates(documents(spark, [])).count() == 0
    assert neardup.near_duplicates(documents(spark, awkward())).count() == 9


def test_posterior_bounds_are_safe():
    need = neardup.least_matches(0.85, 1e-6)
    assert list(need) == sorted(need) and len(need) == neardup.SLOTS // neardup.BATCH
    assert all(n < 0.85 * neardup.BATCH * (i + 1) for i, n in enumerate(need)) and need[-1] > 64


@pytest.mark.parametrize("cut", [1, 7, 50, 1000])
def test_bucket_forests_connect_all_surviving_pairs(cut):
    import pyarrow as pa

    g = np.random.default_rng(cut)
    centres = g.integers(0, 256, (6, neardup.SKETCH), dtype=np.uint8)
    band = np.sort(g.integers(0, 12, 160))
    node = g.integers(0, 90, 160)
    rows = centres[node % 6].copy()
    noise = g.random(rows.shape) < 0.35
    rows[noise] = g.integers(0, 256, int(noise.sum()))
    need = 16
    batches = [pa.RecordBatch.from_arrays([pa.array(band[i : i + cut]), pa.array(node[i : i + cut]), pa.array([r.tobytes() for r in rows[i : i + cut]], pa.binary())], names=["b", "n", "s"]) for i in range(0, 160, cut)]
    found = [(u, v) for b in neardup._bucket_edges(need)(batches) for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    forest = neardup.Forest(90)
    for u, v in found:
        forest.union(u, v)
    for b in range(12):
        at = np.flatnonzero(band == b)
        first = {int(node[i]): i for i in at[::-1]}  # a vertex repeated in a bucket counts once, by its first row
        for i in first.values():
            for j in first.values():
                if (rows[i] == rows[j]).sum() >= need:
                    assert forest.root(int(node[i])) == forest.root(int(node[j]))
    assert len(found) < 160


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (5, 5)] + [(300, 300 + i) for i in range(50)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[200] == got[100] == 100 and got[349] == 300 and 5 in got
    assert components.components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


# --- mixing ----------------------------------------------------------------------------------------------------
def reshared(sizes, weights=(5, 2, 1), share=1.5):
    """Targets by repeated resharing."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, open_, left = {}, list(names), share * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > 2 * sizes[s]]
        if not over:
            out |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


@pytest.mark.parametrize("bin_rows", [20_000, 3])
def test_mix(spark, bin_rows):
    r = random.Random(4)
    texts = [" ".join("w" for _ in range(r.choice([0, 1, 5, 40]))) for _ in range(200)] + awkward()
    df = documents(spark, texts)
    rows = mixing.mix(df, bin_rows=bin_rows).collect()
    assert len(rows) == len(texts)
    sizes, taken, target = {}, {}, {}
    for x in rows:
        assert x.size == len(brute.words(texts[x.doc_id])) and 0 <= x.taken <= 2 * x.size
        sizes[x.source] = sizes.get(x.source, 0) + x.size
        taken[x.source] = taken.get(x.source, 0) + x.taken
        target[x.source] = x.target
    want = reshared(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 0.5
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(df.repartition(5), bin_rows=bin_rows).collect()))
    out = mixing.materialise(df, mixing.mix(df))
    assert out.columns == df.columns


def test_mix_without_words(spark):
    assert [x.taken for x in mixing.mix(documents(spark, ["", None])).collect()] == [0, 0]
    assert mixing.mix(documents(spark, [])).count() == 0


# --- toxicity ----------------------------------------------------------------------------------------------------
def test_grammar_scores_clauses():
    lex = toxicity.Lexicon({"^idio": 1.5}, 0.02)
    s = lambda t: lex.score(t)[0]
    assert s("you idiot") > s("idiot") > s("not idiot") > s(None) == s("") == pytest.approx(0.02)
    assert s("they said idiot") < s("an idiot") and s("idiot. idiot") > s("idiot")
    assert s("i will kill you") > 0.7 > s("kill the process")
    assert s("antiidiotic") == pytest.approx(0.02)


def test_composition_is_finite_and_total():
    assert all(len(row) == 6 and all(0 <= n < len(toxicity.GRAMMAR) for n, _ in row) for row in toxicity.GRAMMAR)


def test_learned_stems_hold_out(spark):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
        toxic = r.random() < 0.2
        for _ in range(3 if toxic else 0):
            words.insert(r.randrange(60), "zorqu" + "".join(r.choice("xyz") for _ in range(3)))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    lex = toxicity.learn(docs, lab.filter("doc_id < 400"))
    assert any(k.startswith("^zorqu"[:5]) for k in lex.stems)
    got = {x.doc_id: x.s >= 0.7 for x in toxicity.score_rows(docs, lex, score_col="s").collect()}
    assert all(got[i] == bool(y) for i, y in labels if i >= 400)


def test_negated_and_reported_threats():
    lex = toxicity.Lexicon({}, 0.02)
    seed = toxicity.SEED_ODDS - lex.intercept
    assert lex.clause("i will kill you".split()) == lex.clause("they will kill you".split()) == pytest.approx(seed)
    assert lex.clause("i will not kill you".split()) == pytest.approx(0.4 * seed)
    assert lex.clause("he said i will kill you".split()) == pytest.approx(0.5 * seed)
    assert lex.clause("they said it would not kill you".split()) == pytest.approx(0.2 * seed)
    assert lex.score("They said it would not kill you")[0] < 0.7 <= lex.score("It would kill you")[0]
    assert lex.clause("it would not kill the engine".split()) == lex.clause("not kill".split()) == 0


def test_scores_equal_a_plain_restatement():
    r = random.Random(13)
    lex = toxicity.Lexicon({"^idio": 0.8, "^fool$": 0.6, "^kill": 1.1, "^stupi": 0.3}, 0.02, {toxicity.AIMED: 1.7, toxicity.NEGATED: 0.3, toxicity.REPORTED: 0.6})
    words = "you not said idiot idiots fool fools kill killing hurt stupid the engine word never they she Idiot".split()
    for _ in range(3000):
        t = "".join(r.choice(words) + r.choice([" ", " ", " ", " ", ", ", ". ", "\n", "! "]) for _ in range(r.randint(0, 25)))
        raw = min(30.0, lex.intercept + brute.toxicity(lex, t))
        assert lex.score(t)[0] == pytest.approx(1 / (1 + np.exp(-raw))), t


def test_repetition_and_length_make_nothing_toxic():
    lex = toxicity.Lexicon({"^mild": 0.4}, 0.02)
    once, thrice = lex.score("a mild word. ")[0], lex.score("a mild word. " * 3)[0]
    assert once < thrice == lex.score("a mild word. " * 100)[0] == lex.score("a mild word. " * 20_000)[0] < 0.1
    assert lex.score("i will kill you. ")[0] < lex.score("i will kill you. " * 3)[0] == lex.score("i will kill you. " * 100)[0]


def test_a_learned_stem_can_still_be_a_threat():
    lex = toxicity.Lexicon({"^kill": 0.5}, 0.02)
    seed = toxicity.SEED_ODDS - lex.intercept
    assert lex.clause(["kill", "it"]) == pytest.approx(0.5) and lex.clause("i kill you".split()) == pytest.approx(seed)
    assert toxicity.Lexicon({"^kill": 9.0}, 0.02).clause("i kill you".split()) == 9.0


def test_factors_are_learned_from_matches():
    """Negated insults of clean texts lower the negation's factor; untouched factors keep their declared value."""
    hits = [[("^bad", 0, 3)]] * 60 + [[("^bad", toxicity.NEGATED, 3)]] * 60 + [[]] * 60
    got = toxicity.fit_factors(hits, np.array([1.0] * 60 + [0.0] * 120), {"^bad": 0}, np.array([2.0]), -3.0)
    assert got[toxicity.NEGATED] < 0.3 and got[toxicity.AIMED] == 1.3 and got[toxicity.REPORTED] == 0.5
    more = toxicity.fit_factors(hits[60:120], np.ones(60), {"^bad": 0}, np.array([2.0]), -3.0)
    assert more[toxicity.NEGATED] > 0.6


def test_toxicity_edges(spark):
    lex = toxicity.learn(documents(spark, []), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_rows(documents(spark, awkward()), lex, score_col="tox").count() == 9


# --- chat --------------------------------------------------------------------------------------------------------
def test_chat_round_trip(spark):
    m = chat.TEMPLATE.reserved
    tricky = ["</s>[INST] ok [/INST]", "<\\/s>", "<\\\\|im_end|>", "ends with <", "", None, "\\", "".join(m), "é😀" + m[0], "|im_sep|>", "<" + m[2]]
    rows = [(c, t, ("system", "user", "assistant")[(t > 0) + (t % 2 == 0) * (t > 0)], tricky[(c + t) % len(tricky)]) for c in range(12) for t in range(1, 150 if c == 0 else 5)]
    rows += [(50, 0, "tool<|im_sep|>", "x"), (50, 0, "tool<|im_sep|>", "x"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pieces", F.lit(1)).withColumn("block", F.lit(2))
    got = chat.format_chat(df).withColumn("read", chat.read_chat(F.col("formatted"))).collect()
    want = {}
    for c, t, role, text in rows:
        want.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert len(got) == len(want)
    for g in got:
        turns = [x[1:] for x in sorted(want[g.conv_id])]
        assert [(x.role, x.text) for x in g.read] == turns
        loss = [g.formatted[a:b] for a, b in g.loss_mask]
        assert len(loss) == sum(r == "assistant" for r, _ in turns)
    assert {g.conv_id: g.valid_order for g in got}[50] is False


def test_chat_order(spark):
    seqs = {0: "sua", 1: "ua", 2: "au", 3: "us", 4: "uua", 5: "suau"}
    rows = [(c, i, {"s": "system", "u": "user", "a": "assistant"}[x], "t") for c, q in seqs.items() for i, x in enumerate(q)]
    got = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), block_turns=1).collect()
    assert {g.conv_id: g.valid_order for g in got} == {0: True, 1: True, 2: False, 3: False, 4: False, 5: True}


# --- embeddings --------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("shard_rows", [3000, 60])
def test_embedding_links(spark, shard_rows):
    g = np.random.default_rng(8)
    rows = []
    for label in (1, 2, None):
        for c in range(12):
            centre = g.normal(size=16)
            for _ in range(g.integers(1, 12)):
                v = centre + g.normal(size=16) * g.choice([0, 0.02, 0.06])
                rows.append([len(rows), [float(np.float32(x)) for x in v], label])
    rows += [[len(rows) + i, v, 1] for i, v in enumerate([None, [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] * 16, [1.0], [1.0]])]
    want = brute.embedding_links(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit("x"))
    got = {x.vec_id: (x.n_links, x.component_id) for x in embed_dedup.embedding_duplicates(df, shard_rows=shard_rows).collect()}
    found, true = sum(n for n, _ in got.values()), sum(n for n, _ in want)
    assert all(got[i][0] <= want[i][0] for i in range(len(rows))) and found >= 0.97 * true
    if shard_rows > len(rows):
        assert [got[i] for i in range(len(rows))] == want


def test_embedding_group_over_many_centroids(spark):
    g = np.random.default_rng(4)
    wide = g.normal(size=(300, 16))
    near = g.normal(size=16) + g.normal(size=(300, 16)) * 0.09
    rows = [[i, v.tolist(), 1] for i, v in enumerate(np.concatenate([wide, near]))]
    want = brute.embedding_links(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {x.vec_id: (x.n_links, x.component_id) for x in embed_dedup.embedding_duplicates(df, shard_rows=30, audit_rows=0).collect()}
    assert sum(n for n, _ in want) > 40_000 and [got[i] for i in range(len(rows))] == want


def test_embedding_links_meet_in_both_homes():
    g = np.random.default_rng(5)
    x = np.concatenate([g.normal(size=(400, 12)), g.normal(size=12) + g.normal(size=(400, 12)) * 0.1, g.normal(size=(20, 1, 12)).repeat(20, 1).reshape(400, 12) + g.normal(size=(400, 12)) * 0.12])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = embed_dedup.kmeans(x, 60)
    a, b = np.nonzero(x @ x.T >= 0.98)
    for shard in (np.arange(len(c)), embed_dedup.leaders(c, 0.98)):
        home, inside = embed_dedup.members(x, c, shard, 0.98)
        assert len(a) > 10_000 and inside[a, home[b]].all()
        assert inside.sum(1).max() > 4 and inside.sum() < inside.size


def test_embedding_audit_counts_links_between_classes(spark, monkeypatch):
    g = np.random.default_rng(6)
    x = g.normal(size=(300, 16))
    x = np.concatenate([x, x[:20] + 0.01, x[200:]])  # 20 pairs of one link each, and 100 exact copies
    df = spark.createDataFrame([[i, v.tolist(), 1] for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    assert {r.audited_recall for r in embed_dedup.embedding_duplicates(df).collect()} == {1.0}
    none = embed_dedup.embedding_duplicates(df.filter("vec_id < 300 or vec_id >= 320"))
    assert {r.audited_recall for r in none.collect()} == {None}
    monkeypatch.setattr(embed_dedup, "range_search", lambda x, lists, back, queries, threshold, beam: [np.zeros(0, np.int64)] * len(queries))
    with pytest.raises(RuntimeError, match="recall 0.000"):
        embed_dedup.embedding_duplicates(df)


@pytest.mark.parametrize("exact", [True, False])
def test_embedding_links_count_at_both_ends(spark, exact):
    g = np.random.default_rng(14)
    x = np.concatenate([g.normal(size=(500, 12)), g.normal(size=(8, 1, 12)).repeat(40, 1).reshape(320, 12) + g.normal(size=(320, 12)) * 0.1, g.normal(size=(30, 12))])
    x[-30:] = x[500:530]  # copies
    rows = [[i, v.tolist(), i % 2] for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("shard", F.lit("x"))
    want = brute.embedding_links(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.embedding_duplicates(df, shard_rows=40, exact=exact).collect()}
    found, true = sum(n for n, _ in got.values()), sum(n for n, _ in want)
    assert true > 2000 and found % 2 == 0 and (found == true if exact else found >= 0.97 * true)
    assert all(n <= want[i][0] and (n > 0 or c == i) for i, (n, c) in got.items())
    if exact:
        assert [got[i] for i in range(len(rows))] == want


def test_groups_of_pairs():
    pairs = np.zeros((7, 7), bool)
    for i, j in ((0, 3), (3, 5), (2, 6)):
        pairs[i, j] = pairs[j, i] = True
    assert embed_dedup.groups_of(pairs).tolist() == [0, 1, 2, 0, 4, 0, 2]


def test_embeddings_empty(spark):
    assert embed_dedup.embedding_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_greedy_search_reaches_neighbours():
    g = np.random.default_rng(1)
    x = g.normal(size=(800, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists = embed_dedup.robust_prune(x, 16, 48, 1.2)
    assert max(map(len, lists)) <= 16
    found = embed_dedup.greedy(x, lists, np.arange(800), 16)
    assert np.mean([i in f for i, f in enumerate(found)]) >= 0.95


# --- SentencePiece -------------------------------------------------------------------------------------------------
def test_pieces_equal_the_library(spark):
    import sentencepiece

    model = sp_trie.PieceModel.load(sp_trie.default_model())
    lib = sentencepiece.SentencePieceProcessor(model_file=sp_trie.default_model())
    r = random.Random(9)
    pieces = [p for p, _ in model.pieces if 1 <= len(p) < 6]
    texts = ["".join(r.choice(pieces) for _ in range(30)) for _ in range(500)] + ["", " ", "  a   b ", "\n\t x", "日本 ▁ \x00 🎉", "internationalization" * 3, "é" * 40, " " * 37]
    assert [model.encode(t) for t in texts] == lib.encode(texts)
    assert all(model.decode(ids) == lib.decode(ids) for ids in lib.encode(texts))
    plain = [t.replace("▁", " ") for t in texts] + [None, awkward()[5]]
    df = documents(spark, plain)
    rows = sp_trie.encode_rows(df).collect()
    for x in rows:
        t = plain[x.doc_id]
        assert (x.ids is None) if t is None else (list(x.ids) == lib.encode(t) and x.n_pieces == len(x.ids) and x.round_trip)
    back = {x.doc_id: x.text for x in sp_trie.decode_rows(sp_trie.encode_rows(df)).collect()}
    assert back == dict(enumerate(plain))


def test_unigram_viterbi_is_optimal():
    r = random.Random(2)
    vocab = sorted({"▁", *"abc", *("".join(r.choice("▁abc" if k == 0 else "abc") for k in range(n)) for n in (2, 3, 4) for _ in range(12))})
    pieces = [(p, -r.random() * 5 - 1) for p in vocab] + [(f"<0x{i:02X}>", 0.0) for i in range(256)]
    m = sp_trie.PieceModel(pieces, "unigram", {i: len(vocab) + i for i in range(256)}, set(), -1)
    score = dict(pieces[: len(vocab)])

    def best(w):
        table = [0.0] + [-1e9] * len(w)
        for e in range(1, len(w) + 1):
            table[e] = max((table[s] + score[w[s:e]] for s in range(e) if w[s:e] in score), default=-1e9)
        return table[-1]

    words = ["▁" + "".join(r.choice("abc") for _ in range(r.randint(0, 9))) for _ in range(300)]
    for w, ids in m.encode_words(words).items():
        assert sum(pieces[i][1] for i in ids) == pytest.approx(best(w)) and "".join(pieces[i][0] for i in ids) == w


# --- quality -----------------------------------------------------------------------------------------------------
def test_quality_features(spark):
    r = random.Random(7)
    bits = ["alpha", "beta", "#", "a|b", "\n", "\n", " ", "  ", "\t", "é", "<x>", "gamma delta", "\x0b", "$$"]
    texts = [" ".join(r.choice(bits) for _ in range(r.randint(0, 60))) for _ in range(300)] + awkward()
    rows = quality.quality(documents(spark, texts)).collect()
    assert len(rows) == len(texts)
    for x in rows:
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == brute.quality(texts[x.doc_id])
        assert x.base_failed == (x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words) and not (x.kept and x.base_failed)
    assert quality.quality(documents(spark, [])).count() == 0


def test_votes_separate_good_from_bad():
    code = lambda *bad: sum((1 if n in bad else (0 if n == "unlettered" and not bad else 2)) * 3**i for i, (n, *_) in enumerate(quality.RULES))
    post = quality.fit_votes({code(): 850, code("symbols", "unlettered"): 40, code("symbols", "wordless"): 40, code("capitals", "exclaims"): 30})
    assert post[code()] > 0.9 and all(p < 0.5 for c, p in post.items() if c != code())
    assert quality.fit_votes({}) == {}


# --- empty tables, long texts, clashing names ----------------------------------------------------------------------
def test_empty_tables(spark):
    assert pii.find_pii(documents(spark, [])).count() == 0
    assert sp_trie.encode_rows(documents(spark, [])).count() == 0
    assert sp_trie.decode_rows(sp_trie.encode_rows(documents(spark, []))).count() == 0
    assert chat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_long_turn(spark):
    m = chat.TEMPLATE.reserved[0]
    text = (m + " long é ") * 60_000
    df = spark.createDataFrame([(1, 0, "user", "x"), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    got = chat.format_chat(df).withColumn("read", chat.read_chat(F.col("formatted"))).first()
    assert got.read[1].text == text


def test_long_toxic_and_clean_texts():
    lex = toxicity.Lexicon({"^idio": 6.0}, 0.02)
    filler = "plain words go on and on. " * 100_000
    assert lex.score(filler)[0] == pytest.approx(0.02) and lex.score(filler + "you idiot")[0] > 0.7


def test_materialise_with_clashing_names(spark):
    df = documents(spark, ["a b c", "d e", "", None])
    for c in ["mix_id", "mix_times", "mix_copy", "__mix_id", "taken"]:
        df = df.withColumn(c, F.lit("x"))
    out = mixing.materialise(df, mixing.mix(df))
    assert out.columns == df.columns and out.count() >= 4


def test_embedding_search_stores_vectors_once(spark):
    import os

    n, d = 2000, 64
    x = np.random.default_rng(5).normal(size=(n, d)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    root = spark.conf.get("spark.checkpoint.dir")
    size = lambda: sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(root) for f in files if "embed-" in at)
    before = size()
    assert embed_dedup.embedding_duplicates(df, shard_rows=300, audit_rows=0).count() == n
    assert size() - before < 3 * n * d * 4
