"""Line dedup, filter interaction and source divergence on small inputs with odd rows, against plain restatements."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from alertloom.llm import filter_audit, line_dedup, source_audit

SCHEMA = "doc_id long, text string, lang string, source string, mark string, n_lines int, part string, value double"


def frame(spark, rows):
    """(doc_id, text, lang, source) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", 1, "y", 0.5) for r in rows], SCHEMA)


# --- lines -----------------------------------------------------------------------------------------------------
LOWER = {c: c + 32 for c in range(65, 91)}


def line_keys(text):
    return [x.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(LOWER) for x in (text or "").split("\n")]


def lines_by_hand(rows, least):
    """Sorted (doc_id, n_lines, n_dropped, kept text) of [(doc_id, text)]; each row is a document."""
    seen = Counter(k for _, t in rows for k in set(line_keys(t)) if k)
    out = []
    for i, t in rows:
        keep = [x for x, k in zip((t or "").split("\n"), line_keys(t), strict=True) if seen[k] < least]
        n = len(line_keys(t))
        out.append((i, n, n - len(keep), "\n".join(keep)))
    return sorted(out, key=repr)


def odd_lines():
    r = random.Random(3)
    common = ["Share this page", "\tCookies \r", "COOKIES", "École", "école", "a b", "", "   ", "x"]
    rows = [(i, "\n".join(r.choice(common + [f"line {r.randrange(60)}"]) for _ in range(r.randint(1, 12)))) for i in range(60)]
    rows += [(7, "Share this page\nanother text of id 7"), (8, "same row\nx"), (8, "same row\nx"), (None, None), (None, ""), (None, "x\nno id"), (70, "\n\n"), (71, "long " * 50_000 + "\n" + "x\n" * 3000)]
    return rows


@pytest.mark.parametrize("least", [1, 2, 4, 10])
def test_lines_equal_brute_force(spark, least):
    rows = odd_lines()
    docs = frame(spark, [(*r, None, None) for r in rows])
    out = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, least))
    assert out.columns == [*docs.columns, "kept_text", "n_lines_", "n_dropped"]
    got = sorted(((r.doc_id, r.n_lines_, r.n_dropped, r.kept_text) for r in out.collect()), key=repr)
    assert got == lines_by_hand(rows, least)


def test_first_occurrence_stays(spark):
    docs = spark.createDataFrame([(i, f"only {i}\nshared\nshared") for i in range(12)], "doc_id long, text string")
    out = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, 10, keep_first=True))
    assert {r.doc_id: r.kept_text for r in out.collect()} == {i: f"only {i}" + "\nshared" * (i == 0) for i in range(12)}


def test_lines_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs)).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_stretches_and_batches_do_not_change_the_lines(seed):
    """Sorted rows cut anywhere between documents into stretches, and anywhere into batches."""
    r = random.Random(seed)
    least, rows = r.randint(1, 5), []
    for key in range(r.randint(1, 12)):
        for doc in range(r.choice([1, 1, 2, 4, 5, 30])):
            copies = r.choice([1, 1, 1, 3])
            rows += [(key, 0, doc, doc * 7, pos) for pos in range(r.randint(1, 3)) for _ in range(copies)]
    docs = Counter()
    for k, _, d, _, p in rows:
        docs[k] += p == 0
    want = Counter(x for x in rows if docs[x[0]] >= least)
    cuts = sorted({0, len(rows), *[i for i in range(1, len(rows)) if rows[i][:4] != rows[i - 1][:4] and r.random() < 0.2]})
    out, held = [], 0
    for part, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        stretch, at = line_dedup._Stretch(least, part), a
        while at < b:
            to = min(b, at + r.randint(1, 6))
            h1, h2, d, m, p = zip(*rows[at:to], strict=True)
            batch = pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(d), pa.array(m), pa.array(p, pa.int32())], ["h1", "h2", "doc_id", "mark", "pos"])
            out += [x for y in stretch.add(batch) for x in y.to_pylist()]
            held = max(held, stretch.held.num_rows if stretch.held else 0)
            at = to
        out += [x for y in stretch.add(None) for x in y.to_pylist()]
    totals = Counter()
    for x in out:
        if x["state"] != line_dedup.WITHIN:
            totals[x["h1"]] += x["docs"]
    got = Counter((x["h1"], x["h2"], x["doc_id"], x["mark"], x["pos"]) for x in out if x["state"] != line_dedup.OPEN or totals[x["h1"]] >= least)
    assert got == want and held <= 9 * least
    assert sum(x["state"] == line_dedup.OPEN for x in out) <= 2 * len(cuts) * 9 * least


# --- filters ---------------------------------------------------------------------------------------------------
def failures(rows):
    out = []
    for i, t, _, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        f["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _, _ in rows)
        out.append({k for k, v in f.items() if v})
    return out


def test_filters_equal_brute_force(spark):
    r = random.Random(4)
    text = lambda n, vocabulary: " ".join(r.choice(vocabulary) for _ in range(n))
    plain = [f"word{i}" for i in range(400)]
    rows = [(i, text(r.choice([5, 250, 300]), r.choice([plain, plain[:9], ["UPPER", "Lower", *plain]])) + r.choice(["", " #", " $5"]), "en", r.choice(["a", "b", None, ""])) for i in range(40)]
    rows += [(50 + i, rows[i % 3][1], "en", "b") for i in range(8)]
    rows += [(60, None, None, None), (61, "", "", "a"), (None, rows[0][1], "en", "a"), (3, "id 3 again", "en", "a"), (4, rows[4][1], "en", "b"), (70, "Word " * 60_000, "en", "a")]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(30)] + [(2, 1, 1), (None, 1, 1), (6, None, None)]
    marks = defaultdict(lambda: (False, False))
    for i, q, x in labels:
        if i is not None:
            marks[i] = (marks[i][0] or q == 1, marks[i][1] or x == 1)
    want, removed = defaultdict(Counter), Counter()
    for (i, _, _, source), f in zip(rows, failures(rows), strict=True):
        good, toxic = marks[i] if i is not None else (False, False)
        for order in permutations("ABCDE"):
            first = next((k for k, x in enumerate(order, 1) if x in f), 6)
            for k, x in enumerate(order, 1):
                c = want[source or "", "".join(order), k]
                c.update(kept=k < first, removed=k == first, redundant=k > first and x in f, unique_fails=f == {x}, good_lost=k == first and good, toxic_lost=k == first and toxic)
                removed[source or "", x] += k == first
    flags = filter_audit.document_flags(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert flags.count() == len(rows)
    got = filter_audit.replay(flags, list("ABCDE")).collect()
    assert len(got) == len(want) == 600 * 3
    for x in got:
        c = want[x.part, x.filter_order, x.step]
        assert all(x[k] == c[k] for k in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), x
        assert x.shapley == removed[x.part, x.filter_order[x.step - 1]]


def test_filters_of_an_empty_table_and_bounds(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    flags = filter_audit.document_flags(frame(spark, []), labels)
    assert filter_audit.replay(flags, list("ABCDE")).count() == 0
    with pytest.raises(ValueError):
        filter_audit.replay(flags, list("ABCDEFG"))
    one = spark.createDataFrame([("p", True, None, None, True), ("p", None, True, True, None)], "part string, A boolean, B boolean, good boolean, toxic boolean")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.replay(one, ["A", "B"]).collect()}
    assert got == {("AB", 1): (1, 1, 1, 0, 1, 2), ("AB", 2): (0, 1, 1, 1, 0, 2), ("BA", 1): (1, 1, 1, 1, 0, 2), ("BA", 2): (0, 1, 1, 0, 1, 2)}


# --- sources ---------------------------------------------------------------------------------------------------
def divergence(rows, least, ranks):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    found = [(lang or "", source or "", Counter(term.findall((t or "").translate(LOWER)))) for _, t, lang, source in rows]
    out = {}
    for lang in {x[0] for x in found}:
        docs = Counter(t for x, _, c in found if x == lang for t in c)
        kept = [t for t, n in docs.items() if n >= least]
        counts = defaultdict(Counter)
        for x, source, c in found:
            if x == lang:
                counts[source].update({t: n for t, n in c.items() if t in set(kept)})
        total = sum(counts.values(), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        ps, q = {s: p(c) for s, c in counts.items()}, p(total)
        f = lambda a, b: (a - b) ** 2 // b
        for s in ps:
            pairs = [(o, sum(f(ps[s][t], ps[o][t]) for t in kept)) for o in ps if o != s]
            terms = [(t, f(ps[s][t], q[t])) for t in kept if counts[s][t] and ps[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, ranks)):
                for k, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out[lang, s, part, item] = (value, k)
    return out


@pytest.mark.parametrize("least,ranks,entries,shard_rows", [(3, 200, 250_000, 200_000), (1, 2, 7, 10), (2, 5, 50, 60)])
def test_sources_equal_brute_force(spark, monkeypatch, least, ranks, entries, shard_rows):
    monkeypatch.setattr(source_audit, "COUNT_ENTRIES", entries)
    monkeypatch.setattr(source_audit, "SHARD_ROWS", shard_rows)
    r = random.Random(6)
    words = ["the", "The", "año", "Été", "\U0001f600x", "don't", "x9y", *[f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]]
    rows = [(i, " ".join(r.choice(words[: r.choice([5, 67])]) for _ in range(r.randint(0, 30))), r.choice(["en", "de", None]), r.choice(["a", "b", "c", None, ""])) for i in range(80)]
    rows += [(1, "the the", "en", "a")] * 3 + [(None, None, None, None), (90, "", "en", "no terms"), (91, "42 !", "qq", "s"), (92, "once", "qq", "t"), (93, "the " * 50_000, "en", "b"), (94, "alone", "solo", "one")]
    got = {(x.lang, x.source, x.part, x.item): (x.value, x.rank) for x in source_audit.source_divergence(frame(spark, rows), least, ranks).collect()}
    assert got == divergence(rows, least, ranks)


def test_sources_of_an_empty_table(spark):
    assert source_audit.source_divergence(frame(spark, [])).count() == 0


def test_kept_bitmaps_are_small():
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([list(range(0, 100_000, 2))])], ["doc_id", "mark", "at"])
    (out,) = list(line_dedup._packed(iter([batch])))
    assert out.column(3)[0].as_py() == 50_000 and len(out.column(2)[0].as_py()) < 200
    texts = line_dedup._kept_texts(line_dedup.pd.Series(["\n".join(map(str, range(100_001)))]), line_dedup.pd.Series([out.column(2)[0].as_py()]))
    assert texts[0].split("\n") == [str(i) for i in range(1, 100_000, 2)] + ["100000"]
    assert np.array(texts).shape == (1,)
