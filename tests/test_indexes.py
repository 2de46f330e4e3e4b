"""Vector and text indexes on small inputs with odd rows, against plain searches."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertloom.operators import search, text_index, vector_index
from alertloom.operators.text_index import TextIndex, cover_density
from alertloom.operators.vector_index import VectorIndex


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- vectors ---------------------------------------------------------------------------------------------------
def cosines(rows, query):
    def good(v):
        return v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    q = np.array(query, np.float32).astype(float)
    out = []
    for i, v in rows:
        if i is not None and good(v):
            v = np.array(v, np.float32).astype(float)
            out.append((i, round(float(q @ v / np.linalg.norm(q) / np.linalg.norm(v)), 9)))
    return sorted(out, key=lambda x: (-x[1], x[0]))


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(1)
    centres = r.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + 0.25 * r.normal(size=8)).tolist()) for i in range(600)]
    rows += [(600 + i, rows[5][1]) for i in range(300)]  # a third of all rows are one vector
    nan, inf = float("nan"), float("inf")
    return rows + [(2000, None), (2001, [0.0] * 8), (2002, [nan] + [1.0] * 7), (2003, [inf] + [1.0] * 7), (2004, [1.0] * 9), (2005, []), (None, [1.0] * 8), (2006, [None] + [1.0] * 7), (7, rows[7][1])]


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index"))
    old = vector_index.PART_ROWS
    vector_index.PART_ROWS = 50
    VectorIndex.build(spark.createDataFrame(vectors, "id long, vector array<double>"), folder, k=5)
    vector_index.PART_ROWS = old
    return VectorIndex.load(spark, folder)


def test_all_lists_give_exact_search(spark, vectors, index, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK_QUERIES", 4)
    asked = spark.createDataFrame([(i, v) for i, v in vectors if i in (0, 1, 5, 7, 77, 2000, 2001, 2002, 2004)], "query_id long, vector array<double>").dropDuplicates(["query_id"])
    got = {}
    for x in index.search(asked, 7, probes=index.lists).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.id, x.score))
    assert set(got) == {0, 1, 5, 7, 77}
    for q, found in got.items():
        want = cosines(vectors, dict(vectors)[q])[:7]
        assert [(r, i) for r, i, _ in sorted(found)] == [(n + 1, i) for n, (i, _) in enumerate(want)]
        assert np.allclose([s for *_, s in sorted(found)], [s for _, s in want], atol=1e-6)


def test_probing_reaches_the_recall_and_prunes_lists(spark, vectors, index):
    asked = spark.createDataFrame([(i, v) for i, v in vectors[:600:7]], "query_id long, vector array<double>")
    assert index.lists == 30 and 1 <= index.probes < index.lists
    (row,) = index.recall(asked, 5).collect()
    assert row.queries == 86 and row.recall >= 0.9 and row.probes == index.probes
    found = index.search(asked, 5)
    found.collect()
    plan = plan_of(found)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    one = index.search(asked.limit(1), 5, probes=2)
    assert re.search(r"PartitionFilters: \[list#\d+ IN \(\d+,\d+\)\]", plan_of(one))
    parts = [r.n for r in index.rows(spark).groupBy("list", "part").agg(F.count("*").alias("n")).collect()]
    assert sum(parts) == 901 and max(parts) < 100


def test_threshold_and_empty_tables(spark, index, vectors, tmp_path):
    asked = spark.createDataFrame([(0, dict(vectors)[0])], "query_id long, vector array<double>")
    assert all(r.score >= 0.9 for r in index.search(asked, 50, threshold=0.9).collect())
    assert index.search(asked.limit(0), 3).count() == 0
    VectorIndex.build(spark.createDataFrame([(1, None)], "id long, vector array<float>"), str(tmp_path))
    nothing = VectorIndex.load(spark, str(tmp_path))
    assert nothing.lists == 0 and nothing.search(asked, 3).count() == 0 and nothing.recall(asked, 3).first().recall == 1.0


# --- texts -----------------------------------------------------------------------------------------------------
def covers_by_hand(lists):
    """All minimal stretches by looking at every pair of ends."""
    at = sorted({p for x in lists for p in x})
    whole = [(a, b) for a in at for b in at if a <= b and all(any(a <= p <= b for p in x) for x in lists)]
    minimal = [(a, b) for a, b in whole if not any((c, d) != (a, b) and a <= c and d <= b for c, d in whole)]
    return sum(0.1 / (1 + (b - a) - (sum(a <= p <= b for x in lists for p in x) - 1)) for a, b in minimal)


@pytest.mark.parametrize("seed", range(40))
def test_cover_density_equals_all_pairs(seed):
    r = random.Random(seed)
    at = r.sample(range(60), r.randint(1, 30))
    lists = [[] for _ in range(r.randint(1, 4))]
    for p in at:
        r.choice(lists).append(p)
    lists = [sorted(x) for x in lists if x]
    assert cover_density([np.array(x) for x in lists]) == pytest.approx(covers_by_hand(lists))


def test_known_ranks():
    at = lambda *p: np.array(p)
    assert cover_density([at(3, 9)]) == pytest.approx(0.2)
    assert cover_density([at(0), at(1)]) == pytest.approx(0.1) and cover_density([at(0), at(3)]) == pytest.approx(0.1 / 3)
    assert cover_density([at(0, 2), at(1)]) == pytest.approx(0.2)


TEXTS = [(1, "alpha beta gamma", None), (2, "Beta x x ALPHA", '{"k": "delta"}'), (3, None, "alpha"), (4, "", None), (5, "alpha " * 3000 + "beta", None), (6, "école Alpha_1", None), (7, "gamma", "alpha beta"), (7, "beta alpha", None), (7, "beta alpha", None), (None, "alpha beta", None)]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [("custom_document", i, c, m) for i, c, m in TEXTS]
    return spark.createDataFrame(rows, "source string, id long, content string, metadata string")


def test_text_search_equals_brute_force(spark, corpus, tmp_path, monkeypatch):
    index = TextIndex.build(corpus, str(tmp_path))
    asked = {1: "alpha beta", 2: "BETA beta", 3: "delta", 4: "", 5: "alpha nowhere", 6: "École", 7: "gamma beta alpha", 8: None}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, query string")
    want = []
    for q, text in asked.items():
        lexemes = set(re.findall(r"\w+", (text or "").lower()))
        for i, c, m in sorted(set(TEXTS), key=repr):
            words = re.findall(r"\w+", f"{c or ''} {m or ''}".lower())
            lists = [[p for p, w in enumerate(words) if w == x] for x in lexemes]
            if i is not None and lists and all(lists):
                want.append((q, i, round(cover_density([np.array(x) for x in lists]), 6)))
    found = index.search(queries)
    assert sorted(((r.query_id, r.id, round(r.lexical_score, 6)) for r in found.collect()), key=repr) == sorted(want, key=repr)
    assert "content" not in plan_of(found) and "NestedLoop" not in plan_of(found)
    best = {r.query_id: (round(r.lexical_score, 6), r.rank) for r in index.search(queries, 1).collect()}
    assert best == {q: (max(v for p, _, v in want if p == q), 1) for q, *_ in want}
    counts = {r.lexeme: (r.texts, r.occurrences) for r in index.lexemes(spark).collect()}
    assert counts["alpha"] == (6, 3005) and counts["beta"] == (5, 5) and counts["alpha_1"] == (1, 1)


def test_empty_text_index(spark, corpus, tmp_path):
    index = TextIndex.build(corpus.limit(0), str(tmp_path))
    assert index.search(spark.createDataFrame([(1, "alpha")], "query_id long, query string"), 3).count() == 0


def test_hybrid_search_through_indexes(spark, tmp_path):
    r = np.random.default_rng(2)
    rows = [("archive", i, f"word{i % 5} common{' extra' * (i % 3)}", None, 0, r.normal(size=8).tolist()) for i in range(40)]
    corpus = spark.createDataFrame(rows, "source string, id long, content string, ts timestamp, severity int, vector array<float>")
    index, texts = VectorIndex.build(corpus, f"{tmp_path}/v"), TextIndex.build(corpus, f"{tmp_path}/t")
    terms = "terms array<struct<type:string,term:string>>"
    queries = spark.createDataFrame([(1, "word1 common", rows[3][5], []), (2, "word2", rows[4][5], [])], f"query_id long, query string, vector array<float>, {terms}")
    through = search.hybrid_search([corpus], queries, 5, indexes=[(index, texts)]).collect()
    plain = search.hybrid_search([corpus], queries, 5).collect()
    kinds = lambda x: {(y.query_id, y.id) for y in x if "lexical" in y.match_types}
    assert {x.query_id for x in through} == {1, 2} and kinds(through) and len(through) == len(plain) == 10
    assert {round(x.lexical_score, 6) for x in through if x.lexical_score is not None} == {text_index.WEIGHT}


@pytest.mark.parametrize("n", [1, 2, 3])
def test_covers_of_many_texts_equal_one_by_one(n):
    r = np.random.default_rng(n)
    texts = [np.array_split(r.permutation(60)[: 8 * n], n) for _ in range(40)]
    lists = [(np.repeat(np.arange(40), [len(t[j]) for t in texts]), np.concatenate([t[j] for t in texts])) for j in range(n)]
    assert text_index._covers(lists, 40).tolist() == [cover_density([np.sort(x) for x in t]) for t in texts]


def test_best_texts_are_found_without_pairs(spark, corpus, tmp_path, monkeypatch):
    index = TextIndex.build(corpus, str(tmp_path / "i"))
    asked = spark.createDataFrame([(i, "alpha beta") for i in range(50)], "query_id long, query string")
    monkeypatch.setattr(TextIndex, "matches", lambda self, queries: pytest.fail("every query meets every posting"))
    assert index.search(asked, 3).count() % 50 == 0


def test_hybrid_scores_alike_go_by_id(spark, tmp_path):
    def text(gaps):
        return " ".join(f"a {'x ' * g}b" + " y" * 40 for g in gaps)

    def score(gaps):
        words = text(gaps).split()
        return 0.3 + cover_density([np.array([i for i, w in enumerate(words) if w == x]) for x in "ab"])

    r, seen = random.Random(1), {}
    while True:  # the same terms in two orders whose sums differ in the last digits
        gaps = [r.randint(0, 9) for _ in range(6)]
        first, other = seen.setdefault(tuple(sorted(gaps)), gaps), gaps
        if score(first) != score(other) and round(score(first), 9) == round(score(other), 9):
            break
        gaps = sorted(gaps)
        first, other = gaps, r.sample(gaps, 6)
        if score(first) != score(other) and round(score(first), 9) == round(score(other), 9):
            break
    low, high = sorted((first, other), key=score)
    rows = [(1, text(low)), (2, text(high))]
    docs = spark.createDataFrame(rows, "id long, content string").select(F.lit("custom_document").alias("source"), "id", "content", F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("array<float>").alias("vector"))
    asked = spark.createDataFrame([(0, "a b", None, [])], "query_id long, query string, vector array<float>, terms array<struct<type:string,term:string>>")
    texts = TextIndex.build(docs, str(tmp_path / "i"))
    assert [x.id for x in search.hybrid_search([docs], asked, 1, diverse=False, indexes=[(None, texts)]).collect()] == [1]


def test_compared_vectors_keep_no_pairs_and_break_ties_by_id(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=8).tolist(), i % 2) for i in range(300)]
    rows += [(300 + i, rows[i % 3][1], 1) for i in range(90)] + [(400, None, 0), (401, [0.0] * 8, 0), (402, [1.0] * 7, 1), (403, [math.nan] * 8, 1)]
    corpus = spark.createDataFrame(rows, "id long, vector array<float>, label int").repartition(5)
    asked = corpus.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    corpus_rows, asked_rows = corpus.filter("id < 400"), asked.filter("query_id < 400")
    pairs = [tuple(x) for x in search.similar(corpus_rows, asked_rows, -2.0).select("query_id", "label", "id", "semantic_score").collect()]

    def best(group, k, least):
        kept = {}
        for x in sorted((x for x in pairs if x[3] >= least), key=lambda x: (-x[3], x[2])):
            kept.setdefault((x[0], group(x)), []).append(x)
        return sorted(x for g in kept.values() for x in g[:k])

    got = search.nearest(corpus, asked, 4, group="label").select("query_id", "label", "id", "semantic_score")
    assert sorted(map(tuple, got.collect())) == best(lambda x: x[1], 4, -2)
    got = search.nearest(corpus, asked, 7, 0.3).select("query_id", "id", "semantic_score")
    assert sorted(map(tuple, got.collect())) == sorted((x[0], x[2], x[3]) for x in best(lambda x: 0, 7, 0.3))
    n = {}
    for x in pairs:
        n[x[0]] = n.get(x[0], 0) + (x[3] >= 0.25)
    counted = search.count_similar(corpus, asked, 0.25)
    assert {x.query_id: x.n for x in counted.collect()} == n and "NestedLoop" not in plan_of(counted)
    assert search.nearest(corpus, asked.limit(0), 4).count() == 0


def test_hybrid_search_takes_more_queries_than_a_local_relation(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(5)
    rows = [("archive", i, f"word{i % 5} common seen at 198.51.100.{i}", None, 0, r.normal(size=8).tolist()) for i in range(40)]
    corpus = spark.createDataFrame(rows, "source string, id long, content string, ts timestamp, severity int, vector array<float>")
    index, texts = VectorIndex.build(corpus, f"{tmp_path}/v"), TextIndex.build(corpus, f"{tmp_path}/t")
    asked = [(i, f"word{i % 5} common", rows[i][5], [("ips", f"198.51.100.{i}")]) for i in range(8)]
    queries = spark.createDataFrame(asked, "query_id long, query string, vector array<float>, terms array<struct<type:string,term:string>>")

    def found(indexes):
        got = search.hybrid_search([corpus], queries, 5, indexes=indexes).collect()
        return sorted((x.query_id, x.id, x.content, x.score, x.match_types, x.match_evidence, x.rank) for x in got)

    want = [found(x) for x in ([(index, texts)], None)]
    for name in ("MOST_QUERIES", "MOST_LEXEMES"):
        monkeypatch.setattr(search, name, 3)
    assert [found(x) for x in ([(index, texts)], None)] == want and len(want[0]) == len(want[1]) == 40


def test_hybrid_indexed_of_more_than_a_thousand_queries(spark, tmp_path):
    from alertloom.plans import catalog

    folder = str(tmp_path)
    spark.range(100_100).selectExpr("id AS doc_id", "concat('w', id % 5000, ' v', id % 5) AS text").write.parquet(f"{folder}/d")
    spark.range(300).selectExpr("id * 100 AS vec_id", "transform(sequence(0, 7), i -> cast(sin(id * (i + 1)) AS float)) AS embedding").write.parquet(f"{folder}/e")
    tables = tmp_path / "in"
    tables.mkdir()
    for name, at in (("documents", "d"), ("embeddings", "e")):
        spark.read.parquet(f"{folder}/{at}").coalesce(1).write.parquet(f"{tables}/{name}")
        (part,) = (tables / name).glob("*.parquet")
        (tables / f"{name}.parquet").hardlink_to(part)
    got = {r.query_id: r for r in catalog.QUERIES["hybrid_indexed"](spark, str(tables)).groupBy("query_id").agg(F.max("rank").alias("most"), F.max("near").alias("near"), F.max("worded").alias("worded")).collect()}
    assert set(got) == set(range(0, 100_100, 100)) and all(r.most == 10 and r.worded for r in got.values())
    assert {q for q, r in got.items() if r.near} <= set(range(0, 30_000, 100))


def test_postings_are_shuffled_packed_and_copies_are_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK_WORDS", 50)
    r = random.Random(6)
    rows = [("s", i, " ".join(r.choice(["alpha", "Beta", "école", f"w{i}"]) for _ in range(r.randint(0, 30)))) for i in range(60)]
    rows += [rows[3], rows[3], ("s", 4, "beta other"), ("t", *rows[5][1:]), ("s", None, "lost"), ("s", 90, None)]
    corpus = spark.createDataFrame(rows, "source string, id long, content string").repartition(3)
    index = TextIndex.build(corpus, str(tmp_path))
    want = {}
    for s, i, c in {x for x in rows if x[1] is not None}:
        for p, w in enumerate(words := re.findall(r"\w+", (c or "").lower())):
            want.setdefault((s, i, w, len(words)), []).append(p)
    got = index.postings(spark)
    assert sorted((x.source, x.id, x.lexeme, x.n_words, list(x.positions)) for x in got.collect()) == sorted((*k, v) for k, v in want.items())
    assert got.filter(F.col("bucket") != text_index.bucket(F.col("lexeme"))).count() == 0
    texts, n = {}, {}
    for (_, i, w, _), at in want.items():
        texts.setdefault(w, set()).add(i)
        n[w] = n.get(w, 0) + len(at)
    for most in (200_000, 0):
        monkeypatch.setattr(text_index, "MOST_KEYS", most)
        assert {x.lexeme: (x.texts, x.occurrences) for x in index.counts(spark).collect()} == {w: (len(t), n[w]) for w, t in texts.items()}
    TextIndex.build(corpus, str(tmp_path / "all"))  # more copies than are broadcast
    assert TextIndex(str(tmp_path / "all")).postings(spark).exceptAll(got).count() == 0 == got.exceptAll(TextIndex(str(tmp_path / "all")).postings(spark)).count()


def test_packed_postings_are_far_smaller_than_words(spark):
    import pyarrow as pa

    r = random.Random(7)
    texts = [[f"w{int(r.paretovariate(0.6))}" for _ in range(300)] for _ in range(4000)]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string())]
    columns = [["custom_document"] * 4000, range(4000), [r.getrandbits(62) for _ in range(4000)], [i % 4 for i in range(4000)], texts]
    batch = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["source", "id", "row", "part", "words"])
    packed = sum(len(b) for x in text_index._blocks(iter([batch])) for b in x.column(1).to_pylist())
    assert packed < sum(len(w) for t in texts for w in t) * 1.5
