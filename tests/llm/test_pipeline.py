"""The pipeline against a plain version, stage by stage."""

import brute
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from alertloom.llm import mixing, secrets, toxicity
from alertloom.llm import sentencepiece_trie as sp_trie

SF = "/root/testdata/sf0.001"


def test_stages_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    lex = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet").filter(~held))
    a = corpus_pipeline.drop_toxic(spark, docs, SF)
    clean = {i: r for i, r in rows.items() if lex.score(r.text)[0] < corpus_pipeline.TOXIC_AT}
    assert a.columns == docs.columns and {r.doc_id for r in a.collect()} == set(clean)

    b = corpus_pipeline.drop_near_duplicates(spark, a, SF)
    want = {i for i, (_, c) in brute.near_duplicates([(i, r.text) for i, r in clean.items()]).items() if i == c}
    assert b.columns == docs.columns and sorted(r.doc_id for r in b.collect()) == sorted(want)

    c = corpus_pipeline.redact_secrets(spark, b, SF)
    got = {r.doc_id: r.text for r in c.collect()}
    assert set(got) == want and not any(brute.secrets(t) for t in got.values())
    assert all(t == rows[i].text for i, t in got.items() if not secrets.find_secrets(rows[i].text))

    d = corpus_pipeline.mix_sources(spark, c, SF).cache()
    plan = {r.doc_id: (r.size, r.taken) for r in mixing.mix(c).collect()}
    times = {}
    for r in d.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
        assert r.text == got[r.doc_id]
    assert d.columns == docs.columns and times == {i: n for i, (s, t) in plan.items() if (n := int(t / s + 0.5) if s else 1)}

    lib = sentencepiece.SentencePieceProcessor(model_file=sp_trie.default_model())
    e = corpus_pipeline.encode(spark, d, SF).collect()
    assert len(e) == sum(times.values()) and all(list(r.ids) == lib.encode(got[r.doc_id]) and r.round_trip for r in e)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_pieces", "ids", "round_trip"] and out.count() > 0


def test_repeated_and_odd_rows(spark):
    rows = [(1, "same words again and again", "en", "s", 5), (1, "same words again and again", "en", "s", 5), (None, None, None, None, None), (2, "", "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("__extra", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns and out.count() >= 3
    assert corpus_pipeline.drop_near_duplicates(spark, df, SF).filter("doc_id = 1").count() == 1
    empty = df.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_shared_ids_and_clashing_names(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(1, long, "en", "s", 5), (1, "quite another text", "en", "s", 5), (2, long, "en", "s", 5), (2, long + " end", "en", "s", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ["__id", "__rows", "__toxicity", "toxicity", "__mix_id", "__mix_times", "row_number", "component", "mix_id"]:
        df = df.withColumn(c, F.lit("x"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, SF).columns == df.columns
    kept = corpus_pipeline.drop_near_duplicates(spark, df, SF).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, "quite another text"), (1, long)]
