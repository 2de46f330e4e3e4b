"""How far the sources of a language diverge, by DuckDB over shards of terms.

1. Each task counts the terms of its documents by language and source and hands on one row per (language, source, term)
   and COUNT_ENTRIES entries.
2. The counts are hashed into shards by language and term. DuckDB adds up each shard in one streamed SQL query and keeps
   the terms that enough documents of the language hold. The result is written down.
3. The kept terms are dealt anew into shards of about SHARD_ROWS rows of one language, and each shard gets the totals of
   its language's sources. DuckDB computes in SQL every pair's sum over the shard's terms and the shard's best terms.
4. Spark adds the partial pair sums and ranks.

With p = 1 + floor(SCALE * (count + 1) / (N + V)), the distance of two sources sums floor((p - q)**2 / q) over all kept terms. Terms that
a source lacks have one p for all of them, so a shard's sum is (number of terms) * f(both lacking), corrected by a histogram of
counts for terms one side has, and by a join on the term for terms both have. All arithmetic is in integers (128 bits where products
of counts need it), so partial sums add up exactly, whatever the shards.

A document is a row; null texts, languages and sources read as empty strings, repeated rows count each, and a language
or source named '' is one like others. Groups without terms occur, with counts 0; a language without kept terms has all pairs at 0. Ties in
value go by the UTF-8 item. Very long texts are counted whole. An empty table gives an empty result. Only the three named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches

#: Runs of ASCII letters and of any bytes of other characters, of lower-cased UTF-8.
TERM = re.compile(rb"[a-z\x80-\xff]+")
SCALE = 1_000_000_000
#: Entries a task counts before it hands them on; rows of a shard of step 3; DuckDB's memory in a task.
COUNT_ENTRIES, SHARD_ROWS, DUCKDB_MEMORY = 250_000, 200_000, "600MB"
COUNTED = "lang string, source string, term string, n long, docs long"
KEPT = "lang string, source string, term string, n long, leads boolean"
PARTIAL = "lang string, source string, part string, item string, value long"

MERGE_SQL = """
WITH c AS (SELECT lang, term, source, CAST(sum(n) AS BIGINT) AS n, sum(docs) AS docs FROM c0 GROUP BY ALL),
     d AS (SELECT lang, term, min(source) AS lead FROM c GROUP BY ALL HAVING sum(docs) >= $least)
SELECT lang, source, term, n, source = lead AS leads FROM c JOIN d USING (lang, term)
"""

PROBABILITY_SQL = f"CREATE MACRO probability(n, total) AS CAST(1 + (CAST({SCALE} AS HUGEINT) * (n + 1)) // total AS BIGINT)"
DISTANCE_SQL = "CREATE MACRO distance(p, q) AS ((p - q) * (p - q)) // q"
SHARD_SQL = """
CREATE TEMP TABLE s AS SELECT source, total, probability(0, total) AS p0 FROM sources;
CREATE TEMP TABLE k AS SELECT source, term, n, probability(n, s.total) AS p, p0 FROM kept JOIN s USING (source);
CREATE TEMP TABLE h AS SELECT source, p, p0, count(*) AS terms FROM k GROUP BY ALL;
"""
PAIRS_SQL = """
WITH lacking AS (SELECT a.source, b.source AS item, a.p0 AS p, b.p0 AS q FROM s a JOIN s b ON a.source <> b.source),
     parts AS (SELECT source, item, $terms * distance(p, q) AS value FROM lacking
     UNION ALL SELECT h.source, s.source, sum(h.terms * (distance(h.p, s.p0) - distance(h.p0, s.p0))) FROM h JOIN s ON h.source <> s.source GROUP BY ALL
     UNION ALL SELECT s.source, h.source, sum(h.terms * (distance(s.p0, h.p) - distance(s.p0, h.p0))) FROM h JOIN s ON h.source <> s.source GROUP BY ALL
     UNION ALL SELECT a.source, b.source, sum(distance(a.p, b.p) - distance(a.p, b.p0) - distance(a.p0, b.p) + distance(a.p0, b.p0))
               FROM k a JOIN k b ON a.term = b.term AND a.source <> b.source GROUP BY ALL)
SELECT source, 'pair' AS part, item, CAST(coalesce(sum(value), 0) AS BIGINT) AS value FROM parts GROUP BY ALL
"""
TERMS_SQL = """
WITH l AS (SELECT term, probability(sum(n), $total) AS q FROM k GROUP BY term)
SELECT source, 'term' AS part, term AS item, distance(p, q) AS value FROM k JOIN l USING (term) WHERE p > q
QUALIFY row_number() OVER (PARTITION BY source ORDER BY value DESC, term) <= $ranks
"""


def _duckdb():
    """A connection of this task: one thread, bounded memory, no files."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": "", "preserve_insertion_order": False})


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Term counts and document counts by (lang, source) of (lang, source, text)."""
    names = ["lang", "source", "term", "n", "docs"]

    def rows(counts: dict) -> pa.RecordBatch:
        flat = [(*group, term, n, docs[term]) for group, (words, docs) in counts.items() for term, n in words.items()]
        lang, source, term, n, docs = zip(*flat, strict=True)
        term = pa.array(term, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), term, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names)

    counts, held = defaultdict(lambda: (Counter(), Counter())), 0
    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang, source, text in zip(langs, sources, batch.column(2).cast(pa.large_binary()), strict=True):
            terms = TERM.findall(text.as_py().lower())
            words, docs = counts[lang, source]
            held -= len(words)
            words.update(terms)
            docs.update(set(terms))
            held += len(words)
            if held >= COUNT_ENTRIES:
                yield rows(counts)
                counts, held = defaultdict(lambda: (Counter(), Counter())), 0
    if held:
        yield rows(counts)


def _merged(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([(f.name, f.type) for f in first.schema])

        def stream():
            yield first
            yield from batches

        with _duckdb() as con:
            con.register("counted", pa.RecordBatchReader.from_batches(schema, stream()))
            con.execute("CREATE TEMP TABLE c0 AS SELECT lang, term, source, sum(n) AS n, sum(docs) AS docs FROM counted GROUP BY ALL")
            con.unregister("counted")
            yield from con.sql(MERGE_SQL, params={"least": least}).to_arrow_reader(50_000)

    return run


def _compared(ranks: int):
    """(lang, source, part, item, value) of a shard: partial sums of all pairs, and the best `ranks` terms of each source."""

    def run(key: tuple, kept: pa.Table, sources: pa.Table) -> pa.Table:
        lang, shard = (k.as_py() for k in key)
        names = ["lang", "source", "part", "item", "value"]
        schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
        if not kept.num_rows and shard:
            return schema.empty_table()
        with _duckdb() as con:
            con.register("kept", kept.select(["source", "term", "n"]))
            con.register("sources", sources.select(["source", "total"]))
            con.execute(PROBABILITY_SQL)
            con.execute(DISTANCE_SQL)
            con.execute(SHARD_SQL)
            ((terms,),) = con.sql("SELECT count(DISTINCT term) FROM k").fetchall()
            found = [con.sql(PAIRS_SQL, params={"terms": terms}).to_arrow_table()]
            if terms:
                found.append(con.sql(TERMS_SQL, params={"total": sources.column("lang_total")[0].as_py(), "ranks": ranks}).to_arrow_table())
        out = pa.concat_tables([t.select(["source", "part", "item", "value"]).cast(pa.schema(list(schema)[1:])) for t in found])
        return pa.Table.from_arrays([pa.array([lang] * out.num_rows, pa.string()), *out.columns], names)

    return run


def source_divergence(docs: DataFrame, least_docs: int = 3, ranks: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a language its distances from the others (part `pair`)
    and the terms it uses more than the language does (part `term`, the first `ranks`)."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "source-audit")
    filled = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    rows = docs.select(filled(lang_col, "lang"), filled(source_col, "source"), filled(text_col, "text"))
    counted = rows.mapInArrow(_counted, COUNTED)
    kept = scratch.save(counted.repartition("lang", "term").mapInArrow(_merged(least_docs), KEPT), compact=True)
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count_if("leads").alias("terms"))
    groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").na.fill(0, ["n", "terms"])
    whole = Window.partitionBy("lang")
    groups = groups.withColumn("terms", F.sum("terms").over(whole))
    groups = groups.select("lang", "source", F.greatest(F.col("n") + F.col("terms"), F.lit(1)).alias("total"), (F.sum("n").over(whole) + F.col("terms")).alias("lang_total"))  # without terms no total counts
    shards = max(1, -(-kept.count() // SHARD_ROWS))
    dealt = kept.select("lang", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard"), "source", "term", "n")
    copies = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    partial = dealt.groupBy("lang", "shard").cogroup(copies.groupBy("lang", "shard")).applyInArrow(_compared(ranks), PARTIAL)
    # pairs are added up; a term lies in one shard and keeps its value
    merged = partial.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return merged.withColumn("rank", F.row_number().over(order)).filter((F.col("part") == "pair") | (F.col("rank") <= ranks))
