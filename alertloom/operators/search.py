"""Hybrid retrieval: vector, exact and lexical branches over the two stores, merging, source diversity, re-ranking
and evidence annotation, for all queries of a batch in one job.

Corpora have (id, source, content, vector, ts, severity) and may have metadata columns. Queries have (query_id, query,
vector, terms array<struct<type, term>>). A query batch is mostly small (the representatives of one report) and then held
as a local relation; a larger one stays a table, is sent to tasks in blocks only, and meets indexes by joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as K
from pyspark.sql.pandas.types import to_arrow_schema

from alertloom.functions import text as T
from alertloom.operators.text_index import TextIndex
from alertloom.operators.vector_index import VectorIndex

#: Branch scores by source.
EXACT_SCORE = {"archive": 1.25, "custom_document": 1.15}
LEXICAL_SCORE = {"archive": (0.35, 1.1), "custom_document": (0.30, 1.05)}
MULTIPLIER, THRESHOLD = 4, 0.2
MOST_QUERIES, MOST_LEXEMES = 1000, 20_000
#: Queries of a block that is sent to every task; pairs compared at once; how far a matrix product may be from the cosine.
BLOCK_QUERIES, PAIRS, NEAR = 20_000, 4_000_000, 1e-9
STRONG = ("high", "medium")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity of two arrays in double precision; NULL for a zero vector. Norms may be given where they are known."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot / F.nullif((norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b), F.lit(0.0))


def held(queries: DataFrame) -> DataFrame:
    """A small query batch as a local relation, computed once; a larger one as it is, so none of its queries is left out."""
    rows = queries.limit(MOST_QUERIES + 1).collect()
    return queries if len(rows) > MOST_QUERIES else queries.sparkSession.createDataFrame(rows, queries.schema)


def blocks(queries: DataFrame) -> Iterator[DataFrame]:
    """The queries in local relations of bounded size, however many there are."""
    rows = iter(queries.toLocalIterator())
    while block := list(islice(rows, MOST_QUERIES)):
        yield queries.sparkSession.createDataFrame(block, queries.schema)


def vector_blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(ids, vectors, norms) of the queries in blocks of one width and bounded size; queries without a direction find nothing."""
    of: dict[int, tuple[list, list]] = {}
    for row in queries.select("query_id", "vector").toLocalIterator():
        v = np.array([np.nan if x is None else x for x in row.vector or ()], np.float64)
        if np.isfinite(v).all() and v.any():
            ids, vectors = of.setdefault(len(v), ([], []))
            ids.append(row.query_id)
            vectors.append(v)
            if len(ids) == BLOCK_QUERIES:
                yield ids, np.stack(vectors), norms(np.stack(vectors))
                del of[len(v)]
    for ids, vectors in of.values():
        yield ids, np.stack(vectors), norms(np.stack(vectors))


def norms(m: np.ndarray) -> np.ndarray:
    """norm() of each row: the terms are added in the same order, so the result is the same to the last digit."""
    total = np.zeros(len(m))
    for j in range(m.shape[1]):
        total += m[:, j] * m[:, j]
    return np.sqrt(total)


def cosines(a: np.ndarray, b: np.ndarray, norm_a: np.ndarray, norm_b: np.ndarray) -> np.ndarray:
    """cosine() of each row of a with that of b, the same to the last digit."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total / (norm_a * norm_b)


def _directed(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of a batch whose vector has the width and a direction, their vectors, their norms)."""
    column = batch.column("vector")
    fits = np.flatnonzero(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == width)
    m = column.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fits), width)
    good = np.isfinite(m).all(1) & m.any(1)
    return fits[good], m[good], norms(m[good])


def _compared(corpus: DataFrame, queries: DataFrame, schema: K.StructType, task) -> DataFrame:
    """The results of task(ids, vectors, norms of a block, batches) for each block of queries."""
    found = corpus.sparkSession.createDataFrame([], schema)
    for block in vector_blocks(queries):
        found = found.unionByName(corpus.mapInArrow(lambda batches, block=block: task(*block, batches), schema))
    return found


def count_similar(corpus: DataFrame, queries: DataFrame, threshold: float) -> DataFrame:
    """(query_id, n): how many rows are at least so similar, for queries with any; a task sends one number for each query."""
    schema = K.StructType([K.StructField("query_id", queries.schema["query_id"].dataType), K.StructField("n", K.LongType())])
    arrow = to_arrow_schema(schema)

    def task(ids, asked, asked_norms, batches):
        n = np.zeros(len(ids), np.int64)
        units = asked / asked_norms[:, None]
        for batch in batches:
            _, there, there_norms = _directed(batch, asked.shape[1])
            step = max(1, PAIRS // max(1, len(there)))
            for a in range(0, len(ids), step):
                s = units[a : a + step] @ (there / there_norms[:, None]).T
                n[a : a + step] += (s >= threshold + NEAR).sum(1)
                q, r = np.nonzero(np.abs(s - threshold) < NEAR)
                exact = cosines(there[r], asked[q + a], there_norms[r], asked_norms[q + a]) >= threshold
                np.add.at(n, q[exact] + a, 1)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in some], arrow.field(0).type), pa.array(n[some])], schema=arrow)

    return _compared(corpus.select("vector"), queries, schema, task).groupBy("query_id").agg(F.sum("n").alias("n"))


def nearest(corpus: DataFrame, queries: DataFrame, k: int, threshold: float | None = None, group: str | None = None, digits: int | None = None) -> DataFrame:
    """(query_id, [group,] id, semantic_score): the k nearest rows of each query, and of each group of rows if one is named, by
    comparing all. Scores count to `digits` digits, equal ones go by id; only the best k leave a task."""
    group_kind = [K.StructField("group", corpus.schema[group].dataType)] if group else []
    schema = K.StructType([K.StructField("query_id", queries.schema["query_id"].dataType), *group_kind, K.StructField("id", corpus.schema["id"].dataType), K.StructField("semantic_score", K.DoubleType())])
    arrow, near = to_arrow_schema(schema), NEAR + (10.0**-digits if digits is not None else 0)
    shown = lambda s: np.round(s, digits) if digits is not None else s

    def best(q: np.ndarray, g: np.ndarray, at: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Of pairs, the first k of each query and group; `at` is their order by id."""
        order = np.lexsort((at, -shown(score), g, q))
        new = np.append(True, (np.diff(q[order]) != 0) | (np.diff(g[order]) != 0))[: len(order)]
        place = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        return order[place < k]

    def task(ids, asked, asked_norms, batches):
        units, names, kept = asked / asked_norms[:, None], {}, None
        for batch in batches:
            fits, there, there_norms = _directed(batch, asked.shape[1])
            if not len(fits):
                continue
            of = batch.column("group").take(pa.array(fits)).to_pylist() if group else [None] * len(fits)
            g = np.array([names.setdefault(x, len(names)) for x in of])
            row_ids = batch.column("id").take(pa.array(fits)).to_pandas()
            step, found = max(1, PAIRS // len(fits)), []
            for a in range(0, len(ids), step):
                s = units[a : a + step] @ (there / there_norms[:, None]).T
                for x in np.unique(g):
                    inside = np.flatnonzero(g == x)
                    part = s[:, inside]
                    least = np.partition(part, -k, axis=1)[:, -k] - 2 * near if len(inside) > k else np.full(len(part), -np.inf)
                    q, r = np.nonzero(part >= (least if threshold is None else np.maximum(least, threshold - NEAR))[:, None])
                    r = inside[r]
                    score = cosines(there[r], asked[q + a], there_norms[r], asked_norms[q + a])
                    fine = np.ones(len(q), bool) if threshold is None else score >= threshold
                    found.append(pd.DataFrame({"q": q[fine] + a, "g": g[r[fine]], "id": row_ids.to_numpy()[r[fine]], "score": score[fine]}))
            both = pd.concat(found if kept is None else [kept, *found], ignore_index=True)
            kept = both.iloc[best(both.q.to_numpy(), both.g.to_numpy(), both.id.rank(method="first").to_numpy(), both.score.to_numpy())]
        if kept is not None and len(kept):
            values = list(names)
            columns = [[ids[i] for i in kept.q], *([[values[i] for i in kept.g]] if group else []), kept.id, kept.score]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    rows = _compared(corpus.filter(F.col("vector").isNotNull()).select("id", "vector", *([F.col(group).alias("group")] if group else [])), queries, schema, task)
    score = F.col("semantic_score") if digits is None else F.round("semantic_score", digits)
    rank = F.row_number().over(W.partitionBy("query_id", *(["group"] if group else [])).orderBy(F.desc(score), "id"))
    rows = rows.withColumn("__n", rank).filter(F.col("__n") <= k).drop("__n")
    return rows.withColumnRenamed("group", group) if group else rows


def top_per_query(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).filter(F.col("__n") <= k).drop("__n")


def metadata_filter(corpus: DataFrame, min_severity: int | None = None, since: Column | None = None, embedded: bool = False) -> DataFrame:
    """Filters of the archive, written so that they reach the scan."""
    if embedded:
        corpus = corpus.filter(F.col("vector").isNotNull())
    if min_severity is not None:
        corpus = corpus.filter(F.col("severity") >= min_severity)
    return corpus.filter(F.col("ts") >= since) if since is not None else corpus


def similar(corpus: DataFrame, queries: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """corpus's columns with query_id and semantic_score, for every query and row that are at least so similar.

    Every query meets every row in blocks (a stated query set against all rows), each block of queries broadcast.
    """
    # norms are taken once a row and once a query, not once a pair; a generator keeps them from being moved into the join
    there = corpus.filter(F.col("vector").isNotNull()).select("*", F.inline(F.array(F.struct(norm(F.col("vector")).alias("__n")))))
    found = None
    for block in blocks(queries.select("query_id", F.col("vector").alias("__q"))):
        block = block.withColumn("__qn", norm(F.col("__q")))
        rows = there.join(F.broadcast(block)).withColumn("semantic_score", cosine(F.col("vector"), F.col("__q"), F.col("__n"), F.col("__qn"))).filter(F.col("semantic_score") >= threshold)
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = there.limit(0).withColumns({"query_id": F.lit(None).cast(queries.schema["query_id"].dataType), "semantic_score": F.lit(None).cast("double")})
    return found


def semantic(corpus: DataFrame, queries: DataFrame, k: int, threshold: float = THRESHOLD) -> DataFrame:
    """(query_id, source, id, content, score, semantic_score): the nearest rows of each query above the threshold, by comparing all;
    only the best k per task and query leave a task."""
    found = top_per_query(similar(corpus, queries, threshold), k, F.desc("semantic_score"), F.asc("id"))
    return found.select("query_id", "source", "id", "content", F.col("semantic_score").alias("score"), "semantic_score")


def semantic_indexed(corpus: DataFrame, index: VectorIndex, queries: DataFrame, k: int, threshold: float = THRESHOLD) -> DataFrame:
    """As semantic(), through an index of the corpus by id; a filtered corpus may leave fewer than k rows."""
    near = index.search(queries.select("query_id", "vector"), k, threshold=threshold).select("query_id", "id", "score")
    return near.join(hashed(corpus).select("source", "id", "content", "content_hash"), "id").select("query_id", "source", "id", "content", "content_hash", "score", F.col("score").alias("semantic_score"))


def exact(corpus: DataFrame, queries: DataFrame, k: int, kinds: tuple[str, ...] = tuple(T.EXTRACTORS)) -> DataFrame:
    """Rows whose typed indicators hold a term of the query, newest first, with the matched terms as evidence.

    Indicators are extracted once per row and exploded, so the match is an equi-join on (type, value). The refanged
    text is searched only where it differs.
    """
    terms = held(queries.select("query_id", "terms")).select("query_id", F.explode("terms").alias("t")).select("query_id", F.col("t.type").alias("type"), F.lower(F.trim(T.refang(F.col("t.term")))).alias("value"), F.col("t.term").alias("term")).distinct()
    asked = [r.value for r in terms.filter("value is not null").select("value").distinct().limit(MOST_QUERIES + 1).collect()]

    def typed(texts: Column) -> Column:
        def of(kind: str) -> Column:
            # kinds without a pattern of their own (rule numbers, signatures) are compared as tokens
            pick = T.EXTRACTORS.get(kind, T.tokens)
            found = F.transform(F.flatten(F.transform(texts, lambda t: pick(t))), F.lower)  # an extractor may take more than the text
            if len(asked) <= MOST_QUERIES:  # what no query asks for is left out before the rows are made
                found = F.filter(found, lambda v: v.isin(asked))
            return F.transform(F.array_distinct(found), _typed(kind))

        return F.concat(*[of(kind) for kind in kinds])

    texts = F.array_distinct(F.array(F.col("content"), T.refang(F.col("content"))))
    few = terms.limit(MOST_LEXEMES + 1).count() <= MOST_LEXEMES
    left = corpus.withColumn("__a", F.explode(T.let(texts, typed))).select("source", "id", "content", "ts", F.col("__a.type").alias("type"), F.col("__a.value").alias("value"))
    hits = left.join(F.broadcast(terms) if few else terms, ["type", "value"]).groupBy("query_id", "source", "id").agg(F.first("content").alias("content"), F.first("ts").alias("ts"), F.slice(F.array_sort(F.collect_set(F.concat_ws(":", "type", "term"))), 1, 6).alias("match_evidence"))
    hits = top_per_query(hits, k, F.desc_nulls_last("ts"), F.asc("id"))
    score = F.when(F.col("source") == "archive", EXACT_SCORE["archive"]).otherwise(EXACT_SCORE["custom_document"])
    return hits.select("query_id", "source", "id", "content", score.alias("score"), "match_evidence")


def _typed(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value"))


def lexeme_blocks(queries: DataFrame) -> Iterator[list[Row]]:
    """Blocks of (query_id, lexemes, anchor) of bounded size; the longest lexeme is the anchor a query is joined on."""
    lexemes = T.words(F.col("query"))
    rows = queries.select("query_id", lexemes.alias("lexemes")).filter(F.size("lexemes") > 0)
    anchor = F.array_max(F.transform("lexemes", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    block, held = [], 0
    for row in rows.withColumn("anchor", anchor).toLocalIterator():
        if block and (len(block) >= MOST_QUERIES or held + len(row.lexemes) > MOST_LEXEMES):
            yield block
            block, held = [], 0
        block.append(row)
        held += len(row.lexemes)
    if block:
        yield block


def _lexical_block(corpus: DataFrame, block: list[Row], query_type: str) -> DataFrame:
    """A text is tokenised once and cut to the words some query asks for; it meets the queries whose anchor it holds.

    The rank stands in for a cover-density rank: 0.1 per word that is a lexeme of the query, over 1 + log2 of the words.
    """
    wanted, anchors = sorted({w for r in block for w in r.lexemes}), sorted({r.anchor for r in block})
    words = F.regexp_extract_all(F.lower(F.coalesce("content", F.lit(""))), F.lit(r"(?U)[\w]+"), F.lit(0))
    cut = T.let(words, lambda t: F.struct(F.size(t).alias("n_words"), F.filter(t, lambda w: w.isin(wanted)).alias("asked")))
    # a generator holds what is above it back, which would otherwise repeat the tokenising
    texts = corpus.select("source", "id", "content", F.inline(F.array(cut)))
    held = F.filter(F.array_distinct("asked"), lambda w: w.isin(anchors))
    texts = texts.select("*", F.explode(held).alias("anchor"))
    q = corpus.sparkSession.createDataFrame(block, f"query_id {query_type}, lexemes array<string>, anchor string")
    rows = texts.join(F.broadcast(q), "anchor").filter(F.size(F.array_except("lexemes", "asked")) == 0)
    hits = F.size(F.filter("asked", lambda w: F.array_contains("lexemes", w)))
    return rows.select("query_id", "source", "id", "content", (0.1 * hits / (1 + F.log2(F.greatest("n_words", F.lit(1))))).alias("lexical_score"))


def matching(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, source, id, content, lexical_score) of all rows that hold every lexeme of a query; without a lexeme, none."""
    query_type = queries.schema["query_id"].dataType.simpleString()
    found = None
    for block in lexeme_blocks(queries):
        rows = _lexical_block(corpus, block, query_type)
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = corpus.limit(0).select(F.lit(None).cast(query_type).alias("query_id"), "source", "id", "content", F.lit(None).cast("double").alias("lexical_score"))
    return found


def lexical(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The best k of matching() for each query."""
    return _lexical_scored(top_per_query(matching(corpus, queries), k, F.desc("lexical_score"), F.asc("id")))


def lexical_indexed(corpus: DataFrame, index: TextIndex, queries: DataFrame, k: int) -> DataFrame:
    """As lexical(), from an index's postings and ranked by cover density; the metadata of the index counts as text."""
    best = index.search(queries.select("query_id", "query"), k).select("query_id", "source", "id", "row", "lexical_score")
    rows = hashed(corpus).withColumn("row", index.row_of(corpus)).select("source", "id", "row", "content", "content_hash").dropDuplicates(["source", "id", "row"])
    return _lexical_scored(best.join(rows, ["source", "id", "row"]).drop("row"), "content_hash")


def _lexical_scored(rows: DataFrame, *more: str) -> DataFrame:
    a, c = LEXICAL_SCORE["archive"], LEXICAL_SCORE["custom_document"]
    score = F.when(F.col("source") == "archive", F.least(F.lit(a[1]), a[0] + F.col("lexical_score"))).otherwise(F.least(F.lit(c[1]), c[0] + F.col("lexical_score")))
    return rows.select("query_id", "source", "id", "content", *more, score.alias("score"), "lexical_score")


def hashed(rows: DataFrame) -> DataFrame:
    """Rows with content_hash; taken before a join, it stands for the content where only that is compared."""
    return rows if "content_hash" in rows.columns else rows.withColumn("content_hash", F.sha2("content", 256))


def merge(candidates: DataFrame) -> DataFrame:
    """One row per (query, source, id, content): best scores, sorted match types, distinct evidence (the first 8 in order)."""
    return hashed(candidates).groupBy("query_id", "source", "id", "content_hash").agg(
        F.first("content").alias("content"),
        F.max("score").alias("score"),
        F.max("semantic_score").alias("semantic_score"),
        F.max("lexical_score").alias("lexical_score"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("match_types")))).alias("match_types"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("match_evidence")))), 1, 8).alias("match_evidence"),
    )


def diversify(results: DataFrame, k: int) -> DataFrame:
    """At most (2k + 2) // 3 rows of a source first, then the best of the rest, k in all."""
    cap = max(1, (2 * k + 2) // 3)
    order = [F.desc("score"), F.asc("source"), F.asc("id")]
    per = F.row_number().over(W.partitionBy("query_id", "source").orderBy(*order))
    ranked = results.withColumn("__late", (per > cap).cast("int"))
    n = F.row_number().over(W.partitionBy("query_id").orderBy("__late", *order))
    return ranked.withColumn("rank", n).filter(F.col("rank") <= k).drop("__late")


def hybrid_search(corpora: list[DataFrame], queries: DataFrame, k: int, diverse: bool = True, indexes: list[tuple[VectorIndex | None, TextIndex | None]] | None = None) -> DataFrame:
    """Three branches on each corpus, merged; k rows per query, of which there may be any number. `indexes` gives each corpus its
    vector and text index, or None."""
    take = max(k * MULTIPLIER, k)
    found, queries = None, held(queries)
    kinds = [r.type for r in queries.select(F.explode("terms.type").alias("type")).distinct().limit(100).collect() if r.type]  # the few kinds asked for
    for corpus, (vectors, texts) in zip(corpora, indexes or [(None, None)] * len(corpora), strict=True):
        near = semantic_indexed(corpus, vectors, queries, take) if vectors else semantic(corpus, queries, take)
        worded = lexical_indexed(corpus, texts, queries, take) if texts else lexical(corpus, queries, take)
        for name, rows in (("semantic", near), ("exact", exact(corpus, queries, take, tuple(kinds)) if kinds else None), ("lexical", worded)):
            if rows is None:
                continue
            for c, kind in (("semantic_score", "double"), ("lexical_score", "double"), ("match_evidence", "array<string>")):
                if c not in rows.columns:
                    rows = rows.withColumn(c, F.lit(None).cast(kind))
            evidence = F.when(F.lit(name) == "semantic", F.array(F.format_string("semantic similarity %.3f", F.col("semantic_score")))).otherwise(F.coalesce("match_evidence", F.array().cast("array<string>")))
            rows = rows.withColumn("match_evidence", evidence).withColumn("match_types", F.array(F.lit(name)))
            rows = hashed(rows)
            found = rows if found is None else found.unionByName(rows)
    merged = merge(found)
    if diverse:
        return diversify(merged, k)
    # sums of the same terms in another order differ in their last digits
    return top_per_query(merged, k, F.desc(F.round("score", 9)), F.asc("source"), F.asc("id"))


def merge_queries(found: DataFrame) -> DataFrame:
    """Results of several focused queries as one list: one row per (source, id, content), best score, its queries (3 at most)."""
    return found.groupBy("source", "id", "content_hash").agg(F.first("content").alias("content"), F.max("score").alias("score"), F.array_join(F.slice(F.array_sort(F.collect_set(F.col("query_id").cast("string"))), 1, 3), " || ").alias("queries"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("match_types")))).alias("match_types"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("match_evidence")))), 1, 8).alias("match_evidence"))


# --- re-ranking and evidence -------------------------------------------------------------------------------------
def context_score(match_types: Column, lexical_hits: Column, similarity: Column, evidence: Column, severity: Column, source: Column, overlap: Column, disjoint: Column) -> Column:
    """What a retrieved row is ranked by."""
    is_exact = F.array_contains(match_types, "exact")
    return (
        F.when(is_exact, 2.0).otherwise(0.0)
        + 0.18 * F.least(lexical_hits, F.lit(10))
        + 1.2 * F.least(F.greatest(F.coalesce(similarity, F.lit(0.0)), F.lit(0.0)), F.lit(1.5))
        + 0.15 * F.least(evidence, F.lit(5))
        + F.when(severity >= 12, 0.5).when(severity >= 8, 0.25).otherwise(0.0)
        + F.when(source == "custom_document", 0.25).otherwise(0.1)
        + 0.35 * F.least(overlap, F.lit(3))
        - F.when(disjoint & ~is_exact, 0.45).otherwise(0.0)
    )


def context_rank(*parts: Column) -> Column:
    """context_score() as it is shown."""
    return F.round(context_score(*parts), 3)


def overlap(current: Column, document: Column, cap: int = 8) -> Column:
    """Document values that the current alerts hold too, refanged and case-folded."""
    fold = lambda v: F.lower(T.refang(v))
    keys = F.transform(current, fold)
    return F.slice(T.unique(F.filter(document, lambda v: F.array_contains(keys, fold(v)))), 1, cap)


def historical_only(current: Column, document: Column, cap: int = 5) -> Column:
    fold = lambda v: F.lower(T.refang(v))
    keys = F.transform(current, fold)
    return F.slice(F.filter(document, lambda v: ~F.array_contains(keys, fold(v))), 1, cap)


def reliability(source: Column, validated: Column) -> Column:
    return F.when(F.coalesce(validated, F.lit(False)), "analyst_approved_historical_report").when(source == "archive", "local_security_telemetry").when(source == "custom_document", "uploaded_cti_document").otherwise(source)


def evidence_strength(match_types: Column, overlaps: Column, malicious: Column, non_attacker: Column) -> Column:
    has = lambda t: F.array_contains(match_types, t)
    some = overlaps > 0
    return F.when((has("exact") & some & ~non_attacker) | (malicious & some), "high").when(has("exact") | (overlaps >= 2) | (has("lexical") & some), "medium").otherwise("low")


def cautions(source: Column, match_types: Column, overlaps: Column, labels: Column, non_attacker: Column, mismatch: Column, quality: Column, warnings: Column, strength: Column) -> Column:
    """Reviewer notes, six at most."""
    uploaded, has = source == "custom_document", lambda t: F.array_contains(match_types, t)
    detail = F.when(F.size(warnings) > 0, F.concat(F.lit(" ("), F.array_join(warnings, ", "), F.lit(")"))).otherwise("")
    notes = (
        (uploaded, F.lit("uploaded CTI is historical/contextual unless current alert has exact overlap")),
        (has("semantic") & ~has("exact"), F.lit("semantic-only support; do not use alone for attribution")),
        (overlaps == 0, F.lit("no exact current-alert IoC overlap")),
        (uploaded & F.array_contains(labels, "analysis_environment"), F.lit("analysis-environment details may not be malicious infrastructure")),
        (uploaded & F.array_contains(labels, "victim_infrastructure"), F.lit("victim/target infrastructure should not be treated as attacker infrastructure")),
        (non_attacker, F.lit("current overlap is marked benign, victim, or analysis-environment, not attacker infrastructure")),
        (mismatch, F.lit("CTI behavior tags do not align with current alert behavior")),
        (quality.isin("low", "empty"), F.concat(F.lit("source document extraction quality is "), quality, detail)),
        (strength == "low", F.lit("use only for weak background context")),
    )
    return F.slice(F.array_compact(F.array(*[F.when(c, n) for c, n in notes])), 1, 6)


def quality_cap(docs: DataFrame, limit: int, order: list[Column]) -> DataFrame:
    """High and medium evidence first; with any of it at most one weak row, else weak rows fill the limit.

    For the retrieved rows of one report, which a top-k has bounded before: its windows have no finer key than the strength.
    """
    w = W.partitionBy(F.col("evidence_strength").isin(*STRONG)).orderBy(*order)
    ranked = docs.withColumn("__strong", F.col("evidence_strength").isin(*STRONG)).withColumn("__n", F.row_number().over(w))
    n_strong = F.sum(F.col("__strong").cast("int")).over(W.partitionBy(F.lit(0)))
    ranked = ranked.withColumn("__s", n_strong)
    weak_cap = F.when(F.col("__s") > 0, F.least(F.lit(1), F.greatest(F.lit(0), limit - F.col("__s")))).otherwise(limit)
    keep = (F.col("__strong") & (F.col("__n") <= limit)) | (~F.col("__strong") & (F.col("__n") <= weak_cap))
    return ranked.filter(keep).drop("__strong", "__n", "__s")


def keyword_fallback(texts: DataFrame, query: str, k: int = 4, text_col: str = "content") -> DataFrame:
    """Without an index: rows by how many query terms they contain, the first k."""
    terms = F.array(*[F.lit(t) for t in dict.fromkeys(query.lower().split())])
    hits = F.size(F.filter(terms, lambda t: F.contains(F.lower(F.col(text_col)), t)))
    return texts.withColumn("hits", hits).filter("hits > 0").orderBy(F.desc("hits"), "id").limit(k)
