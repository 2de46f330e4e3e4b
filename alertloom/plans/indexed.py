"""Queries that go through an index or a versioned store built from the given tables, and the SQL each must equal."""

from __future__ import annotations

from dataclasses import replace
from uuid import uuid4

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alertloom.functions import net
from alertloom.operators import search as S
from alertloom.operators import versioned
from alertloom.operators.text_index import TextIndex, sequence
from alertloom.operators.vector_index import VectorIndex
from alertloom.operators.versioned import VersionedTable
from alertloom.plans.alert_view import alerts
from alertloom.plans.registry import documents, query, shared_folder


def _folder(spark, name: str) -> str:
    return shared_folder(spark, f"{name}-{uuid4().hex}")


# --- vectors ---------------------------------------------------------------------------------------------------
def _vectors(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _asked(spark, sf_dir):
    return _vectors(spark, sf_dir).filter("id % 100 = 0").withColumnRenamed("id", "query_id")


@query("""SELECT query_id, id AS nearest, round(s, 6) AS score, least(n, 10) AS found, true AS recalled FROM (SELECT q.vec_id AS query_id, c.vec_id AS id,
  list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s, count(*) OVER (PARTITION BY q.vec_id) AS n,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 12) DESC, c.vec_id) AS i
  FROM embeddings c, embeddings q WHERE q.vec_id % 100 = 0) WHERE i = 1""")
def indexed_topk(spark, sf_dir):
    """Every hundredth vector asks the index for its 10 nearest; `recalled`: they hold 0.9 of the exact 10 over all queries."""
    index = VectorIndex.build(_vectors(spark, sf_dir), _folder(spark, "vector-index"))
    asked = _asked(spark, sf_dir)
    recall = index.recall(asked, 10).select((F.col("recall") >= 0.9).alias("recalled"))
    best = index.search(asked, 10).groupBy("query_id").agg(F.min_by("id", "rank").alias("nearest"), F.round(F.max("score"), 6).alias("score"), F.count("*").alias("found"))
    return best.join(F.broadcast(recall))  # one row


@query()
def index_recall(spark, sf_dir):
    """One row: queries, k, lists, probes and the measured recall."""
    return VectorIndex.build(_vectors(spark, sf_dir), _folder(spark, "vector-index")).recall(_asked(spark, sf_dir), 10)


# --- texts -----------------------------------------------------------------------------------------------------
WORDS_SQL = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"


def _text_index(spark, sf_dir) -> TextIndex:
    corpus = documents(spark, sf_dir).select(F.lit("custom_document").alias("source"), F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return TextIndex.build(corpus, _folder(spark, "text-index"))


@query(f"""WITH t AS (SELECT doc_id, unnest(w) AS lex, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, {WORDS_SQL} AS w FROM documents)),
  q AS (SELECT doc_id AS query_id, list_distinct({WORDS_SQL}[1:3]) AS l FROM documents WHERE doc_id % 100 = 0),
  o AS (SELECT query_id, doc_id, pos, lex, l FROM t JOIN (SELECT *, unnest(l) AS one FROM q) ON lex = one),
  s AS (SELECT *, len(l) AS n, row_number() OVER w AS i, max(CASE WHEN lex = l[1] THEN pos END) OVER w AS p1, max(CASE WHEN lex = l[2] THEN pos END) OVER w AS p2,
    max(CASE WHEN lex = l[3] THEN pos END) OVER w AS p3 FROM o WINDOW w AS (PARTITION BY query_id, doc_id ORDER BY pos)),
  b AS (SELECT *, CASE WHEN p1 IS NOT NULL AND (n < 2 OR p2 IS NOT NULL) AND (n < 3 OR p3 IS NOT NULL) THEN least(p1, coalesce(p2, p1), coalesce(p3, p1)) END AS first FROM s),
  c AS (SELECT query_id, doc_id, first, min(pos) AS last, min(i) AS i FROM b WHERE first IS NOT NULL GROUP BY ALL),
  r AS (SELECT c.query_id, c.doc_id AS id, sum(0.1::DOUBLE / (1 + (c.last - c.first) - (c.i - s.i))) AS v FROM c JOIN s ON s.query_id = c.query_id AND s.doc_id = c.doc_id AND s.pos = c.first GROUP BY ALL)
  SELECT query_id, id, round(v, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(v, 9) DESC, id) AS rank FROM r) WHERE rank <= 10""")
def cover_rank(spark, sf_dir):
    """The first three words of every hundredth text as a query: the 10 best texts by cover density, from postings."""
    asked = documents(spark, sf_dir).filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(sequence(F.col("text")), 1, 3), " ").alias("query"))
    return _text_index(spark, sf_dir).search(asked, 10).select("query_id", "id", F.round("lexical_score", 6).alias("score"), "rank")


@query(f"SELECT lexeme, count(DISTINCT doc_id) AS texts, count(*) AS occurrences FROM (SELECT doc_id, unnest({WORDS_SQL}) AS lexeme FROM documents) GROUP BY lexeme")
def posting_counts(spark, sf_dir):
    """Texts and occurrences of every lexeme, read from postings and not from texts."""
    return _text_index(spark, sf_dir).counts(spark)


COVERS_SQL = f"""t AS (SELECT doc_id, unnest(w) AS lex, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, {WORDS_SQL} AS w FROM documents)),
  q AS (SELECT doc_id AS query_id, list_distinct({WORDS_SQL}[1:2]) AS l FROM documents WHERE doc_id % 100 = 0),
  o AS (SELECT query_id, doc_id, pos, lex, l FROM t JOIN (SELECT *, unnest(l) AS one FROM q) ON lex = one),
  s AS (SELECT *, len(l) AS n, row_number() OVER w AS i, max(CASE WHEN lex = l[1] THEN pos END) OVER w AS p1, max(CASE WHEN lex = l[2] THEN pos END) OVER w AS p2
    FROM o WINDOW w AS (PARTITION BY query_id, doc_id ORDER BY pos)),
  b AS (SELECT *, CASE WHEN p1 IS NOT NULL AND (n < 2 OR p2 IS NOT NULL) THEN least(p1, coalesce(p2, p1)) END AS first FROM s),
  c AS (SELECT query_id, doc_id, first, min(pos) AS last, min(i) AS i FROM b WHERE first IS NOT NULL GROUP BY ALL),
  l AS (SELECT query_id, id, v FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(v, 9) DESC, id) AS k FROM (SELECT c.query_id, c.doc_id AS id,
    sum(0.1::DOUBLE / (1 + (c.last - c.first) - (c.i - s.i))) AS v FROM c JOIN s ON s.query_id = c.query_id AND s.doc_id = c.doc_id AND s.pos = c.first GROUP BY ALL)) WHERE k <= 40)"""


@query(f"""WITH {COVERS_SQL},
  e AS (SELECT d.doc_id, CAST(embedding AS DOUBLE[]) AS v FROM documents d JOIN embeddings ON vec_id = d.doc_id),
  n AS (SELECT query_id, id, s FROM (SELECT a.doc_id AS query_id, b.doc_id AS id, list_cosine_similarity(a.v, b.v) AS s,
    row_number() OVER (PARTITION BY a.doc_id ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.doc_id) AS k FROM e a, e b WHERE a.doc_id % 100 = 0) WHERE k <= 40 AND s >= 0.2),
  m AS (SELECT query_id, id, greatest(coalesce(s, -1), CASE WHEN v IS NULL THEN -1 ELSE least(1.05, 0.3::DOUBLE + v) END) AS score, s IS NOT NULL AS near, v IS NOT NULL AS worded FROM n FULL JOIN l USING (query_id, id))
  SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, near, worded FROM
    (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM m) WHERE rank <= 10""")
def hybrid_indexed(spark, sf_dir):
    """Hybrid search of every hundredth text, its first two words and its vector, over all texts: both branches through indexes, every list probed."""
    vectors, folder = _vectors(spark, sf_dir), _folder(spark, "asked")
    corpus = documents(spark, sf_dir).select(F.lit("custom_document").alias("source"), F.col("doc_id").alias("id"), F.col("text").alias("content"), F.lit(None).cast("timestamp").alias("ts"), F.lit(0).alias("severity"))
    index = VectorIndex.build(corpus.select("id").join(vectors, "id"), _folder(spark, "vector-index"))
    index = replace(index, probes=max(1, index.lists))
    texts = TextIndex.build(corpus, _folder(spark, "text-index"))
    terms = F.expr("cast(array() as array<struct<type:string,term:string>>)")
    asked = corpus.filter("id % 100 = 0").join(vectors, "id", "left").select(F.col("id").alias("query_id"), F.array_join(F.slice(sequence(F.col("content")), 1, 2), " ").alias("query"), "vector", terms.alias("terms"))
    asked.write.parquet(folder)  # both branches use the queries several times
    asked = spark.read.parquet(folder)
    found = S.hybrid_search([corpus], asked, 40 // S.MULTIPLIER, diverse=False, indexes=[(index, texts)])
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))
    has = lambda kind: F.array_contains("match_types", kind)
    return found.select("query_id", "id", rank.alias("rank"), F.round("score", 6).alias("score"), has("semantic").alias("near"), has("lexical").alias("worded"))


# --- versions --------------------------------------------------------------------------------------------------
@query("""WITH e AS (SELECT event_id AS id, CAST(ts AS DATE) AS event_date, event_type, value, event_id % 3 = 0 AS first, event_id % 5 = 0 AS filled FROM events),
  r AS (SELECT 1 AS version, id, event_date, NULL AS filled FROM e WHERE first UNION ALL SELECT 2, id, event_date, NULL FROM e
    UNION ALL SELECT 3, id, event_date, CASE WHEN filled THEN value END FROM e UNION ALL SELECT 4, id, event_date, CASE WHEN filled THEN value END FROM e WHERE event_date >= DATE '2024-01-11')
  SELECT CAST(version AS INTEGER) AS version, event_date, count(*) AS n, count(filled) AS filled, round(coalesce(sum(filled), 0), 2) AS total FROM r GROUP BY ALL""")
def versioned_store(spark, sf_dir):
    """Events in a versioned table, all versions by date: a third inserted, all inserted (known ones ignored, and once more by a retry), every fifth
    back-filled twice, 20 days retained."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), F.to_date("ts").alias("event_date"), "event_type", "value")
    table = VersionedTable.create(spark, _folder(spark, "events"), "id long, event_date date, event_type string, filled double", "id", "event_date")
    rows = events.select("id", "event_date", "event_type", F.lit(None).cast("double").alias("filled"))
    for part in (rows.filter("id % 3 = 0"), rows, rows):
        table.insert(part)
    for _ in range(2):
        table.update(events.filter("id % 5 = 0").select("id", F.col("value").alias("filled")), only_null=True)
    versioned.retain(table, 20, "2024-01-31")
    out = None
    for n in table.numbers():
        by = table.read(n).groupBy("event_date").agg(F.count("*").alias("n"), F.count("filled").alias("filled"), F.round(F.coalesce(F.sum("filled"), F.lit(0.0)), 2).alias("total")).withColumn("version", F.lit(n))
        out = by if out is None else out.unionByName(by)
    return out


# --- large inventories -------------------------------------------------------------------------------------------
KINDS = ("internal", "owned", "infrastructure")


@query("""SELECT context, count(*) AS n, min(event_id) AS first_event FROM (SELECT event_id, CASE WHEN src_ip IS NULL THEN 'unknown' ELSE ['internal', 'owned', 'infrastructure'][(CAST(split_part(src_ip, '.', 3) AS INT) * 16
  + CAST(split_part(src_ip, '.', 4) AS INT) // 16) % 3 + 1] END AS context FROM alerts) GROUP BY context""", True)
def large_inventory(spark, sf_dir):
    """Source addresses in an inventory of 16,384 blocks of 16 addresses."""
    blocks = {k: [] for k in KINDS}
    for start in ("10.0", "192.0", "198.51", "203.0"):
        for i in range(4096):
            blocks[KINDS[i % 3]].append(f"{start}.{i // 16}.{i % 16 * 16}/28")
    assets = net.Assets(tuple(blocks["infrastructure"]), tuple(blocks["owned"]), tuple(blocks["internal"]))
    rows = alerts(spark, sf_dir)
    return rows.withColumn("context", net.large_context(spark, F.col("src_ip"), assets)).groupBy("context").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))
