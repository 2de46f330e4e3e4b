"""The registered queries opN_* and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embed_dedup, filter_audit, line_dedup, mixing, neardup, pii, quality, secrets, sentencepiece_trie, sharding, source_audit, toxicity
from .common import table


def _joined(spans: Column) -> Column:
    """kind:start:end of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("secrets", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    every = F.filter("secrets", lambda s: s["confirmed"] | s["kind"].isin(*secrets.BASE_KINDS))
    confirmed = F.size(F.filter("secrets", lambda s: s["confirmed"])).cast("long").alias("n_confirmed")
    return found.select("doc_id", *[count(k) for k in secrets.BASE_KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(every).alias("spans"), confirmed)


def op2_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))

    def tagged(kinds: tuple[str, ...]) -> Column:
        def one(kind: str) -> Column:
            return F.transform(kind, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

        return F.concat(*[one(k) for k in kinds])

    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(tagged(pii.BASE_KINDS)), 256).alias("base_sha256"), _joined(tagged(pii.KINDS)).alias("spans"))


def op4_bayes_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels").filter(~held))
    scored = toxicity.score_rows(docs, lexicon, score_col="score", matched_col="n_clauses")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_clauses")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    blocks = chat.format_blocks(rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra))
    turns = chat.read_chat(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss", lambda m: chat.TEMPLATE.unescape(F.substring(F.col("formatted"), m["start"] + 1, m["end"] - m["start"]))), "")
    read = blocks.select("conv_id", "block", F.size(turns).cast("long").alias("n"), said.alias("said"), loss.alias("loss"), F.length("formatted").cast("long").alias("chars"), "valid")
    by = read.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("block", "said", "loss"))).alias("parts"), F.sum("chars").alias("formatted_chars"), F.min("valid").alias("valid_order"))
    whole = lambda name: F.array_join(F.transform("parts", lambda p: p[name]), "")
    return by.select("conv_id", "n_turns", F.sha2(whole("said"), 256).alias("turns_sha256"), F.length(whole("loss")).cast("long").alias("loss_chars"), F.sha2(whole("loss"), 256).alias("loss_sha256"), "formatted_chars", "valid_order")


def op8_embedding_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_duplicates(table(spark, sf_dir, "embeddings")).drop("audited_recall")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_trie.encode_rows(table(spark, sf_dir, "documents"))


def op10_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.source_divergence(table(spark, sf_dir, "documents"), least_docs=3, ranks=200)


def op12_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = filter_audit.document_flags(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return filter_audit.replay(flags, list("ABCDE"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, min_docs=10))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_sampled_splitters, op3_pii_boosting, op4_bayes_minhash, op5_mixing, op6_toxicity_grammar, op7_chat_format, op8_embedding_graph, op9_sentencepiece, op10_quality_votes, op11_source_divergence, op12_filter_interaction, op13_line_dedup)}

ORACLE_SQL = {
    "op5_mixing": """
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
                  md5(concat(coalesce(CAST(doc_id AS VARCHAR), 'null'), ':mix')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s),
c AS (SELECT *, 2 * source_size AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total,
             coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
             sum(w) OVER (ORDER BY 2 * source_size / w::DOUBLE, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w,
             row_number() OVER (ORDER BY 2 * source_size / w::DOUBLE, source NULLS LAST) AS i FROM r),
l AS (SELECT *, (total - full_) / left_w::DOUBLE AS lvl FROM c),
o AS (SELECT arg_min(lvl, i) FILTER (WHERE lvl * w <= cap) AS common FROM l),
t AS (SELECT source, source_size, CASE WHEN common IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, common * w) END AS target FROM l, o),
b AS (SELECT *, CAST(round(target) AS BIGINT) AS budget, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
p AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.epochs, b.budget - b.epochs * b.source_size AS rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - start_)) AS BIGINT) AS taken FROM p
""",
    "op4_bayes_minhash": """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
""",
    "op7_chat_format": """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS earlier,
  length('<|im_start|><|im_sep|><|im_end|>') + length(role) + length(text)
  + len(regexp_extract_all(text, '<\\\\*(\\|im_start\\|>|\\|im_sep\\|>|\\|im_end\\|>|\\|endoftext\\|>|s>|/s>)|\\[\\\\*(INST\\]|/INST\\])')) AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars,
  bool_and((role = 'system' AND earlier = '') OR (role = 'user' AND earlier IN ('', 'system', 'assistant')) OR (role = 'assistant' AND earlier = 'user')) AS valid_order
FROM f GROUP BY conv_id
""",
    "op8_embedding_graph": """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
""",
    "op11_source_divergence": """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 1)) // CAST(total + v AS HUGEINT) AS BIGINT) AS p
      FROM s JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
l AS (SELECT lang, term, CAST(1 + (CAST(1000000000 AS HUGEINT) * (sum(n) + 1)) // CAST(sum(sum(n)) OVER (PARTITION BY lang) + v AS HUGEINT) AS BIGINT) AS q
      FROM c JOIN v USING (lang) GROUP BY lang, term, v),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT p.lang, p.source, 'term', p.term, ((p.p - l.q) * (p.p - l.q)) // l.q FROM p JOIN l USING (lang, term) WHERE n > 0 AND p.p > l.q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u QUALIFY part = 'pair' OR rank <= 200
""",
    "op12_filter_interaction": """
WITH RECURSIVE o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || l FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) WHERE NOT contains(filter_order, l)),
s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o WHERE length(filter_order) = 5),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
f AS (SELECT t.doc_id, part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic,
        concat(CASE WHEN len(w) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END,
               CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' END,
               CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END,
               CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY text) THEN 'E' END) AS failed
      FROM t LEFT JOIN labels USING (doc_id)),
r AS (SELECT part, good, toxic, failed, filter_order, step, filter_order[step] AS letter, coalesce(list_min(list_filter([1, 2, 3, 4, 5], lambda i: contains(failed, filter_order[i]))), 6) AS first FROM f, s),
a AS (SELECT part, filter_order, step, letter, count(*) FILTER (step < first) AS kept, count(*) FILTER (step = first) AS removed,
        count(*) FILTER (step > first AND contains(failed, letter)) AS redundant, count(*) FILTER (failed = letter) AS unique_fails,
        count(*) FILTER (step = first AND good) AS good_lost, count(*) FILTER (step = first AND toxic) AS toxic_lost FROM r GROUP BY ALL)
SELECT * EXCLUDE (letter), CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM a
""",
    "op13_line_dedup": """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(h.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (h.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN h USING (key) GROUP BY doc_id
""",
}
