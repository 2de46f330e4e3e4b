"""Positional inverted index over texts and their metadata, and ranking by cover density.

A posting is (lexeme, source, id, positions, n_words), written in BUCKETS partitions by a hash of the lexeme and sorted by it, so that a
query reads the buckets of its lexemes and skips row groups of others. A text is tokenised once, at build time; its postings are
shuffled in packed blocks (gaps of positions, each text and lexeme once a block), not one by one. A text matches if it
holds every lexeme of a query. Its rank sums over the minimal covers (stretches that hold every lexeme and no smaller such stretch)
WEIGHT / (1 + noise), noise being the positions in the stretch without a lexeme of the query.

The best k are found by parts of the texts: the postings of asked lexemes are dealt once by a hash of the text, each part meets the
distinct sets of lexemes that are asked for, and only the k best of a part and set leave a task. Pairs of queries and texts are thus
never stored, only compared.

Rows without a source or an id are not indexed. Texts and metadata may be null; metadata follows the content in one sequence of positions. Rows that share source and id are told apart by
`row`, which the index numbers by a hash of the text; rows alike in all three are one. Queries without a lexeme find nothing. Positions of a
text are as many as its words, whatever its length; one text's postings are built in one batch.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from alertloom.functions import text as X
from alertloom.session import small_batches

#: Partitions of the postings; files a bucket is written in; the weight of a lexeme.
BUCKETS, FILES, WEIGHT = 64, 4, 0.1
#: Words whose postings are packed together; characters of text whose postings one task writes; keys that are broadcast at most.
BLOCK_WORDS, TASK_CHARS, MOST_KEYS = 1_000_000, 8_000_000, 200_000
#: Postings of a part of the texts when queries are answered.
PART_POSTINGS = 2_000_000


def sequence(text: Column) -> Column:
    """All lexemes in order: lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)[\w]+"), F.lit(0))


def indexed_text(corpus: DataFrame) -> Column:
    """Content and, where there is such a column, metadata."""
    content = F.coalesce("content", F.lit(""))
    return F.concat_ws(" ", content, F.coalesce(F.col("metadata").cast("string"), F.lit(""))) if "metadata" in corpus.columns else content


def bucket(lexeme: Column) -> Column:
    return (F.crc32(lexeme.cast("binary")) % BUCKETS).cast("int")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(deal, block) of (source, id, row, part, words): the postings of about BLOCK_WORDS words, packed for each bucket and part of the texts."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch.column(4).flatten())
        if n >= BLOCK_WORDS:
            yield from _packed(pa.Table.from_batches(held))
            held, n = [], 0
    if n:
        yield from _packed(pa.Table.from_batches(held))


def _packed(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    rows = rows.combine_chunks().to_batches()[0]
    words, part = rows.column(4), rows.column(3).to_numpy()
    sizes = np.diff(words.offsets.to_numpy())
    coded = words.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lexemes = coded.dictionary
    buckets = np.array([crc32(w) % BUCKETS for w in lexemes.cast(pa.binary()).to_pylist()], np.int64)
    texts = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key = (buckets[codes] * FILES + part[texts]) * len(lexemes) + codes
    order = np.argsort(key, kind="stable")  # within a lexeme by text and position, as they came
    key, texts, at = key[order], texts[order], at[order]
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (texts[1:] != texts[:-1])))
    gaps = np.diff(at, prepend=0)
    gaps[first] = at[first]
    n, key, texts = np.diff(np.append(first, len(at))), key[first], texts[first]
    deal, ends = key // len(lexemes), np.append(first, len(at))
    about = pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(3)), pa.array(sizes, pa.int32())], ["source", "id", "row", "n_words"])
    cuts = np.append(np.flatnonzero(np.append(True, deal[1:] != deal[:-1])), len(deal))
    blocks = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        new = np.flatnonzero(np.append(True, key[a + 1 : b] != key[a : b - 1]))
        used, of = np.unique(texts[a:b], return_inverse=True)
        columns = {"lexeme": lexemes.take(pa.array(key[a:b][new] % len(lexemes))), "held": _small(np.diff(np.append(new, b - a))), "text": _small(of), "n": _small(n[a:b]), "gap": _small(gaps[ends[a] : ends[b]])}
        columns |= {c: about.column(c).take(pa.array(used)) for c in about.schema.names}
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns.values()]
        sink = pa.BufferOutputStream()
        one = pa.RecordBatch.from_arrays(lists, list(columns))
        with pa.ipc.new_stream(sink, one.schema) as out:
            out.write_batch(one)
        raw = sink.getvalue()
        blocks.append(len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True))
    yield pa.RecordBatch.from_arrays([pa.array(deal[cuts[:-1]], pa.int32()), pa.array(blocks, pa.binary())], ["deal", "block"])


def _small(numbers: np.ndarray) -> pa.Array:
    """In the narrowest type that holds them."""
    return pa.array(numbers.astype(np.min_scalar_type(int(numbers.max(initial=0)))))


def _opened(schema: pa.Schema):
    """The postings of blocks, with their bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for deal, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = pa.decompress(block[8:], int.from_bytes(block[:8], "little"), codec="zstd")
                one = pa.ipc.open_stream(raw).read_all().to_batches()[0]
                c = {name: one.column(name).flatten() for name in one.schema.names}
                number = lambda name, c=c: c[name].to_numpy().astype(np.int64)
                n, of = number("n"), pa.array(number("text"))
                ends = np.append(0, np.cumsum(n))
                total = np.append(0, np.cumsum(number("gap")))
                at = total[1:] - np.repeat(total[ends[:-1]], n)
                positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at, pa.int32()))
                lexemes = c["lexeme"].take(pa.array(np.repeat(np.arange(len(c["lexeme"])), number("held"))))
                bucket = pa.array(np.full(len(n), deal // FILES), pa.int32())
                yield pa.RecordBatch.from_arrays([*(c[x].take(of) for x in ("source", "id", "row")), lexemes, positions, c["n_words"].take(of), bucket], schema=schema)

    return run


def cover_density(lists: list[np.ndarray]) -> float:
    """Rank of a text from the positions of each lexeme of the query; one pass over them in order.

    At each position the lexemes' latest positions are known; the earliest of them begins the shortest cover that ends here. It is minimal
    if no earlier end had the same beginning.
    """
    merged = sorted((int(p), j) for j, at in enumerate(lists) for p in at)
    latest: OrderedDict[int, tuple[int, int]] = OrderedDict()
    rank, before = 0.0, None
    for i, (position, j) in enumerate(merged):
        latest.pop(j, None)
        latest[j] = (position, i)
        if len(latest) < len(lists):
            continue
        begin, at = next(iter(latest.values()))
        if begin != before:
            before = begin
            rank += WEIGHT / (1 + (position - begin) - (i - at))
    return rank


def _ranks(lists: pd.Series) -> pd.Series:
    return pd.Series([cover_density([np.asarray(p) for p in row]) for row in lists], dtype=float)


def _covers(lists: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """cover_density() of n texts at once, from (text, position) arrays of each lexeme."""
    of, at = (np.concatenate(x) for x in zip(*lists, strict=True))
    lexeme = np.repeat(np.arange(len(lists)), [len(x) for x, _ in lists])
    order = np.lexsort((at, of))
    of, at, lexeme, line = of[order], at[order].astype(np.int64), lexeme[order], np.arange(len(of))
    start = np.searchsorted(of, of)  # where each row's text begins
    begin, full = line, np.ones(len(of), bool)
    for j in range(len(lists)):
        latest = np.maximum.accumulate(np.where(lexeme == j, line, -1))
        begin, full = np.minimum(begin, latest), full & (latest >= start)
    new = np.append(True, (begin[1:] != begin[:-1]) | (of[1:] != of[:-1]) | ~full[:-1]) & full
    line, begin = line[new], begin[new]
    return np.bincount(of[new], WEIGHT / (1 + (at[line] - at[begin]) - (line - begin)), n)


def _best(k: int, schema: pa.Schema):
    """The k best texts of a part for each set of lexemes."""

    def run(postings: pa.Table, sets: pa.Table) -> pa.Table:
        if not postings.num_rows or not sets.num_rows:
            return schema.empty_table()
        texts = postings.select(["source", "id", "row"]).to_pandas().groupby(["source", "id", "row"])
        text, ids = texts.ngroup().to_numpy(), texts.head(1).index.to_numpy()  # numbered in the order that breaks ties
        first = np.empty(len(ids), np.int64)
        first[text[ids]] = ids
        coded = postings.column("lexeme").combine_chunks().dictionary_encode()
        lexeme = coded.indices.to_numpy(zero_copy_only=False)
        number = {w: i for i, w in enumerate(coded.dictionary.to_pylist())}
        order = np.lexsort((text, lexeme))
        bounds = np.searchsorted(lexeme[order], np.arange(len(number) + 1))
        positions = postings.column("positions").combine_chunks()
        flat, ends = positions.values.to_numpy(zero_copy_only=False), positions.offsets.to_numpy()
        sizes = np.diff(ends)
        chosen, of, scores = [], [], []
        for i, asked in enumerate(sets.column("lexemes").to_pylist()):
            codes = [number.get(w) for w in asked]
            if None in codes:
                continue
            rows = sorted((order[bounds[c] : bounds[c + 1]] for c in codes), key=len)  # each by text; the rarest lexeme first
            held = text[rows[0]]
            for r in rows[1:]:
                held = held[np.isin(held, text[r], assume_unique=True)]
            if not len(held):
                continue
            lists = []
            for r in rows:
                r = r[np.searchsorted(text[r], held)]
                n = sizes[r]
                lists.append((np.repeat(np.arange(len(held)), n), flat[np.repeat(ends[r] - np.cumsum(n) + n, n) + np.arange(n.sum())]))
            score = _covers(lists, len(held))
            top = np.lexsort((held, -np.round(score, 9)))[:k]
            chosen.append(first[held[top]])
            of.append(np.full(len(top), i))
            scores.append(score[top])
        if not chosen:
            return schema.empty_table()
        at, of = pa.array(np.concatenate(chosen)), pa.array(np.concatenate(of))
        found = [sets.column("lexemes").take(of), *[postings.column(c).take(at) for c in ("source", "id", "row")], pa.array(np.concatenate(scores))]
        return pa.Table.from_arrays(found, schema.names).cast(schema)

    return run


@dataclass(frozen=True)
class TextIndex:
    """Postings in <path>/postings, in <path>/lexemes how many texts hold each lexeme, in <path>/texts the texts by source, id and row."""

    path: str

    @classmethod
    def build(cls, corpus: DataFrame, path: str) -> TextIndex:
        """Index (source, id, content) and, if a column, metadata."""
        small_batches(corpus.sparkSession)
        text = indexed_text(corpus)
        spark, key = corpus.sparkSession, ["source", "id", "row"]
        texts = corpus.filter(F.col("source").isNotNull() & F.col("id").isNotNull()).select("source", "id", F.xxhash64(text).alias("row"), text.alias("text"))
        # keys go through a shuffle, not texts; only texts that have copies are compared whole
        texts.groupBy(*key).agg(F.count("*").alias("copies"), F.sum(F.length("text")).alias("chars")).write.mode("overwrite").parquet(f"{path}/texts")
        known = spark.read.parquet(f"{path}/texts")
        copied, chars = known.agg(F.count_if(F.col("copies") > 1), F.coalesce(F.sum("chars"), F.lit(0))).first()
        if copied > MOST_KEYS:
            texts = texts.dropDuplicates(key)
        elif copied:
            again = F.broadcast(known.filter("copies > 1").select(*key))
            texts = texts.join(again, key, "left_anti").unionByName(texts.join(again, key, "left_semi").dropDuplicates(key))
        # a lexeme that most texts hold is written by FILES tasks
        rows = texts.select(*key, F.pmod(F.xxhash64("id"), F.lit(FILES)).cast("int").alias("part"), sequence(F.col("text")).alias("words"))
        kind = lambda c: T.StructField(c, rows.schema[c].dataType)
        schema = T.StructType([kind("source"), kind("id"), kind("row"), T.StructField("lexeme", T.StringType()), T.StructField("positions", T.ArrayType(T.IntegerType())), T.StructField("n_words", T.IntegerType())])
        stored = T.StructType([*schema, T.StructField("bucket", T.IntegerType())])
        tasks = max(1, min(BUCKETS * FILES, -(-chars // TASK_CHARS)))
        dealt = rows.mapInArrow(_blocks, "deal int, block binary").repartition(tasks, "deal").mapInArrow(_opened(to_arrow_schema(stored)), stored)
        dealt.sortWithinPartitions("bucket", "lexeme", "id").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
        index = cls(path)
        spark.createDataFrame([(stored.json(),)], "schema string").coalesce(1).write.mode("overwrite").parquet(f"{path}/schema")
        index.postings(spark).groupBy("bucket", "lexeme").agg(F.count("*").alias("texts"), F.sum(F.size("positions")).alias("occurrences")).write.mode("overwrite").parquet(f"{path}/lexemes")
        return index

    @staticmethod
    def row_of(corpus: DataFrame) -> Column:
        """The index's `row` of each row of the corpus it was built from."""
        return F.xxhash64(indexed_text(corpus))

    def postings(self, spark: SparkSession) -> DataFrame:
        import json

        schema = T.StructType.fromJson(json.loads(spark.read.parquet(f"{self.path}/schema").first()[0]))
        return spark.read.schema(schema).parquet(f"{self.path}/postings")

    def counts(self, spark: SparkSession) -> DataFrame:
        """(lexeme, texts, occurrences), from postings; texts with the same id count once."""
        postings, occurrences = self.postings(spark), F.sum(F.size("positions")).alias("occurrences")
        # a posting is another id's, but for the few ids that have several texts
        several = spark.read.parquet(f"{self.path}/texts").groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
        n = several.limit(MOST_KEYS + 1).count()
        if n > MOST_KEYS:
            return postings.groupBy("lexeme").agg(F.count_distinct("id").alias("texts"), occurrences)
        found = postings.groupBy("lexeme").agg(F.count("*").alias("texts"), occurrences)
        if n:
            more = postings.join(F.broadcast(several), "id", "left_semi").groupBy("lexeme", "id").agg((F.count("*") - 1).alias("more")).groupBy("lexeme").agg(F.sum("more").alias("more"))
            found = found.join(more, "lexeme", "left").withColumn("texts", F.col("texts") - F.coalesce("more", F.lit(0))).drop("more")
        return found

    def lexemes(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/lexemes")

    def matches(self, queries: DataFrame) -> DataFrame:
        """(query_id, source, id, row, lists): texts that hold every lexeme of a query, with the positions of each.

        The rarest lexeme of a query chooses the texts; the postings of its other lexemes are joined to those only.
        """
        spark = queries.sparkSession
        asked = queries.select("query_id", F.explode(X.words(F.col("query"))).alias("lexeme")).withColumn("bucket", bucket(F.col("lexeme")))
        known = asked.join(self.lexemes(spark), ["bucket", "lexeme"], "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
        each = W.partitionBy("query_id")
        known = known.withColumns({"n": F.count("*").over(each), "least": F.min("texts").over(each), "i": F.row_number().over(each.orderBy("texts", "lexeme"))}).filter("least > 0")
        postings = self.postings(spark).select("bucket", "lexeme", "source", "id", "row", "positions")
        first = postings.join(known.filter("i = 1").select("bucket", "lexeme", "query_id", "n"), ["bucket", "lexeme"])
        alone = first.filter("n = 1").select("query_id", "source", "id", "row", F.array("positions").alias("lists"))
        anchors = first.filter("n > 1").select("query_id", "source", "id", "row", "positions", "n")
        others = postings.join(known.filter("i > 1").select("bucket", "lexeme", "query_id"), ["bucket", "lexeme"]).select("query_id", "source", "id", "row", F.col("positions").alias("other"))
        key = ["query_id", "source", "id", "row"]
        both = anchors.join(others, key).groupBy(*key).agg(F.first("n").alias("n"), F.first("positions").alias("own"), F.collect_list("other").alias("other"))
        return alone.unionByName(both.filter(F.size("other") == F.col("n") - 1).select(*key, F.concat(F.array("own"), F.col("other")).alias("lists")))

    def search(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """(query_id, source, id, row, lexical_score, rank): matching texts of queries (query_id, query), best first; k or all."""
        if k is None:
            scored = self.matches(queries).select("query_id", "source", "id", "row", F.pandas_udf(_ranks, T.DoubleType())("lists").alias("lexical_score"))
            return scored.withColumn("rank", F.lit(None).cast("int"))
        spark = queries.sparkSession
        asked = queries.select("query_id", F.explode(X.words(F.col("query"))).alias("lexeme")).groupBy("query_id").agg(F.array_sort(F.collect_set("lexeme")).alias("lexemes"))
        sets = asked.select("lexemes").distinct()
        wanted = sets.select(F.explode("lexemes").alias("lexeme")).distinct().withColumn("bucket", bucket(F.col("lexeme")))
        total = self.lexemes(spark).join(wanted, ["bucket", "lexeme"], "left_semi").agg(F.coalesce(F.sum("texts"), F.lit(0))).first()[0]
        parts = max(1, -(-total // PART_POSTINGS))
        postings = self.postings(spark).join(wanted, ["bucket", "lexeme"], "left_semi")
        dealt = postings.select(F.pmod(F.xxhash64("source", "id", "row"), F.lit(parts)).cast("int").alias("part"), "lexeme", "source", "id", "row", "positions")
        met = sets.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "lexemes")
        kinds = T.StructType([T.StructField("lexemes", T.ArrayType(T.StringType())), *[postings.schema[c] for c in ("source", "id", "row")], T.StructField("lexical_score", T.DoubleType())])
        found = dealt.groupBy("part").cogroup(met.groupBy("part")).applyInArrow(_best(k, to_arrow_schema(kinds)), kinds)
        order = W.partitionBy("lexemes").orderBy(F.desc(F.round("lexical_score", 9)), "source", "id", "row")
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return asked.join(ranked, "lexemes").select("query_id", "source", "id", "row", "lexical_score", "rank")
