"""Lines that many documents share are dropped, by range-partitioned line hashes and bitmaps.

Every line's key (white space stripped at both ends, A-Z lower-cased) is hashed to 128 bits, and (hash, document,
position) rows are range-partitioned by hash and document and sorted by position too, so that one
task streams a stretch of them in order and a key that many documents hold is cut over several stretches. A stream counts the documents of each
key. It holds back rows of the key at hand only until that many documents are seen (fewer than `min_docs` documents' rows), then passes
them on. Only the first and the last key of a stretch may go on in another one: those are settled by adding up their counts, at most
two a stretch. What the streams pass on becomes one compressed bitmap of kept lines per document; texts meet only that.

A document is a row. Null or empty texts have one empty line; empty keys are never dropped. Rows alike in id and text count as
documents each and share one bitmap; ids may be null or repeated. Positions order ties. A text of any length is split whole. An empty
table gives an empty result. Helper columns take free names, other columns pass through apply_bitmaps() untouched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, free_name, small_batches

BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: What a stream knows of a row: its key is dropped and lies within the stretch; is dropped and may go on; isn't decided.
WITHIN, DROPPED, OPEN = 0, 1, 2


def document_mark(id_col: str, text_col: str) -> Column:
    """Tells rows apart that share an id: 64 bits over id and text."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, doc_id, mark, pos) of the keyed lines of (doc_id, mark, text)."""
    from xxhash import xxh3_128_digest

    for batch in batches:
        digests, rows, at = [], [], []
        for row, text in enumerate(batch.column(2).cast(pa.large_binary())):
            for pos, line in enumerate((text.as_py() or b"").split(b"\n")):
                key = line.strip(BLANKS).lower()
                if key:
                    digests.append(xxh3_128_digest(key))
                    rows.append(row)
                    at.append(pos)
        h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        rows = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at, pa.int32())], ["h1", "h2", "doc_id", "mark", "pos"])


class _Stretch:
    """Streams the sorted rows of one task and passes on those of keys that are, or may be, dropped."""

    def __init__(self, least: int, part: int):
        self.least, self.part = least, part
        self.held: pa.Table | None = None  # rows of the key at hand while it isn't decided
        self.begun = False  # a key before the one at hand has ended
        self.key = None  # the key at hand, if it is decided: its rows have been passed on

    def out(self, rows: pa.Table, states: np.ndarray, firsts: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
        n = rows.num_rows
        extra = [pa.array(states.astype(np.int8)), pa.array(firsts), pa.array(docs.astype(np.int64)), pa.array(np.full(n, self.part, np.int32))]
        return pa.Table.from_arrays([*rows.columns, *extra], [*rows.column_names, "state", "first", "docs", "part"]).combine_chunks().to_batches()

    def add(self, batch: pa.RecordBatch | None):
        """Rows to pass on after this batch; None ends the stretch."""
        tables = [] if self.held is None else [self.held]
        if batch is not None:
            tables.append(pa.Table.from_batches([batch]))
        rows, self.held = (pa.concat_tables(tables).combine_chunks() if tables else None), None
        if rows is None or not rows.num_rows:
            return []
        h1, h2, mark, pos = (rows.column(c).to_numpy() for c in ("h1", "h2", "mark", "pos"))
        new_key = np.ones(len(h1), bool)
        new_key[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        starts = np.flatnonzero(new_key)
        sizes = np.diff(np.append(starts, len(h1)))
        # rows of a document at its first position of the key: one for each row of documents that is alike
        new_doc = new_key.copy()
        new_doc[1:] |= mark[1:] != mark[:-1]
        at = np.flatnonzero(new_doc)
        opening = pos == np.repeat(pos[at], np.diff(np.append(at, len(h1))))
        docs = np.add.reduceat(opening.astype(np.int64), starts)
        dropped = docs >= self.least
        keys = len(starts)
        edge = np.zeros(keys, bool)
        edge[0] = not self.begun
        edge[-1] = True
        going_on = np.zeros(keys, bool)
        if self.key == (h1[0], h2[0]):
            dropped[0] = going_on[0] = True
        states = np.where(dropped, np.where(edge, DROPPED, WITHIN), OPEN)
        passed = dropped | edge
        last_key = (h1[-1], h2[-1])
        if batch is not None and not dropped[-1]:
            self.held, passed[-1] = rows.slice(int(starts[-1])), False
        self.key = last_key if dropped[-1] else None
        if keys > 1:
            self.begun = True
        mask = np.repeat(passed, sizes)
        firsts = np.zeros(len(h1), bool)
        firsts[starts[~going_on]] = True
        weight = np.zeros(len(h1), np.int64)
        weight[starts] = np.where(going_on, 0, docs)
        return self.out(rows.filter(pa.array(mask)), np.repeat(states, sizes)[mask], firsts[mask], weight[mask])


def _streamed(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        stretch = _Stretch(least, TaskContext.get().partitionId())
        for batch in batches:
            if batch.num_rows:
                yield from stretch.add(batch)
        yield from stretch.add(None)

    return run


def dropped_lines(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, pos) of the lines whose key occurs in min_docs documents or more; with keep_first, all but the key's
    first occurrence by id, mark and position."""
    if min_docs < 1:
        raise ValueError("min_docs is 1 or more")
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "lines")
    rows = docs.select(F.col(id_col).alias("doc_id"), document_mark(id_col, text_col).alias("mark"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType
    fields = [("h1", T.LongType()), ("h2", T.LongType()), ("doc_id", kind), ("mark", T.LongType()), ("pos", T.IntegerType())]
    more = [("state", T.ByteType()), ("first", T.BooleanType()), ("docs", T.LongType()), ("part", T.IntegerType())]
    schema = lambda x: T.StructType([T.StructField(n, t) for n, t in x])
    lines = rows.mapInArrow(_hashed, schema(fields))  # hashed twice: once more for the samples that cut the ranges
    ordered = lines.repartitionByRange("h1", "h2", "doc_id", "mark").sortWithinPartitions("h1", "h2", "doc_id", "mark", "pos")
    found = scratch.save(ordered.mapInArrow(_streamed(min_docs), schema(fields + more)), compact=True)
    edges = found.filter(F.col("state") != WITHIN)
    totals = edges.groupBy("h1", "h2").agg(F.sum("docs").alias("all_docs"), F.min("part").alias("first_part"))
    open_ = edges.filter((F.col("state") == OPEN)).join(totals.filter(F.col("all_docs") >= min_docs), ["h1", "h2"])
    if not keep_first:
        return found.filter(F.col("state") != OPEN).select("doc_id", "mark", "pos").unionByName(open_.select("doc_id", "mark", "pos"))
    # the first row of a key that reaches over stretches is that of its first stretch
    leads = edges.filter((F.col("state") == DROPPED) & F.col("first")).join(totals, ["h1", "h2"]).filter(F.col("part") > F.col("first_part"))
    inside = found.filter((F.col("state") != OPEN) & ~F.col("first"))
    late = open_.filter(~F.col("first") | (F.col("part") > F.col("first_part")))
    return inside.select("doc_id", "mark", "pos").unionByName(leads.select("doc_id", "mark", "pos")).unionByName(late.select("doc_id", "mark", "pos"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps, counts = [], []
        for at in batch.column(2):
            at = np.unique(at.values.to_numpy())
            keep = np.ones(-(-(int(at[-1]) + 1) // 8) * 8, np.uint8)  # whole bytes: lines past the last dropped one are kept
            keep[at] = 0
            maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 6))
            counts.append(len(at))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.binary()), pa.array(counts, pa.int64())], ["doc_id", "mark", "keep", "n_dropped"])


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, keep, n_dropped): of every document that loses lines a zlib-compressed bitmap, lowest bit first, of the
    lines it keeps. It ends with the byte of the last dropped line; what follows is kept."""
    at = dropped_lines(docs, min_docs, keep_first, id_col, text_col).groupBy("doc_id", "mark").agg(F.collect_set("pos").alias("at"))
    kind = at.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("mark", T.LongType()), T.StructField("keep", T.BinaryType()), T.StructField("n_dropped", T.LongType())])
    return at.mapInArrow(_packed, schema)


def _kept_texts(texts: pd.Series, keeps: pd.Series) -> pd.Series:
    def kept(text: str, keep: bytes | None) -> str:
        if keep is None:
            return text
        bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")
        return "\n".join(line for i, line in enumerate(text.split("\n")) if i >= len(bits) or bits[i])

    return pd.Series([kept(t, k) for t, k in zip(texts, keeps, strict=True)], dtype=object)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, out_col: str = "kept_text", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with out_col, the kept lines joined by line breaks, and n_lines and n_dropped (free names if taken)."""
    mark, n_lines, n_dropped = (free_name(n, docs) for n in ("mark", "n_lines", "n_dropped"))
    b_id, b_mark, b_keep, b_n = (free_name(f"b_{n}", docs) for n in ("id", "mark", "keep", "n"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.withColumn(mark, document_mark(id_col, text_col))
    maps = bitmaps.select(F.col("doc_id").alias(b_id), F.col("mark").alias(b_mark), F.col("keep").alias(b_keep), F.col("n_dropped").alias(b_n))
    joined = rows.join(maps, F.col(id_col).eqNullSafe(F.col(b_id)) & (F.col(mark) == F.col(b_mark)), "left")
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.pandas_udf(_kept_texts, T.StringType())(text, b_keep).alias(out_col), lines.cast("long").alias(n_lines), F.coalesce(b_n, F.lit(0)).cast("long").alias(n_dropped))
