"""Inverted-file index over vectors: a coarse quantiser, its lists as a partitioned table, and probing by list number.

The quantiser (spherical k-means) is fitted on the rows with the smallest id hashes, at most SAMPLE_ROWS of them and SAMPLE_FLOATS
numbers; every row is then put into the list of its nearest centroid. A query is sent to its `probes` nearest lists and
meets their rows in a cogroup on (list, part, block): lists are cut into parts of about PART_ROWS rows and queries into blocks of
about BLOCK_QUERIES, so neither a large list nor many queries meet in one task. Only the best k of a part leave it.
Probing all lists is exact search; there a query is sent to parts of at most about WHOLE_ROWS rows of any list, not to each list.
How many probes reach a recall is read off the sample, where neighbours are further apart than among all rows, so the number
errs on the high side; `recall` measures it against exact search.

Vectors that are null, zero, of another width than most of the sample or not finite are in no list and are found by no query; such
queries find nothing. Rows without an id are not indexed. Repeated rows are found each. Equal scores go by id.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertloom.sources.files import remove

SAMPLE_ROWS, SAMPLE_FLOATS, MOST_LISTS, ROUNDS = 20_000, 8_000_000, 1024, 12
PART_ROWS, BLOCK_QUERIES = 20_000, 5_000
#: Where every list is probed: rows and numbers of a part at most; parts and their rows where there are fewer rows than that.
WHOLE_ROWS, WHOLE_FLOATS, LEAST_PARTS, LEAST_ROWS = 100_000, 8_000_000, 16, 5_000
CALIBRATION_QUERIES, TARGET = 200, 0.97


def usable(v: Column, width: int | None = None) -> Column:
    """Vectors that have a direction: of the width, finite, not zero."""
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(good & ((F.size(v) == width) if width else (F.size(v) > 0)), F.lit(False))


def _matrix(column: pa.ChunkedArray | pd.Series) -> np.ndarray:
    """Unit rows, in double precision."""
    if isinstance(column, pd.Series):
        m = np.stack(column.to_list()).astype(np.float64) if len(column) else np.zeros((0, 1))
    else:
        flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
        m = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    # a large or tiny vector is scaled first, so that its norm neither overflows nor vanishes
    m = m / np.abs(m).max(axis=1, initial=0, keepdims=True) if len(m) else m
    return m / np.linalg.norm(m, axis=1, keepdims=True) if len(m) else m


def quantiser(sample: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Unit centroids of spherical k-means; an empty list takes the row that fits its own list worst."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(ROUNDS):
        near = sample @ centroids.T
        own, fit = near.argmax(1), near.max(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=lists) == 0)
        if len(empty):
            sums[empty] = sample[np.argsort(fit)[: len(empty)]]
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centroids)
    return centroids


def probes_for(sample: np.ndarray, centroids: np.ndarray, k: int, target: float) -> int:
    """The fewest probes that find `target` of the k nearest of sampled queries within the sample."""
    queries = sample[:CALIBRATION_QUERIES]
    near = queries @ sample.T
    best = np.argpartition(-near, min(k, len(sample) - 1), axis=1)[:, :k]
    lists = (sample @ centroids.T).argmax(1)
    place = np.argsort(np.argsort(-(queries @ centroids.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(place, lists[best], axis=1).ravel()) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)])


def _nearest(centroids: np.ndarray, n: int):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            near = _matrix(s) @ centroids.T if len(s) else np.zeros((0, len(centroids)))
            order = np.argsort(-near, axis=1, kind="stable")[:, :n].astype(np.int32)
            yield pd.Series(list(order))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.ArrayType(T.IntegerType()))


def _best(k: int, schema: pa.Schema):
    """The k nearest rows of a part for each query of a block."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return schema.empty_table()
        there, asked = _matrix(rows.column("vector")), _matrix(queries.column("vector"))
        ids, found = rows.column("id").combine_chunks(), []
        order = np.array(pc.sort_indices(ids))
        there = there[order]  # by id, so that a stable sort by score breaks ties by it
        step = max(1, 4_000_000 // len(there))
        at, of, scores = [], [], []
        for a in range(0, len(asked), step):
            near = np.round(asked[a : a + step] @ there.T, 12)
            for j, s in enumerate(near):
                if len(s) > k:
                    over = np.flatnonzero(s >= np.partition(s, -k)[-k])
                    over = over[np.argsort(-s[over], kind="stable")][:k]
                else:
                    over = np.argsort(-s, kind="stable")
                at.append(order[over])
                of.append(np.full(len(over), a + j))
                scores.append(s[over])
        at, of = pa.array(np.concatenate(at)), pa.array(np.concatenate(of))
        found = [queries.column("query_id").take(of), ids.take(at), pa.array(np.concatenate(scores))]
        return pa.Table.from_arrays(found, schema.names).cast(schema)

    return run


@dataclass(frozen=True)
class VectorIndex:
    """An index on disk: <path>/lists (partitioned by list), <path>/sizes and the quantiser in <path>/quantiser."""

    path: str
    centroids: np.ndarray
    width: int
    probes: int
    id_type: T.DataType

    @classmethod
    def build(cls, rows: DataFrame, path: str, lists: int | None = None, k: int = 10, target: float = TARGET) -> VectorIndex:
        """Index rows (id, vector). `lists` defaults to the square root of their number, MOST_LISTS at most."""
        spark = rows.sparkSession
        rows = rows.select("id", F.col("vector").cast("array<float>").alias("vector")).filter(F.col("id").isNotNull() & usable(F.col("vector")))
        widths = rows.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").limit(1).collect()
        if not widths:
            return cls(path, np.zeros((0, 1)), 0, 0, rows.schema["id"].dataType)._save(spark, rows.limit(0))
        width, n = widths[0]
        rows = rows.filter(F.size("vector") == width)
        most = max(1, min(SAMPLE_ROWS, SAMPLE_FLOATS // width))
        # a share by hash is ranked, half as many again as are taken, so that no task has to send its own best
        mark, share = F.pmod(F.xxhash64("id"), F.lit(1_000_000_007)), min(1.0, 1.5 * most / n)
        sample = _matrix(rows.filter(mark <= int(share * 1_000_000_007)).orderBy(mark, "id").limit(most).select("vector").toArrow().column(0))
        lists = min(lists or max(1, round(n**0.5)), MOST_LISTS, len(sample))
        centroids = quantiser(sample, lists)
        return cls(path, centroids, width, probes_for(sample, centroids, k, target), rows.schema["id"].dataType)._save(spark, rows)

    def _save(self, spark: SparkSession, rows: DataFrame) -> VectorIndex:
        own = _nearest(self.centroids, 1)(F.col("vector"))[0] if len(self.centroids) else F.lit(0)
        # parts are cut by a hash of the id within each list; sizes are known after this write
        rows.withColumn("list", own).write.mode("overwrite").parquet(f"{self.path}/placed")
        placed = spark.read.parquet(f"{self.path}/placed")
        sizes = placed.groupBy("list").agg(F.count("*").alias("n_rows")).withColumn("parts", F.ceil(F.col("n_rows") / PART_ROWS).cast("int"))
        sizes.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/sizes")
        sizes = spark.read.parquet(f"{self.path}/sizes")
        # a row for each list, MOST_LISTS at most
        parted = placed.join(F.broadcast(sizes), "list").select("list", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "vector")
        parted.repartition("list", "part").write.mode("overwrite").partitionBy("list").parquet(f"{self.path}/lists")
        remove(spark, f"{self.path}/placed")
        flat = [(i, c.tolist()) for i, c in enumerate(self.centroids)]
        meta = spark.createDataFrame([(json.dumps({"width": self.width, "probes": self.probes, "id": self.id_type.jsonValue()}), flat)], "meta string, centroids array<struct<list:int,centroid:array<double>>>")
        meta.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/quantiser")
        return self

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        row = spark.read.parquet(f"{path}/quantiser").first()
        meta = json.loads(row.meta)
        flat = sorted((c["list"], c["centroid"]) for c in row.centroids)
        return cls(path, np.array([c for _, c in flat]) if flat else np.zeros((0, 1)), meta["width"], meta["probes"], T.StructType.fromJson({"type": "struct", "fields": [{"name": "id", "type": meta["id"], "nullable": True, "metadata": {}}]})["id"].dataType)

    @property
    def lists(self) -> int:
        return len(self.centroids)

    def rows(self, spark: SparkSession) -> DataFrame:
        """(part, id, vector, list) of every indexed row."""
        fields = [("part", T.IntegerType()), ("id", self.id_type), ("vector", T.ArrayType(T.FloatType())), ("list", T.IntegerType())]
        return spark.read.schema(T.StructType([T.StructField(n, t) for n, t in fields])).parquet(f"{self.path}/lists")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, threshold: float | None = None) -> DataFrame:
        """(query_id, id, score, rank): the k best rows of the probed lists for each of queries (query_id, vector)."""
        spark = queries.sparkSession
        probes = min(self.lists, probes or self.probes)
        kinds = [T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("id", self.id_type), T.StructField("score", T.DoubleType())]
        asked = queries.select("query_id", F.col("vector").cast("array<float>").alias("vector")).filter(usable(F.col("vector"), self.width or -1))
        if not self.lists:
            return spark.createDataFrame([], T.StructType([*kinds, T.StructField("rank", T.IntegerType())]))
        blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
        sizes = spark.read.parquet(f"{self.path}/sizes")
        names = pa.schema([(f.name, t) for f, t in zip(kinds, (_arrow(f.dataType) for f in kinds), strict=True)])
        if probes == self.lists:
            n = sizes.agg(F.sum("n_rows")).first()[0]
            parts = max(-(-n // max(1, min(WHOLE_ROWS, WHOLE_FLOATS // self.width))), min(LEAST_PARTS, -(-n // LEAST_ROWS)))
            there = self.rows(spark).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
            sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "query_id", "vector")
            key = ["part", "block"]
        else:
            there, sent, key = self._probed(asked, probes, sizes)
        there = there.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        sent = sent.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        found = there.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(_best(k, names), T.StructType(kinds))
        if threshold is not None:
            found = found.filter(F.col("score") >= threshold)
        ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id")))
        return ranked.filter(F.col("rank") <= k)

    def _probed(self, asked: DataFrame, probes: int, sizes: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
        """Rows of the probed lists, queries for each part of the lists they probe, and what they meet on."""
        sizes = F.broadcast(sizes.select("list", "parts"))  # MOST_LISTS rows at most
        sent = asked.select("query_id", "vector", F.explode(_nearest(self.centroids, probes)("vector")).alias("list")).join(sizes, "list")
        sent = sent.select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "query_id", "vector")
        # only lists that some query probes are read: their numbers, MOST_LISTS at most, prune the partitions
        probed = [r[0] for r in sent.select("list").distinct().collect()]
        return self.rows(asked.sparkSession).filter(F.col("list").isin(probed)), sent, ["list", "part", "block"]

    def recall(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """One row (queries, k, lists, probes, recall): the share of the exact k nearest that probing finds."""
        probes = min(self.lists, probes or self.probes)
        found, exact = self.search(queries, k, probes), self.search(queries, k, max(1, self.lists))
        hit = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")).distinct(), ["query_id", "id"], "left")
        share = F.coalesce(F.count("hit") / F.nullif(F.count("*"), F.lit(0)), F.lit(1.0))
        return hit.agg(F.count_distinct("query_id").alias("queries"), share.alias("recall")).select("queries", F.lit(k).alias("k"), F.lit(self.lists).alias("lists"), F.lit(probes).alias("probes"), "recall")


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
