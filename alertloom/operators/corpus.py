"""The two stores (alert archive, document chunks) as Parquet tables: building, idempotent ingest, back-fill,
retention, status and duplicate checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.functions import chunk
from alertloom.functions import text as X

ARCHIVE = "alert_hash string, content string, vector array<float>, metadata string, source string, severity int, created_at timestamp, event_timestamp timestamp, event_date date"
CHUNKS = "doc_hash string, filename string, content string, vector array<float>, metadata string, chunk_index int, created_at timestamp"


def create_store(spark: SparkSession, path: str, schema: str) -> None:
    """An empty table with the declared schema, if there is none."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        spark.createDataFrame([], schema).write.parquet(path)


def drop_store(spark: SparkSession, path: str, confirm: bool = False) -> None:
    if not confirm:
        raise ValueError("dropping a store needs confirm=True")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def new_rows(rows: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Rows whose key the store lacks, one per key: insert-or-ignore."""
    return rows.dropDuplicates([key]).join(store.select(key), key, "left_anti")


def append_new(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Append the new rows to the store; a repeated run appends nothing."""
    store = rows.sparkSession.read.parquet(path)
    added = new_rows(rows, store, key)
    added.write.mode("append").parquet(path)
    return added


def pending(store: DataFrame, limit: int | None = None) -> DataFrame:
    rows = store.filter(F.col("vector").isNull())
    return rows.limit(limit) if limit else rows


def back_fill(store: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """The store with vectors of (key, vector) put where there are none; to be written as the table's next version."""
    v = vectors.select(key, F.col("vector").alias("__v")).dropDuplicates([key])
    return store.join(v, key, "left").withColumn("vector", F.coalesce("vector", "__v")).drop("__v").select(*store.columns)


def retained(store: DataFrame, days: int, now: Column | None = None) -> DataFrame:
    """Rows younger than `days` by event time, else creation time; rows without either stay."""
    at = F.coalesce("event_timestamp", "created_at")
    limit = (now if now is not None else F.current_timestamp()) - F.make_dt_interval(days=F.lit(days))
    return store.filter(at.isNull() | (at >= limit))


def embed(rows: DataFrame, encoder: Callable[[list[str]], list[list[float]]], size: int, text_col: str = "content", batch: int = 16, most: int = 6000) -> DataFrame:
    """Rows with `vector` from an injected encoder, called per batch of normalised texts; another width is an error."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = [v for i in range(0, len(s), batch) for v in encoder(s.iloc[i : i + batch].tolist())]
            if any(len(v) != size for v in out):
                raise ValueError(f"the encoder's vectors are not {size} wide")
            yield pd.Series(out)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return rows.withColumn("vector", F.pandas_udf(run, "array<float>")(X.normalise(F.col(text_col), most)))


def checked_vector(v: Column, size: int) -> Column:
    return F.when(v.isNull() | (F.size(v) == size), v).otherwise(F.raise_error(F.lit(f"a vector is not {size} wide")))


def content_hash(c: Column) -> Column:
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def archive_rows(cleaned: DataFrame, content: Column, now: Column | None = None) -> DataFrame:
    """Archive rows of cleaned alerts: hash of the content, metadata as JSON, event date for pruning."""
    at = F.col("timestamp").try_cast("timestamp")
    keep = [c for c in cleaned.columns if c not in ("json", "full_log")]
    return cleaned.select(content_hash(content).alias("alert_hash"), content.alias("content"), F.lit(None).cast("array<float>").alias("vector"), F.to_json(F.struct(*keep)).alias("metadata"), F.lit("archive").alias("source"), F.col("rule_level").alias("severity"), (now if now is not None else F.current_timestamp()).alias("created_at"), at.alias("event_timestamp"), at.cast("date").alias("event_date"))


def chunk_rows(documents: DataFrame, now: Column | None = None, **sizes: int) -> DataFrame:
    """Chunk rows of documents(filename, text): section-aware chunks with artefacts, labels, tags, dispositions and header lines."""
    named = documents.select(F.lit(None).alias("doc_id"), F.left("filename", F.lit(255)).alias("filename"), F.sha2("text", 256).alias("raw_hash"), "text")
    named = chunk.chunk_documents(named, "sections", keep=("filename", "raw_hash"), **sizes).withColumnRenamed("text", "chunk")
    body = F.col("chunk")
    rows = named.withColumn("artifacts", X.artifacts(body)).withColumn("labels", F.slice(F.array_union(X.context_labels(F.col("section_heading")), X.context_labels(body)), 1, 4)).withColumn("tags", X.behavior_tags(body))

    def role(kind: str) -> Column:
        return F.transform(F.slice(F.col(f"artifacts.{kind}"), 1, 30), lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value"), X.section_default(X.disposition(body, v, kind), F.col("labels")).alias("disposition")))

    rows = rows.withColumn("dispositions", F.concat(*[role(k) for k in ("ips", "domains", "urls", "hashes")]))
    header = F.concat_ws("\n", F.concat(F.lit("Document: "), F.col("filename")), F.when(F.col("section_path") != "", F.concat(F.lit("Section: "), F.col("section_path"))), F.nullif(X.labels_line(F.col("labels")), F.lit("")), F.nullif(X.tags_line(F.col("tags")), F.lit("")))
    content = F.concat_ws("\n", header, body)
    meta = F.to_json(F.struct("chunk_index", "chunk_count", "section_path", "section_heading", "artifacts", "labels", "tags", "dispositions", "raw_hash"))
    return rows.select(F.sha2(F.concat_ws(":", "raw_hash", "chunk_index", body), 256).alias("doc_hash"), "filename", content.alias("content"), F.lit(None).cast("array<float>").alias("vector"), meta.alias("metadata"), "chunk_index", (now if now is not None else F.current_timestamp()).alias("created_at"))


def status(archive: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: rows and embedded rows of both stores, and distinct source documents."""
    a = archive.agg(F.count("*").alias("archive_rows"), F.count("vector").alias("archive_embedded"))
    name = F.coalesce(F.get_json_object("metadata", "$.raw_hash"), F.nullif("filename", F.lit("")), F.col("doc_hash"))
    c = chunks.agg(F.count("*").alias("chunk_rows"), F.count("vector").alias("chunk_embedded"), F.count_distinct(name).alias("documents"))
    return a.join(c).withColumn("ready", (F.col("archive_embedded") > 0) | (F.col("chunk_embedded") > 0))  # one row each


def duplicate_uploads(uploads: DataFrame, processed: DataFrame, hash_col: str = "content_hash") -> DataFrame:
    """Uploads with `duplicate`: known already, or a repeat within the batch."""
    from pyspark.sql import Window as W

    known = processed.select(F.col(hash_col)).distinct().withColumn("__known", F.lit(True))
    n = F.row_number().over(W.partitionBy(hash_col).orderBy("name"))
    return uploads.join(known, hash_col, "left").withColumn("duplicate", F.coalesce("__known", F.lit(False)) | (n > 1)).drop("__known")


def approved_report_row(report: DataFrame) -> DataFrame:
    """Approved reports (report_id, markdown) as documents for the corpus, without their evidence appendices."""
    from alertloom.operators import reports

    body = reports.strip_appendix(F.col("markdown"))
    return report.select(F.col("report_id").alias("doc_id"), F.concat(F.lit("approved_report_"), F.col("report_id"), F.lit(".md")).alias("filename"), body.alias("text"), F.sha2(body, 256).alias("doc_sha256"), F.lit(True).alias("human_validated"))
