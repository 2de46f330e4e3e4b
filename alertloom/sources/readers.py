"""Sources: NDJSON alerts and archives, JSON templates, text files, catalogues."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Accepted uploads with their size limit in bytes, and leading bytes that are refused.
UPLOAD_LIMITS = {"pdf": 10 << 20, "txt": 5 << 20, "md": 5 << 20}
REFUSED_MAGIC = ("4D5A", "7F454C46", "504B0304", "CAFEBABE")
TEMPLATE_ROWS = 1000


def read_ndjson(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(json, archive_source): one row per line that is a JSON object; blank and bad lines are left out. gzip is read as is."""
    lines = spark.read.text(paths).select(F.trim("value").alias("json"), F.col("_metadata.file_path").alias("archive_source"))
    return lines.filter((F.col("json") != "") & F.coalesce(F.get_json_object("json", "$").startswith("{"), F.lit(False)))


def tail(lines: DataFrame, n: int, order: str) -> DataFrame:
    """The last n rows by an arrival order, newest first."""
    return lines.orderBy(F.desc(order)).limit(n)


def archive_days(base: str, past_days: int, today: date | None = None) -> list[str]:
    """Paths base/YYYY/Mon/...-DD.json of yesterday and the days before; today is left out."""
    today = today or date.today()
    days = [today - timedelta(days=i) for i in range(1, past_days + 1)]
    return [f"{base}/{d:%Y}/{d:%b}/ossec-archive-{d:%d}.json" for d in days]


def read_archives(spark: SparkSession, base: str, past_days: int, today: date | None = None) -> DataFrame:
    """Rows of the days' plain files, or of a day's .gz file where the plain one is missing or has no rows; days without files are skipped."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()

    def there(path: str) -> bool:
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf).exists(p)

    def of_day(day: str) -> str | None:
        plain, packed = there(day), there(f"{day}.gz")
        if plain and not (packed and read_ndjson(spark, day).isEmpty()):
            return day
        return f"{day}.gz" if packed else None

    paths = [q for d in archive_days(base, past_days, today) if (q := of_day(d))]
    if not paths:
        return spark.createDataFrame([], "json string, archive_source string")
    return read_ndjson(spark, paths)


def expand_envelopes(rows: DataFrame, json_col: str = "json") -> DataFrame:
    """Rows {"alerts": [...]} become one row per object in them; other rows pass through."""
    inner = F.filter(F.from_json(F.get_json_object(json_col, "$.alerts"), "array<string>"), lambda x: F.trim(x).startswith("{"))
    packed = F.coalesce(F.get_json_object(json_col, "$.alerts").startswith("["), F.lit(False))
    return rows.withColumn(json_col, F.explode(F.when(packed, inner).otherwise(F.array(json_col))))


def read_template(spark: SparkSession, path: str) -> DataFrame:
    """An uploaded file: one object, an array, an envelope or NDJSON; more than TEMPLATE_ROWS rows is an error."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("t"))
    t = F.trim(F.col("t"))
    single = F.get_json_object(t, "$").isNotNull() & ~F.regexp_like(t, F.lit(r"(?s)^\{.*\}\s*\n\s*\{"))
    items = F.when(t.startswith("["), F.from_json(t, "array<string>")).when(single, F.array(t)).otherwise(F.filter(F.split(t, r"\r?\n"), lambda x: F.trim(x) != ""))
    rows = expand_envelopes(whole.select(F.explode(items).alias("json")))
    ok = F.coalesce(F.get_json_object("json", "$").startswith("{"), F.lit(False))
    rows = rows.withColumn("json", F.when(ok, F.col("json")).otherwise(F.raise_error(F.lit("every row of a template must be a JSON object"))))
    if rows.limit(TEMPLATE_ROWS + 1).count() > TEMPLATE_ROWS:
        raise ValueError(f"a template has at most {TEMPLATE_ROWS} rows")
    return rows


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """(name, path, length, content, content_hash, error): files with the reason of refusal, NULL for a good one.

    Spark's binary source leaves empty files out of its listing on some stores; where they show up they are refused.
    """
    f = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.element_at(F.split(name, r"\."), -1))
    limit = F.lit(0)
    for e, n in UPLOAD_LIMITS.items():
        limit = F.when(ext == e, n).otherwise(limit)
    head = F.hex(F.substring("content", 1, 4))
    bad = F.lit(False)
    for m in REFUSED_MAGIC:
        bad = bad | head.startswith(m)
    error = F.when(limit == 0, "unsupported type").when(F.col("length") == 0, "empty file").when(F.col("length") > limit, "file too large").when(bad, "refused content")
    return f.select(name.alias("name"), "path", "modificationTime", "length", "content", F.sha2("content", 256).alias("content_hash"), error.alias("error"))


def processed_files(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, path, size, content_hash, modified) of the processed texts, newest first; the hash is in one of the first ten lines."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*_processed*.txt").load(folder)
    head = F.slice(F.split(decode_text(F.col("content")), "\n"), 1, 10)
    stamped = F.get(F.filter(head, lambda x: x.startswith("# Content Hash:")), F.lit(0))
    given = F.trim(F.get(F.split(stamped, ":"), F.lit(1)))
    return f.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "path", F.col("length").alias("size"), given.alias("content_hash"), F.col("modificationTime").alias("modified")).orderBy(F.desc("modified"), "path")


def remove_older(spark: SparkSession, folder: str, days: int = 7, now: Column | None = None) -> int:
    """Delete processed texts last changed over `days` ago; the number of files deleted."""
    limit = (now if now is not None else F.current_timestamp()) - F.make_dt_interval(days=F.lit(days))
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*_processed*.txt").load(folder).select("path", "modificationTime")
    conf, gone = spark._jsc.hadoopConfiguration(), 0
    for row in listed.filter(F.col("modificationTime") < limit).toLocalIterator():
        p = spark._jvm.org.apache.hadoop.fs.Path(row.path)
        gone += bool(p.getFileSystem(conf).delete(p, False))
    return gone


def decode_text(content: Column) -> Column:
    """UTF-8 where it is valid, else Latin-1, which never fails."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def strip_markdown(text: Column) -> Column:
    out = F.regexp_replace(text, r"(?s)```.*?```", "")
    out = F.regexp_replace(out, r"(?m)^#{1,6}\s+", "")
    out = F.regexp_replace(out, r"\*\*([^*]+)\*\*", "$1")
    out = F.regexp_replace(out, r"\[([^\]]+)\]\([^)]*\)", "$1")
    return F.regexp_replace(out, r"`([^`]*)`", "$1")


def looks_tabular(text: Column) -> Column:
    """A page that names a table and has two aligned or two delimited lines."""
    lines = F.split(text, "\n")
    aligned = F.size(F.filter(lines, lambda x: F.regexp_count(x, F.lit(r"\S(?=\s{2,}\S)")) >= 2))
    delimited = F.size(F.filter(lines, lambda x: F.regexp_count(x, F.lit(r"[|\t;]")) >= 2))
    return text.rlike(r"(?i)\b(?:table|indicator|hash|domain|address|port)s?\b") & ((aligned >= 2) | (delimited >= 2))


def safe_name(name: Column) -> Column:
    """A file name without path or odd characters, its stem cut at 80."""
    base = F.regexp_replace(F.element_at(F.split(name, r"[/\\]"), -1), r"[^A-Za-z0-9._-]", "_")
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    return F.concat(F.left(stem, F.lit(80)), F.regexp_extract(base, r"(\.[^.]*)$", 1))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Technique catalogue (JSON array): id, name, tactic, deprecated; the last of equal ids counts."""
    c = spark.read.json(path, multiLine=True, schema="id string, name string, tactic string, deprecated boolean")
    return c.filter("id is not null").dropDuplicates(["id"])


@dataclass
class Settings:
    """Defaults < JSON file < environment variables, checked on construction."""

    chunk_size: int = 500
    chunk_overlap: int = 50
    document_chunk_size: int = 1200
    document_chunk_overlap: int = 120
    vector_size: int = 1024
    max_documents: int = 10
    similarity_threshold: float = 0.2
    candidate_multiplier: int = 4
    poll_seconds: int = 10
    severity_threshold: int = 8

    def __post_init__(self):
        if self.chunk_overlap >= self.chunk_size or self.document_chunk_overlap >= self.document_chunk_size:
            raise ValueError("an overlap must be smaller than its chunk")
        if not 0 <= self.similarity_threshold <= 1 or not 1 <= self.severity_threshold <= 16 or self.poll_seconds < 1:
            raise ValueError("a setting is out of range")

    @classmethod
    def load(cls, path: str | None = None, env: dict[str, str] | None = None, prefix: str = "ALERTLOOM_") -> Settings:
        import json
        from pathlib import Path

        values = json.loads(Path(path).read_text()) if path else {}
        for name, default in cls().__dict__.items():
            raw = (env or {}).get(prefix + name.upper())
            if raw is not None:
                values[name] = type(default)(raw)
        return cls(**{k: v for k, v in values.items() if k in cls.__dataclass_fields__})
