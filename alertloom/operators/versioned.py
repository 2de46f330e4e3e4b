"""A table of immutable segments with versions: inserts that ignore known keys, updates and deletes that rewrite files,
atomic commits by several writers, reads of any kept version.

<path>/data/<commit>/part=<hash> holds the Parquet files a commit wrote for a value of the partition column; a version is one small file
<path>/versions/<number>.json that lists its segments with their partition values and row counts. A writer reads the latest version, writes its segments
and then gives the next version's file its name. One writer of a number succeeds; the others, who built on a version that is no longer
the latest, do their work again on the new one. So a reader sees whole versions only, and a writer that dies leaves nothing but segments
that no version lists (`vacuum` removes them). A retried insert finds its keys in the table and adds nothing.

Versions list segments (a commit times its partition values), not files, so they stay small; they are read by the driver. Reads by
partition pass only the chosen segments to Spark. Keys compare null-safe, so one row without a key is kept. Rows of an insert
that share a key: the smallest row by the other columns stays, whatever the order. Columns are those declared at creation.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertloom.sources import files

#: How often a writer starts anew because another was faster.
ATTEMPTS = 20
NO_VALUE = "none"


class Conflict(RuntimeError):
    """Other writers were faster ATTEMPTS times."""


@dataclass(frozen=True)
class Segment:
    path: str
    partition: str
    rows: int


@dataclass(frozen=True)
class Version:
    number: int
    operation: str
    segments: tuple[Segment, ...]


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        head = json.loads(files.read_text(spark, f"{self.path}/table.json"))
        self.schema = T.StructType.fromJson(head["schema"])
        self.key, self.partition = head["key"], head["partition"]

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: str, key: str, partition: str | None = None) -> VersionedTable:
        """The table, made if there is none; an existing one keeps its declaration."""
        kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        made = f"{path}/table-{uuid4().hex}.tmp"
        files.write_text(spark, made, json.dumps({"schema": kind.jsonValue(), "key": key, "partition": partition}))
        files.publish(spark, made, f"{path}/table.json")
        return cls(spark, path)

    # --- versions ----------------------------------------------------------------------------------------------
    def _file(self, number: int) -> str:
        return f"{self.path}/versions/{number:012d}.json"

    def numbers(self) -> list[int]:
        return [int(n[:-5]) for n in files.names(self.spark, f"{self.path}/versions") if n.endswith(".json")]

    def version(self, number: int | None = None) -> Version:
        """The latest version, or the one of a number; version 0 is the empty table."""
        number = max(self.numbers(), default=0) if number is None else number
        if number == 0:
            return Version(0, "create", ())
        got = json.loads(files.read_text(self.spark, self._file(number)))
        return Version(number, got["operation"], tuple(Segment(**s) for s in got["segments"]))

    def history(self) -> DataFrame:
        """(version, operation, segments, rows) of every version kept."""
        rows = [(v.number, v.operation, len(v.segments), sum(s.rows for s in v.segments)) for v in map(self.version, self.numbers())]
        return self.spark.createDataFrame(rows, "version int, operation string, segments int, rows long")

    def read(self, number: int | None = None, partitions: Callable[[str], bool] | None = None) -> DataFrame:
        """A version's rows; `partitions` chooses segments by the partition value's text before Spark lists any file."""
        return self._frame([s for s in self.version(number).segments if partitions is None or partitions(s.partition)])

    def _frame(self, segments: list[Segment]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[s.path for s in segments])

    def _write(self, rows: DataFrame) -> list[Segment]:
        """Rows as segments of one commit that no version lists yet."""
        commit = f"{self.path}/data/{uuid4().hex}"
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
        text = F.coalesce(F.col(self.partition).cast("string"), F.lit(NO_VALUE)) if self.partition else F.lit("all")
        rows.withColumn("part", F.left(F.md5(text), F.lit(16))).write.partitionBy("part").parquet(commit)
        if not any(n.startswith("part=") for n in files.names(self.spark, commit)):
            return []
        # a row for each segment
        made = self.spark.read.schema(T.StructType([*self.schema, T.StructField("part", T.StringType())])).parquet(commit)
        return [Segment(f"{commit}/part={r.part}", r.value, r.n) for r in made.groupBy("part").agg(F.min(text).alias("value"), F.count("*").alias("n")).orderBy("value").collect()]

    def _commit(self, base: Version, operation: str, segments: list[Segment]) -> bool:
        body = json.dumps({"operation": operation, "segments": [s.__dict__ for s in segments]})
        made = f"{self.path}/versions/{uuid4().hex}.tmp"
        files.write_text(self.spark, made, body)
        return files.publish(self.spark, made, self._file(base.number + 1))

    def _change(self, operation: str, attempt: Callable[[Version], list[Segment] | None]) -> Version:
        """Build the next version on the latest until no other writer was faster; None changes nothing."""
        for _ in range(ATTEMPTS):
            base = self.version()
            segments = attempt(base)
            if segments is None:
                return base
            if self._commit(base, operation, segments):
                return Version(base.number + 1, operation, tuple(segments))
        raise Conflict(f"{operation}: other writers were faster {ATTEMPTS} times")

    # --- changes -----------------------------------------------------------------------------------------------
    def insert(self, rows: DataFrame) -> Version:
        """Add the rows whose key the table lacks, one per key."""
        others = [f.name for f in self.schema if f.name != self.key]
        one = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).groupBy(self.key).agg(F.min(F.struct(*others)).alias("__row")).select(self.key, *[F.col(f"__row.{c}").alias(c) for c in others])

        def attempt(base: Version) -> list[Segment] | None:
            known = self._frame(list(base.segments)).select(F.col(self.key).alias("__key"))
            added = self._write(one.join(known, one[self.key].eqNullSafe(known["__key"]), "left_anti"))
            return [*base.segments, *added] if added else None

        return self._change("insert", attempt)

    def update(self, changes: DataFrame, only_null: bool = False) -> Version:
        """Set columns of rows by key: `changes` has the key and the columns to set, one row a key (the greatest if several).

        With only_null a column that holds a value keeps it (back-fill). Only segments with a row to change are rewritten.
        """
        columns = [c for c in changes.columns if c != self.key]
        new = changes.groupBy(self.key).agg(F.max(F.struct(*columns)).alias("__new")).withColumnRenamed(self.key, "__key")

        def value(c: str) -> Column:
            got = F.col(f"__new.{c}")
            return F.coalesce(F.col(c), got) if only_null else F.when(F.col("__key_found"), got).otherwise(F.col(c))

        def attempt(base: Version) -> list[Segment] | None:
            keys = new
            wanted = F.lit(False)
            for c in columns:
                differs = F.col(c).isNull() & F.col(f"__new.{c}").isNotNull() if only_null else ~F.col(c).eqNullSafe(F.col(f"__new.{c}"))
                wanted = wanted | differs
            rows = self._marked(base)
            touched = rows.join(keys, rows[self.key].eqNullSafe(keys["__key"])).filter(wanted).select("__segment").distinct()
            old = self._of(base, touched)
            if not old:
                return None
            rows = self._frame(old)
            found = keys.withColumn("__key_found", F.lit(True))
            joined = rows.join(found, rows[self.key].eqNullSafe(found["__key"]), "left").withColumn("__key_found", F.coalesce("__key_found", F.lit(False)))
            changed = joined.select(*[(value(f.name) if f.name in columns else F.col(f.name)).alias(f.name) for f in self.schema])
            return [*(s for s in base.segments if s not in set(old)), *self._write(changed)]

        return self._change("back-fill" if only_null else "update", attempt)

    def delete(self, condition: Column, whole: Callable[[str], bool | None] | None = None) -> Version:
        """Remove the rows for which the condition is true. `whole` may answer for a partition value alone: True removes its segments, False
        keeps them, both without reading them; None looks into them. Segments without such a row are not rewritten."""

        def attempt(base: Version) -> list[Segment] | None:
            answers = {s: whole(s.partition) if whole else None for s in base.segments}
            kept = [s for s in base.segments if answers[s] is False]
            unsure = Version(base.number, "", tuple(s for s in base.segments if answers[s] is None))
            old = self._of(unsure, self._marked(unsure).filter(condition).select("__segment").distinct()) if unsure.segments else []
            kept += [s for s in unsure.segments if s not in set(old)]
            if len(kept) == len(base.segments):
                return None
            rest = self._write(self._frame(old).filter(~F.coalesce(condition, F.lit(False)))) if old else []
            return [*kept, *rest]

        return self._change("delete", attempt)

    def _marked(self, version: Version) -> DataFrame:
        """Rows with the folder of their segment."""
        folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
        return self._frame(list(version.segments)).withColumn("__segment", folder) if version.segments else self._frame([]).withColumn("__segment", F.lit(""))

    def _of(self, version: Version, folders: DataFrame) -> list[Segment]:
        """The version's segments among folders, of which there are no more than segments."""
        ends = {tuple(r[0].split("/")[-2:]) for r in folders.collect()}
        return [s for s in version.segments if tuple(s.path.split("/")[-2:]) in ends]

    def vacuum(self, keep: int = 1) -> int:
        """Forget all but the last `keep` versions and remove the commits none of them lists; the number removed. Not while others write."""
        numbers = self.numbers()
        for n in numbers[:-keep]:
            files.remove(self.spark, self._file(n))
        live = {s.path.rsplit("/", 2)[-2] for n in numbers[-keep:] for s in self.version(n).segments}
        dead = [c for c in files.names(self.spark, f"{self.path}/data") if c not in live]
        for c in dead:
            files.remove(self.spark, f"{self.path}/data/{c}")
        return len(dead)


def retain(table: VersionedTable, days: int, today: str) -> Version:
    """Delete what is older than `days` before `today` (YYYY-MM-DD) by event date; rows without a date stay. Whole partitions go unread."""
    limit = (datetime.date.fromisoformat(today) - datetime.timedelta(days=days)).isoformat()
    return table.delete(F.col(table.partition) < F.lit(limit).cast("date"), whole=lambda value: value != NO_VALUE and value < limit)
