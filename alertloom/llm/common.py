"""Helpers shared by the operators: scratch tables in the shared folder and input selection."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Records and bytes of an Arrow batch handed to Python; texts are long, so batches stay small.
ARROW_RECORDS, ARROW_BYTES = 1000, 64 << 20
#: Files a core writes of a compact table.
FILES_PER_CORE = 4
#: A key with over one in HOT_SHARES rows of a table is hot; a table has fewer than HOT_SHARES such keys.
HOT_SHARES = 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or a local one where it is unset (tests)."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="alertloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


class Scratch:
    """Tables written to the shared folder: they cut lineage, and lost executors don't lose them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame, compact: bool = False) -> DataFrame:
        """df as written; compact for what is small beside its tasks, which are then many: a few files a core."""
        if compact:
            df = df.repartition(FILES_PER_CORE * self.spark.sparkContext.defaultParallelism)
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Remove a table of save() that nothing reads any more."""
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = self.spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def small_batches(spark: SparkSession) -> None:
    """Lower the session's bounds on Arrow batches; they count when a plan runs, so they stay."""
    for key, most in (("maxRecordsPerBatch", ARROW_RECORDS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).upper().rstrip("B")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def join_each(left: DataFrame, right: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """left joined with right, which has one row a key and in column n the number of left's `total` rows that hold it.

    Hot keys, at most HOT_SHARES of them, go by broadcast, so their rows stay where they are; the others are shuffled.
    """
    hot = F.col(n) * HOT_SHARES > F.lit(total)
    few = F.broadcast(right.filter(hot).drop(n))
    rest = left.join(few.select(*keys), keys, "left_anti").join(right.filter(~hot).drop(n), keys)
    return left.join(few, keys).unionByName(rest)


def free_name(wanted: str, *taken: DataFrame) -> str:
    """`wanted`, with underscores appended until no column of the frames has the name."""
    names = {c.lower() for df in taken for c in df.columns}
    while wanted.lower() in names:
        wanted += "_"
    return wanted


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long_array(values: list[int]) -> Column:
    """A constant array<bigint>; callers bound its length."""
    return F.expr("array(" + ",".join(f"{v}L" for v in values) + ")") if values else F.expr("cast(array() as array<bigint>)")
