"""Files of any store that Spark's file systems reach, through them."""

from __future__ import annotations

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    fs, p = file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = file_system(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = file_system(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()


def publish(spark: SparkSession, made: str, target: str) -> bool:
    """Give a finished file its name if no file has it: True for exactly one of several writers.

    A store's rename without overwrite decides; for local files, whose rename overwrites, a hard link does.
    """
    jvm = spark._jvm
    fs, source = file_system(spark, made)
    goal = jvm.org.apache.hadoop.fs.Path(target)
    if fs.getScheme() == "file":
        get = jvm.java.nio.file.Paths.get
        try:
            jvm.java.nio.file.Files.createLink(get(goal.toUri().getPath(), _strings(spark)), get(source.toUri().getPath(), _strings(spark)))
        except Exception as e:
            if "FileAlreadyExistsException" not in str(e):
                raise
            return False
        finally:
            fs.delete(source, False)
        return True
    options = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration()).rename(source, goal, options)
    except Exception as e:
        if "FileAlreadyExistsException" not in str(e):
            raise
        fs.delete(source, False)
        return False
    return True


def _strings(spark: SparkSession):
    return spark._sc._gateway.new_array(spark._jvm.java.lang.String, 0)
