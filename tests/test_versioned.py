"""Versions of a table under concurrent, retried and failing writers."""

import datetime
import threading

import pytest
from pyspark.sql import functions as F

from alertloom.operators import versioned
from alertloom.operators.versioned import VersionedTable
from alertloom.sources import files

SCHEMA = "id long, event_date date, note string, vector array<float>"


def day(n):
    return datetime.date(2024, 1, n)


def rows(spark, *ids, note="n"):
    return spark.createDataFrame([(i, day(1 + i % 3) if i is not None and i % 7 else None, f"{note}{i}", None) for i in ids], SCHEMA)


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable.create(spark, str(tmp_path / "t"), SCHEMA, "id", "event_date")


def ids(df):
    return sorted((r.id for r in df.collect()), key=lambda x: (x is None, x or 0))


def test_inserts_ignore_known_keys_and_versions_stay(spark, table):
    assert table.version().number == 0 and table.read().count() == 0
    table.insert(rows(spark, 1, 2, 2, 7, None))
    again = table.insert(rows(spark, 1, 2, 7, None, note="other"))
    assert again.number == 1 and ids(table.read()) == [1, 2, 7, None]
    table.insert(rows(spark, 2, 3))
    assert ids(table.read(1)) == [1, 2, 7, None] and ids(table.read()) == [1, 2, 3, 7, None]
    assert {r.note for r in table.read().collect()} == {"n1", "n2", "n3", "n7", "nNone"}
    assert [tuple(r) for r in table.history().orderBy("version").collect()] == [(1, "insert", 3, 4), (2, "insert", 4, 5)]
    two = spark.createDataFrame([(9, None, "b", None), (9, None, "a", None)], SCHEMA)
    table.insert(two)
    assert table.read().filter("id = 9").first().note == "a"


def test_concurrent_writers_leave_each_key_once(spark, table):
    failed = []

    def write(k):
        try:
            VersionedTable(spark, table.path).insert(rows(spark, *range(k * 5, k * 5 + 10), note=f"w{k}-"))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and ids(table.read()) == list(range(25))
    assert table.numbers() == list(range(1, len(table.numbers()) + 1)) and table.version().number in (3, 4)  # the last may find all its keys there


def test_a_slower_writer_starts_anew(spark, table, monkeypatch):
    real, calls = VersionedTable._commit, []

    def late(self, base, operation, segments):
        if not calls:
            calls.append(1)
            VersionedTable(spark, self.path).insert(rows(spark, 5, 6, note="fast"))
        return real(self, base, operation, segments)

    monkeypatch.setattr(VersionedTable, "_commit", late)
    table.insert(rows(spark, 4, 5, note="slow"))
    assert {r.id: r.note for r in table.read().collect()} == {4: "slow4", 5: "fast5", 6: "fast6"}
    monkeypatch.setattr(VersionedTable, "_commit", lambda *a: False)
    with pytest.raises(versioned.Conflict):
        table.insert(rows(spark, 100))
    assert 100 not in ids(table.read())


def test_a_writer_that_dies_leaves_no_rows_and_may_retry(spark, table, monkeypatch):
    table.insert(rows(spark, 1))
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.insert(rows(spark, 2))
    assert ids(table.read()) == [1]
    table.insert(rows(spark, 2))
    assert ids(table.read()) == [1, 2] and table.vacuum(keep=2) == 1 and ids(table.read()) == [1, 2]


def test_back_fill_rewrites_only_segments_with_a_change(spark, table):
    table.insert(rows(spark, 1, 2, 3, 4, 7))
    before = {s.path for s in table.version().segments}
    vectors = spark.createDataFrame([(1, [1.0]), (1, [0.5]), (4, [2.0]), (99, [3.0])], "id long, vector array<float>")
    table.update(vectors, only_null=True)
    assert {r.id: r.vector for r in table.read().collect()} == {1: [1.0], 2: None, 3: None, 4: [2.0], 7: None}
    assert len(before & {s.path for s in table.version().segments}) == len(before) - 1
    number = table.version().number
    table.update(spark.createDataFrame([(1, [9.0])], "id long, vector array<float>"), only_null=True)
    assert table.version().number == number
    table.update(spark.createDataFrame([(1, None), (2, "set")], "id long, note string"))
    assert {r.id: r.note for r in table.read().collect()} == {1: None, 2: "set", 3: "n3", 4: "n4", 7: "n7"}


def test_retention_and_dated_reads(spark, table):
    table.insert(rows(spark, *range(1, 15)))
    chosen = table.read(partitions=lambda d: d == "2024-01-02")
    assert ids(chosen) == [1, 4, 10, 13] and {f.rsplit("/", 2)[-2] for f in chosen.inputFiles()} == {s.path.rsplit("/", 1)[-1] for s in table.version().segments if s.partition == "2024-01-02"}
    reads = []
    real = VersionedTable._frame
    VersionedTable._frame = lambda self, segments: reads.append(segments) or real(self, segments)
    try:
        versioned.retain(table, 1, "2024-01-03")
    finally:
        VersionedTable._frame = real
    assert ids(table.read()) == [1, 2, 4, 5, 7, 8, 10, 11, 13, 14] and all("2024-01-01" not in {s.partition for s in x} for x in reads)
    table.delete(F.col("id") > 10)
    assert ids(table.read()) == [1, 2, 4, 5, 7, 8, 10] and ids(table.read(1)) == list(range(1, 15))
    number = table.version().number
    table.delete(F.col("id") > 1000)
    assert table.version().number == number
    table.vacuum()
    assert table.numbers() == [number] and ids(table.read()) == [1, 2, 4, 5, 7, 8, 10]


def test_publish_lets_one_win(spark, tmp_path):
    for i in range(2):
        files.write_text(spark, f"{tmp_path}/{i}.tmp", f"text {i}")
    assert files.publish(spark, f"{tmp_path}/0.tmp", f"{tmp_path}/x") is True
    assert files.publish(spark, f"{tmp_path}/1.tmp", f"{tmp_path}/x") is False
    assert files.read_text(spark, f"{tmp_path}/x") == "text 0" and [n for n in files.names(spark, str(tmp_path)) if not n.endswith(".crc")] == ["x"]
    files.write_text(spark, f"{tmp_path}/2.tmp", "é")
    assert files.read_text(spark, f"{tmp_path}/2.tmp") == "é"
