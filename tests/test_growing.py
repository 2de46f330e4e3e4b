"""Line files that grow, rotate, are cut and get lost."""

import json
import os

import pytest
from pyspark.sql import functions as F

from alertloom.functions import net
from alertloom.sources import growing
from alertloom.sources.growing import GrowingLines, GrowingReader
from alertloom.streaming import monitor as M


def lines(reader, start, end):
    return [(v, p) for part in reader.partitions(start, end) for b in reader.read(part) for v, p in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]


def reader(path, **options):
    return GrowingReader({"path": str(path), "pause": "0.01", **options})


def append(path, data, mode="ab"):
    with open(path, mode) as f:
        f.write(data)


def test_half_lines_wait_and_bytes_are_read_once(tmp_path):
    p = tmp_path / "a.json"
    r = reader(p)
    assert r.latestOffset() == {} and lines(r, {}, {}) == []
    append(p, "eins\nzwö".encode())
    a = r.latestOffset()
    assert lines(r, {}, a) == [("eins", 0)]
    append(p, b"\n\n  \r\nthree\r\nfo")
    b = r.latestOffset()
    assert [v for v, _ in lines(r, a, b)] == ["zwö", "three"] and lines(r, b, b) == []
    assert lines(reader(p), {}, b) == lines(r, {}, b)  # a restarted reader reads the same
    append(p, b"ur\n\xff\n")
    assert [v for v, _ in lines(r, b, r.latestOffset())] == ["four", "�"]


@pytest.mark.parametrize("size", [1, 3, 7, 64, 5000])
def test_tasks_cut_anywhere_give_every_line_once(tmp_path, size, monkeypatch):
    monkeypatch.setattr(growing, "STEP", 5)
    p = tmp_path / "a.json"
    want = [("x" * (i * 7 % 23) + str(i)) for i in range(60)]
    append(p, "".join(f"{x}\n" for x in want).encode() + b"rest")
    r = reader(p, bytes_per_task=str(size))
    end = r.latestOffset()
    assert [v for v, _ in lines(r, {}, end)] == want and (size > 2000 or len(r.partitions({}, end)) > 1)


def test_rotation_and_cutting(tmp_path):
    p = tmp_path / "a.json"
    r = reader(f"{p}*")
    append(p, b"1\n2\n")
    a = r.latestOffset()
    append(p, b"3\n")
    os.rename(p, tmp_path / "a.json.1")
    append(p, b"4\n")
    b = r.latestOffset()
    assert sorted(v for v, _ in lines(r, a, b)) == ["3", "4"]
    append(p, b"5\n6\n")
    c = r.latestOffset()
    append(p, b"7\n", "wb")  # cut in place
    d = r.latestOffset()
    with pytest.raises(growing.Lost):
        lines(r, b, c)
    assert lines(r, c, d) == [("7", 0)]
    append(p, b"8\n")
    assert [v for v, _ in lines(r, d, r.latestOffset())] == ["8"]


def test_a_lost_file_is_asked_for_again(tmp_path, monkeypatch):
    p = tmp_path / "a.json"
    append(p, b"1\n")
    r = reader(p, attempts="3")
    end = r.latestOffset()
    os.rename(p, tmp_path / "away")
    tries = []

    def back(seconds):
        tries.append(seconds)
        if len(tries) == 2:
            os.rename(tmp_path / "away", p)

    monkeypatch.setattr(growing.time, "sleep", back)
    assert lines(r, {}, end) == [("1", 0)] and tries == [0.01, 0.02]
    os.rename(p, tmp_path / "away")
    tries.clear()
    tries.extend([0, 0])
    with pytest.raises(growing.Lost):
        lines(reader(p, attempts="2"), {}, end)


class Shouting(growing.LocalFiles):
    def read(self, path, start, end):
        return super().read(path, start, end).upper()


def test_another_transport(tmp_path):
    p = tmp_path / "a.json"
    append(p, b"one\n")
    r = reader(p, transport=f"{__name__}:Shouting")
    assert lines(r, {}, r.latestOffset()) == [("ONE", 0)]


def alert(i, level, minute):
    return json.dumps({"timestamp": f"2024-01-01T00:{minute:02d}:00Z", "rule": {"level": level, "id": str(100000 + i % 3), "description": f"rule {i}"}, "data": {"src_ip": f"203.0.113.{i}", "dest_ip": "192.0.2.1"}})


def test_from_raw_lines_to_trigger_records(spark, tmp_path):
    """Lines appended between triggers, one of them in two halves, a repeated alert and a bad line."""
    p, records = tmp_path / "alerts.json", []
    mon = M.Monitor(f"{p}*", None, str(tmp_path / "ck"), str(tmp_path / "out"), on_trigger=lambda i, r: records.extend(r.collect()), source=lambda s, path: M.read_alerts(s, path, net.Assets()))
    first = alert(1, 9, 1)
    append(p, f"{alert(0, 14, 0)}\n{first[:40]}".encode())
    mon.start(spark, once=True).awaitTermination()
    assert [(r.alerts, r.critical, r.urgency) for r in records] == [(1, 1, "IMMEDIATE")]
    append(p, f"{first[40:]}\nnot json\n{alert(2, 3, 2)}\n{alert(0, 14, 0)}\n".encode())
    os.rename(p, tmp_path / "alerts.json.1")
    append(p, f"{alert(3, 8, 3)}\n".encode())
    mon.start(spark, once=True).awaitTermination()
    assert sum(r.alerts for r in records) == 3
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.src_ip for r in out.collect()) == ["203.0.113.0", "203.0.113.1", "203.0.113.3"]
    assert {r.severity for r in out.select(net.severity(F.col("rule_level")).alias("severity")).collect()} == {"critical", "high"} or out.count() == 3


def test_registered_name_and_missing_path(spark):
    spark.dataSource.register(GrowingLines)
    with pytest.raises(Exception, match="path"):
        spark.readStream.format("growing_lines").load().writeStream.format("noop").trigger(availableNow=True).start().awaitTermination()
