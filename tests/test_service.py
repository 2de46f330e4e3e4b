"""Driver-side service parts, IPv6 membership and processed files."""

import ipaddress
import os
import random
import threading

from pyspark.sql import functions as F

from alertloom.functions import net
from alertloom.operators import analytics as N
from alertloom.operators import corpus as C
from alertloom.operators import reporting as G
from alertloom.sources import readers
from alertloom.streaming import service as V
from alertloom.streaming import monitor as M


def test_ipv6_equals_the_standard_library(spark):
    r = random.Random(4)
    texts = ["::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1::2::3", ":::", ":1", "1:", "12345::", "g::", "::ffff:1.2.3.4", "::1.2.3.400", "1.2.3.4", "", "fe80::A", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3.4:5", None]
    for _ in range(300):
        a = ipaddress.IPv6Address(r.getrandbits(128) & r.choice([(1 << 128) - 1, 0xFFFF << 64 | 0xFFFF, (1 << 40) - 1]))
        texts += [a.compressed, a.exploded.upper()]
        texts.append("".join(r.choice(["1", "ab", ":", ":", "::", "0"]) for _ in range(r.randint(1, 14))))

    def digits(t):
        try:
            return f"{int(ipaddress.IPv6Address(t)):032x}"
        except (ValueError, TypeError):
            return None

    blocks = ("2000::/3", "::/96", "fd00::/8", "bad", "10.0.0.0/8")
    rows = spark.createDataFrame([(t,) for t in texts], "ip string").select("ip", net.ip6_digits(F.col("ip")).alias("d"), net.in_blocks(net.ip_number(F.col("ip")), blocks, F.col("ip")).alias("inside")).collect()
    nets = [ipaddress.ip_network(b) for b in blocks if b != "bad"]
    for x in rows:
        assert x.d == digits(x.ip), x
        if x.d:
            assert x.inside == any(ipaddress.ip_address(x.ip) in n for n in nets), x


def test_inventory_prompt():
    a = net.Assets(infrastructure=("203.0.113.9", "bad"), owned=("192.0.2.7/24",), internal=("10.0.0.0/8", "fd00::/8"))
    assert a.summary() == {"owned_cidrs": ["192.0.2.0/24"], "infrastructure_ips": ["203.0.113.9"], "internal_cidrs": ["10.0.0.0/8", "fd00::/8"]}
    assert a.prompt().split("\n")[0] == "Owned protected CIDRs/IPs: 192.0.2.0/24" and a.prompt().count("\n") == 3


def test_location_of_wide_and_missing_ranges(spark):
    ranges = spark.createDataFrame([(1 << 24, (3 << 24) - 1, "W"), (45 << 24, (45 << 24) + 9, "N")], "lo long, hi long, country string")
    ips = ["1.0.0.0", "2.255.255.255", "3.0.0.0", "45.0.0.9", "45.0.0.10", "x", None]
    got = N.geo_lookup(spark.createDataFrame([(i, ip) for i, ip in enumerate(ips)], "i int, ip string"), ranges, "ip", "c").orderBy("i").collect()
    assert [x.c for x in got] == ["W", "W", None, "N", None, None, None]


class Source:
    def __init__(self, up=True, error=None):
        self.up, self.error, self.is_connected = up, error, False

    def connect(self):
        self.is_connected = self.up
        return self.up

    def read(self, n):
        if self.error:
            raise OSError(self.error)
        return list(range(n))

    def disconnect(self):
        self.is_connected = False


def test_connection_is_opened_again():
    made = [Source(False), Source(error="lost connection"), Source(error="bad record"), Source()]
    given = iter(made)
    c = V.Connection(lambda: next(given), clock=lambda: 5.0)
    assert c.read() == [] and c.attempts == 1
    assert c.read() == [] and c.attempts == 0 and c.source is None  # lost while reading
    assert c.read() == [] and c.source is made[2]  # another error keeps the connection
    made[2].is_connected = False
    assert c.read(3) == [0, 1, 2] and c.connected_at == 5.0
    c.close()
    assert c.source is None and not made[3].is_connected and not c.ensure() and c.attempts == 1


def test_waiting_reports_are_merged_and_bounded(spark):
    def alerts(*ids):
        return spark.createDataFrame([(i, "2024-01-01 00:00:00", f"10.0.0.{i}") for i in ids], "rule_id int, ts string, src_ip string").withColumns({"ts": F.col("ts").cast("timestamp"), "dest_ip": F.lit("x"), "rule_description": F.lit("d")})

    begun, go, seen = threading.Event(), threading.Event(), []

    def generate(df):
        begun.set()
        go.wait(60)
        seen.append(sorted(r.rule_id for r in df.collect()))

    q = V.ReportQueue(generate, size=2, wait=0.0)
    first = threading.Thread(target=q.submit, args=(alerts(1, 2),))
    first.start()
    begun.wait(60)
    assert [q.submit(alerts(3)), q.submit(alerts(3, 4)), q.submit(alerts(5))] == [True, True, False] and q.refused == 1
    go.set()
    first.join(60)
    assert q.submit(alerts(4, 6)) and seen == [[1, 2], [3, 4, 6]] and q.reports == 2 and not q.waiting


def test_progress_of_tasks_and_sessions():
    now = [0.0]
    p = V.Progress(lambda: now[0])
    assert all(p.connect(f"s{i}") for i in range(V.MOST_SESSIONS)) and not p.connect("more") and p.connect("s0")
    p.start("t", "report", 200)
    p.update("t", "a", step=50)
    assert (p.tasks["t"].progress, p.tasks["t"].status) == (25, "running")
    now[0] = 10.0
    p.update("t", "b", progress=140)
    p.update("t", "done", status="success")
    s = p.statistics()
    assert s["tasks"]["t"] == {"status": "completed", "progress": 100, "step": 200, "duration_seconds": 10.0, "message_count": 3}
    assert s["sessions"]["s1"] == {"duration_seconds": 10.0, "idle_seconds": 0.0, "message_count": 3}
    for i in range(60):
        now[0] += 1
        p.start(f"f{i}", "x")
        p.update(f"f{i}", status="failed" if i % 2 else "aborted")
    p.sessions["s1"].connected = False
    p.sweep()
    assert "s1" not in p.sessions and len(p.sessions) == 99 and len(p.tasks) == V.KEPT_TASKS and "f59" in p.tasks and "t" not in p.tasks
    now[0] += V.SESSION_SECONDS + 1
    p.sweep()
    assert not p.sessions


def test_processed_files_are_listed_and_aged(spark, tmp_path):
    for i, age in enumerate((1, 9, 3)):
        f = tmp_path / f"a{i}_processed.txt"
        f.write_text("# Title\n" + (f"# Content Hash: h{i}\n" if i < 2 else "x\n" * 12 + "# Content Hash: late\n"))
        os.utime(f, (1_700_000_000 - age * 86400,) * 2)
    (tmp_path / "other.txt").write_text("x")
    rows = readers.processed_files(spark, str(tmp_path)).collect()
    assert [(r.filename, r.content_hash) for r in rows] == [("a0_processed.txt", "h0"), ("a2_processed.txt", None), ("a1_processed.txt", "h1")]
    at = F.timestamp_seconds(F.lit(1_700_000_000))
    assert readers.remove_older(spark, str(tmp_path), 7, at) == 1 and readers.remove_older(spark, str(tmp_path), 7, at) == 0
    assert sorted(os.listdir(tmp_path)) == ["a0_processed.txt", "a2_processed.txt", "other.txt"]


def test_chat_prompt():
    assert G.chat_prompt("hi", "{{ broken", runtime_renders=False) == "hi" == G.chat_prompt("hi", "<u>{{ messages[0].content }}")
    try:
        import jinja2  # noqa: F401
    except ImportError:
        return
    assert G.chat_prompt("hi", "<u>{{ messages[0].content }}", runtime_renders=False) == "<u>hi"


def test_no_input_gives_an_empty_stream_table(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([], "i long").write.parquet(src)
    live = M.read_stream(spark, src, spark.read.parquet(src).schema)
    assert M.run_to_table(live, "empty_test", str(tmp_path / "ck")).count() == 0


def test_chunks_of_repeated_and_missing_ids(spark):
    docs = [(1, "a.md", "# One\n\nalpha"), (1, "b.md", "# Two\n\nbeta"), (None, "c.md", "gamma"), (None, None, "delta"), (2, "e.md", None), (3, "f.md", "")]
    rows = C.chunk_rows(spark.createDataFrame(docs, "doc_id long, filename string, text string")).collect()
    assert sorted((r.filename or "", r.content.split("\n")[-1]) for r in rows) == [("", "delta"), ("a.md", "alpha"), ("b.md", "beta"), ("c.md", "gamma")]
    assert len({r.doc_hash for r in rows}) == 4
