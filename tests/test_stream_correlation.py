"""The stateful correlation over many files and restarts equals the batch rule."""

import random

import pytest
from pyspark.sql import functions as F

from alertloom.operators import rules
from alertloom.streaming import correlation as C
from alertloom.streaming import monitor as M

SCHEMA = "event_id long, ts timestamp, rule_id int, src_ip string"
TABLE = ((1, (10, 11), 3, 300, 12, "x"), (2, (11,), 2, 1000, 9, "y"))


@pytest.fixture
def rocks(spark):
    C.configure(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "ts double")).withColumn("ts", F.col("ts").cast("timestamp"))


def test_many_files_and_restarts_equal_the_batch_rule(spark, rocks, tmp_path):
    r = random.Random(5)
    times = sorted(1704067200 + r.randint(0, 60_000) / 10 for _ in range(240))
    rows = [(i, t, r.choice([10, 11, 11, 99]), r.choice(["a", "a", "b", "c"])) for i, t in enumerate(times)]
    rows += [(900, times[50], 11, "a"), (901, times[50], 11, "a"), (902, times[60], 11, None)]
    late = [(950, times[0], 11, "a")]  # beyond the delay when it arrives
    swapped = sorted(rows, key=lambda x: x[1] + r.random() * 50)  # out of order within the delay
    files = [swapped[a : a + 40] for a in range(0, len(swapped), 40)]
    src, out = str(tmp_path / "in"), str(tmp_path / "ck")
    found = None
    for k, part in enumerate([*files, [*late, (999, times[-1] + 9000, 99, "z")], [(1000, times[-1] + 9001, 11, "z")]]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(src)
        if k % 3 == 2 or k >= len(files):  # several files a run, several runs on one checkpoint
            live = M.event_time(M.read_stream(spark, src, frame(spark, part).schema, 1), delay="2 minutes")
            found = M.run_to_table(C.correlate_stream(live, TABLE), f"corr{k}", out)
    got = sorted((x.ts, x.event_id, x.src_ip, x.correlation_id, x.hits) for x in found.collect())
    want = rules.correlate(frame(spark, rows), TABLE)
    want = sorted((x.ts, x.event_id, x.src_ip, x.correlation_id, x.hits) for x in want.collect())
    assert got == want and len(want) > 60


def test_state_ends_with_the_stretch(spark, rocks, tmp_path):
    src, ck = str(tmp_path / "in"), str(tmp_path / "ck")
    kept = []
    for k in range(4):
        frame(spark, [(k * 50 + i, 1704067200.0 + 5000 * k + i, 10, "a") for i in range(50)]).coalesce(1).write.mode("append").parquet(src)
        live = M.event_time(M.read_stream(spark, src, frame(spark, [(0, 0.0, 0, "")]).schema, 1), delay="1 minute")
        query = C.correlate_stream(live, TABLE[:1]).writeStream.format("noop").option("checkpointLocation", ck).trigger(availableNow=True).start()
        query.awaitTermination()
        state = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
        kept.append(state[-1])
    assert kept[-1] <= kept[0] + 5, kept


def test_alerts_before_the_watermark_are_decided_beside_newer_ones(spark, rocks, tmp_path):
    src, t = str(tmp_path / "in"), 1704067200.0
    frame(spark, [(0, t + 1, 11, "a"), (1, t + 2, 11, "a"), (2, t + 100, 11, "a"), (3, t + 101, 11, "a"), (4, t + 150, 99, "z")]).coalesce(1).write.parquet(src)
    live = M.event_time(M.read_stream(spark, src, frame(spark, [(0, 0.0, 0, "")]).schema, 1), delay="1 minute")
    found = M.run_to_table(C.correlate_stream(live, TABLE[1:]), "beside", str(tmp_path / "ck"))
    assert sorted(x.event_id for x in found.collect()) == [1]
