import random

from pyspark.sql import functions as F

from alertloom.streaming import monitor as M

SCHEMA = "event_id long, ts timestamp, rule_level int, rule_id int, rule_description string, src_ip string, dest_ip string"


def test_monitor_equals_batch_and_restarts(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i % 50:02d}:00", i % 16, 100000 + i % 7, "d", f"10.0.0.{i % 3}", "192.0.2.1") for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp"))
    src = str(tmp_path / "in")
    df.repartition(3).write.parquet(src)
    records = []
    mon = M.Monitor(src, df.schema, str(tmp_path / "ck"), str(tmp_path / "out"), on_trigger=lambda i, r: records.extend(r.collect()))
    mon.start(spark, once=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == got.select("alert_hash").distinct().count()
    assert records and sum(r.alerts for r in records) == got.count()
    mon.start(spark, once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == got.count()
    import pytest

    with pytest.raises(RuntimeError):
        mon.start(spark, ready=False)


def test_stream_snapshots_equal_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i % 5:02d}:10:00", i % 16, 100000 + i % 7, "d", "10.0.0.1", "192.0.2.1") for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp"))
    src = str(tmp_path / "in")
    df.write.parquet(src)
    live = M.snapshots(M.event_time(M.read_stream(spark, src, df.schema)))
    out = M.run_to_table(live, "snap_test", str(tmp_path / "ck"), "complete")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, M.snapshots(df).collect()))


def test_stream_correlation_equals_batch(spark, tmp_path):
    """Every alert looks back exactly the rule's time, wherever windows begin."""
    from alertloom.operators import rules

    r = random.Random(3)
    at = [30.0, 150.0, 320.0] + [r.randint(0, 4000) / 2 for _ in range(150)]
    src = ["10.0.0.9"] * 3 + [f"10.0.0.{r.randint(0, 4)}" for _ in range(150)]
    rows = [(i, 1704067200 + t, 5, r.choice([100010, 100011, 100099]) if i > 2 else 100010, "d", s, "192.0.2.1") for i, (t, s) in enumerate(zip(at, src, strict=True))]
    df = spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "ts double")).withColumn("ts", F.col("ts").cast("timestamp"))
    want = rules.correlate(df, ((1, (100010, 100011), 3, 300, 12, "x"),)).select("ts", "src_ip", "hits").collect()
    assert any(x.src_ip == "10.0.0.9" for x in want) and len(want) > 10
    assert sorted(map(tuple, M.correlated(df, (100010, 100011), 3, 300).collect())) == sorted(map(tuple, want))
    path = str(tmp_path / "in")
    df.repartition(4).write.parquet(path)
    live = M.correlated(M.event_time(M.read_stream(spark, path, df.schema)), (100010, 100011), 3, 300)
    out = M.run_to_table(live, "correlated_test", str(tmp_path / "ck"), "complete")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want))


def test_sketches_merge_within_their_bound(spark):
    from alertloom.operators import analytics as N

    r = random.Random(4)
    rows = [(1704067200.0 + r.randrange(48) * 3600 + r.randrange(3600), f"k{r.randrange(40_000)}") for _ in range(120_000)]
    df = spark.createDataFrame(rows, "ts double, k string").withColumn("ts", F.col("ts").cast("timestamp"))
    hourly = N.distinct_sketches(df, F.col("k"))
    assert hourly.count() == 48 and max(len(x.sketch) for x in hourly.collect()) < 40_000
    for x in N.sliding_distinct(hourly, 24).collect():
        end = x.period.timestamp() + 3600
        inside = [k for t, k in rows if end - 86400 <= t < end]
        assert x.n == len(inside) and abs(x.distinct - len(set(inside))) <= N.DISTINCT_ERROR * len(set(inside))
    # sketches of parts of an hour add up
    halves = N.distinct_sketches(df.filter("k < 'k2'"), F.col("k")).unionByName(N.distinct_sketches(df.filter("k >= 'k2'"), F.col("k")))
    whole, parts = ({x.period: x.distinct for x in N.sliding_distinct(y, 1).collect()} for y in (hourly, halves))
    assert all(abs(whole[p] - parts[p]) <= N.DISTINCT_ERROR * whole[p] for p in whole) and len(whole) == 48
    assert N.sliding_distinct(hourly.limit(0)).count() == 0
