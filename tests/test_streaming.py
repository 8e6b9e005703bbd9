"""Streams end with the rows that the batch jobs give."""

import pytest
from pyspark.sql import functions as F

from foliant.plans.activity_queries import events
from foliant.streaming import activity


@pytest.fixture(scope="module")
def feed(spark, sf, tmp_path_factory):
    """Requests in time order, in a few files, and one late marker that lets every window close."""
    path = str(tmp_path_factory.mktemp("feed"))
    rows = events(spark, sf)
    last = rows.agg(F.max("ts")).first()[0]
    rows.coalesce(1).sortWithinPartitions("ts").write.parquet(f"{path}/a")
    end = rows.limit(1).select(F.lit(-1).cast("long").alias("event_id"), (F.lit(last) + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit(0).cast("long").alias("tokens"), F.lit(-1).cast("long").alias("finding_id"), F.lit(0).cast("long").alias("generation"), F.lit("end").alias("status"), F.lit("end").alias("request"))
    end.write.parquet(f"{path}/b")
    return path, rows


def run(spark, feed, stream, mode, name):
    path, rows = feed
    source = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(path)
    query = stream(source).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    return spark.table(name)


def test_sessions(spark, feed):
    got = run(spark, feed, activity.sessions_stream, "append", "sessions").filter("user_id >= 0")
    want = activity.sessions(feed[1])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_daily_usage(spark, feed):
    got = run(spark, feed, activity.daily_usage_stream, "complete", "usage").filter("user_id >= 0")
    want = activity.daily_usage(feed[1]).select("user_id", "day", "tokens", "requests")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_latest_status(spark, feed):
    got = run(spark, feed, activity.latest_stream, "complete", "latest").filter("finding_id >= 0")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, activity.latest(feed[1]).collect()))


def test_first_requests(spark, feed):
    got = run(spark, feed, activity.first_requests_stream, "append", "firsts")
    keys = [r.request for r in got.collect()]
    assert set(keys) == {r.request for r in feed[1].select("request").distinct().collect()} | {"end"}


def test_admission_as_requests_come(spark, feed):
    caps = {"token_cap": 20_000, "request_cap": 3}
    got = run(spark, feed, lambda s: activity.admitted_stream(s, **caps), "append", "admitted").filter("user_id >= 0")
    want = activity.admitted(feed[1], **caps).select("event_id", "allowed")
    assert sorted((r.event_id, r.allowed) for r in got.collect()) == sorted(map(tuple, want.collect()))
    assert {r.allowed for r in got.collect()} == {True, False}


def test_reuse_windows(spark, feed):
    got = run(spark, feed, activity.reuse_windows_stream, "append", "reuse").filter("request <> 'end'")
    want = activity.reuse_windows(feed[1])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def times(spark, tmp_path, per_file=4):
    """Requests on both sides of a slot's end, at a window's very end, with equal times, over several files."""
    at = ["00:00", "05:59", "06:00", "06:01", "06:01", "11:50", "12:02", "23:59"]
    rows = [(k, f"2026-01-0{d} {t}:00", key) for key, shift in (("a", 0), ("b", 1)) for d in (1, 2) for k, t in enumerate(at, start=100 * d + 10_000 * shift)]
    df = spark.createDataFrame(rows, "event_id long, ts string, request string").withColumn("ts", F.col("ts").cast("timestamp"))
    for k, part in enumerate((df.filter("ts < '2026-01-01 06:01:00'"), df.filter("ts >= '2026-01-01 06:01:00' AND ts < '2026-01-02 00:00:00'"), df.filter("ts >= '2026-01-02 00:00:00'"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/f{k}")
    return df


def test_windows_that_straddle_slots(spark, tmp_path):
    df = times(spark, tmp_path)
    want = {}
    for r in df.orderBy("request", "ts", "event_id").collect():
        opened = want.get(r.request, [(None, None)])[-1][1]
        again = opened is not None and (r.ts - opened).total_seconds() <= 6 * 3600
        want.setdefault(r.request, []).append((r.event_id, opened if again else r.ts, again))
    flat = sorted((k, *x) for k, v in want.items() for x in v)
    batch = activity.reuse_windows(df.repartition(3))
    assert sorted((r.request, r.event_id, r.opened, r.reused) for r in batch.collect()) == flat
    assert [x[2] for x in want["a"][:8]] == [False, True, True, False, True, True, False, False]
    source = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    query = activity.reuse_windows_stream(source).writeStream.format("memory").queryName("straddle").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert sorted((r.request, r.event_id, r.opened, r.reused) for r in spark.table("straddle").collect()) == flat


def test_reuse_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(500).selectExpr("id AS event_id", "timestamp_seconds(id * 1700) AS ts", "IF(id % 3 = 0, 'x', 'hot') AS request")
        got = {r.event_id: (r.opened, r.reused) for r in activity.reuse_windows(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    opened = {}
    for r in df.orderBy("ts").collect():
        first = opened.get(r.request)
        again = first is not None and (r.ts - first).total_seconds() <= 6 * 3600
        opened[r.request] = first if again else r.ts
        assert got[r.event_id] == (opened[r.request], again)


def test_request_keys(spark):
    rows = spark.createDataFrame([(" A Title ", "Some Abstract"), ("a title", "some abstract "), ("A title", "Other"), ("x" * 130, "y" * 300), ("x" * 140, "y" * 250)], "t string, a string")
    keys = [r.k for r in rows.select(activity.request_key(F.col("t"), F.col("a")).alias("k")).collect()]
    assert keys[0] == keys[1] != keys[2] and keys[3] == keys[4]


def test_upsert_can_be_repeated(spark, tmp_path):
    write = activity.upsert(str(tmp_path), ["k"])
    batch = lambda *rows: spark.createDataFrame(list(rows), "k long, v string")
    write(batch((1, "a"), (2, "b")), 0)
    for _ in range(2):
        write(batch((2, "c"), (3, "d")), 1)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/batch=1").collect())) == [(1, "a"), (2, "c"), (3, "d")]
