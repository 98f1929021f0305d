"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from factloom.operators import lifecycle
from factloom.streaming import pipelines

FOLDER = "/root/testdata/sf0.001"


def events(spark, tmp_path):
    batch = spark.read.parquet(f"{FOLDER}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.orderBy("ts").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    return batch, pipelines.table_stream(spark, f"file://{tmp_path}/in", batch.schema)


def test_windows(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    pipelines.drain(pipelines.event_counts(stream), f"file://{tmp_path}/c1", name="counts", mode="complete")
    assert sorted(map(str, spark.table("counts").collect())) == sorted(map(str, pipelines.event_counts(batch).collect()))


def test_sessions_close_behind_the_watermark(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    pipelines.drain(pipelines.sessions(stream), f"file://{tmp_path}/c2", name="sessions")
    whole = set(map(str, pipelines.sessions(batch).collect()))
    closed = set(map(str, spark.table("sessions").collect()))
    assert closed <= whole and len(closed) > 0.9 * len(whole)


def test_new_hits_of_subscriptions(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    subs = spark.createDataFrame([("u", "error")], "user string, query string").withColumn("last_seen", F.lit("2024-01-10").cast("timestamp"))
    hits = lambda df: df.select(F.col("event_type").alias("query"), F.col("event_id").alias("doc_id"), F.col("ts").alias("at"))
    pipelines.drain(pipelines.new_hits(hits(stream), subs), f"file://{tmp_path}/c3", name="hits")
    assert spark.table("hits").count() == batch.filter("event_type = 'error' and ts > '2024-01-10'").count() > 0


def test_upsert_runs_again_with_one_result(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    path = f"file://{tmp_path}/table"
    write = pipelines.upsert_into(path, ["user_id"], ["ts", "event_id"])
    pipelines.drain(stream, f"file://{tmp_path}/c4", sink=write)
    write(batch, 0)
    got = pipelines.current(spark, path, batch.schema)
    assert sorted(map(str, got.collect())) == sorted(map(str, lifecycle.keep_last(batch, ["user_id"], ["ts", "event_id"]).collect()))


def test_first_seen(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "doc_id string, n int")
    assert pipelines.first_seen(df).count() == 2


def test_latest_per_key_of_several_batches(spark, monkeypatch):
    from factloom.plans import catalogue_flow

    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/events.parquet")
    middle = sorted(r.ts for r in rows.select("ts").collect())[rows.count() // 2]
    parts = [rows.filter(F.col("ts") < F.lit(middle)), rows.filter(F.col("ts") >= F.lit(middle))]
    monkeypatch.setattr(pipelines, "drain", lambda stream, state, sink: [sink(part, i) for i, part in enumerate(parts)])
    got = catalogue_flow.stream_latest_per_key(spark, folder)
    want = lifecycle.keep_last(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_batch_writes_the_buckets_of_its_keys_only(spark, tmp_path):
    path = f"file://{tmp_path}/buckets"
    write = pipelines.upsert_into(path, ["k"], ["n"], buckets=16)
    write(spark.createDataFrame([(f"k{i}", i) for i in range(100)], "k string, n int"), 0)
    write(spark.createDataFrame([("k3", 1000), ("new", 1)], "k string, n int"), 1)
    parts = pipelines.current_parts(spark, path)
    assert sum("/v=1/" in p for p in parts.values()) <= 2 and len(parts) == 16
    got = {r.k: r.n for r in pipelines.current(spark, path, spark.createDataFrame([], "k string, n int").schema).collect()}
    assert got == {f"k{i}": i for i in range(100)} | {"k3": 1000, "new": 1}
    assert len(pipelines.superseded(spark, path)) == sum("/v=1/" in p for p in parts.values())
    assert pipelines.current(spark, f"{path}/none", spark.createDataFrame([], "k string, n int").schema).count() == 0
