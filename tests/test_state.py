"""Stateful streams and the growing index: any order and any restart gives what the batch operator gives."""

import datetime as dt
import time

from pyspark.sql import functions as F

from factloom.operators import lifecycle, retrieval, segments
from factloom.streaming import pipelines, state

FOLDER = "/root/testdata/sf0.001"


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def run(spark, tmp_path, lots, schema, make, keys, order):
    """Write each lot as a file of its own and drain after each; (table, last rows put out)."""
    rows = []
    sink = pipelines.upsert_into(f"file://{tmp_path}/out", keys, order, buckets=4)

    def both(batch, n):
        rows.append(batch.collect())
        sink(batch, n)

    for lot in lots:
        spark.createDataFrame(lot, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        out = make(pipelines.table_stream(spark, f"file://{tmp_path}/in", spark.createDataFrame([], schema).schema, 1))
        pipelines.drain(out, f"file://{tmp_path}/c", sink=both, mode="update")
    return pipelines.current(spark, f"file://{tmp_path}/out", out.schema), rows


HITS = "query string, doc_id string, at timestamp"


def test_novelties_over_restarts(spark, tmp_path):
    subs = spark.createDataFrame([("ann", "ni", at(5)), ("bob", "ni", at(1)), ("bob", "cu", at(9)), ("eve", "fe", at(1))], "user string, query string, last_seen timestamp")
    lots = [
        [("ni", "d1", at(4)), ("ni", "d2", at(6)), ("cu", "d2", at(9))],
        [("ni", "d1", at(7)), ("ni", "d2", at(2)), ("zn", "d9", at(9)), ("ni", None, at(9)), ("cu", "d3", None)],
        [("cu", "d2", at(10)), ("ni", "d3", at(3))],
    ]
    table, _ = run(spark, tmp_path, lots, HITS, lambda stream: state.novelties(stream, subs), ["user", "query"], ["new"])
    got = {(r.user, r.query): r.new for r in table.filter("new > 0").collect()}
    hits = spark.createDataFrame([x for lot in lots for x in lot if x[1]], HITS)
    want = lifecycle.novelties(hits.select("query", "doc_id").distinct(), subs, hits.select("doc_id", "at"), F.lit(None).cast("timestamp"))
    # a document's time is that of its latest hit for the query; here no document hits two queries late
    assert got == {("ann", "ni"): 2, ("bob", "ni"): 3, ("bob", "cu"): 1} and {(r.user, r.query) for r in want.collect()} == set(got)


def test_marks_move_forward(spark, tmp_path):
    subs = spark.createDataFrame([("ann", "ni", at(1))], "user string, query string, last_seen timestamp")
    schema = "user string, query string, doc_id string, at timestamp"

    def make(stream):
        hits = stream.filter("user is null").select("query", "doc_id", "at")
        return state.novelties(hits, subs, stream.filter("user is not null").select("user", "query", "at"))

    lots = [
        [(None, "ni", "d1", at(2)), (None, "ni", "d2", at(6))],
        [("ann", "ni", None, at(3))],
        [("ann", "ni", None, at(2)), (None, "ni", "late", at(2)), (None, "cu", "other", at(9))],
        [("ann", "ni", None, at(8))],
    ]
    table, rows = run(spark, tmp_path, lots, schema, make, ["user", "query"], ["new"])
    assert [r.new for batch in rows for r in batch] == [2, 1, 1, 0]
    (last,) = table.collect()
    assert last.new == 0 and last.last_seen == int(at(8).replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)


def test_a_reminder_comes_once(spark, tmp_path):
    subs = spark.createDataFrame([("ann", "ni", at(1))], "user string, query string, last_seen timestamp")
    spark.createDataFrame([("ni", "d1", at(2)), ("ni", "d2", at(6))], HITS).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = pipelines.table_stream(spark, f"file://{tmp_path}/in", spark.createDataFrame([], HITS).schema, 1)
    told = []
    out = state.novelties(stream, subs, remind=100)
    # a stream with such timers runs on, as time does: it is started, watched and stopped
    query = out.writeStream.option("checkpointLocation", f"file://{tmp_path}/c").outputMode("update").foreachBatch(lambda batch, n: told.extend(batch.collect())).trigger(processingTime="1 second").start()
    try:
        end = time.time() + 40
        while time.time() < end and not any(r.reminder for r in told):
            time.sleep(0.5)
        time.sleep(3)
    finally:
        query.stop()
    assert [(r.new, r.reminder) for r in told] == [(2, False), (2, True)]


FACTS = "doc_id long, canon string, metric string, conditions string, pkey string, extracted_at timestamp"


def test_chains_of_versions_over_restarts(spark, tmp_path):
    lots = [
        [(1, "cu", "m", None, "b", at(2)), (1, "cu", "m", None, "c", at(3)), (2, "ni", None, "x", "z", at(1))],
        [(1, "cu", "m", None, "a", at(1)), (1, "cu", "m", None, "b2", at(2)), (1, "cu", "m", "", "q", at(9))],
        [(1, "cu", "m", None, "c", at(3)), (2, "ni", None, "x", "z", at(5)), (2, "ni", None, "x", "none", None)],
    ]
    table, rows = run(spark, tmp_path, lots, FACTS, lambda stream: state.versions(stream, buckets=4), ["slot", "pkey"], ["version"])
    facts = spark.createDataFrame([x for lot in lots for x in lot], FACTS)
    order = ["doc_id", "canon", "metric", "conditions", "pkey", "extracted_at", "version"]
    got = sorted(map(str, state.chains(table, dict(facts.dtypes)).select(order).collect()))
    assert got == sorted(map(str, lifecycle.versions(facts.filter("extracted_at is not null")).select(order).collect()))
    assert {r.pkey for r in rows[1]} == {"a", "b", "b2", "c", "q"}  # a late fact moves those after it
    assert [r.pkey for r in rows[2]] == ["z"]  # what stays as it is is not told again


def index_rows(df):
    return sorted((r.lemma, r.doc_id, r.tf, r.df) for r in df.collect())


DOCS = "doc_id long, text string, segment int"


def test_index_by_segments_is_the_index_at_once(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    long = "x" * 30
    rows = {i: f"copper nickel word{'abcdefghij'[i % 10]} {'slag ' * (i % 4)} {long if i == 7 else ''}" for i in range(40)}
    frame = lambda ids, change=lambda x: x: spark.createDataFrame([(i, change(rows[i]), 0) for i in ids], DOCS)
    segments.add(path, frame(range(0, 25), lambda x: x.upper() + " matte"), 1)
    segments.delete(path, spark.createDataFrame([(3,), (4,), (99,)], "doc_id long"), 2)
    segments.add(path, frame(range(0, 20)), 3)
    segments.add(path, frame(range(20, 40)).unionByName(spark.createDataFrame([(None, "lost", 0), (50, None, 0), (50, None, 0)], DOCS)), 4)
    segments.delete(path, spark.createDataFrame([(50,), (50,), (None,)], "doc_id long"), 5)
    want = index_rows(retrieval.postings(frame(range(40))))
    assert index_rows(segments.postings(spark, path)) == want and segments.size(spark, path, "bigint").first().n == 40
    segments.add(path, frame(range(20, 40)), 4)  # a batch that runs again
    assert index_rows(segments.postings(spark, path)) == want
    terms = ["slag", "worda", "nothing"]
    once = retrieval.keyword_search(retrieval.postings(frame(range(40))), spark.createDataFrame([(40,)], "n long"), terms)
    assert segments.search(spark, path, terms).collect() == once.collect()
    segments.compacted(spark, path, f"{path}-one")
    assert index_rows(segments.postings(spark, f"{path}-one")) == want
    segments.add(f"{path}-one", frame([0], lambda x: "gold " * 3), 6)
    assert ("gold", 0, 3, 1) in index_rows(segments.postings(spark, f"{path}-one"))


def test_no_index_yet(spark, tmp_path):
    assert segments.postings(spark, f"file://{tmp_path}/none").count() == 0
    assert segments.size(spark, f"file://{tmp_path}/none", "bigint").first().n == 0


def test_search_reads_the_words_it_asks_for(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    segments.add(path, docs, 1, pattern="[a-z]{4,}")
    plan = segments.postings(spark, path, terms=["this"])._jdf.queryExecution().executedPlan().toString()
    assert "In(lemma" in plan or "EqualTo(lemma,this)" in plan
