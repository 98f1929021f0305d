"""Subscriptions as state: many users and hits of one query, over restarts, with marks on the way."""

import bisect
import datetime as dt
import random

from pyspark.sql import functions as F

from factloom.streaming import pipelines, state

START = dt.datetime(2024, 1, 1)
ROWS = "user long, query string, doc_id string, at timestamp"


def test_many_users_and_hits(spark, tmp_path):
    rnd = random.Random(11)
    moment = lambda: START + dt.timedelta(microseconds=rnd.randrange(10**10))
    users = [None, *range(4000)]
    subs = [(u, q, None if rnd.random() < 0.1 else moment()) for u in users for q in ("a", "b") if rnd.random() < 0.8]
    lots = []
    for _ in range(3):  # documents come again, with later and earlier times; marks of all and of unknown users
        lot = [(None, rnd.choice("abc"), f"d{rnd.randrange(9000)}", None if rnd.random() < 0.05 else moment()) for _ in range(6000)]
        lots.append(lot + [(rnd.randrange(4100), rnd.choice("ab"), None, moment()) for _ in range(800)])
    known = spark.createDataFrame(subs, "user long, query string, last_seen timestamp")
    sink = pipelines.upsert_into(f"file://{tmp_path}/out", ["user", "query"], ["new"], buckets=4)
    for lot in lots:
        spark.createDataFrame(lot, ROWS).coalesce(2).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = pipelines.table_stream(spark, f"file://{tmp_path}/in", spark.createDataFrame([], ROWS).schema)
        hits, marks = stream.filter("doc_id is not null"), stream.filter("doc_id is null")
        out = state.novelties(hits.select("query", "doc_id", "at"), known, marks.select("user", "query", "at"), parts=3)
        pipelines.drain(out, f"file://{tmp_path}/c", sink=sink, mode="update")
    table = pipelines.current(spark, f"file://{tmp_path}/out", out.schema).filter("new > 0").collect()
    seen, latest = {(u, q): at for u, q, at in subs}, {}
    for user, query, doc, at in (x for lot in lots for x in lot):
        if doc and at:
            latest[query, doc] = max(at, latest.get((query, doc), at))
        elif not doc and (user, query) in seen:
            seen[user, query] = max(at, seen[user, query] or at)
    times = {q: sorted(at for (other, _), at in latest.items() if other == q) for q in "ab"}
    want = {k: len(times[k[1]]) - bisect.bisect_right(times[k[1]], at) for k, at in seen.items() if at}
    got = {(r.user, r.query): (r.new, r.last_seen) for r in table}
    micros = lambda at: (at - START) // dt.timedelta(microseconds=1) + 1_704_067_200_000_000
    assert got == {k: (n, micros(seen[k])) for k, n in want.items() if n}


def test_a_batch_names_each_query_once(spark):
    rows = spark.range(1000).repartition(8).select(F.concat(F.lit("q"), F.col("id") % 3).alias("query"))
    once = rows.mapInArrow(state._each_once, rows.schema).repartition("query").mapInArrow(state._each_once, rows.schema)
    assert sorted(r.query for r in once.collect()) == ["q0", "q1", "q2"]
