"""Subscriptions against many hits: counts by time, never pairs of hits and subscriptions."""

import bisect
import datetime as dt
import random
import time

from pyspark.sql import functions as F

from factloom.operators import lifecycle

START = dt.datetime(2024, 1, 1)
SUBS, TIMES = "user string, query string, last_seen timestamp", "doc_id long, at timestamp"


def test_counts_equal_pairs(spark):
    rnd = random.Random(5)
    # microseconds, blocks of 66 ms and of 71 minutes, and times before 1970
    moment = lambda: START + dt.timedelta(microseconds=rnd.choice([rnd.randrange(5), rnd.randrange(200_000), rnd.randrange(10**11), -rnd.randrange(10**16)]))
    hits = [(rnd.choice(["a", "b", None]), rnd.choice([None, *range(300)])) for _ in range(900)]
    times = [(rnd.choice([None, *range(250)]), rnd.choice([None, moment()])) for _ in range(600)]
    subs = [(rnd.choice([None, *"uvwxyz"]), rnd.choice(["a", "b", "c", None]), rnd.choice([None, moment()])) for _ in range(60)]
    for fallback in (None, START + dt.timedelta(microseconds=100)):
        latest = {}
        for doc, at in times:
            if doc is not None and at is not None:
                latest[doc] = max(at, latest.get(doc, at))
        want = {}
        for user, query, seen in subs:
            for q, doc in hits:
                at = latest.get(doc, fallback)
                if q == query and q is not None and seen is not None and at is not None and at > seen:
                    want.setdefault((user, query), set()).update(set() if doc is None else {doc})
        out = lifecycle.novelties(spark.createDataFrame(hits, "query string, doc_id long"), spark.createDataFrame(subs, SUBS), spark.createDataFrame(times, TIMES), F.lit(fallback).cast("timestamp"))
        rows = out.collect()
        assert {(r.user, r.query): r.new for r in rows} == {k: len(v) for k, v in want.items()} and len(rows) == len(want)


def test_many_hits_and_subscriptions(spark):
    n, users = 60_000, 6_000  # 360 million pairs
    hits = spark.range(n).select(F.lit("q").alias("query"), F.col("id").alias("doc_id"))
    times = spark.range(n).select(F.col("id").alias("doc_id"), F.timestamp_micros(F.col("id") * 999_983 % 2_592_000_000 * 1000).alias("at"))
    subs = spark.range(users).select(F.col("id").alias("user"), F.lit("q").alias("query"), F.timestamp_micros(F.col("id") * 431_999_000 + 7).alias("last_seen"))
    began = time.time()
    got = {r.user: r.new for r in lifecycle.novelties(hits, subs, times, F.lit(None).cast("timestamp")).collect()}
    assert time.time() - began < 60
    sorted_times = sorted(i * 999_983 % 2_592_000_000 * 1000 for i in range(n))
    want = {u: n - bisect.bisect_right(sorted_times, u * 431_999_000 + 7) for u in range(users)}
    assert got == {u: c for u, c in want.items() if c}
