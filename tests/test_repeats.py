"""Repeats of facts: documents are scanned one after another, in batches that end anywhere."""

import random

from factloom.operators import relations

FACTS = "doc_id double, pos int, canon string, metric string, value_low double, value_high double, unit_canon string, quote string"


def test_documents_over_batches(spark):
    rnd, rows = random.Random(8), []
    for n in range(400):
        doc = None if n == 0 else float("nan") if n == 1 else float(n // 2 * 2)
        for pos in range(300 if n in (0, 1, 7) else rnd.randrange(6)):
            low = rnd.choice([None, 0.0, -0.0, 1.0, 2.0])
            rows.append((doc, pos * 2 + n % 2, rnd.choice("abcdefgh"), rnd.choice(["m", None]), low, low, "u", rnd.choice([None, "", " Q  1", "q 1\n", "x" * 119 + " y", "x" * 119 + " z", f"own {rnd.random()}", f"own {rnd.random()}"])))
    rnd.shuffle(rows)
    want, kept = set(), {}
    for doc, pos, *value, quote in sorted(rows, key=lambda r: r[1]):
        values, quotes = kept.setdefault(str(doc), (set(), set()))
        quote = " ".join((quote or "").lower().split())[:120]
        if tuple(value) not in values and quote not in quotes:
            want.add((str(doc), pos))
            values.add(tuple(value))
            quotes.add(quote)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        out = relations.without_repeats(spark.createDataFrame(rows, FACTS).repartition(5))
        got = [(str(r.doc_id), r.pos) for r in out.collect()]
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    assert sorted(got) == sorted(want) and len(want) > 300
    assert "FlatMapGroups" not in plan and "FlatMapCoGroups" not in plan  # no call for each document
