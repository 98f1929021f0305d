"""Mentions of a dictionary: small ones are sent to the tasks, and all ways give the same mentions."""

import random

from factloom.plans import dictionary


def test_ngrams_are_not_exchanged(spark, monkeypatch):
    rnd, words = random.Random(6), ["a", "b", "c", "Медь", "x1", "dd"]
    texts = [(n if n % 5 else None, " ,".join(rnd.choices(words, k=rnd.randrange(12))) or None) for n in range(60)]
    aliases = [(f"{' '.join(c)} {i}", " ".join(c), i) for c in {tuple(rnd.choices(words, k=rnd.randrange(1, 4))) for _ in range(25)} for i in (1, 0)] + [(None, "b", 0), ("no word", "...", 0)]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    own = spark.createDataFrame(aliases, "canon string, alias string, tier int")
    tell = lambda: sorted(map(str, dictionary.mentions(docs, own).collect()))
    plan = dictionary.mentions(docs, own)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    few = tell()
    monkeypatch.setattr(dictionary, "KNOWN", 0, raising=False)
    sent = tell()
    monkeypatch.setattr(dictionary, "SENT", -1, raising=False)
    assert few == sent == tell() and len(few) > 100
