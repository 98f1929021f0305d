"""Versions, upserts, curation, audit and subscriptions
(K05-K08, K14-K15, J14, J16, J20, A25, W08, W11, Q13, R04, S11, S23-S24, F27-F28, U09-U10, B03)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY_PARTS = ("doc_id", "canon", "metric", "unit_canon", "value_low", "value_high", "conditions", "phase")
SLOT = ("doc_id", "canon", "metric", "conditions")


def number_key(column: str) -> Column:
    """A number as text, whole ones without a fraction; null is empty."""
    c = F.col(column)
    return F.coalesce(F.when(c == F.floor(c), c.cast("decimal(20,0)").cast("string")).otherwise(c.cast("string")), F.lit(""))


def pkey(parts: tuple[str, ...] = KEY_PARTS, numbers: tuple[str, ...] = ("value_low", "value_high")) -> Column:
    """The identity of a fact. Nulls count as empty parts, they are not skipped."""
    return F.concat_ws("|", *[number_key(p) if p in numbers else F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])


def swapped(facts: DataFrame) -> DataFrame:
    """Bounds in order."""
    low, high = F.col("value_low"), F.col("value_high")
    turned = F.coalesce(low > high, F.lit(False))
    return facts.withColumns({"value_low": F.when(turned, high).otherwise(low), "value_high": F.when(turned, low).otherwise(high)})


def keep_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order]))
    return rows.withColumn("_last", last).filter("_last = 1").drop("_last")


def upserted(before: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """New rows replace those with their key; the last of several new ones wins. One shuffle,
    as union and window, where a full outer join would need two."""
    rows = before.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    return keep_last(rows, keys, ["_batch", *order]).drop("_batch")


def superseded(facts: DataFrame) -> DataFrame:
    """(pkey, older): facts of one slot with another identity that were extracted before."""
    a = facts.select(*SLOT, "pkey", "extracted_at").distinct()
    b = a.select(*[F.col(c).alias(f"_{c}") for c in SLOT], F.col("pkey").alias("older"), F.col("extracted_at").alias("_at"))
    same = (F.col("_at") < F.col("extracted_at")) & (F.col("older") != F.col("pkey"))
    for c in SLOT:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return a.join(b, same).select("pkey", "older").distinct()


def versions(facts: DataFrame) -> DataFrame:
    """The version of each fact: one more than the older ones of its slot. Counted by
    a running window, without the pairs of superseded()."""
    w = Window.partitionBy(*SLOT)
    distinct = facts.groupBy(*SLOT, "pkey").agg(F.max("extracted_at").alias("extracted_at"))
    older = F.count("*").over(w.orderBy(F.unix_micros(F.col("extracted_at").cast("timestamp"))).rangeBetween(Window.unboundedPreceding, -1))
    return distinct.withColumn("version", 1 + older)


def live(facts: DataFrame) -> DataFrame:
    """Facts that were not deleted."""
    return facts.filter(~F.coalesce("deleted", F.lit(False)))


def match(key: dict) -> Column:
    """a curation key: an id, or any of doc_id, canon, metric."""
    if key.get("id") is not None:
        return F.col("pkey") == key["id"]
    parts = [F.col(c) == key[c] for c in ("doc_id", "canon", "metric") if key.get(c) is not None]
    if not parts:
        raise ValueError("a curation key needs an id, or some of doc_id, canon and metric")
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def edited(facts: DataFrame, key: dict, value: float, editor: str, at: Column, comment: str = "") -> tuple[DataFrame, DataFrame]:
    """Q13: (facts with the new value, snapshots of what they were)."""
    hit = F.coalesce(match(key), F.lit(False))
    history = facts.filter(hit).select("pkey", F.col("value_low").alias("old_low"), F.col("value_high").alias("old_high"), F.lit(editor).alias("editor"), F.lit(comment).alias("comment"), at.alias("edited_at"))
    new = facts.withColumns({"value_low": F.when(hit, F.lit(value)).otherwise(F.col("value_low")), "value_high": F.when(hit, F.lit(value)).otherwise(F.col("value_high")), "manually_edited": F.when(hit, F.lit(True)).otherwise(F.lit(False))})
    return new, history


def deleted(facts: DataFrame, key: dict) -> DataFrame:
    """Q13: marks facts as deleted; nothing is removed."""
    before = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in facts.columns else F.lit(False)
    return facts.withColumn("deleted", before | F.coalesce(match(key), F.lit(False)))


def added(facts: DataFrame, new: DataFrame) -> DataFrame:
    """Q13: facts entered by hand, with their own kind of key."""
    own = new.withColumn("pkey", F.concat(F.lit("manual|"), pkey())).withColumn("source", F.lit("manual"))
    return upserted(facts, own, ["pkey"], ["extracted_at"])


def history(snapshots: DataFrame, limit: int = 100) -> DataFrame:
    """T06."""
    return snapshots.orderBy(F.col("edited_at").desc_nulls_last(), "pkey").limit(limit)


def normalised_text_key(text: Column) -> Column:
    """MD5 of a text without case and runs of white space."""
    return F.md5(F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))).cast("binary"))


def distinct_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per normalised text the first document. Only ids and keys are shuffled for that; rows
    are joined back by id and key, and of those that agree in both one stays. Null ids come last."""
    rows = documents.withColumn("_key", normalised_text_key(F.col(text_col)))
    firsts = rows.groupBy("_key").agg(F.min(id_col).alias("_id"))
    back = rows.join(firsts.withColumnRenamed("_key", "_first"), (F.col("_key") == F.col("_first")) & F.col(id_col).eqNullSafe(F.col("_id")))
    return back.drop("_first", "_id").dropDuplicates(["_key"]).drop("_key")


def not_known(new: DataFrame, known: DataFrame, key: Column) -> DataFrame:
    """New rows whose key no known row has."""
    return new.withColumn("_key", key).join(known.select(key.alias("_key")).distinct(), "_key", "left_anti").drop("_key")


#: Bits of a time in microseconds that are left out at each level of `newer`.
_SHIFTS = (32, 16, 0)


def _blocks(times: DataFrame, *more: str) -> DataFrame:
    """Each time as a block of each level, with the block of the level above that it lies in."""
    rows = times.select("query", "t", *more, F.explode(F.array(*map(F.lit, _SHIFTS))).alias("shift"))
    block = F.expr("shiftright(t, shift)")
    return rows.withColumns({"block": block, "above": F.when(F.col("shift") < _SHIFTS[0], F.shiftright(block, 16))})


def newer(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """(query, t, n, rows) of each asked (query, t): sums over the counts (query, t, n, rows) of the same
    query that are later; t in microseconds. Times are counted in blocks of 71 minutes, of these in
    blocks of 66 ms, and of these one by one: what is later is the later blocks of each level. No count
    meets a time that is asked for, and below the first level no window holds more than 65,536 rows."""
    zero = F.lit(0).cast("long")
    both = _blocks(counts, "n", "rows").unionByName(_blocks(asked.select("query", "t", zero.alias("n"), zero.alias("rows")), "n", "rows"))
    blocks = both.groupBy("query", "shift", "above", "block").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))
    later = Window.partitionBy("query", "shift", "above").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.select("query", "shift", "block", *[F.coalesce(F.sum(c).over(later), zero).alias(c) for c in ("n", "rows")])
    met = _blocks(asked.select("query", "t").distinct()).join(sums, ["query", "shift", "block"])
    return met.groupBy("query", "t").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))


def novelties(hits: DataFrame, subscriptions: DataFrame, times: DataFrame, fallback: Column) -> DataFrame:
    """Per (user, query) the hits newer than what was last seen. hits: (query,
    doc_id); times: (doc_id, at), of which the latest counts, else the fallback. Hits and subscriptions
    of a query are not paired; see `newer`."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    latest = times.groupBy("doc_id").agg(F.max("at").alias("at"))
    rows = hits.filter("query is not null").select("query", "doc_id").distinct().join(latest, "doc_id", "left").withColumn("at", F.coalesce("at", fallback))
    counts = rows.filter("at is not null").groupBy("query", micros("at").alias("t")).agg(F.count("doc_id").alias("n"), F.count("*").alias("rows"))
    asked = subscriptions.filter("query is not null and last_seen is not null").groupBy("user", "query").agg(F.min(micros("last_seen")).alias("t"))
    return asked.join(newer(counts, asked).filter("rows > 0"), ["query", "t"]).select("user", "query", F.col("n").alias("new"))


def marked_seen(subscriptions: DataFrame, user: str, query: str, at: Column) -> DataFrame:
    """K15."""
    own = (F.col("user") == user) & (F.col("query") == query)
    return subscriptions.withColumn("last_seen", F.when(own, at).otherwise(F.col("last_seen")))


def audit_tail(events: DataFrame, limit: int = 500) -> DataFrame:
    """The last events."""
    return events.orderBy(F.col("ts").desc_nulls_last(), "event_id").limit(limit)


def subscriptions_of(subscriptions: DataFrame, user: str) -> DataFrame:
    """What a user follows."""
    return subscriptions.filter(F.col("user") == user).orderBy("query")
