"""Mentions of dictionary entries in whole texts, as a join.

Texts become words; word n-grams up to the longest alias meet the aliases by equality, in the JVM.
Aliases of up to `SENT` characters are sent to every task, so that n-grams are not exchanged; only
mentions are. Of up to `KNOWN` aliases the first words are known in advance, and n-grams that
begin otherwise are not made. Larger dictionaries exchange every n-gram of every text.
An alias of several entries goes to the lowest tier, then to the first name. Of mentions that
overlap the one that begins first counts, of those that begin together the longest: a sweep over
the mentions of a text in order.

Nulls and empty texts hold no mention; an alias without a word is left out; case does not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"([\p{L}\p{N}]+)"
SENT, KNOWN = 64 << 20, 10_000


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 1)


def mentions(documents: DataFrame, aliases: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, words, canon): start counts words from 0. aliases: (canon, alias, tier)."""
    own = aliases.select("canon", "tier", _words(F.col("alias")).alias("w")).filter(F.size("w") > 0)
    best = F.row_number().over(Window.partitionBy("alias").orderBy("tier", "canon"))
    own = own.select("canon", "tier", F.array_join("w", " ").alias("alias"), F.size("w").alias("n")).withColumn("nth", best).filter("nth = 1").select("alias", "canon", "n")
    size = F.sum(F.length("alias") + F.coalesce(F.length("canon"), F.lit(0)))
    lengths = sorted(own.groupBy("n").agg(F.count("*").alias("count"), size.alias("size")).collect())  # of aliases: few
    firsts: dict[int, list[str]] = {}
    if sum(r["count"] for r in lengths) <= KNOWN:
        for r in own.select("n", F.substring_index("alias", " ", 1).alias("first")).distinct().collect():
            firsts.setdefault(r.n, []).append(r.first)
    rows = documents.select(F.col(id_col).alias("doc_id"), _words(F.col(text_col)).alias("w"))
    grams = [_grams(r.n, firsts.get(r.n)) for r in lengths]
    if not grams:
        return rows.select("doc_id", F.lit(0).alias("start"), F.lit(0).alias("words"), F.lit("").alias("canon")).limit(0)
    each = rows.select("doc_id", F.explode(F.concat(*grams)).alias("g")).select("doc_id", "g.start", "g.alias")
    small = sum(r.size for r in lengths) <= SENT
    met = each.join(F.broadcast(own) if small else own, "alias").select("doc_id", "start", F.col("n").alias("words"), "canon")
    ordered = F.array_sort(F.collect_list(F.struct("start", (-F.col("words")).alias("less"), "canon")))
    kept = met.groupBy("doc_id").agg(F.aggregate(ordered, F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,less:int,canon:string>>").alias("kept")), _sweep, lambda s: s["kept"]).alias("kept"))
    return kept.select("doc_id", F.explode("kept").alias("m")).select("doc_id", "m.start", (-F.col("m.less")).alias("words"), "m.canon")


def _grams(n: int, firsts: list[str] | None) -> Column:
    """(start, alias) of each run of n words of w, or of those that begin with one of the first words."""
    starts = F.sequence(F.lit(0), F.size("w") - n)
    if firsts:
        starts = F.filter(starts, lambda i: F.get("w", i).isin(firsts))
    every = F.transform(starts, lambda i: F.struct(i.alias("start"), F.array_join(F.slice("w", i + 1, n), " ").alias("alias")))
    return F.when(F.size("w") >= n, every).otherwise(F.array().cast("array<struct<start:int,alias:string>>"))


def _sweep(state: Column, m: Column) -> Column:
    """One mention further: it counts if it begins where the last one that counts has ended."""
    free = m["start"] >= state["end"]
    return F.struct(F.when(free, m["start"] - m["less"]).otherwise(state["end"]).alias("end"), F.when(free, F.array_append(state["kept"], m)).otherwise(state["kept"]).alias("kept"))
