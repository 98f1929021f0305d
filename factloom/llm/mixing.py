"""Mixing sources to target weights with a low-discrepancy schedule. DataFrame functions only.

Slot n of the schedule is the n-th point of a golden-ratio sequence, u(n) = frac(n * A / M)
with M = 2^31 - 1 and A = round(M / golden ratio), in whole numbers. u(n) is mapped through
the sources' cumulative weights, and the slots of a source are ranked. Each source's
documents are shuffled (by MD5 of seed and id) and laid end to end, twice; rank r takes words
r*block .. (r+1)*block of that line. So every stretch of the schedule holds the sources in
their target shares, and a document is taken at most twice.

Prefix sums never gather a source in one task: rows fall into 4096 bins by the shuffle key,
bins are summed first, and only rows of one bin of one source are ordered together.

Nulls, empties, ties: a null source is a source of its own, ordered last; a null text has
size 0; documents of size 0 are in no block and have `taken` 0; rows with equal ids are
ordered by a hash of their text, and rows equal in both by chance, which leaves the same
multiset of rows. An empty table, or one without any word, gives an empty schedule.
Rows with null or equal ids share a shuffle key and so one bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import common

#: Modulus and multiplier of the golden-ratio points (fixed values).
M, A = 2147483647, 1327217885
BIN_DIGITS = 3  # hexadecimal digits of the shuffle key: 4096 bins
CELLS = 4096
WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    """Number of maximal runs of bytes other than ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """(id, source, size, key): size in words and the shuffle key of each row."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key"), F.xxhash64(text_col).alias("tie"))


def targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target): water-filling of `share` times all sizes by weight, no
    source above `most` times its size. One row per source."""
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(nth, F.lit(len(weights))) + 1)
    ranked = by_source.select("source", "source_size", nth.alias("nth"), weight.alias("weight"), (most * F.col("source_size")).alias("cap"))
    # The sources that fill up first are those with the smallest cap for their weight.
    order = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    everything = Window.partitionBy()
    filled = ranked.select(
        "*",
        F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("full"),
        F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("open_weight"),
        (share * F.sum("source_size").over(everything)).alias("total"),
    )
    level = (F.col("total") - F.col("full")) / F.col("open_weight")
    # The first source that the level does not fill sets the level of all that follow.
    open_level = F.min(F.when(level * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "nth", level.alias("level"))))
    leveled = filled.withColumn("first", open_level.over(everything))
    target = F.when(F.col("first").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("first.level") * F.col("weight")))
    return leveled.select("source", "source_size", "nth", target.alias("target"))


def _prefix(rows: DataFrame, group: list[str], bin_: str, value: str, order: list[str], out: str) -> DataFrame:
    """Adds the sum of `value` over the rows before each row of its group (ordered by bin, then
    `order`), without gathering a group: bins are summed, bin sums are run up, rows are run up
    within their bin."""
    bins = rows.groupBy(*group, bin_).agg(F.sum(value).alias("_sum"))
    up = Window.partitionBy(*group).orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(*[F.col(c).alias(f"_{c}") for c in (*group, bin_)], F.coalesce(F.sum("_sum").over(up), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*group, bin_).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_local", F.coalesce(F.sum(value).over(within), F.lit(0)))
    same = [local[c].eqNullSafe(bins[f"_{c}"]) for c in (*group, bin_)]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return local.join(bins, condition).withColumn(out, F.col("_before") + F.col("_local")).drop("_local", "_before", *[f"_{c}" for c in (*group, bin_)])


def placed(rows: DataFrame, aims: DataFrame) -> DataFrame:
    """(nth, id, size, start): where each document starts in its source's shuffled line."""
    numbered = rows.join(aims.select(F.col("source").alias("_source"), "nth"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return _prefix(numbered.withColumn("bin", F.substring("key", 1, BIN_DIGITS)), ["nth"], "bin", "size", ["key", "id", "tie"], "start").drop("bin")


def schedule(aims: DataFrame, block: int = 128) -> DataFrame:
    """(slot, nth, rank): the source of each slot and its rank among that source's slots."""
    spark = aims.sparkSession
    total = aims.agg(F.sum("target")).first()[0] or 0.0
    n = int(-(-total // block))
    up = Window.orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    edges = aims.filter("target > 0").select("nth", (F.coalesce(F.sum("target").over(up), F.lit(0.0)) / total if total else F.lit(0.0)).alias("lo"), (F.col("target") / total if total else F.lit(0.0)).alias("width"))
    edges = edges.select("nth", "lo", F.coalesce(F.lead("lo").over(Window.orderBy("nth")), F.lit(1.0)).alias("hi"))
    cells = edges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))))
    slots = spark.range(n).select(F.col("id").alias("slot"), ((F.col("id") % M * A) % M / float(M)).alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    mapped = slots.join(cells, "cell").filter("u >= lo and u < hi").select("slot", "nth")
    counted = mapped.select("slot", "nth", F.floor(F.col("slot") / 16384).alias("bin"), F.lit(1).cast("long").alias("one"))
    return _prefix(counted, ["nth"], "bin", "one", ["slot"], "rank").select("slot", "nth", "rank")


def blocks(lines: DataFrame, block: int = 128, most: int = 2) -> DataFrame:
    """(nth, rank, id, size, start, pass, from_word, to_word): the pieces of documents in each block of a
    source's line, which holds its documents `most` times over."""
    length = lines.groupBy("nth").agg(F.sum("size").alias("length"))
    rows = lines.filter("size > 0").join(length.withColumnRenamed("nth", "_nth"), F.col("nth") == F.col("_nth")).drop("_nth")
    passes = rows.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("at", F.col("pass") * F.col("length") + F.col("start"))
    cut = passes.withColumn("rank", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))))
    first = F.greatest(F.lit(0).cast("long"), F.col("rank") * block - F.col("at"))
    last = F.least(F.col("size"), (F.col("rank") + 1) * block - F.col("at"))
    return cut.select("nth", "rank", "id", "size", "start", "pass", first.alias("from_word"), last.alias("to_word"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 128, seed: str = "mix", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, targets, slices). Slices are the mix in order of `slot`: document `id` of source
    number `nth`, words from_word up to to_word."""
    # Texts are read once: sizes and targets are small and are written before they are used again.
    rows = common.materialise(sized(docs, id_col, text_col, source_col, seed), "mixing-sizes")
    aims = common.materialise(targets(rows, weights, share), "mixing-targets")
    lines = placed(rows, aims)
    slices = blocks(lines, block).join(schedule(aims, block), ["nth", "rank"])
    return lines, aims, slices.select("slot", "nth", "pass", "id", "size", "start", "from_word", "to_word")


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 128, seed: str = "mix", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5) -> DataFrame:
    """(id, size, source_size, target, taken): per document the words that the mix takes of it."""
    lines, aims, slices = mixed(docs, id_col, text_col, source_col, block, seed, weights, share)
    sums = slices.groupBy("nth", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    # The start of a document that has words is its own in its source.
    out = lines.join(sums.select(F.col("nth").alias("_nth"), F.col("start").alias("_start"), "taken"), (F.col("nth") == F.col("_nth")) & (F.col("start") == F.col("_start")) & (F.col("size") > 0), "left")
    out = out.select("id", "nth", "size", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return out.join(aims.select("nth", "source_size", "target"), "nth").select("id", "size", "source_size", "target", "taken")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 128, seed: str = "mix", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5) -> DataFrame:
    """The rows of `docs`, all columns as they are, whatever their names, each as often as the mix
    takes it: taken words over size, rounded to a whole number (a half rounds up). Documents without
    words go. A source's words then miss its target by its last block and half a document at most."""
    tie = F.xxhash64(text_col, source_col)
    part = docs.select(F.struct(F.col(id_col).alias("id"), tie.alias("tie")).alias("key"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    counts = taken(part, "key", "text", "source", block, seed, weights, share).filter("taken > 0")
    copies = counts.groupBy(F.col("id.id").alias("of_id"), F.col("id.tie").alias("of_tie")).agg(F.sum(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int").alias("copies"), F.count("*").alias("n")).filter("copies > 0")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), tie.alias("tie"))
    joined = own.join(copies, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("tie") == F.col("of_tie"))).select("row", "id", "tie", "copies", "n")
    # Equal rows (same id, text and source) share their copies: the first takes them all. Only they are numbered.
    nth = F.row_number().over(Window.partitionBy("id", "tie").orderBy("tie"))
    single = joined.filter("n = 1").select("row", "copies")
    several = joined.filter("n > 1").withColumn("nth", nth).filter("nth = 1").select("row", "copies")
    made = single.unionByName(several).withColumn("again", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    return made.select("row.*")
