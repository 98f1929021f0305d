"""Agreement and contradiction between documents.

Facts are compared within (metric, canon, phase, unit), one per document, the first `cap`
pairs of a group in order of their documents. A group's pairs are never all made: the n-th
document is only paired with later ones while the number of pairs before it is below the cap.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.facts import midpoint, plausible

#: Limits are norms, not measurements (fixed values).
LIMITS = ("<", "<=", ">", ">=")
#: Metrics of composition: content and concentration (fixed values).
COMPOSITION = ("содержание", "концентрация")
TABLE_SOURCE = "vision_ocr"
GROUP = ("metric", "canon", "phase", "unit_canon")


def eligible(least_confidence: float = 0.7, widest: float = 0.5) -> Column:
    """F16: a confident, pointlike measurement of a thing, with a plausible value."""
    size = F.greatest(F.abs("value_low"), F.abs("value_high"))
    wide = F.coalesce(F.try_divide(F.abs(F.col("value_high") - F.col("value_low")), size) > widest, F.lit(False))
    phase_only = F.coalesce(F.col("canon") == F.col("phase"), F.lit(False)) | F.coalesce(F.col("label") == "Phase", F.lit(False))
    return (
        (F.coalesce("confidence", F.lit(0.0)) >= least_confidence)
        & midpoint().isNotNull()
        & (F.coalesce("metric", F.lit("")) != "")
        & ~F.coalesce("comparator", F.lit("=")).isin(*LIMITS)
        & ~phase_only
        & plausible("relation")
        & ~wide
    )


def quote_key(quote: str = "quote") -> Column:
    """what two quotes must share to be the same source."""
    return F.substring(F.trim(F.regexp_replace(F.lower(F.coalesce(quote, F.lit(""))), r"\s+", " ")), 1, 80)


def comparable(a: str, b: str, compositions: tuple[str, ...] = COMPOSITION) -> Column:
    """equal conditions; or none on either side, for compositions of one phase from tables."""
    ca, cb = F.coalesce(f"{a}.conditions", F.lit("")), F.coalesce(f"{b}.conditions", F.lit(""))
    table = (F.col(f"{a}.source") == TABLE_SOURCE) & (F.col(f"{b}.source") == TABLE_SOURCE)
    bare = (F.coalesce(f"{a}.phase", F.lit("")) != "") & F.col(f"{a}.metric").isin(*compositions) & table
    return F.when((ca == "") & (cb == ""), F.coalesce(bare, F.lit(False))).otherwise((ca != "") & (ca == cb))


def first_documents_of(facts: DataFrame, order: tuple[str, ...], most: int) -> DataFrame:
    """One fact per group and document, of the first `most` documents of each group,
    numbered. Both ranks are limited before rows are exchanged, so a group of many documents
    sends at most `most` rows from each task."""
    keys = [F.coalesce(k, F.lit("")) if k == "phase" else F.col(k) for k in GROUP]
    first = F.row_number().over(Window.partitionBy(*keys, "doc_id").orderBy(*order))
    one = facts.withColumn("_first", first).filter("_first = 1").drop("_first")
    return one.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id"))).filter(F.col("nth") <= most)


def pairs(facts: DataFrame, documents: DataFrame | None = None, order: tuple[str, ...] = ("pkey",), cap: int = 40, agree: float = 0.10, differ: float = 0.20, compositions: tuple[str, ...] = COMPOSITION) -> DataFrame:
    """VALIDATED_BY and CONTRADICTS between documents. `documents` gives `origin` for the
    kind. Ordered pairs are counted before the gates, as (1,2), (1,3), ..., (2,3), ...

    Only the first cap+1 documents of a group can be in one of its first `cap` pairs. They are put
    into one row, and its pairs are made from it: one exchange, and no join of facts with facts."""
    reps = first_documents_of(facts.filter(eligible()), order, cap + 1)
    if documents is not None:
        reps = reps.join(documents.select("doc_id", "origin"), "doc_id", "left")
    else:
        reps = reps.withColumn("origin", F.lit(None).cast("string"))
    keys = [F.coalesce(k, F.lit("")).alias(k) if k == "phase" else F.col(k) for k in GROUP]
    fields = ["nth", "doc_id", "value_low", "value_high", "quote", "conditions", "source", "phase", "metric", "origin"]
    groups = reps.select(*keys, F.struct(*fields).alias("f")).groupBy(*GROUP).agg(F.sort_array(F.collect_list("f")).alias("fs")).filter(F.size("fs") > 1)
    n = F.size("fs")
    # the number of pair (i, j) among the pairs of n documents; with n = cap+1 the first row is full already
    number = lambda i, j: (i - 1) * n - (i * (i - 1) / 2).cast("int") + (j - i)
    later = lambda i: F.filter(F.transform(F.sequence(i + 1, n), lambda j: F.struct(i.alias("i"), j.alias("j"))), lambda p: number(p["i"], p["j"]) <= cap)
    made = groups.withColumn("p", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), n - 1), later))))
    joined = made.select(*GROUP, F.element_at("fs", F.col("p.i")).alias("a"), F.element_at("fs", F.col("p.j")).alias("b")).filter(comparable("a", "b", compositions))
    va = (F.coalesce("a.value_low", "a.value_high") + F.coalesce("a.value_high", "a.value_low")) / 2
    vb = (F.coalesce("b.value_low", "b.value_high") + F.coalesce("b.value_high", "b.value_low")) / 2
    gap = F.abs(va - vb) / F.coalesce(F.nullif(F.greatest(F.abs(va), F.abs(vb)), F.lit(0.0)), F.lit(1.0))
    key = lambda s: F.substring(F.trim(F.regexp_replace(F.lower(F.coalesce(f"{s}.quote", F.lit(""))), r"\s+", " ")), 1, 80)
    copied = (key("a") == key("b")) & (key("a") != "")
    rel = F.when(gap <= agree, F.when(~copied, "VALIDATED_BY")).when(gap > differ, "CONTRADICTS")
    tabled = (F.col("a.source") == TABLE_SOURCE) & (F.col("b.source") == TABLE_SOURCE) & F.col("metric").isin(*compositions) & (F.col("phase") != "")
    kind = F.when(~F.col("a.origin").eqNullSafe(F.col("b.origin")) & F.coalesce(tabled, F.lit(False)), "ru_vs_world").otherwise("method_vs_method")
    out = joined.select(rel.alias("rel"), kind.alias("kind"), "metric", F.col("canon").alias("entity"), "phase", F.col("unit_canon").alias("unit"), F.col("a.doc_id").alias("doc_a"), F.col("b.doc_id").alias("doc_b"), va.alias("val_a"), vb.alias("val_b"), F.substring("a.quote", 1, 200).alias("quote_a"), F.substring("b.quote", 1, 200).alias("quote_b"))
    return out.filter("rel is not null")


def relations_of(relations: DataFrame, doc_ids: DataFrame, limit: int = 300) -> DataFrame:
    """Relations with either end in a set, as two semi-joins rather than one join on OR."""
    ids = doc_ids.select("doc_id").distinct()
    a = relations.join(ids, F.col("doc_a") == F.col("doc_id"), "left_semi")
    b = relations.join(ids, F.col("doc_b") == F.col("doc_id"), "left_semi")
    return a.union(b).distinct().orderBy("rel", "doc_a", "doc_b", "metric", "entity", "phase", "unit").limit(limit)


def grouped(relations: DataFrame, confidences: DataFrame) -> DataFrame:
    """Per (rel, entity, metric, phase, unit) the number of relations, of documents at
    either end, of values on one side only, and the mean confidence of the documents. Pairs are
    aggregated once; a group has at most 41 documents, which then meet their confidences."""
    keys = ["rel", "entity", "metric", "phase", "unit"]
    one = relations.groupBy(*keys).agg(F.count("*").alias("n"), F.collect_set("val_a").alias("a"), F.collect_set("val_b").alias("b"), F.collect_set("doc_a").alias("da"), F.collect_set("doc_b").alias("db"))
    docs = F.array_union("da", "db")
    rows = one.select(*keys, "n", F.size(docs).cast("long").alias("n_docs"), F.size(F.array_except("a", "b")).cast("long").alias("only_a"), F.size(F.array_intersect("a", "b")).cast("long").alias("shared"), F.explode(docs).alias("doc_id"))
    out = rows.join(confidences, "doc_id", "left").groupBy(*keys, "n", "n_docs", "only_a", "shared").agg(F.avg("confidence").alias("mean_confidence"))
    return out.select(*keys, "n", "n_docs", "mean_confidence", "only_a", "shared")


def group_lists(relations: DataFrame, documents: DataFrame, confidences: DataFrame, cap: int = 3) -> DataFrame:
    """What a report says of each group (rel, entity, metric, phase, unit): how many documents, the
    first of them and how many more, their mean confidence, years and places, the kinds of relation,
    and the values: `same` on both sides, or those that the sides do not share (all, if they share
    every value). Lists are sorted. A group has at most 41 documents (`pairs`)."""
    keys = ["rel", "entity", "metric", "phase", "unit"]
    one = relations.groupBy(*keys).agg(F.sort_array(F.collect_set("val_a")).alias("a"), F.sort_array(F.collect_set("val_b")).alias("b"), F.sort_array(F.collect_set("kind")).alias("kinds"), F.sort_array(F.array_union(F.collect_set("doc_a"), F.collect_set("doc_b"))).alias("docs"))
    told = documents.select(F.col("doc_id").alias("_doc"), F.col("year").cast("string").alias("year"), "geo")
    each = one.select(*keys, F.explode("docs").alias("doc_id")).join(told, F.col("doc_id") == F.col("_doc"), "left").join(confidences, "doc_id", "left")
    about = each.groupBy(*keys).agg(F.sort_array(F.collect_set("year")).alias("years"), F.sort_array(F.collect_set("geo")).alias("places"), F.avg("confidence").alias("mean_confidence"))
    same = F.col("a") == F.col("b")
    side = lambda own, other: F.when(same, own).when(F.size(F.array_except(own, other)) > 0, F.array_except(own, other)).otherwise(own)
    out = one.join(about, keys)  # keys of `pairs` are never null
    return out.select(*keys, "kinds", F.size("docs").cast("long").alias("n_docs"), F.slice("docs", 1, cap).alias("first_docs"), F.greatest(F.size("docs") - cap, F.lit(0)).cast("long").alias("more"), "mean_confidence", "years", "places", same.alias("same"), side(F.col("a"), F.col("b")).alias("left_values"), side(F.col("b"), F.col("a")).alias("right_values"))


def upserted(before: DataFrame, new: DataFrame) -> DataFrame:
    """One relation a (rel, documents, metric, entity, phase), the new one where both are."""
    key = ["rel", "doc_a", "doc_b", "metric", "entity", "phase"]
    rest = [c for c in new.columns if c not in key]
    rows = before.select(*new.columns, F.lit(0).alias("_new")).unionByName(new.withColumn("_new", F.lit(1)))
    one = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("_new", *[c for c in rest if c not in ("quote_a", "quote_b")])).alias("r"))
    return one.select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])


def contradictions(relations: DataFrame, limit: int = 50) -> DataFrame:
    """Disagreements by kind and entity."""
    rows = relations.filter("rel = 'CONTRADICTS'")
    return rows.orderBy("kind", "entity", "metric", "phase", "unit", "doc_a", "doc_b").limit(limit)


def mean_confidence(facts: DataFrame) -> DataFrame:
    """A13."""
    return facts.groupBy("doc_id").agg(F.avg("confidence").alias("confidence"))


#: What makes two facts of a document the same value.
VALUE_KEY = ("canon", "metric", "value_low", "value_high", "unit_canon")


def without_repeats(facts: DataFrame, pos: str = "pos") -> DataFrame:
    """Per document in order of `pos`, a fact goes if its value key or its quote key was kept
    before. What was dropped does not count, so this is a scan of one document's facts: documents lie
    sorted one after another, and a task holds the keys that the document it is at has kept."""
    columns = facts.columns

    def keep(batches):
        import pyarrow as pa

        at, values, quotes = None, set(), set()
        for batch in batches:
            flags = []
            keys = (batch.column(columns.index(c)).to_pylist() for c in VALUE_KEY)
            said = batch.column(columns.index("quote")).dictionary_encode()
            texts = [" ".join((x or "").lower().split())[:120] for x in [*said.dictionary.to_pylist(), None]]
            which = (len(texts) - 1 if i is None else i for i in said.indices.to_pylist())
            for doc, quote, *value in zip(batch.column(columns.index("doc_id")).to_pylist(), which, *keys):
                if doc != at and (doc == doc or at == at):  # not a number is one document
                    at, values, quotes = doc, set(), set()
                value, quote = tuple(value), texts[quote]
                new = value not in values and quote not in quotes
                flags.append(new)
                if new:
                    values.add(value)
                    quotes.add(quote)
            yield batch.filter(pa.array(flags, pa.bool_()))

    rows = facts.repartition("doc_id").sortWithinPartitions("doc_id", F.col(pos).asc_nulls_last())
    return rows.mapInArrow(keep, facts.schema)
