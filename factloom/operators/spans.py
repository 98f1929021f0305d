"""Span joins: the nearest, the last before, and one-to-one matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def span_distance(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """0 if two spans overlap, else the gap between them."""
    return F.greatest(F.lit(0), b_start - a_end, a_start - b_end)


def nearest(values: DataFrame, mentions: DataFrame, group: str, tier: Column | None = None) -> DataFrame:
    """For every value (group, vid, v_start, v_end) its nearest mention (group, mid, m_start,
    m_end): lowest tier, then distance, then position. One aggregate over the pairs of a group:
    for groups that are short, as sentences are. Points of long groups: `nearest_points`."""
    rows = values.join(mentions, group)
    gap = span_distance(F.col("v_start"), F.col("v_end"), F.col("m_start"), F.col("m_end"))
    best = F.min(F.struct((tier if tier is not None else F.lit(0)).alias("tier"), gap.alias("gap"), F.col("m_start"), F.col("mid")))
    out = rows.groupBy(group, "vid").agg(best.alias("b"))
    return out.select(group, "vid", F.col("b.mid").alias("mid"), F.col("b.gap").alias("gap"))


def nearest_points(values: DataFrame, mentions: DataFrame, group: str) -> DataFrame:
    """For every value (group, vid, v_at) the nearest mention (group, mid, m_at): by distance,
    then the earlier, then the smaller mid. No pairs: both sides stand in one line of their group,
    and each value sees the last mention up to it and the first from it on. Values of a group
    without mentions are left out."""
    points = mentions.groupBy(group, F.col("m_at").alias("at")).agg(F.min("mid").alias("mid"))
    seen = F.struct("at", "mid")
    nothing = F.lit(None).cast(T.StructType([T.StructField("at", points.schema["at"].dataType), T.StructField("mid", points.schema["mid"].dataType)]))
    vid = F.lit(None).cast(values.schema["vid"].dataType)
    line = values.select(group, F.col("v_at").alias("at"), "vid", nothing.alias("m"), F.lit(True).alias("own")).unionByName(points.select(group, "at", vid.alias("vid"), seen.alias("m"), F.lit(False).alias("own")))
    up = Window.partitionBy(group).orderBy("at", "own").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(group).orderBy(F.col("at").desc(), "own").rowsBetween(Window.unboundedPreceding, 0)
    both = line.select(group, "vid", "at", "own", F.last("m", ignorenulls=True).over(up).alias("before"), F.last("m", ignorenulls=True).over(down).alias("after")).filter("own")
    near = lambda m: F.when(m.isNotNull(), F.struct(F.abs(F.col("at") - m["at"]).alias("gap"), m["at"].alias("at"), m["mid"].alias("mid")))
    best = both.select(group, "vid", F.least(near(F.col("before")), near(F.col("after"))).alias("b")).filter("b is not null")
    return best.select(group, "vid", F.col("b.mid").alias("mid"), F.col("b.gap").alias("gap"))


def last_before(left: DataFrame, right: DataFrame, group: str, at: str, value: str, within: Column | None = None) -> DataFrame:
    """An as-of join without pairs: both sides in one sorted line per group, the last right value
    carried on to the left rows. `left` has (group, lid, at), `right` (group, at, value)."""
    a = left.select(group, F.col(at).alias("_at"), F.lit(1).alias("_side"), "lid", F.lit(None).cast(right.schema[value].dataType).alias("_value"), F.lit(None).cast(right.schema[at].dataType).alias("_seen"))
    b = right.select(group, F.col(at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema["lid"].dataType).alias("lid"), F.col(value).alias("_value"), F.col(at).alias("_seen"))
    w = Window.partitionBy(group).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    line = a.unionByName(b).select(group, "_at", "_side", "lid", F.last("_value", ignorenulls=True).over(w).alias(value), F.last("_seen", ignorenulls=True).over(w).alias("seen_at"))
    rows = line.filter("_side = 1")
    if within is not None:
        rows = rows.withColumn(value, F.when(within, F.col(value)))
    return rows.select(group, "lid", F.col("_at").alias(at), value, "seen_at")


def segments(rows: DataFrame, group: str, order: list[str], anchor: Column) -> DataFrame:
    """Numbers the stretches that anchors begin; 0 is what comes before the first."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("segment", F.sum(F.when(anchor, 1).otherwise(0)).over(w))


def cross_in_group(left: DataFrame, right: DataFrame, group: str) -> DataFrame:
    """Every left key with every right key of the group, distinct sides only (sentences and
    documents name few)."""
    return left.distinct().join(right.distinct(), group)


def enumerated(sentences: DataFrame) -> DataFrame:
    """From left to right each value takes the nearest material that none has taken; only where
    there are two of each at least. Input: (sid, values array<struct<s,e>>, materials
    array<struct<s,e,canon>>); output: (sid, value_no, canon). The choice of one value depends on
    those before, so a sentence is scanned as a whole."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sid, no, canon = [], [], []
            for key, values, materials in zip(*(batch.column(c).to_pylist() for c in ("sid", "values", "materials"))):
                if not values or not materials or len(values) < 2 or len(materials) < 2:
                    continue
                free = sorted(materials, key=lambda m: m["s"])
                for i, v in sorted(enumerate(values), key=lambda x: x[1]["s"]):
                    if not free:
                        break
                    best = min(free, key=lambda m: (max(0, m["s"] - v["e"], v["s"] - m["e"]), m["s"]))
                    free.remove(best)
                    sid.append(key)
                    no.append(i)
                    canon.append(best["canon"])
            yield pa.RecordBatch.from_arrays([pa.array(sid, batch.schema.field("sid").type), pa.array(no, pa.int64()), pa.array(canon, pa.string())], ["sid", "value_no", "canon"])

    kind = sentences.schema["sid"].dataType.simpleString()
    return sentences.select("sid", "values", "materials").mapInArrow(run, f"sid {kind}, value_no long, canon string")
