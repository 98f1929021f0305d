"""Filters, access, ranking and merging of facts.

A fact has the columns of schemas.PARAMETER, a document those of schemas.DOCUMENT. All of
this is Column arithmetic: predicates are built only for what is asked, so that Catalyst can
push them to the scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sensitivity levels each role may see; any other role counts as the first.
ROLE_LEVELS = {
    "external_partner": ("public",),
    "researcher": ("public", "internal"),
    "analyst": ("public", "internal"),
    "lead": ("public", "internal", "secret"),
    "admin": ("public", "internal", "secret"),
}
HIGHEST_ROLE = "admin"
#: Value bounds per unit in three contexts (F11 load, F12 relation, F13 display; B05). None: open.
UNIT_BOUNDS = {
    "load": {"pct": (0.0, 100.0), "pH": (0.0, 14.0), "degC": (-273.0, None), "g_t": (0.0, None), "mg_L": (0.0, None), "ppm": (0.0, None)},
    "relation": {"pct": (0.0, 105.0), "degC": (-50.0, 2000.0), "g_t": (0.0, None), "mg_L": (0.0, None)},
    "display": {"pct": (0.0, 100.0), "pH": (0.0, 14.0), "degC": (-50.0, 3500.0), "g_t": (0.0, None), "mg_L": (0.0, None), "ppm": (0.0, None), "A_m2": (0.0, None), "m3_h": (0.0, None), "t_day": (0.0, None)},
}


@dataclass(frozen=True)
class Filters:
    """A normalised filter (F07). Every part is optional."""

    year_lo: int | None = None
    year_hi: int | None = None
    geo: tuple[str, ...] = ()
    material: tuple[str, ...] = ()
    process: tuple[str, ...] = ()
    min_confidence: float | None = None

    def __bool__(self) -> bool:
        return bool(self.year_lo is not None or self.year_hi is not None or self.geo or self.material or self.process or self.min_confidence is not None)


def _whole(x) -> int | None:
    try:
        return int(x)
    except (TypeError, ValueError):
        return None


def _texts(x) -> tuple[str, ...]:
    items = x if isinstance(x, (list, tuple, set)) else [x]
    return tuple(s for s in (str(i).strip().lower() for i in items if i is not None) if s)


def normalised(raw: dict | None, since: int | None = None) -> Filters | None:
    """`year` as a pair is a range, as a list its least and greatest, as a number the lower
    bound; what cannot be read is ignored; `since` (from the query's words) is a lower bound
    where none is given. None if nothing is left."""
    raw = raw or {}
    lo = hi = None
    year = raw.get("year")
    if isinstance(year, tuple) and len(year) == 2:
        lo, hi = map(_whole, year)
    elif isinstance(year, (list, tuple, set)):
        years = [y for y in map(_whole, year) if y is not None]
        lo, hi = (min(years), max(years)) if years else (None, None)
    elif year is not None:
        lo = _whole(year)
    try:
        confidence = float(raw["min_confidence"]) if raw.get("min_confidence") is not None else None
    except (TypeError, ValueError):
        confidence = None
    out = Filters(lo if lo is not None else since, hi, _texts(raw.get("geo")), _texts(raw.get("material")), _texts(raw.get("process")), confidence)
    return out or None


def overlaps(lo: float | None, hi: float | None, low: str = "value_low", high: str = "value_high", half_line: bool = False) -> Column:
    """does a fact's interval meet lo..hi? A one-sided fact is a point, or with
    `half_line` (B22) a half-line. Facts without any bound never do."""
    a, b = F.coalesce(low, high), F.coalesce(high, low)
    held = a.isNotNull() & b.isNotNull()
    if half_line:
        a, b = F.col(low), F.col(high)
    if hi is not None:
        held = held & (F.coalesce(a <= hi, F.lit(True)) if half_line else (a <= hi))
    if lo is not None:
        held = held & (F.coalesce(b >= lo, F.lit(True)) if half_line else (b >= lo))
    return held


def midpoint(low: str = "value_low", high: str = "value_high") -> Column:
    """The value that stands for a fact."""
    return (F.coalesce(low, high) + F.coalesce(high, low)) / 2


def distance(target: float | None, low: str = "value_low", high: str = "value_high") -> Column:
    return F.abs(midpoint(low, high) - F.lit(target)) if target is not None else F.lit(None).cast("double")


@dataclass(frozen=True)
class Wanted:
    """A number asked for: unit and metric optional, an interval, a material optional."""

    unit_canon: str | None = None
    metric: str | None = None
    value_low: float | None = None
    value_high: float | None = None
    material: str | None = None
    target: float | None = field(default=None)

    def point(self) -> float | None:
        if self.target is not None:
            return self.target
        known = [x for x in (self.value_low, self.value_high) if x is not None]
        return sum(known) / len(known) if known else None


def numeric_track(parameters: DataFrame, documents: DataFrame, wanted: Wanted, limit: int = 50, ties: tuple[str, ...] = ("doc_id", "pkey")) -> DataFrame:
    """Facts for one number, those in range first, then the nearest.
    Documents are joined after the top-k has cut the facts down."""
    rows = parameters
    if wanted.unit_canon is not None:
        rows = rows.filter(F.col("unit_canon") == wanted.unit_canon)
    if wanted.metric is not None:
        rows = rows.filter(F.contains(F.lower("metric"), F.lit(wanted.metric.lower())))
    if wanted.material is not None:
        rows = rows.filter(F.contains(F.lower("canon"), F.lit(wanted.material.lower())))
    rows = rows.withColumns({"in_range": overlaps(wanted.value_low, wanted.value_high), "dist": distance(wanted.point())})
    top = rows.orderBy(F.col("in_range").desc(), F.col("dist").asc_nulls_last(), *ties).limit(limit)
    return top.join(documents.select("doc_id", "year", "geo", "sensitivity"), "doc_id", "left")


def entity_track(parameters: DataFrame, canons: DataFrame, limit: int = 10, ties: tuple[str, ...] = ("doc_id", "pkey")) -> DataFrame:
    """The facts of the named entities with the highest confidence."""
    return parameters.join(canons.select("canon"), "canon", "left_semi").orderBy(F.col("confidence").desc_nulls_last(), *ties).limit(limit)


def _any_contains(column: Column, parts: tuple[str, ...]) -> Column:
    held = F.lit(False)
    for part in parts:
        held = held | F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(part))
    return held


def fact_matches(nf: Filters, year: Column | None = None) -> Column:
    """F04 as a predicate on facts that carry `year`, `geo` of their document. A null year or
    confidence fails where that part is asked for."""
    year = year if year is not None else F.col("year")
    held = F.lit(True)
    if nf.year_lo is not None:
        held = held & F.coalesce(year >= nf.year_lo, F.lit(False))
    if nf.year_hi is not None:
        held = held & F.coalesce(year <= nf.year_hi, F.lit(False))
    if nf.geo:
        held = held & _any_contains(F.col("geo"), nf.geo)
    if nf.min_confidence is not None:
        held = held & F.coalesce(F.col("confidence") >= nf.min_confidence, F.lit(False))
    if nf.material:
        held = held & _any_contains(F.col("canon"), nf.material)
    if nf.process:
        held = held & _any_contains(F.concat_ws(" ", "canon", "quote", "conditions", "metric"), nf.process)
    return held


def document_matches(nf: Filters) -> Column:
    """year and geo only."""
    return fact_matches(Filters(nf.year_lo, nf.year_hi, nf.geo))


def apply_filters(documents: DataFrame, facts: DataFrame, nf: Filters | None) -> tuple[DataFrame, DataFrame]:
    """filtered documents and facts; where a material or process is asked for, a document
    needs a fact that passed."""
    if not nf:
        return documents, facts
    known = documents.select("doc_id", "year", "geo")
    kept = facts.join(known, "doc_id", "left").filter(fact_matches(nf)).drop("year", "geo")
    docs = documents.filter(document_matches(nf))
    if nf.material or nf.process:
        docs = docs.join(kept.select("doc_id"), "doc_id", "left_semi")
    return docs, kept


def visible(rows: DataFrame, role: str, column: str = "sensitivity") -> DataFrame:
    """rows that the role may see; a null level is public."""
    return rows.filter(F.coalesce(column, F.lit("public")).isin(*ROLE_LEVELS.get(role, ROLE_LEVELS["external_partner"])))


def hidden_count(rows: DataFrame, role: str, column: str = "sensitivity") -> DataFrame:
    """one row, how many the role may not see."""
    level = F.coalesce(column, F.lit("public"))
    return rows.agg(F.count_if(~level.isin(*ROLE_LEVELS.get(role, ROLE_LEVELS["external_partner"]))).alias("hidden_count"))


def plausible(context: str, unit: str = "unit_canon", low: str = "value_low", high: str = "value_high") -> Column:
    """are both bounds within the context's limits for the unit? Open bounds and
    units without limits pass."""
    held = F.lit(True)
    for name, (lo, hi) in UNIT_BOUNDS[context].items():
        inside = F.lit(True)
        for value in (low, high):
            if lo is not None:
                inside = inside & F.coalesce(F.col(value) >= lo, F.lit(True))
            if hi is not None:
                inside = inside & F.coalesce(F.col(value) <= hi, F.lit(True))
        held = held & F.when(F.col(unit) == name, inside).otherwise(F.lit(True))
    return held


def sane_year(year: Column) -> Column:
    """F14."""
    return F.when(year >= 1950, year)


def dense(documents: DataFrame, least: int = 3, limit: int | None = None) -> DataFrame:
    """Readable documents of at least this value, the best first."""
    rows = documents.filter((F.coalesce("kg_value", F.lit(0)) >= least) & F.coalesce("ok", F.lit(True))).orderBy(F.col("kg_value").desc(), "doc_id")
    return rows.limit(limit) if limit is not None else rows


def rank_key(target: float | None) -> list[Column]:
    """Reference facts, facts in range, the nearest to the target, clean quotes."""
    gap = F.coalesce(distance(target), F.lit(float("inf")))
    return [F.col("ref").desc(), F.col("in_range").desc(), gap.asc(), F.col("bad_quote").asc()]


def ranked(facts: DataFrame, target: float | None, limit: int, ties: tuple[str, ...]) -> DataFrame:
    """T02, W12."""
    return facts.orderBy(*rank_key(target), *ties).limit(limit)


def signature() -> Column:
    """What makes two facts the same in a list; the entity is not part of it."""
    return F.struct("metric", "value_low", "value_high", "unit_canon", "phase", "doc_id", F.substring("quote", 1, 50).alias("quote"))


def deduplicated(facts: DataFrame, order: list[Column | str]) -> DataFrame:
    """The first fact of each signature."""
    first = F.row_number().over(Window.partitionBy(signature()).orderBy(*order))
    return facts.withColumn("_first", first).filter("_first = 1").drop("_first")


def merged(numeric: DataFrame, semantic: DataFrame, floor: float = 0.35) -> DataFrame:
    """(doc_id, source, score, place): numeric hits (columns doc_id, ref, in_range,
    pos) before semantic ones (doc_id, score, pos) at or above the floor, each document once."""
    a = numeric.select("doc_id", F.lit("numeric").alias("source"), F.lit(None).cast("double").alias("score"), F.lit(0).alias("track"), F.struct((~F.col("ref")).alias("r"), (~F.col("in_range")).alias("i"), "pos").alias("at"))
    b = semantic.filter(F.coalesce("score", F.lit(0.0)) >= floor).select("doc_id", F.lit("semantic").alias("source"), F.col("score").cast("double"), F.lit(1).alias("track"), F.struct(F.lit(False).alias("r"), F.lit(False).alias("i"), "pos").alias("at"))
    best = F.min_by(F.struct("source", "score"), F.struct("track", "at"))
    rows = a.unionByName(b).groupBy("doc_id").agg(best.alias("best"), F.min(F.struct("track", "at")).alias("place"))
    return rows.select("doc_id", "best.source", "best.score", "place")


def out_of_domain(top_score: float | None, numbers: int, entities: int, facts: int, least: float = 0.45) -> bool:
    """nothing was recognised and the best text is not near enough."""
    return not numbers and not entities and not facts and (top_score or 0.0) < least


def confidence_word(column: str = "confidence") -> Column:
    """High from 0.8, medium from 0.5 or unknown, else low."""
    c = F.coalesce(column, F.lit(0.5))
    return F.when(c >= 0.8, "high").when(c >= 0.5, "medium").otherwise("low")


def needs_check(facts: DataFrame) -> DataFrame:
    """numeric facts from running text."""
    numeric = F.col("value_low").isNotNull() | F.col("value_high").isNotNull()
    return facts.filter(numeric & F.col("source").isin("grammar", "mention"))
