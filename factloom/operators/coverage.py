"""Coverage, risks and comparisons.

Every branch is aggregated before it is joined: no fan-out, and each shuffle carries partial
sums. Inputs: documents, parameters (facts), authors (doc_id, author), domains (doc_id,
domain), relations (doc_a, doc_b, rel).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import contain, lifecycle

def summary(documents: DataFrame, facts: DataFrame, authors: DataFrame, domains: DataFrame, contradictions: DataFrame, home: str) -> DataFrame:
    """One row of key figures; shares are null without documents."""
    geo = F.col("geo")
    docs = documents.agg(F.count("*").alias("documents"), F.count_if(geo == home).alias("home"), F.count_if(geo != home).alias("abroad"), F.count_if(geo.isNull()).alias("unknown"))
    per_doc = facts.groupBy("doc_id").agg(F.count("*").alias("n"))
    counted = per_doc.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("facts"), F.count("*").alias("docs_with_facts"))
    experts = authors.agg(F.countDistinct("author").alias("experts"))
    areas = domains.agg(F.countDistinct("domain").alias("domains"))
    against = contradictions.agg(F.count("*").alias("contradictions"))
    row = docs.crossJoin(counted).crossJoin(experts).crossJoin(areas).crossJoin(against)  # five rows of one each
    share = lambda c: F.round(F.try_divide(F.col(c).cast("double"), F.col("documents").cast("double")), 3)
    return row.select("*", share("home").alias("home_share"), share("abroad").alias("abroad_share"), share("docs_with_facts").alias("coverage"))


def by_domain(domains: DataFrame, facts: DataFrame, authors: DataFrame) -> DataFrame:
    """Per domain its documents, the facts in them and their authors; zeros are kept."""
    pairs = domains.select("domain", "doc_id").distinct()
    n_facts = facts.groupBy("doc_id").agg(F.count("*").alias("n"))
    docs = pairs.join(n_facts, "doc_id", "left").groupBy("domain").agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("facts"))
    experts = pairs.join(authors.select("doc_id", "author").distinct(), "doc_id").groupBy("domain").agg(F.countDistinct("author").alias("experts"))
    return docs.join(experts, "domain", "left").select("domain", "documents", "facts", F.coalesce("experts", F.lit(0)).alias("experts"))


def by_column(documents: DataFrame, facts: DataFrame, column: Column, name: str) -> DataFrame:
    """Documents and facts by a document's property."""
    n_facts = facts.groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = documents.select("doc_id", column.alias(name)).join(n_facts, "doc_id", "left")
    return rows.groupBy(name).agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("facts"))


def low_sources(facts: DataFrame, least: int, limit: int) -> DataFrame:
    """Entities with too few documents."""
    return facts.groupBy("canon").agg(F.countDistinct("doc_id").alias("sources")).filter(F.col("sources") < least).orderBy("sources", "canon").limit(limit)


def one_sided(facts: DataFrame, documents: DataFrame, home: str) -> DataFrame:
    """Entities with documents of one side only."""
    seen = facts.select("canon", "doc_id").distinct().join(documents.select("doc_id", "geo"), "doc_id")
    sides = seen.groupBy("canon").agg(F.count_if(F.col("geo") == home).alias("home"), F.count_if(F.col("geo") != home).alias("abroad"))
    side = F.when((F.col("home") > 0) & (F.col("abroad") == 0), "only_home").when((F.col("home") == 0) & (F.col("abroad") > 0), "only_abroad")
    return sides.withColumn("side", side).filter("side is not null")


def activity(documents: DataFrame, facts: DataFrame, authors: DataFrame, limit: int) -> DataFrame:
    """The most recent documents with their facts and authors."""
    f = facts.groupBy("doc_id").agg(F.count("*").alias("facts"), F.max("extracted_at").alias("last_extracted"))
    a = authors.groupBy("doc_id").agg(F.countDistinct("author").alias("experts"))
    rows = documents.select("doc_id", "year").join(f, "doc_id", "left").join(a, "doc_id", "left")
    rows = rows.select("doc_id", "year", F.coalesce("facts", F.lit(0)).alias("facts"), F.coalesce("experts", F.lit(0)).alias("experts"), "last_extracted")
    return rows.orderBy(F.col("year").desc_nulls_last(), F.col("last_extracted").desc_nulls_last(), "doc_id").limit(limit)


def experts(authors: DataFrame, domains: DataFrame, most: int, limit: int) -> DataFrame:
    """Authors with at most `most` documents, and the number of their domains."""
    pairs = authors.select("author", "doc_id").distinct()
    few = pairs.groupBy("author").agg(F.count("*").alias("docs")).filter(F.col("docs") <= most)
    areas = pairs.join(domains.select("doc_id", "domain").distinct(), "doc_id").groupBy("author").agg(F.countDistinct("domain").alias("domains"))
    rows = few.join(areas, "author", "left").select("author", "docs", F.coalesce("domains", F.lit(0)).alias("domains"))
    return rows.orderBy(F.col("docs").desc(), "author").limit(limit)


def topic_experts(authors: DataFrame, scope: DataFrame, most: int, limit: int) -> DataFrame:
    """Authors of documents in scope, of few documents in all."""
    pairs = authors.select("author", "doc_id").distinct()
    inside = pairs.join(scope.select("doc_id").distinct().withColumn("_in", F.lit(1)), "doc_id", "left")
    rows = inside.groupBy("author").agg(F.count("_in").alias("docs"), F.count("*").alias("total")).filter((F.col("docs") > 0) & (F.col("total") <= most))
    return rows.orderBy(F.col("docs").desc(), "author").limit(limit)


def technology_comparison(facts: DataFrame, axes: dict[str, Column], technologies: DataFrame) -> DataFrame:
    """Per technology and axis the least and greatest bound, the unit and the number of
    facts, in one pass; `axes` maps a name to the predicate that puts a fact on it."""
    low, high = F.coalesce("value_low", "value_high"), F.coalesce("value_high", "value_low")
    aggregates = []
    for name, on in axes.items():
        aggregates += [F.min(F.when(on, F.least(low, high))).alias(f"{name}_min"), F.max(F.when(on, F.greatest(low, high))).alias(f"{name}_max"), F.max(F.when(on, F.col("unit_canon"))).alias(f"{name}_unit"), F.count_if(on & low.isNotNull()).alias(f"{name}_n")]
    rows = facts.join(technologies.select("canon"), "canon", "left_semi")
    return rows.groupBy("canon").agg(F.countDistinct("doc_id").alias("sources"), *aggregates)


#: Parts of metrics, units and conditions that put a fact on an axis (fixed values).
EFFICIENCY, ENERGY, ENERGY_UNITS = ("извлеч", "выход", "степень"), ("энерг", "расход электро", "удельн"), ("A_m2",)
ECOLOGY = ("выброс", "so2", "co2", "пыл", "стоки", "шлам", "отвал", "экологи", "загрязн")
COLD = ("холодный климат", "Заполярье")


def axes_of_technologies(metric: str = "metric", unit: str = "unit_canon") -> dict[str, Column]:
    """A10: efficiency, energy, temperature and ecology; costs are in no fact."""
    named = lambda parts: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(F.lower(F.coalesce(metric, F.lit(""))), p))
    return {
        "efficiency_pct": (F.col(unit) == "pct") & named(EFFICIENCY),
        "energy": named(ENERGY) | F.coalesce(F.col(unit).isin(*ENERGY_UNITS), F.lit(False)),
        "temperature_c": F.col(unit) == "degC",
        "ecology": named(ECOLOGY),
    }


def technologies(facts: DataFrame, edges: DataFrame, names: DataFrame, axes: dict[str, Column] | None = None, cold: tuple[str, ...] = COLD) -> DataFrame:
    """A10: per technology (column canon) its sources and facts, each axis' bounds, unit and number
    of facts, its conditions (edges src, dst, type OPERATES_AT_CONDITION), whether one of them is cold,
    and capex, which is null. A technology without facts is kept."""
    axes = axes_of_technologies() if axes is None else axes
    figures = technology_comparison(facts, axes, names)
    total = facts.join(names.select("canon"), "canon", "left_semi").groupBy("canon").agg(F.count("*").alias("total_facts"))
    own = edges.filter("type = 'OPERATES_AT_CONDITION'").join(names.select(F.col("canon").alias("src")), "src", "left_semi")
    conditions = own.groupBy(F.col("src").alias("canon")).agg(F.sort_array(F.collect_set("dst")).alias("conditions"), F.max(F.col("dst").isin(*cold)).alias("cold_climate"))
    rows = names.select("canon").distinct().join(figures, "canon", "left").join(total, "canon", "left").join(conditions, "canon", "left")
    made = [F.col(f"{a}_{x}") for a in axes for x in ("min", "max", "unit")] + [F.coalesce(f"{a}_n", F.lit(0)).alias(f"{a}_n") for a in axes]
    return rows.select(
        "canon",
        F.coalesce("sources", F.lit(0)).alias("sources"),
        F.coalesce("total_facts", F.lit(0)).alias("total_facts"),
        *made,
        F.coalesce("conditions", F.array().cast("array<string>")).alias("conditions"),
        F.coalesce("cold_climate", F.lit(False)).alias("cold_climate"),
        F.lit(None).cast("double").alias("capex"),
    )


def dashboard(documents: DataFrame, facts: DataFrame, authors: DataFrame, domains: DataFrame, relations: DataFrame, home: str, limit: int = 20) -> dict[str, DataFrame | None]:
    """Q11: all parts of the overview, as plans that nobody has run. A part whose inputs lack a column
    is None, the others are there."""
    from pyspark.errors import AnalysisException

    from factloom.operators.relations import contradictions

    parts = {
        "summary": lambda: summary(documents, facts, authors, domains, relations.filter("rel = 'CONTRADICTS'"), home),
        "by_domain": lambda: by_domain(domains, facts, authors),
        "by_year": lambda: by_column(documents, facts, F.col("year"), "year"),
        "by_geo": lambda: by_column(documents, facts, F.col("geo"), "geo"),
        "low_sources": lambda: low_sources(facts, 2, limit),
        "one_sided": lambda: one_sided(facts, documents, home),
        "contradictions": lambda: contradictions(relations, limit),
        "activity": lambda: activity(documents, facts, authors, limit),
        "experts": lambda: experts(authors, domains, 15, limit),
    }
    out: dict[str, DataFrame | None] = {}
    for name, make in parts.items():
        try:
            out[name] = make()
        except AnalysisException:
            out[name] = None
    return out


def top_entities(facts: DataFrame, k: int) -> DataFrame:
    """A11."""
    return facts.groupBy("canon").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "canon").limit(k)


def coverage_gaps(facts: DataFrame, documents: DataFrame, column: str) -> DataFrame:
    """Entities whose documents all have one value of a column."""
    seen = facts.select("canon", "doc_id").distinct().join(documents.select("doc_id", column), "doc_id").filter(F.col(column).isNotNull())
    sides = seen.groupBy("canon").agg(F.min(column).alias("only"), F.max(column).alias("_max"), F.countDistinct("doc_id").alias("docs"))
    return sides.filter("only = _max").drop("_max")


#: Entries that one of the two lists of `combination_gaps` may have.
MOST_COMBINED = 10_000


def combination_gaps(left: DataFrame, right: DataFrame, facts: DataFrame) -> DataFrame:
    """Pairs of two short lists (column canon each) of which no fact names either part. The
    parts that facts name are found by n-grams of the distinct entities; what is left of the second
    list, `MOST_COMBINED` entries at most, is put to each of the first."""
    entities = facts.select(F.lower("canon").alias("entity")).distinct()
    both = left.select(F.lower("canon").alias("needle")).union(right.select(F.lower("canon").alias("needle")))
    named = contain.containing(entities, both, "entity").select("needle").distinct()
    free = lambda rows: rows.withColumn("needle", F.lower("canon")).join(named, "needle", "left_anti").select("canon")
    names = [r.canon for r in free(right).limit(MOST_COMBINED + 1).collect()]
    if len(names) > MOST_COMBINED:
        raise ValueError(f"a list of more than {MOST_COMBINED} entries is not combined")
    return free(left).select(F.col("canon").alias("a"), F.explode(F.array(*[F.lit(x) for x in names]) if names else F.array().cast("array<string>")).alias("b"))


def two_sided(facts: DataFrame, documents: DataFrame, column: str, home: str, most_values: int = 4, limit: int = 15) -> DataFrame:
    """Per (canon, metric, unit) how many values either side gives; both sides needed."""
    rows = facts.join(documents.select("doc_id", column), "doc_id")
    value = F.struct("value_low", "value_high")
    out = rows.groupBy("canon", "metric", "unit_canon").agg(F.count_distinct(F.when(F.col(column) == home, value)).alias("home_values"), F.count_distinct(F.when(F.col(column) != home, value)).alias("other_values"))
    out = out.filter("home_values > 0 and other_values > 0")
    rest = F.greatest(F.lit(0), F.col("home_values") - most_values) + F.greatest(F.lit(0), F.col("other_values") - most_values)
    return out.withColumn("not_shown", rest).orderBy("canon", "metric", "unit_canon").limit(limit)


def review_groups(facts: DataFrame) -> DataFrame:
    """Per (canon, unit) its metrics, values and gaps."""
    return facts.groupBy("canon", "unit_canon").agg(
        F.countDistinct("metric").alias("metrics"),
        F.count_if(F.col("value_low").isNotNull() | F.col("value_high").isNotNull()).alias("values"),
        F.count_if(F.col("value_low").isNull() & F.col("value_high").isNull()).alias("no_value"),
        F.count_if(F.coalesce("quote", F.lit("")) == "").alias("no_quote"),
    )


def _first_of(rows: DataFrame, keys: list[str], value: Column, order: list[Column], most: int, name: str) -> DataFrame:
    """Per group its first different values and how many more there are: ranked before they are
    gathered, so that no group is gathered whole. Groups with null keys are groups."""
    distinct = rows.select(*keys, value.alias("value"), *[c.alias(f"_{i}") for i, c in enumerate(order)]).filter("value is not null").distinct()
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(f"_{i}").asc_nulls_first() for i in range(len(order))], "value"))
    kept = distinct.withColumn("nth", nth)
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("nth") <= most, F.struct("nth", "value")))), lambda x: x["value"])
    return kept.groupBy(*keys).agg(listed.alias(name), F.greatest(F.count("*") - most, F.lit(0)).alias(f"{name}_more"))


def value_of() -> Column:
    """A value or a range of values, whole numbers without a fraction."""
    low, high = lifecycle.number_key("value_low"), lifecycle.number_key("value_high")
    both = F.when(F.col("value_low") == F.col("value_high"), low).otherwise(F.concat(low, F.lit("–"), high))
    return F.nullif(F.when(F.col("value_low").isNull(), high).when(F.col("value_high").isNull(), low).otherwise(both), F.lit(""))


def two_sided_lists(facts: DataFrame, documents: DataFrame, column: str, home: str, most_values: int = 4, limit: int = 15) -> DataFrame:
    """Per (canon, metric, unit) the first values of either side and how many more; both needed."""
    rows = facts.join(documents.select("doc_id", F.col(column).alias("_side")), "doc_id")
    keys = ["canon", "metric", "unit_canon"]
    side = lambda wanted, name: _first_of(rows.filter(wanted), keys, value_of(), [F.col("value_low"), F.col("value_high")], most_values, name)
    here, there = side(F.col("_side") == home, "home"), side(F.col("_side") != home, "other")
    renamed = there.select(*[F.col(k).alias(f"_{k}") for k in keys], "other", "other_more")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return here.join(renamed, on).drop(*[f"_{k}" for k in keys]).orderBy(*keys).limit(limit)


def review_lists(facts: DataFrame, most: int = 4) -> DataFrame:
    """Per (canon, unit) its first metrics and values, and how many more there are of each."""
    keys = ["canon", "unit_canon"]
    metrics = _first_of(facts, keys, F.col("metric"), [F.col("metric")], most, "metrics")
    values = _first_of(facts, keys, value_of(), [F.col("value_low"), F.col("value_high")], most, "values")
    every = facts.select(*keys).distinct()
    for part in (metrics, values):
        named = part.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in part.columns if c not in keys])
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
        every = every.join(named, on, "left").drop(*[f"_{k}" for k in keys])
    return every


def card_facts(facts: DataFrame, most: int = 50) -> DataFrame:
    """The facts that a document's card shows: the `most` surest, of these good quotes first:
    (doc_id, nth, bad, and the columns of the facts)."""
    surest = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("confidence").desc_nulls_last(), "pkey"))
    rows = facts.withColumn("_nth", surest).filter(F.col("_nth") <= most).withColumn("bad", F.coalesce(text.degenerate(F.col("quote")), F.lit(False)))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("bad", "_nth"))
    return rows.withColumn("nth", nth).drop("_nth")


def sources_line(facts: DataFrame, cap: int = 3) -> DataFrame:
    """Per entity its first documents in order, and how many more there are."""
    docs = facts.select("canon", "doc_id").distinct()
    nth = F.row_number().over(Window.partitionBy("canon").orderBy("doc_id"))
    rows = docs.withColumn("nth", nth)
    return rows.groupBy("canon").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("nth") <= cap, F.col("doc_id")))).cast("array<string>"), ",").alias("first"), F.greatest(F.lit(0), F.count("*") - cap).alias("more"))


def document_card(documents: DataFrame, facts: DataFrame, most: int = 50) -> DataFrame:
    """Per document its facts, their mean confidence, and how many a card shows."""
    f = facts.groupBy("doc_id").agg(F.count("*").alias("facts"), F.round(F.avg("confidence"), 6).alias("confidence"))
    return documents.select("doc_id").join(f, "doc_id", "left").select("doc_id", F.coalesce("facts", F.lit(0)).alias("facts"), "confidence", F.least(F.coalesce("facts", F.lit(0)), F.lit(most)).alias("shown"))


def facets(documents: DataFrame, facts: DataFrame, most: int = 300) -> DataFrame:
    """(facet, value): years from the latest, places, entities."""
    years = documents.filter("year is not null").select(F.lit("year").alias("facet"), F.col("year").cast("string").alias("value")).distinct()
    geos = documents.filter("geo is not null").select(F.lit("geo").alias("facet"), F.col("geo").alias("value")).distinct()
    canons = facts.filter("canon is not null").select(F.lit("canon").alias("facet"), F.col("canon").alias("value")).distinct().orderBy("value").limit(most)
    return years.union(geos).union(canons)
