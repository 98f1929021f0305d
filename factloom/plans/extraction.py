"""From texts to facts, edges and the graph's tables (E11-E12, F35, H05-H06, K01-K08, S10, J17,
J21-J25, R01).

Python reads a sentence once: its values, mentions and verbs go side by side into its row. All that
follows (whom a value belongs to, which way an edge points) is decided on those arrays in the
JVM, row by row; only what holds for a whole document is grouped.
"""

from __future__ import annotations

from dataclasses import asdict

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import gazetteer, grammar, text
from factloom.operators import facts as ops
from factloom.operators import graphs, lifecycle
from factloom.schemas import MENTION, VALUE

# --- fixed values ---------------------------------------------------------------

#: stems of verbs and nouns that say that a process takes or gives a material
TAKES = ("выщелачива", "плавк", "плавл", "флотаци", "обраб", "раствор", "экстрак", "перераб", "загруж", "подаю", "подают", "подач")
GIVES = ("получа", "образу", "образо", "выход", "извлека", "производ", "выпуск", "выплавля")
#: what comes out of smelting and roasting, and is never taken in
OUTPUTS = ("штейн", "шлак", "файнштейн", "огарок", "кек", "возгон")
#: words before a value that make it no part of a composition
QUALIFIERS = ("до", "более", "менее", "на", "около", "порядка", "свыше")
QUALIFIER_STEMS = ("потер", "выход")
#: processes by domain, for documents that name none
PYRO = ("плавка", "взвешенная плавка", "конвертирование", "обжиг", "обеднение шлаков")
BENEFICIATION = ("флотация", "магнитная сепарация", "гравитационное обогащение", "измельчение", "флотоконцентрирование")
OTHER_DOMAIN = "гидрометаллургия"

#: metric -> types of entities that it is measured on; other metrics: any of ENTITIES
MEASURED_ON = {
    "температура": ("Process", "Equipment", "Phase"),
    "плотность тока": ("Process", "Equipment"),
    "расход": ("Process", "Equipment"),
    "производительность": ("Process", "Equipment", "Facility"),
    "pH": ("Phase", "Process"),
    "содержание": ("Material", "Phase"),
    "концентрация": ("Material", "Phase"),
    "извлечение": ("Material", "Process"),
    "остаток": ("Material", "Phase"),
}
ENTITIES = ("Material", "Process", "Equipment", "Phase")
#: what makes a temperature one of a material: it melts or boils
MELTING = ("плавлен", "кипен")
#: entities that a list of regimes hangs on, whatever stands between
CARRIERS = ("Process", "Equipment")
COMPOSITION = ("содержание", "концентрация")

VERB = T.StructType([T.StructField("span_start", T.IntegerType()), T.StructField("span_end", T.IntegerType()), T.StructField("type", T.StringType())])


def verbs_of(sentence: str) -> list[dict]:
    """Where a sentence says that something is taken or given."""
    out = []
    low = sentence.lower()
    for kind, stems in (("PRODUCES_OUTPUT", GIVES), ("USES_MATERIAL", TAKES)):
        for stem in stems:
            at = low.find(stem)
            while at >= 0:
                out.append({"span_start": at, "span_end": at + len(stem), "type": kind})
                at = low.find(stem, at + 1)
    return sorted(out, key=lambda v: (v["span_start"], v["type"]))


def reader(spark: SparkSession, entries: list[gazetteer.Entry]):
    """One pass of Python over sentences: a struct of values, mentions and verbs, in Arrow batches. The
    dictionary is built once and broadcast; it is a closed list of some thousand entries."""
    shared = spark.sparkContext.broadcast(gazetteer.Matcher(entries))
    kind = T.StructType([T.StructField("values", T.ArrayType(VALUE)), T.StructField("mentions", T.ArrayType(MENTION)), T.StructField("verbs", T.ArrayType(VERB))])

    @F.pandas_udf(kind)
    def read(sentence: pd.Series) -> pd.DataFrame:
        match = shared.value.match
        rows = [([asdict(v) for v in grammar.parse(t)], match(t), verbs_of(t or "")) for t in sentence]
        return pd.DataFrame(rows, columns=["values", "mentions", "verbs"])

    return read


def sentence_facts(documents: DataFrame, entries: list[gazetteer.Entry], guard: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sent_no, sent, values, mentions, verbs): sentences that hold a value or a mention.
    Noise is dropped before, in the JVM."""
    rows = text.sentence_rows(documents, id_col, text_col)
    if guard:
        rows = rows.filter(text.noise(F.col("sent")).isNull())
    read = rows.withColumn("read", reader(documents.sparkSession, entries)("sent")).select("doc_id", "sent_no", "sent", "read.values", "read.mentions", "read.verbs")
    return read.filter((F.size("values") > 0) | (F.size("mentions") > 0))


def _of(kind: str) -> Column:
    return F.filter("mentions", lambda m: m["type"] == kind)


def _canons(kind: str) -> Column:
    return F.array_distinct(F.transform(_of(kind), lambda m: m["canon"]))


def _gap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0), a["span_start"] - b["span_end"], b["span_start"] - a["span_end"])


def intruder(value: Column, sentence: Column) -> Column:
    """a value that is no part of a composition: a bound, one with a qualifier before it, or one
    of something (`5 % которого`)."""
    left = F.substring(sentence, 1, value["span_start"])
    word = F.lower(F.regexp_extract(left, r"(?U)([\p{L}]+)\s*$", 1))
    stem = F.exists(F.array(*map(F.lit, QUALIFIER_STEMS)), lambda x: F.startswith(word, x))
    right = F.substring(sentence, value["span_end"] + 1, F.lit(20))
    return (F.coalesce(value["comparator"], F.lit("=")) != "=") | word.isin(*QUALIFIERS) | stem | right.rlike(r"(?iU)^\s*(?:%[\p{L}.]*)?\s*котор")


def foreign_between(value: Column, mention: Column) -> Column:
    """Does another value stand between a value and a mention?"""
    lo, hi = F.least(value["span_end"], mention["span_end"]), F.greatest(value["span_start"], mention["span_start"])
    other = lambda g: (g["span_start"] != value["span_start"]) & (lo <= g["span_start"]) & (g["span_end"] <= hi)
    return F.exists("values", other)


def is_output(mention: Column) -> Column:
    """H06."""
    return F.translate(F.lower(mention["canon"]), "ё", "е").isin(*OUTPUTS)


def _is_composition(value: Column) -> Column:
    return F.coalesce(value["metric"].isin(*COMPOSITION), F.lit(False))


def _enumerated() -> Column:
    """In a list of compositions each value, from left to right, takes the nearest material that
    none has taken: an array of (at, canon), empty where there are not two of each."""
    values = F.filter("values", lambda v: _is_composition(v) & ~intruder(v, F.col("sent")))
    materials = _of("Material")
    nearest = lambda v, free: F.array_min(F.transform(free, lambda m: F.struct(_gap(v, m).alias("gap"), m["span_start"].alias("at"), m["canon"].alias("canon"))))
    start = F.struct(materials.alias("free"), F.array().cast("array<struct<at:int,canon:string>>").alias("taken"))

    def step(state: Column, v: Column) -> Column:
        best = nearest(v, state["free"])
        taken = F.when(F.size(state["free"]) > 0, F.array_append(state["taken"], F.struct(v["span_start"].alias("at"), best["canon"].alias("canon")))).otherwise(state["taken"])
        return F.struct(F.filter(state["free"], lambda m: m["span_start"] != F.coalesce(best["at"], F.lit(-1))).alias("free"), taken.alias("taken"))

    listed = (F.size(values) >= 2) & (F.size(materials) >= 2)
    return F.when(listed, F.aggregate(values, start, step, lambda state: state["taken"])).otherwise(F.array().cast("array<struct<at:int,canon:string>>"))


def facts_of(sentences: DataFrame) -> DataFrame:
    """A fact for each value. Its entity is the material that it takes in a list
    of compositions; else the material that the grammar read, if the metric is one of materials; else the nearest mention of a type that
    the metric is measured on, without another value between; else the nearest process or
    equipment, whatever is between. In such a list, values that are no part of a composition are
    left out. The mentions of a sentence are ranked in the row, so nothing is shuffled."""
    listed = sentences.withColumn("taken", _enumerated())
    rows = listed.select("doc_id", "sent_no", "sent", "values", "mentions", "taken", F.explode("values").alias("v"))
    value = F.col("v")
    rows = rows.filter(~((F.size("taken") > 0) & _is_composition(value) & intruder(value, F.col("sent"))))
    own = F.get(F.filter("taken", lambda t: t["at"] == F.col("v.span_start")), F.lit(0))["canon"]
    melts = (F.col("v.metric") == "температура") & F.col("sent").rlike(rf"(?iU)температур\w*\s+(?:{'|'.join(MELTING)})")

    def measured_on(kind: Column, others: Column) -> Column:
        """Is the value's metric measured on this type of entity? `others`: what holds for other metrics."""
        out = others
        for metric, types in MEASURED_ON.items():
            out = F.when(F.col("v.metric") == metric, kind.isin(*types)).otherwise(out)
        return out | F.coalesce(melts & (kind == "Material"), F.lit(False))

    fits = lambda m: measured_on(m["type"], m["type"].isin(*ENTITIES))
    usable = F.filter("mentions", lambda m: fits(m) & (~foreign_between(value, m) | m["type"].isin(*CARRIERS)))
    far = lambda m: F.when(foreign_between(value, m), 1).otherwise(0)
    ranked = F.array_min(F.transform(usable, lambda m: F.struct(far(m).alias("far"), _gap(m, value).alias("gap"), m["span_start"].alias("at"), m["canon"].alias("canon"), m["type"].alias("type"))))
    measured = F.transform("v.conditions", lambda c: F.concat_ws(" ", c["kind"], c["value"].cast("string"), c["unit_canon"]))
    conditions = F.array_join(F.array_distinct(F.concat(F.array_sort(measured), F.array_sort(_canons("Condition")))), ", ")
    # The last phase of the clause before the value is its phase, where the grammar read none
    clause = F.length(F.regexp_extract(F.substring(F.col("sent"), F.lit(1), F.col("v.span_start")), r"(?s)^(.*[,;:—(])", 1))
    before = F.filter("mentions", lambda m: (m["type"] == "Phase") & (m["span_end"] <= F.col("v.span_start")) & (m["span_start"] >= clause))
    phase = F.coalesce("v.phase", F.get(before, F.size(before) - 1)["canon"])
    material = F.coalesce(own, F.when(measured_on(F.lit("Material"), F.lit(True)), F.col("v.material")))
    out = rows.withColumns({"near": ranked, "material": material}).select(
        "doc_id",
        F.when(F.col("material").isNotNull(), "Material").otherwise(F.col("near.type")).alias("label"),
        F.coalesce("material", "near.canon").alias("canon"),
        F.col("v.metric").alias("metric"),
        F.col("v.unit_canon").alias("unit_canon"),
        F.col("v.value_low").alias("value_low"),
        F.col("v.value_high").alias("value_high"),
        F.col("v.comparator").alias("comparator"),
        F.col("v.confidence").alias("confidence"),
        F.nullif(conditions, F.lit("")).alias("conditions"),
        phase.alias("phase"),
        F.lit("grammar").alias("source"),
        text.quote_window(F.col("sent"), F.col("v.span_start"), F.col("v.span_end")).alias("quote"),
    )
    out = out.withColumn("phase", F.when(F.col("label") != "Phase", F.col("phase")))
    return out.filter("canon is not null")


def _edges(rows: DataFrame, src: str, src_label: str, dst: str, dst_label: str | Column, kind: str | Column, source: str = "pattern") -> DataFrame:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select(F.col(src).cast("string").alias("src"), F.lit(src_label).alias("src_label"), F.col(dst).alias("dst"), as_column(dst_label).alias("dst_label"), as_column(kind).alias("type"), "doc_id", F.lit(source).alias("source"))


def sentence_edges(sentences: DataFrame) -> DataFrame:
    """What a sentence says of its processes. A material belongs to the nearest process;
    the nearest verb says whether it is taken or given; a product of smelting is given if any verb
    says so, and never taken. Equipment and conditions belong to every process."""
    rows = sentences.filter(F.exists("mentions", lambda m: m["type"] == "Process"))
    processes = _of("Process")
    nearest = lambda m, others: F.array_min(F.transform(others, lambda o: F.struct(_gap(m, o).alias("gap"), o["span_start"].alias("at"), o.alias("o"))))["o"]
    gives = F.exists("verbs", lambda x: x["type"] == "PRODUCES_OUTPUT")
    materials = F.filter("mentions", lambda m: m["type"].isin("Material", "Phase"))
    made = F.transform(
        materials,
        lambda m: F.struct(
            nearest(m, processes)["canon"].alias("src"),
            m["canon"].alias("dst"),
            m["type"].alias("label"),
            F.when(is_output(m), F.when(gives, "PRODUCES_OUTPUT")).otherwise(nearest(m, F.col("verbs"))["type"]).alias("type"),
        ),
    )
    linked = rows.select("doc_id", F.explode(made).alias("m")).select("doc_id", "m.*").filter("type is not null")
    out = _edges(linked, "src", "Process", "dst", F.col("label"), F.col("type"))
    for kind in ("Equipment", "Condition"):
        pairs = rows.select("doc_id", F.explode(_canons("Process")).alias("p"), _canons(kind).alias("others")).select("doc_id", "p", F.explode("others").alias("o"))
        out = out.unionByName(_edges(pairs, "p", "Process", "o", kind, "OPERATES_AT_CONDITION"))
    return out


def document_domains(sentences: DataFrame) -> DataFrame:
    """(doc_id, domain): the domains that a document names, else those of its processes."""
    kinds = F.array_sort(F.array_distinct(F.flatten(F.collect_list("names"))))
    per = sentences.select("doc_id", _canons("Domain").alias("d"), _canons("Process").alias("p"))
    domain = lambda p: F.when(p.isin(*PYRO), "пирометаллургия").when(p.isin(*BENEFICIATION), "обогащение").otherwise(OTHER_DOMAIN)
    named = per.select("doc_id", F.col("d").alias("names")).groupBy("doc_id").agg(kinds.alias("named"))
    told = per.select("doc_id", F.transform("p", domain).alias("names")).groupBy("doc_id").agg(kinds.alias("told"))
    both = named.join(told, "doc_id")
    return both.select("doc_id", F.explode(F.when(F.size("named") > 0, F.col("named")).otherwise(F.col("told"))).alias("domain"))


def document_edges(documents: DataFrame, sentences: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """AUTHORED_BY, IN_DOMAIN (every author of a document with every domain of it) and SHOWED."""
    authors = documents.select(F.col(id_col).alias("doc_id"), F.explode(text.authors(F.col(text_col))).alias("author")).filter(~text.junk_author(F.col("author"))).distinct()
    claims = text.sentence_rows(documents, id_col, text_col).select("doc_id", text.claims(F.col("sent")).alias("claim")).filter("claim is not null").distinct()
    areas = authors.join(document_domains(sentences), "doc_id")
    out = _edges(authors, "doc_id", "Document", "author", "Author", "AUTHORED_BY", "regex")
    return out.unionByName(_edges(areas, "author", "Author", "domain", "Domain", "IN_DOMAIN", "regex")).unionByName(_edges(claims, "doc_id", "Document", "claim", "Claim", "SHOWED", "regex"))


def edges_of(sentences: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """All edges, each (src, dst, type, doc_id) once."""
    rows = sentence_edges(sentences)
    if documents is not None:
        rows = rows.unionByName(document_edges(documents, sentences))
    return graphs.merged_edges(rows)


def mention_nodes(sentences: DataFrame) -> DataFrame:
    """(doc_id, label, canon): facilities, conditions and domains that a document names."""
    found = F.explode(F.filter("mentions", lambda m: m["type"].isin("Facility", "Condition", "Domain"))).alias("m")
    named = sentences.select("doc_id", found).select("doc_id", F.col("m.type").alias("label"), F.col("m.canon").alias("canon"))
    areas = document_domains(sentences).select("doc_id", F.lit("Domain").alias("label"), F.col("domain").alias("canon"))
    return named.unionByName(areas).distinct()


def parameters(facts: DataFrame, extracted_at) -> DataFrame:
    """Bounds in order, implausible facts out, an identity for each, the last of equals kept."""
    rows = lifecycle.swapped(facts).filter(ops.plausible("load")).withColumn("pkey", lifecycle.pkey()).withColumn("extracted_at", extracted_at)
    return lifecycle.keep_last(rows, ["pkey"], ["extracted_at", "confidence", "quote"])


def document_rows(files: DataFrame) -> DataFrame:
    """What is known of a file from its text and name (columns path, text)."""
    body, name = F.col("text"), text.base_name(F.col("path"))
    lang = F.when(text.cyrillic_share(body) >= 0.5, "ru").when(text.cyrillic_share(body).isNotNull(), "en")
    return files.select(
        lifecycle.normalised_text_key(body).alias("doc_id"), name.alias("name"), F.coalesce(text.year_of_name(name), F.lit(None).cast("int")).alias("year"), lang.alias("lang"), text.doc_type(body, name).alias("doc_type"), text.patent_meta(body).alias("patent_meta"), body.alias("text")
    )
