"""What readers see: units, values, places, labels and lines (X11-X13, X19-X20, X22-X23, H04), as
columns, so that a list of any length is written in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------

#: canonical unit -> as it is shown
UNITS_SHOWN = {
    "mg_L": "мг/л",
    "g_t": "г/т",
    "pct": "%",
    "degC": "°C",
    "A_m2": "А/м²",
    "m3_h": "м³/ч",
    "t_day": "т/сут",
    "pH": "pH",
    "mol_L": "моль/л",
    "geq_L": "г-экв/л",
}
#: parts of names of places at home and abroad
HOME_PLACES = ("талнах", "норильск", "надежд", "кольск", "мончегорск", "заполярн", "мурманск", "печенга", "россия", "росси", "гмк", "норникел")
FOREIGN_PLACES = ("china", "usa", "canada", "australia", "africa", "finland", "sweden", "germany", "japan", "india", "chile", "peru", "brazil", "europe", "китай", "финлянд", "канад", "австрал", "япони", "чили")
#: labels of nodes
LABELS = ("Material", "Process", "Equipment", "Property", "Experiment", "Publication", "Expert", "Facility", "Parameter", "Metric", "Phase", "Claim", "Domain", "Topic", "Standard", "Organization", "Author", "Document", "Article", "Condition")
NO_YEAR = "б.г."


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def unit_shown(unit: Column) -> Column:
    """The unit as readers know it; an unknown one as it is, none as nothing."""
    known = F.create_map(*[F.lit(x) for pair in UNITS_SHOWN.items() for x in pair])
    return F.coalesce(F.try_element_at(known, unit), unit, F.lit(""))


def place(lang: Column, sensitivity: Column, geo: Column, source: Column, category: Column) -> Column:
    """RU or WORLD by what the place or the source names; else the place given, if it is not the
    category; else by level and language; else null."""
    told = F.lower(F.concat_ws(" ", geo, source))
    names = lambda parts: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(told, p))
    own = F.trim(_text(geo))
    home = (F.lower(F.trim(_text(sensitivity))) == "internal") | (F.upper(F.trim(_text(lang))) == "RU")
    out = F.when(names(HOME_PLACES), "RU").when(names(FOREIGN_PLACES), "WORLD")
    return out.when((own != "") & (own != _text(category)), own).when(home, "RU").when(F.upper(F.trim(_text(lang))) == "EN", "WORLD")


def place_key(lang: Column, sensitivity: Column, geo: Column, source: Column, category: Column) -> Column:
    """X22 for filters: lower case, empty where there is none."""
    return F.lower(F.coalesce(place(lang, sensitivity, geo, source, category), F.lit("")))


def label(node_type: Column) -> Column:
    """The label of a node; what is no label is a material."""
    name = F.initcap(F.trim(_text(node_type)))
    return F.when(name.isin(*LABELS), name).otherwise("Material")


def endpoint(node_type: Column) -> Column:
    """(label, key field) of an edge's end: documents go by doc_id, all else by canon."""
    document = F.lower(F.trim(_text(node_type))).isin("document", "publication")
    return F.struct(F.when(document, "Document").otherwise(label(node_type)).alias("label"), F.when(document, "doc_id").otherwise("canon").alias("key"))


def fact_year(own: Column, document: Column) -> Column:
    """The fact's year, else its document's; null if it is no number."""
    return F.coalesce(F.nullif(own.cast("string"), F.lit("")), document.cast("string")).try_cast("int")


def number_shown(value: Column) -> Column:
    """Whole numbers without a fraction; nothing is rounded."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def value_shown(low: Column, high: Column) -> Column:
    """`12`, `12–15`, `≤300`, `≥5` or nothing; bounds in the order given."""
    both = F.when(low == high, number_shown(low)).otherwise(F.concat(number_shown(low), F.lit("–"), number_shown(high)))
    return F.when(low.isNotNull() & high.isNotNull(), both).when(high.isNotNull(), F.concat(F.lit("≤"), number_shown(high))).when(low.isNotNull(), F.concat(F.lit("≥"), number_shown(low))).otherwise("")


def year_shown(year: Column) -> Column:
    return F.coalesce(F.nullif(year.cast("string"), F.lit("")), F.lit(NO_YEAR))


def document_link(doc_id: Column, title: Column, year: Column) -> Column:
    """A Markdown link to a source."""
    own = _text(doc_id)
    name = F.coalesce(F.nullif(title, F.lit("")), F.nullif(own, F.lit("")), F.lit("источник"))
    shown = F.coalesce(F.concat(F.lit(" ("), F.nullif(year.cast("string"), F.lit("")), F.lit(")")), F.lit(""))
    return F.when(own == "", "источник").otherwise(F.concat(F.lit("[«"), name, F.lit("»"), shown, F.lit("](/sources?doc="), own, F.lit(")")))


def bullet(metric: Column, low: Column, high: Column, unit: Column, phase: Column, quote: Column, doc_id: Column, title: Column, year: Column, longest: int = 240) -> Column:
    """A fact as a line: metric, value, unit, phase, quote, source. The unit is left out where
    the metric is its name."""
    shown = unit_shown(unit)
    named = F.lower(F.trim(_text(metric))).isin(F.lower(F.trim(shown)), F.lower(F.trim(_text(unit))))
    parts = F.array(_text(metric), value_shown(low, high), F.when(named & (_text(metric) != ""), "").otherwise(shown))
    head = F.array_join(F.filter(parts, lambda x: x != ""), " ")
    head = F.trim(F.when(_text(phase) != "", F.concat(head, F.lit(" ["), phase, F.lit("]"))).otherwise(head))
    said = F.trim(_text(quote))
    said = F.when(F.length(said) > longest, F.concat(F.rtrim(F.substring(said, 1, longest - 3)), F.lit("…"))).otherwise(said)
    own = _text(doc_id)
    name = F.coalesce(F.nullif(title, F.lit("")), own)
    source = F.when(own == "", F.concat(F.lit("("), year_shown(year), F.lit(")"))).otherwise(F.concat(F.lit("[«"), name, F.lit("» ("), year_shown(year), F.lit(")](/sources?doc="), own, F.lit(")")))
    return F.concat(F.lit("- "), head, F.when(said != "", F.concat(F.lit(" — «"), said, F.lit("»"))).otherwise(""), F.lit(" — "), source)


def preview_line(doc_id: Column, title: Column, year: Column, preview: Column) -> Column:
    """A document of a list, with the beginning of its text."""
    own = _text(doc_id)
    name = F.coalesce(F.nullif(title, F.lit("")), F.nullif(own, F.lit("")), F.lit("—"))
    named = F.concat(F.lit("**"), name, F.lit("** ("), year_shown(year), F.lit(")"))
    named = F.when(own == "", named).otherwise(F.concat(F.lit("[**"), name, F.lit("** ("), year_shown(year), F.lit(")](/sources?doc="), own, F.lit(")")))
    said = F.trim(_text(preview))
    return F.concat(F.lit("- "), named, F.when(said != "", F.concat(F.lit(" — "), said)).otherwise(""))
