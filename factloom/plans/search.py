"""Hybrid search and what is made of it.

The query is read on the driver; numeric, entity, semantic and keyword tracks are separate lazy
plans; filters and access are applied to each track before its top-k, which differs from
filtering a finished list only in returning more of what was asked for. One collect at the end.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import display, grammar
from factloom.operators import coverage, graphs, relations, retrieval
from factloom.operators import facts as ops

_LAST_YEARS = re.compile(r"(?:за|for|over)?\s*(?:последн\w+|the last|last)\s+(\d{1,2})\s+(?:лет|год\w*|years?)", re.I)
_SINCE = re.compile(r"(?:\bс|\bsince|\bfrom)\s+((?:19|20)\d\d)", re.I)
_EXPERT = re.compile(r"кто\b|эксперт|специалист|автор|who\b|expert|author", re.I)
#: words of a query -> a ready question to the graph, asked besides the tracks (fixed values)
DESALINATION = ("обессоливан", "сульфат", "desalinat", "sulfate", "sulphate")
CATHOLYTE = ("католит", "электроэкстракц", "catholyte", "electrowinning", "electro-winning")
SPREAD, SPREAD_PHASES = ("распределени", "distribution"), ("штейн", "шлак", "matte", "slag")
KINDS_SHOWN = {"Process": "процесс", "Material": "материал", "Equipment": "оборудование", "Facility": "объект", "Phase": "фаза", "Parameter": "параметр", "Document": "документ", "Publication": "публикация"}
_LIST = re.compile(r"список|перечисл|какие|list|which", re.I)


def since_year(query: str, now: int) -> int | None:
    """a lower bound on years in words."""
    if m := _LAST_YEARS.search(query):
        return now - int(m[1])
    return int(m[1]) if (m := _SINCE.search(query)) else None


def intent_of(query: str, numbers: int) -> str:
    """numeric before expert before listing before search."""
    return "numeric" if numbers else "expert" if _EXPERT.search(query) else "listing" if _LIST.search(query) else "search"


@dataclass
class Corpus:
    """The tables a search reads. `semantic` gives (doc_id, score) for a query, if there is one;
    `shortcuts` gives, by name, a function of the query's numbers to facts of a ready question."""

    documents: DataFrame
    parameters: DataFrame
    authors: DataFrame | None = None
    index: DataFrame | None = None
    semantic: object | None = None
    edges: DataFrame | None = None
    shortcuts: dict | None = None


@dataclass
class Result:
    query: str
    intent: str
    filters: ops.Filters | None
    facts: list[dict] = field(default_factory=list)
    docs: list[dict] = field(default_factory=list)
    experts: list[dict] = field(default_factory=list)
    hidden_count: int = 0
    grounded: bool = False


def fact_track(corpus: Corpus, query: str, role: str, nf: ops.Filters | None, entities: list[str], limit: int = 50) -> DataFrame | None:
    """The numeric track for each number asked for, else the entity track, within the role's view."""
    seen = ops.visible(corpus.documents, role)
    base = corpus.parameters.join(seen.select("doc_id", "year", "geo"), "doc_id")
    if "deleted" in base.columns:
        base = base.filter(~F.coalesce("deleted", F.lit(False)))
    if nf:
        base = base.filter(ops.fact_matches(nf))
    numbers = grammar.parse(query)
    tracks = []
    for v in numbers:
        wanted = ops.Wanted(v.unit_canon, None, v.value_low, v.value_high, v.material)
        rows = base.withColumns({"in_range": ops.overlaps(v.value_low, v.value_high), "dist": ops.distance(wanted.point())}).filter(F.col("unit_canon") == v.unit_canon)
        if v.material:
            rows = rows.filter(F.contains(F.lower("canon"), F.lit(v.material.lower())))
        tracks.append(rows.orderBy(F.col("in_range").desc(), F.col("dist").asc_nulls_last(), "doc_id", "pkey").limit(limit))
    if not tracks and entities:
        rows = base.filter(F.lower("canon").isin([e.lower() for e in entities]))
        tracks.append(rows.withColumns({"in_range": F.lit(False), "dist": F.lit(None).cast("double")}).orderBy(F.col("confidence").desc_nulls_last(), "doc_id", "pkey").limit(10))
    out = None
    for t in tracks:
        out = t if out is None else out.unionByName(t)
    return out


def shortcut_names(query: str) -> list[str]:
    """Q06: the ready questions that a query's words call for."""
    low = query.lower()
    out = []
    if any(w in low for w in DESALINATION):
        out.append("desalination")
    if any(w in low for w in CATHOLYTE):
        out.append("catholyte")
    if any(w in low for w in SPREAD) and any(w in low for w in SPREAD_PHASES):
        out.append("pgm")
    return out


def sulfate_limit(numbers: list, default: float = 300.0) -> float:
    """Q06: the first upper bound in mg/L that a query names."""
    return next((v.value_high for v in numbers if v.unit_canon == "mg_L" and v.value_high is not None), default)


#: What the ready questions look for in entities, phases and metrics (fixed values).
SALTS, FLOW, CURRENT = ("сульфат", "хлорид"), ("скорост",), ("плотност", "ток", "скорост")
NOBLE, MELTS = ("au", "ag", "золот", "серебр", "мпг", "платин"), ("штейн", "шлак")
CONTENTS, CONTENT_UNITS = ("содержан", "концентрац", "распределен"), ("pct", "g_t")


def _holds(column: str, words: tuple[str, ...]) -> Column:
    low, out = F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(False)
    for word in words:
        out = out | F.contains(low, F.lit(word))
    return out


def ready_questions(corpus: Corpus, now: int, years: int = 5) -> dict:
    """The ready questions over a corpus: functions of the query's numbers to facts.

    desalination: salts in mg/L up to the limit asked for. catholyte: densities and speeds measured in
    the catholyte, and ten speeds without a phase of documents that measure in it. pgm: noble metals
    in matte and slag, of the last years or of documents without a year."""
    p = corpus.parameters
    bound = F.coalesce("value_high", "value_low")

    def desalination(numbers: list) -> DataFrame:
        return p.filter(_holds("canon", SALTS) & (F.col("unit_canon") == "mg_L") & (bound <= sulfate_limit(numbers)))

    def catholyte(numbers: list) -> DataFrame:
        bath = _holds("phase", ("католит",))
        direct = p.filter(bath & _holds("metric", CURRENT))
        same = p.filter(bath).select(F.col("doc_id").alias("_bath")).distinct()
        speeds = p.filter(F.col("phase").isNull() & _holds("metric", FLOW) & F.coalesce("value_low", "value_high").isNotNull())
        near = speeds.join(same, F.col("doc_id") == F.col("_bath"), "left_semi").orderBy(F.coalesce("value_low", "value_high"), "doc_id", "pkey").limit(10)
        return direct.unionByName(near.withColumn("phase", F.lit("католит (эксперимент)")).select(direct.columns))

    def pgm(numbers: list) -> DataFrame:
        recent = corpus.documents.filter(F.col("year").isNull() | (F.col("year") >= now - years)).select(F.col("doc_id").alias("_recent"))
        rows = p.filter(_holds("canon", NOBLE) & _holds("phase", MELTS) & (F.coalesce(F.col("unit_canon").isin(*CONTENT_UNITS), F.lit(False)) | _holds("metric", CONTENTS)))
        return rows.join(recent, F.col("doc_id") == F.col("_recent"), "left_semi")

    return {"desalination": desalination, "catholyte": catholyte, "pgm": pgm}


def shortcut_facts(corpus: Corpus, query: str, seen: DataFrame, nf: ops.Filters | None, now: int = 2024) -> DataFrame | None:
    """Q06: facts of the ready questions, within the role's view and the filters, marked `ref`. Those
    of `corpus.shortcuts` if it has any, else those of `ready_questions`."""
    numbers, out = grammar.parse(query), None
    known = corpus.shortcuts if corpus.shortcuts is not None else ready_questions(corpus, now)
    for name in shortcut_names(query):
        make = known.get(name)
        if make is None:
            continue
        rows = make(numbers).drop("year", "geo").join(seen.select("doc_id", "year", "geo"), "doc_id").withColumn("ref", F.lit(True))
        if nf:
            rows = rows.filter(ops.fact_matches(nf))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def expert_track(corpus: Corpus, numeric: list, semantic: list, most: int = 15, limit: int = 25) -> list[dict]:
    """Authors of the documents that numbers led to; if those have none, of all found."""
    if corpus.authors is None:
        return []
    kind = corpus.documents.schema["doc_id"].dataType.simpleString()
    for ids in (numeric, numeric + semantic):
        if not ids:
            continue
        scope = corpus.documents.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], f"doc_id {kind}")
        found = coverage.topic_experts(corpus.authors, scope, most, limit).select("author", "docs").collect()
        if found:
            return [r.asDict() for r in found]
    return []


def adjacent_topics(corpus: Corpus, entities: list[str], limit: int = 12) -> list[dict]:
    """Neighbours of the query's entities in the graph."""
    if corpus.edges is None or not entities:
        return []
    start = corpus.edges.sparkSession.createDataFrame([(e,) for e in entities], "node string")
    return [{"canon": r.node} for r in graphs.adjacent(corpus.edges, start, F.lit(True), limit).collect()]


def recommendations(corpus: Corpus, result: Result, entities: list[str], most: int = 8) -> dict:
    """Q04: documents that only likeness found, neighbouring topics, and experts."""
    similar = [d for d in result.docs if d["source"] == "semantic"][:most]
    numeric = [f["doc_id"] for f in result.facts] + [d["doc_id"] for d in result.docs if d["source"] != "semantic"]
    return {"similar_cases": similar, "adjacent_topics": adjacent_topics(corpus, entities), "experts": expert_track(corpus, numeric, [d["doc_id"] for d in similar])}


def recommendations_text(rec: dict) -> str:
    """Q04 as Markdown; nothing to recommend is nothing."""
    lines: list[str] = []
    if rec["similar_cases"]:
        lines += ["**Похожие документы:**", "", *[f"- [«{c.get('name') or c['doc_id']}» ({c.get('year') or display.NO_YEAR})](/sources?doc={c['doc_id']})" for c in rec["similar_cases"][:8]], ""]
    if rec["adjacent_topics"]:
        lines += ["**Смежные темы:**", "", ", ".join(f"{t['canon']} ({KINDS_SHOWN.get(t.get('type'), 'тема')})" for t in rec["adjacent_topics"][:12]), ""]
    if rec["experts"]:
        lines += ["**Эксперты по теме**:", "", *[f"- {e['author']} — публикаций: {e['docs']}" for e in rec["experts"][:8]], ""]
    return "\n".join(["### Рекомендации", "", *lines]) if lines else ""


def composed(corpus: Corpus, result: Result, previews: DataFrame | None = None, most: int = 15) -> str:
    """Q07: the answer in Markdown: its documents, at most `most`, and the counts. Facts and experts
    are lists of their own."""
    lines = [f"## Результаты поиска: {result.query}", ""]
    if not result.facts:
        lines += ["_Числовых фактов по запросу не найдено._", ""]
    shown = [d["doc_id"] for d in result.docs[:most]]
    if shown:
        rows = corpus.documents.filter(F.col("doc_id").isin(shown)).select("doc_id", F.col("name") if "name" in corpus.documents.columns else F.lit(None).cast("string").alias("name"), "year")
        rows = rows.join(previews.select("doc_id", "preview"), "doc_id", "left") if previews is not None else rows.withColumn("preview", F.lit(None).cast("string"))
        line = dict(rows.select("doc_id", display.preview_line(F.col("doc_id"), F.col("name"), F.col("year"), F.col("preview")).alias("line")).collect())
        lines += ["### Релевантные документы", "", *[line.get(i, f"- {i}") for i in shown], ""]
    lines.append(f"Документов в выдаче: {len(result.docs)}.")
    if result.hidden_count:
        lines.append(f"Скрыто по правам доступа: {result.hidden_count}.")
    return "\n".join(lines)


def search(corpus: Corpus, query: str, role: str = "researcher", filters: dict | None = None, entities: list[str] | None = None, now: int = 2024, most_facts: int = 40, most_docs: int = 24) -> Result:
    """Q01."""
    numbers = grammar.parse(query)
    nf = ops.normalised(filters, since_year(query, now))
    result = Result(query, intent_of(query, len(numbers)), nf)
    seen = ops.visible(corpus.documents, role)
    track = fact_track(corpus, query, role, nf, entities or [])
    asked = shortcut_facts(corpus, query, ops.visible(corpus.documents, ops.HIGHEST_ROLE), nf, now)
    ready = None if asked is None else asked.join(seen.select("doc_id"), "doc_id", "left_semi")
    semantic = corpus.semantic(query) if corpus.semantic else None
    target = ops.Wanted(None, None, numbers[0].value_low, numbers[0].value_high).point() if numbers else None
    if track is not None:
        track = track.withColumn("ref", F.lit(False))
    if ready is not None:
        ready = ready.withColumns({"in_range": F.lit(False), "dist": F.lit(None).cast("double")})
        track = ready if track is None else track.unionByName(ready, allowMissingColumns=True)
    if track is not None:
        rows = track.withColumn("bad_quote", F.lit(0)).filter(ops.plausible("display"))
        order = [*ops.rank_key(target), F.col("doc_id"), F.col("pkey")]
        result.facts = [r.asDict() for r in ops.deduplicated(rows, order).orderBy(*order).limit(most_facts).collect()]
    hits: list[dict] = [{"doc_id": d, "source": "numeric", "score": None} for d in dict.fromkeys(f["doc_id"] for f in result.facts)]
    if semantic is not None:
        near = semantic.join(seen.select("doc_id", "year", "geo"), "doc_id")
        if nf:
            near = near.filter(ops.document_matches(nf))
        found = near.filter(F.col("score") >= 0.35).orderBy(F.col("score").desc(), "doc_id").limit(most_docs).collect()
        if ops.out_of_domain(max([r.score for r in found], default=0.0), len(numbers), len(entities or []), len(result.facts)):
            return result
        known = {h["doc_id"] for h in hits}
        hits += [{"doc_id": r.doc_id, "source": "semantic", "score": r.score} for r in found if r.doc_id not in known]
    if len(hits) < 3 and corpus.index is not None:
        terms = [w.lower() for w in re.findall(retrieval.TOKEN, query.lower())]
        n = corpus.documents.agg(F.count("*").alias("n"))
        known = {h["doc_id"] for h in hits}
        rows = retrieval.keyword_search(corpus.index.join(seen.select("doc_id"), "doc_id", "left_semi"), n, terms)
        hits += [{"doc_id": r.doc_id, "source": "keyword", "score": r.score} for r in rows.collect() if r.doc_id not in known]
    result.docs = hits[:most_docs]
    result.hidden_count = hidden_hits(corpus, query, role, nf, entities or [], semantic, asked)
    if result.intent == "expert":
        result.experts = expert_track(corpus, [h["doc_id"] for h in hits if h["source"] != "semantic"], [h["doc_id"] for h in hits if h["source"] == "semantic"])
    return result


def hidden_hits(corpus: Corpus, query: str, role: str, nf: ops.Filters | None, entities: list[str], semantic: DataFrame | None, ready: DataFrame | None, most: int = 50) -> int:
    """how many documents the same search would show to a role that sees all, but not to this one:
    of the documents in its tracks (50 facts a number, the ready questions, 50 like it, 8 by words),
    those above the role's levels."""
    found = fact_track(corpus, query, ops.HIGHEST_ROLE, nf, entities, most)
    ids = None if found is None else found.select("doc_id")
    if ready is not None:
        ids = ready.select("doc_id") if ids is None else ids.unionByName(ready.select("doc_id"))
    if corpus.index is not None and ids is None and semantic is None:
        words = retrieval.keyword_search(corpus.index, corpus.documents.agg(F.count("*").alias("n")), [w.lower() for w in re.findall(retrieval.TOKEN, query.lower())])
        ids = words.select("doc_id")
    if semantic is not None:
        near = semantic.filter(F.col("score") >= 0.35).orderBy(F.col("score").desc(), "doc_id").limit(most).select("doc_id")
        ids = near if ids is None else ids.unionByName(near)
    if ids is None:
        return 0
    rows = corpus.documents.join(ids.distinct(), "doc_id", "left_semi")
    return ops.hidden_count(rows, role).first()[0]


def _sources(rows: list[dict], cap: int = 3) -> str:
    docs = list(dict.fromkeys(r["doc_id"] for r in rows))
    more = f" +{len(docs) - cap}" if len(docs) > cap else ""
    return f" [{', '.join(map(str, docs[:cap]))}{more}]" if docs else ""


def _group_line(r: dict) -> str:
    """What a group of relations says, in one line."""
    show = lambda xs: "/".join(f"{x:.6g}" for x in xs)
    head = " · ".join(x for x in (r["entity"], r["metric"]) if x) + (f" [{r['phase']}]" if r["phase"] else "")
    values = f"≈{show(r['left_values'])}" if r["same"] else f"{show(r['left_values'])} vs {show(r['right_values'])}"
    sure = f", confidence {r['mean_confidence']:.2f}" if r["mean_confidence"] is not None else ""
    more = f" +{r['more']}" if r["more"] else ""
    return f"- **{head}** ({values} {r['unit'] or ''}".rstrip() + f") — sources: {r['n_docs']}{sure}; {'/'.join(r['kinds'])}; years: {', '.join(r['years']) or display.NO_YEAR}; places: {', '.join(r['places']) or '—'}; [{', '.join(map(str, r['first_docs']))}{more}]"


def review(corpus: Corpus, query: str, role: str = "researcher", filters: dict | None = None, entities: list[str] | None = None, now: int = 2024) -> str:
    """Q02: methods, regimes, agreement, disagreement and gaps, as Markdown. Methods and regimes are
    those of the facts that the search shows, by entity and unit; agreement and disagreement are all
    groups of relations between the documents found."""
    result = search(corpus, query, role, filters, entities, now)
    groups: dict[tuple[str, str], list[dict]] = {}
    for f in result.facts:
        groups.setdefault((f.get("canon") or "—", f.get("unit_canon") or "—"), []).append(f)
    ordered = sorted(groups.items())
    lines = [f"# {query}", "", "## Methods"]
    lines += [f"- {canon}: {metric} ({unit}){_sources(rows)}" for (canon, unit), rows in ordered for metric in sorted({f.get("metric") or "—" for f in rows})] or ["- none"]
    valued = {key: [f for f in rows if f.get("value_low") is not None or f.get("value_high") is not None] for key, rows in ordered}
    lines += ["", "## Regimes"]
    lines += [f"- {canon}, {', '.join(sorted({f.get('metric') or '—' for f in rows}))}: {', '.join(dict.fromkeys(value_text(f) for f in rows))}{_sources(rows)}" for (canon, _), rows in valued.items() if rows] or ["- none"]
    ids = [d["doc_id"] for d in result.docs]
    if ids:
        scope = corpus.parameters.filter(F.col("doc_id").isin(ids))
        lists = relations.group_lists(relations.pairs(scope), corpus.documents, relations.mean_confidence(scope))
        found = [r.asDict() for r in lists.orderBy(F.col("n_docs").desc(), "entity", "metric", "phase", "unit").collect()]
        for title, rel in (("Agreement", "VALIDATED_BY"), ("Disagreement", "CONTRADICTS")):
            lines += ["", f"## {title}"] + ([_group_line(r) for r in found if r["rel"] == rel] or ["- none"])
    gaps = [f"- {canon} ({unit}): no values" if not valued[canon, unit] else f"- {canon} ({unit}): no quote" for (canon, unit), rows in ordered if not valued[canon, unit] or not any((f.get("quote") or "").strip() for f in rows)]
    lines += ["", "## Gaps"] + (gaps or ["- none"])
    return "\n".join(lines)


def recommend(corpus: Corpus, query: str, role: str = "researcher", filters: dict | None = None, entities: list[str] | None = None, now: int = 2024, most: int = 28) -> dict:
    """Without a model the answer is the list of its grounds, and says so."""
    result = search(corpus, query, role, filters, entities, now)
    grounds = [f"[{i}] {f['canon']} {value_text(f)}" for i, f in enumerate(result.facts[:most], 1)]
    rec = recommendations(corpus, result, entities or [])
    text = "\n".join(grounds + ([recommendations_text(rec)] if any(rec.values()) else []))
    return {"answer_md": text, "grounded": False, "recommendations": rec, "legend": {i: f["doc_id"] for i, f in enumerate(result.facts[:most], 1)}}


def valid_relations(found: list[dict], canons: set[str], text: str) -> list[dict]:
    """Of proposed relations those between known names whose quote stands in the text."""
    plain = " ".join(text.lower().split())
    return [r for r in found if r.get("src") in canons and r.get("dst") in canons and r.get("src") != r.get("dst") and r.get("quote") and " ".join(r["quote"].lower().split()) in plain]


def value_text(fact: dict) -> str:
    """A value for reading; bounds in order."""
    low, high, unit = fact.get("value_low"), fact.get("value_high"), fact.get("unit_canon") or ""
    if low is not None and high is not None and low > high:
        low, high = high, low
    show = lambda x: f"{x:.6g}"
    if low is None and high is None:
        return ""
    if low is None or high is None:
        return f"{fact.get('comparator') or ''} {show(low if low is not None else high)} {unit}".strip()
    return (show(low) if low == high else f"{show(low)}-{show(high)}") + f" {unit}".rstrip()
