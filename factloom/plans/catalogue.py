"""Relational queries of the reference's operators: name -> (query, oracle in DuckDB SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import coverage, facts, graphs, lifecycle, relations, retrieval, spans
from factloom.plans import adapters as ad

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Queries of rows that stand in their code, or of a slice of a table that another query reads whole:
#: name -> (query, oracle). Tests run them; they are not registered.
FIXTURES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}
HOME = "EUROPE"


def query(sql: str | None = None, *more: str, plain: bool = False, fixture: bool = False):
    """Registers a query under its function's name, with its oracle."""

    def keep(f):
        if fixture:
            FIXTURES[f.__name__] = f, sql.strip() if plain else ad.with_views(sql, *more)
            return f
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.strip() if plain else ad.with_views(sql, *more)
        return f

    return keep


def _doc(s: SparkSession, d: str) -> DataFrame:
    return ad.document(s, d)


def _par(s: SparkSession, d: str) -> DataFrame:
    return ad.parameter(s, d)


OVERLAP = "coalesce(value_low,value_high) <= 6 AND coalesce(value_high,value_low) >= 4"
MID = "(coalesce(value_low,value_high)+coalesce(value_high,value_low))/2"


@query(f"""SELECT t.pkey, t.doc_id, t.canon, t.value_low, t.value_high, t.in_range, t.dist, d.year, d.geo FROM (
  SELECT *, ({OVERLAP}) AS in_range, abs({MID}-5.0) AS dist FROM parameter WHERE unit_canon='O' AND contains(lower(canon),'brand#1')
  ORDER BY in_range DESC, dist ASC NULLS LAST, doc_id, pkey, author LIMIT 50) t LEFT JOIN document d USING (doc_id)""")
def numeric_range_track(s, d):
    """J01 F02 F03 T01"""
    wanted = facts.Wanted(unit_canon="O", value_low=4.0, value_high=6.0, material="Brand#1")
    return facts.numeric_track(_par(s, d), _doc(s, d), wanted, 50, ("doc_id", "pkey", "author")).select("pkey", "doc_id", "canon", "value_low", "value_high", "in_range", "dist", "year", "geo")


@query("""SELECT p.doc_id, p.pkey, p.canon, coalesce(p.value_high,p.value_low) AS bound, d.year FROM parameter p LEFT JOIN document d USING (doc_id)
  WHERE p.unit_canon='F' AND contains(p.canon,'Brand#7') AND coalesce(p.value_high,p.value_low) <= 3""")
def limit_by_entity(s, d):
    """Facts within a limit, with their document, in order of the bound"""
    bound = F.coalesce("value_high", "value_low")
    rows = _par(s, d).filter((F.col("unit_canon") == "F") & F.contains(F.col("canon"), F.lit("Brand#7")) & (bound <= 3))
    return rows.join(_doc(s, d).select("doc_id", "year"), "doc_id", "left").select("doc_id", "pkey", "canon", bound.alias("bound"), "year").orderBy("bound", "doc_id", "pkey")


@query("""SELECT p.doc_id, p.pkey, p.phase, d.year, CASE WHEN p.label='PROMO' THEN p.canon END AS entity
  FROM parameter p JOIN document d USING (doc_id) WHERE p.phase='liquid' AND p.metric='R'""")
def conditional_left_join(s, d):
    """The entity is optional, and its condition belongs to the join"""
    p = _par(s, d).filter((F.col("phase") == "liquid") & (F.col("metric") == "R"))
    entities = p.select(F.col("canon").alias("entity"), F.col("label").alias("entity_label")).distinct()
    on = (F.col("canon") == F.col("entity")) & (F.col("label") == F.col("entity_label")) & (F.col("entity_label") == "PROMO")
    joined = p.join(_doc(s, d).select("doc_id", "year"), "doc_id").join(entities, on, "left")
    return joined.select("doc_id", "pkey", "phase", "year", "entity")


@query("""SELECT doc_id, pkey, canon FROM (SELECT DISTINCT doc_id, pkey, canon FROM parameter p WHERE metric='A' AND phase IS NULL
    AND EXISTS (SELECT 1 FROM parameter q WHERE q.doc_id=p.doc_id AND q.phase='liquid') AND NOT EXISTS (SELECT 1 FROM parameter q WHERE q.doc_id=p.doc_id AND q.phase='solid')
    ORDER BY doc_id, pkey LIMIT 10)
  UNION ALL SELECT DISTINCT doc_id, pkey, canon FROM parameter WHERE phase='solid' AND canon='Brand#3' AND metric='N'""")
def semi_anti_union(s, d):
    """J05 U04 G05"""
    p = _par(s, d)
    docs = lambda phase: p.filter(F.col("phase") == phase).select("doc_id")
    bare = p.filter("metric = 'A' and phase is null").join(docs("liquid"), "doc_id", "left_semi").join(docs("solid"), "doc_id", "left_anti")
    first = bare.select("doc_id", "pkey", "canon").distinct().orderBy("doc_id", "pkey").limit(10)
    return first.unionAll(p.filter("phase = 'solid' and canon = 'Brand#3' and metric = 'N'").select("doc_id", "pkey", "canon").distinct())


@query("""SELECT p.doc_id, p.pkey, d.year FROM parameter p JOIN document d USING (doc_id) WHERE p.canon='Brand#5' AND p.metric='R' AND
  ((CASE WHEN d.year>=1996 THEN d.year END) IS NULL OR d.year>=1999)""")
def recent_by_year_nullsafe(s, d):
    """Recent, or of unknown year; unknown years first"""
    year = F.when(F.col("year") >= 1996, F.col("year"))
    docs = _doc(s, d).filter(year.isNull() | (year >= 1999)).select("doc_id", "year")
    return _par(s, d).filter("canon = 'Brand#5' and metric = 'R'").join(docs, "doc_id").select("doc_id", "pkey", "year").orderBy(F.col("year").desc_nulls_first(), "doc_id")


@query("""SELECT doc_id, pkey, canon, confidence FROM parameter WHERE canon IN (SELECT DISTINCT p_brand FROM part WHERE p_size=50 AND p_type='ECONOMY')
  ORDER BY confidence DESC NULLS LAST, doc_id, pkey LIMIT 10""")
def entity_topk_confidence(s, d):
    """J02 T03"""
    canons = ad.table(s, d, "part").filter("p_size = 50 and p_type = 'ECONOMY'").select(F.col("p_brand").alias("canon")).distinct()
    return facts.entity_track(_par(s, d), canons).select("doc_id", "pkey", "canon", "confidence")


FIVE = {"year": (1996, 1999), "geo": ["asia", "europe"], "material": "brand#2", "process": ["widget", "q3"], "min_confidence": 0.95}


@query("""SELECT p.doc_id, p.pkey, p.canon, p.confidence FROM parameter p LEFT JOIN document d USING (doc_id)
  WHERE d.year BETWEEN 1996 AND 1999 AND (contains(lower(d.geo),'asia') OR contains(lower(d.geo),'europe')) AND p.confidence>=0.95 AND contains(lower(p.canon),'brand#2')
  AND (contains(lower(concat_ws(' ',p.canon,p.quote,p.conditions,p.metric)),'widget') OR contains(lower(concat_ws(' ',p.canon,p.quote,p.conditions,p.metric)),'q3'))""")
def five_dim_filter(s, d):
    """F04 F07 J15"""
    _, kept = facts.apply_filters(_doc(s, d), _par(s, d), facts.normalised(FIVE))
    return kept.select("doc_id", "pkey", "canon", "confidence")


@query("""SELECT d.doc_id, d.year, d.geo FROM document d WHERE d.year BETWEEN 1996 AND 1999 AND (contains(lower(d.geo),'asia') OR contains(lower(d.geo),'europe')) AND EXISTS (
  SELECT 1 FROM parameter p WHERE p.doc_id=d.doc_id AND p.confidence>=0.95 AND contains(lower(p.canon),'brand#2')
  AND (contains(lower(concat_ws(' ',p.canon,p.quote,p.conditions,p.metric)),'widget') OR contains(lower(concat_ws(' ',p.canon,p.quote,p.conditions,p.metric)),'q3')))""")
def filtered_documents(s, d):
    """F05 F06"""
    docs, _ = facts.apply_filters(_doc(s, d), _par(s, d), facts.normalised(FIVE))
    return docs.select("doc_id", "year", "geo")


@query("SELECT doc_id, sensitivity FROM document WHERE sensitivity IN ('public','internal')")
def rbac_visible(s, d):
    """F10"""
    return facts.visible(_doc(s, d), "researcher").select("doc_id", "sensitivity")


@query("SELECT count(*) FILTER (sensitivity<>'public') AS hidden_count FROM document")
def rbac_hidden_count(s, d):
    """F09"""
    return facts.hidden_count(_doc(s, d), "external_partner")


@query("""SELECT doc_id, CASE WHEN nn IS NOT NULL THEN 'numeric' ELSE 'semantic' END AS source, CASE WHEN nn IS NULL THEN score END AS score FROM
  (SELECT coalesce(a.doc_id,b.doc_id) AS doc_id, a.doc_id AS nn, b.score FROM (SELECT DISTINCT doc_id FROM parameter WHERE canon='Brand#4' AND metric='N') a
   FULL JOIN (SELECT DISTINCT doc_id, round(kg_value/10.0,1)::DOUBLE AS score FROM document WHERE kg_value/10.0>=0.35 AND geo='ASIA') b ON a.doc_id=b.doc_id)""")
def merge_first_wins(s, d):
    """J30 W07 F26"""
    num = _par(s, d).filter("canon = 'Brand#4' and metric = 'N'").select("doc_id", F.lit(False).alias("ref"), facts.overlaps(4.0, 6.0).alias("in_range"), F.col("pkey").alias("pos"))
    sem = _doc(s, d).filter("geo = 'ASIA'").select("doc_id", F.round(F.col("kg_value") / 10, 1).alias("score"), F.col("doc_id").cast("string").alias("pos"))
    return facts.merged(num, sem).select("doc_id", "source", "score")


@query("""SELECT doc_id, metric, value_low, value_high, unit_canon, phase, quote, canon FROM (SELECT *, row_number() OVER (
    PARTITION BY metric, value_low, value_high, unit_canon, phase, doc_id, substr(quote,1,50) ORDER BY confidence DESC, pkey) AS r FROM parameter) WHERE r=1""")
def fact_dedup_signature(s, d):
    """W06 H03"""
    return facts.deduplicated(_par(s, d), [F.col("confidence").desc(), "pkey"]).select("doc_id", "metric", "value_low", "value_high", "unit_canon", "phase", "quote", "canon")


@query(r"""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY md5(lower(trim(regexp_replace(text,'\s+',' ','g')))) ORDER BY doc_id) AS r FROM documents) WHERE r=1""", plain=True)
def doc_md5_dedup(s, d):
    """U09"""
    return lifecycle.distinct_documents(ad.table(s, d, "documents")).select("doc_id", "lang")


@query(f"""SELECT pkey, doc_id, dist FROM (SELECT pkey, doc_id, author, abs({MID}-5.0) AS dist, (metric='R') AS ref, ({OVERLAP}) AS in_range, (quote LIKE 'small%')::INT AS bad_quote FROM parameter WHERE canon='Brand#9')
  ORDER BY ref DESC, in_range DESC, dist, bad_quote, doc_id, pkey, author LIMIT 40""")
def rank_facts_topk(s, d):
    """T02 W12"""
    rows = _par(s, d).filter("canon = 'Brand#9'").withColumns({"ref": F.col("metric") == "R", "in_range": facts.overlaps(4.0, 6.0), "bad_quote": F.startswith(F.col("quote"), F.lit("small")).cast("int"), "dist": facts.distance(5.0)})
    return facts.ranked(rows, 5.0, 40, ("doc_id", "pkey", "author")).select("pkey", "doc_id", "dist")


PAIRS_SQL = """
eligible AS (SELECT *, coalesce(phase,'') AS ph FROM parameter WHERE confidence>=0.7 AND comparator NOT IN ('<','<=','>','>=')
  AND NOT coalesce(abs(value_high-value_low)/nullif(greatest(abs(value_low),abs(value_high)),0)>0.5,false)),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY metric,canon,ph,unit_canon,doc_id ORDER BY pkey) AS r FROM eligible) WHERE r=1),
rep AS (SELECT *, row_number() OVER (PARTITION BY metric,canon,ph,unit_canon ORDER BY doc_id) AS nth, count(*) OVER (PARTITION BY metric,canon,ph,unit_canon) AS n FROM one),
pairs AS (SELECT a.metric, a.canon AS entity, a.ph AS phase, a.unit_canon AS unit, a.doc_id AS doc_a, b.doc_id AS doc_b, (a.value_low+a.value_high)/2 AS val_a, (b.value_low+b.value_high)/2 AS val_b, a.quote AS quote_a, b.quote AS quote_b
  FROM (SELECT * FROM rep WHERE nth<=41) a JOIN (SELECT * FROM rep WHERE nth<=41) b ON a.metric=b.metric AND a.canon=b.canon AND a.ph=b.ph AND a.unit_canon=b.unit_canon AND a.nth<b.nth
  WHERE (a.nth-1)*a.n-(a.nth*(a.nth-1))//2+(b.nth-a.nth)<=40 AND coalesce(a.conditions,'')<>'' AND a.conditions=b.conditions),
gap AS (SELECT *, abs(val_a-val_b)/coalesce(nullif(greatest(abs(val_a),abs(val_b)),0),1) AS g FROM pairs),
rel AS (SELECT CASE WHEN g<=0.10 THEN 'VALIDATED_BY' ELSE 'CONTRADICTS' END AS rel, * FROM gap WHERE (g<=0.10 AND NOT (quote_a=quote_b AND quote_a<>'')) OR g>0.20)"""
PAIR_COLUMNS = ["rel", "metric", "entity", "phase", "unit", "doc_a", "doc_b", "val_a", "val_b"]


def _relations(s, d) -> DataFrame:
    return relations.pairs(_par(s, d))


@query("SELECT rel, metric, entity, phase, unit, doc_a, doc_b, val_a, val_b FROM rel WHERE rel='CONTRADICTS'", PAIRS_SQL.strip())
def pair_compare_contradict(s, d):
    """J13 F16 F17 F18 M03 M04 M05 W01 W02"""
    return _relations(s, d).filter("rel = 'CONTRADICTS'").select(*PAIR_COLUMNS)


@query("SELECT rel, metric, entity, phase, unit, doc_a, doc_b, val_a, val_b FROM rel WHERE rel='VALIDATED_BY'", PAIRS_SQL.strip())
def pair_compare_validate(s, d):
    """J13 F18"""
    return _relations(s, d).filter("rel = 'VALIDATED_BY'").select(*PAIR_COLUMNS)


@query("""SELECT r.rel, r.entity, r.metric, r.phase, r.unit, count(DISTINCT (r.doc_a,r.doc_b)) AS n, any_value(e.n_docs) AS n_docs FROM rel r JOIN
  (SELECT rel,entity,metric,phase,unit,count(DISTINCT doc) AS n_docs FROM (SELECT rel,entity,metric,phase,unit,doc_a AS doc FROM rel UNION ALL SELECT rel,entity,metric,phase,unit,doc_b FROM rel) GROUP BY ALL) e
  USING (rel,entity,metric,phase,unit) GROUP BY r.rel, r.entity, r.metric, r.phase, r.unit""", PAIRS_SQL.strip())
def relation_group_consensus(s, d):
    """A12 A13 U05"""
    out = relations.grouped(_relations(s, d), relations.mean_confidence(_par(s, d)))
    return out.select("rel", "entity", "metric", "phase", "unit", "n", "n_docs")


@query("""SELECT r.rel, r.entity, r.metric, r.phase, r.unit, r.n, m.n_docs, round(m.c + 1e-9, 6) AS mean_confidence, r.only_a, r.shared FROM
  (SELECT rel, entity, metric, phase, unit, count(*) AS n, CAST(len(list_filter(a, lambda x: NOT list_contains(b, x))) AS BIGINT) AS only_a, CAST(len(list_filter(a, lambda x: list_contains(b, x))) AS BIGINT) AS shared
   FROM (SELECT rel, entity, metric, phase, unit, list(DISTINCT val_a) AS a, list(DISTINCT val_b) AS b FROM rel GROUP BY ALL) JOIN rel USING (rel, entity, metric, phase, unit) GROUP BY ALL) r
  JOIN (SELECT rel, entity, metric, phase, unit, count(*) AS n_docs, avg(c) AS c FROM (SELECT DISTINCT rel, entity, metric, phase, unit, unnest([doc_a, doc_b]) AS doc_id FROM rel) LEFT JOIN (SELECT doc_id, avg(confidence) AS c FROM parameter GROUP BY 1) USING (doc_id) GROUP BY ALL) m
  USING (rel, entity, metric, phase, unit)""", PAIRS_SQL.strip())
def relation_group_details(s, d):
    """With confidences and the values of one side only"""
    out = relations.grouped(_relations(s, d), relations.mean_confidence(_par(s, d)))
    return out.withColumn("mean_confidence", F.round(F.col("mean_confidence") + 1e-9, 6))


@query("SELECT kind, entity, metric, phase, unit, doc_a, doc_b, val_a, val_b FROM (SELECT *, 'method_vs_method' AS kind FROM rel WHERE rel='CONTRADICTS') ORDER BY kind, entity, metric, phase, unit, doc_a, doc_b LIMIT 50", PAIRS_SQL.strip())
def contradictions_by_kind(s, d):
    """T07"""
    return relations.contradictions(_relations(s, d), 50).select("kind", "entity", "metric", "phase", "unit", "doc_a", "doc_b", "val_a", "val_b")


@query("""SELECT rel, metric, entity, phase, unit, doc_a, doc_b FROM rel WHERE doc_a IN (SELECT doc_id FROM document WHERE kg_value=1) OR doc_b IN (SELECT doc_id FROM document WHERE kg_value=1)
  ORDER BY rel, doc_a, doc_b, metric, entity, phase, unit LIMIT 300""", PAIRS_SQL.strip())
def relations_touching(s, d):
    """J08"""
    return relations.relations_of(_relations(s, d), _doc(s, d).filter("kg_value = 1")).select("rel", "metric", "entity", "phase", "unit", "doc_a", "doc_b")


@query("""SELECT b.domain, count(*) AS documents, CAST(coalesce(sum(f.n),0) AS BIGINT) AS facts, any_value(e.experts) AS experts FROM domains b
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM parameter GROUP BY 1) f USING (doc_id)
  LEFT JOIN (SELECT domain, count(DISTINCT author) AS experts FROM domains JOIN authors USING (doc_id) GROUP BY 1) e ON e.domain=b.domain GROUP BY b.domain""")
def coverage_by_domain(s, d):
    """A02"""
    p = _par(s, d)
    return coverage.by_domain(ad.domains(p), p, ad.authors(s, d))


@query("""SELECT d.year, count(*) AS documents, CAST(coalesce(sum(n),0) AS BIGINT) AS facts FROM document d LEFT JOIN (SELECT doc_id, count(*) AS n FROM parameter GROUP BY 1) USING (doc_id) GROUP BY d.year""")
def coverage_by_year(s, d):
    """A03"""
    return coverage.by_column(_doc(s, d), _par(s, d), F.col("year"), "year").orderBy(F.col("year").asc_nulls_last())


@query("""SELECT coalesce(d.geo,'?') AS geo, count(*) AS documents, CAST(coalesce(sum(n),0) AS BIGINT) AS facts FROM document d LEFT JOIN (SELECT doc_id, count(*) AS n FROM parameter GROUP BY 1) USING (doc_id) GROUP BY 1""")
def coverage_by_geo(s, d):
    """A04"""
    return coverage.by_column(_doc(s, d), _par(s, d), F.coalesce("geo", F.lit("?")), "geo")


@query("""SELECT d.*, f.*, (SELECT count(DISTINCT author) FROM authors) AS experts, (SELECT count(DISTINCT domain) FROM domains) AS domains,
  (SELECT count(*) FROM parameter WHERE comparator='<=') AS contradictions, round(d.home/d.documents,3) AS home_share, round(d.abroad/d.documents,3) AS abroad_share, round(f.docs_with_facts/d.documents,3) AS coverage
  FROM (SELECT count(*) AS documents, count(*) FILTER (geo='EUROPE') AS home, count(*) FILTER (geo<>'EUROPE') AS abroad, count(*) FILTER (geo IS NULL) AS unknown FROM document) d,
  (SELECT count(*) AS facts, count(DISTINCT doc_id) AS docs_with_facts FROM parameter) f""")
def summary_kpis(s, d):
    """A01 A28 M09"""
    p = _par(s, d)
    return coverage.summary(_doc(s, d), p, ad.authors(s, d), ad.domains(p), p.filter("comparator = '<='"), HOME)


@query("""SELECT canon, count(DISTINCT doc_id) AS sources FROM parameter WHERE metric='R' AND unit_canon='O' AND phase='solid' GROUP BY 1 HAVING count(DISTINCT doc_id)<1500 ORDER BY sources, canon LIMIT 12""", fixture=True)
def risk_low_sources(s, d):
    """A05 A30"""
    return coverage.low_sources(_par(s, d).filter("metric = 'R' and unit_canon = 'O' and phase = 'solid'"), 1500, 12)


@query("""SELECT * FROM (SELECT canon, count(*) FILTER (geo='EUROPE') AS home, count(*) FILTER (geo<>'EUROPE') AS abroad, CASE WHEN home>0 AND abroad=0 THEN 'only_home' WHEN home=0 AND abroad>0 THEN 'only_abroad' END AS side
  FROM (SELECT DISTINCT p.quote AS canon, p.doc_id, d.geo FROM parameter p JOIN document d USING (doc_id) WHERE p.value_high<1 AND p.confidence=1) GROUP BY 1) WHERE side IS NOT NULL""", fixture=True)
def risk_only_side(s, d):
    """A06"""
    p = _par(s, d).filter("value_high < 1 and confidence = 1").select(F.col("quote").alias("canon"), "doc_id")
    return coverage.one_sided(p, _doc(s, d), HOME)


@query("""SELECT d.doc_id, d.year, coalesce(f.facts,0) AS facts, coalesce(a.experts,0) AS experts, f.last_extracted FROM document d
  LEFT JOIN (SELECT doc_id, count(*) AS facts, max(extracted_at) AS last_extracted FROM parameter GROUP BY 1) f USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(DISTINCT author) AS experts FROM authors GROUP BY 1) a USING (doc_id) ORDER BY d.year DESC NULLS LAST, f.last_extracted DESC NULLS LAST, d.doc_id LIMIT 25""")
def activity_recent(s, d):
    """A07 T08 R05"""
    return coverage.activity(_doc(s, d), _par(s, d), ad.authors(s, d), 25)


@query("""SELECT e.author, e.docs, coalesce(m.domains,0) AS domains FROM (SELECT author, count(*) AS docs FROM authors GROUP BY 1 HAVING count(*)<=600) e
  LEFT JOIN (SELECT author, count(DISTINCT domain) AS domains FROM authors JOIN domains USING (doc_id) GROUP BY 1) m USING (author) ORDER BY e.docs DESC, e.author LIMIT 25""")
def expert_coverage(s, d):
    """A08 A29 T04"""
    return coverage.experts(ad.authors(s, d), ad.domains(_par(s, d)), 600, 25)


@query("""SELECT a.author, count(*) FILTER (d.kg_value=1) AS docs, count(*) AS total FROM authors a JOIN document d USING (doc_id) GROUP BY 1 HAVING docs>0 AND total<=600 ORDER BY docs DESC, a.author LIMIT 25""")
def expert_capped(s, d):
    """J07 A14"""
    return coverage.topic_experts(ad.authors(s, d), _doc(s, d).filter("kg_value = 1"), 600, 25)


@query("""SELECT canon, count(DISTINCT doc_id) AS sources, min(least(value_low,value_high)) FILTER (metric='R') AS returned_min, max(greatest(value_low,value_high)) FILTER (metric='R') AS returned_max, max(unit_canon) FILTER (metric='R') AS returned_unit, count(*) FILTER (metric='R') AS returned_n,
  min(least(value_low,value_high)) FILTER (unit_canon='O' AND value_low>8) AS open_min, max(greatest(value_low,value_high)) FILTER (unit_canon='O' AND value_low>8) AS open_max, max(unit_canon) FILTER (unit_canon='O' AND value_low>8) AS open_unit, count(*) FILTER (unit_canon='O' AND value_low>8) AS open_n
  FROM parameter WHERE canon IN ('Brand#1','Brand#2','Brand#3') GROUP BY 1""")
def technology_compare(s, d):
    """A09 A10 P24"""
    names = s.createDataFrame([("Brand#1",), ("Brand#2",), ("Brand#3",)], "canon string")
    axes = {"returned": F.col("metric") == "R", "open": (F.col("unit_canon") == "O") & (F.col("value_low") > 8)}
    return coverage.technology_comparison(_par(s, d), axes, names)


@query("""SELECT n.canon, coalesce(p.sources,0) AS sources, coalesce(p.total,0) AS total_facts, p.lo AS returned_min, p.hi AS returned_max, p.u AS returned_unit, coalesce(p.k,0) AS returned_n, coalesce(c.conditions,'') AS conditions, coalesce(c.cold,false) AS cold_climate
  FROM (VALUES ('Brand#1'),('Brand#2'),('Brand#3'),('none')) n(canon)
  LEFT JOIN (SELECT canon, count(DISTINCT doc_id) AS sources, count(*) AS total, min(least(value_low,value_high)) FILTER (metric='R') AS lo, max(greatest(value_low,value_high)) FILTER (metric='R') AS hi, max(unit_canon) FILTER (metric='R') AS u, count(*) FILTER (metric='R') AS k FROM parameter GROUP BY 1) p USING (canon)
  LEFT JOIN (SELECT canon, string_agg(DISTINCT phase, '+' ORDER BY phase) AS conditions, bool_or(phase='solid') AS cold FROM parameter WHERE phase IS NOT NULL GROUP BY 1) c USING (canon)""")
def technologies_by_axis(s, d):
    """A10: axes, conditions, and a technology without facts"""
    names = s.createDataFrame([("Brand#1",), ("Brand#2",), ("Brand#3",), ("none",)], "canon string")
    edges = _par(s, d).filter("phase is not null").select(F.col("canon").alias("src"), F.col("phase").alias("dst"), F.lit("OPERATES_AT_CONDITION").alias("type"))
    out = coverage.technologies(_par(s, d), edges, names, {"returned": F.col("metric") == "R"}, cold=("solid",))
    return out.withColumn("conditions", F.array_join("conditions", "+")).drop("capex")


@query("SELECT canon, count(*) AS n FROM parameter GROUP BY 1 ORDER BY n DESC, canon LIMIT 5")
def top_processes(s, d):
    """A11"""
    return coverage.top_entities(_par(s, d), 5)


@query("""SELECT canon, min(geo) AS only, count(DISTINCT doc_id) AS docs FROM (SELECT DISTINCT p.quote || p.canon AS canon, p.doc_id, d.geo FROM parameter p JOIN document d USING (doc_id) WHERE d.geo IS NOT NULL AND p.value_low=0) GROUP BY 1 HAVING min(geo)=max(geo)""", fixture=True)
def lang_coverage_gap(s, d):
    """A15"""
    p = _par(s, d).filter("value_low = 0").select(F.concat("quote", "canon").alias("canon"), "doc_id")
    return coverage.coverage_gaps(p, _doc(s, d), "geo")


@query("""SELECT a.c AS a, b.c AS b FROM (VALUES ('brand#1'),('steel'),('acid')) a(c), (VALUES ('brand#20'),('roasting'),('leaching')) b(c)
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT lower(canon) AS e FROM parameter) WHERE contains(e,a.c) OR contains(e,b.c))""")
def combo_gap(s, d):
    """J26"""
    a = s.createDataFrame([("brand#1",), ("steel",), ("acid",)], "canon string")
    b = s.createDataFrame([("brand#20",), ("roasting",), ("leaching",)], "canon string")
    return coverage.combination_gaps(a, b, _par(s, d))


@query("""SELECT canon, metric, unit_canon, home_values, other_values, greatest(0,home_values-4)+greatest(0,other_values-4) AS not_shown FROM (
  SELECT canon, metric, unit_canon, count(DISTINCT (value_low,value_high)) FILTER (geo='EUROPE') AS home_values, count(DISTINCT (value_low,value_high)) FILTER (geo<>'EUROPE') AS other_values
  FROM parameter JOIN document USING (doc_id) GROUP BY 1,2,3) WHERE home_values>0 AND other_values>0 ORDER BY canon, metric, unit_canon LIMIT 15""")
def two_sided_compare(s, d):
    """A16"""
    return coverage.two_sided(_par(s, d), _doc(s, d), "geo", HOME)


@query("""SELECT canon, unit_canon, count(DISTINCT metric) AS metrics, count(*) FILTER (value_low IS NOT NULL OR value_high IS NOT NULL) AS "values", count(*) FILTER (value_low IS NULL AND value_high IS NULL) AS no_value, count(*) FILTER (coalesce(quote,'')='') AS no_quote FROM parameter GROUP BY 1,2""")
def review_groups(s, d):
    """A17"""
    return coverage.review_groups(_par(s, d))


@query("""SELECT canon, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (nth<=3) AS first, greatest(0,count(*)-3) AS more FROM (SELECT *, row_number() OVER (PARTITION BY canon ORDER BY doc_id) AS nth FROM (SELECT DISTINCT canon, doc_id FROM parameter)) GROUP BY 1""")
def sources_line(s, d):
    """A18 U06"""
    return coverage.sources_line(_par(s, d))


@query("""SELECT d.doc_id, coalesce(f.n,0) AS facts, f.c AS confidence, least(coalesce(f.n,0),50) AS shown FROM document d LEFT JOIN (SELECT doc_id, count(*) AS n, round(avg(confidence),6) AS c FROM parameter GROUP BY 1) f USING (doc_id)""")
def document_card(s, d):
    """A22"""
    return coverage.document_card(_doc(s, d), _par(s, d))


@query("""SELECT DISTINCT 'year' AS facet, CAST(year AS VARCHAR) AS value FROM document WHERE year IS NOT NULL UNION ALL SELECT DISTINCT 'geo', geo FROM document WHERE geo IS NOT NULL
  UNION ALL SELECT * FROM (SELECT DISTINCT 'canon', canon FROM parameter ORDER BY 2 LIMIT 300)""")
def facet_options(s, d):
    """A23 F34"""
    return coverage.facets(_doc(s, d), _par(s, d))


@query("""SELECT a.pkey, b.pkey AS older FROM (SELECT DISTINCT doc_id,canon,metric,conditions,pkey,extracted_at FROM parameter) a JOIN (SELECT DISTINCT doc_id,canon,metric,conditions,pkey,extracted_at FROM parameter) b
  ON a.doc_id=b.doc_id AND a.canon=b.canon AND a.metric=b.metric AND a.conditions IS NOT DISTINCT FROM b.conditions AND b.extracted_at<a.extracted_at AND a.pkey<>b.pkey GROUP BY 1,2""")
def supersedes(s, d):
    """J16"""
    return lifecycle.superseded(_par(s, d))


@query("""SELECT a.pkey, 1+count(b.pkey) AS version FROM (SELECT doc_id,canon,metric,conditions,pkey,max(extracted_at) AS t FROM parameter GROUP BY ALL) a LEFT JOIN (SELECT doc_id,canon,metric,conditions,pkey,max(extracted_at) AS t FROM parameter GROUP BY ALL) b
  ON a.doc_id=b.doc_id AND a.canon=b.canon AND a.metric=b.metric AND a.conditions IS NOT DISTINCT FROM b.conditions AND b.t<a.t GROUP BY a.doc_id,a.canon,a.metric,a.conditions,a.pkey,a.t""")
def supersedes_versions(s, d):
    """A25 W08 R04"""
    return lifecycle.versions(_par(s, d)).select("pkey", "version")


@query("""SELECT CAST(doc_id AS VARCHAR) || '::' || conditions AS exp_id, doc_id, conditions, count(*) AS facts FROM parameter WHERE coalesce(conditions,'')<>'' GROUP BY doc_id, conditions""")
def experiment_reify(s, d):
    """J17 E16 D11"""
    return graphs.experiments(_par(s, d)).select("exp_id", "doc_id", "conditions", "facts")


@query("""SELECT CAST(p.doc_id AS VARCHAR) || '::' || p.conditions AS exp_id, d.kg AS claim FROM (SELECT DISTINCT doc_id, conditions FROM parameter WHERE coalesce(conditions,'')<>'') p
  JOIN (SELECT doc_id, 'claim ' || CAST(kg_value AS VARCHAR) AS kg FROM document WHERE kg_value<=2) d USING (doc_id)""")
def experiment_claims(s, d):
    """J17 J14"""
    claims = _doc(s, d).filter("kg_value <= 2").select("doc_id", F.concat(F.lit("claim "), F.col("kg_value").cast("string")).alias("claim"))
    return graphs.shown_claims(graphs.experiments(_par(s, d)), claims)


def _edges(s, d) -> DataFrame:
    """Customers, orders' suppliers' nations: a small graph of names."""
    t = lambda n: ad.table(s, d, n)
    cust = t("customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("dst"), F.lit("IN").alias("type"))
    supp = t("supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("dst"), F.lit("IN").alias("type"))
    nat = t("nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dst"), F.lit("PART").alias("type"))
    return cust.union(supp).union(nat)


EDGES_SQL = """edges AS (SELECT 'c'||c_custkey AS src, 'n'||c_nationkey AS dst, 'IN' AS type FROM customer UNION ALL SELECT 's'||s_suppkey, 'n'||s_nationkey, 'IN' FROM supplier UNION ALL SELECT 'n'||n_nationkey, 'r'||n_regionkey, 'PART' FROM nation),
both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"""
WALK_SQL = """walk AS (SELECT 's0' AS node, 0 AS hop UNION SELECT b.dst, w.hop+1 FROM walk w JOIN both_ways b ON b.src=w.node WHERE w.hop<3)"""


@query("WITH RECURSIVE " + EDGES_SQL + ", " + WALK_SQL + " SELECT node, min(hop) AS hop FROM walk GROUP BY 1", plain=True)
def neighborhood_k(s, d):
    """J11 G03 P07"""
    return graphs.neighborhood(_edges(s, d), s.createDataFrame([("s0",)], "node string"), 3)


@query("WITH RECURSIVE " + EDGES_SQL + ", " + WALK_SQL + """, near AS (SELECT DISTINCT node FROM walk WHERE hop<=2) SELECT DISTINCT least(src,dst) AS a, greatest(src,dst) AS b, type FROM edges WHERE src IN (SELECT node FROM near) AND dst IN (SELECT node FROM near) AND src<>dst ORDER BY a, b, type LIMIT 400""", plain=True)
def induced_subgraph(s, d):
    """J11 G06"""
    e = _edges(s, d)
    return graphs.induced(e, graphs.neighborhood(e, s.createDataFrame([("s0",)], "node string"), 2))


@query("WITH " + EDGES_SQL + """, docs AS (SELECT DISTINCT dst AS doc FROM edges WHERE dst LIKE 'n%'), one AS (SELECT b.src, b.dst AS doc FROM both_ways b JOIN docs ON b.dst=doc),
  near AS (SELECT * FROM one UNION SELECT b.src, o.doc FROM both_ways b JOIN one o ON b.dst=o.src) SELECT src AS node, count(DISTINCT doc) AS source_count FROM near WHERE src<>doc GROUP BY 1""", plain=True)
def source_count_2hop(s, d):
    """J12 G09 P08"""
    e = _edges(s, d)
    return graphs.document_counts(e, e.filter("dst like 'n%'").select(F.col("dst").alias("doc_id")).distinct())


@query("WITH " + EDGES_SQL + " SELECT DISTINCT dst AS node FROM both_ways WHERE src IN ('r0','r1') AND dst LIKE 'n%' ORDER BY 1 LIMIT 40", plain=True)
def adjacent_topics(s, d):
    """J09 G02"""
    return graphs.adjacent(_edges(s, d), s.createDataFrame([("r0",), ("r1",)], "node string"), F.col("node").like("n%"), 40)


@query("""SELECT doc_id, type, key FROM (SELECT DISTINCT doc_id, 'material' AS type, canon AS key, dense_rank() OVER (PARTITION BY doc_id ORDER BY canon) AS r FROM parameter WHERE doc_id IN (SELECT doc_id FROM ids)) WHERE r<=6
  UNION ALL SELECT doc_id, 'process', key FROM (SELECT DISTINCT doc_id, label AS key, dense_rank() OVER (PARTITION BY doc_id ORDER BY label) AS r FROM parameter WHERE doc_id IN (SELECT doc_id FROM ids)) WHERE r<=4
  UNION ALL SELECT doc_id, 'expert', CAST(key AS VARCHAR) FROM (SELECT DISTINCT doc_id, author AS key, dense_rank() OVER (PARTITION BY doc_id ORDER BY author) AS r FROM authors WHERE doc_id IN (SELECT doc_id FROM ids)) WHERE r<=5""",
  "ids AS (SELECT DISTINCT doc_id FROM document WHERE kg_value=2 ORDER BY doc_id LIMIT 40)")
def answer_subgraph(s, d):
    """J10 G11 P06"""
    p = _par(s, d)
    branches = {"material": (p.select("doc_id", F.col("canon").alias("key")), 6), "process": (p.select("doc_id", F.col("label").alias("key")), 4), "expert": (ad.authors(s, d).select("doc_id", F.col("author").alias("key")), 5)}
    return graphs.answer_subgraph(branches, _doc(s, d).filter("kg_value = 2"))


KINDS = "CASE phase WHEN 'solid' THEN 'Process' WHEN 'liquid' THEN 'Equipment' ELSE 'Material' END"
LINKS = "CASE metric WHEN 'R' THEN 'USES_MATERIAL' WHEN 'A' THEN 'PRODUCES_OUTPUT' ELSE 'OPERATES_AT_CONDITION' END"
ENDS = "CASE metric WHEN 'R' THEN 'Material' WHEN 'A' THEN 'Phase' ELSE CASE unit_canon WHEN 'O' THEN 'Condition' ELSE 'Equipment' END END"


@query(
    f"""SELECT src, CAST(NULL AS VARCHAR) AS dst, 'Process' AS type FROM pr
  UNION ALL SELECT DISTINCT src, dst, type FROM (SELECT src, dst, type, dense_rank() OVER (PARTITION BY src, type, el ORDER BY dst) AS r, CASE WHEN type='OPERATES_AT_CONDITION' THEN 4 ELSE 6 END AS most FROM (SELECT canon AS src, label AS dst, {LINKS} AS type, {ENDS} AS el FROM parameter) JOIN pr USING (src)) WHERE r<=most
  UNION ALL SELECT canon, NULL, 'Equipment' FROM (SELECT DISTINCT canon FROM (SELECT canon, {KINDS} AS k, doc_id FROM parameter) JOIN ids USING (doc_id) WHERE k='Equipment' ORDER BY 1 LIMIT 15)
  UNION ALL SELECT CAST(doc_id AS VARCHAR), canon, 'MENTIONS' FROM (SELECT DISTINCT doc_id, 'f' || author AS canon FROM authors JOIN ids USING (doc_id) ORDER BY 1, 2 LIMIT 15)
  UNION ALL SELECT CAST(a AS VARCHAR), CAST(b AS VARCHAR), 'CONTRADICTS' FROM (SELECT DISTINCT least(doc_a,doc_b) AS a, greatest(doc_a,doc_b) AS b FROM rel WHERE rel='CONTRADICTS' AND doc_a IN (SELECT doc_id FROM ids) AND doc_b IN (SELECT doc_id FROM ids) ORDER BY 1, 2 LIMIT 30)
  UNION ALL SELECT CAST(doc_id AS VARCHAR), CAST(author AS VARCHAR), 'AUTHORED_BY' FROM (SELECT DISTINCT doc_id, author FROM authors JOIN ids USING (doc_id) ORDER BY 1, 2 LIMIT 25)""",
    PAIRS_SQL.strip(),
    "ids AS (SELECT DISTINCT doc_id FROM document WHERE kg_value=2 ORDER BY doc_id LIMIT 40)",
    f"pr AS (SELECT DISTINCT canon AS src FROM (SELECT canon, {KINDS} AS k, doc_id FROM parameter) JOIN ids USING (doc_id) WHERE k='Process' ORDER BY 1 LIMIT 60)",
)
def answer_graph(s, d):
    """All its branches"""
    p = _par(s, d)
    rows = p.select("doc_id", "canon", F.expr(KINDS).alias("label"))
    edges = p.select(F.col("canon").alias("src"), F.col("label").alias("dst"), F.expr(ENDS).alias("dst_label"), F.expr(LINKS).alias("type"))
    places = ad.authors(s, d).select("doc_id", F.lit("Facility").alias("label"), F.concat(F.lit("f"), "author").alias("canon"))
    return graphs.answer_graph(_doc(s, d).filter("kg_value = 2"), rows, edges, places, _relations(s, d), ad.authors(s, d))


def _nodes(s, d) -> DataFrame:
    p = _par(s, d)
    return p.select(F.col("label"), F.col("canon").alias("key"), F.col("phase"), F.col("unit_canon"), F.col("extracted_at").alias("at"))


@query("SELECT key, phase, count(*) AS n FROM (SELECT label, canon AS key, phase FROM parameter) WHERE label='PROMO' AND key='Brand#5' AND phase='solid' GROUP BY 1,2")
def node_seek(s, d):
    """G01 S15"""
    return graphs.nodes_of(_nodes(s, d), "PROMO", "Brand#5", phase="solid").groupBy("key", "phase").agg(F.count("*").alias("n"))


@query("SELECT d.doc_id, e.author AS expert FROM document d LEFT JOIN (SELECT DISTINCT doc_id, author FROM authors WHERE author<=20) e USING (doc_id)")
def optional_expand(s, d):
    """Documents with their authors, and those without"""
    edges = ad.authors(s, d).filter("author <= 20").select(F.col("doc_id").alias("src"), F.col("author").alias("dst"), F.lit("AUTHORED_BY").alias("type"))
    return graphs.optional(_doc(s, d).select("doc_id"), edges, "AUTHORED_BY", "doc_id", "expert")


@query("""SELECT label, key, max("at") AS "at", arg_max(phase, (is_new, "at", phase)) FILTER (phase IS NOT NULL) AS phase, arg_min(first_unit, (is_new, "at", first_unit)) FILTER (first_unit IS NOT NULL) AS first_unit FROM
  (SELECT label, canon AS key, CAST(max(extracted_at) AS TIMESTAMP) AS "at", max(phase) AS phase, min(unit_canon) AS first_unit, CASE WHEN metric='R' THEN 1 ELSE 0 END AS is_new FROM parameter GROUP BY label, canon, metric='R') GROUP BY 1,2""")
def node_upsert(s, d):
    """Properties over old ones, one kept from the first time"""
    p = _par(s, d)
    part = lambda rows: rows.groupBy("label", F.col("canon").alias("key")).agg(F.max("extracted_at").alias("at"), F.max("phase").alias("phase"), F.min("unit_canon").alias("first_unit"))
    out = graphs.upserted_nodes(part(p.filter("metric <> 'R'")), part(p.filter("metric = 'R'")), on_create=("first_unit",))
    return out.select("label", "key", F.col("at").cast("timestamp_ntz").alias("at"), "phase", "first_unit")


@query("SELECT canon AS key, string_agg(DISTINCT label, '+' ORDER BY label) AS labels FROM parameter GROUP BY 1")
def node_labels(s, d):
    """G08"""
    return graphs.with_labels(_nodes(s, d)).select("key", F.array_join("labels", "+").alias("labels"))


@query("""SELECT rel, doc_a, doc_b, metric, entity, phase, max(v) AS val_a FROM (SELECT rel, doc_a, doc_b, metric, entity, phase, CASE WHEN entity<'Brand#2' THEN val_a+1 ELSE val_a END AS v FROM rel) GROUP BY ALL""", PAIRS_SQL.strip())
def relation_upsert(s, d):
    """Some relations come again with another value"""
    old = _relations(s, d)
    new = old.filter("entity < 'Brand#2'").withColumn("val_a", F.col("val_a") + 1)
    return relations.upserted(old, new).select("rel", "doc_a", "doc_b", "metric", "entity", "phase", "val_a")


@query("SELECT src, dst, type, doc_id, string_agg(DISTINCT source, '+' ORDER BY source) AS sources FROM (SELECT canon AS src, label AS dst, metric AS type, doc_id, source FROM parameter) GROUP BY 1,2,3,4")
def edge_upsert(s, d):
    """K08 A26 U08 K02"""
    e = _par(s, d).select(F.col("canon").alias("src"), F.col("label").alias("dst"), F.col("metric").alias("type"), "doc_id", "source")
    return graphs.merged_edges(e).select("src", "dst", "type", "doc_id", F.array_join("sources", "+").alias("sources"))


@query("""SELECT DISTINCT src, src_label, dst, dst_label FROM (SELECT CAST(doc_id AS VARCHAR) AS src, 'Document' AS src_label, pkey AS dst, 'Parameter' AS dst_label FROM parameter WHERE metric='R' AND canon='Brand#6'
  UNION ALL SELECT pkey, 'Parameter', canon, 'Entity' FROM parameter WHERE metric='R' AND canon='Brand#6')""")
def facts_to_subgraph(s, d):
    """J32 G10"""
    return graphs.chained(_par(s, d).filter("metric = 'R' and canon = 'Brand#6'"))


@query("""SELECT doc_id FROM (SELECT doc_id, min(p) AS p FROM (SELECT doc_id, (0, pkey) AS p FROM parameter WHERE canon='Brand#8' UNION ALL SELECT doc_id, (1, lpad(CAST(doc_id AS VARCHAR),12,'0')) FROM document WHERE geo='ASIA') GROUP BY 1) ORDER BY p, doc_id LIMIT 40""")
def result_documents(s, d):
    """J33 U06"""
    a = _par(s, d).filter("canon = 'Brand#8'").select("doc_id", F.col("pkey").alias("pos"))
    b = _doc(s, d).filter("geo = 'ASIA'").select("doc_id", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("pos"))
    return graphs.first_documents(a, b)


@query("""SELECT canon, form, rank, source_count FROM (SELECT p_brand AS canon, CASE WHEN contains(lower(p_brand),'brand#1') THEN p_brand WHEN contains(lower('type ' || min(p_type)),'brand#1') THEN 'type ' || min(p_type) END AS form, count(*) AS source_count,
   CAST(CASE WHEN starts_with(lower(form),'brand#1') THEN 0 ELSE 1 END AS INTEGER) AS rank FROM part GROUP BY 1) WHERE form IS NOT NULL ORDER BY rank, canon LIMIT 10""", plain=True)
def suggest_prefix(s, d):
    """F31 J31 T10"""
    entities = ad.table(s, d, "part").groupBy(F.col("p_brand").alias("canon")).agg(F.min("p_type").alias("t"), F.count("*").alias("source_count"))
    return retrieval.suggestions(entities.withColumn("forms", F.array("canon", F.concat(F.lit("type "), F.col("t")))), "Brand#1")


@query("""SELECT d.doc_id, d.name, d.year, coalesce(f.n,0) AS fact_count, f.c AS confidence FROM document d LEFT JOIN (SELECT doc_id, count(*) AS n, round(avg(confidence),6) AS c FROM parameter GROUP BY 1) f USING (doc_id)
  WHERE ((contains(lower(d.name),'customer') AND contains(lower(d.name),'machinery')) OR d.doc_id IN (SELECT doc_id FROM authors WHERE author=3)) AND d.year>=1996 AND d.year<=2000 AND d.sensitivity='public' ORDER BY fact_count DESC, d.doc_id LIMIT 20 OFFSET 20""")
def documents_library(s, d):
    """F25 J18 J19 T05"""
    own = ad.authors(s, d).filter("author = 3")
    out = retrieval.library(_doc(s, d), _par(s, d), "Customer MACHINERY", 1996, 2000, sensitivity="public", author_docs=own, offset=20)
    return out.select("doc_id", "name", "year", "fact_count", "confidence")


TF_SQL = """WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text),'[a-z]{4,}')) AS lemma FROM documents), tf AS (SELECT lemma, doc_id, count(*) AS tf FROM tok GROUP BY 1,2),
df AS (SELECT lemma, count(*) AS df FROM tf GROUP BY 1), nn AS (SELECT count(*) AS n FROM documents), kept AS (SELECT lemma, df FROM df, nn WHERE df<=greatest(2,0.30*n) AND NOT (df=1 AND length(lemma)>25)) """


@query(TF_SQL + "SELECT lemma, doc_id, tf, df FROM tf JOIN kept USING (lemma)", plain=True)
def kw_postings(s, d):
    """A19 H08 X07 K13 S17"""
    return retrieval.postings(ad.table(s, d, "documents"), pattern="[a-z]{4,}").select("lemma", "doc_id", "tf", "df")


@query(TF_SQL + "SELECT doc_id, round(sum(ln(n/df)*ln(1+tf)),2) AS score FROM tf JOIN kept USING (lemma), nn WHERE lemma IN ('this','thed','therhean','inst') GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 8", plain=True)
def kw_search_tfidf(s, d):
    """J29 M07 T09"""
    docs = ad.table(s, d, "documents")
    return retrieval.keyword_search(retrieval.postings(docs, pattern="[a-z]{4,}"), docs.agg(F.count("*").alias("n")), ["this", "thed", "therhean", "inst"])


VEC_SQL = """WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id=7), sc AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) AS s FROM embeddings, q) """


def _probe(s, d) -> list[float]:
    return list(ad.table(s, d, "embeddings").filter("vec_id = 7").first()["embedding"])


@query(VEC_SQL + "SELECT vec_id, round(s,6) AS score FROM sc WHERE s>=0.1 ORDER BY s DESC, vec_id LIMIT 20", plain=True)
def vector_topk(s, d):
    """J28 F26 M08 P19 S16"""
    return retrieval.vector_topk(ad.table(s, d, "embeddings"), _probe(s, d), 20, floor=0.1).select("vec_id", F.round("score", 6).alias("score"))


@query(VEC_SQL + "SELECT label, arg_max(vec_id, s) AS vec_id, round(max(s),6) AS score FROM sc GROUP BY 1", plain=True)
def vector_best_per_label(s, d):
    """W05"""
    scored = retrieval.vector_scores(ad.table(s, d, "embeddings"), _probe(s, d))
    return retrieval.best_chunk(scored, "label", "vec_id").select("label", "vec_id", F.round("score", 6).alias("score"))


@query("""SELECT doc_id, line AS chunk_no FROM (SELECT p.doc_id, p.line, d.kg_value, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.line) AS r FROM (SELECT DISTINCT l_orderkey AS doc_id, l_suppkey AS line FROM lineitem) p JOIN document d USING (doc_id)) WHERE r<=3 ORDER BY kg_value DESC NULLS LAST, doc_id, line LIMIT 400""")
def chunk_cap(s, d):
    """W04 P17"""
    rows = ad.authors(s, d).join(_doc(s, d).select("doc_id", "kg_value"), "doc_id").withColumnRenamed("author", "chunk_no")
    return retrieval.chunk_cap(rows, 3, 400).select("doc_id", "chunk_no")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS r FROM lineitem) WHERE r=1""", plain=True)
def upsert_keep_last(s, d):
    """K05 K06 W11"""
    rows = ad.table(s, d, "lineitem")
    old, new = rows.filter("l_shipdate < '1998-01-01'"), rows.filter("l_shipdate >= '1998-01-01'")
    return lifecycle.upserted(old, new, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")


@query("SELECT doc_id, pkey, canon FROM parameter WHERE NOT (canon='Brand#2' AND metric='A')")
def soft_delete_view(s, d):
    """Q13 B03 F28"""
    return lifecycle.live(lifecycle.deleted(_par(s, d), {"canon": "Brand#2", "metric": "A"})).select("doc_id", "pkey", "canon")


@query("SELECT pkey, value_low AS old_low, value_high AS old_high FROM parameter WHERE doc_id=17")
def curation_snapshot(s, d):
    """Q13 T06"""
    _, history = lifecycle.edited(_par(s, d), {"doc_id": 17}, 5.0, "ed", F.lit("2024-01-01").cast("timestamp"))
    return lifecycle.history(history, 1000).select("pkey", "old_low", "old_high")


@query("""SELECT user_id AS user, 'type ' || event_type AS query, count(DISTINCT CASE WHEN v.ts>u.last_seen THEN v.event_id END) AS new FROM
  (SELECT user_id, min(ts) AS last_seen FROM events WHERE event_type='signup' GROUP BY 1) u JOIN (SELECT event_id, event_type, ts FROM events WHERE event_type IN ('error','purchase')) v ON true WHERE v.ts>u.last_seen GROUP BY 1,2""", plain=True)
def subscription_new(s, d):
    """R02 F27 J20 Q12"""
    e = ad.table(s, d, "events")
    kinds = s.createDataFrame([("type error",), ("type purchase",)], "query string")
    subs = e.filter("event_type = 'signup'").groupBy(F.col("user_id").alias("user")).agg(F.min("ts").alias("last_seen")).join(F.broadcast(kinds))
    hits = e.filter("event_type in ('error', 'purchase')").select(F.concat(F.lit("type "), F.col("event_type")).alias("query"), F.col("event_id").alias("doc_id"))
    return lifecycle.novelties(hits, subs, e.select(F.col("event_id").alias("doc_id"), F.col("ts").alias("at")), F.lit(None).cast("timestamp"))


@query("SELECT event_id, event_type, ts FROM events ORDER BY ts DESC NULLS LAST, event_id LIMIT 500", plain=True)
def audit_tail(s, d):
    """S23"""
    return lifecycle.audit_tail(ad.table(s, d, "events")).select("event_id", "event_type", "ts")


@query("SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n, round(sum(value),2) AS total FROM events GROUP BY 1,2", plain=True)
def audit_tumbling(s, d):
    """R03 K14 (extension)"""
    out = ad.table(s, d, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total")


@query("""SELECT event_type, start, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS start FROM events) GROUP BY 1,2""", plain=True)
def audit_sliding(s, d):
    """R03 (extension)"""
    out = ad.table(s, d, "events").groupBy("event_type", F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return out.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, g""", plain=True)
def audit_sessions(s, d):
    """R03 (extension)"""
    out = ad.table(s, d, "events").groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("""SELECT user_id, segment, count(*) AS n, min(event_id) AS first FROM (SELECT *, CAST(sum(CASE WHEN event_type='signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM events) GROUP BY 1,2""", plain=True)
def segment_sessionize(s, d):
    """W10 E13"""
    rows = spans.segments(ad.table(s, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "signup")
    return rows.groupBy("user_id", "segment").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("""SELECT p.event_id AS lid, c.event_id AS click FROM (SELECT * FROM events WHERE event_type='purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type='click') c ON p.user_id=c.user_id AND p.ts>=c.ts""", plain=True)
def asof_left_phase(s, d):
    """J23 W09"""
    e = ad.table(s, d, "events")
    left = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("lid"), "ts")
    right = e.filter("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click"))
    return spans.last_before(left, right, "user_id", "ts", "click").select("lid", "click")


@query("""SELECT vid, mid, gap FROM (SELECT v.event_id AS vid, m.event_id AS mid, abs(epoch_us(v.ts)//1000000-epoch_us(m.ts)//1000000) AS gap, row_number() OVER (PARTITION BY v.event_id ORDER BY abs(epoch_us(v.ts)//1000000-epoch_us(m.ts)//1000000), epoch_us(m.ts)//1000000, m.event_id) AS r
  FROM (SELECT * FROM events WHERE event_type='error') v JOIN (SELECT * FROM events WHERE event_type='view') m USING (user_id)) WHERE r=1""", plain=True)
def nearest_span_join(s, d):
    """J21 J24 M06"""
    e = ad.table(s, d, "events").withColumn("at", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000))
    v = e.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("vid"), F.col("at").alias("v_at"))
    m = e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("mid"), F.col("at").alias("m_at"))
    return spans.nearest_points(v, m, "user_id").select("vid", "mid", F.col("gap").cast("long").alias("gap"))


@query("SELECT DISTINCT conv_id, u.text AS u, length(a.text) AS a_size FROM (SELECT DISTINCT conv_id, text FROM conversations WHERE role='system') u JOIN (SELECT DISTINCT conv_id, text FROM conversations WHERE role='assistant') a USING (conv_id)", plain=True)
def cross_in_sentence(s, d):
    """J25"""
    c = ad.table(s, d, "conversations")
    u, a = (c.filter(F.col("role") == r).select("conv_id", F.col("text").alias(n)) for r, n in (("system", "u"), ("assistant", "a")))
    return spans.cross_in_group(u, a, "conv_id").select("conv_id", "u", F.length("a").cast("long").alias("a_size")).distinct()


@query("""SELECT pkey, doc_id FROM parameter WHERE source='grammar' AND (value_low IS NOT NULL OR value_high IS NOT NULL) AND canon='Brand#11'""", fixture=True)
def verify_needed(s, d):
    """F29 L04"""
    return facts.needs_check(_par(s, d).filter("canon = 'Brand#11'")).select("pkey", "doc_id")


@query("""SELECT CASE WHEN confidence>=0.97 THEN 'a' ELSE 'b' END AS part, CASE WHEN confidence>=0.8 THEN 'high' WHEN confidence>=0.5 THEN 'medium' ELSE 'low' END AS word, count(*) AS n FROM parameter GROUP BY 1,2""")
def confidence_words(s, d):
    """X25"""
    return _par(s, d).groupBy(F.when(F.col("confidence") >= 0.97, "a").otherwise("b").alias("part"), facts.confidence_word().alias("word")).agg(F.count("*").alias("n"))


@query("SELECT unit, count(*) AS n FROM (SELECT CASE metric WHEN 'R' THEN 'pct' WHEN 'A' THEN 'pH' ELSE 'degC' END AS unit, value_low*12 AS lo, value_high*12 AS hi FROM parameter) WHERE NOT (unit='pct' AND (lo<0 OR lo>100 OR hi<0 OR hi>100)) AND NOT (unit='pH' AND (lo<0 OR lo>14 OR hi<0 OR hi>14)) AND NOT (unit='degC' AND (lo<-273 OR hi<-273)) GROUP BY 1")
def load_sanity_gate(s, d):
    """F11 F12 F13 B05"""
    unit = F.when(F.col("metric") == "R", "pct").when(F.col("metric") == "A", "pH").otherwise("degC")
    rows = _par(s, d).select(unit.alias("unit"), (F.col("value_low") * 12).alias("value_low"), (F.col("value_high") * 12).alias("value_high"))
    return rows.filter(facts.plausible("load", "unit")).groupBy("unit").agg(F.count("*").alias("n"))


@query("SELECT doc_id, kg_value FROM document WHERE kg_value>=4 ORDER BY kg_value DESC, doc_id LIMIT 100")
def dense_documents(s, d):
    """F01 T12"""
    return facts.dense(_doc(s, d).withColumn("ok", F.lit(True)), 4, 100).select("doc_id", "kg_value")


@query("""SELECT DISTINCT doc_id FROM document WHERE kg_value=3 AND doc_id NOT IN (SELECT doc_id FROM parameter WHERE canon='Brand#1') ORDER BY doc_id LIMIT 8""")
def similar_cases(s, d):
    """J27 U07"""
    return _doc(s, d).filter("kg_value = 3").join(_par(s, d).filter("canon = 'Brand#1'").select("doc_id"), "doc_id", "left_anti").select("doc_id").orderBy("doc_id").limit(8)


@query("""SELECT id, type, count(*) AS n FROM (SELECT DISTINCT 'doc/' || CAST(doc_id AS VARCHAR) AS id, 'ScholarlyArticle' AS type FROM parameter WHERE canon='Brand#12' AND metric='A' UNION ALL SELECT DISTINCT 'person/' || CAST(author AS VARCHAR), 'Person' FROM parameter WHERE canon='Brand#12' AND metric='A') GROUP BY 1,2""")
def jsonld_nodes(s, d):
    """The distinct nodes of an exported graph"""
    rows = _par(s, d).filter("canon = 'Brand#12' and metric = 'A'")
    node = lambda prefix, c, kind: F.struct(F.concat(F.lit(prefix), F.col(c).cast("string")).alias("id"), F.lit(kind).alias("type"))
    nodes = rows.select(F.explode(F.array(node("doc/", "doc_id", "ScholarlyArticle"), node("person/", "author", "Person"))).alias("n")).select("n.*").distinct()
    return nodes.groupBy("id", "type").agg(F.count("*").alias("n"))


# Reports of the whole fact table; the entity is what is counted, and no fact is left out before.


@query("""SELECT pkey, doc_id FROM parameter WHERE source='grammar' AND (value_low IS NOT NULL OR value_high IS NOT NULL)""")
def verify_needed_all(s, d):
    """F29 L04"""
    return facts.needs_check(_par(s, d)).select("pkey", "doc_id")


@query("""SELECT quote AS canon, count(DISTINCT doc_id) AS sources FROM parameter GROUP BY 1 HAVING count(DISTINCT doc_id)<1500 ORDER BY sources, canon LIMIT 12""")
def risk_low_sources_all(s, d):
    """A05 A30"""
    return coverage.low_sources(_par(s, d).withColumn("canon", F.col("quote")), 1500, 12)


@query("""SELECT * FROM (SELECT canon, count(*) FILTER (geo='EUROPE') AS home, count(*) FILTER (geo<>'EUROPE') AS abroad, CASE WHEN home>0 AND abroad=0 THEN 'only_home' WHEN home=0 AND abroad>0 THEN 'only_abroad' END AS side
  FROM (SELECT DISTINCT p.quote || '|' || CAST(p.author AS VARCHAR) AS canon, p.doc_id, d.geo FROM parameter p JOIN document d USING (doc_id)) GROUP BY 1) WHERE side IS NOT NULL""")
def risk_only_side_all(s, d):
    """A06"""
    p = _par(s, d).select(F.concat("quote", F.lit("|"), F.col("author").cast("string")).alias("canon"), "doc_id")
    return coverage.one_sided(p, _doc(s, d), HOME)


@query("""SELECT canon, min(geo) AS only, count(DISTINCT doc_id) AS docs FROM (SELECT DISTINCT p.quote || '|' || CAST(p.author AS VARCHAR) AS canon, p.doc_id, d.geo FROM parameter p JOIN document d USING (doc_id) WHERE d.geo IS NOT NULL) GROUP BY 1 HAVING min(geo)=max(geo)""")
def lang_coverage_gap_all(s, d):
    """A15"""
    p = _par(s, d).select(F.concat("quote", F.lit("|"), F.col("author").cast("string")).alias("canon"), "doc_id")
    return coverage.coverage_gaps(p, _doc(s, d), "geo")
