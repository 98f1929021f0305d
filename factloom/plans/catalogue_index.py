"""Queries of what is kept and maintained: indexes, layouts, counters, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import registry, tables
from factloom.operators import contain, coverage, graphs, relations, segments
from factloom.plans import adapters as ad
from factloom.plans import dictionary, verify
from factloom.plans.catalogue import EDGES_SQL, HOME, PAIRS_SQL, TF_SQL, _edges, _relations, query
from factloom.plans.catalogue_flow import _folder
from factloom.sources import layout, lines
from factloom.streaming import pipelines

_WORD = "[a-z]{4,}"


def _indexed(s: SparkSession, d: str) -> str:
    """An index of all documents, built by lots, with texts that are replaced and documents that are
    deleted and come back on the way."""
    docs = ad.table(s, d, "documents").select("doc_id", "text").withColumn("lot", F.pmod(F.xxhash64("doc_id"), F.lit(5)))
    path = f"{_folder(s)}/index"
    lot = lambda i: docs.filter(F.col("lot") == i)
    early = lot(1).withColumn("text", F.concat(F.reverse("text"), F.lit(" early words")))
    segments.add(path, lot(0).unionByName(early), 1, pattern=_WORD)
    segments.add(path, lot(1), 2, pattern=_WORD)
    segments.delete(path, lot(0).filter(F.col("doc_id") % 3 == 0), 3)
    segments.add(path, lot(2).unionByName(lot(0).filter(F.col("doc_id") % 3 == 0)), 4, pattern=_WORD)
    segments.add(path, lot(3), 5, pattern=_WORD)
    segments.add(path, lot(4), 6, pattern=_WORD)
    return path


@query(TF_SQL + "SELECT lemma, doc_id, tf, df FROM tf JOIN kept USING (lemma)", plain=True)
def kw_segments(s, d):
    """An index that grew by lots is the index of all documents at once"""
    return segments.postings(s, _indexed(s, d), dict(ad.table(s, d, "documents").dtypes)["doc_id"])


@query(TF_SQL + "SELECT doc_id, round(sum(ln(n/df)*ln(1+tf)),2) AS score FROM tf JOIN kept USING (lemma), nn WHERE lemma IN ('this','thed','therhean','inst') GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 8", plain=True)
def kw_segments_search(s, d):
    """Idf at the time of the question, over all segments"""
    return segments.search(s, _indexed(s, d), ["this", "thed", "therhean", "inst"], kind=dict(ad.table(s, d, "documents").dtypes)["doc_id"])


@query("SELECT doc_id, pkey, value_low FROM parameter WHERE metric='A' AND unit_canon='F' AND value_low BETWEEN 2 AND 4")
def layout_range(s, d):
    """A range of one metric, from facts laid out by value"""
    path = f"{_folder(s)}/by-value"
    layout.write_by_value(ad.parameter(s, d), path, parts=8)
    return layout.facts_between(s, path, "A", "F", 2, 4, parts=8).select("doc_id", "pkey", "value_low")


@query("SELECT doc_id, year, count(*) AS facts, max(value_high) AS most FROM parameter JOIN document USING (doc_id) GROUP BY 1,2")
def layout_join(s, d):
    """Facts and documents in the same buckets, joined and grouped where they lie"""
    folder = _folder(s)
    mark = folder.rpartition("-")[2][:12]
    layout.write_bucketed({f"facts_{mark}": ad.parameter(s, d), f"documents_{mark}": ad.document(s, d)}, folder, buckets=8)
    rows = s.table(f"facts_{mark}").join(s.table(f"documents_{mark}").select("doc_id", "year"), "doc_id")
    return rows.groupBy("doc_id", "year").agg(F.count("*").alias("facts"), F.max("value_high").alias("most"))


@query("SELECT count(*) AS rows, count(*) FILTER (source='vision_ocr') AS vision, count(*) FILTER (phase IS NULL) AS no_phase, CAST(sum(length(quote)) AS BIGINT) AS quoted FROM parameter")
def run_counters(s, d):
    """What a load of facts wrote, counted while it was written"""
    counters = {"vision": F.count_if(F.col("source") == "vision_ocr"), "no_phase": F.count_if(F.col("phase").isNull()), "quoted": F.sum(F.length("quote"))}
    found = layout.write_counted(ad.parameter(s, d).repartition(4, "doc_id"), f"{_folder(s)}/facts", counters)
    return s.createDataFrame([tuple(found[c] for c in ("rows", "vision", "no_phase", "quoted"))], "rows long, vision long, no_phase long, quoted long")


@query("SELECT DISTINCT b.p AS needle, n.p_name AS text FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS p FROM part) b JOIN (SELECT DISTINCT p_name FROM part) n ON contains(n.p_name, b.p)", plain=True)
def containment(s, d):
    """Which names contain which first words of names, by n-grams"""
    names = ad.table(s, d, "part").select(F.col("p_name").alias("text"))
    return contain.containing(names, names.select(F.substring_index("text", " ", 1).alias("needle")))


ALIASES = [("this one", "this", 0), ("that one", "that", 0), ("to the", "to the", 0), ("the there", "the there", 1), ("the", "the", 1), ("to", "To", 1), ("other", "to", 2), ("of", "of", 0), ("of the to", "of the to", 0), ("none", "...", 0)]
_ALIAS_SQL = "(VALUES ('this','this one'),('that','that one'),('to the','to the'),('the there','the there'),('the','the'),('to','to'),('of','of'),('of the to','of the to')) a(alias, canon)"


@query(rf"""SELECT doc_id, canon, count(*) AS n FROM (SELECT doc_id, replace(unnest(regexp_extract_all(t, ' (of  the  to|the  there|to  the|that|this|the|of|to) ', 1)), '  ', ' ') AS alias FROM
  (SELECT doc_id, ' ' || array_to_string(list_transform(regexp_extract_all(lower(coalesce(text,'')), '[\p{{L}}\p{{N}}]+'), lambda x: x || ' '), ' ') AS t FROM documents)) x JOIN {_ALIAS_SQL} USING (alias) GROUP BY 1,2""", plain=True)
def dictionary_mentions(s, d):
    """Mentions of a dictionary in whole texts, by joins of word n-grams"""
    aliases = s.createDataFrame(ALIASES, "canon string, alias string, tier int")
    return dictionary.mentions(ad.table(s, d, "documents"), aliases).groupBy("doc_id", "canon").agg(F.count("*").alias("n"))


@query("WITH " + EDGES_SQL + """, docs AS (SELECT DISTINCT dst AS doc FROM edges WHERE dst LIKE 'n%'), one AS (SELECT b.src, b.dst AS doc FROM both_ways b JOIN docs ON b.dst=doc),
  near AS (SELECT * FROM one UNION SELECT b.src, o.doc FROM both_ways b JOIN one o ON b.dst=o.src) SELECT src AS node, count(DISTINCT doc) AS source_count FROM near WHERE src<>doc GROUP BY 1""", plain=True)
def source_count_maintained(s, d):
    """The counts of source_count_2hop, kept up while edges come in three lots"""
    folder = _folder(s)
    edges = _edges(s, d).withColumn("lot", F.pmod(F.xxhash64("src", "dst"), F.lit(3)))
    docs = edges.filter("dst like 'n%'").select(F.col("dst").alias("doc_id")).distinct()
    counts = s.createDataFrame([], "node string, source_count long")
    for i in range(3):
        changes = graphs.document_count_changes(edges.filter(F.col("lot") < i), edges.filter(F.col("lot") == i), docs)
        graphs.counts_changed(counts, changes).write.parquet(f"{folder}/{i}")
        counts = s.read.parquet(f"{folder}/{i}")
    return counts


@query("""SELECT CAST(user_id AS VARCHAR) AS owner, segment, count(*) AS n, min(event_id) AS first FROM (SELECT *, CAST(sum(CASE WHEN event_type='signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM events) GROUP BY 1,2""", plain=True)
def segments_in_sql(s, d):
    """The table function, called from SQL"""
    registry.register_table_functions(s)
    rows = ad.table(s, d, "events").select(F.col("user_id").cast("string").alias("owner"), "ts", F.col("event_id").alias("item"), (F.col("event_type") == "signup").alias("starts"))
    rows = rows.withColumn("place", F.struct("ts", "item")).drop("ts")
    name = f"events_{_folder(s).rpartition('-')[2][:12]}"
    rows.createOrReplaceTempView(name)
    return s.sql(f"SELECT owner, segment, n, first FROM segments(TABLE({name}) PARTITION BY owner ORDER BY place)")


@query("""SELECT rel, entity, metric, phase, unit, len(docs) AS n_docs, array_to_string(docs[1:3], ',') AS first_docs, greatest(0, len(docs)-3) AS more, round(c + 1e-9, 6) AS mean_confidence, years, places, a=b AS same,
  array_to_string(CASE WHEN a=b OR len(oa)=0 THEN a ELSE oa END, '/') AS left_values, array_to_string(CASE WHEN a=b OR len(ob)=0 THEN b ELSE ob END, '/') AS right_values FROM
  (SELECT *, list_filter(a, lambda x: NOT list_contains(b, x)) AS oa, list_filter(b, lambda x: NOT list_contains(a, x)) AS ob FROM (SELECT rel, entity, metric, phase, unit, list_sort(list(DISTINCT val_a)) AS a, list_sort(list(DISTINCT val_b)) AS b FROM rel GROUP BY ALL))
  JOIN (SELECT rel, entity, metric, phase, unit, list(doc_id ORDER BY doc_id) AS docs, avg(c) AS c, string_agg(DISTINCT CAST(year AS VARCHAR), ', ' ORDER BY CAST(year AS VARCHAR)) AS years, string_agg(DISTINCT geo, ', ' ORDER BY geo) AS places
   FROM (SELECT DISTINCT rel, entity, metric, phase, unit, unnest([doc_a, doc_b]) AS doc_id FROM rel) LEFT JOIN document USING (doc_id) LEFT JOIN (SELECT doc_id, avg(confidence) AS c FROM parameter GROUP BY 1) USING (doc_id) GROUP BY ALL) USING (rel, entity, metric, phase, unit)""", PAIRS_SQL.strip())
def relation_group_lists(s, d):
    """Groups with documents, years, places and the values of either side"""
    par = ad.parameter(s, d)
    out = relations.group_lists(_relations(s, d), ad.document(s, d), relations.mean_confidence(par))
    joined = lambda c, sep: F.array_join(F.col(c).cast("array<string>"), sep).alias(c)
    return out.select("rel", "entity", "metric", "phase", "unit", "n_docs", joined("first_docs", ","), "more", F.round(F.col("mean_confidence") + 1e-9, 6).alias("mean_confidence"), joined("years", ", "), joined("places", ", "), "same", joined("left_values", "/"), joined("right_values", "/"))


_SHOWN = "CASE WHEN value_low=value_high THEN CAST(CAST(value_low AS BIGINT) AS VARCHAR) ELSE CAST(CAST(value_low AS BIGINT) AS VARCHAR) || '–' || CAST(CAST(value_high AS BIGINT) AS VARCHAR) END"


@query(f"""SELECT * FROM (SELECT canon, metric, unit_canon, string_agg(v, ', ' ORDER BY nth) FILTER (side='home' AND nth<=4) AS home, greatest(0, count(*) FILTER (side='home')-4) AS home_more,
   string_agg(v, ', ' ORDER BY nth) FILTER (side='other' AND nth<=4) AS other, greatest(0, count(*) FILTER (side='other')-4) AS other_more FROM
  (SELECT *, row_number() OVER (PARTITION BY canon, metric, unit_canon, side ORDER BY value_low, value_high) AS nth FROM (SELECT DISTINCT canon, metric, unit_canon, CASE WHEN geo='EUROPE' THEN 'home' ELSE 'other' END AS side, value_low, value_high, {_SHOWN} AS v FROM parameter JOIN document USING (doc_id) WHERE geo IS NOT NULL)) GROUP BY 1,2,3)
  WHERE home IS NOT NULL AND other IS NOT NULL ORDER BY canon, metric, unit_canon LIMIT 15""")
def two_sided_lists(s, d):
    """The values of either side, in order"""
    out = coverage.two_sided_lists(ad.parameter(s, d), ad.document(s, d), "geo", HOME)
    return out.withColumns({c: F.array_join(c, ", ") for c in ("home", "other")})


@query(f"""SELECT canon, unit_canon, m.metrics, m.metrics_more, v.v AS "values", v.more AS values_more FROM
  (SELECT canon, unit_canon, string_agg(metric, ', ' ORDER BY nth) FILTER (nth<=4) AS metrics, greatest(0, count(*)-4) AS metrics_more FROM (SELECT *, row_number() OVER (PARTITION BY canon, unit_canon ORDER BY metric) AS nth FROM (SELECT DISTINCT canon, unit_canon, metric FROM parameter)) GROUP BY 1,2) m
  JOIN (SELECT canon, unit_canon, string_agg(v, ', ' ORDER BY nth) FILTER (nth<=4) AS v, greatest(0, count(*)-4) AS more FROM (SELECT *, row_number() OVER (PARTITION BY canon, unit_canon ORDER BY value_low, value_high) AS nth FROM (SELECT DISTINCT canon, unit_canon, value_low, value_high, {_SHOWN} AS v FROM parameter)) GROUP BY 1,2) v USING (canon, unit_canon)""")
def review_lists(s, d):
    """Metrics and values of each entity and unit"""
    out = coverage.review_lists(ad.parameter(s, d))
    return out.withColumns({c: F.array_join(c, ", ") for c in ("metrics", "values")})


_GRAMS = "list_transform(range(1, len(w)-1), lambda i: array_to_string(w[i:i+2], ' '))"


@query(f"""SELECT doc_id, pkey, bad, row_number() OVER (PARTITION BY doc_id ORDER BY bad, surest) AS nth FROM (SELECT *, coalesce(list_max(list_transform(list_distinct(g), lambda x: len(list_filter(g, lambda y: y=x)))), 0)>=3 AS bad FROM
  (SELECT doc_id, pkey, surest, {_GRAMS} AS g FROM (SELECT doc_id, pkey, regexp_split_to_array(lower(trim(coalesce(quote,''))), '\\s+') AS w, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC NULLS LAST, pkey) AS surest FROM parameter) WHERE surest<=50))""")
def card_facts(s, d):
    """The facts on a document's card, good quotes first"""
    return coverage.card_facts(ad.parameter(s, d)).select("doc_id", "pkey", "bad", "nth")


def _strict():
    """A verifier for the query: it refuses what is over five and was returned."""

    def answer(questions):
        return [{"id": q["id"], "keep": not (q["metric"] == "R" and float(q["value"].lstrip("<=>").split("..")[0]) > 5)} for q in questions]

    return answer


@query("SELECT canon, metric, count(*) AS n FROM parameter WHERE NOT (source='grammar' AND metric='R' AND value_low>5) GROUP BY 1,2")
def verified_facts(s, d):
    """Facts judged in batches by a verifier, verdicts kept by content"""
    path = f"{_folder(s)}/verdicts"
    return verify.verified(s, ad.parameter(s, d), path, _strict).groupBy("canon", "metric").agg(F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL '7 days', CAST(extracted_at AS TIMESTAMP), TIMESTAMP '1970-01-01') AS start, count(*) AS facts, CAST(max(extracted_at) AS TIMESTAMP) AS last_extracted FROM parameter GROUP BY 1")
def stream_activity(s, d):
    """Facts by week of extraction, from a stream over lots with a restart between"""
    from factloom.plans.catalogue_flow import _in_lots

    folder = _folder(s)
    rows = ad.parameter(s, d).select("pkey", "doc_id", "extracted_at")

    def run(stream: DataFrame) -> None:
        pipelines.drain(pipelines.activity(stream, late="4000 days"), f"{folder}/state", sink=lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out"), mode="complete")

    _in_lots(s, rows, "pkey", folder, run)
    return s.read.parquet(f"{folder}/out").select(F.col("start").cast("timestamp_ntz").alias("start"), "facts", F.col("last_extracted").cast("timestamp_ntz").alias("last_extracted"))


@query("SELECT doc_id, lang, n_chars, md5(coalesce(text,'')) AS text FROM documents", plain=True)
def json_by_ranges(s, d):
    """Documents written as JSON lines, early versions and broken lines among them, and read back by byte ranges"""
    folder = _folder(s)
    docs = ad.table(s, d, "documents").select("doc_id", "lang", "n_chars", "text")
    early = docs.withColumn("text", F.lit("early")).select(F.to_json(F.struct("*")).alias("value"))
    whole = docs.select(F.to_json(F.struct("*")).alias("value"))
    broken = docs.select(F.concat(F.lit('{"doc_id": '), F.col("doc_id").cast("string"), F.lit(', "lang"')).alias("value"))
    early.write.text(f"{folder}/lines/1")
    whole.unionByName(broken).write.text(f"{folder}/lines/2")
    rows = lines.json_ranges(s, f"{folder}/lines", "doc_id long, lang string, n_chars long, text string", "doc_id", range_bytes=1 << 20)
    return rows.select("doc_id", "lang", "n_chars", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text"))


_GRID_SQL = """l AS (SELECT l_orderkey AS doc_id, l_linenumber AS line, max(CAST(l_quantity AS BIGINT)) AS q, max(CAST(round(l_discount*100) AS BIGINT)) AS lo, max(CAST(round((l_discount+l_tax)*100) AS BIGINT)) AS hi, max(CAST(round(l_tax*100) AS BIGINT)) AS t, max(CAST(l_extendedprice AS BIGINT)) AS price, max(l_returnflag) AS mode FROM lineitem GROUP BY 1,2)"""


@query(f"""WITH {_GRID_SQL}, n AS (SELECT *, CASE WHEN line%7=0 THEN 'Итого' WHEN line%2=0 THEN 'штейн ' || mode ELSE mode END AS label, CASE WHEN line%7<>0 AND line%2=0 THEN 'штейн' END AS phase FROM l)
SELECT doc_id, 'Cu' AS canon, '=' AS comparator, CAST(q AS DOUBLE) AS value_low, CAST(q AS DOUBLE) AS value_high, phase, label FROM n WHERE line%7<>0 AND q<=100
UNION ALL SELECT doc_id, 'Ni', '=', lo, hi, phase, label FROM n WHERE line%7<>0 UNION ALL SELECT doc_id, 'Fe', '<', NULL, t, phase, label FROM n WHERE line%7<>0
UNION ALL SELECT doc_id, 'S', '=', price, price, phase, label FROM n WHERE line%7<>0 AND price<=100""", plain=True)
def grid_facts_all(s, d):
    """Tables made of the lines of each order, half of them with the header in a column"""
    c = lambda x: F.col(x)
    whole = lambda x: F.round(x * 100).cast("long")
    lines = ad.table(s, d, "lineitem").groupBy(c("l_orderkey").alias("doc_id"), c("l_linenumber").cast("int").alias("line")).agg(
        F.max(c("l_quantity").cast("long")).alias("q"), F.max(whole(c("l_discount"))).alias("lo"), F.max(whole(c("l_discount") + c("l_tax"))).alias("hi"), F.max(whole(c("l_tax"))).alias("t"), F.max(c("l_extendedprice").cast("long")).alias("price"), F.max("l_returnflag").alias("mode")
    )
    label = F.when(c("line") % 7 == 0, "Итого").when(c("line") % 2 == 0, F.concat(F.lit("штейн "), "mode")).otherwise(c("mode"))
    cell = lambda at, text: F.struct(F.lit(at).alias("at"), text.cast("string").alias("text"))
    body = F.array(cell(0, label), cell(1, c("q")), cell(2, F.concat(c("lo").cast("string"), F.lit("-"), c("hi").cast("string"))), cell(3, F.concat(F.lit("< "), c("t").cast("string"))), cell(4, c("price")))
    heads = F.array(*[cell(i, F.lit(x)) for i, x in enumerate(["Продукт", "Сu, %", "Ni", "Fe", "S"])])
    rows = lines.select("doc_id", "line", F.explode(body).alias("x")).unionByName(lines.select("doc_id").distinct().select("doc_id", F.lit(0).alias("line"), F.explode(heads).alias("x")))
    turned = c("doc_id") % 2 == 0
    cells = rows.select("doc_id", F.lit(1).alias("table_no"), F.when(turned, c("x.at")).otherwise(c("line")).alias("r"), F.when(turned, c("line")).otherwise(c("x.at")).alias("c"), c("x.text").alias("text"))
    return tables.grid_facts(cells).select("doc_id", "canon", "comparator", "value_low", "value_high", "phase", "label")
