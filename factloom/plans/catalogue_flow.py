"""Queries of whole flows: extraction, search tracks, streams, curation, samples."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import session
from factloom.operators import facts, lifecycle
from factloom.plans import adapters as ad
from factloom.plans import extraction, search
from factloom.plans.catalogue import query
from factloom.plans.catalogue_text import ENTRIES
from factloom.sources import files, sinks
from factloom.streaming import pipelines, state


def _folder(spark: SparkSession) -> str:
    """A folder for a stream's state and output: in the cluster's shared one."""
    root = session.shared_root(spark)
    return f"{root.rstrip('/')}/factloom/stream-{uuid.uuid4().hex}"


TEXTS = [("d1", "Содержание меди в шлаке составило 0,6 %. При электроэкстракции меди выдержка от 60 до 80 °C давала осадок."), ("d2", "Извлечение никеля составляет 95,2 %. Рынок меди: рост на 10,1 % к 2011 г."), ("d3", None)]


@query(
    """SELECT * FROM (VALUES ('d1','медь','содержание','pct',0.6::DOUBLE,0.6::DOUBLE,'шлак'),('d1','электроэкстракция','температура','degC',60.0,80.0,NULL),('d2','никель','извлечение','pct',95.2,95.2,NULL)) t(doc_id,canon,metric,unit_canon,value_low,value_high,phase)""",
    plain=True,
    fixture=True,
)
def extract_facts(s, d):
    """Sentences, guards, grammar, dictionary, resolution, load gate"""
    rows = extraction.sentence_facts(s.createDataFrame(TEXTS, "doc_id string, text string"), ENTRIES)
    out = extraction.parameters(extraction.facts_of(rows), F.lit("2024-01-01").cast("timestamp"))
    return out.select("doc_id", "canon", "metric", "unit_canon", "value_low", "value_high", "phase")


@query("SELECT * FROM (VALUES ('электроэкстракция','медь','USES_MATERIAL','d1')) t(src,dst,type,doc_id)", plain=True, fixture=True)
def extract_edges(s, d):
    """J24 J25 K08"""
    rows = extraction.sentence_facts(s.createDataFrame(TEXTS, "doc_id string, text string"), ENTRIES)
    return extraction.edges_of(rows).select("src", "dst", "type", "doc_id")


@query("SELECT doc_id, lang FROM (VALUES ('a','ru'),('b','en'),('c',NULL)) t(doc_id,lang)", plain=True, fixture=True)
def document_meta(s, d):
    """S10 X17 X18 X24 M11"""
    rows = s.createDataFrame([("x/a.pdf", "Текст статьи"), ("x/b.docx", "A text"), ("x/c.xls", "12")], "path string, text string")
    return extraction.document_rows(rows).select(F.col("name").alias("doc_id"), "lang")


@query(
    """SELECT p.pkey, p.doc_id, p.confidence FROM parameter p JOIN document d USING (doc_id) WHERE d.sensitivity='public' AND d.year>=1998 AND lower(p.canon) IN ('brand#3','brand#4')
  ORDER BY p.confidence DESC NULLS LAST, p.doc_id, p.pkey LIMIT 10"""
)
def search_entity_track(s, d):
    """Access and filters before the top-k"""
    corpus = search.Corpus(ad.document(s, d), ad.parameter(s, d))
    return search.fact_track(corpus, "Brand", "external_partner", facts.normalised({"year": 1998}), ["Brand#3", "BRAND#4"]).select("pkey", "doc_id", "confidence")


@query("SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n FROM events GROUP BY 1,2", plain=True)
def stream_event_counts(s, d):
    """The same counts from a stream that is drained"""
    schema = ad.table(s, d, "events").schema
    stream = s.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    folder = _folder(s)
    counts = pipelines.event_counts(stream)
    pipelines.drain(counts, f"{folder}/state", sink=lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out"), mode="complete")
    return s.read.schema(counts.schema).parquet(f"{folder}/out").select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r=1", plain=True)
def stream_latest_per_key(s, d):
    """A keyed table that a stream keeps up to date"""
    schema = ad.table(s, d, "events").schema
    stream = s.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(d)
    folder = _folder(s)
    pipelines.drain(stream, f"{folder}/state", sink=pipelines.upsert_into(f"{folder}/out", ["user_id"], ["ts", "event_id"]))
    return pipelines.current(s, f"{folder}/out", schema).select("user_id", "event_id")


def _in_lots(spark: SparkSession, rows: DataFrame, key: str, folder: str, run, lots: int = 2, files: int = 3) -> None:
    """Write rows in lots of several files, in no order, and run a stream over what is there after
    each: it goes on from its checkpoint."""
    for i in range(lots):
        lot = rows.filter(F.pmod(F.xxhash64(key), F.lit(lots)) == i)
        lot.repartition(files, F.xxhash64(key, F.lit(7))).write.mode("append").parquet(f"{folder}/in")
        run(pipelines.table_stream(spark, f"{folder}/in", rows.schema, 1))


@query("""SELECT user_id AS user, 'type ' || event_type AS query, count(DISTINCT CASE WHEN v.ts>u.last_seen THEN v.event_id END) AS new FROM
  (SELECT user_id, min(ts) AS last_seen FROM events WHERE event_type='signup' GROUP BY 1) u JOIN (SELECT event_id, event_type, ts FROM events WHERE event_type IN ('error','purchase')) v ON true WHERE v.ts>u.last_seen GROUP BY 1,2""", plain=True)
def stream_subscriptions(s, d):
    """What subscription_new tells, from state per user and query, over lots with a restart between"""
    events = ad.table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    kinds = s.createDataFrame([("type error",), ("type purchase",)], "query string")
    subs = events.filter("event_type = 'signup'").groupBy(F.col("user_id").alias("user")).agg(F.min("ts").alias("last_seen")).join(F.broadcast(kinds))
    hits = events.filter("event_type in ('error', 'purchase')").select(F.concat(F.lit("type "), F.col("event_type")).alias("query"), F.col("event_id").alias("doc_id"), F.col("ts").alias("at"))
    folder = _folder(s)
    subs.write.parquet(f"{folder}/subscriptions")
    known = s.read.parquet(f"{folder}/subscriptions")
    sink = pipelines.upsert_into(f"{folder}/out", ["user", "query"], ["new"], buckets=8)
    schema = []

    def run(stream: DataFrame) -> None:
        out = state.novelties(stream, known)
        schema.append(out.schema)
        pipelines.drain(out, f"{folder}/state", sink=sink, mode="update")

    _in_lots(s, hits, "doc_id", folder, run)
    return pipelines.current(s, f"{folder}/out", schema[0]).filter("new > 0").select("user", "query", "new")


@query("""SELECT a.pkey, 1+count(b.pkey) AS version FROM (SELECT doc_id,canon,metric,conditions,pkey,max(extracted_at) AS t FROM parameter GROUP BY ALL) a LEFT JOIN (SELECT doc_id,canon,metric,conditions,pkey,max(extracted_at) AS t FROM parameter GROUP BY ALL) b
  ON a.doc_id=b.doc_id AND a.canon=b.canon AND a.metric=b.metric AND a.conditions IS NOT DISTINCT FROM b.conditions AND b.t<a.t GROUP BY a.doc_id,a.canon,a.metric,a.conditions,a.pkey,a.t""")
def stream_versions(s, d):
    """What supersedes_versions tells, from chains in state, over lots with a restart between"""
    rows = ad.parameter(s, d).select(*lifecycle.SLOT, "pkey", "extracted_at")
    folder, schema = _folder(s), []
    sink = pipelines.upsert_into(f"{folder}/out", ["slot", "pkey"], ["version"], buckets=8)

    def run(stream: DataFrame) -> None:
        out = state.versions(stream, buckets=32)
        schema.append(out.schema)
        pipelines.drain(out, f"{folder}/state", sink=sink, mode="update")

    _in_lots(s, rows, "pkey", folder, run)
    return state.chains(pipelines.current(s, f"{folder}/out", schema[0]), dict(rows.dtypes)).select("pkey", "version")


@query("SELECT pkey, count(*) AS n FROM parameter GROUP BY 1 HAVING count(*)>1")
def key_violations(s, d):
    """What a uniqueness constraint would refuse"""
    return sinks.violations(ad.parameter(s, d), ["pkey"]).select("pkey", "n")


@query("SELECT doc_id, CASE WHEN length(p)>180 THEN rtrim(substr(p,1,179)) || '…' ELSE p END AS preview FROM (SELECT doc_id, trim(regexp_replace(text,'[\\s\\v]+',' ','g')) AS p FROM (SELECT doc_id, text FROM documents ORDER BY n_chars DESC, doc_id LIMIT 15))", plain=True)
def previews(s, d):
    """Of the documents that a list shows, here the longest"""
    docs = ad.table(s, d, "documents")
    return files.previews(docs, docs.orderBy(F.col("n_chars").desc(), "doc_id").limit(15).select("doc_id"))


@query("SELECT d.doc_id, d.lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents k WHERE k.source='src0' AND md5(k.text)=md5(d.text)) AND d.source<>'src0'", plain=True)
def upload_duplicates(s, d):
    """Of one lot of uploads those that another lot does not hold"""
    docs = ad.table(s, d, "documents")
    return lifecycle.not_known(docs.filter("source <> 'src0'"), docs.filter("source = 'src0'"), F.md5(F.col("text").cast("binary"))).select("doc_id", "lang")


@query()
def audit_sample(s, d):
    """The same sample at every run"""
    return files.audit_sample(ad.parameter(s, d).select("pkey", "doc_id", "canon").distinct(), 100)


@query("SELECT count(*) AS rows, count(DISTINCT source) AS parts FROM parameter")
def union_of_tracks(s, d):
    """S13 U01"""
    p = ad.parameter(s, d)
    both: DataFrame = files.union_of_facts(p.filter("source = 'grammar'"), p.filter("source <> 'grammar'").drop("quote"))
    return both.agg(F.count("*").alias("rows"), F.countDistinct("source").alias("parts"))


@query("SELECT p.pkey, least(p.value_low*1.0, p.value_high-3) AS value_low, greatest(p.value_low, p.value_high-3) AS value_high FROM parameter p WHERE canon='Brand#13'", fixture=True)
def swapped_bounds(s, d):
    """K07"""
    rows = ad.parameter(s, d).filter("canon = 'Brand#13'").withColumn("value_high", F.col("value_high") - 3)
    return lifecycle.swapped(rows).select("pkey", "value_low", "value_high")


@query("SELECT p.pkey, least(p.value_low*1.0, p.value_high-3) AS value_low, greatest(p.value_low, p.value_high-3) AS value_high FROM parameter p")
def swapped_bounds_all(s, d):
    """Of all facts"""
    rows = ad.parameter(s, d).withColumn("value_high", F.col("value_high") - 3)
    return lifecycle.swapped(rows).select("pkey", "value_low", "value_high")
