"""A keyword index that grows by segments (K13, S17, A19, J29): postings, signed counts of documents
per word, and marks of documents.

A batch of documents is one segment of three Parquet tables, each a partition `segment=number`:

* postings (lemma, doc_id, tf), by ranges of words, so that a search reads the row groups of its
  words only;
* terms (lemma, delta): how many documents more (or fewer) hold the word since then; their sum is
  the document frequency, without a look at postings;
* documents (doc_id, deleted): the latest mark of a document counts. Postings of a segment that is
  not its document's latest are dead.

What a batch replaces or deletes is taken off in the batch's own terms. Frequencies, their limits
and the idf are worked out when the index is read, so five batches give what one gives. A batch
that runs again reads the segments before its own and writes its partition anew. `compacted` writes
all segments as one in another folder.

Nulls, empties, ties: documents without an id are left out; a null or blank text is a document
without words. Of rows with one id in a batch the greatest text counts. Deleting what is not there
does nothing. An empty batch writes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import retrieval

_TABLES = {"postings": "lemma string, doc_id {id}, tf long", "terms": "lemma string, delta long", "documents": "doc_id {id}, deleted boolean"}


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _read(spark: SparkSession, path: str, name: str, kind: str, before: int | None = None) -> DataFrame:
    schema = f"{_TABLES[name].format(id=kind)}, segment int"
    if not _exists(spark, f"{path}/{name}"):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(f"{path}/{name}")
    return rows if before is None else rows.filter(F.col("segment") < before)


def _write(rows: DataFrame, path: str, name: str, segment: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/{name}/segment={segment}")


def _latest(documents: DataFrame) -> DataFrame:
    """(doc_id, segment, deleted): each document's latest mark."""
    return documents.groupBy("doc_id").agg(F.max(F.struct("segment", "deleted")).alias("m")).select("doc_id", "m.segment", "m.deleted")


def _replace(spark: SparkSession, path: str, segment: int, touched: DataFrame, new: DataFrame, kind: str) -> None:
    """Write a segment: marks of the touched documents (doc_id, deleted), new postings, and the
    signed counts of both."""
    live = _latest(_read(spark, path, "documents", kind, segment)).filter(~F.col("deleted"))
    gone = live.join(touched.select("doc_id"), "doc_id", "left_semi")
    old = _read(spark, path, "postings", kind, segment).join(gone.select("doc_id", "segment"), ["doc_id", "segment"], "left_semi")
    terms = new.select("lemma", F.lit(1).alias("delta")).unionByName(old.select("lemma", F.lit(-1).alias("delta")))
    terms = terms.groupBy("lemma").agg(F.sum("delta").alias("delta")).filter("delta <> 0")
    _write(new.repartitionByRange("lemma", "doc_id").sortWithinPartitions("lemma", "doc_id"), path, "postings", segment)
    _write(terms.repartitionByRange("lemma").sortWithinPartitions("lemma"), path, "terms", segment)
    _write(touched.select("doc_id", "deleted"), path, "documents", segment)  # last: without marks a segment is not there


def add(path: str, batch: DataFrame, segment: int, id_col: str = "doc_id", text_col: str = "text", pattern: str = retrieval.TOKEN) -> None:
    """Index a batch of documents as segment `segment`, greater than those before; what it holds of a
    document replaces what was indexed of it."""
    spark, kind = batch.sparkSession, batch.schema[id_col].dataType.simpleString()
    rows = batch.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    rows = rows.groupBy("doc_id").agg(F.max("text").alias("text")).persist()
    try:
        words = rows.select("doc_id", F.explode(retrieval.tokens(F.col("text"), pattern)).alias("lemma"))
        tf = words.groupBy("lemma", "doc_id").agg(F.count("*").alias("tf"))
        _replace(spark, path, segment, rows.select("doc_id", F.lit(False).alias("deleted")), tf, kind)
    finally:
        rows.unpersist()


def delete(path: str, ids: DataFrame, segment: int) -> None:
    """Mark the documents of `ids` (doc_id) as deleted, as segment `segment`."""
    spark, kind = ids.sparkSession, ids.schema["doc_id"].dataType.simpleString()
    touched = ids.select("doc_id").filter("doc_id is not null").distinct().withColumn("deleted", F.lit(True))
    none = _read(spark, path, "postings", kind).select("lemma", "doc_id", "tf").limit(0)
    _replace(spark, path, segment, touched, none, kind)


def size(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(n): the number of documents, one row."""
    return _latest(_read(spark, path, "documents", kind)).agg(F.count_if(~F.col("deleted")).alias("n"))


def _wanted(df: Column, n: Column, most_share: float, longest_hapax: int) -> Column:
    return (df > 0) & (df <= F.greatest(F.lit(2.0), most_share * n)) & ~((df == 1) & (F.length("lemma") > longest_hapax))


def postings(spark: SparkSession, path: str, kind: str = "bigint", terms: list[str] | None = None, most_share: float = 0.30, longest_hapax: int = 25) -> DataFrame:
    """(lemma, doc_id, tf, df), as `retrieval.postings` gives them on all documents at once; of some
    words only, if `terms` are given. Words meet their frequency by the word; a word of many
    documents is limited by `most_share` before that."""
    rows, counts = _read(spark, path, "postings", kind), _read(spark, path, "terms", kind)
    if terms is not None:
        some = sorted(set(terms))
        rows, counts = rows.filter(F.col("lemma").isin(some)), counts.filter(F.col("lemma").isin(some))
    df = counts.groupBy("lemma").agg(F.sum("delta").alias("df"))
    kept = df.crossJoin(F.broadcast(size(spark, path, kind))).filter(_wanted(F.col("df"), F.col("n"), most_share, longest_hapax)).select("lemma", "df")
    live = _latest(_read(spark, path, "documents", kind)).filter(~F.col("deleted")).select("doc_id", "segment")
    return rows.join(kept, "lemma").join(live, ["doc_id", "segment"], "left_semi").select("lemma", "doc_id", "tf", "df")


def search(spark: SparkSession, path: str, terms: list[str], k: int = 8, kind: str = "bigint") -> DataFrame:
    """The best documents, by frequencies as they are now."""
    return retrieval.keyword_search(postings(spark, path, kind, terms), size(spark, path, kind), terms, k)


def compacted(spark: SparkSession, path: str, into: str, kind: str = "bigint") -> None:
    """All segments as one, in another folder: live postings, summed counts, documents that are there."""
    documents = _latest(_read(spark, path, "documents", kind)).filter(~F.col("deleted"))
    last = _read(spark, path, "documents", kind).agg(F.max("segment").alias("s")).first().s or 0
    rows = _read(spark, path, "postings", kind).join(documents.select("doc_id", "segment"), ["doc_id", "segment"], "left_semi").select("lemma", "doc_id", "tf")
    terms = _read(spark, path, "terms", kind).groupBy("lemma").agg(F.sum("delta").alias("delta")).filter("delta <> 0")
    _write(rows.repartitionByRange("lemma", "doc_id").sortWithinPartitions("lemma", "doc_id"), into, "postings", last)
    _write(terms.repartitionByRange("lemma").sortWithinPartitions("lemma"), into, "terms", last)
    _write(documents.select("doc_id", F.lit(False).alias("deleted")), into, "documents", last)

