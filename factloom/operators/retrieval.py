"""Keyword index and search, vector search, suggestions, the document library
(A19, J28-J29, J31, F25-F26, F31, J18-J19, T05, T09-T10, W04-W05, M07-M08)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = r"[а-яёa-z]{4,}"


def tokens(text: Column, pattern: str = TOKEN) -> Column:
    """Lower-case words of four letters and more."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({pattern})"), 1)


def postings(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id", most_share: float = 0.30, longest_hapax: int = 25, pattern: str = TOKEN) -> DataFrame:
    """(lemma, doc_id, tf, df). Words in more than max(2, share of the documents) go, and
    long words that occur once. Term counts are partial before the shuffle; the number of documents
    is one row."""
    tf = documents.select(F.col(id_col).alias("doc_id"), F.explode(tokens(F.col(text_col), pattern)).alias("lemma")).groupBy("lemma", "doc_id").agg(F.count("*").alias("tf"))
    df = tf.groupBy("lemma").agg(F.count("*").alias("df"))
    n = documents.agg(F.count("*").alias("n"))
    kept = df.crossJoin(F.broadcast(n)).filter(F.col("df") <= F.greatest(F.lit(2.0), most_share * F.col("n")))
    kept = kept.filter(~((F.col("df") == 1) & (F.length("lemma") > longest_hapax))).select("lemma", "df")
    return tf.join(kept, "lemma")


def keyword_search(index: DataFrame, n_documents: DataFrame, terms: list[str], k: int = 8) -> DataFrame:
    """Documents by the sum over query terms of ln(n / df) * ln(1 + tf)."""
    hits = index.filter(F.col("lemma").isin(sorted(set(terms)))).crossJoin(F.broadcast(n_documents.select("n")))
    score = F.sum(F.log(F.col("n") / F.col("df")) * F.log1p("tf"))
    return hits.groupBy("doc_id").agg(F.round(score, 2).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(k)


def dot(a: Column, b: Column) -> Column:
    """M08."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_scores(vectors: DataFrame, query: list[float], vector_col: str = "embedding") -> DataFrame:
    """Adds the cosine with a query, in numpy over Arrow batches: one matrix product."""
    import numpy as np

    q = np.asarray(query, np.float64)
    q = q / (np.linalg.norm(q) or 1.0)
    at = vectors.columns.index(vector_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column(at)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            sizes = np.diff(column.offsets.to_numpy())
            score = np.full(len(column), np.nan)
            full = sizes == len(q)  # null and odd vectors have no score
            if full.any():
                matrix = flat.reshape(-1, len(q)) if full.all() else np.stack([x for x in column.to_pylist() if x is not None and len(x) == len(q)]).astype(np.float64)
                norm = np.linalg.norm(matrix, axis=1)
                score[full] = matrix @ q / np.where(norm == 0, 1, norm)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, from_pandas=True)], [*batch.schema.names, "score"])

    return vectors.mapInArrow(run, T.StructType([*vectors.schema.fields, T.StructField("score", T.DoubleType())]))


def vector_topk(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", floor: float | None = None) -> DataFrame:
    """J28, T09, F26."""
    rows = vector_scores(vectors, query)
    if floor is not None:
        rows = rows.filter(F.col("score") >= floor)
    return rows.select(id_col, "score").orderBy(F.col("score").desc_nulls_last(), id_col).limit(k)


def best_chunk(chunks: DataFrame, group: str, id_col: str) -> DataFrame:
    """Per group the best score and where it is."""
    best = F.max_by(id_col, F.struct("score", -F.col(id_col)))
    return chunks.groupBy(group).agg(best.alias(id_col), F.max("score").alias("score"))


def chunk_cap(chunks: DataFrame, per_document: int = 15, overall: int = 4000) -> DataFrame:
    """The first chunks of each document; of these the best documents' first. Chunks have
    (doc_id, kg_value, chunk_no)."""
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_no"))
    rows = chunks.withColumn("_nth", nth).filter(F.col("_nth") <= per_document).drop("_nth")
    return rows.orderBy(F.col("kg_value").desc_nulls_last(), "doc_id", "chunk_no").limit(overall)


def suggestions(entities: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """Entities (canon, forms, source_count) of which a form holds the text; forms
    that start with it first."""
    q = prefix.lower()
    forms = F.filter("forms", lambda f: F.contains(F.lower(f), F.lit(q)))
    rows = entities.withColumn("form", F.get(forms, F.lit(0))).filter("form is not null")
    rows = rows.withColumn("rank", F.when(F.startswith(F.lower("form"), F.lit(q)), 0).otherwise(1))
    return rows.orderBy("rank", "canon").limit(limit).select("canon", "form", "rank", "source_count")


def library(documents: DataFrame, facts: DataFrame, words: str = "", year_from: int | None = None, year_to: int | None = None, doc_type: str | None = None, lang: str | None = None, sensitivity: str | None = None, author_docs: DataFrame | None = None, sort: str = "relevance", offset: int = 0, limit: int = 20) -> DataFrame:
    """The list of documents, all words in the name or the author's documents,
    with their number of facts and mean confidence; one page of it."""
    rows = documents
    for part in words.lower().split():
        held = F.contains(F.lower("name"), F.lit(part))
        rows = rows.withColumn("_held", F.coalesce(F.col("_held"), F.lit(True)) & held) if "_held" in rows.columns else rows.withColumn("_held", held)
    if "_held" in rows.columns:
        if author_docs is not None:
            own = author_docs.select(F.col("doc_id").alias("_author")).distinct()
            rows = rows.join(own, F.col("doc_id") == F.col("_author"), "left").filter(F.col("_held") | F.col("_author").isNotNull()).drop("_author")
        else:
            rows = rows.filter("_held")
        rows = rows.drop("_held")
    if year_from is not None:
        rows = rows.filter(F.col("year") >= year_from)
    if year_to is not None:
        rows = rows.filter(F.col("year") <= year_to)
    for column, value in (("doc_type", doc_type), ("sensitivity", sensitivity)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    if lang is not None:
        rows = rows.filter(F.lower("lang") == lang.lower())
    counted = facts.groupBy("doc_id").agg(F.count("*").alias("fact_count"), F.round(F.avg("confidence"), 6).alias("confidence"))
    rows = rows.join(counted, "doc_id", "left").withColumn("fact_count", F.coalesce("fact_count", F.lit(0)))
    order = [F.coalesce("year", F.lit(0)).desc()] if sort == "date" else [F.col("fact_count").desc()]
    return rows.orderBy(*order, "doc_id").offset(offset).limit(limit)
