"""The corpus pipeline: documents in, token shards out.

Each stage is (name, function of (session, documents, folder of the tables)). All but the
last return rows with the columns of documents, whatever further columns there are and however
they are named; the last returns what stands in the shards.

Nulls, empties, ties: documents whose text is null or has no letter go in the first stage. Null
and repeated ids, null sources and languages are kept and are values like any other. Equal rows
are one document: one stays of them in the second stage. Of a group of near-duplicates the
smallest id stays, nulls first, then the smallest hash of the text. An empty table gives an
empty one in every stage, and no shard.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import session
from factloom.llm import common, decontam, langid, mixing, nearcopies, sstable
from factloom.llm import queries as q

#: A document is rejected if no language is predicted with at least this score.
LEAST_SCORE = 0.5


def _stage(f):
    """A stage may be called by itself: it prepares the session."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return f(session.attach(spark), docs, sf_dir)

    return run


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; texts that are null or without a letter go."""
    return langid.accepted(docs, q.language_model(spark, sf_dir), least_score=LEAST_SCORE)


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more.
    Null and wordless texts are one group; of equal rows one stays."""
    return nearcopies.deduplicated(docs)


@_stage
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; a text without words is clean."""
    return decontam.clean(docs, q.table(spark, sf_dir, "benchmark"))


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole number. A null source is a
    source of its own; documents without words go."""
    return mixing.repeated(docs)


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards, read back: one row per document, and per copy of it that the mix takes. Null ids
    come first, rows of one id stand together."""
    manifest = sstable.write(docs, common.run_folder(spark, "pipeline"), sstable.path_of("byte_bpe_50k.json"))
    return sstable.read(spark, manifest).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark),
    ("mixing sources to target weights", mix),
    ("token-ID output", tokens),
]

#: Neither fingerprints' anchors, code lengths nor tokenizer merges can be put in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = q.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", F.col("n_chars"))
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.materialise(docs, f"stage-{i}")
    return docs
