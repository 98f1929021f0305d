"""Facts judged by an outside verifier, a few at a time.

Facts that need it (F29) are asked about once for each distinct content. A task makes one client
and puts `BATCH` facts to it at a time. A batch that fails, or an answer that leaves a fact out,
keeps the facts: a verifier that is away loses nothing. Verdicts are rows with the key of the fact's
content, so a run that is repeated asks only about what has no verdict yet.

Nulls and empty quotes are part of the content like any value. Equal facts share a verdict.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import facts as ops

BATCH = 12
CONTENT = ("canon", "label", "metric", "comparator", "value_low", "value_high", "unit_canon", "quote")
#: From a list of {id, canon, label, metric, value, unit, quote} to a list of {id, keep, reason}.
Client = Callable[[list[dict]], Iterable[dict]]


def content_key() -> Column:
    return F.md5(F.to_json(F.struct(*CONTENT), {"ignoreNullFields": "false"}).cast("binary"))


def _question(i: int, f: dict) -> dict:
    low, high = f["value_low"], f["value_high"]
    value = f"{low}..{high}" if low is not None and high is not None and low != high else str(low if low is not None else high)
    return {"id": i, "canon": f["canon"], "label": f["label"], "metric": f["metric"], "value": f"{f['comparator'] or '='}{value}", "unit": f["unit_canon"], "quote": " ".join((f["quote"] or "").split())[:400]}


def judged(client: Client, facts: list[dict]) -> list[tuple[bool, str | None, bool]]:
    """(keep, reason, answered) of each fact of a batch."""
    out: list[tuple[bool, str | None, bool]] = [(True, None, False)] * len(facts)
    try:
        answers = list(client([_question(i, f) for i, f in enumerate(facts)]))
    except Exception:  # noqa: BLE001 - any failure of an outside service keeps the batch
        return out
    for a in answers:
        if isinstance(a, dict) and isinstance(a.get("id"), int) and 0 <= a["id"] < len(facts):
            out[a["id"]] = bool(a.get("keep", True)), a.get("reason"), True
    return out


def verdicts(facts: DataFrame, make_client: Callable[[], Client], known: DataFrame | None = None, batch: int = BATCH) -> DataFrame:
    """(key, keep, reason, answered) of the facts that need one and have none in `known`."""
    rows = ops.needs_check(facts).select(content_key().alias("key"), *CONTENT).dropDuplicates(["key"])
    if known is not None:
        rows = rows.join(known.filter("answered").select("key"), "key", "left_anti")

    def run(batches):
        import pyarrow as pa

        client, waiting = None, []
        schema = pa.schema([("key", pa.string()), ("keep", pa.bool_()), ("reason", pa.string()), ("answered", pa.bool_())])

        def ask():
            nonlocal client
            try:
                client = client or make_client()
            except Exception:  # noqa: BLE001
                client = None
            told = judged(client, waiting) if client else [(True, None, False)] * len(waiting)
            return pa.RecordBatch.from_pylist([{"key": f["key"], "keep": k, "reason": r, "answered": a} for f, (k, r, a) in zip(waiting, told)], schema)

        for part in batches:
            for row in part.to_pylist():
                waiting.append(row)
                if len(waiting) == batch:
                    yield ask()
                    waiting.clear()
        if waiting:
            yield ask()

    return rows.mapInArrow(run, "key string, keep boolean, reason string, answered boolean")


def kept(facts: DataFrame, told: DataFrame) -> DataFrame:
    """The facts that no verdict refuses; one refusal counts, if a key was asked about twice."""
    refused = told.filter(~F.col("keep")).select(F.col("key").alias("_key")).distinct()
    need = F.coalesce(F.col("value_low").isNotNull() | F.col("value_high").isNotNull(), F.lit(False)) & F.coalesce(F.col("source").isin("grammar", "mention"), F.lit(False))
    return facts.withColumn("_content", F.when(need, content_key())).join(refused, F.col("_content") == F.col("_key"), "left_anti").drop("_content")


def verified(spark: SparkSession, facts: DataFrame, path: str, make_client: Callable[[], Client], batch: int = BATCH) -> DataFrame:
    """The kept facts; verdicts are appended to the table at `path`, and those there are not asked for
    again. Where the verifier did not answer, the next run asks."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    schema = "key string, keep boolean, reason string, answered boolean"
    known = spark.read.schema(schema).parquet(path) if there else None
    verdicts(facts, make_client, known, batch).write.mode("append").parquet(path)
    return kept(facts, spark.read.schema(schema).parquet(path))
