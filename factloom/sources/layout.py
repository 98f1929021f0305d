"""Where rows lie on disk (K10, S15), and counts of what a load wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_PARTS = 64


def _part(metric: Column, unit: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(metric, unit), F.lit(parts)).cast("int")


def write_by_value(facts: DataFrame, path: str, keys: tuple[str, ...] = ("doc_id", "pkey"), distinct_keys: int = 1_000_000, parts: int = _PARTS) -> None:
    """Facts for searches by value: a folder for each hash of metric and unit, in it files by
    ranges of the lower bound, sorted, with Bloom filters of the keys. A range of one metric then
    opens one folder and reads the row groups whose bounds meet it; a look-up by key skips those
    whose filter does not know it."""
    rows = facts.withColumn("part", _part(F.col("metric"), F.col("unit_canon"), parts))
    order = ["part", "metric", "unit_canon", "value_low"]
    writer = rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("part")
    for key in keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", str(distinct_keys))
    writer.parquet(path)


def facts_between(spark: SparkSession, path: str, metric: str | None, unit: str | None, low: float | None = None, high: float | None = None, parts: int = _PARTS) -> DataFrame:
    """The facts of a metric and unit (null: those without) whose lower bound is in a range. The
    folder is known before anything is read."""
    number = spark.range(1).select(_part(F.lit(metric).cast("string"), F.lit(unit).cast("string"), parts).alias("part")).first().part
    rows = spark.read.parquet(path).filter(F.col("part") == number)
    for column, value in (("metric", metric), ("unit_canon", unit)):
        rows = rows.filter(F.col(column).isNull() if value is None else F.col(column) == value)
    if low is not None:
        rows = rows.filter(F.col("value_low") >= low)
    if high is not None:
        rows = rows.filter(F.col("value_low") <= high)
    return rows.drop("part")


def write_bucketed(tables: dict[str, DataFrame], folder: str, key: str = "doc_id", buckets: int = 64) -> None:
    """Tables that share buckets of a key, sorted by it: joins and groups by the key need no
    exchange. Names are those of the catalogue, files lie below `folder`."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", f"{folder}/{name}").saveAsTable(name)


def write_counted(rows: DataFrame, path: str, counters: dict[str, Column]) -> dict[str, int]:
    """Write rows and tell what was written, counted by the plan that writes: no second pass.
    counters: name -> aggregate; `rows` is added. Counts are those of the tasks that were accepted,
    so tries that failed do not count."""
    seen = Observation()
    counted = rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(name) for name, c in counters.items()])
    counted.write.mode("overwrite").parquet(path)
    return {name: value or 0 for name, value in seen.get.items()}
