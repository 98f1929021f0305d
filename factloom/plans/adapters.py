"""Documents, facts, authors and domains read off the star schema, in Spark and in SQL.

The star schema has no facts of its own; an order is taken for a document and a line for a
fact, so that every operator has rows of realistic shape and skew to work on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the region of their customer."""
    t = lambda n: table(spark, sf_dir, n)
    place = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    customers = t("customer").join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name", "c_name", "c_mktsegment")
    level = F.when(F.col("o_orderstatus") == "F", "public").when(F.col("o_orderstatus") == "O", "internal").otherwise("secret")
    rows = t("orders").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select(
        F.col("o_orderkey").alias("doc_id"),
        F.concat(F.coalesce("c_name", F.lit("")), F.lit(" "), F.coalesce("c_mktsegment", F.lit(""))).alias("name"),
        F.year("o_orderdate").alias("year"),
        F.col("r_name").alias("geo"),
        level.alias("sensitivity"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("kg_value"),
        F.col("c_mktsegment").alias("doc_type"),
    )


def parameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their part."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_name", "p_size")
    line = table(spark, sf_dir, "lineitem")
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    low = F.round(F.col("l_discount") * 100, 0) + F.lit(0.0)
    phase = F.when(F.col("p_size") % 3 == 0, "solid").when(F.col("p_size") % 3 == 1, "liquid")
    out = rows.select(
        F.col("l_orderkey").alias("doc_id"),
        F.col("p_brand").alias("canon"),
        F.col("p_type").alias("label"),
        F.col("l_returnflag").alias("metric"),
        F.col("l_linestatus").alias("unit_canon"),
        low.alias("value_low"),
        (low + F.round(F.col("l_tax") * 100, 0)).alias("value_high"),
        F.round(1 - F.col("l_tax"), 2).alias("confidence"),
        F.when(F.col("l_linenumber") % 5 == 0, "<=").otherwise("=").alias("comparator"),
        phase.alias("phase"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("q"), (F.col("l_quantity").cast("int") % 5).cast("string"))).alias("conditions"),
        F.when(F.col("l_quantity") > 25, "vision_ocr").otherwise("grammar").alias("source"),
        F.col("p_name").alias("quote"),
        F.col("l_shipdate").alias("extracted_at"),
        F.col("l_suppkey").alias("author"),
    )
    whole = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "canon", "label", "metric", "unit_canon")]
    whole += [F.col(c).cast("long").cast("string") for c in ("value_low", "value_high")]
    whole += [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("phase", "conditions", "source", "author")]
    return out.withColumn("pkey", F.md5(F.concat_ws("|", *whole, F.date_format("extracted_at", "yyyy-MM-dd")).cast("binary")))


def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("author")).distinct()


def domains(parameters: DataFrame) -> DataFrame:
    return parameters.select("doc_id", F.col("label").alias("domain")).distinct()


SQL = """
document AS (
  SELECT o_orderkey AS doc_id, coalesce(c_name,'') || ' ' || coalesce(c_mktsegment,'') AS name, CAST(year(o_orderdate) AS INTEGER) AS year, r_name AS geo,
    CASE o_orderstatus WHEN 'F' THEN 'public' WHEN 'O' THEN 'internal' ELSE 'secret' END AS sensitivity,
    CAST(substr(o_orderpriority,1,1) AS INTEGER) AS kg_value, c_mktsegment AS doc_type
  FROM orders LEFT JOIN (customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey) ON o_custkey=c_custkey),
parameter0 AS (
  SELECT l_orderkey AS doc_id, p_brand AS canon, p_type AS label, l_returnflag AS metric, l_linestatus AS unit_canon,
    round(l_discount*100,0)+0.0::DOUBLE AS value_low, round(l_discount*100,0)+0.0::DOUBLE+round(l_tax*100,0) AS value_high,
    round(1-l_tax,2) AS confidence, CASE WHEN l_linenumber%5=0 THEN '<=' ELSE '=' END AS comparator,
    CASE p_size%3 WHEN 0 THEN 'solid' WHEN 1 THEN 'liquid' END AS phase,
    CASE WHEN l_linenumber%2=0 THEN 'q' || CAST(CAST(trunc(l_quantity) AS INTEGER)%5 AS VARCHAR) END AS conditions,
    CASE WHEN l_quantity>25 THEN 'vision_ocr' ELSE 'grammar' END AS source, p_name AS quote, l_shipdate AS extracted_at, l_suppkey AS author
  FROM lineitem JOIN part ON l_partkey=p_partkey),
parameter AS (
  SELECT *, md5(concat_ws('|', CAST(doc_id AS VARCHAR), coalesce(canon,''), coalesce(label,''), coalesce(metric,''), coalesce(unit_canon,''),
    CAST(CAST(value_low AS BIGINT) AS VARCHAR), CAST(CAST(value_high AS BIGINT) AS VARCHAR), coalesce(phase,''), coalesce(conditions,''), source,
    CAST(author AS VARCHAR), strftime(extracted_at,'%Y-%m-%d'))) AS pkey FROM parameter0),
authors AS (SELECT DISTINCT l_orderkey AS doc_id, l_suppkey AS author FROM lineitem),
domains AS (SELECT DISTINCT doc_id, label AS domain FROM parameter)
"""


def with_views(sql: str, *more: str) -> str:
    """The oracle's text: the adapters, further named queries, and the query."""
    return "WITH " + ",\n".join([SQL.strip(), *more]) + "\n" + sql.strip()
