"""Layouts, counters, containment, dictionary joins, maintained counts, table functions."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import registry
from factloom.operators import contain, coverage, graphs
from factloom.plans import adapters, dictionary
from factloom.sources import layout

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_range_opens_one_folder_and_some_row_groups(spark, tmp_path):
    path = f"file://{tmp_path}/facts"
    facts = adapters.parameter(spark, FOLDER)
    odd = facts.limit(3).withColumns({"metric": F.lit(None).cast("string"), "unit_canon": F.lit("")})
    layout.write_by_value(facts.unionByName(odd), path, parts=8)
    got = layout.facts_between(spark, path, "A", "F", 2, 4, parts=8)
    assert got.count() == facts.filter("metric = 'A' and unit_canon = 'F' and value_low between 2 and 4").count() > 0
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    told = plan(layout.facts_between(spark, path, "A", "F", 2, 4, parts=8))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PartitionFilters: [isnotnull(part" in told and "GreaterThanOrEqual(value_low,2.0)" in told
    assert layout.facts_between(spark, path, None, "", parts=8).count() == 3
    assert layout.facts_between(spark, path, "none", None, parts=8).count() == 0


def test_tables_in_the_same_buckets_join_without_exchange(spark, tmp_path):
    tables = {"bucketed_facts": adapters.parameter(spark, FOLDER), "bucketed_documents": adapters.document(spark, FOLDER)}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        layout.write_bucketed(tables, f"file://{tmp_path}", buckets=4)
        out = spark.table("bucketed_facts").join(spark.table("bucketed_documents"), "doc_id").groupBy("doc_id").count()
        assert "Exchange" not in plan(out) and "SortMergeJoin" in plan(out)
        assert out.count() == tables["bucketed_facts"].select("doc_id").distinct().count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in tables:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_counters_are_those_of_what_was_written(spark, tmp_path):
    path = f"file://{tmp_path}/facts"
    rows = adapters.parameter(spark, FOLDER).repartition(5, "canon").join(adapters.document(spark, FOLDER).select("doc_id", "year"), "doc_id")
    told = layout.write_counted(rows, path, {"vision": F.count_if(F.col("source") == "vision_ocr"), "years": F.sum("year")})
    back = spark.read.parquet(path)
    assert told == {"rows": back.count(), "vision": back.filter("source = 'vision_ocr'").count(), "years": back.agg(F.sum("year")).first()[0]}
    assert layout.write_counted(rows.limit(0), f"{path}-none", {"years": F.sum("year")}) == {"rows": 0, "years": 0}


def test_containment_by_grams(spark):
    texts = ["copper matte", "nickel", "ni", "", None, "аб", "copper matte"]
    needles = ["matte", "ni", "n", "", "б", "zinc", "matt e", None, "copper matte and more", "ck"]
    made = contain.containing(spark.createDataFrame([(x,) for x in texts], "text string"), spark.createDataFrame([(x,) for x in needles], "needle string"))
    want = {(n, t) for n in needles if n is not None for t in texts if t is not None and n in t}
    rows = [(r.needle, r.text) for r in made.collect()]
    assert set(rows) == want and len(rows) == len(want)
    none = spark.createDataFrame([], "needle string")
    assert contain.containing(spark.createDataFrame([("a",)], "text string"), none).collect() == []


def test_gaps_are_found_without_a_nested_loop(spark):
    lists = [spark.createDataFrame([(x,) for x in xs], "canon string") for xs in (["Gold", "brand#1", "slag"], ["matte", "BRAND#2"])]
    facts = spark.createDataFrame([("Brand#12",), ("Brand#2",), (None,)], "canon string")
    out = coverage.combination_gaps(*lists, facts)
    assert sorted(map(tuple, out.collect())) == [("Gold", "matte"), ("slag", "matte")]
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    assert coverage.combination_gaps(lists[0], lists[1].limit(0), facts).collect() == []


def test_mentions_by_joins(spark):
    docs = spark.createDataFrame([(1, "Heap leaching of copper-nickel ore; HEAP leaching."), (2, None), (3, ""), (4, "copper copper nickel")], "doc_id long, text string")
    aliases = spark.createDataFrame([("leaching", "leaching", 1), ("heap leaching", "Heap leaching", 0), ("Cu", "copper", 0), ("Zz", "copper", 0), ("CuNi", "copper nickel", 1), ("ore body", "nickel ore body", 0), ("none", "--", 0), ("Ni", "nickel", 5)], "canon string, alias string, tier int")
    got = sorted(map(tuple, dictionary.mentions(docs, aliases).collect()))
    assert got == [(1, 0, 2, "heap leaching"), (1, 3, 2, "CuNi"), (1, 6, 2, "heap leaching"), (4, 0, 1, "Cu"), (4, 1, 2, "CuNi")]
    assert dictionary.mentions(docs, aliases.limit(0)).collect() == []
    assert "Python" not in plan(dictionary.mentions(docs, aliases)) and "Arrow" not in plan(dictionary.mentions(docs, aliases))


def test_counts_kept_up_equal_counts_at_once(spark):
    edges = [("a", "d1"), ("b", "a"), ("c", "b"), ("b", "d2"), ("d1", "d2"), ("e", "d3"), ("a", "e"), ("a", "d1")]
    schema = "src string, dst string, type string"
    frame = lambda xs: spark.createDataFrame([(*x, "T") for x in xs], schema)
    docs = spark.createDataFrame([("d1",), ("d2",), ("d3",)], "doc_id string")
    counts = spark.createDataFrame([], "node string, source_count long")
    for i in range(0, len(edges), 2):
        counts = graphs.counts_changed(counts, graphs.document_count_changes(frame(edges[:i]), frame(edges[i : i + 2]), docs))
        counts = spark.createDataFrame(counts.collect(), "node string, source_count long")
        want = graphs.document_counts(frame(edges[: i + 2]), docs)
        assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, want.collect()))
    assert graphs.document_count_changes(frame(edges), frame(edges[:1]), docs).collect() == []


def test_segments_as_a_table_function(spark):
    assert registry.register_table_functions(spark) == ["segments"]
    spark.createDataFrame([("u", 2, 8, False), ("u", 1, 9, False), ("u", 3, 7, True), ("u", 4, 5, False), ("v", 1, 1, True), (None, 1, 3, None)], "owner string, place int, item long, starts boolean").createOrReplaceTempView("rows_of_segments")
    got = spark.sql("SELECT * FROM segments(TABLE(rows_of_segments) PARTITION BY owner ORDER BY place)").collect()
    assert sorted(map(tuple, got), key=str) == [("u", 0, 2, 8), ("u", 1, 2, 5), ("v", 1, 1, 1), (None, 0, 1, 3)]


@pytest.mark.parametrize("size", [0, 1, 3])
def test_grams_are_distinct(spark, size):
    (row,) = spark.createDataFrame([("abab",)], "t string").select(contain._grams(F.col("t"), size).alias("g")).collect()
    assert row.g == {0: [""], 1: ["a", "b"], 3: ["aba", "bab"]}[size]
