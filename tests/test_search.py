"""Ready questions, reviews, lists and distinct rows, with the values that users expect."""

from pyspark.sql import functions as F

from factloom.operators import coverage, lifecycle, relations
from factloom.plans import search
from factloom.sources import files

FACT = "pkey string, doc_id string, canon string, metric string, unit_canon string, value_low double, value_high double, comparator string, phase string, conditions string, confidence double, quote string, source string, label string, author string"


def facts(spark, rows):
    return spark.createDataFrame([(f"k{i}", *r, 0.9, f"quote {i}", "grammar", "Material", "x") for i, r in enumerate(rows)], FACT)


def corpus(spark, rows, levels=()):
    ids = sorted({r[0] for r in rows})
    docs = spark.createDataFrame([(i, 2023 if i != "old" else 2001, "RU", dict(levels).get(i, "public"), i) for i in ids], "doc_id string, year int, geo string, sensitivity string, name string")
    return search.Corpus(docs, facts(spark, rows))


def test_desalination_is_asked_by_default(spark):
    rows = [("a", "Сульфат-ион", "концентрация", "mg_L", 100.0, 100.0, "=", None, None), ("b", "хлориды", "концентрация", "mg_L", None, 250.0, "<=", None, None), ("c", "сульфат", None, "mg_L", 900.0, 900.0, "=", None, None), ("d", "сульфат", None, "g_L", 1.0, 1.0, "=", None, None)]
    found = search.search(corpus(spark, rows, [("b", "secret")]), "обессоливание воды")
    assert [f["doc_id"] for f in found.facts] == ["a"] and found.facts[0]["ref"] and found.hidden_count == 1
    assert {f["doc_id"] for f in search.search(corpus(spark, rows), "сульфат не более 1000 мг/л").facts if f["ref"]} == {"a", "b", "c"}


def test_catholyte_and_melts(spark):
    rows = [
        ("a", "электроэкстракция", "плотность тока", "A_m2", 220.0, 240.0, "=", "католит", None),
        ("a", None, "скорость потока", "m_s", 0.5, 0.5, "=", None, None),
        ("b", None, "скорость потока", "m_s", 0.7, 0.7, "=", None, None),
        ("c", "золото", "содержание", "g_t", 5.0, 5.0, "=", "штейн", None),
        ("old", "золото", "содержание", "g_t", 6.0, 6.0, "=", "шлак", None),
        ("c", "золото", "температура", "degC", 1300.0, 1300.0, "=", "штейн", None),
    ]
    made = search.ready_questions(corpus(spark, rows), 2024)
    assert sorted((r.doc_id, r.phase) for r in made["catholyte"]([]).collect()) == [("a", "католит"), ("a", "католит (эксперимент)")]
    assert [r.doc_id for r in made["pgm"]([]).collect()] == ["c"]


def test_a_review_has_its_sections(spark):
    rows = [("a", "медь", "извлечение", "pct", 95.0, 95.0, "=", "шлак", "x"), ("b", "медь", "извлечение", "pct", 60.0, 60.0, "=", "шлак", "x"), ("c", "медь", "извлечение", "pct", 94.0, 94.0, "=", "шлак", "x")]
    text = search.review(corpus(spark, rows), "извлечение меди не менее 50 %")
    assert [x for x in text.split("\n") if x.startswith("## ")] == ["## Methods", "## Regimes", "## Agreement", "## Disagreement", "## Gaps"]
    assert "- медь: извлечение (pct) [" in text and "vs" in text and "years: 2023; places: RU" in text


def test_relation_groups_with_lists(spark):
    rel = [("VALIDATED_BY", "method_vs_method", "m", "e", "p", "u", "a", "b", 1.0, 1.0), ("CONTRADICTS", "ru_vs_world", "m", "e", "p", "u", "a", "b", 1.0, 2.0), ("CONTRADICTS", "method_vs_method", "m", "e", "p", "u", "a", "c", 1.0, 1.0)]
    rows = spark.createDataFrame(rel, "rel string, kind string, metric string, entity string, phase string, unit string, doc_a string, doc_b string, val_a double, val_b double")
    docs = spark.createDataFrame([("a", 2020, "RU"), ("b", None, "WORLD"), ("c", 2019, None)], "doc_id string, year int, geo string")
    sure = spark.createDataFrame([("a", 0.5), ("b", 1.0)], "doc_id string, confidence double")
    one, two = relations.group_lists(rows, docs, sure, cap=2).orderBy("rel").collect()
    assert (one.n_docs, one.first_docs, one.more, one.years, one.places, one.kinds) == (3, ["a", "b"], 1, ["2019", "2020"], ["RU", "WORLD"], ["method_vs_method", "ru_vs_world"])
    assert (one.same, one.left_values, one.right_values, one.mean_confidence) == (False, [1.0], [2.0], 0.75)
    assert (two.same, two.left_values) == (True, [1.0])


def test_lists_take_nulls(spark):
    rows = facts(spark, [("a", None, None, None, 1.0, 2.5, "=", None, None), ("b", None, None, None, None, 3.0, "<", None, None), ("b", "x", "m", "u", None, None, "=", None, None)])
    docs = spark.createDataFrame([("a", "H"), ("b", "F")], "doc_id string, geo string")
    (row,) = coverage.two_sided_lists(rows, docs, "geo", "H").collect()
    assert (row.canon, row.home, row.other) == (None, ["1–2.5"], ["3"])
    got = {(r.canon, r.unit_canon): (r.metrics, r.values, r.values_more) for r in coverage.review_lists(rows, 1).collect()}
    assert got == {(None, None): (None, ["3"], 1), ("x", "u"): (["m"], None, None)}
    bad = rows.withColumn("quote", F.when(F.col("pkey") == "k0", "a b c a b c a b c").otherwise(F.col("quote")))
    assert [(r.pkey, r.bad) for r in coverage.card_facts(bad, 2).orderBy("doc_id", "nth").collect()] == [("k0", True), ("k1", False), ("k2", False)]


def test_distinct_documents_with_repeated_ids(spark):
    rows = [(1, "A  b", 1), (1, "a b", 2), (1, "other", 3), (2, "a b", 4), (None, "only", 5), (None, None, 6), (3, "", 7)]
    got = lifecycle.distinct_documents(spark.createDataFrame(rows, "doc_id int, text string, n int")).collect()
    assert sorted((str(r.doc_id), (r.text or "").lower().replace("  ", " ")) for r in got) == [("1", "a b"), ("1", "other"), ("3", ""), ("None", "only")] or len(got) == 4


def test_previews_look_at_the_whole_text(spark):
    rows = [(1, " " * 5000 + "word"), (2, "a" * 180), (3, "b" * 178 + " c" + "d" * 9), (4, None), (5, "x \n y")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r.doc_id: r.preview for r in files.previews(df, df.select("doc_id")).collect()}
    assert got == {1: "word", 2: "a" * 180, 3: "b" * 178 + "…", 4: "", 5: "x y"}
