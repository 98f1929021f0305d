"""The sample that the language model is fitted on."""

import pytest

from factloom.llm import langid

SCHEMA = "doc_id long, text string, lang string, key string"
EN, DE = "the house stands near the water and the people there ", "das Haus steht nahe am Wasser und die Leute dort "


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "k") for r in rows], SCHEMA).repartition(4)


def test_one_id_many_equal_rows(spark):
    model = langid.fit(rows_of(spark, [(7, EN, "en")] * 5000), per_language=10)
    assert model.languages == ["en"]


def test_repeated_and_distinct_ids(spark):
    rows = [(i, EN + str(i), "en") for i in range(3000)] + [(9, DE, "de")] * 5000
    df = rows_of(spark, rows)
    model = langid.fit(df, per_language=20)
    assert model.languages == ["de", "en"]
    got = langid.predict(df, model).groupBy("lang_pred").count().collect()
    assert {r.lang_pred: r["count"] for r in got} == {"de": 5000, "en": 3000}


def test_one_id_of_different_texts_stays_bounded(spark):
    rows = [(1, f"{EN} {i}", "en") for i in range(4000)] + [(i, f"{DE} {i}", "de") for i in range(5)] + [(None, "hola", "es"), (3, None, "fr"), (4, "rien", None)]
    sample = langid.sampled(rows_of(spark, rows), per_language=50).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in sample} == {"en": 50, "de": 5}


def test_sample_is_bounded_by_bytes_but_never_empty(spark):
    rows = [(1, EN * 1000, "en"), (2, EN, "en"), (3, EN + "x", "en"), (4, DE * 1000, "de")]
    sample = langid.sampled(rows_of(spark, rows), language_bytes=500).collect()
    assert sorted((r.lang, len(r.text)) for r in sample) == sorted([("en", len(EN)), ("en", len(EN) + 1), ("de", 1000 * len(DE))])


@pytest.mark.parametrize("partitions", [1, 7])
def test_same_sample_at_every_partitioning(spark, partitions):
    rows = [(i % 700, f"{EN} {i % 900}", "en") for i in range(3000)]
    sample = langid.sampled(rows_of(spark, rows).repartition(partitions), per_language=30).collect()
    assert sorted(r.text for r in sample) == sorted(r.text for r in langid.sampled(rows_of(spark, rows), per_language=30).collect())
    assert len(sample) == 30


def test_empty_table(spark):
    assert langid.fit(rows_of(spark, []).limit(0)).languages == []
