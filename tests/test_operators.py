"""Edge cases of the operators: nulls, bounds, ties, access, versions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from factloom.functions import display, gazetteer, grammar, tables, text
from factloom.operators import coverage, facts, graphs, lifecycle, relations, retrieval, spans
from factloom.plans import extraction, search
from factloom.sources import files, sinks

FACT = "pkey string, doc_id string, canon string, label string, metric string, unit_canon string, value_low double, value_high double, comparator string, confidence double, source string, quote string, conditions string, phase string, extracted_at timestamp"


def fact(pkey, doc, value=1.0, **more):
    base = {"pkey": pkey, "doc_id": doc, "canon": "медь", "label": "Material", "metric": "извлечение", "unit_canon": "pct", "value_low": value, "value_high": value, "comparator": "=", "confidence": 0.9, "source": "grammar", "quote": pkey, "conditions": "T 60", "phase": None, "extracted_at": dt.datetime(2024, 1, 1)}
    base |= more
    return tuple(base[c.split()[0]] for c in FACT.split(", "))


def facts_of(spark, *rows):
    return spark.createDataFrame(list(rows), FACT)


@pytest.mark.parametrize(("lo", "hi", "want"), [(200.0, 300.0, {"point", "edge"}), (None, 300.0, {"point", "edge", "low", "both"}), (300.0, None, {"edge", "high"})])
def test_overlap(spark, lo, hi, want):
    rows = [("point", 250.0, 250.0), ("edge", 300.0, 400.0), ("low", None, 150.0), ("high", 310.0, None), ("none", None, None), ("both", 10.0, None)]
    df = spark.createDataFrame(rows, "k string, value_low double, value_high double")
    assert {r.k for r in df.filter(facts.overlaps(lo, hi)).collect()} == want


def test_overlap_as_half_lines(spark):
    df = spark.createDataFrame([("low", None, 150.0), ("high", 310.0, None)], "k string, value_low double, value_high double")
    assert {r.k for r in df.filter(facts.overlaps(100.0, 120.0, half_line=True)).collect()} == {"low"}


def test_filters_are_normalised():
    n = facts.normalised
    assert n(None) is None and n({"year": "x"}) is None and n({"confidence": "high"}) is None
    assert (n({"year": (2000, 2010)}).year_lo, n({"year": (2000, 2010)}).year_hi) == (2000, 2010)
    assert (n({"year": [2005, 1999, 2001]}).year_lo, n({"year": [2005, 1999, 2001]}).year_hi) == (1999, 2005)
    assert n({"year": 2003}, since=1990).year_lo == 2003 and n({}, since=1990).year_lo == 1990
    assert n({"geo": "RU", "min_confidence": "0.5"}) == facts.Filters(geo=("ru",), min_confidence=0.5)


def test_null_fails_a_filter_and_documents_follow_facts(spark):
    docs = spark.createDataFrame([("a", 2000, "RU"), ("b", None, "RU"), ("c", 2001, None)], "doc_id string, year int, geo string")
    rows = facts_of(spark, fact("1", "a"), fact("2", "b"), fact("3", "c", confidence=None), fact("4", "a", canon="никель"))
    d, f = facts.apply_filters(docs, rows, facts.normalised({"year": 1999, "material": "МЕДЬ", "min_confidence": 0.5}))
    assert {r.pkey for r in f.collect()} == {"1"} and {r.doc_id for r in d.collect()} == {"a"}


@pytest.mark.parametrize(("role", "want"), [("external_partner", 2), ("researcher", 3), ("admin", 4), ("unheard of", 2)])
def test_access(spark, role, want):
    df = spark.createDataFrame([("public",), ("internal",), ("secret",), (None,)], "sensitivity string")
    assert facts.visible(df, role).count() == want and facts.hidden_count(df, role).first()[0] == 4 - want


@pytest.mark.parametrize(("b", "more", "want"), [(90.0, {}, "VALIDATED_BY"), (85.0, {}, None), (80.0, {}, None), (79.0, {}, "CONTRADICTS"), (100.0, {"quote": "1"}, None), (50.0, {"comparator": "<="}, None), (79.0, {"conditions": None}, None), (79.0, {"confidence": 0.6}, None), (79.0, {"doc_id": "a"}, None), (300.0, {}, None)])
def test_pairs(spark, b, more, want):
    other = fact("2", more.pop("doc_id", "b"), b, **more)
    got = [r.rel for r in relations.pairs(facts_of(spark, fact("1", "a", 100.0), other)).collect()]
    assert got == ([want] if want else [])


def test_pairs_of_tables_need_no_conditions(spark):
    kw = {"conditions": None, "source": "vision_ocr", "metric": "содержание", "phase": "шлак"}
    docs = spark.createDataFrame([("a", "RU"), ("b", "WORLD")], "doc_id string, origin string")
    got = relations.pairs(facts_of(spark, fact("1", "a", 10.0, **kw), fact("2", "b", 20.0, **kw)), docs).collect()
    assert [(r.rel, r.kind) for r in got] == [("CONTRADICTS", "ru_vs_world")]


def test_pair_cap_is_before_the_gates(spark):
    rows = [fact(str(i), f"d{i:03}", 10.0 + 90.0 * (i % 2)) for i in range(60)]
    got = relations.pairs(facts_of(spark, *rows), cap=40).collect()
    assert len(got) == 40 and {r.doc_a for r in got} == {"d000"}


def test_floor_and_merge(spark):
    num = spark.createDataFrame([("a", False, False, 1), ("b", False, True, 2)], "doc_id string, ref boolean, in_range boolean, pos int")
    sem = spark.createDataFrame([("a", 0.9, 1), ("c", 0.35, 2), ("d", 0.34, 3), ("e", None, 4)], "doc_id string, score double, pos int")
    got = facts.merged(num, sem).orderBy("place").collect()
    assert [(r.doc_id, r.source) for r in got] == [("b", "numeric"), ("a", "numeric"), ("c", "semantic")]
    assert facts.out_of_domain(0.44, 0, 0, 0) and not facts.out_of_domain(0.45, 0, 0, 0) and not facts.out_of_domain(0.1, 1, 0, 0)


def test_keys_count_nulls(spark):
    df = spark.createDataFrame([("d", None, "m", "u", 5.0, 2.5, None, None)], "doc_id string, canon string, metric string, unit_canon string, value_low double, value_high double, conditions string, phase string")
    assert df.select(lifecycle.pkey()).first()[0] == "d||m|u|5|2.5||"


def test_upsert_is_idempotent_and_last_wins(spark):
    schema = "k int, v string, at int"
    old = spark.createDataFrame([(1, "a", 9), (2, "b", 9)], schema)
    new = spark.createDataFrame([(1, "c", 1), (3, "d", 1), (3, "e", 2)], schema)
    once = lifecycle.upserted(old, new, ["k"], ["at"])
    twice = lifecycle.upserted(once, new, ["k"], ["at"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "c", 1), (2, "b", 9), (3, "e", 2)]


def test_curation(spark):
    rows = facts_of(spark, fact("1", "a"), fact("2", "b"))
    new, history = lifecycle.edited(rows, {"doc_id": "a"}, 7.0, "ed", F.current_timestamp())
    assert {r.pkey: r.value_low for r in new.collect()} == {"1": 7.0, "2": 1.0} and history.first().old_low == 1.0
    gone = lifecycle.deleted(lifecycle.deleted(rows, {"id": "1"}), {"id": "2"})
    assert lifecycle.live(gone).count() == 0 and gone.count() == 2
    with pytest.raises(ValueError, match="needs an id"):
        lifecycle.match({})


def test_versions_count_the_older_ones(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    rows = facts_of(spark, fact("1", "a", extracted_at=day(1)), fact("2", "a", extracted_at=day(2)), fact("3", "a", extracted_at=day(2)), fact("4", "a", conditions=None))
    assert {r.pkey: r.version for r in lifecycle.versions(rows).collect()} == {"1": 1, "2": 2, "3": 2, "4": 1}
    assert {(r.pkey, r.older) for r in lifecycle.superseded(rows).collect()} == {("2", "1"), ("3", "1")}


def test_graph_bounds(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "a", "x"), ("b", "c", "y"), ("c", "d", "y"), ("d", "e", "y"), ("a", "a", "z")], "src string, dst string, type string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.hop) for r in graphs.neighborhood(edges, start, 3).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert {(r.a, r.b) for r in graphs.induced(edges, graphs.neighborhood(edges, start, 1)).collect()} == {("a", "b")}
    with pytest.raises(ValueError, match="depth"):
        graphs.neighborhood(edges, start, 4)


def test_vectors_with_nulls(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (5, [1.0, 1.0])], "vec_id int, embedding array<float>")
    got = retrieval.vector_topk(df, [2.0, 0.0], 2).collect()
    assert [(r.vec_id, round(r.score, 3)) for r in got] == [(1, 1.0), (5, 0.707)]


def test_shares_without_documents(spark):
    docs = spark.createDataFrame([], "doc_id string, geo string")
    row = coverage.summary(docs, facts_of(spark, fact("1", "a")).limit(0), spark.createDataFrame([], "doc_id string, author string"), spark.createDataFrame([], "doc_id string, domain string"), docs, "RU").first()
    assert row.documents == 0 and row.home_share is None and row.facts == 0


@pytest.mark.parametrize(
    ("sentence", "want"),
    [
        ("остаточное содержание сульфат-ионов составило 9,4 мг/л", ("содержание", "сульфат", 9.4, 9.4, "=", "mg_L")),
        ("содержание МПГ в шлаке составляет более 10 г/т", ("содержание", "МПГ", 10.0, None, ">", "g_t")),
        ("влажность концентрата не более 0,3 процента", (None, None, None, 0.3, "<=", "pct")),
        ("Fe <20 ppm в растворе", ("содержание", "железо", None, 20.0, "<", "mg_L")),
        ("температура порядка 1200 °С", ("температура", None, 1200.0, 1200.0, "~", "degC")),
        ("расход 1 200 м3/ч или выше", ("расход", None, 1200.0, None, ">=", "m3_h")),
    ],
)
def test_grammar(sentence, want):
    v = grammar.parse(sentence)[0]
    assert (v.material, v.value_low, v.value_high, v.comparator, v.unit_canon) == want[1:] and (want[0] is None or v.metric in (want[0], None))


def test_grammar_of_nothing():
    assert grammar.parse(None) == [] and grammar.parse("") == [] and grammar.parse("S. 45–52 в журнале, тираж 500 %") == []


def test_dictionary_is_checked():
    with pytest.raises(ValueError, match="twice"):
        gazetteer.checked([{"type": "a", "canon": "b"}, {"type": "a", "canon": "b"}])
    with pytest.raises(ValueError, match="needs"):
        gazetteer.checked([{"type": "a"}])


def test_cells():
    assert tables.cell_value("1999-2005") is None and tables.cell_value("1-2-3") is None and tables.cell_value("Cu") is None
    assert tables.cell_value("≈ 5,5") == ("~", 5.5, 5.5) and tables.cell_value("20–25") == ("=", 20.0, 25.0)
    assert tables.facts_of({(0, 0): "a", (0, 1): "Cu"}) == [] and tables.facts_of({}) == []


def test_repeats_collapse():
    assert text.repeats_collapsed("a b c a b c a b c d") == "a b c d" and text.repeats_collapsed("x y") == "x y"


def test_text_columns_take_nulls(spark):
    df = spark.createDataFrame([(None,), ("",), ("Первое предложение здесь. Second one follows here!\n\nshort",)], "t string")
    got = df.select(text.sentences(F.col("t")).alias("s"), text.chunks(F.col("t"), 30).alias("c"), text.cyrillic_share(F.col("t")).alias("r"), text.authors(F.col("t")).alias("a")).collect()
    assert [len(r.s) for r in got] == [0, 0, 2] and len(got[2].c) == 2 and got[0].r is None and got[0].a == []


def test_search_and_reports(spark):
    docs = spark.createDataFrame([("a", 2020, "RU", "public"), ("b", 2021, "RU", "internal"), ("c", 2022, "RU", "secret")], "doc_id string, year int, geo string, sensitivity string")
    rows = facts_of(spark, fact("1", "a", 95.0), fact("2", "b", 90.0), fact("3", "c", 94.0), fact("4", "a", 500.0))
    corpus = search.Corpus(docs, rows, authors=spark.createDataFrame([("a", "x")], "doc_id string, author string"))
    found = search.search(corpus, "извлечение меди не менее 94 %", "researcher")
    assert [f["pkey"] for f in found.facts] == ["1", "2"] and found.facts[0]["in_range"] and found.hidden_count == 1 and found.intent == "numeric"
    assert {d["doc_id"] for d in search.search(corpus, "медь", "external_partner", entities=["медь"]).docs} == {"a"}
    assert search.search(corpus, "кто эксперт", entities=["медь"]).experts == [{"author": "x", "docs": 1}]
    empty = search.Corpus(docs, rows.limit(0), semantic=lambda q: docs.select("doc_id", F.lit(0.4).alias("score")))
    assert search.search(empty, "weather").docs == []
    made = sinks.bundle(found)
    assert b"| 95 pct |" in made["report.md"].replace("медь".encode(), b"m") and made["report.pdf"].startswith(b"%PDF") and made["report.jsonld"].count(b'"doc/a"') >= 1
    assert search.recommend(corpus, "извлечение меди не менее 94 %")["grounded"] is False
    assert "## Gaps" in search.review(corpus, "извлечение меди не менее 94 %")
    assert search.search(corpus, "извлечение меди не менее 94 %", "admin").hidden_count == 0
    composed = search.composed(corpus, found)
    assert "Документов в выдаче: 2." in composed and "Скрыто по правам доступа: 1." in composed and "[**a** (2020)](/sources?doc=a)" in composed
    assert search.since_year("за последние 5 лет", 2024) == 2019 and search.since_year("с 2010", 2024) == 2010 and search.since_year("медь", 2024) is None


def test_ready_questions_and_recommendations(spark):
    docs = spark.createDataFrame([("a", 2020, "RU", "public"), ("b", 2021, "RU", "secret")], "doc_id string, year int, geo string, sensitivity string")
    rows = facts_of(spark, fact("1", "a", 95.0), fact("2", "b", 90.0))
    edges = spark.createDataFrame([("медь", "электролиз", "USES_MATERIAL")], "src string, dst string, type string")
    limits = []
    shortcuts = {"desalination": lambda numbers: (limits.append(search.sulfate_limit(numbers)), rows)[1]}
    corpus = search.Corpus(docs, rows, authors=spark.createDataFrame([("a", "x"), ("b", "y")], "doc_id string, author string"), edges=edges, shortcuts=shortcuts, semantic=lambda q: docs.select("doc_id", F.lit(0.9).alias("score")))
    found = search.search(corpus, "обессоливание: сульфат не более 200 мг/л", "researcher")
    assert limits == [200.0] and [f["pkey"] for f in found.facts] == ["1"] and found.facts[0]["ref"]
    assert search.shortcut_names("Distribution in matte") == ["pgm"] and search.shortcut_names("католит") == ["catholyte"] and search.shortcut_names("медь") == []
    rec = search.recommend(corpus, "медь", entities=["медь"])["recommendations"]
    assert rec["adjacent_topics"] == [{"canon": "электролиз"}] and rec["experts"] == [{"author": "x", "docs": 1}]
    assert "Смежные темы" in search.recommendations_text(rec) and search.recommendations_text({"similar_cases": [], "adjacent_topics": [], "experts": []}) == ""


def test_display(spark):
    d = F.col
    df = spark.createDataFrame([("содержание", 5.0, 12.5, "pct", "шлак", "q" * 300, "d1", "T", "2020"), ("pH", None, 3.0, "pH", None, None, None, None, None), (None, None, None, None, None, None, "d2", None, "x")], "m string, lo double, hi double, u string, p string, q string, d string, t string, y string")
    got = [r.b for r in df.select(display.bullet(d("m"), d("lo"), d("hi"), d("u"), d("p"), d("q"), d("d"), d("t"), d("y")).alias("b")).collect()]
    assert got[0] == f"- содержание 5–12.5 % [шлак] — «{'q' * 237}…» — [«T» (2020)](/sources?doc=d1)" and got[1] == "- pH ≤3 — (б.г.)"
    places = spark.createDataFrame([("ru", None, None, None, None), ("en", None, None, "x", None), (None, "internal", None, None, None), ("en", None, "Норильск", None, None), (None, None, "Chile", None, None), (None, None, "Статьи", None, "Статьи"), (None, None, "Марс", None, "Статьи")], "l string, s string, g string, r string, c string")
    assert [r.p for r in places.select(display.place(d("l"), d("s"), d("g"), d("r"), d("c")).alias("p")).collect()] == ["RU", "WORLD", "RU", "RU", "WORLD", None, "Марс"]
    names = spark.createDataFrame([("material",), ("publication",), ("nonsense",), (None,)], "t string")
    assert [tuple(r.e) for r in names.select(display.endpoint(d("t")).alias("e")).collect()] == [("Material", "canon"), ("Document", "doc_id"), ("Material", "canon"), ("Material", "canon")]
    assert [r.y for r in df.select(display.fact_year(d("y"), F.lit(1999)).alias("y")).collect()] == [2020, 1999, None]


def test_edges_of_texts(spark):
    kinds = {"медь": "Material", "руда": "Material", "штейн": "Phase", "плавка": "Process", "печь": "Equipment", "Заполярье": "Condition"}
    entries = gazetteer.checked([{"type": t, "canon": c, "aliases": [c]} for c, t in kinds.items()])
    body = "Иванов И.О., Петров П.П.\n\nПри плавке руды в печи получают штейн с содержанием меди 45 %. В Заполярье плавка идёт и составляет основу дела. Установлено, что медь остаётся в шлаке."
    docs = spark.createDataFrame([("d1", body), ("d2", None), ("d3", "")], "doc_id string, text string")
    read = extraction.sentence_facts(docs, entries)
    got = {(r.src, r.dst, r.type) for r in extraction.edges_of(read, docs).collect()}
    assert {("плавка", "штейн", "PRODUCES_OUTPUT"), ("плавка", "печь", "OPERATES_AT_CONDITION"), ("плавка", "Заполярье", "OPERATES_AT_CONDITION"), ("d1", "Иванов И.О.", "AUTHORED_BY"), ("Петров П.П.", "пирометаллургия", "IN_DOMAIN"), ("d1", "медь остаётся в шлаке", "SHOWED")} <= got
    assert not any(d == "штейн" and t == "USES_MATERIAL" for _, d, t in got)
    assert {(r.label, r.canon) for r in extraction.mention_nodes(read).collect()} == {("Condition", "Заполярье"), ("Domain", "пирометаллургия")}
    fact_ = extraction.facts_of(read).collect()
    assert [(r.canon, r.phase, r.value_low) for r in fact_] == [("медь", "штейн", 45.0)]


def test_other_values_come_between(spark):
    said = "Доля 10 % при 500 °C и ещё 7 г/т составляет {} вещества."
    docs = spark.createDataFrame([("d", said.format("руда")), ("e", said.format("обжиг"))], "doc_id string, text string")
    entries = gazetteer.checked([{"type": "Process", "canon": "обжиг", "aliases": ["обжиг"]}, {"type": "Material", "canon": "руда", "aliases": ["руда"]}])
    got = extraction.facts_of(extraction.sentence_facts(docs, entries)).collect()
    # the others are cut off from the material; a process bears them all
    assert sorted((r.doc_id, r.canon, r.unit_canon) for r in got) == [("d", "руда", "g_t"), ("e", "обжиг", "degC"), ("e", "обжиг", "g_t"), ("e", "обжиг", "pct")]


def test_lists_of_compositions(spark):
    entries = gazetteer.checked([{"type": "Material", "canon": c, "aliases": [c], "symbols": [s]} for c, s in (("медь", "Cu"), ("никель", "Ni"), ("железо", "Fe"))] + [{"type": "Process", "canon": "обжиг", "aliases": ["обжиг"]}])
    texts_ = ["Содержание составляет 45 % Cu, 20 % Ni, более 3 % Fe и так далее.", "Температура плавления меди составляет 1083 °C при давлении.", "Обжиг меди ведут, температура составляет 900 °C обычно."]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts_)], "doc_id string, text string")
    got = sorted((r.doc_id, r.canon, r.value_low) for r in extraction.facts_of(extraction.sentence_facts(docs, entries)).collect())
    assert got == [("0", "медь", 45.0), ("0", "никель", 20.0), ("1", "медь", 1083.0), ("2", "обжиг", 900.0)]


def test_rich_text_and_sheets():
    import io
    import zipfile

    rtf = rb"{\rtf1\ansi\ansicpg1251{\fonttbl{\f0 Arial;}}{\*\generator x;}\f0 \'cc\'e5\'e4\'fc 5 %\par second \u1052?\{a\}}"
    assert files._rtf(rtf) == "Медь 5 %\nsecond М{a}"
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst xmlns='x'><si><t>Cu</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", "<worksheet xmlns='x'><sheetData><row><c t='s'><v>0</v></c><c><v>45.5</v></c><c t='inlineStr'><is><t>own</t></is></c></row>" + "<row><c><v>1</v></c></row>" * 80 + "</sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", "<broken")
    lines = files._office(box.getvalue()).split("\n")
    assert lines[0] == "Cu\t45.5\town" and len(lines) == 60
    word = io.BytesIO()
    with zipfile.ZipFile(word, "w") as z:
        z.writestr("word/document.xml", "<d xmlns='x'><p><t>before</t></p><tbl><tr><tc><p><t>a</t></p></tc><tc><p><t>b</t></p></tc></tr></tbl></d>")
    assert files._office(word.getvalue()) == "before\na | b"


def test_pdf_loses_no_letter():
    made = sinks.pdf(search.Result("медь и 銅 é", "search", None))
    assert b"?" not in made.split(b"stream")[1] and "м".encode("utf-16-be").hex().upper().encode() in made and b"/uni043C" in made and "銅".encode("utf-16-be").hex().upper().encode() in made


def test_technologies_keep_those_without_facts(spark):
    rows = facts_of(spark, fact("1", "a", 95.0), fact("2", "b", 900.0, metric="температура", unit_canon="degC"))
    edges = spark.createDataFrame([("медь", "Заполярье", "OPERATES_AT_CONDITION")], "src string, dst string, type string")
    got = {r.canon: r for r in coverage.technologies(rows, edges, spark.createDataFrame([("медь",), ("нет",)], "canon string")).collect()}
    assert (got["медь"].efficiency_pct_max, got["медь"].temperature_c_n, got["медь"].cold_climate, got["медь"].sources) == (95.0, 1, True, 2)
    assert (got["нет"].sources, got["нет"].cold_climate, got["нет"].conditions, got["нет"].capex) == (0, False, [], None)


def test_dashboard_does_without_a_part(spark):
    docs = spark.createDataFrame([("a", 2020)], "doc_id string, year int")  # no geo
    rows = facts_of(spark, fact("1", "a"))
    rel = spark.createDataFrame([], "rel string, kind string, entity string, metric string, phase string, unit string, doc_a string, doc_b string")
    made = coverage.dashboard(docs, rows, spark.createDataFrame([("a", "x")], "doc_id string, author string"), spark.createDataFrame([("a", "d")], "doc_id string, domain string"), rel, "RU")
    assert made["summary"] is None and made["by_geo"] is None and made["by_year"].collect()[0].documents == 1 and made["contradictions"].count() == 0


def test_nearest_points(spark):
    import random

    r = random.Random(3)
    vs = [(r.randrange(3), i, r.randrange(40)) for i in range(60)]
    ms = [(r.randrange(2), i, r.randrange(40)) for i in range(30)]
    got = {x.vid: (x.mid, x.gap) for x in spans.nearest_points(spark.createDataFrame(vs, "g int, vid int, v_at int"), spark.createDataFrame(ms, "g int, mid int, m_at int"), "g").collect()}
    want = {}
    for g, v, at in vs:
        near = [(abs(at - m_at), m_at, m) for h, m, m_at in ms if h == g]
        if near:
            gap, _, m = min(near)
            want[v] = (m, gap)
    assert got == want


def test_relations_proposed_are_validated():
    good = {"src": "a", "dst": "b", "quote": "A  makes b"}
    assert search.valid_relations([good, {**good, "dst": "z"}, {**good, "quote": "no"}], {"a", "b"}, "x a makes B y") == [good]


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "raw" / "cat1").mkdir(parents=True)
    (tmp_path / "raw" / "cat1" / "a.txt").write_text("hello")
    (tmp_path / "raw" / "cat1" / "b.html").write_text("<p>x<script>y</script></p>")
    (tmp_path / "raw" / "cat1" / "c.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "raw" / "skip.xyz").write_text("no")
    found = files.corpus(spark, f"file://{tmp_path}/raw")
    assert {r.kind for r in found.collect()} == {"txt", "html", "pdf"} and {r.cat for r in found.collect()} == {"cat1"}
    got = {r.path[-5:]: r for r in files.texts(found).collect()}
    assert got["a.txt"].text == "hello" and got[".html"].text == "x" and got["c.pdf"].text is None and got["c.pdf"].error
    (tmp_path / "m.jsonl").write_text('{"k":1,"v":"a"}\nbroken\n{"k":1,"v":"b"}\n{"k":2,"v":"c"}\n')
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    rows = files.json_lines(spark, f"file://{tmp_path}/m.jsonl", StructType([StructField("k", IntegerType()), StructField("v", StringType())]), "k")
    assert {r.k: r.v for r in rows.filter("k is not null").collect()} == {1: "b", 2: "c"}
    sinks.write_facts(facts_of(spark, fact("1", "a"), fact("2", "b", source="vision_ocr")), f"file://{tmp_path}/facts")
    assert spark.read.parquet(f"file://{tmp_path}/facts").count() == 2
    sinks.replace_version(rows, f"file://{tmp_path}/t", "1")
    assert sinks.latest(spark, f"file://{tmp_path}/t").count() == rows.count()
    assert sinks.violations(rows, ["k"]).filter("k is not null").count() == 0


FOLDER = "/root/testdata/sf0.001"


def chunks_of(body, most=1200):
    import re

    parts = []
    for p in re.split(r"\n\s*\n", body or ""):
        if p.strip(" "):
            parts += [p.strip(" ")] if len(p) <= most else re.split(r"(?<=[.!?;])\s+", p.strip(" "))
    out, now = [], ""
    for x in parts:
        if len(now) + len(x) + 1 > most:
            out += [now] if now else []
            now = x
        else:
            now = f"{now}\n{x}" if now else x
    return out + ([now] if now else [])


def test_chunks_of_a_whole_table(spark):
    from factloom.plans import catalogue_text

    got = {}
    for r in catalogue_text.chunk_pack(spark, FOLDER).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert got == {r.doc_id: c for r in rows if (c := chunks_of(r.text))}


def test_repeats_of_a_whole_table(spark):
    from factloom.plans import adapters, catalogue_text

    kept = {(r.doc_id, r.pos) for r in catalogue_text.either_key_dedup_all(spark, FOLDER).collect()}
    docs = {}
    for r in sorted(adapters.parameter(spark, FOLDER).collect(), key=lambda r: (r.doc_id, r.pkey, r.author)):
        docs.setdefault(r.doc_id, []).append(r)
    want = set()
    for doc, own in docs.items():
        values, quotes = set(), set()
        for pos, r in enumerate(own, 1):
            value, quote = (r.canon, r.metric, r.value_low, r.value_high, r.unit_canon), " ".join(r.quote.lower().split())[:120]
            if value not in values and quote not in quotes:
                want.add((doc, pos))
                values.add(value)
                quotes.add(quote)
    assert kept == want


def test_noise_of_a_whole_table(spark):
    from factloom.plans import catalogue_text

    rows = catalogue_text.sentence_split(spark, FOLDER).withColumn("reason", text.noise(F.col("sent"))).collect()
    told = catalogue_text.noise_reasons(spark, FOLDER).collect()
    assert sorted((r.doc_id, r.sent_no, r.reason or "") for r in told) == sorted((r.doc_id, r.sent_no, r.reason or "") for r in rows)
    marks = set(".,;:%–—-/()°")
    for r in rows:
        dense = len(r.sent) >= 40 and sum(c.isdecimal() or c in marks for c in r.sent) > 0.4 * len(r.sent)
        short = sum(len(w) >= 3 and w.isalpha() and w.isascii() for w in "".join(c if c.isalpha() else " " for c in r.sent).split())
        assert not dense or r.reason in ("market", "garble") or "pH" in r.sent
        assert r.reason != "no_verb" or short < 6


def test_the_sample_is_the_same_in_any_order(spark):
    from factloom.plans import adapters

    rows = adapters.parameter(spark, FOLDER).select("pkey", "doc_id").distinct()
    a, b = files.audit_sample(rows, 100).collect(), files.audit_sample(rows.repartition(7), 100).collect()
    assert a == b and len({r.pkey for r in a}) == 100


def test_settings_embeddings_and_exported_events(spark, tmp_path, monkeypatch):
    from factloom.sources import settings

    (tmp_path / "env").write_text("# no=1\nA = 'x y'\nB=2\n\nbroken\n")
    path = str(tmp_path / "env")
    assert settings.read(path) == {"A": "x y", "B": "2"} and settings.read(str(tmp_path / "none")) == {}
    monkeypatch.setenv("B", "3")
    assert settings.setting("B", path=path) == "3" and settings.setting("A", path=path) == "x y" and settings.setting("C", "d", path) == "d"
    good = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 1.0])], "vec_id int, embedding array<float>")
    sinks.write_embeddings(good, f"file://{tmp_path}/v", 2)
    assert spark.read.parquet(f"file://{tmp_path}/v").count() == 2
    with pytest.raises(Exception, match="not a vector of 3 numbers"):
        sinks.write_embeddings(good, f"file://{tmp_path}/w", 3)
    events = spark.createDataFrame([(dt.datetime(2024, 1, i), f"e{i}") for i in (3, 1, 2)], "ts timestamp, event string")
    sinks.export_events(events, f"file://{tmp_path}/e")
    assert [r.event for r in spark.read.json(f"file://{tmp_path}/e").orderBy("ts").collect()] == ["e1", "e2", "e3"]
