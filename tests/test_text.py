"""Text functions against the values that users of such data expect."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import guards, text


def one(spark, column, *values):
    rows = [(i, v) for i, v in enumerate(values)]
    return [r.x for r in spark.createDataFrame(rows, "i int, t string").select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


def test_authors_that_are_no_authors(spark):
    good = ["Евграфова А.К.", "Цымбулов Л.Б.", "Петров", "Иванов И.И", "Иванов И.И.", "Сидоров-Кузнецов А.Б.", "Релевантов Р.В"]
    junk = ["Gennadiy L.", "Henao M.", "Mackey J.", "Advantages T.V.", "Any U.S.", "Asia Д.К.", "Взаимосвязь A.И.", "Проведен С.", "Editors J.", "Achurra G.", "Российская Федерация", "Федерация И.О."]
    more = ["John Smith", "Senior Researcher", "Федерация", "Editor", "", None, "Ив А.", "иванов И.", "Петров И..", "А-Б-В Г."]
    assert one(spark, text.junk_author, *good) == [False] * len(good)
    assert one(spark, text.junk_author, *junk, *more) == [True] * (len(junk) + len(more))


NOISE = {
    "рынок меди: рост на 10,1 % к 2011 г.": "market",
    "Цена никеля составила 12 тыс. долл./т": "market",
    "экспорт меди вырос на 12 %": "market",
    "производство выросло на 5 % против 2010 г.": "market",
    "спрос: 15 % снижения": "market",
    "экспорт меди изучен в работе авторов института": None,
    "12 % 15 мм 18 мм 20 кг ": "garble",
    "1,5\n2,5 %\n30 мм": "garble",
    "(1) питание (2) слив (3) пески": "garble",
    "12.5 13.4 55.2 (44) 12.3 / 44.5; 12: 44-55, 12; 13": "garble",
    "расход 12.5 13.4 55.2 (44) 12.3 / 44.5; 12: 44-55, 1": None,
    "медь никель кобальт": "no_verb",
    "СОДЕРЖАНИЕ РАБОТЫ ТОМА": "no_verb",
    "извлечение никеля составляет 95 %": None,
    "Co – 93-94%": None,
    "8-10 г/дм3 Fe;": None,
    "It was leached well": None,
    "Copper leached well": None,
    None: None,
    "": None,
}


def test_noise(spark):
    assert one(spark, text.noise, *NOISE) == list(NOISE.values())


LINES = {
    "УДК 669.2": True,
    "см. doi:10.1/2": True,
    "пишите на a.b@mail.example.com": True,
    "цена @ 5.00": False,
    "a@b": False,
    "a@b.c1": False,
    "«Цветные металлы». 2013. № 4": True,
    '"Цветные металлы". 2013. № 4': True,
    "Иванов И. С. 15–23.": True,
    "Т. 5. № 2.": True,
    "J. Met. Vol. 12": True,
    "No. 3, P. 7": True,
    "волна 12": False,
    "идоиск": False,
    None: False,
    "": False,
}


def test_lines_of_apparatus(spark):
    assert one(spark, guards.apparatus, *LINES) == list(LINES.values())
    assert one(spark, text.kill_lines, "a\nhttps://x.y\nb", None) == ["a\n\nb", None]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("медно-\nникелевый", "медно-никелевый"),
        ("Медно- \n  никелевый", "Медно-никелевый"),
        ("выще-\nлачивание", "выщелачивание"),
        ("слово-\nСлово", "слово-\nСлово"),
        ("leach-\ning", "leaching"),
        (None, None),
    ],
)
def test_words_split_at_the_end_of_a_line(spark, given, want):
    assert one(spark, text.dehyphenated, given) == [want]


def test_degrees_and_letters_of_units(spark):
    assert one(spark, text.degrees, "100 °С", "100оС и 90 0С", "x℃", "°С", "5 одС", None) == ["100 °C", "100°C и 90 °C", "x°C", "°C", "5 одС", None]
    assert one(spark, text.unit_letters, "мг/с", "моль/л·с", "CaСO3 и С1", "Сталь", "средний", None) == ["мг/c", "моль/л·с", "CaCO3 и С1", "Сталь", "средний", None]
    assert one(spark, text.normalised, "при 90 0С медно-\r\nникелевый") == ["при 90 °C медно-никелевый"]


def test_pages_lose_running_lines_and_numbers_at_their_ends(spark):
    pages = [("d", p, i, x) for p in range(3) for i, x in enumerate(["Журнал 2020", "42", f"текст {'абв'[p]}", str(p + 1)])] + [("e", 0, 0, "7")]
    got = {(r.doc_id, r.page_no): r.text for r in text.normalised_pages(spark.createDataFrame(pages, "doc_id string, page_no int, line_no int, line string")).collect()}
    assert got == {("d", 0): "42\nтекст а", ("d", 1): "42\nтекст б", ("d", 2): "42\nтекст в", ("e", 0): ""}


def test_authors_in_one_form(spark):
    got = one(spark, text.authors, "И. О. Иванов, Петров П.П., Рис А., Лазаревb Л.", "Данные А.Б.", None)
    assert got == [["Иванов И.О.", "Лазарев Л.", "Петров П.П."], [], []]
    many = ", ".join(f"{x}ванов И.И." for x in "АБВГДЕЖЗК")
    assert one(spark, text.authors, many) == [[]]


def test_authors_of_a_file_name(spark):
    names = {"a/Статья - Клименко И.В. (ЛГМ).pdf": ["Клименко И.В"], "Петров_тема.docx": ["Петров"], "Доклад_Реле Вантов.pdf": ["Реле Вантов"], "Презентация Измерение НДС в шахте.pdf": [], "Обзор.pdf": [], "": [], None: []}
    assert one(spark, text.authors_of_name, *names) == list(names.values())


def test_claims(spark):
    long = "Установлено, что " + "слово " * 40
    got = one(spark, text.claims, "Показано, что медь растворяется. Далее", "показано, что нет", "Мы выявлено - рост; затем", "Получен эффект: лучше", "Показали", None, long)
    assert got[:6] == ["медь растворяется", None, "рост", "лучше", None, None]
    assert got[6].endswith("слово…") and len(got[6]) <= 120


def test_patent_fields(spark):
    (got,) = one(spark, text.patent_meta, "(19) RU 2512345 C1\nМПК: C22B 3/00, C22B 15/00\nПатентообладатель: ООО Ромашка\nПриоритет от 12.03.2014")
    assert got.asDict() == {"number": "RU 2512345", "ipc": "C22B 3/00", "applicant": "ООО Ромашка", "priority_date": "12.03.2014"}
    (none,) = one(spark, text.patent_meta, None)
    assert none.asDict() == dict.fromkeys(("number", "ipc", "applicant", "priority_date"))
