"""Text functions as columns (X01-X04, X08-X10, X17-X18, X24, M10-M11, A20-A21, A24, F15, F19-F20,
F22-F24, F30, E13, W14). All are JVM expressions but for those that say otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.guards import LINE_MARKS, LINE_PARTS, apparatus, junk_author, kill_lines, noise, number_lines  # noqa: F401

# --- fixed values: words that the guards and the classes go by ------------------
ANCHOR = r"^\s*(?:УДК\s*[\d\[]|Для цитирования:)"
ECONOMIC = r"^\s*УДК\s*\[?3[23]"
RUBRICS = ("ЭКОНОМИКА И УПРАВЛЕНИЕ ПРОИЗВОДСТВОМ", "НОВОСТИ", "ХРОНИКА", "НАШИ ЮБИЛЯРЫ", "ПОЗДРАВЛЯЕМ", "РЕКЛАМА", "ИНФОРМАЦИЯ")

#: Type of document -> what its text or name holds; the first that fits wins. `*` goes on in the word,
#: `#` is a digit, a space is any white space or none.
DOC_TYPES = {
    "patent": ("патент", "RU ######*", "МПК", "заявка №", "приоритет от", "(51) Int Cl", "(51) Int. Cl", "IPC"),
    "standard": ("ГОСТ", "ТУ 20*", "СП #*", "СанПиН", "стандарт организации", "СТО", "стандарт"),
    "reference": ("справочник", "энциклопед*", "каталог оборудования", "каталог"),
    "protocol": ("протокол испытан*", "протокол эксперимент*", "протокол"),
    "presentation": ("-- слайд", "слайд #*", "презентац*"),
    "report": ("отчет", "отчёт", "доклад", "technical report"),
    "article": ("аннотац*", "abstract", "DOI", "список литератур*", "статья", "references"),
}


PAGE_NUMBER = r"^\s*\d{1,4}\s*$"


def any_of(words: tuple[str, ...], flags: str = "iuU") -> str:
    """A pattern of whole words and phrases written as above."""

    def one(word: str) -> str:
        body = "".join({"*": r"\w*", "#": r"\d", " ": r"\s*"}.get(c) or (c if c.isalnum() else f"\\{c}") for c in word)
        first = r"(?<!\w)" if word[0].isalnum() else ""
        last = r"(?!\w)" if word[-1].isalnum() else ""
        return f"{first}{body}{last}"

    return f"(?{flags})(?:{'|'.join(map(one, words))})"


# --- normalisation --------------------------------------------------------------


def nfc():
    """Unicode composition; Spark has no such function, so an Arrow-batched one."""
    import unicodedata

    @F.pandas_udf(T.StringType())
    def compose(text):
        return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return compose


#: Parts of adjectives that are written with a hyphen (fixed values).
COMPOUNDS = (
    "медно никелевый физико химический серно кислый окислительно восстановительный жидко твёрдый твердый газо жидкостный тепло массообмен электро гидро металлургический пиро цветной кобальто содержащий железо марганцево хромо титано рудно термический"
).split()


def degrees(text: Column) -> Column:
    """The spellings of degrees Celsius as one: a degree sign, or an o or zero after a number."""
    out = F.regexp_replace(text, "℃", "°C")
    out = F.regexp_replace(out, r"(?<=\d)(\s*)[°º˚]\s*[СCсc]", "$1°C")
    out = F.regexp_replace(out, r"(?<=\d)(\s*)[оo0][СC](?![\p{L}\d_])", "$1°C")
    return F.regexp_replace(out, r"[°º˚]\s*[СCсc](?![\p{L}\d_])", "°C")


def unit_letters(text: Column) -> Column:
    """In a token that holds a Latin letter or a sign of units, and no run of three Cyrillic
    letters, a Cyrillic C is a Latin one."""
    parts = F.regexp_extract_all(text, F.lit(r"([A-Za-zА-Яа-яЁё0-9]+(?:[/·^²³°.\-][A-Za-zА-Яа-яЁё0-9]+)*|[^A-Za-zА-Яа-яЁё0-9]+)"), 1)
    unit = lambda t: t.rlike("[A-Za-z/·^²³°]") & ~t.rlike("[А-Яа-яЁё]{3}")
    return F.array_join(F.transform(parts, lambda t: F.when(unit(t), F.translate(t, "Сс", "Cc")).otherwise(t)), "")


def dehyphenated(text: Column) -> Column:
    """Words split at a line's end are joined; between two parts of a compound the hyphen stays."""
    part = f"(?:{'|'.join(COMPOUNDS)})"
    kept = F.regexp_replace(text, rf"(?iu)(?<!\p{{L}})({part})-[ \t]*\n[ \t]*(?=\p{{Ll}})({part})(?!\p{{L}})", "$1-$2")
    return F.regexp_replace(kept, r"(\p{L})-[ \t]*\n[ \t]*(\p{Ll})", "$1$2")


def normalised(text: Column) -> Column:
    """One spelling of degrees, of units, of line ends and of words split at them (composition
    of Unicode is X01's)."""
    return unit_letters(degrees(dehyphenated(F.regexp_replace(text, "\\r\\n?", "\n"))))


def normalised_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, text) from lines (doc_id, page_no, line_no, line): without running
    lines and page numbers at a page's ends, then as `normalised`. A page that loses all its lines
    stays, empty."""
    rows = without_running_lines(pages, edges_only=True)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    kept = rows.groupBy("doc_id", "page_no").agg(lines.alias("text"))
    every = pages.select("doc_id", "page_no").distinct()
    return every.join(kept, ["doc_id", "page_no"], "left").select("doc_id", "page_no", normalised(F.coalesce("text", F.lit(""))).alias("text"))


def normal_line(line: Column) -> Column:
    """A line without digits, case and runs of white space."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, "\\d+", ""), "\\s+", " ")))


def sentences(text: Column) -> Column:
    """Sentences of 12 to 1200 characters."""
    parts = F.split(F.coalesce(text, F.lit("")), "(?<=[.!?;])\\s+(?=[\\p{Lu}\\d])|\\n\\s*\\n")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: F.length(x).between(12, 1200))


def sentence_rows(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sent_no, sent)."""
    return documents.select(F.col(id_col).alias("doc_id"), F.posexplode(sentences(F.col(text_col))).alias("sent_no", "sent"))


def quote_window(sentence: Column, start: Column, end: Column, around: int = 120) -> Column:
    """What stands around a span, with dots where it was cut."""
    lo = F.greatest(F.lit(0), start - around)
    hi = F.least(F.length(sentence), end + around)
    body = F.substring(sentence, lo + 1, hi - lo)
    return F.concat(F.when(lo > 0, F.lit("…")).otherwise(""), body, F.when(hi < F.length(sentence), F.lit("…")).otherwise(""))


def degenerate(quote: Column) -> Column:
    """Does some run of three words come three times?"""
    words = F.split(F.lower(F.trim(quote)), "\\s+")
    grams = F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.array_join(F.slice(words, i, 3), " "))).otherwise(F.array())
    return F.coalesce(F.exists(F.array_distinct(grams), lambda g: F.size(F.filter(grams, lambda x: x == g)) >= 3), F.lit(False))


def repeats_collapsed(text: str) -> str:
    """A phrase of up to eight words that follows itself is said once."""
    words = text.split()
    for size in range(8, 0, -1):
        out: list[str] = []
        for word in words:
            out.append(word)
            if len(out) >= 2 * size and out[-size:] == out[-2 * size : -size] and (size > 1 or len(out) >= 3 and out[-3] == word):
                del out[-size:]
        words = out
    return " ".join(words)


# --- language, year, type -------------------------------------------------------


def cyrillic_share(text: Column, head: int = 4000) -> Column:
    """Cyrillic letters among all letters of the head of a text; null without letters."""
    start = F.substring(text, 1, head)
    cyr = F.regexp_count(start, F.lit("[а-яёА-ЯЁ]")).cast("double")
    lat = F.regexp_count(start, F.lit("[a-zA-Z]")).cast("double")
    return F.try_divide(cyr, cyr + lat)


def origin(text: Column, lang: Column) -> Column:
    """RU or WORLD by letters, else by the language given."""
    share = cyrillic_share(text)
    return F.when(share >= 0.5, "RU").when(share < 0.5, "WORLD").when(F.lower(lang) == "ru", "RU").when(lang.isNotNull(), "WORLD")


def year_of_name(name: Column) -> Column:
    """The last year in a file name."""
    found = F.regexp_extract_all(name, F.lit("(?<!\\d)((?:19|20)\\d\\d)(?!\\d)"), 1)
    return F.try_element_at(found, F.lit(-1)).cast("int")


def year_modes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = 3000) -> DataFrame:
    """Per document the year named most in its head, the latest of equals."""
    found = F.regexp_extract_all(F.substring(text_col, 1, head), F.lit("(?<!\\d)((?:19|20)\\d\\d)(?!\\d)"), 1)
    rows = documents.select(F.col(id_col).alias("doc_id"), F.explode(found).alias("year")).groupBy("doc_id", "year").agg(F.count("*").alias("n"))
    return rows.groupBy("doc_id").agg(F.max_by(F.col("year").cast("int"), F.struct("n", "year")).alias("year"))


def doc_type(text: Column, name: Column) -> Column:
    """By the whole text and the name."""
    whole = F.concat_ws("\n", F.coalesce(name, F.lit("")), F.coalesce(text, F.lit("")))
    out = F.lit("other")
    for kind in reversed(DOC_TYPES):
        out = F.when(whole.rlike(any_of(DOC_TYPES[kind])), kind).otherwise(out)
    return out


#: What stands before a field of a patent (fixed values), in lower case.
PATENT_LABELS = {"ipc": ("мпк", "ipc", "(51) int. cl.", "(51) int cl.", "(51) int.cl.", "(51) int cl"), "applicant": ("заявитель", "патентообладатель", "applicant"), "priority_date": ("приоритет от",)}


def _labelled(text: Column, labels: tuple[str, ...]) -> Column:
    """What follows the first of the labels that the text has, up to the line's end."""
    low = F.lower(text)
    places = F.array(*[F.struct(F.when(F.instr(low, label) > 0, F.instr(low, label)).alias("at"), F.lit(-len(label)).alias("size")) for label in labels])
    first = F.array_min(F.filter(places, lambda p: p["at"].isNotNull()))
    return F.ltrim(F.substring_index(F.ltrim(F.substring(text, first["at"] - first["size"], F.length(text)), F.lit(" :\t")), "\n", 1))


def patent_meta(text: Column) -> Column:
    """Number, class, applicant and priority that a patent names; null where it does not."""
    whole = F.coalesce(text, F.lit(""))
    filled = lambda value: F.nullif(F.trim(value), F.lit(""))
    words = F.split(F.upper(whole), r"[^\p{L}\d]+")
    digits = lambda w: F.length(F.translate(w, "0123456789", "")) == 0
    long = lambda w: digits(w) & (F.length(w) >= 6)
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.when((a == "RU") & long(b), F.concat(F.lit("RU "), b)).when(F.startswith(a, F.lit("RU")) & long(F.substring(a, 3, 99)), a))
    group = F.split(_labelled(whole, PATENT_LABELS["ipc"]), r"[\s,;]+")
    main, sub = F.get(group, F.lit(0)), F.coalesce(F.get(group, F.lit(1)), F.lit(""))
    classed = F.when(F.length(F.translate(main, "0123456789", "")) < F.length(main), main)
    day = F.regexp_extract(_labelled(whole, PATENT_LABELS["priority_date"]), "^[0-9][0-9./-]*", 0)
    return F.struct(
        F.get(F.filter(pairs, lambda x: x.isNotNull()), F.lit(0)).alias("number"),
        filled(F.when(F.substring(sub, 1, 1).between("0", "9"), F.concat(classed, F.lit(" "), sub)).otherwise(classed)).alias("ipc"),
        filled(F.substring(_labelled(whole, PATENT_LABELS["applicant"]), 1, 120)).alias("applicant"),
        filled(day).alias("priority_date"),
    )


def file_kind(content: Column, name: Column) -> Column:
    """By the first bytes, else by the extension."""
    head = F.hex(F.substring(content, 1, 8))
    extension = F.lower(F.regexp_extract(name, "\\.([^.]+)$", 1))
    return F.when(head.startswith("25504446"), "pdf").when(head.startswith("504B0304"), "zip").when(head.startswith("D0CF11E0"), "ole2").when(head.startswith("52617221"), "rar").when(head.startswith("7B5C727466"), "rtf").otherwise(extension)


def base_name(path: Column) -> Column:
    """X24."""
    return F.substring(F.regexp_replace(F.regexp_extract(path, "([^/\\\\]*)$", 1), "\\.[^.]{1,5}$", ""), 1, 80)


# --- guards (the others are in guards.py) ------------------------------------


def difference(quote: Column) -> Column:
    """a value that is a difference, not a measurement."""
    return quote.rlike(r"(?iu)\bна\s+\d[\d.,]*\s*\S{0,6}\s+(?:ниже|выше|больше|меньше)")


def numeric_cell(cell: Column) -> Column:
    """F22."""
    return ~cell.rlike("\\p{L}") & cell.rlike("\\d")


# --- rows -----------------------------------------------------------------------


def without_running_lines(pages: DataFrame, share: float = 0.3, least: int = 2, edges_only: bool = False) -> DataFrame:
    """Lines of (doc_id, page_no, line_no, line) that, without digits, stand on many pages of
    their document go; and page numbers, everywhere or in a page's first and last line only."""
    rows = pages.withColumn("_key", normal_line(F.col("line")))
    number = F.col("line").rlike(PAGE_NUMBER)
    if edges_only:
        page = Window.partitionBy("doc_id", "page_no")
        rows = rows.withColumns({"_first": F.min("line_no").over(page), "_last": F.max("line_no").over(page)})
        number = number & F.col("line_no").isin(F.col("_first"), F.col("_last"))
    n = rows.groupBy("doc_id").agg(F.countDistinct("page_no").alias("_pages"))
    often = rows.filter("_key <> ''").groupBy("doc_id", "_key").agg(F.countDistinct("page_no").alias("_n")).join(n, "doc_id")
    often = often.filter(F.col("_n") >= F.greatest(F.lit(least), F.ceil(share * F.col("_pages")))).select("doc_id", "_key")
    kept = rows.join(often, ["doc_id", "_key"], "left_anti").filter(~number)
    return kept.drop("_key", "_first", "_last")


def article_segments(documents: DataFrame, least: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, segment, kind, text): an issue cut at the anchors of its articles. Without an
    anchor the whole is one article. Kinds: preamble, science, econ, rubric."""
    lines = documents.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n", -1)).alias("line_no", "line"))
    anchor = F.col("line").rlike(ANCHOR)
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    cut = lines.withColumn("segment", F.sum(F.when(anchor, 1).otherwise(0)).over(w))
    head = F.min_by("line", "line_no")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    rubric = F.max(F.trim("line").isin(*RUBRICS) & (F.col("line_no") >= 0))
    out = cut.groupBy("doc_id", "segment").agg(head.alias("head"), rubric.alias("rubric"), text.alias("text"))
    anchored = F.max("segment").over(Window.partitionBy("doc_id")) > 0
    kind = F.when(~anchored, "science").when(F.col("segment") == 0, "preamble").when(F.col("head").rlike(ECONOMIC), "econ").when(F.col("rubric"), "rubric").otherwise("science")
    return out.select("doc_id", "segment", kind.alias("kind"), "text").filter((F.col("kind") != "science") | (F.length("text") >= least) | (F.col("segment") == 0))


def chunks(text: Column, most: int = 1200) -> Column:
    """Paragraphs, and sentences of long ones, put together up to a length."""
    paragraphs = F.filter(F.split(F.coalesce(text, F.lit("")), "\\n\\s*\\n"), lambda p: F.trim(p) != "")
    parts = F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) <= most, F.array(F.trim(p))).otherwise(F.split(F.trim(p), "(?<=[.!?;])\\s+"))))
    full = lambda acc, x: F.length(acc["now"]) + F.length(x) + 1 > most
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    step = lambda acc, x: F.struct(
        F.when(full(acc, x) & (acc["now"] != ""), F.array_append(acc["done"], acc["now"])).otherwise(acc["done"]).alias("done"),
        F.when(full(acc, x) | (acc["now"] == ""), x).otherwise(F.concat(acc["now"], F.lit("\n"), x)).alias("now"),
    )
    last = lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["now"]))
    return F.aggregate(parts, start, step, last)


#: A surname and initials, in either order.
_SURNAME, _LETTERS = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?", r"\p{Lu}\.\s*(?:\p{Lu}\.)?"
#: Words that begin sentences and headings and are no surnames (fixed values).
NO_SURNAMES = (
    "Рис Табл Таблица Рисунок При Для Как Что Это Так Все Из По На От До Данные Результаты Геофизика Геология Геомеханика Спасибо Ведущий Автор Авторы Докладчик Руководитель Научный Инженер Доктор Профессор Кандидат Заведующий Начальник Директор Глава Работу Работа Доклад Выполнил Подготовил Рецензент Институт Лаборатория Кафедра Отдел Секция Тема Цель Введение Заключение Выводы Аннотация Реферат Влияние Изучение Исследование Разработка Применение Использование Оценка Анализ Определение Особенности Обоснование Совершенствование Повышение Снижение Получение Технология Методика Способ Опыт Перспективы Проблемы Современные Основные Новый Новые Комплексный Текст Младший Старший Ведущая Общие Прочие The This That These Fig Figure Table Abstract Study Analysis Effect Influence Development Review Содержание Плотность Температура Извлечение Концентрация Масса Скорость Расход Давление Напряжение Мощность Объём Объем Выход Потери Степень Величина Значение Оглавление Список Литература Приложение Раздел Формула Уравнение Примечание"
).split()
#: Kinds of papers that a file's name begins with (fixed values).
PAPERS = ("доклад", "презентация", "обзор", "статья", "отчет", "отчёт", "тэр", "материалы", "тезисы", "реферат", "протокол")


def author_name(written: Column) -> Column:
    """Surname, a blank, initials with dots and without blanks; a Latin letter at the end of a
    Cyrillic surname is a footnote's."""
    surname = F.regexp_extract(written, f"({_SURNAME})", 1)
    surname = F.when(surname.rlike(r"^[А-ЯЁ][А-ЯЁа-яё-]+[a-z]$"), F.left(surname, F.length(surname) - 1)).otherwise(surname)
    letters = F.regexp_extract_all(F.replace(written, surname, F.lit(" ")), F.lit(r"(\p{Lu})\."), 1)
    return F.concat(surname, F.lit(" "), F.array_join(F.transform(letters, lambda x: F.concat(x, F.lit("."))), ""))


def authors(text: Column, head: int = 1500, most: int = 8) -> Column:
    """Names with initials in a head, either order, in one form; too many are none."""
    start = F.substring(F.coalesce(text, F.lit("")), 1, head)
    found = lambda form: F.regexp_extract_all(start, F.lit(f"(?<!\\p{{L}})({form})"), 1)
    names = F.transform(F.concat(found(rf"{_SURNAME}\s+{_LETTERS}"), found(rf"{_LETTERS}\s*{_SURNAME}(?!\p{{L}})")), author_name)
    known = F.array_sort(F.array_distinct(F.filter(names, lambda x: ~F.substring_index(x, " ", 1).isin(NO_SURNAMES))))
    return F.when(F.size(known) > most, F.array().cast("array<string>")).otherwise(known)


def authors_of_name(source: Column) -> Column:
    """Authors that a file's name tells: surnames with initials anywhere in it; else what stands
    before the first underscore, after words for kinds of papers, if it is a surname, alone or with
    one first name."""
    stem = F.regexp_replace(F.regexp_extract(F.coalesce(source, F.lit("")), "([^/]*)$", 1), r"\.[^.]*$", "")
    initial = r"[А-ЯЁ]\.?(?![а-яё])"
    full = rf"[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?\s+{initial}\s*(?:{initial})?(?![А-ЯЁ])"
    tidy = lambda x: F.rtrim(F.trim(F.regexp_replace(x, r"\s+", " ")), F.lit("."))
    named = F.array_distinct(F.transform(F.regexp_extract_all(stem, F.lit(f"({full})"), 1), tidy))
    parts = F.filter(F.transform(F.split(stem, "_"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    start = F.aggregate(parts, F.lit("").cast("string"), lambda seen, x: F.when((seen == "") & ~F.lower(x).isin(*PAPERS), x).otherwise(seen))
    words = F.split(start, " ")
    capital = lambda w: w.rlike("^[А-ЯЁ][а-яё]+$")
    single = (F.size(words) <= 2) & F.forall(F.concat(F.split(F.get(words, F.lit(0)), "-"), F.slice(words, F.lit(2), F.lit(1))), capital) & (F.size(F.split(F.get(words, F.lit(0)), "-")) <= 2)
    return F.when(F.size(named) > 0, named).when(single, F.array(start)).otherwise(F.array().cast("array<string>"))


#: What says that something was shown (fixed values).
CLAIM_MARKS = ("показал", "показала", "показали", "показано", "установлено", "выявлено", "доказано", "получен эффект", "получен результат*", "получены результат*")


def claims(sentence: Column, most: int = 120) -> Column:
    """What a sentence says was shown, up to its end, cut at a word. Pieces of sentences, which
    begin with a small letter, a digit or a bracket, say nothing."""
    whole = F.trim(sentence)
    mark = "|".join(w.replace(" ", r"\s+").replace("*", r"\p{L}*") for w in sorted(CLAIM_MARKS, key=len, reverse=True))
    tail = F.regexp_extract(whole, rf"(?isu)(?:{mark})(?:[,\s]+(?:что|о\s+том,?\s+что))?[\s,:—-]*(.*)$", 1)
    tail = F.trim(F.regexp_replace(F.substring_index(F.translate(tail, "!?;", "..."), ".", 1), r"\s+", " "))
    head = F.left(tail, F.lit(most - 1))
    cut = F.concat(F.rtrim(F.when(F.instr(head, " ") > 1, F.regexp_extract(head, r"^(.*) ", 1)).otherwise(head), F.lit(" ,;:—-–")), F.lit("…"))
    return F.when(~whole.rlike(r"^[\p{Ll}\d(\[{]") & (F.length(tail) >= 4), F.when(F.length(tail) > most, cut).otherwise(tail))
