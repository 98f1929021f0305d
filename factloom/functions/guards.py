"""Guards before extraction (F19, F20, F23, H07), all JVM expressions.

A line or sentence is cut into tokens once: numbers, words (with a unit's slash and power) and
single signs. Each token gets one letter for its kind; the letters in a row are the shape of the
sentence. Rules look at the shape and at which words there are, found by their sets.

Nulls and empty texts hold no token and are no noise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: words and units that the guards go by ------------------------

#: A line with one of these words is apparatus, not text.
LINE_MARKS = ("УДК", "ГРНТИ", "ISSN", "ISBN", "DOI", "eLIBRARY", "EDN")
LINE_PARTS = ("doi.", "doi:", "dx.doi", "http://", "https://", "www.", "©", "email", "e-mail")
#: What a reference looks like, numbers as 0 and all dashes as one.
CITATIONS = ("С . 0 - 0", "Т . 0 . №", "Vol . 0", "No . 0 , P .", "No . 0 , p .", "No . 0 P .", "No . 0 p .")
#: A title's end, a year of this century (as 2000), an issue's number.
RUNNING_HEADS = ("» 2000 . № 0", "» . 2000 . № 0", '" 2000 . № 0', '" . 2000 . № 0')
#: Money, markets and change: what tells market statistics from measurements.
SCALES = ("млрд", "млн", "тыс")
CURRENCIES = ("долл", "дол", "руб", "евро", "usd")
PRICES = ("долл/т", "долл./т", "доллсша/т", "долл.сша/т", "долларов/т", "долларовсша/т", "центзафунт", "центовзафунт", "долл/унц", "долл./унц")
MARKET = ("рынк", "рыноч", "продаж", "экспорт", "импорт", "прогноз", "квартал", "выручк", "спрос", "потреблени", "поставк", "котиров", "биржев")
MARKET_WHOLE = ("цена", "цены", "цене", "ценов", "lme")
MARKET_PHRASES = ("производство в мире", "производства в мире", "мирового производств", "мировое производств", "мировог производств")
CHANGES = ("рост", "вырос", "вырастет", "снизил", "снизится", "снижени", "увеличил", "увеличится", "увеличени", "сократил", "сократится", "сокращени", "упал", "упадет", "падени", "составил", "составит", "прирост", "подорожа", "подешеве")
CHANGES_AFTER = ("рост", "снижени", "увеличени", "сокращени", "прирост")
AGAINST = ("к", "против", "относительно")
#: Units that stand in columns of numbers; and one more that may stand in a line of its own.
UNITS = ("°c", "°с", "оc", "ос", "%", "мпа", "кпа", "гпа", "мм", "см", "мкм", "нм", "км", "кг", "мг", "т", "квт", "мвт", "гвт", "м3", "м³", "м2", "м²", "мин", "ч", "об/мин", "гц")
UNITS_UPPER = ("А", "В")
UNITS_LINE = ("м",)
#: Ends of Russian verbs and short participles; beginnings and whole words of verbs.
VERB_ENDS = ("ет", "ют", "ит", "ат", "ят", "ется", "ится", "ются", "атся", "лся", "лась", "лось", "лись", "ли", "ла", "ло", "ен", "ена", "ено", "ены", "ан", "ана", "ано", "аны")
VERB_STARTS = ("составля", "содерж", "равн", "достига", "показа", "получ", "приведен", "использ", "применя", "снижа", "повыша", "обеспечива", "наблюда")
VERBS = ("является", "имеет", "был", "была", "было", "были", "будет", "может", "следует", "is", "are", "was", "were", "has", "have", "be", "been")
#: Parts of nouns of measurement: a sentence with one holds a fact without a verb.
MEASURED = ("содержан", "температур", "давлени", "расход", "концентрац", "извлечен", "плотност", "скорост", "прочност", "влажност", "крупност", "степень", "степени", "напряжени", "глубин")
MEASURED_END = "выход"
ACIDITY = ("рН", "pH")
SYMBOLS = ("Fe", "Ni", "Cu", "Co", "Au", "Ag", "Pt", "Pd", "Zn", "Pb", "Al", "Mg", "Si", "Ca", "Ti", "Cr", "Mn", "As", "Se", "Te", "Sb", "Bi", "Sn", "Cd", "Mo", "W", "V", "S")
#: Roles that are read as authors; words that are read as surnames.
ROLES = ("editor", "editors", "junior", "senior", "researcher", "reviewer", "corresponding", "professor", "prof", "редактор", "редакция", "рецензент")
NOT_SURNAMES = (
    "проведен проведён взаимосвязь интересны установлено показано получен получено определен определён рассмотрен предложен разработан выполнен исследован приведен приведён представлен отмечено заключение введение результаты таблица рисунок "
    "федерация республика область институт университет компания общество комбинат завод фабрика корпорация академия лаборатория кафедра министерство россия москва российская российской федеральное государственное "
    "специалист автор докладчик руководитель начальник главный ведущий инженер директор заведующий профессор"
).split()

# --- tokens and shapes ----------------------------------------------------------

_TOKEN = r"\d+(?:[.,]\d+)*|°?\p{L}[\p{L}\d]*(?:/\p{L}[\p{L}\d³]*)?[²³]?|[^\s\p{L}\d]"
#: Kinds of tokens: Year, Number, Percent, Unit, line's unit, Element, Scale, Currency, Against, Dash,
#: siGn before a number, Word, short word (l).
_SIGNS = {"%": "P", "–": "D", "—": "D", "-": "D", "+": "G", "±": "G", "<": "G", ">": "G", "~": "G", "≤": "G", "≥": "G"}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """A value that is computed once and used in several places of an expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(text: Column) -> Column:
    """Numbers, words and signs in a row."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({_TOKEN})"), 1)


def _in(token: Column, words) -> Column:
    return F.array_contains(F.array(*[F.lit(w) for w in words]), token)


def _starts(token: Column, stems) -> Column:
    out = F.lit(False)
    for stem in stems:
        out = out | F.startswith(token, F.lit(stem))
    return out


def kind(token: Column) -> Column:
    """The letter of a token; a sign without a kind is itself."""

    def of(low: Column) -> Column:
        number = F.substring(token, 1, 1).between("0", "9")
        year = number & (F.length(token) == 4) & F.substring(token, 1, 2).isin("19", "20") & ~F.contains(token, F.lit(",")) & ~F.contains(token, F.lit("."))
        sign = F.create_map(*[F.lit(x) for pair in _SIGNS.items() for x in pair])[token]
        letter = F.substring(token, 1, 1)
        out = F.when(year, "Y").when(number, "N").when(sign.isNotNull(), sign)
        out = out.when(_in(low, UNITS) | _in(token, UNITS_UPPER) | F.startswith(low, F.lit("г/")), "U").when(_in(low, UNITS_LINE), "u")
        out = out.when(_in(token, SYMBOLS), "E").when(_in(low, SCALES), "S").when(_starts(low, CURRENCIES), "C").when(_in(low, AGAINST), "A")
        return out.when(F.lower(letter) == F.upper(letter), token).when(F.length(token) >= 3, "W").otherwise("l")

    return let(F.lower(token), of)


def shape(found: Column) -> Column:
    return F.array_join(F.transform(found, kind), "")


# --- lines ----------------------------------------------------------------------


def _address(low: Column) -> Column:
    """A mail address: a sign, a name, a dot and two letters."""
    ends = F.slice(F.split(low, "@"), F.lit(2), F.greatest(F.size(F.split(low, "@")) - 1, F.lit(0)))
    host = lambda end: F.regexp_extract(end, "^[a-z0-9.-]*", 0)
    labels = lambda end: F.split(host(end), "[.]")
    named = lambda end, i, label: (i > 0) & F.substring(label, 1, 1).between("a", "z") & F.substring(label, 2, 1).between("a", "z") & (F.length(F.array_join(F.slice(labels(end), F.lit(1), i), ".")) > 0)
    return F.exists(ends, lambda end: F.exists(F.zip_with(labels(end), F.sequence(F.lit(0), F.size(labels(end)) - 1), lambda label, i: named(end, i, label)), lambda x: x))


def apparatus(line: Column) -> Column:
    """is a line of references, addresses or a running head?"""
    low = F.lower(line)
    words = F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}_]+)"), 1)
    marked = F.arrays_overlap(words, F.array(*[F.lit(x.lower()) for x in LINE_MARKS]))
    for part in LINE_PARTS:
        marked = marked | F.contains(low, F.lit(part))

    def listed(found: Column) -> Column:
        plain = F.transform(found, lambda t: F.when(F.substring(t, 1, 1).between("0", "9"), F.when((F.length(t) == 4) & F.startswith(t, F.lit("20")), "2000").otherwise("0")).when(t.isin("–", "—"), "-").otherwise(t))
        row = F.concat(F.lit(" "), F.array_join(plain, " "), F.lit(" "))
        cited = F.lit(False)
        for head in RUNNING_HEADS:
            cited = cited | F.contains(row, F.lit(f" {head} "))
        row = F.replace(row, F.lit(" 2000 "), F.lit(" 0 "))
        for phrase in CITATIONS:
            cited = cited | F.contains(row, F.lit(f" {phrase} "))
        return cited

    single = F.regexp_extract_all(F.coalesce(line, F.lit("")), F.lit(r"(\d+|[\p{L}_][\p{L}\p{N}_]*|[^\s\p{L}\p{N}_])"), 1)
    return F.coalesce(marked | _address(low) | let(single, listed), F.lit(False))


def kill_lines(text: Column) -> Column:
    """lines of apparatus are emptied; their number stays."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda x: F.when(apparatus(x), F.lit("")).otherwise(x)), "\n")


def number_lines(sentence: Column) -> Column:
    """Lines that hold a number only, perhaps with a unit."""
    alone = lambda form: form.rlike("^[DG]?[NY][UPu]?$")
    return F.size(F.filter(F.split(F.coalesce(sentence, F.lit("")), "\n", -1), lambda line: (F.length(line) <= 40) & alone(shape(tokens(line)))))


# --- sentences ------------------------------------------------------------------


def _market(found: Column, low: Column, form: Column) -> Column:
    """trade, not technique: change against a year; or a market word beside money or a change."""
    plain, flat = F.array_join(low, " "), F.array_join(low, "")
    traded = F.exists(low, lambda w: _starts(w, MARKET) | _in(w, MARKET_WHOLE))
    for phrase in MARKET_PHRASES:
        traded = traded | F.contains(plain, F.lit(phrase))
    yearly = F.lit(False)
    for against in AGAINST:
        yearly = yearly | plain.rlike(f"% ([)] )?{against} (19|20)[0-9][0-9] г")
    money = F.contains(form, F.lit("SC")) | F.contains(form, F.lit("S.C"))
    for price in PRICES:
        money = money | F.contains(flat, F.lit(price))
    share = lambda i: F.substring(form, i + 1, F.lit(1)).isin("P") | (F.get(low, i).isin("млн", "тыс") & F.exists(F.slice(low, i + 2, F.lit(2)), lambda w: w == "т"))
    near = lambda i, j: F.length(F.array_join(F.slice(found, i + 2, F.greatest(j - i - 1, F.lit(0))), " "))
    places = F.sequence(F.lit(0), F.size(low) - 1)
    number = lambda j: F.get(low, j).rlike("^[0-9]")
    before = F.exists(places, lambda i: _starts(F.get(low, i), CHANGES) & F.exists(F.sequence(i, F.least(i + 12, F.size(low) - 1)), lambda j: (j > i) & number(j) & (near(i, j) <= 32) & share(j + 1)))
    after = F.exists(places, lambda i: number(i) & F.get(low, i + 1).eqNullSafe("%") & F.exists(F.sequence(i, F.least(i + 10, F.size(low) - 1)), lambda j: (j > i + 1) & _starts(F.get(low, j), CHANGES_AFTER) & (near(i + 1, j) <= 24)))
    return yearly | (traded & (money | before | after))


def _measured(found: Column) -> Column:
    """A noun of measurement, unless it stands in capitals, as a heading does."""
    stem = lambda low: F.exists(F.array(*[F.lit(x) for x in MEASURED]), lambda s: F.contains(low, s)) | F.endswith(low, F.lit(MEASURED_END))
    return F.exists(found, lambda w: _in(w, ACIDITY) | (F.lower(F.substring(w, 2, 99)) == F.substring(w, 2, 99)) & stem(F.lower(w)))


def _garble(sentence: Column, found: Column, form: Column) -> Column:
    """columns of numbers, mostly digits, or the legend of a figure."""
    run = form.rlike("([DG]?[NY]+[.,]*[UP]){3}")
    signs = F.length(sentence) - F.length(F.translate(sentence, "0123456789.,;:%–—-/()°", ""))
    dense = (F.length(sentence) >= 40) & (signs > 0.4 * F.length(sentence)) & ~_measured(found)
    places = F.sequence(F.lit(0), F.size(found) - 1)
    legend = F.size(F.filter(places, lambda i: (F.get(found, i) == "(") & F.get(found, i + 1).rlike("^[0-9а-жa-g]$") & F.get(found, i + 2).eqNullSafe(")"))) >= 3
    return run | (number_lines(sentence) >= 3) | dense | legend


def _verb(word: Column) -> Column:
    """Words in capitals are headings, not verbs."""
    ends = F.lit(False)
    for n in sorted({len(x) for x in VERB_ENDS}):
        ends = ends | (F.length(word) >= n + 2) & _in(F.right(word, F.lit(n)), [x for x in VERB_ENDS if len(x) == n])
    return ends | _starts(word, VERB_STARTS) | _in(word, VERBS) | word.rlike("^[a-z]{3,}ed$")


def _wordless(found: Column, form: Column, words: Column) -> Column:
    """a few words without a verb that tie no number to anything."""
    bound = form.rlike("[A-Za-z)]DG?[NY]") & ~form.rlike("^[DG]")
    element = form.rlike("[NY][PU]?E|E[(D:]{0,3}[NY]")
    verb = F.exists(found, _verb)
    return ~(bound | _measured(found) | element | verb) & (words < 6)


def noise(sentence: Column) -> Column:
    """why a sentence is not worth reading: market, garble, no_verb, or null."""
    words = F.size(F.regexp_extract_all(sentence, F.lit("([А-Яа-яЁёA-Za-z]{3,})"), 1))

    def judged(x: Column) -> Column:
        found, low, form = x["found"], x["low"], x["form"]
        return F.when(_market(found, low, form), "market").when(_garble(x["sent"], found, form), "garble").when(_wordless(found, form, x["words"]), "no_verb")

    found = tokens(sentence)
    inner = lambda f: F.struct(sentence.alias("sent"), f.alias("found"), F.transform(f, F.lower).alias("low"), shape(f).alias("form"), words.alias("words"))
    return F.when(F.size(found) > 0, let(let(found, inner), judged))


# --- authors --------------------------------------------------------------------


def junk_author(name: Column) -> Column:
    """whatever is not a Russian surname, alone or with one or two initials: roles, Latin
    letters, words and organisations read as surnames."""
    parts = F.split(F.trim(F.coalesce(name, F.lit(""))), r"\s+")
    surname, initials = F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    halves = F.split(surname, "-")
    named = F.forall(halves, lambda h: h.rlike("^[А-ЯЁ][а-яё]+$")) & (F.size(halves) <= 2) & (F.length(F.get(halves, F.lit(0))) >= 3)
    letters = F.replace(initials, F.lit("."), F.lit(""))
    initialled = letters.rlike("^[А-ЯЁ]{0,2}$") & (F.length(initials) <= 2 * F.length(letters)) & ~F.startswith(initials, F.lit(".")) & ~F.contains(initials, F.lit(".."))
    role = F.arrays_overlap(F.split(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}]+"), F.array(*[F.lit(x) for x in ROLES]))
    return ~(named & initialled & (F.size(parts) <= 2)) | role | _in(F.lower(surname), NOT_SURNAMES)
