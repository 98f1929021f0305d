"""Numeric facts in sentences (E01-E09, J22): value, unit, metric, material, phase, comparator.

One reader serves corpus and query. A sentence is cut into tokens (numbers, words, signs) once;
quantities are read off the list of tokens, and what a quantity is about is looked for among
the tokens before and behind it. Words are matched by stem and ending, as no morphology library
is at hand; units are looked up by spelling.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import asdict, dataclass, field

# --- fixed values: what the words mean, as the data to be read uses them ----------

#: spelling of a unit -> (canonical unit, factor, offset)
UNITS = {
    "А/дм2": ("A_m2", 100.0, 0.0),
    "A/дм2": ("A_m2", 100.0, 0.0),
    "А/м2": ("A_m2", 1.0, 0.0),
    "A/м2": ("A_m2", 1.0, 0.0),
    "A/m2": ("A_m2", 1.0, 0.0),
    "мг/дм3": ("mg_L", 1.0, 0.0),
    "мг/л": ("mg_L", 1.0, 0.0),
    "mg/dm3": ("mg_L", 1.0, 0.0),
    "mg/L": ("mg_L", 1.0, 0.0),
    "mg/l": ("mg_L", 1.0, 0.0),
    "г/дм3": ("mg_L", 1000.0, 0.0),
    "г/л": ("mg_L", 1000.0, 0.0),
    "g/dm3": ("mg_L", 1000.0, 0.0),
    "g/L": ("mg_L", 1000.0, 0.0),
    "g/l": ("mg_L", 1000.0, 0.0),
    "ppm": ("ppm", 1.0, 0.0),
    "г/т": ("g_t", 1.0, 0.0),
    "g/t": ("g_t", 1.0, 0.0),
    "дм3/мин": ("m3_h", 0.06, 0.0),
    "л/мин": ("m3_h", 0.06, 0.0),
    "м3/ч": ("m3_h", 1.0, 0.0),
    "л/ч": ("m3_h", 0.001, 0.0),
    "т/сут": ("t_day", 1.0, 0.0),
    "т/ч": ("t_day", 24.0, 0.0),
    "т/год": ("t_day", 1.0 / 365.0, 0.0),
    "°C": ("degC", 1.0, 0.0),
    "°С": ("degC", 1.0, 0.0),
    "оC": ("degC", 1.0, 0.0),
    "оС": ("degC", 1.0, 0.0),
    "oC": ("degC", 1.0, 0.0),
    "oС": ("degC", 1.0, 0.0),
    "℃": ("degC", 1.0, 0.0),
    "K": ("degC", 1.0, -273.15),
    "К": ("degC", 1.0, -273.15),
    "%": ("pct", 1.0, 0.0),
    "процент": ("pct", 1.0, 0.0),
    "процента": ("pct", 1.0, 0.0),
    "проценте": ("pct", 1.0, 0.0),
    "процентов": ("pct", 1.0, 0.0),
    "проценту": ("pct", 1.0, 0.0),
    "проценты": ("pct", 1.0, 0.0),
    "рН": ("pH", 1.0, 0.0),
    "pH": ("pH", 1.0, 0.0),
}
#: units of letters only, which must not go on in a word
WHOLE = frozenset(["K", "К", "процент", "процента", "проценте", "процентов", "проценту", "проценты"])
#: stem -> metric
METRICS = {
    "концентраци": "концентрация",
    "содержани": "содержание",
    "содержал": "содержание",
    "содержит": "содержание",
    "извлечени": "извлечение",
    "температур": "температура",
    "плотност": "плотность тока",
    "скорост": "скорость",
    "расход": "расход",
    "производительност": "производительность",
    "остатк": "остаток",
    "остаток": "остаток",
    "выход": "выход",
}
#: metric -> units it is measured in
METRIC_UNITS = {
    "температура": {"degC"},
    "плотность тока": {"A_m2"},
    "расход": {"m3_h"},
    "скорость": {"m3_h"},
    "производительность": {"t_day"},
    "pH": {"pH"},
    "остаток": {"mg_L", "ppm"},
    "содержание": {"mg_L", "g_t", "pct", "ppm"},
    "концентрация": {"mg_L", "g_t", "pct", "ppm"},
    "извлечение": {"pct"},
    "выход": {"pct"},
}
#: unit -> the metric that it tells
UNIT_METRIC = {"degC": "температура", "A_m2": "плотность тока", "m3_h": "расход", "t_day": "производительность", "pH": "pH"}
#: stem -> material
MATERIALS = {
    "сульфат": "сульфат",
    "никел": "никель",
    "хлорид": "хлорид",
    "мпг": "МПГ",
    "мед": "медь",
    "кобальт": "кобальт",
    "желез": "железо",
    "цинк": "цинк",
    "серебр": "серебро",
    "золот": "золото",
    "платин": "платина",
}
#: symbol of an element -> material
ELEMENTS = {
    "Cu": "медь",
    "Ni": "никель",
    "Fe": "железо",
    "Zn": "цинк",
    "Co": "кобальт",
    "Au": "золото",
    "Ag": "серебро",
    "Pt": "платина",
    "Pd": "палладий",
    "Sb": "сурьма",
    "Se": "селен",
    "Pb": "свинец",
    "As": "мышьяк",
    "S": "сера",
}
#: stem -> phase
PHASES = {"штейн": "штейн", "шлак": "шлак", "файнштейн": "файнштейн", "раствор": "раствор", "католит": "католит", "анолит": "анолит"}
#: words before a number, by what they make of it
AT_MOST = ("не более", "не выше", "не превышает", "до")
AT_LEAST = ("не менее", "не ниже", "от")
ABOVE = ("свыше", "более", "выше", "превышает")
BELOW = ("менее", "ниже", "менее чем")
ABOUT = ("около", "порядка", "приблизительно", "примерно")
COMPARATORS = {"<=": AT_MOST, ">=": AT_LEAST, ">": ABOVE, "<": BELOW, "~": ABOUT}
SIGNS = {"<": "<", ">": ">", "≤": "<=", "≥": ">=", "<=": "<=", ">=": ">=", "±": "±", "~": "~", "≈": "~"}
#: stems of verbs after which `до X` is a value that was reached
REACHED = ("довел", "доведен", "нагрел", "нагрет", "подня", "достиг", "разогрел", "разогрет")
#: marks of a reference to literature
BIBLIOGRAPHY = ("с.", "s.", "стр.", "№", "т.", "vol.", "pp.", "doi", "issn", "тираж")
#: stems of what makes a liquid of what is measured in ppm
LIQUIDS = ("раствор", "вод", "электролит", "жидк", "католит", "анолит")
#: prepositions: after the first two the matrix is named, after the others something else
INTO, OTHER = ("в", "во"), ("и", "с", "со", "на", "из", "от", "по", "к", "о", "об", "у")
#: stem of a unit of time -> canonical unit
TIMES = {"мин": "min", "ч": "h", "час": "h", "сек": "s", "сут": "day"}
TIME_ENDINGS = ("", "ут", "уты", "ута", "а", "ов", "унд", "унды", "ок", "ки")
#: what joins the two ends of a range, besides `до`
JOINTS = ("–", "—", "-", "÷", "…", "...")
ENDINGS = frozenset("а у ом е ы ов ам ами ах я ю ем и ей ям ями ях ь ью о ием ии ию ия ий ие иям иями ла ло ли".split()) | {""}

#: How far, in characters, a material, a phase and a close material are looked for.
FAR, NEAR = 80, 15
_LONGEST_UNIT = max(map(len, UNITS)) + 2
_SAME = str.maketrans({"²": "2", "³": "3", " ": " "})

# --- tokens ---------------------------------------------------------------------


@dataclass(frozen=True)
class Token:
    kind: str  # number, word, sign
    text: str
    start: int
    end: int
    value: float = 0.0


def number(text: str) -> float:
    """Spaces between thousands, decimal comma or point."""
    return float("".join(text.replace(",", ".").split()))


def _digits(text: str, at: int) -> int:
    """Where the run of digits at `at` ends."""
    while at < len(text) and text[at].isdecimal():
        at += 1
    return at


def _number_end(text: str, at: int) -> int:
    """Where the number at `at` ends: digits, groups of three after a space, a decimal part."""
    end = _digits(text, at)
    if end - at <= 3:
        while end < len(text) and text[end] in "  " and _digits(text, end + 1) == end + 4:
            end += 4
    if end < len(text) and text[end] in ".," and _digits(text, end + 1) > end + 1:
        end = _digits(text, end + 1)
    return end


def tokens(text: str) -> list[Token]:
    """Numbers, words (with hyphens inside) and signs, in order."""
    out: list[Token] = []
    at = 0
    while at < len(text):
        c = text[at]
        if c.isdecimal():
            end = _number_end(text, at)
            out.append(Token("number", text[at:end], at, end, number(text[at:end])))
        elif c.isalpha():
            end = at + 1
            while end < len(text) and (text[end].isalpha() or text[end] == "-" and end + 1 < len(text) and text[end + 1].isalpha()):
                end += 1
            out.append(Token("word", text[at:end], at, end))
        elif c.isspace():
            end = at + 1
        else:
            end = at + (3 if text.startswith("...", at) else 2 if text[at : at + 2] in SIGNS else 1)
            out.append(Token("sign", text[at:end], at, end))
        at = end
    return out


def _plain(word: str) -> str:
    return word.lower().replace("ё", "е")


def stem_of(word: str, lexicon: dict[str, str]) -> str | None:
    """The entry whose stem and a noun's ending make the word (its first part, if hyphened)."""
    word = _plain(word)
    for part in (word, word.partition("-")[0]):
        for size in range(len(part), 1, -1):
            if part[:size] in lexicon and part[size:] in ENDINGS:
                return lexicon[part[:size]]
    return None


# --- quantities -----------------------------------------------------------------


@dataclass
class Value:
    metric: str | None
    material: str | None
    phase: str | None
    comparator: str
    unit_canon: str
    unit_raw: str
    value_low: float | None
    value_high: float | None
    confidence: float
    span_start: int
    span_end: int
    conditions: list[dict] = field(default_factory=list)


def unit_at(text: str, at: int) -> tuple[str, int] | None:
    """(spelling, end) of the longest unit that stands at `at`, white space skipped."""
    while at < len(text) and text[at].isspace():
        at += 1
    for size in range(min(_LONGEST_UNIT, len(text) - at), 0, -1):
        spelling = text[at : at + size].translate(_SAME)
        if spelling[:1] == "°":
            spelling = spelling.replace(" ", "")
        end = at + size
        known = spelling if spelling in UNITS else spelling.lower() if spelling.lower() in WHOLE else None
        if known and not (known in WHOLE and end < len(text) and text[end].isalpha()):
            return known, end
    return None


class Sentence:
    """The tokens of a sentence, and what stands around a quantity in it."""

    def __init__(self, text: str):
        self.text = text
        self.tokens = tokens(text)
        self.starts = [t.start for t in self.tokens]
        self.liquid = any(t.kind == "word" and _plain(t.text).startswith(LIQUIDS) for t in self.tokens)

    def before(self, at: int, reach: int | None = None) -> list[Token]:
        first = 0 if reach is None else bisect_left(self.starts, at - reach)
        return self.tokens[first : bisect_left(self.starts, at)]

    def behind(self, at: int, reach: int) -> list[Token]:
        return self.tokens[bisect_left(self.starts, at) : bisect_left(self.starts, at + reach)]

    def acidity(self, at: int) -> tuple[bool, str | None]:
        """Does `pH` stand before the number, perhaps with a sign or a verb between, and which sign?"""
        sign = None
        for t in reversed(self.before(at, 30)):
            if t.kind == "word" and t.text.replace("р", "p").replace("Н", "H").lower() == "ph":
                return True, sign
            if t.text in SIGNS:
                sign = SIGNS[t.text]
            elif not (t.text in "=:" or _plain(t.text).startswith(("составля", "рав"))):
                break
        return False, None

    def comparator(self, at: int) -> str | None:
        """What the sign or the words just before a number say."""
        left = self.before(at)
        if not left:
            return None
        if left[-1].text in SIGNS:
            return SIGNS[left[-1].text]
        said = [_plain(t.text) if t.kind == "word" else "" for t in left[-2:]]
        for phrase in (" ".join(said), said[-1]):
            for comparator, phrases in COMPARATORS.items():
                if phrase in phrases:
                    reached = phrase == "до" and any(_plain(t.text).startswith(REACHED) for t in left)
                    return "=" if reached else comparator
        return None

    def metric(self, at: int, unit: str) -> str | None:
        """The nearest metric to the left if the unit fits it, else what the unit tells."""
        found = None
        left = self.before(at)
        for t in reversed(left):
            found = stem_of(t.text, METRICS) if t.kind == "word" else None
            if found == "плотность тока" and not any(_plain(x.text).startswith("ток") for x in left):
                found = None
            if found:
                break
        if found and unit in METRIC_UNITS[found]:
            return found
        if unit in UNIT_METRIC:
            return UNIT_METRIC[unit]
        return None if found is None else found if found in ("извлечение", "выход", "остаток") else "содержание"

    def reagent(self, start: int, end: int) -> bool:
        """A share of a reagent (`расход соды 120 %`, `120 % от стехиометрии`), not of a product."""
        right = [_plain(t.text) for t in self.behind(end, 25)]
        if any(a == "от" and b.startswith("стехиометри") for a, b in zip(right, right[1:])):
            return True
        left = [t for t in self.before(start, 40)][-2:]
        return len(left) == 2 and all(t.kind == "word" for t in left) and _plain(left[0].text) == "расход"

    def material(self, start: int, end: int) -> str | None:
        """Near on the left, then on the right up to the next item, then far left; what is
        named after `в` is the matrix and not meant. Symbols of elements last."""
        free: list[Token] = []
        matrix = False
        for t in self.before(start, FAR):
            low = _plain(t.text)
            if low in INTO or low in OTHER:
                matrix = low in INTO
            elif t.kind == "word" and stem_of(t.text, MATERIALS):
                if not matrix:
                    free.append(t)
                matrix = False
        if free and free[-1].start >= start - NEAR:
            return stem_of(free[-1].text, MATERIALS)
        item = []
        for t in self.behind(end, FAR):
            if t.text in (",", ";", "–", "—", "-", "и"):
                break
            item.append(t)
        named = [canon for t in item if t.kind == "word" and (canon := stem_of(t.text, MATERIALS))]
        if named:
            return named[0]
        if free:
            return stem_of(free[-1].text, MATERIALS)
        symbols = [t.text for t in item if t.text in ELEMENTS] or [t.text for t in reversed(self.before(start, 6)) if t.text in ELEMENTS]
        return ELEMENTS[symbols[0]] if symbols else None

    def phase(self, start: int, end: int) -> str | None:
        """The first phase named around."""
        for t in self.before(start, FAR) + self.behind(end, FAR):
            if t.kind == "word" and (phase := stem_of(t.text, PHASES)):
                return phase
        return None

    def cited(self, start: int, end: int) -> bool:
        """A number in a reference."""
        around = f"{self.text[max(0, start - 30) : start]} {self.text[end : end + 30]}".lower()
        words = around.split()
        return any(mark in words or len(mark) > 3 and mark in around for mark in BIBLIOGRAPHY)

    def times(self) -> list[dict]:
        """Numbers with a unit of time."""
        out = []
        for t, unit in zip(self.tokens, self.tokens[1:]):
            if t.kind == "number" and unit.kind == "word":
                stem = next((s for s in sorted(TIMES, key=len, reverse=True) if unit.text.lower().startswith(s) and unit.text.lower()[len(s) :] in TIME_ENDINGS), None)
                if stem:
                    out.append({"kind": "time", "value": t.value, "unit_canon": TIMES[stem]})
        return out

    def quantities(self):
        """(first number, second or None, does `от` open the range, start, end) from left to right."""
        i, n = 0, len(self.tokens)
        while i < n:
            t = self.tokens[i]
            if t.kind != "number":
                i += 1
                continue
            second = None
            if i + 2 < n and self.tokens[i + 2].kind == "number":
                joint = self.tokens[i + 1].text
                if joint in JOINTS or joint.lower() == "до":
                    second = self.tokens[i + 2]
            opened = i > 0 and _plain(self.tokens[i - 1].text) == "от" and second is not None
            start = self.tokens[i - 1].start if opened else t.start
            glued = t.start > 0 and (self.text[t.start - 1].isalnum() or self.text[t.start - 1] in "/^")
            if not glued:  # not a part of a name or formula
                yield t, second, opened, start, (second or t).end
            i += 3 if second else 1


def _quantity(s: Sentence, first: Token, second: Token | None, opened: bool, start: int, end: int) -> Value | None:
    """One fact, if a unit says so and it is no reference."""
    unit, sign = unit_at(s.text, end), None
    if unit:
        raw, last = s.text[end : unit[1]].strip(), unit[1]
        canon, factor, offset = UNITS[unit[0]]
    else:
        acid, sign = s.acidity(start)
        if not acid:
            return None
        raw, last, (canon, factor, offset) = "pH", end, UNITS["pH"]
    if s.cited(start, last):
        return None
    if canon == "ppm" and s.liquid:
        canon = "mg_L"  # parts per million of a liquid
    low = high = round(first.value * factor + offset, 6)
    said = sign or s.comparator(start)
    comparator = said or "="
    if second:
        high = round(second.value * factor + offset, 6)
        comparator = said if said in ("<=", ">=") and not opened else "="
    elif comparator == "=":
        words = [_plain(t.text) for t in s.behind(last, 20)[:2]]
        if words[:1] == ["или"] and words[1:]:
            comparator = ">=" if words[1] in ("выше", "более") else "<=" if words[1] in ("ниже", "менее") else "="
    bounds = (None if comparator in ("<", "<=") else low, None if comparator in (">", ">=") else high)
    if canon == "pct" and s.reagent(start, last):
        return Value("расход реагента", None, None, comparator, canon, raw, *bounds, 0.6, start, last)
    metric = "pH" if canon == "pH" else s.metric(start, canon)
    confidence = 1.0 if metric else 0.6
    if None not in bounds and low > high:
        confidence = 0.5
    return Value(metric, s.material(start, last), s.phase(start, last), comparator, canon, raw, *bounds, confidence, start, last)


def parse(text: str | None) -> list[Value]:
    """All facts of a sentence or query, in order."""
    if not text or not any(c.isdecimal() for c in text):
        return []
    s = Sentence(text)
    found = [v for q in s.quantities() if (v := _quantity(s, *q))]
    kinds = {"degC": "temperature", "pH": "pH"}
    for value in found:  # E08: temperature, pH and time that stand beside a fact
        beside = [v for v in found if v is not value and v.unit_canon in kinds]
        value.conditions = [{"kind": kinds[v.unit_canon], "value": v.value_high if v.value_low is None else v.value_low, "unit_canon": v.unit_canon} for v in beside] + s.times()
    return found


def values_udf():
    """E01 as a column: sentences to arrays of values, in Arrow batches."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from factloom.schemas import VALUE

    @F.pandas_udf(T.ArrayType(VALUE))
    def values(text):
        return text.map(lambda t: [asdict(v) for v in parse(t)])

    return values
