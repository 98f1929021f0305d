"""Facts of tables (E14-E15, F21, M12, X26-X27): long grids (doc_id, table_no, r, c, text) to facts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: chemical signs of a composition's header (fixed values)
SIGNS = frozenset("Cu Ni Co Fe Zn Pb S As Sb Se Te Au Ag Pt Pd Rh Ru Ir Os SiO2 Al2O3 CaO MgO FeO Fe2O3 Fe3O4 TiO2 Cr2O3 MnO Na2O K2O Cl C P Mg Ca Al Si Mn Cr".split())
#: words of a table's text -> phase (fixed values)
PHASES = {"штейн": "штейн", "шлак": "шлак", "файнштейн": "файнштейн", "концентрат": "концентрат", "раствор": "раствор", "электролит": "электролит", "matte": "штейн", "slag": "шлак"}
#: Cyrillic letters that look like Latin ones (fixed values)
LOOKALIKE = str.maketrans("АВЕКМНОРСТХаеорсух", "ABEKMHOPCTXaeopcyx")
_TOTAL = re.compile(r"(?i)^(?:итого|всего|сумма|total|sum|прочие|остальн)")
_RANGE = re.compile(r"^\s*([<>≤≥~≈]?)\s*(\d+(?:[.,]\d+)?)\s*(?:[-–—…]\s*(\d+(?:[.,]\d+)?))?\s*$")
_COMPARE = {"<": "<", "≤": "<=", ">": ">", "≥": ">=", "~": "~", "≈": "~", "": "="}


def sign(cell: str) -> str | None:
    """A header cell as a chemical sign."""
    token = re.sub(r"[\s,%*()]+", "", cell or "").translate(LOOKALIKE)
    return token if token in SIGNS else None


def cell_value(cell: str) -> tuple[str, float | None, float | None] | None:
    """(comparator, low, high) of a cell; letters, years and more than one dash are none."""
    m = _RANGE.match(cell or "")
    if not m:
        return None
    a = float(m[2].replace(",", "."))
    b = float(m[3].replace(",", ".")) if m[3] else a
    if m[3] and 1900 <= a <= 2100 and 1900 <= b <= 2100:
        return None
    c = _COMPARE[m[1]]
    return c, (None if c in ("<", "<=") else a), (None if c in (">", ">=") else b)


def facts_of(grid: dict[tuple[int, int], str], title: str = "") -> list[dict]:
    """The header is the row or column with the most chemical signs, three at least. Each other
    line is a product; its first cell names it. Percent unless the title says g/t; totals, oxygen and
    percents above 100 are left out."""
    rows = sorted({r for r, _ in grid})
    cols = sorted({c for _, c in grid})
    by_row = {r: sum(sign(grid.get((r, c), "")) is not None for c in cols) for r in rows}
    by_col = {c: sum(sign(grid.get((r, c), "")) is not None for r in rows) for c in cols}
    best_row, best_col = max(rows, key=lambda r: by_row[r], default=None), max(cols, key=lambda c: by_col[c], default=None)
    if best_row is None or max(by_row[best_row], by_col[best_col]) < 3:
        return []
    across = by_row[best_row] >= by_col[best_col]
    heads = {c: sign(grid.get((best_row, c), "")) for c in cols} if across else {r: sign(grid.get((r, best_col), "")) for r in rows}
    lines = [r for r in rows if r > best_row] if across else [c for c in cols if c > best_col]
    unit = "g_t" if re.search(r"г/т|g/t", " ".join([title, *grid.values()])) else "pct"
    out = []
    for line in lines:
        at = (lambda k: grid.get((line, k), "")) if across else (lambda k: grid.get((k, line), ""))  # noqa: B023
        label = at(min(k for k in (cols if across else rows))) or ""
        if _TOTAL.match(label):
            continue
        phase = next((p for w, p in PHASES.items() if w in label.lower()), None) or next((p for w, p in PHASES.items() if w in title.lower()), None)
        for k, name in heads.items():
            value = cell_value(at(k)) if name and name != "O" else None
            if not value or (unit == "pct" and max(x for x in value[1:] if x is not None) > 100):
                continue
            out.append({"canon": name, "metric": "содержание", "unit_canon": unit, "comparator": value[0], "value_low": value[1], "value_high": value[2], "phase": phase, "label": label})
    return out


def is_composition(grid: dict[tuple[int, int], str]) -> bool:
    """half of the numbers are between 0 and 100, and there are some."""
    found = [v for v in map(cell_value, grid.values()) if v]
    small = [v for v in found if all(x is None or 0 <= x <= 100 for x in v[1:])]
    return bool(found) and 2 * len(small) >= len(found)


def _read(rows: DataFrame) -> DataFrame:
    """X27 and M12 as columns of cells: `sign`, and `v` (comparator, low, high), null if the text is no number.
    Each text is taken apart once, and what it gives is put into columns before it is looked at."""
    token = F.translate(F.regexp_replace("text", r"[\s,%*()]+", ""), "".join(map(chr, LOOKALIKE)), "".join(map(chr, LOOKALIKE.values())))
    apart = F.split(F.regexp_replace("text", _RANGE.pattern, "$1\x01$2\x01$3"), "\x01")
    rows = rows.withColumns({"_token": token, "_parts": F.when(F.col("text").rlike(_RANGE.pattern), apart)})
    number = lambda i: F.replace(F.nullif(F.col("_parts")[i], F.lit("")), F.lit(","), F.lit(".")).cast("double")
    rows = rows.withColumns({"_a": number(1), "_to": number(2), "_mark": F.translate(F.col("_parts")[0], "≈", "~")})
    a, b = F.col("_a"), F.coalesce("_to", "_a")
    mark = F.when(F.col("_mark") == "≤", "<=").when(F.col("_mark") == "≥", ">=").when(F.col("_mark") == "", "=").otherwise(F.col("_mark"))
    years = F.col("_to").isNotNull() & a.between(1900, 2100) & b.between(1900, 2100)
    bound = lambda value, *open_at: F.when(~F.col("_mark").isin(*open_at), value)
    value = F.when(a.isNotNull() & ~years, F.struct(mark.alias("comparator"), bound(a, "<", "≤").alias("low"), bound(b, ">", "≥").alias("high")))
    sign = F.when(F.col("_token").isin(*sorted(SIGNS)), F.col("_token"))
    return rows.withColumns({"sign": sign, "v": value}).drop("_token", "_parts", "_a", "_to", "_mark")


def grid_facts(cells: DataFrame) -> DataFrame:
    """E14, F21 over a long table of cells (doc_id, table_no, r, c, text), in windows: which row or
    column is the header, what each line is called, what it says. Cells are dealt out once, by
    table; all windows lie within a table's rows, columns or cells, so a page's worth is sorted
    together and no table is gathered. Null texts are empty; of cells at one place the greatest text
    counts. `facts_of` tells the same of one table in plain Python."""
    one = cells.repartition("doc_id", "table_no").groupBy("doc_id", "table_no", "r", "c").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    table = Window.partitionBy("doc_id", "table_no")
    row, column = Window.partitionBy("doc_id", "table_no", "r"), Window.partitionBy("doc_id", "table_no", "c")
    rows = _read(one)
    rows = rows.withColumns({"in_row": F.count("sign").over(row), "in_column": F.count("sign").over(column)})
    small = F.coalesce(F.col("v.low").between(0, 100), F.lit(True)) & F.coalesce(F.col("v.high").between(0, 100), F.lit(True))
    rows = rows.withColumns(
        {
            "best_row": F.max(F.struct("in_row", (-F.col("r")).alias("at"))).over(table),
            "best_column": F.max(F.struct("in_column", (-F.col("c")).alias("at"))).over(table),
            "numbers": F.count("v").over(table),
            "small": F.count(F.when(F.col("v").isNotNull() & small, 1)).over(table),
            "per_ton": F.max(F.contains("text", F.lit("г/т")) | F.contains("text", F.lit("g/t"))).over(table),
            "first_r": F.min("r").over(table),
            "first_c": F.min("c").over(table),
        }
    )
    rows = rows.filter((F.col("numbers") > 0) & (2 * F.col("small") >= F.col("numbers")) & (F.greatest("best_row.in_row", "best_column.in_column") >= 3))
    across = F.col("best_row.in_row") >= F.col("best_column.in_column")
    head_r, head_c = -F.col("best_row.at"), -F.col("best_column.at")
    rows = rows.withColumns(
        {
            "name": F.when(across, F.max(F.when(F.col("r") == head_r, F.col("sign"))).over(column)).otherwise(F.max(F.when(F.col("c") == head_c, F.col("sign"))).over(row)),
            "label": F.coalesce(F.when(across, F.max(F.when(F.col("c") == F.col("first_c"), F.col("text"))).over(row)).otherwise(F.max(F.when(F.col("r") == F.col("first_r"), F.col("text"))).over(column)), F.lit("")),
        }
    )
    unit = F.when(F.col("per_ton"), "g_t").otherwise("pct")
    line = F.when(across, F.col("r") > head_r).otherwise(F.col("c") > head_c)
    sane = (unit != "pct") | (F.greatest("v.low", "v.high") <= 100)
    phase = F.lit(None).cast("string")
    for word, canon in reversed(PHASES.items()):
        phase = F.when(F.contains(F.lower("label"), F.lit(word)), canon).otherwise(phase)
    kept = rows.filter(line & F.col("name").isNotNull() & F.col("v").isNotNull() & ~F.col("label").rlike("(?iu)" + _TOTAL.pattern.removeprefix("(?i)")) & sane)
    return kept.select("doc_id", "table_no", F.col("name").alias("canon"), F.lit("содержание").alias("metric"), unit.alias("unit_canon"), "v.comparator", F.col("v.low").alias("value_low"), F.col("v.high").alias("value_high"), phase.alias("phase"), "label", F.lit("vision_ocr").alias("source"))


#: What a model that reads page images answers: tables of compositions (fixed format).
ANSWER = "struct<tables: array<struct<phase: string, rows: array<struct<element: string, value: string, unit: string>>>>>"
OXIDES = ("SiO2", "Al2O3", "CaO", "MgO", "FeO", "Fe2O3", "Fe3O4", "TiO2", "Cr2O3", "MnO", "Na2O", "K2O")


def answered_facts(answers: DataFrame, check_text: bool = False) -> DataFrame:
    """Facts of (doc_id, answer[, text]): a model's answers in JSON, which are not trusted. Numbers are
    read by the rules of cells; what is no number, oxygen, and percents above 100 are left out; with
    `check_text` also values that do not stand in the page's text. An answer that is no such JSON
    gives no fact. JVM expressions only."""
    rows = answers.withColumn("a", F.from_json("answer", ANSWER)).select("*", F.explode(F.coalesce("a.tables", F.array().cast("array<struct<phase:string,rows:array<struct<element:string,value:string,unit:string>>>>"))).alias("t"))
    rows = rows.select("*", F.explode(F.coalesce("t.rows", F.array().cast("array<struct<element:string,value:string,unit:string>>"))).alias("r"))
    said, name, raw = F.lower(F.trim(F.coalesce("t.phase", F.lit("")))), F.trim(F.coalesce("r.element", F.lit(""))), F.trim(F.coalesce("r.value", F.lit("")))
    phase = F.lit(None).cast("string")
    for word, canon in reversed(PHASES.items()):
        phase = F.when(F.contains(said, F.lit(word)), canon).otherwise(phase)
    part = lambda i: F.nullif(F.regexp_extract(raw, _RANGE.pattern, i), F.lit(""))
    number = lambda i: F.regexp_replace(part(i), ",", ".").cast("double")
    compare = F.lit("=")
    for mark, canon in _COMPARE.items():
        if mark:
            compare = F.when(part(1) == mark, canon).otherwise(compare)
    a, b = number(2), F.coalesce(number(3), number(2))
    unit_said = F.lower(F.coalesce("r.unit", F.lit("")))
    has = lambda *parts: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(unit_said, p))
    unit = F.when(name.isin(*OXIDES), "pct").when(has("%", "мас", "wt", "pct"), "pct").when(has("г/т", "g/t"), "g_t").when(has("мг/л", "mg/l", "мг/дм"), "mg_L").when(has("ppm"), "ppm").otherwise("pct")
    years = part(3).isNotNull() & a.between(1900, 2100) & b.between(1900, 2100)
    canon = F.when(name.isin(*SIGNS), name).otherwise(F.translate(F.lower(name), "ё", "е"))
    good = (name != "") & (name != "O") & part(2).isNotNull() & ~years & ~((unit == "pct") & (F.greatest(a, b) > 100))
    if check_text:
        good = good & F.contains(F.coalesce("text", F.lit("")), raw)
    low, high = F.when(~compare.isin("<", "<="), a), F.when(~compare.isin(">", ">="), b)
    quote = F.concat(F.lit("таблица состава"), F.coalesce(F.concat(F.lit(" ["), phase, F.lit("]")), F.lit("")), F.lit(" | "), name, F.lit(": "), raw)
    return rows.filter(good).select("doc_id", canon.alias("canon"), F.lit("содержание").alias("metric"), unit.alias("unit_canon"), compare.alias("comparator"), low.alias("value_low"), high.alias("value_high"), phase.alias("phase"), F.lit(0.9).alias("confidence"), F.lit("vision_vl").alias("source"), quote.alias("quote"))
