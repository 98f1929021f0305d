"""Facts of tables by windows against the plain form of one table."""

import random

from factloom.functions import tables

CELLS = "doc_id string, table_no int, r int, c int, text string"


def test_windows_tell_what_one_table_tells(spark):
    rnd = random.Random(3)
    heads = ["Cu", "Ni", "Fe", "S", "SiO2", "СаО", "Au, %", "O", "x", ""]
    values = ["45,5", "20-25", "<3", "≥ 7", "1999-2001", "150", "", "24", "~5", "abc", "12 - 14", None]
    rows, grids = [], {}
    for n in range(120):
        across, size = rnd.random() < 0.5, rnd.randrange(2, 6)
        names = rnd.sample(heads, size)
        grid = {(0, 0): "Продукт, г/т" if n % 9 == 0 else "Продукт"} | {(0, i + 1): x for i, x in enumerate(names)}
        for line in range(1, rnd.randrange(2, 5)):
            grid[line, 0] = rnd.choice(["Штейн 1", "Шлак", "Итого", "прочее", ""])
            grid |= {(line, i + 1): rnd.choice(values) for i in range(size) if rnd.random() < 0.9}
        grid = grid if across else {(c, r): t for (r, c), t in grid.items()}
        key = (f"d{n // 2}", n % 2)
        grids[key] = grid
        rows += [(*key, r, c, t) for (r, c), t in grid.items()]
    rnd.shuffle(rows)
    got = sorted(str((r.doc_id, r.table_no, r.canon, r.unit_canon, r.comparator, r.value_low, r.value_high, r.phase, r.label)) for r in tables.grid_facts(spark.createDataFrame(rows, CELLS)).collect())
    want = []
    for (doc, no), grid in grids.items():
        plain = {k: t or "" for k, t in grid.items()}
        if tables.is_composition(plain):
            want += [str((doc, no, *(f[k] for k in ("canon", "unit_canon", "comparator", "value_low", "value_high", "phase", "label")))) for f in tables.facts_of(plain) if f["canon"] != "O"]
    assert got == sorted(want) and len(got) > 50


def test_no_cells(spark):
    assert tables.grid_facts(spark.createDataFrame([], CELLS)).collect() == []
    assert tables.grid_facts(spark.createDataFrame([("d", 1, 0, 0, None)], CELLS)).collect() == []


def test_a_text_is_taken_apart_once(spark):
    rnd = random.Random(4)
    pieces = ["<", "≤", "≥", ">", "~", "≈", " ", "", "12", "1999", "2001", "7,5", "0.3", "-", "–", "—", "…", "\x01", "Cu", "Сu, %", "SiO2", "\n", "|", "$1"]
    texts = ["", "≈ 5,5", "≤7", "≥ 7-9", "1990–2000", "1990", "\x011\x012", "5\x01", *("".join(rnd.choices(pieces, k=rnd.randrange(1, 5))) for _ in range(3000))]
    rows = tables._read(spark.createDataFrame([(x,) for x in texts], "text string"))
    for r in rows.collect():
        assert r.sign == tables.sign(r.text), repr(r.text)
        assert (r.v and tuple(r.v)) == tables.cell_value(r.text), repr(r.text)
    facts = tables.grid_facts(spark.createDataFrame([("d", 1, 0, 0, "Cu")], CELLS))
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") + plan.count("regexp_replace(") <= 2
