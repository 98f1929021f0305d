"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from factloom.llm import collocations as c


def brute(rows, longest=3, least=10, covered=50, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) of rows (lang, text)."""
    found = {}
    for lang, text in rows:
        f = found.setdefault(lang if lang is not None else "und", Counter())
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[tuple(w[i : i + k])] += 1
    out = []
    for lang, f in found.items():
        n = sum(a for p, a in f.items() if len(p) == 1)
        kept = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            if any(len(q) > len(p) and b >= least and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in f.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def texts(n, seed=1):
    rnd = random.Random(seed)
    words = ["Alpha", "beta", "ga-mma", "ДОМ", "été", "x", "y", "#1", "tab\tbed", "a.b", "end!", "line\n", "\x0bv", "q,"]
    return [(rnd.choice(["en", "de", None, "und"]), " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 60)))) for _ in range(n)]


ROWS = [*texts(200), ("en", None), ("en", ""), (None, "   "), ("fr", "one two three four. " * 30), ("fr", "one two three four. " * 30), ("es", "so so so so so so so so so so so so so so")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "k", 1) for i, (lang, t) in enumerate(rows)], "block long, text string, lang string, word string, n int")


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_against_brute_force(spark, longest):
    got = c.collocations(frame(spark, ROWS).repartition(5), longest=longest)
    want = brute(ROWS, longest)
    assert rows_of(got) == want and {"fr", "es", "und"} <= {r[0] for r in want}


def test_parameters_and_ties_at_the_cut(spark):
    got = c.collocations(frame(spark, ROWS), least=3, covered=80, top=7)
    assert rows_of(got) == brute(ROWS, least=3, covered=80, top=7)
    with pytest.raises(ValueError):
        c.collocations(frame(spark, ROWS), longest=1)


def test_slices_give_the_same():
    whole, cut = c.Words(), c.Words()
    for lang, text in ROWS:
        whole.add(lang or "und", (text or "").encode())
    c.SLICE = 7
    try:
        for lang, text in ROWS:
            cut.add(lang or "und", (text or "").encode())
    finally:
        c.SLICE = 1 << 20
    assert (np.concatenate(whole.parts) == np.concatenate(cut.parts)).all() and whole.numbers == cut.numbers


def test_many_blocks_give_the_same(spark):
    one = rows_of(c.collocations(frame(spark, ROWS).coalesce(1)))
    many = rows_of(c.collocations(frame(spark, ROWS).repartition(40)))
    assert one == many == brute(ROWS)


def test_lists_hold_every_occurrence():
    sequence = np.array([1, 2, 1, 2, 3, 0, 1, 2, 0, 2, 1, 2], np.int32)
    lists = c.Lists.of_words(sequence, np.array([1, 2]), np.array([100, 200], np.int64))
    start, number, phrases, n = lists.extended()
    assert phrases.tolist() == [[100, 200], [200, 100]] and n.tolist() == [4, 2]
    assert start[number == 0].tolist() == [0, 2, 6, 10]
    longer = lists.frequent(np.array([0, 1]))
    _, _, phrases, n = longer.extended()
    assert phrases.tolist() == [[100, 200, 100], [200, 100, 200]] and n.tolist() == [1, 2]
    back = c.Lists.unpacked(longer.packed())
    assert back.phrases.tolist() == longer.phrases.tolist() and back.start.tolist() == longer.start.tolist()


def test_empty_tables_and_one_language_column_of_numbers(spark):
    assert c.collocations(frame(spark, ROWS).limit(0)).collect() == []
    assert c.collocations(frame(spark, [("en", None), (None, "")])).collect() == []
    rows = [(1, "one two three four. " * 30)]
    got = c.collocations(spark.createDataFrame(rows, "lang int, text string"))
    assert {r.lang for r in got.collect()} == {"1"}


def test_products_beyond_64_bits(spark):
    big = 10**9
    levels = [
        spark.createDataFrame([("en", bytearray(b"a"), big, 1), ("en", bytearray(b"b"), big + 7, 2)], "lang string, word binary, a long, w0 long"),
        spark.createDataFrame([(1, 2, big - 3)], "w0 long, w1 long, a long"),
    ]
    (row,) = c._scored(levels, 50, c.SCALE).collect()
    assert row.score == c.SCALE * (big - 3) ** 2 // (big * (big + 7)) and (row.l, row.r, row.phrase) == (big, big + 7, "a b")
