"""Vector codes against plain loops over all entries."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import codes
from factloom.llm import queries as q

SCHEMA = "vec_id long, embedding array<float>, label int, x string"


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """(id, label, code, error) by complete distances to all entries, and the books."""
    kept = [(i, lab, [math.floor(scale * c) for c in v]) for i, v, lab in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[2]))
    if not kept:
        return [], []
    width = len(kept[0][2]) // parts
    cut = [[r[2][p * width : (p + 1) * width] for r in kept] for p in range(parts)]
    books = [[list(x) for x in c[:entries]] for c in cut]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for x in cut[p]:
                held.setdefault(nearest(x, books[p])[1], []).append(x)
            for i, xs in held.items():
                books[p][i] = [sum(c) // len(xs) for c in zip(*xs)]
    out = []
    for n, (i, lab, _) in enumerate(kept):
        best = [nearest(cut[p][n], books[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
    return out, books


def test_nearest_is_exact_with_ties():
    rnd = np.random.default_rng(3)
    for width, spread in ((1, 5), (4, 3), (16, 400), (16, 2)):
        book = codes.Codebook(rnd.integers(-spread, spread, (256, width)))
        x = rnd.integers(-spread, spread, (3000, width))
        index, least = book.nearest(x)
        every = ((x[:, None, :] - book.entries[None]) ** 2).sum(axis=2)
        assert (index == every.argmin(axis=1)).all() and (least == every.min(axis=1)).all()


def key(r):
    return tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("entries", [3, 16])
def test_against_brute_force_with_odd_rows(spark, entries):
    rnd = np.random.default_rng(4)
    vectors = [[float(c) for c in v] for v in rnd.normal(0, 0.1, (150, 8)).astype(np.float32)]
    rows = [(i, v, [0, 1, None][i % 3]) for i, v in enumerate(vectors)]
    rows += [(7, vectors[0], 1), (7, vectors[7], 1), (None, vectors[9], None), (200, None, 1), (201, [*vectors[0][:7], None], 1), (202, [*vectors[0][:7], float("nan")], 0), (203, [*vectors[0][:7], float("-inf")], 0)]
    rows += [(300 + i, vectors[5], 2) for i in range(60)]
    df = spark.createDataFrame([(*r, "z") for r in rows], SCHEMA).withColumn("code", F.lit("clash")).repartition(5)
    out, books = codes.compressed(df, entries=entries)
    want, want_books = brute(rows, entries=entries)
    got = out.collect()
    assert sorted(((r.id, r.label, r.code, r.error) for r in got), key=key) == sorted(want, key=key)
    assert [e.tolist() for e in books.entries] == want_books
    sums = {}
    for _, label, _, error in want:
        sums[label] = sums.get(label, 0) + error
    assert all(r.label_error == sums[r.label] for r in got)
    back = codes.decoded(out, books).collect()
    for r in back:
        code = next(g.code for g in got if g.id == r.id and g.label == r.label)
        if sum(g.id == r.id for g in got) == 1:
            assert [math.floor(1024 * c) for c in r.vector] == [c for p in range(4) for c in want_books[p][int(code[2 * p : 2 * p + 2], 16)]]


def test_other_lengths_and_large_components(spark):
    rows = [(0, [], 1, ""), (1, [1.0, 2.0, 3.0], 1, ""), (2, [1.0] * 8, 1, ""), (3, [2.0] * 8, None, ""), (4, [1.0] * 4, None, ""), (5, [1e30] * 8, None, "")]
    out, books = codes.compressed(spark.createDataFrame(rows, SCHEMA))
    got = {r.id: (r.code, r.error, r.label_error) for r in out.collect()}
    assert got == {0: (None, None, 0), 1: (None, None, 0), 2: ("00000000", 0, 0), 3: ("01010101", 0, 0), 4: (None, None, 0), 5: (None, None, 0)}
    assert books.length == 8


def test_empty_table_and_only_nulls(spark):
    for rows in ([], [(1, None, 1, "x")]):
        out, books = codes.compressed(spark.createDataFrame(rows, SCHEMA))
        assert out.collect() == [] and books is None


def test_books_of_a_size_that_tasks_can_hold(spark):
    with pytest.raises(ValueError):
        codes.fit(codes.whole_numbers(spark.createDataFrame([(1, [0.5] * 8, 1, "")], SCHEMA)), entries=1 << 21)


def test_query_whole_table_by_full_distances(spark):
    """The query's last assignment and errors, on a whole table, against all distances at once."""
    folder = "/root/testdata/sf0.01"
    got = {r.vec_id: r for r in q.op11_vector_codes(spark, folder).collect()}
    kept = codes.whole_numbers(spark.read.parquet(f"{folder}/embeddings.parquet"))
    books = codes.fit(kept)
    assert {r.codebooks_sha256 for r in got.values()} == {books.sha256}
    rows = kept.collect()
    assert len(rows) == len(got)
    x = np.array([r.x for r in rows], np.int64)
    for p, e in enumerate(books.entries):
        part = x[:, p * 16 : (p + 1) * 16]
        index = ((part[:, None] - e[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert [got[r.id].code[2 * p : 2 * p + 2] for r in rows] == [f"{i:02x}" for i in index]
