"""Compression of vectors to a few bytes: a codebook for each part of a vector, fitted exactly.

Components become whole numbers floor(scale * x). Vectors are cut into equal consecutive parts;
each part position has a codebook, which begins as that part of the vectors of the smallest ids.
A round assigns each part to its nearest entry and moves each entry to the floor of the mean of
its parts. All sums are of whole numbers, so results do not depend on how rows are dealt.

The nearest entry is found by partial distances: dimensions are taken in descending variance over
the codebook. The first few are summed for all entries; the best entry so far is then measured
completely, and from there on masks drop every entry of which the sum strictly exceeds the best
complete distance. What is left at the end is complete; ties go to the lower index.

A round is one pass over the vectors: a task sums its own parts by entry, and parts x entries rows
a task are added up. The driver and each task hold the codebooks, whose size is checked
(`MOST_BYTES`); nothing else grows with the input. Whole-number vectors are written once to the
shared folder, and every pass reads them there.

Nulls, empties, ties: rows whose vector is null or holds a null, a NaN or an infinity are dropped.
Rows with equal ids count as often as they stand there; their order is that of their components;
null ids come last. The length is that of the kept vector of the smallest id that can be cut into
equal parts and is not empty. Vectors of another length, and those with a component beyond
+-2**24 after scaling (their distances would pass 64 bits), are returned with null code and error
and do not take part. Fewer rows than entries: as many entries. An empty table gives an empty one.
Columns may have any names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import common

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LARGEST = 1 << 24
#: Codebooks larger than this are refused, as every task holds them.
MOST_BYTES = 64 << 20
#: Distances that are held at a time, for all entries of some vectors.
_BLOCK = 1 << 19


class Codebook:
    """The entries of one part position and the order in which their dimensions are summed."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.order = np.argsort(-entries.astype(np.float64).var(axis=0), kind="stable")
        self.lead = max(1, entries.shape[1] // 2)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry to each row."""
        index, least = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        largest = max(int(np.abs(x).max(initial=0)), int(np.abs(self.entries).max(initial=0)))
        kind = np.int32 if 4 * largest * largest * x.shape[1] < 1 << 31 else np.int64  # sums fit
        table = np.ascontiguousarray(self.entries.T, kind)
        step = max(1, _BLOCK // len(self.entries))
        for lo in range(0, len(x), step):
            index[lo : lo + step], least[lo : lo + step] = self._nearest(np.ascontiguousarray(x[lo : lo + step].T, kind), table)
        return index, least

    def _nearest(self, x: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x: dimensions by vectors; table: dimensions by entries."""

        def complete(entry: np.ndarray) -> np.ndarray:
            return ((x - table[:, entry]) ** 2).sum(axis=0, dtype=x.dtype)

        n = x.shape[1]
        sums = np.zeros((n, table.shape[1]), x.dtype)
        for d in self.order[: self.lead]:
            apart = x[d][:, None] - table[d]
            apart *= apart
            sums += apart
        best = complete(sums.argmin(axis=1))
        at = np.flatnonzero(sums <= best[:, None])  # by row, then by entry
        row, entry = np.divmod(at.astype(np.int32), np.int32(table.shape[1]))
        sums = sums.ravel()[at]
        rest = self.order[self.lead :]
        for i, d in enumerate(rest):
            sums += (x[d][row] - table[d][entry]) ** 2
            if i == len(rest) // 3:  # what leads now may be nearer than what led then
                starts = np.searchsorted(row, np.arange(n))
                lowest = np.minimum.reduceat(sums, starts)
                hit = np.flatnonzero(sums == lowest[row])
                _, first = np.unique(row[hit], return_index=True)
                best = np.minimum(best, complete(entry[hit[first]]))
            alive = sums <= best[row]
            row, entry, sums = row[alive], entry[alive], sums[alive]
        least = np.minimum.reduceat(sums, np.searchsorted(row, np.arange(n)))
        hit = np.flatnonzero(sums == least[row])
        _, first = np.unique(row[hit], return_index=True)
        return entry[hit[first]], least


@dataclass(frozen=True)
class Codebooks:
    """What `fit` learns: for each part position its entries, whole numbers."""

    entries: tuple[np.ndarray, ...]
    scale: int

    @property
    def length(self) -> int:
        return sum(e.shape[1] for e in self.entries)

    @property
    def sha256(self) -> str:
        """Of all components by part, entry and position, in decimals with commas between."""
        return hashlib.sha256(",".join(str(x) for e in self.entries for x in e.ravel().tolist()).encode()).hexdigest()


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """(id, label, x): the kept rows, x as array<int>; null where a component is too large."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    small = F.forall("v", lambda c: F.abs(c) < LARGEST / scale)
    x = F.transform("v", lambda c: F.floor(c * scale).cast("int"))
    return rows.filter(finite).select("id", "label", F.when(small, x).alias("x"))


def _matrix(column, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the batch whose vector has this length, their vectors)."""
    import pyarrow.compute as pc

    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), length), False).to_numpy(zero_copy_only=False))
    if not len(rows):
        return rows, np.zeros((0, length), np.int64)
    return rows, column.take(rows).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(rows), length)


def _sums(x: DataFrame, books: Codebooks) -> DataFrame:
    """(part, entry, n, total): the parts of each entry, counted and summed."""
    width = books.length // len(books.entries)

    def run(batches):
        import pyarrow as pa

        found = [Codebook(e) for e in books.entries]
        count = [np.zeros(len(e), np.int64) for e in books.entries]
        total = [np.zeros(e.shape, np.int64) for e in books.entries]
        for batch in batches:
            _, rows = _matrix(batch.column(0), books.length)
            for p, book in enumerate(found):
                part = rows[:, p * width : (p + 1) * width]
                index, _ = book.nearest(part)
                order = np.argsort(index, kind="stable")
                used, first, n = np.unique(index[order], return_index=True, return_counts=True)
                if len(used):
                    count[p][used] += n
                    total[p][used] += np.add.reduceat(part[order], first, axis=0)
        for p in range(len(found)):
            used = np.flatnonzero(count[p])
            columns = [pa.array(np.full(len(used), p), pa.int32()), pa.array(used, pa.int32()), pa.array(count[p][used]), pa.array(list(total[p][used]), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "total"])

    found = x.select("x").mapInArrow(common.releasing(run), "part int, entry int, n long, total array<long>")
    return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[j]) for j in range(width)]).alias("total"))


def fit(x: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """The codebooks of the rows of `whole_numbers`; none if no row can be cut. x is read
    rounds + 2 times, so it should be a written table."""
    whole = x.filter((F.size("x") > 0) & (F.size("x") % parts == 0))
    order = [F.col("id").asc_nulls_last(), F.col("x")]
    first = whole.orderBy(*order).limit(1).collect()
    if not first:
        return None
    length = len(first[0].x)
    if entries * length * 8 > MOST_BYTES:
        raise ValueError(f"codebooks of {entries} entries for vectors of {length} components exceed {MOST_BYTES} bytes")
    seeds = np.array([r.x for r in whole.filter(F.size("x") == length).orderBy(*order).limit(entries).collect()], np.int64)
    books = Codebooks(tuple(np.split(seeds, parts, axis=1)), scale)
    for _ in range(rounds):
        moved = [e.copy() for e in books.entries]
        for r in _sums(whole, books).collect():  # parts x entries rows at most
            moved[r.part][r.entry] = [t // r.n for t in r.total]
        books = Codebooks(tuple(moved), scale)
    return books


def encoded(x: DataFrame, books: Codebooks) -> DataFrame:
    """(id, label, code, error) of the rows of `whole_numbers`: for each part the index of its
    entry, two hex digits up to 256 entries and more beyond, and the squared distances summed."""
    width = books.length // len(books.entries)
    digits = max(2, (len(f"{len(books.entries[0]) - 1:x}") + 1) // 2 * 2)
    kinds = [x.schema[c].dataType.simpleString() for c in ("id", "label")]

    def run(batches):
        import pyarrow as pa

        found = [Codebook(e) for e in books.entries]
        for batch in batches:
            rows, vectors = _matrix(batch.column(2), books.length)
            error = np.zeros(len(rows), np.int64)
            code = np.full(len(rows), "", object)
            for p, book in enumerate(found):
                index, least = book.nearest(vectors[:, p * width : (p + 1) * width])
                error += least
                code += np.array([f"{i:0{digits}x}" for i in range(len(book.entries))], object)[index]
            codes, errors = np.full(batch.num_rows, None, object), np.full(batch.num_rows, None, object)
            codes[rows], errors[rows] = code, error
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["id", "label", "code", "error"])

    return x.select("id", "label", "x").mapInArrow(common.releasing(run), f"id {kinds[0]}, label {kinds[1]}, code string, error long")


def decoded(coded: DataFrame, books: Codebooks) -> DataFrame:
    """(id, label, vector) of the rows of `encoded`: the entries put together and scaled back;
    null for a null code."""
    digits = max(2, (len(f"{len(books.entries[0]) - 1:x}") + 1) // 2 * 2)
    kinds = [coded.schema[c].dataType.simpleString() for c in ("id", "label")]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            vectors = [None if c is None else np.concatenate([e[int(c[p * digits : (p + 1) * digits], 16)] for p, e in enumerate(books.entries)]) / books.scale for c in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vectors, pa.list_(pa.float64()))], ["id", "label", "vector"])

    return coded.select("id", "label", "code").mapInArrow(common.releasing(run), f"id {kinds[0]}, label {kinds[1]}, vector array<double>")


def compressed(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks | None]:
    """((id, label, code, error, label_error), codebooks). label_error: the errors of all rows of
    the label, nulls together. Labels are summed before they meet the rows; the sums are a written
    table, so Spark knows their size when it chooses how to join them."""
    x = common.materialise(whole_numbers(vectors, id_col, vec_col, label_col, scale), "codes-x")
    books = fit(x, parts, entries, rounds, scale)
    if books is None:
        rows = x.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    else:
        rows = common.materialise(encoded(x, books), "codes")
    sums = common.materialise(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "codes-labels")
    return rows.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of"), books
