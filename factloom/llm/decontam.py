"""Benchmark decontamination with an Aho-Corasick automaton over word numbers.

Texts are normalised to lower-case (A-Z) words of digits, letters and non-ASCII bytes, and the
benchmark's words are numbered. A window is a run of `window` consecutive words of an item (an
item of fewer words, but not none, is one window). Every window holds one of the pieces of half
a window that start at multiples of that length in its item, so these pieces are the automaton's
patterns: about three nodes a word of the benchmark. A document is scanned once; around a hit, the
windows that hold the piece are looked up by hash and compared word by word. What is hit is
mapped back to word numbers and to code-point offsets of the original text.

The benchmark is numbered by Spark tasks, in blocks of about `block_words` words (a single item
above that is a block of its own), each written to a file of the shared folder; the driver holds
their names only. A worker builds a block's automaton once (200 to 500 bytes a word) and keeps it.
Up to `resident` blocks are one scan; with more, rows are numbered and written once, each group
of `resident` blocks is a scan of them, and what the scans hit is merged by row.

Nulls, empties, ties: a null or wordless text has no words and is clean; a null or wordless
item has no window; items with equal text are all named; repeated document rows are returned
as often as they occur; null ids are kept. An empty benchmark leaves every document clean, an
empty table gives no row. Item ids are whole numbers or strings, document ids of any type.
A document of any length is scanned whole, by the numbers of its words. Items with equal text are
one block's.
"""

from __future__ import annotations

import pickle
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import common

_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
BLOCK_WORDS, RESIDENT = 500_000, 2
#: The number of a word is written in digits of this base, each place with characters of its own,
#: so that no node of the automaton has many children and hits begin at words. Zeros: unknown.
_BASE = 85


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _spread(codes: np.ndarray) -> np.ndarray:
    return common.mix64(codes.astype(np.uint64))


class Block:
    """Items of the benchmark: their words as numbers, and their distinct windows by hash."""

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        self.window, self.piece = window, (window + 1) // 2
        number: dict[bytes, int] = {}
        codes, bounds, names = [], [0], []
        for item, text in items:
            words = words_of(text)
            if words:
                codes += [number.setdefault(w, len(number) + 1) for w in words]
                bounds.append(len(codes))
                names.append(item)
        self.words, self.names = list(number), names
        self.digits = 3 if len(number) < _BASE**3 else 5
        self.codes, self.bounds = np.array(codes, np.int32), np.array(bounds, np.int64)
        size = np.diff(self.bounds)
        count = np.maximum(0, size - window + 1)
        item = np.repeat(np.arange(len(size)), count)
        start = np.repeat(self.bounds[:-1], count) + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        hashes = common.window_hashes(_spread(self.codes), window)[start] if len(start) else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hash, self.start, self.item = hashes[order], start[order], item[order]

    def open(self) -> Block:
        """Build what is not written to the file: the automaton and the characters of words."""
        from ahocorasick import Automaton

        digits = self.digits
        self.unknown = "\0" * digits
        shown = ["".join(chr(1 + place * _BASE + i // _BASE**place % _BASE) for place in range(digits)) for i in range(len(self.words) + 1)]
        self.char = dict(zip(self.words, shown[1:]))
        self.machine = Automaton()
        self.short: list[list[object]] = []
        text = "".join([shown[c] for c in self.codes.tolist()])
        whole: dict[str, int] = {}
        for i, (a, b) in enumerate(zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist())):
            if b - a < self.window:
                which = whole.setdefault(text[a * digits : b * digits], len(self.short))
                self.short += [[]] * (which == len(self.short))
                self.short[which] = [*self.short[which], self.names[i]]
            else:
                for at in range(a, b - self.piece + 1, self.piece):
                    self.machine.add_word(text[at * digits : (at + self.piece) * digits], (self.piece, -1))
        for key, which in whole.items():  # a short item may equal a piece: its value says both
            self.machine.add_word(key, (len(key) // digits, which))
        if len(self.machine):
            self.machine.make_automaton()
        return self

    def scan(self, words: list[bytes]) -> list[tuple[int, int, object]]:
        """[(first word, end word, item id)]: the windows that occur."""
        if not len(self.machine):
            return []
        line = "".join(map(self.char.get, words, repeat(self.unknown)))
        out, pieces = [], []
        for end, (size, which) in self.machine.iter(line):
            end //= self.digits
            if which >= 0:
                out += [(end - size + 1, end + 1, item) for item in self.short[which]]
            if which < 0 or size == self.piece:
                pieces.append(end - size + 1)
        if pieces and len(self.hash):
            out += self._windows(line, pieces)
        return out

    def _windows(self, line: str, pieces: list[int]) -> list[tuple[int, int, object]]:
        """The windows of the line that hold one of these pieces and stand in an item."""
        shift = np.arange(self.window - self.piece + 1)
        starts = np.unique((np.array(pieces)[:, None] - shift).ravel())
        starts = starts[(starts >= 0) & (starts + self.window <= len(line) // self.digits)]
        if not len(starts):
            return []
        chars = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.int64).reshape(-1, self.digits)
        codes = np.where(chars > 0, (chars - 1) % _BASE, 0) @ _BASE ** np.arange(self.digits)
        hashes = common.window_hashes(_spread(codes), self.window)[starts]
        lo, hi = np.searchsorted(self.hash, hashes), np.searchsorted(self.hash, hashes, side="right")
        who = np.repeat(np.arange(len(starts)), hi - lo)
        place = np.repeat(lo, hi - lo) + np.arange(len(who)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
        step = np.arange(self.window)
        same = (codes[starts[who][:, None] + step] == self.codes[self.start[place][:, None] + step]).all(axis=1)
        return [(a, a + self.window, self.names[i]) for a, i in zip(starts[who[same]].tolist(), self.item[place[same]].tolist())]


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open ranges."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point offsets in the original text of ranges of words."""
    raw = np.frombuffer(text.translate(_TABLE), np.uint8)
    inside = np.concatenate(([False], raw != 0x20, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    points = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [(int(points[starts[a]]), int(points[ends[b - 1]])) for a, b in runs]


def compiled(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> list[str]:
    """Write the benchmark's blocks; returns their files."""
    spark = benchmark.sparkSession
    common.arrow_type(benchmark.schema[id_col].dataType.simpleString())
    items = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).filter("text is not null")
    n = F.regexp_count("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"))
    total = items.agg(F.sum(n)).first()[0] or 0
    folder = common.run_folder(spark, "benchmark")
    part = F.pmod(F.xxhash64("text"), F.lit(max(1, -(-total // block_words))))

    def compile_(key, table):
        import pyarrow as pa

        uri = f"{folder}/block-{key[0].as_py():06d}"
        out = common.AtomicFile(uri)
        out.write(pickle.dumps(Block(list(zip(table.column("item").to_pylist(), common.utf8(table.column("text")))), window), protocol=5))
        out.close()
        return pa.table({"uri": [uri]})

    return sorted(r.uri for r in items.withColumn("block", part).groupBy("block").applyInArrow(compile_, "uri string").collect())


_opened: dict[str, Block] = {}


def _open(uris: list[str]) -> list[Block]:
    """Blocks of this worker; those of other runs are let go."""
    for uri in [u for u in _opened if u not in uris]:
        del _opened[uri]
    for uri in uris:
        if uri not in _opened:
            fs, path = common.filesystem(uri)
            with fs.open_input_file(path) as f:
                _opened[uri] = pickle.loads(f.read()).open()
    return [_opened[u] for u in uris]


def _hits(text: bytes, blocks: list[Block]) -> tuple[int, list[tuple[int, int]], set]:
    """(number of words, merged runs of hit words, ids of the items)."""
    words = words_of(text)
    found = [hit for block in blocks for hit in block.scan(words)] if words else []
    return len(words), merged([h[:2] for h in found]), {h[2] for h in found}


def _in_order(items: set) -> list:
    return sorted(items, key=lambda x: (x is not None, x if x is not None else 0))


_RUNS = "array<struct<start:long,end:long>>"


def _runs(runs: list[list[tuple[int, int]]]):
    import pyarrow as pa

    return pa.array([[{"start": a, "end": b} for a, b in r] for r in runs], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))


def _groups(uris: list[str], resident: int) -> list[list[str]]:
    return [uris[i : i + resident] for i in range(0, len(uris), resident)]


def _numbered(docs: DataFrame, text_col: str) -> DataFrame:
    """(row, rest, text): all columns as they are, written once, so that a number stays with its row."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return common.materialise(docs.select(F.monotonically_increasing_id().alias("row"), rest.alias("rest"), F.col(f"`{text_col}`").alias("text")), "benchmark-rows")


def _scans(rows: DataFrame, uris: list[str], resident: int, item_kind: str) -> DataFrame:
    """(row, runs, items) of the rows that any block hits, from one scan a group of blocks."""

    def of(group: list[str]) -> DataFrame:
        def run(batches):
            import pyarrow as pa

            blocks = _open(group)
            for batch in batches:
                found = [_hits(t, blocks) for t in common.utf8(batch.column(1))]
                hit = [i for i, f in enumerate(found) if f[1]]
                if hit:
                    items = pa.array([list(found[i][2]) for i in hit], pa.list_(common.arrow_type(item_kind)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hit)), _runs([found[i][1] for i in hit]), items], ["row", "runs", "items"])

        return rows.select("row", "text").mapInArrow(common.releasing(run), f"row long, runs {_RUNS}, items array<{item_kind}>")

    every = None
    for group in _groups(uris, resident):
        every = of(group) if every is None else every.unionByName(of(group))
    lists = every.groupBy("row").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return lists.withColumnRenamed("row", "_row")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    block_words: int = BLOCK_WORDS,
    resident: int = RESIDENT,
) -> DataFrame:
    """(id, n_words, n_hit, items, spans): per document the hit words, the ids of the items that
    occur in it (sorted), and the hit spans as code-point offsets of the text."""
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, n_hit long, items array<{item_kind}>, spans {_RUNS}"
    uris = compiled(benchmark, item_col, item_text_col, window, block_words)

    def rows_of(ids, texts: list[bytes], found: list[tuple]):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array([f[0] for f in found], pa.int64()),
                pa.array([sum(b - a for a, b in f[1]) for f in found], pa.int64()),
                pa.array([_in_order(f[2]) for f in found], pa.list_(common.arrow_type(item_kind))),
                _runs([spans(t, f[1]) if f[1] else [] for t, f in zip(texts, found)]),
            ],
            ["id", "n_words", "n_hit", "items", "spans"],
        )

    if len(uris) <= resident:

        def run(batches):
            blocks = _open(uris)
            for batch in batches:
                texts = common.utf8(batch.column(1))
                yield rows_of(batch.column(0), texts, [_hits(t, blocks) for t in texts])

        return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(common.releasing(run), schema)

    rows = _numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text")
    both = rows.join(_scans(rows, uris, resident, item_kind), F.col("row") == F.col("_row"), "left")

    def put_together(batches):
        for batch in batches:
            texts, found = common.utf8(batch.column(1)), []
            for text, runs, items in zip(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                found.append((len(words_of(text)), merged([(r["start"], r["end"]) for r in runs or ()]), set(items or ())))
            yield rows_of(batch.column(0), texts, found)

    return both.select("rest.id", "text", "runs", "items").mapInArrow(common.releasing(put_together), schema)


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    share: float = 0.0,
    block_words: int = BLOCK_WORDS,
    resident: int = RESIDENT,
) -> DataFrame:
    """The rows of `docs`, all columns as they are, of which at most `share` of the words are hit.
    With one scan, the scan is the filter: no join, and rows with equal ids do not mix."""
    uris = compiled(benchmark, item_col, item_text_col, window, block_words)
    if len(uris) <= resident:
        at = docs.columns.index(text_col)

        def run(batches):
            import pyarrow as pa

            blocks = _open(uris)
            for batch in batches:
                found = [_hits(t, blocks) for t in common.utf8(batch.column(at))]
                yield batch.filter(pa.array([sum(b - a for a, b in runs) <= share * n for n, runs, _ in found], pa.bool_()))

        return docs.mapInArrow(common.releasing(run), docs.schema)

    rows = _numbered(docs, text_col)
    both = rows.join(_scans(rows, uris, resident, benchmark.schema[item_col].dataType.simpleString()), F.col("row") == F.col("_row"), "left")

    def mark(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for text, runs in zip(common.utf8(batch.column(1)), batch.column(2).to_pylist()):
                hit = sum(b - a for a, b in merged([(r["start"], r["end"]) for r in runs or ()]))
                keep.append(hit <= share * len(words_of(text)))
            yield batch.select(["rest"]).filter(pa.array(keep, pa.bool_()))

    return both.select("rest", "text", "runs").mapInArrow(common.releasing(mark), rows.select("rest").schema).select("rest.*")
