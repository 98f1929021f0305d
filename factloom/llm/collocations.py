"""Phrases that stand together more often than their parts would: vertical positional lists.

Texts are lower-cased (A-Z) and cut at `.,;:!?` and line ends; phrases do not cross a cut. A block
of texts becomes a sequence of word numbers and a list of its distinct words with their counts.
Then, for phrases of one word, two words and so on:

* the counts of all blocks are added up, and phrases found less than `least` times are dropped:
  no longer phrase that holds one of them can be found more often;
* each block gets its frequent phrases back as inverted lists of the positions where they start,
  and merge-joins them with the postings of the words that stand next to them, and with the list
  of what begins one word further, which must be frequent, too. The length of such a list is the
  exact count of the longer phrase in the block.

Only counts leave a block, never positions of single occurrences. A block's counts and the
verdicts on them meet by the phrase, in a window: a phrase has one row a block. Blocks are written
to the shared folder before they are used, so they are the same for every reader.

A phrase cut into a first part and a rest, found l and r times, scores floor(scale * a * a / (l *
r)), a being its own count; its lowest cut counts, at equal scores the one with the shorter first
part. Products are decimals of 38 digits, exact to counts of 10**15. A phrase is dropped if a
longer one that contains it is found at least `covered` percent as often. The best `top` of each
language come from one range partitioning over language and score: ranks are places in it, and no
task holds a language.

Memory: a block in a worker, a text of any length in slices; a block is at least one text, so its
numbers (4 bytes a word) grow with the longest text.

Nulls, empties, ties: null texts are empty; a null language is `und`, together with a language of
that name. Repeated rows count as often as they stand there. Equal scores go by count descending,
then by phrase in UTF-8 byte order. An empty table gives an empty one. Columns may have any names.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from itertools import count

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import common

SCALE = 1_000_000
#: Bytes of text of a block, and of what is split into words at a time.
BLOCK, SLICE = 8 << 20, 1 << 20
_BATCH = 1 << 17
#: A word's id: the number of a partition, of a block in it, and of the word in the block.
_BLOCK_BITS, _LOCAL_BITS = 16, 27
#: Upper case to lower case, and every cut to one sign that no word holds.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + b"." * 9)
_CUT = b"."


# --- blocks --------------------------------------------------------------------


def packed(*arrays: np.ndarray) -> bytes:
    import zstandard

    head = struct.pack(f"<{1 + 2 * len(arrays)}q", len(arrays), *(x for a in arrays for x in (a.dtype.itemsize, a.size)))
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def unpacked(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    (n,) = struct.unpack_from("<q", raw)
    sizes = struct.unpack_from(f"<{2 * n}q", raw, 8)
    at, out = 8 + 16 * n, []
    for width, size in zip(sizes[::2], sizes[1::2]):
        out.append(np.frombuffer(raw, f"<i{width}", size, at))
        at += width * size
    return out


class Words:
    """The words of a block: numbers from 1 on for each word of a language; 0 is a cut."""

    def __init__(self):
        fresh = count(1)
        self.numbers: dict[str, dict] = defaultdict(lambda: defaultdict(fresh.__next__, {_CUT: 0}))
        self.parts: list[np.ndarray] = []
        self.bytes = 0

    def add(self, lang: str, text: bytes) -> None:
        number, at = self.numbers[lang].__getitem__, 0
        self.bytes += len(text)
        while at < len(text):
            end = at + SLICE
            while end < len(text) and text[end] not in b" \t.,;:!?\n\x0b\x0c\r":
                end += 1
            words = text[at:end].translate(_PLAIN).replace(_CUT, b" . ").split()
            self.parts.append(np.fromiter(map(number, words), np.int32, len(words)))
            at = end
        self.parts.append(np.zeros(1, np.int32))

    def rows(self, block: int):
        """The sequence as one row, then a row for each distinct word."""
        import pyarrow as pa

        sequence = np.concatenate(self.parts)
        n = np.bincount(sequence)
        names = ["block", "local", "lang", "word", "n", "lists"]
        types = [pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((block, None, None, None, None, packed(sequence)), types)], names)
        for lang, number in self.numbers.items():
            found = [(w, i) for w, i in number.items() if i]
            for lo in range(0, len(found), _BATCH):
                words, local = zip(*found[lo : lo + _BATCH])
                k = len(local)
                columns = [[block] * k, local, [lang] * k, words, n[list(local)], [None] * k]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def blocks(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(block, local, lang, word, n, lists): rows of words have no lists, rows of lists no word."""

    def run(batches):
        from pyspark import TaskContext

        number, words = TaskContext.get().partitionId() << _BLOCK_BITS, Words()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), common.utf8(batch.column(1))):
                words.add(lang, text)
                if words.bytes >= BLOCK:
                    yield from words.rows(number)
                    number, words = number + 1, Words()
        if words.parts:
            yield from words.rows(number)

    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    return texts.mapInArrow(common.releasing(run), "block long, local int, lang string, word binary, n long, lists binary")


# --- positional lists of a block -----------------------------------------------


class Lists:
    """Where words and frequent phrases of `length` words start in a block, ascending. `words[i]`
    is the id of the i-th distinct word, `phrases[i]` the word ids of the i-th distinct phrase."""

    def __init__(self, at, word, words, start, phrase, phrases):
        self.at, self.word, self.words, self.start, self.phrase, self.phrases = at, word, words, start, phrase, phrases

    @classmethod
    def of_words(cls, sequence: np.ndarray, local: np.ndarray, ids: np.ndarray) -> Lists:
        """From a block's sequence and the ids of its frequent words."""
        known = np.full(int(sequence.max(initial=0)) + 1, -1, np.int32)
        known[local] = np.arange(len(local), dtype=np.int32)
        word = known[sequence]
        at = np.flatnonzero(word >= 0).astype(np.int32)
        return cls(at, word[at], ids, at, word[at], ids[:, None])

    def extended(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts, number, phrases, counts) of the phrases of one more word."""
        k = self.phrases.shape[1]
        beside = np.searchsorted(self.at, self.start + k)
        hit = beside < len(self.at)
        hit[hit] = self.at[beside[hit]] == self.start[hit] + k
        if k > 1:
            rest = np.searchsorted(self.start, self.start + 1)
            both = rest < len(self.start)
            both[both] = self.start[rest[both]] == self.start[both] + 1
            hit &= both
        key = self.phrase[hit].astype(np.int64) * len(self.words) + self.word[beside[hit]]
        keys, number, n = np.unique(key, return_inverse=True, return_counts=True)
        phrases = np.concatenate((self.phrases[keys // len(self.words)], self.words[keys % len(self.words)][:, None]), axis=1) if len(keys) else np.zeros((0, k + 1), np.int64)
        return self.start[hit], number.reshape(-1), phrases, n

    def frequent(self, local: np.ndarray) -> Lists:
        """The lists of the phrases of one more word, those numbered `local` only."""
        start, number, phrases, _ = self.extended()
        known = np.full(len(phrases), -1, np.int32)
        known[local] = np.arange(len(local), dtype=np.int32)
        phrase = known[number]
        return Lists(self.at, self.word, self.words, start[phrase >= 0], phrase[phrase >= 0], phrases[local])

    def packed(self) -> bytes:
        """Positions as steps; lists of single words once."""
        step = lambda x: np.diff(x, prepend=np.int32(0))
        own = (step(self.at), self.word, self.words)
        return packed(*own) if self.phrases.shape[1] == 1 else packed(*own, step(self.start), self.phrase, np.array([self.phrases.shape[1]]), self.phrases.ravel())

    @classmethod
    def unpacked(cls, data: bytes) -> Lists:
        at, word, words, *more = unpacked(data)
        at = np.cumsum(at, dtype=np.int32)
        if not more:
            return cls(at, word, words, at, word, words[:, None])
        start, phrase, width, flat = more
        return cls(at, word, words, np.cumsum(start, dtype=np.int32), phrase, flat.reshape(-1, int(width[0])))


def _columns(length: int) -> list[str]:
    return [f"w{i}" for i in range(length)]


def _known_lists(table: DataFrame, known: DataFrame, first: bool) -> DataFrame:
    """(block, lists): the lists of the frequent phrases `known`, (block, local[, id]), from the
    sequence of each block (`first`) or from the lists of phrases of one word less."""

    def run(left, right):
        import pyarrow as pa

        schema = pa.schema({"block": pa.int64(), "lists": pa.binary()})
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        local = right.column("known_local").to_numpy()
        order = np.argsort(local)
        data = left.column("lists")[0].as_py()
        if first:
            lists = Lists.of_words(unpacked(data)[0], local[order], right.column("known_id").to_numpy()[order])
        else:
            lists = Lists.unpacked(data).frequent(local[order])
        return pa.table([left.column("block"), pa.array([lists.packed()], pa.binary())], schema=schema)

    marks = known.select(*[F.col(x).alias(f"known_{x}") for x in known.columns])
    return table.select("block", "lists").groupBy("block").cogroup(marks.groupBy("known_block")).applyInArrow(run, "block long, lists binary")


def _extended(lists: DataFrame, length: int) -> DataFrame:
    """(own, w0, ..., n): the phrases of `length` words in each block, with their number there
    (block and number as one) and their counts."""
    names = _columns(length)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                _, _, phrases, n = Lists.unpacked(data.as_py()).extended()
                for lo in range(0, len(n), _BATCH):
                    some = slice(lo, min(lo + _BATCH, len(n)))
                    own = (block << _LOCAL_BITS) + np.arange(lo, some.stop)
                    yield pa.RecordBatch.from_arrays([pa.array(own), *[pa.array(np.ascontiguousarray(w)) for w in phrases[some].T], pa.array(n[some].astype(np.int32))], ["own", *names, "n"])

    return lists.select("block", "lists").mapInArrow(common.releasing(run), f"own long, {', '.join(f'{x} long' for x in names)}, n int")


# --- phrases of all blocks ------------------------------------------------------


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 3, least: int = 10) -> tuple[DataFrame, list[DataFrame]]:
    """((lang, n), tables): n words a language, and for each length from one word on the phrases
    found `least` times or more: their word ids w0, w1, ... and a; those of one word also with
    lang and word. Tables of a step are deleted when the next one is written."""
    spark = docs.sparkSession
    folder = common.run_folder(spark, "phrases")
    table = common.materialise(blocks(docs, lang_col, text_col), "blocks", folder=folder)
    words = table.filter(F.col("word").isNotNull())
    sizes = common.materialise(words.groupBy("lang").agg(F.sum("n").alias("n")), "sizes", folder=folder)
    same = Window.partitionBy("lang", "word")
    own = F.shiftleft("block", _LOCAL_BITS) + F.col("local")
    judged = words.select(own.alias("own"), "lang", "word", "n").withColumns({"id": F.min("own").over(same), "a": F.sum("n").over(same)}).filter(F.col("a") >= least)
    judged = judged.select("own", "id", F.when(F.col("own") == F.col("id"), F.struct("lang", "word", "a")).alias("of"))
    known = common.materialise(judged, "known-1", folder=folder)
    levels = [common.materialise(known.filter(F.col("of").isNotNull()).select("of.*", F.col("id").alias("w0")), "words", folder=folder)]
    place = [F.shiftright("own", _LOCAL_BITS).alias("block"), F.col("own").bitwiseAND((1 << _LOCAL_BITS) - 1).alias("local")]
    sequences = table.filter(F.col("lists").isNotNull())
    lists = common.materialise(_known_lists(sequences, known.select(*place, "id"), True), "lists-1", folder=folder)
    for name in ("blocks", "known-1"):
        common.remove(spark, f"{folder}/{name}")
    for length in range(2, longest + 1):
        names, rows = _columns(length), _extended(lists, length)
        if length < longest:
            judged = rows.withColumn("a", F.sum("n").over(Window.partitionBy(*names))).filter(F.col("a") >= least).drop("n")
            known = common.materialise(judged, f"known-{length}", folder=folder)
            found = known.groupBy(*names).agg(F.first("a").alias("a"))
        else:
            found = rows.groupBy(*names).agg(F.sum("n").alias("a")).filter(F.col("a") >= least)
        levels.append(common.materialise(found, f"frequent-{length}", folder=folder))
        if length < longest:
            lists = common.materialise(_known_lists(lists, known.select(*place), False), f"lists-{length}", folder=folder)
            for name in (f"lists-{length - 1}", f"known-{length}"):
                common.remove(spark, f"{folder}/{name}")
    common.remove(spark, f"{folder}/lists-{longest - 1}")
    return sizes, levels


def _scored(levels: list[DataFrame], covered: int, scale: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of all phrases of two words and more that none covers."""
    named = [levels[0].select("w0", "lang", F.col("word").alias("phrase"), "a")]
    out = None
    for length in range(2, len(levels) + 1):
        names, rows = _columns(length), levels[length - 1]
        for cut in range(1, length):
            first = [F.col(x).alias(f"f{x}") for x in _columns(cut)]
            rest = [F.col(x).alias(f"r{y}") for x, y in zip(_columns(length - cut), names[cut:])]
            texts = ["lang", F.col("phrase").alias("head")] if cut == length - 1 else []
            heads = named[cut - 1].select(*first, *texts, F.col("a").alias(f"l{cut}"))
            tails = named[length - cut - 1].select(*rest, *([F.col("phrase").alias("tail")] if texts else []), F.col("a").alias(f"r{cut}"))
            rows = rows.join(heads, [F.col(x) == F.col(f"f{x}") for x in names[:cut]]).drop(*[f"f{x}" for x in names[:cut]])
            rows = rows.join(tails, [F.col(x) == F.col(f"r{x}") for x in names[cut:]]).drop(*[f"r{x}" for x in names[cut:]])
        phrase = F.concat(F.col("head"), F.lit(b" "), F.col("tail"))
        wide = lambda x: F.col(x).cast("decimal(19,0)")
        cuts = [F.struct(F.call_function("div", F.lit(scale).cast("decimal(7,0)") * wide("a") * wide("a"), wide(f"l{c}") * wide(f"r{c}")).alias("score"), F.lit(c).alias("cut"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r")) for c in range(1, length)]
        best = F.least(*cuts) if len(cuts) > 1 else cuts[0]
        named.append(rows.select(*names, "lang", phrase.alias("phrase"), "a", best.alias("best")))
        if length < len(levels):
            longer = levels[length].select(F.col("a").alias("more"), F.explode(F.array(F.struct(*[F.col(f"w{i}").alias(f"c{i}") for i in range(length)]), F.struct(*[F.col(f"w{i + 1}").alias(f"c{i}") for i in range(length)]))).alias("part"))
            most = longer.groupBy("part").agg(F.max("more").alias("more")).select("part.*", "more")
            kept = named[-1].join(most, [F.col(f"w{i}") == F.col(f"c{i}") for i in range(length)], "left")
            kept = kept.filter(F.col("more").isNull() | (100 * F.col("more") < covered * F.col("a")))
        else:
            kept = named[-1]
        kept = kept.select("lang", F.col("phrase").cast("string").alias("phrase"), "a", "best.l", "best.r", "best.score")
        out = kept if out is None else out.unionByName(kept)
    return out


def ranked(rows: DataFrame, top: int) -> DataFrame:
    """The first `top` rows of each language with their rank, from one range partitioning."""
    order = [F.col("lang"), F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = common.materialise(placed, "ranked").withColumn("part", F.shiftright("at", 33))
    # a row for each part and language in it: parts + languages at most
    firsts = placed.groupBy("lang", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = firsts.select(F.col("lang").alias("of"), F.col("part").alias("in"), "first", before.alias("before"))
    joined = placed.join(firsts, (F.col("lang") == F.col("of")) & (F.col("part") == F.col("in")))
    return joined.withColumn("rank", F.col("before") + F.col("at") - F.col("first") + 1).filter(F.col("rank") <= top).drop("of", "in", "first", "before", "at", "part")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 3, least: int = 10, covered: int = 50, top: int = 2000, scale: int = SCALE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language."""
    if longest < 2:
        raise ValueError("phrases have two words or more")
    sizes, levels = frequent_phrases(docs, lang_col, text_col, longest, least)
    best = ranked(_scored(levels, covered, scale), top)
    return best.join(sizes.withColumnRenamed("lang", "of"), F.col("lang") == F.col("of")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
