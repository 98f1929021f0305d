"""Substring dedup: winnowed seeds, extended both ways window by window.

A match is a run of at least `least` words that also starts in a document with a smaller id.
Of the k-grams in each window of `least` words the one with the smallest hash is the window's
anchor (winnowing), so two equal windows have equal anchors at the same place. Seeds are
anchors that occur in more than one document. A seed is extended to either side by all windows
that it anchors; they meet the equal windows of other documents under the same seed, and the
smallest id among those decides. Matches that touch grow together: the maximal repeats are the
unions of the windows that occur in a document with a smaller id. Documents are not paired: a
pair of documents for each shared seed is quadratic in the copies of a passage.

Documents are packed into blocks, written once to the shared folder; all steps exchange
packed arrays between blocks and hash buckets, never one row a word:

1. blocks -> buckets: the distinct anchor hashes of the block;
2. buckets -> blocks: one bit for each: is it in another block too;
3. blocks -> buckets: the distinct window hashes under seeds, each with its smallest id here;
4. buckets -> blocks: one bit for each: is there a smaller id elsewhere.

So a passage that a third of all documents share counts once a block, no pairs are made, and
no result depends on the size of a group. Buckets are as many as the words, which are counted,
need to hold about `BUCKET_HASHES` each. A window is told by 128 bits, two hashes of 64 from
independent hashes of its words; anchors, which only select, by 64.

Nulls, empties, ties: a null text has no words; ids must be whole numbers; a null id counts
as larger than any other and never removes anything; rows with equal ids never remove from
each other; a text of fewer than `least` words stays whole; an empty table gives no row. A very
long text is a block alone, whose hashes (some tens of bytes a word) are in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm import common

_NO_ID = (1 << 63) - 1
#: Text in a block, and hashes in a bucket, about.
BLOCK_BYTES, BUCKET_HASHES = 4 << 20, 1 << 20
_SLICE = 1 << 19


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, n_words, ids, sizes, body): documents in blocks, their texts compressed."""
    if not isinstance(docs.schema[id_col].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        raise TypeError("ids must be whole numbers")

    def run(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        pack = zstandard.ZstdCompressor(level=3).compress
        block = TaskContext.get().partitionId() << 32
        ids: list = []
        texts: list[bytes] = []
        held = 0

        def row():
            words = sum(len(t.split()) for t in texts)
            return pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([words]), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int32())), pa.array([pack(b"".join(texts))], pa.binary())],
                ["block", "n_words", "ids", "sizes", "body"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), common.utf8(batch.column(1))):
                if texts and held + len(text) > BLOCK_BYTES:
                    yield row()
                    block, ids, texts, held = block + 1, [], [], 0
                ids.append(doc_id)
                texts.append(text)
                held += len(text)
        if texts:
            yield row()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(common.releasing(run), "block long, n_words long, ids array<long>, sizes array<int>, body binary")


class Block:
    """The words, anchors and windows of one block."""

    def __init__(self, ids: list, sizes: list[int], body: bytes, least: int, gram: int):
        import zstandard

        data = zstandard.ZstdDecompressor().decompress(body, max_output_size=max(1, sum(sizes)))
        cuts = np.concatenate(([0], np.cumsum(sizes))).tolist()
        self.texts = [data[a:b] for a, b in zip(cuts, cuts[1:])]
        self.ids = ids
        self.least = least
        self.keys = np.array([_NO_ID if i is None else i for i in ids], np.int64)
        hashes: tuple[list, list] = ([], [])
        self.sizes = np.zeros(len(ids), np.int64)
        for lo, hi in common.slices(self.texts, _SLICE):
            raw, bounds = common.joined(self.texts[lo:hi])
            starts, ends = common.word_bounds(raw)
            self.sizes[lo:hi] = np.diff(np.searchsorted(starts, bounds))
            for family in (0, 1):
                hashes[family].append(common.word_hashes(raw, starts, ends, family))
        words, self.others = (np.concatenate(h) if h else np.zeros(0, np.uint64) for h in hashes)
        self.n = len(words)
        first = np.cumsum(self.sizes) - self.sizes
        # where windows start: at every word of a document that has least-1 words after it
        count = np.maximum(0, self.sizes - least + 1)
        self.doc = np.repeat(np.arange(len(ids)), count)
        self.start = np.repeat(first, count) + np.arange(len(self.doc)) - np.repeat(np.cumsum(count) - count, count)
        self.first = first
        self.words = words
        grams = common.window_hashes(words, gram)
        best = grams[self.start] if len(self.start) else np.zeros(0, np.uint64)
        for shift in range(1, least - gram + 1):
            best = np.minimum(best, grams[self.start + shift])
        self.anchor = best  # the hash of each window's anchor

    def seeds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct anchor hashes, is each in several documents here, the number of each window's)."""
        distinct, which = np.unique(self.anchor, return_inverse=True)
        low = np.full(len(distinct), len(self.ids))
        high = np.full(len(distinct), -1)
        np.minimum.at(low, which, self.doc)
        np.maximum.at(high, which, self.doc)
        return distinct, low != high, which

    def windows(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows under wanted seeds: (their places, both hashes of the distinct ones, smallest
        id of each, number of each window's)."""
        place = np.flatnonzero(wanted)
        start = self.start[place]
        one, two = (common.window_hashes(words, self.least)[start] if len(place) else np.zeros(0, np.uint64) for words in (self.words, self.others))
        order, head = _sorted(one, two)
        which = np.empty(len(place), np.int64)
        which[order] = np.cumsum(head) - 1
        first = order[head]
        least = np.full(len(first), _NO_ID, np.int64)
        np.minimum.at(least, which, self.keys[self.doc[place]])
        return place, one[first], two[first], least, which

    def covered(self, hit: np.ndarray) -> np.ndarray:
        """Which words a hit window covers; hit: places of windows."""
        depth = np.zeros(self.n + 1, np.int64)
        np.add.at(depth, self.start[hit], 1)
        np.add.at(depth, self.start[hit] + self.least, -1)
        return np.cumsum(depth[:-1]) > 0


def _bucketed(distinct: np.ndarray, bits: int) -> np.ndarray:
    """Bounds of the buckets in sorted hashes."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
    return np.concatenate(([0], np.searchsorted(distinct, edges), [len(distinct)]))


def _answers(rows: list[dict] | None, n: int, bounds: np.ndarray) -> np.ndarray:
    """The bits of all buckets, put together."""
    out = np.zeros(n, bool)
    for r in rows or ():
        a, b = bounds[r["bucket"]], bounds[r["bucket"] + 1]
        out[a:b] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=b - a).astype(bool)
    return out


def _by_block(answers: DataFrame) -> DataFrame:
    return answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 13, gram: int = 5) -> DataFrame:
    """(id, n_words, n_removed, kept, spans): per row the words left, joined by one space, and
    the removed ranges of words (maximal, half-open)."""
    blocks = common.materialise(packed(docs, id_col, text_col), "substrings-blocks", "none")
    total = blocks.agg(F.sum("n_words")).first()[0] or 0
    # a document of n words has at most n windows, and about 2 n / (windows to an anchor) distinct anchors
    buckets = lambda n: max(5, int(np.ceil(np.log2(max(1, n / BUCKET_HASHES)))))
    seed_bits, window_bits = buckets(2 * total / (least - gram + 2)), buckets(total)

    def opened(batch):
        for ids, sizes, body in zip(batch.column("ids").to_pylist(), batch.column("sizes").to_pylist(), batch.column("body").to_pylist()):
            yield Block(ids, sizes, body, least, gram)

    def rows(block, arrays: list[np.ndarray], bounds: np.ndarray):
        import pyarrow as pa

        full = [i for i in range(len(bounds) - 1) if bounds[i] < bounds[i + 1]]
        parts = [pa.array([x[bounds[i] : bounds[i + 1]].tobytes() for i in full], pa.binary()) for x in arrays]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([block] * len(full), pa.int64()), *parts], ["bucket", "block", "hashes", "others", "ids"][: 2 + len(parts)])

    def ask_seeds(batches):
        for batch in batches:
            for block, own in zip(batch.column("block").to_pylist(), opened(batch)):
                distinct, _, _ = own.seeds()
                yield rows(block, [distinct], _bucketed(distinct, seed_bits))

    def tell_seeds(table):
        order, sizes, head = _merged(table)
        several = np.concatenate((head[1:] - head[:-1], [len(order) - head[-1]])) > 1
        bit = np.empty(len(order), bool)
        bit[order] = np.repeat(several, np.diff(np.append(head, len(order))))
        return _told(table, bit, sizes)

    asked = blocks.select("block", "ids", "sizes", "body").mapInArrow(common.releasing(ask_seeds), "bucket long, block long, hashes binary")
    seeds = _by_block(asked.groupBy("bucket").applyInArrow(tell_seeds, "block long, bucket long, bits binary"))
    flags = common.materialise(seeds, "substrings-seeds")

    def wanted(own, answers):
        distinct, local, which = own.seeds()
        seed = local | _answers(answers, len(distinct), _bucketed(distinct, seed_bits))
        return seed[which] if len(which) else np.zeros(0, bool)

    def ask_windows(batches):
        for batch in batches:
            for block, answers, own in zip(batch.column("block").to_pylist(), batch.column("answers").to_pylist(), opened(batch)):
                _, one, two, least_id, _ = own.windows(wanted(own, answers))
                yield rows(block, [one, two, least_id], _bucketed(one, window_bits))

    def tell_windows(table):
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist()])
        order, sizes, head = _merged(table)
        least_id = np.minimum.reduceat(ids[order], head)
        bit = np.empty(len(order), bool)
        bit[order] = np.repeat(least_id, np.diff(np.append(head, len(order)))) < ids[order]
        return _told(table, bit, sizes)

    seeded = blocks.select("block", "ids", "sizes", "body").join(flags, "block", "left")
    windows = seeded.mapInArrow(common.releasing(ask_windows), "bucket long, block long, hashes binary, others binary, ids binary")
    told = _by_block(windows.groupBy("bucket").applyInArrow(tell_windows, "block long, bucket long, bits binary")).withColumnRenamed("answers", "told")
    both = common.materialise(flags.join(told, "block", "left"), "substrings-windows")

    def finish(batches):
        import pyarrow as pa

        kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for answers, more, own in zip(batch.column("answers").to_pylist(), batch.column("told").to_pylist(), opened(batch)):
                place, one, _, least_id, which = own.windows(wanted(own, answers))
                smaller = _answers(more, len(one), _bucketed(one, window_bits))
                hit = place[smaller[which] | (least_id[which] < own.keys[own.doc[place]])] if len(place) else place
                gone = own.covered(hit)
                counts = np.add.reduceat(np.append(gone, False).astype(np.int64), own.first) if own.n else np.zeros(len(own.ids), np.int64)
                counts[own.sizes == 0] = 0
                kept, spans = [], []
                for i, text in enumerate(own.texts):
                    words = text.split()
                    if not counts[i]:
                        kept.append(b" ".join(words).decode())
                        spans.append([])
                        continue
                    own_gone = gone[own.first[i] : own.first[i] + own.sizes[i]]
                    kept.append(b" ".join([w for w, g in zip(words, own_gone.tolist()) if not g]).decode())
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], own_gone, [0])).astype(np.int8))).tolist()
                    spans.append([{"start": a, "end": b} for a, b in zip(edge[0::2], edge[1::2])])
                yield pa.RecordBatch.from_arrays([pa.array(own.ids, pa.int64()), pa.array(own.sizes), pa.array(counts), pa.array(kept, pa.string()), pa.array(spans, kinds)], ["id", "n_words", "n_removed", "kept", "spans"])

    out = blocks.select("block", "ids", "sizes", "body").join(both, "block", "left")
    return out.mapInArrow(common.releasing(finish), "id long, n_words long, n_removed long, kept string, spans array<struct<start:long,end:long>>")


def _sorted(one: np.ndarray, two: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts the hashes, which of them in that order are the first of their kind)."""
    order = np.argsort(one, kind="stable") if two is None else np.lexsort((two, one))
    new = np.ones(len(order), bool)
    new[1:] = one[order[1:]] != one[order[:-1]]
    if two is not None:
        new[1:] |= two[order[1:]] != two[order[:-1]]
    return order, new


def _merged(table) -> tuple[np.ndarray, list[int], np.ndarray]:
    """(order that sorts all hashes of a bucket, number from each block, first place of each kind)."""
    parts = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    others = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("others").to_pylist()]) if "others" in table.column_names else None
    order, new = _sorted(np.concatenate(parts), others)
    return order, [len(p) for p in parts], np.flatnonzero(new)


def _told(table, bit: np.ndarray, sizes: list[int]):
    import pyarrow as pa

    cuts = np.concatenate(([0], np.cumsum(sizes))).tolist()
    packed_ = [np.packbits(bit[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])]
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "bits": pa.array(packed_, pa.binary())})
