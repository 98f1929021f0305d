"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code: bits 0-22 and bits 23-45 of a fingerprint
are each read in the binary Golay code, which is perfect with covering radius 3, so
that every fingerprint has one home anchor at distance 3 or less in each half. Two
fingerprints that differ in at most `threshold` bits then meet at the home anchor of
either: the other lies within the radius plus the threshold of it. So each fingerprint
is replicated to every anchor whose excess over the radius, summed over both halves,
is at most the threshold (about 61 anchors for threshold 2), and is compared only with
the fingerprints that have the same anchor. Equal fingerprints are merged before.

Within an anchor's group no list of all pairs is made: a group of more than `_SMALL`
fingerprints is linked through single-bit variants (two words at distance 2 or less
share one), in linear time, and every task returns a spanning forest only. An anchor that
is home to more than `hot` fingerprints is split: each of its replicas goes to three keys,
one for each six of the 18 bits that are not anchored, as two fingerprints that differ in
two bits agree in one of the three. Hot anchors are at most `fingerprints / hot`.

Nulls, empties, ties: a null or wordless text has fingerprint zero, which links like
any other. Fewer words than a shingle: the whole sequence is the one shingle. Rows with
a null id take part and may get a null component if no other row is in it. Repeated rows
are returned as often as they occur. An empty table gives an empty result. Columns other
than the two named are ignored.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import common

#: Generator polynomial of the binary Golay code (fixed value): x^11+x^9+x^7+x^6+x^5+x+1.
GOLAY = 0b101011100011
BLOCK, RADIUS = 23, 3
_SMALL = 64
_CHUNK = 200_000
#: Fingerprints with one home anchor, and rows with one fingerprint, from which they are split.
HOT = 20_000
#: Variants that are sorted at a time in a large group.
_VARIANTS = 4_000_000


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash over the XXH64 (seed 42) of all word shingles, repeats counted."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    raw = np.frombuffer(line, np.uint8)
    gaps = np.flatnonzero(raw == 0x20)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(raw)]))
    k = min(shingle, len(words))
    n = len(words) - k + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        first, last = starts[at : min(n, at + (1 << 15))], ends[at + k - 1 : min(n, at + (1 << 15)) + k - 1]
        hashes = np.fromiter((xxh64_intdigest(line[a:b], 42) for a, b in zip(first.tolist(), last.tolist())), np.uint64, len(first))
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): one row per row of `df`; fp is the unsigned fingerprint's bits as a long."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in common.utf8(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(common.releasing(run), f"id {kind}, fp long")


@cache
def _cosets() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Error patterns of weight up to RADIUS+2 by syndrome, lightest first.

    Returns (syndrome table of the low 12 bits, of the high 11 bits, patterns in coset
    order with their excess over RADIUS packed above bit 32, first index of each coset).
    """

    def reduce(x: int) -> int:
        for shift in range(BLOCK - 1, 10, -1):
            if x >> shift & 1:
                x ^= GOLAY << (shift - 11)
        return x

    unit = [reduce(1 << i) for i in range(BLOCK)]
    low = np.zeros(1 << 12, np.int64)
    high = np.zeros(1 << 11, np.int64)
    for table, offset in ((low, 0), (high, 12)):
        for i in range(len(table).bit_length() - 1):
            table[1 << i : 2 << i] = table[: 1 << i] ^ unit[offset + i]
    rows = []
    for weight in range(RADIUS + 3):
        for places in combinations(range(BLOCK), weight):
            syndrome = pattern = 0
            for i in places:
                syndrome ^= unit[i]
                pattern |= 1 << i
            rows.append((syndrome, max(0, weight - RADIUS), pattern))
    table = np.array(rows, dtype=np.int64)
    table = table[np.lexsort((table[:, 2], table[:, 1], table[:, 0]))]
    first = np.searchsorted(table[:, 0], np.arange((1 << 11) + 1))
    return low, high, table[:, 2] | table[:, 1] << 32, first


def anchors(fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor, is it the home anchor) for every replica."""
    low, high, patterns, first = _cosets()
    mask = (1 << BLOCK) - 1
    halves = []
    for shift in (0, BLOCK):
        block = (fps >> np.uint64(shift)).astype(np.int64) & mask
        syndrome = low[block & 0xFFF] ^ high[block >> 12]
        count = first[syndrome + 1] - first[syndrome]
        who = np.repeat(np.arange(len(fps)), count)
        nth = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
        found = patterns[first[syndrome][who] + nth]
        near = (found >> 32) <= threshold
        halves.append((who[near], block[who[near]] ^ (found[near] & mask), found[near] >> 32))
    (wa, ca, ea), (wb, cb, eb) = halves
    nb = np.bincount(wb, minlength=len(fps))
    start = np.cumsum(nb) - nb
    times = nb[wa]
    left = np.repeat(np.arange(len(wa)), times)
    right = np.repeat(start[wa], times) + np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
    excess = ea[left] + eb[right]
    near = excess <= threshold
    left, right = left[near], right[near]
    return wa[left], ca[left] << BLOCK | cb[right], excess[near] == 0


def components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node of the component of each of n nodes, by hooking and pointer jumping."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        if not len(a):
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _links(anchor: np.ndarray, fps: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (index, index) among rows sorted by anchor, enough to join what belongs together."""
    edges = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1], [True])))
    sizes = np.diff(edges)
    some_home = np.add.reduceat(home.astype(np.int64), edges[:-1]) > 0
    left, right = [], []
    small = np.repeat((sizes > 1) & (sizes <= _SMALL) & some_home, sizes)
    rows = np.flatnonzero(small)
    end = np.repeat(edges[1:], sizes)
    step = 1
    while len(rows):
        rows = rows[rows + step < end[rows]]
        other = rows + step
        hit = (home[rows] | home[other]) & (_bits(fps[rows] ^ fps[other]) <= threshold)
        left.append(rows[hit])
        right.append(other[hit])
        step += 1
    for g in np.flatnonzero((sizes > _SMALL) & some_home):
        own = np.arange(edges[g], edges[g + 1])
        found = _large(fps[own], home[own], threshold)
        left.append(own[found[0]])
        right.append(own[found[1]])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _large(fps: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within one large group. For threshold 2: words at distance 2 or less share a
    single-bit variant, and those that share one are no further apart than that."""
    left, right = [], []
    if threshold == 2:
        flips = np.concatenate(([np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)))
        parts = np.uint64(-(-len(fps) * len(flips) // _VARIANTS))  # equal variants fall into one part
        for part in range(int(parts)):
            who, keys = [], []
            for flip in flips:
                own = fps ^ flip
                held = np.flatnonzero(common.mix64(own) % parts == part) if parts > 1 else np.arange(len(fps))
                who.append(held)
                keys.append(own[held])
            who, keys = np.concatenate(who), np.concatenate(keys)
            order = np.argsort(keys)
            same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
            left.append(who[order[same + 1]])
            right.append(who[order[same]])
        return np.concatenate(left), np.concatenate(right)
    for i in np.flatnonzero(home):
        hit = np.flatnonzero(_bits(fps ^ fps[i]) <= threshold)
        left.append(np.full(len(hit), i))
        right.append(hit)
    return np.concatenate(left), np.concatenate(right)


def _split(anchor: np.ndarray, fps: np.ndarray, home: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Replicas with those of hot anchors dealt over three keys each; such keys are negative."""
    if not len(hot):
        return anchor, fps, home
    place = np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)
    split = hot[place] == anchor
    parts = [(anchor[~split], fps[~split], home[~split])]
    for third in range(3):
        bits = (fps[split] >> np.uint64(2 * BLOCK + 6 * third)) & np.uint64(63)
        key = common.mix64(common.mix64(anchor[split].astype(np.uint64) * np.uint64(3) + np.uint64(third)) + bits)
        parts.append(((key | np.uint64(1 << 63)).view(np.int64), fps[split], home[split]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _hot_anchors(distinct: DataFrame, hot: int) -> np.ndarray:
    """Anchors that are home to more than `hot` fingerprints, ascending."""

    def homes(batches):
        import pyarrow as pa

        for batch in batches:
            _, anchor, _ = anchors(batch.column(0).to_numpy().view(np.uint64), 0)
            yield pa.RecordBatch.from_arrays([pa.array(anchor)], ["anchor"])

    many = distinct.select("fp").mapInArrow(common.releasing(homes), "anchor long").groupBy("anchor").count().filter(F.col("count") > hot)
    return np.sort(many.select("anchor").toArrow().column(0).to_numpy())


def links(distinct: DataFrame, threshold: int = 2, hot: int = HOT) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that give the same components
    as all pairs of at most `threshold` differing bits."""
    if not 0 <= threshold <= 2:
        raise ValueError("threshold must be 0, 1 or 2: the anchors' patterns reach radius + 2")
    spark = distinct.sparkSession
    heavy = spark.sparkContext.broadcast(_hot_anchors(distinct, hot))

    def spread(batches):
        import pyarrow as pa

        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fps), 4096):
                part = fps[at : at + 4096]
                who, anchor, home = anchors(part, threshold)
                anchor, own, home = _split(anchor, part[who], home, heavy.value)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(own.view(np.int64)), pa.array(home)], ["anchor", "fp", "home"])

    def forest(anchor, fps, home):
        import pyarrow as pa

        left, right = _links(anchor, fps, home, threshold)
        if not len(left):
            return None
        nodes, index = np.unique(np.concatenate((fps[left], fps[right])).view(np.int64), return_inverse=True)
        root = components(index[: len(left)], index[len(left) :], len(nodes))
        own = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], ["a", "b"])

    def compare(batches):
        kept: list[tuple] = []
        size, enough = 0, _CHUNK
        for batch in batches:
            cols = (batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False))
            kept.append(cols)
            size += len(cols[0])
            if size < enough:
                continue
            anchor, fps, home = (np.concatenate(c) for c in zip(*kept))
            cut = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on in the next batch
            if cut:
                if (out := forest(anchor[:cut], fps[:cut], home[:cut])) is not None:
                    yield out
            kept, size = [(anchor[cut:], fps[cut:], home[cut:])], len(anchor) - cut
            enough = max(_CHUNK, 2 * size)  # a group that spans batches is put together a few times only
        if size:
            if (out := forest(*(np.concatenate(c) for c in zip(*kept)))) is not None:
                yield out

    spreaded = distinct.select("fp").mapInArrow(common.releasing(spread), "anchor long, fp long, home boolean")
    return spreaded.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(common.releasing(compare), "a long, b long").distinct()


def connected(edges: DataFrame, name: str = "simhash") -> DataFrame:
    """(node, root): the smallest node of each linked node's component, by alternating
    large-star and small-star steps until no link changes. Every step is written to the
    shared folder. Roots themselves are not returned."""

    def least(e: DataFrame) -> DataFrame:
        """Least neighbour, itself included, per node: a partial aggregate, so hubs do not gather."""
        return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("m"))

    edges = common.materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b"), name)
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(least(both), F.col("a") == F.col("node")).filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = common.materialise(large, name)
        small = large.join(least(large), F.col("a") == F.col("node"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        edges = common.materialise(small, name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: int = 2, hot: int = HOT) -> DataFrame:
    """(id, fp, component): the fingerprint of each row and the smallest id that it is linked to,
    directly or through others. Fingerprints that more than `hot` rows have (at most rows / hot) are
    broadcast to their rows, which stay where they are."""
    own = common.materialise(fingerprints(df, id_col, text_col, shingle), "simhash-fp")
    distinct = common.materialise(own.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    roots = connected(links(distinct, threshold, hot))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    by_fp = common.materialise(rooted.join(smallest, "root").select("fp", "n", F.struct("component").alias("of")), "simhash-component")
    often = F.broadcast(by_fp.filter(F.col("n") > hot).select("fp", F.col("of").alias("told")))
    marked = own.join(often, "fp", "left")
    there = marked.filter("told is not null").select("id", "fp", F.col("told.component").alias("component"))
    rest = marked.filter("told is null").join(by_fp.filter(F.col("n") <= hot), "fp").select("id", "fp", F.col("of.component").alias("component"))
    return there.unionByName(rest)
