"""Near-duplicates by five-word shingles: SimHash anchors, min-hash bands, and prefixes for the rest.

Sets of word shingles are near-duplicates from a Jaccard similarity of `least` on. The groups
are those that all pairs of at least that similarity link; every link is tested on whole texts.
They are found in two steps. The first is cheap and links most:

* fingerprints of the shingles that the anchor points link (`simhash.links`, two bits), and
* bands: `BANDS` groups of `ROWS` minima of the shingles under fixed permutations. Sets with a
  similarity of 0.8 share a band with probability 0.99, of 0.85 with 0.999.

Whoever shares a component of fingerprints or a band is a bucket. Each bucket has three centres:
the member that has most companions in all its buckets (a text that was copied often has more
than its copies have), and those with the smallest and the largest hash. Every member is tested
against the centres on the whole texts, so a bucket of n members costs 3 n tests, however large
it is, and no list of pairs is made. What the tests link is put together in components. More
bands (`count`) and further centres (`rounds`) let this step link more.

The second step finds every link between components that the first has left apart, by prefix
filtering: with the shingles of all sets in one order, two sets as similar as that share one of
the first n - ceil(least * n) + 1 of the n shingles of either. All members of a shingle's group
that are in different components, and whose sizes and places allow the similarity, are tested.
Any order is exact. The one used puts shingles last that are frequent among every `EVERY`th set,
so that a passage of many texts makes no large groups; what is counted has no say in the result.
Not alike texts that consist of the same frequent shingles for the most part still meet in pairs.

Hot buckets are never gathered: members meet their bucket's centre over salted keys, and a
centre's text is repeated for every `PER_COPY` members. Groups of a shingle are dealt likewise.

Nulls, empties, ties: null and wordless texts are equal to each other. Fewer words than a
shingle: the whole sequence is the one shingle. Words are lower-cased, shingles of a text
count once; they, texts and sets are told by 64-bit hashes. Rows with null or repeated ids take
part; of equal rows one stays. An empty table gives an empty one. Columns may have any names.
"""

from __future__ import annotations

from functools import cache
from math import ceil

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import common, simhash

BANDS, ROWS = 12, 5
SALTS, PER_COPY = 16, 512
#: Frequent shingles: among every `EVERY`th set, from `OFTEN` sets on, the `ORDERED` most frequent at most.
EVERY, OFTEN, ORDERED = 16, 3, 500_000
_SLACK = 1e-9
_SLICE = 1 << 19
_KEPT_BYTES = 32 << 20


@cache
def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and summands; those of fewer bands are the first of more."""
    return common.mixed(count * ROWS, 21) | np.uint64(1), common.mixed(count * ROWS, 22)


def shingles(text: bytes, k: int) -> np.ndarray:
    """The sorted set of hashes of the k-word shingles of a text."""
    raw = np.frombuffer(text, np.uint8)
    words = common.word_hashes(raw, *common.word_bounds(raw))
    return np.unique(common.window_hashes(words, min(k, len(words)))) if len(words) else words


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    if not len(a) or not len(b):
        return len(a) == len(b)
    if min(len(a), len(b)) < least * max(len(a), len(b)) - _SLACK:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - _SLACK


def bands(sets: list[np.ndarray], count: int = BANDS) -> np.ndarray:
    """The bands of each set, one row a set; those of an empty set are all zero."""
    odd, add = _permutations(count)
    out = np.zeros((len(sets), count), np.uint64)
    full = [i for i, x in enumerate(sets) if len(x)]
    if full:
        every = np.concatenate([sets[i] for i in full])
        first = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
        with np.errstate(over="ignore"):
            for band in range(count):
                key = np.full(len(full), band, np.uint64)
                for row in range(band * ROWS, band * ROWS + ROWS):
                    key = common.mix64(key * odd[0] + np.minimum.reduceat(every * odd[row] + add[row], first))
                out[full, band] = key
    return out


def fingerprint(own: np.ndarray) -> int:
    """64-bit SimHash of a set of hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(own), 1 << 15):
        ones += np.unpackbits(own[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(own), bitorder="little").view("<i8")[0])


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.array([xxh3_64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)


def _lists(sets: list[np.ndarray]):
    """An Arrow column of lists of hashes."""
    import pyarrow as pa

    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(flat.view(np.int64)))


def _sets(texts: DataFrame, k: int, count: int) -> DataFrame:
    """(tie, s, n, fp, bands, counted): digest, size, fingerprint and bands of the set of each text;
    the hashes of every `EVERY`th set, whose frequencies give the order of prefixes."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            every = common.utf8(batch.column(1))
            for lo, hi in common.slices(every, _SLICE):
                own = [shingles(t, k) for t in every[lo:hi]]
                digest = _digests(own)
                counted = [x if s % EVERY == 0 else x[:0] for x, s in zip(own, digest.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(digest), pa.array([len(x) for x in own], pa.int64()), pa.array([fingerprint(x) for x in own], pa.int64()), _lists(list(bands(own, count))), _lists(counted)], ["tie", "s", "n", "fp", "bands", "counted"])

    return texts.select("tie", F.lower("text")).mapInArrow(common.releasing(run), "tie long, s long, n long, fp long, bands array<long>, counted array<long>")


def _salted(members: DataFrame, of_key: DataFrame) -> DataFrame:
    """Members (key, s) with the columns of their key; those of one key are dealt over `SALTS`."""
    dealt = of_key.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return members.withColumn("salt", F.pmod(F.xxhash64("s"), F.lit(SALTS)).cast("int")).join(dealt, ["key", "salt"]).drop("salt")


def buckets(sets: DataFrame) -> DataFrame:
    """(key, s, n, m): the members of each bucket of two and more, m of them. `sets` has one row of
    each set."""
    fps = common.materialise(sets.select("fp").distinct(), "nearcopies-fp")
    roots = simhash.connected(simhash.links(fps, 2), "nearcopies-fp").select(F.col("node").alias("fp"), "root")
    anchored = sets.select("s", "n", "fp").join(roots, "fp", "left").select(F.xxhash64(F.lit("fp"), F.coalesce("root", "fp")).alias("key"), "s", "n")
    members = sets.select(F.explode("bands").alias("key"), "s", "n").unionByName(anchored)
    several = members.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    return common.materialise(_salted(members, several), "nearcopies-members")


def centres_of(members: DataFrame) -> DataFrame:
    """(key, centres): three members of each bucket, or fewer."""
    degree = members.groupBy("s").agg(F.sum("m").alias("degree"))
    own = F.struct("s", "n")
    centres = members.join(degree, "s").groupBy("key").agg(F.max(F.struct("degree", own.alias("own"))).alias("best"), F.min(own).alias("low"), F.max(own).alias("high"))
    return centres.select("key", F.array_distinct(F.array("best.own", "low", "high")).alias("centres"))


def candidates(members: DataFrame, centres: DataFrame, least: float) -> DataFrame:
    """(a, b, copies): members b to test against the centre a of a bucket, and over how many
    copies of the centre its members are dealt."""
    pairs = _salted(members, centres).withColumn("centre", F.explode("centres")).select("key", "s", "n", "m", F.col("centre.s").alias("a"), F.col("centre.n").alias("of"))
    fit = (F.col("a") != F.col("s")) & (F.least("n", "of") >= least * F.greatest("n", "of") - _SLACK)
    return pairs.filter(fit).groupBy("a", F.col("s").alias("b")).agg(F.ceil(F.max("m") / PER_COPY).alias("copies"))


def _tested(pairs: DataFrame, texts: DataFrame, k: int, least: float) -> DataFrame:
    """Those of the pairs (a, b, copies) whose sets are similar. `texts`: s, text."""
    pairs = common.materialise(pairs.withColumn("copy", F.pmod(F.xxhash64("b"), F.col("copies"))), "nearcopies-pairs")
    centres = pairs.groupBy("a").agg(F.max("copies").alias("copies"))
    lower = texts.select("s", F.lower("text").alias("text"))
    own = centres.join(lower.select(F.col("s").alias("a"), F.col("text").alias("ta")), "a").select("a", "ta", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    both = pairs.select("a", "b", "copy").join(lower.select(F.col("s").alias("b"), F.col("text").alias("tb")), "b").join(own, ["a", "copy"])

    def run(batches):
        import pyarrow as pa

        kept, size = {}, 0
        for batch in batches:
            a = batch.column(0).to_numpy()
            hit = np.zeros(len(a), bool)
            ta, tb = batch.column(2), common.utf8(batch.column(3))
            for i, x in enumerate(a.tolist()):
                if x not in kept:
                    if size > _KEPT_BYTES:
                        kept, size = {}, 0
                    kept[x] = shingles(common.utf8(ta.slice(i, 1))[0], k)
                    size += kept[x].nbytes + 100
                hit[i] = similar(kept[x], shingles(tb[i], k), least)
            yield pa.RecordBatch.from_arrays([pa.array(a[hit]), pa.array(batch.column(1).to_numpy()[hit])], ["a", "b"])

    return both.select("a", "b", "ta", "tb").mapInArrow(common.releasing(run), "a long, b long")


def _more_links(members: DataFrame, centres: DataFrame, links: DataFrame, least: float, rounds: int | None, test) -> DataFrame:
    """Links found by further centres. A bucket whose members are of one component is settled. In any
    other a member that was no centre yet becomes one, and those of other components are tested
    against it. After enough rounds every pair of a bucket is linked, tested, or known to be of one
    component; `rounds` is the most, none for as many as it takes."""
    tried = centres.select("key", F.explode("centres").alias("c")).select("key", F.col("c.s").alias("s"))
    n = 0
    while rounds is None or n < rounds:
        n += 1
        roots = simhash.connected(links, "nearcopies-links")
        rooted = members.join(roots, F.col("s") == F.col("node"), "left").select("key", "s", "n", "m", F.coalesce("root", "s").alias("root"))
        open_ = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
        rest = common.materialise(_salted(rooted, open_), "nearcopies-rest")
        fresh = rest.join(tried, ["key", "s"], "left_anti")
        chosen = fresh.groupBy("key").agg(F.max(F.struct(F.xxhash64("s", F.lit(n)).alias("h"), "s", "n", "root")).alias("c"))
        chosen = common.materialise(chosen.select("key", F.col("c.s").alias("a"), F.col("c.n").alias("of"), F.col("c.root").alias("of_root")), "nearcopies-chosen")
        pairs = _salted(rest, chosen).filter((F.col("root") != F.col("of_root")) & (F.least("n", "of") >= least * F.greatest("n", "of") - _SLACK))
        pairs = common.materialise(pairs.groupBy("a", F.col("s").alias("b")).agg(F.ceil(F.max("m") / PER_COPY).alias("copies")), "nearcopies-candidates")
        if chosen.isEmpty():
            return links
        tried = common.materialise(tried.unionByName(chosen.select("key", F.col("a").alias("s"))), "nearcopies-tried")
        links = common.materialise(links.unionByName(test(pairs)), "nearcopies-linked")
    return links


def _frequent(by_text: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of frequent shingles, ascending, and in how many of the counted sets they are."""
    counted = by_text.filter(F.size("counted") > 0).groupBy("s").agg(F.first("counted").alias("counted"))
    often = counted.select(F.explode("counted").alias("h")).groupBy("h").count().filter(F.col("count") >= OFTEN)
    often = common.materialise(often, "nearcopies-often")
    least, total = OFTEN, 0
    for row in often.groupBy("count").agg(F.count("*").alias("of")).orderBy(F.col("count").desc()).collect():
        total += row["of"]
        if total > ORDERED:
            least = row["count"] + 1
            break
    found = often.filter(F.col("count") >= least).toArrow()
    known, times = found.column("h").to_numpy().view(np.uint64), found.column("count").to_numpy()
    order = np.argsort(known)
    return known[order], times[order].astype(np.int32)


def prefix(own: np.ndarray, known: np.ndarray, times: np.ndarray, least: float) -> np.ndarray:
    """Those shingles of a set of which every set as similar has one among its own: the first by
    frequency, then by hash."""
    size = min(len(own), len(own) - ceil(least * len(own) - _SLACK) + 1)
    place = np.searchsorted(known, own)
    place[place == len(known)] = 0
    seen = np.flatnonzero(known[place] == own) if len(known) else place[:0]
    often = np.zeros(len(own), np.int32)
    often[seen] = times[place[seen]]
    # few sets have no frequent shingle; `own` is ascending, so a stable sort keeps the hashes' order
    return own[np.argsort(often, kind="stable")[:size]] if len(seen) else own[:size]


def _prefixes(rows: DataFrame, k: int, least: float, order) -> DataFrame:
    """(key, s, n, at): each shingle of a set's prefix, the set, its size and the shingle's place.
    Equal sets of a batch are given once."""

    def run(batches):
        import pyarrow as pa

        known, times = order.value
        for batch in batches:
            every = common.utf8(batch.column(0))
            for lo, hi in common.slices(every, _SLICE):
                own = [shingles(t, k) for t in every[lo:hi]]
                digest, first = np.unique(_digests(own), return_index=True)
                own = [own[i] for i in first]
                keys = [prefix(x, known, times, least) for x in own]
                size = np.array([len(x) for x in keys])
                at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                n = np.repeat([len(x) for x in own], size)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(digest, size)), pa.array(n, pa.int32()), pa.array(at, pa.int32())], ["key", "s", "n", "at"])

    return rows.select(F.lower("text")).mapInArrow(common.releasing(run), "key long, s long, n int, at int")


def _left_apart(rows: DataFrame, by_text: DataFrame, links: DataFrame, k: int, least: float) -> DataFrame:
    """(a, b, copies): every pair of sets that may be similar and that `links` leave in different
    components, to be tested."""
    order = rows.sparkSession.sparkContext.broadcast(_frequent(by_text))
    of_key = Window.partitionBy("key")
    shared = _prefixes(rows, k, least, order).withColumns({"low": F.min("s").over(of_key), "high": F.max("s").over(of_key)})
    members = shared.filter("low <> high").dropDuplicates(["key", "s"]).select("key", "s", "n", "at")
    roots = simhash.connected(links, "nearcopies-links")
    rooted = members.join(roots, F.col("s") == F.col("node"), "left").select("key", "s", "n", "at", F.coalesce("root", "s").alias("root"))
    rooted = common.materialise(rooted, "nearcopies-prefixes")
    apart = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("m")).filter("low <> high")
    apart = common.materialise(rooted.join(apart.select("key", "m"), "key").withColumn("parts", F.ceil(F.col("m") / PER_COPY)), "nearcopies-apart")
    own = apart.select("key", *[F.col(c).alias(f"{c}_a") for c in ("s", "n", "at", "root")], F.pmod(F.xxhash64("s"), "parts").alias("part"))
    other = apart.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rest = F.least(F.col("n_a") - F.col("at_a"), F.col("n") - F.col("at"))  # what follows in either set, the shingle itself included
    fit = (F.col("root_a") != F.col("root")) & (F.least("n_a", "n") >= least * F.greatest("n_a", "n") - _SLACK)
    fit = fit & (F.col("s_a") < F.col("s")) & (rest * (1 + least) >= least * (F.col("n_a") + F.col("n")) - 1e-6)
    pairs = own.join(other, ["key", "part"]).filter(fit)
    return pairs.groupBy(F.col("s_a").alias("a"), F.col("s").alias("b")).agg(F.ceil(F.max("m") / PER_COPY).alias("copies"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, count: int = BANDS, rounds: int | None = 0) -> DataFrame:
    """The rows of `docs`, all columns as they are, one of each group of near-duplicates: that
    with the smallest id (nulls first; of equal ids, the smallest hash of the text).

    The groups are those of all pairs, whatever `count` and `rounds` are: more bands and further
    rounds of centres (none: as many as it takes) only leave less to the prefixes."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    by_text = common.materialise(_sets(rows.select("tie", "text"), shingle, count), "nearcopies-sets")
    sets = by_text.groupBy("s").agg(F.min("tie").alias("tie"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    sets = common.materialise(sets, "nearcopies-distinct")

    def test(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("s")).union(pairs.select("b")).distinct().join(sets.select("s", "tie"), "s")
        texts = rows.select("tie", "text").join(wanted, "tie").dropDuplicates(["s"]).select("s", "text")
        return _tested(pairs, common.materialise(texts, "nearcopies-texts"), shingle, least)

    members = buckets(sets)
    centres = centres_of(members)
    links = common.materialise(test(common.materialise(candidates(members, centres, least), "nearcopies-candidates")), "nearcopies-linked")
    if rounds != 0:
        links = _more_links(members, centres, links, least, rounds, test)
    rest = common.materialise(_left_apart(rows, by_text, links, shingle, least), "nearcopies-candidates")
    links = links.unionByName(test(rest))
    roots = simhash.connected(links, "nearcopies-links")
    rooted = by_text.select("tie", "s").distinct().join(roots, F.col("s") == F.col("node"), "left").select("tie", F.coalesce("root", "s").alias("root"))
    return one_of_each(docs, rows.select("id", "tie"), rooted, F.col(f"`{id_col}`"), F.xxhash64(text_col))


def one_of_each(docs: DataFrame, rows: DataFrame, rooted: DataFrame, doc_id: Column, tie: Column) -> DataFrame:
    """One row of `docs` for each root, all columns as they are, whatever their names: that with the
    smallest (id, tie). `rows`: id and tie of each row; `rooted`: the root of each tie.

    What goes is told by its keys, so that rows are exchanged only where keys are too many to be
    broadcast; only rows of keys that several rows have are numbered."""
    keys = common.materialise(rows.groupBy("id", "tie").agg(F.count("*").alias("n")), "kept-keys")
    best = keys.select("tie", F.struct("id", "tie").alias("key")).join(rooted, "tie").groupBy("root").agg(F.min("key").alias("key"))
    best = common.materialise(best.select(F.col("key.id").alias("best_id"), F.col("key.tie").alias("best_tie")), "kept-best")
    chosen = F.col("id").eqNullSafe(F.col("best_id")) & F.col("tie").eqNullSafe(F.col("best_tie"))
    gone = keys.join(best, chosen, "left_anti").select("id", "tie")
    several = keys.filter("n > 1").join(best, chosen, "left_semi").select("id", "tie")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), doc_id.alias("id"), tie.alias("tie"))

    def of(part: DataFrame, how: str) -> DataFrame:
        other = part.select(F.col("id").alias("other_id"), F.col("tie").alias("other_tie"))
        return own.join(other, F.col("id").eqNullSafe(F.col("other_id")) & F.col("tie").eqNullSafe(F.col("other_tie")), how)

    single = of(gone.unionByName(several), "left_anti").select("row")
    nth = F.row_number().over(Window.partitionBy("id", "tie").orderBy("tie"))
    repeated = of(several, "left_semi").withColumn("nth", nth).filter("nth = 1").select("row")
    return single.unionByName(repeated).select("row.*")
