"""Near-duplicates of the pipeline: five-word similarity 0.8 and more."""

import random

import corpus_pipeline
import numpy as np

from factloom.llm import nearcopies


def shingles(text, k=5):
    words = (text or "").lower().split()
    k = min(k, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def texts(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = [None, "", " \n", "one two", "One  TWO", "one two three"]
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.randint(5, 150))]
        out.append(" ".join(base))
        for _ in range(r.randint(0, 5)):
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = r.choice(words)
            out.append("  ".join(copy).upper() if r.random() < 0.3 else " ".join(copy))
    base = [r.choice(words) for _ in range(120)]  # a large group of copies, each with its own edits
    for _ in range(90):
        copy = list(base)
        for _ in range(r.randint(1, 3)):
            copy[r.randrange(len(copy))] = r.choice(words)
        out.append(" ".join(copy))
    return out


def kept_by_brute_force(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted({find(i) for i in range(len(texts))})


def test_groups_are_those_of_all_pairs(spark):
    for seed in (1, 2):
        rows = texts(seed)
        docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
        got = nearcopies.deduplicated(docs)
        assert got.schema == docs.schema
        got, want = {r.doc_id for r in got.collect()}, set(kept_by_brute_force(rows))
        assert want <= got and len(got - want) <= 0.1 * (len(rows) - len(want))  # nothing else goes, and nine copies in ten do, even of a text that is not there itself
    assert nearcopies.deduplicated(docs.limit(0)).collect() == []


def test_many_bands_and_rounds_find_every_group(spark):
    """Also groups of copies whose original is not there, of which no member is near to all others."""
    r, rows = random.Random(9), [None, "", "one two three"]
    for g in range(2):
        chain = [f"{g}c{i}" for i in range(120)]
        for _ in range(6):  # each is near to the one before, and not to those further away
            rows.append(" ".join(chain))
            chain = list(chain)
            chain[r.randrange(20, 100)] = f"{g}n{r.random()}"
            chain[r.randrange(20, 100)] = f"{g}n{r.random()}"
    r.shuffle(rows)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    got = {x.doc_id for x in nearcopies.deduplicated(docs, count=60, rounds=None).collect()}
    assert got == set(kept_by_brute_force(rows))


def test_pairs_that_share_no_bucket_are_found(spark):
    """Neither a band nor a fingerprint brings these pairs together. Beside them, texts that are not
    alike but share a long passage."""
    rows, i = [], 0
    while len(rows) < 6:
        i += 1
        base = [f"{i}x{j}" for j in range(104)]
        pair = [" ".join(base), " ".join(base[:30] + ["other"] + base[31:60] + ["word"] + base[61:])]
        a, b = (nearcopies.shingles(t.encode(), 5) for t in pair)
        found = nearcopies.bands([a, b])
        if not (found[0] == found[1]).any() and ((nearcopies.fingerprint(a) ^ nearcopies.fingerprint(b)) & (1 << 64) - 1).bit_count() > 2:
            rows += pair
    passage = " ".join(f"p{j}" for j in range(40))
    rows += [" ".join(f"{g}o{j}" for j in range(30)) + " " + passage for g in range(100)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    got = {x.doc_id for x in nearcopies.deduplicated(docs).collect()}
    assert got == set(kept_by_brute_force(rows)) == set(range(len(rows))) - {1, 3, 5}


def test_sets_that_are_similar_share_a_shingle_of_their_prefixes():
    sets = [nearcopies.shingles(t.lower().encode(), 5) for seed in (1, 2) for t in texts(seed) if t and t.split()]
    every, count = np.unique(np.concatenate(sets), return_counts=True)
    for known in (count > 1, count > 3, count > len(sets)):
        keys = [nearcopies.prefix(s, every[known], count[known].astype(np.int32), 0.8) for s in sets]
        for i in range(len(sets)):
            assert all(len(np.intersect1d(keys[i], keys[j])) for j in range(i) if nearcopies.similar(sets[i], sets[j], 0.8))


def test_bands_of_more_begin_with_those_of_fewer():
    sets = [nearcopies.shingles(t.encode(), 5) for t in texts(5) if t]
    assert (nearcopies.bands(sets, 30)[:, : nearcopies.BANDS] == nearcopies.bands(sets)).all()


def test_clashing_columns_and_repeated_rows(spark):
    names = ["doc_id", "text", "_row", "row", "tie", "id", "root", "nth", "key", "a.b", "s", "n"]
    rows = [(1, "x y"), (1, "x y"), (None, None), (None, None), (2, None), (3, "z"), (None, "Z")]
    docs = spark.createDataFrame([(i, t, *range(10)) for i, t in rows], "doc_id long, text string, " + ", ".join(f"`{c}` long" for c in names[2:]))
    got = nearcopies.deduplicated(docs)
    assert got.schema == docs.schema
    assert sorted(map(str, got.select("doc_id", "text").collect())) == sorted(["Row(doc_id=1, text='x y')", "Row(doc_id=None, text=None)", "Row(doc_id=None, text='Z')"])
    assert all(tuple(r)[2:] == tuple(range(10)) for r in got.collect())


def test_near_copies_between_0_8_and_0_9_leave_the_corpus(spark):
    rows = []
    for i in range(20):
        base = [f"{i}x{j}" for j in range(104)]
        rows += [base, base[:30] + ["other"] + base[31:60] + ["word"] + base[61:]]
    assert all(0.8 <= jaccard(shingles(" ".join(a)), shingles(" ".join(b))) < 0.85 for a, b in zip(rows[::2], rows[1::2]))
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 0) for i, w in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == list(range(0, 40, 2))
