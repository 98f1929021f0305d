"""Repetition rules from suffix arrays.

The texts of a slice of rows are read as one sequence of words, a word's symbol being its
document and its hash, so that no suffix of one document equals a prefix of another's. The
suffix array is built by prefix doubling (only groups that are still equal are sorted again)
and the ranks of every round give the longest common prefixes of neighbours. A suffix's
innermost LCP interval has the value max(lcp before it, lcp after it): the longest substring
from there that occurs again, extended to the right as far as it goes. The union of these
spans, of at least `least` words, is what repeats cover.

A document passes if repeats cover at most `most_covered` of its words' code points and the
longest repeat has at most `longest` words.

Nulls, empties: a null text is an empty one, with all counts 0. Ids may be null or repeated;
each row is judged alone, so ties and repeated rows change nothing. An empty table gives no
row. Memory follows the longest text: about 150 bytes a word of it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import common

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_SLICE = 1 << 19
#: Words of the longest repeat that passes.
LONGEST = 100
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_chars", "longest_repeat")


def longest_repeats(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position the length of the longest prefix of its suffix that also starts
    elsewhere. Equal symbols are in one document; ends[i] is where the document of i ends."""
    n = len(symbols)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    order = np.argsort(symbols)
    rank = np.empty(n, np.int64)
    rank[order] = _heads(symbols[order], np.arange(n))
    levels, k = [(1, rank.copy())], 1
    place = _tied(rank[order], np.arange(n))
    first = place
    while len(place):
        own = order[place]
        after = own + k
        second = np.where(after < ends[own], rank[np.minimum(after, n - 1)], -1)
        key = rank[own] * (n + 1) + second + 1
        turn = np.argsort(key)
        own, key = own[turn], key[turn]
        order[place] = own
        head = _heads(key, place)
        rank[own] = head
        k *= 2
        levels.append((k, rank.copy()))
        place = place[_tied(head, np.arange(len(place)))]
    # neighbours in the array that share at least the first symbol
    pair = first[1:][levels[0][1][order[first[1:]]] == levels[0][1][order[first[1:] - 1]]]
    a, b = order[pair - 1], order[pair]
    lcp = np.zeros(len(pair), np.int64)
    for k, ranks in reversed(levels):
        i, j = a + lcp, b + lcp
        same = (i < ends[a]) & (j < ends[b])
        same[same] = ranks[i[same]] == ranks[j[same]]
        lcp[same] += k
    np.maximum.at(out, a, lcp)
    np.maximum.at(out, b, lcp)
    return out


def _heads(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For sorted keys, the place of the first of each run of equal keys."""
    new = np.concatenate(([True], key[1:] != key[:-1]))
    return place[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]


def _tied(head: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Places whose head is shared with a neighbour."""
    same = head[1:] == head[:-1]
    return place[np.concatenate((same, [False])) | np.concatenate(([False], same))]


def profile(texts: list[bytes], least: int = 8) -> dict[str, np.ndarray]:
    """The counts of COLUMNS for each text."""
    out = {c: np.zeros(len(texts), np.int64) for c in COLUMNS}
    for lo, hi in common.slices(texts, _SLICE):
        raw, bounds = common.joined(texts[lo:hi])
        m = hi - lo
        point = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        starts, ends = common.word_bounds(raw)
        doc = np.searchsorted(bounds, starts, side="right") - 1
        size = np.bincount(doc, minlength=m)
        out["n_words"][lo:hi] = size
        length = point[ends] - point[starts]
        out["word_chars"][lo:hi] = np.bincount(doc, weights=length, minlength=m)
        out["n_symbols"][lo:hi] = np.add.reduceat(_SYMBOL[raw].astype(np.int64), bounds[:-1])

        line_end = np.flatnonzero(raw == 0x0A)
        line_start = np.concatenate(([0], line_end[:-1] + 1))
        seen = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
        line_start, line_end = line_start[seen], line_end[seen]
        line_doc = np.searchsorted(bounds, line_start, side="right") - 1
        out["n_dup_lines"][lo:hi] = _repeated(common.word_hashes(raw, line_start, line_end), line_doc, m)

        with np.errstate(over="ignore"):
            symbol = common.mix64(common.word_hashes(raw, starts, ends) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        repeat = longest_repeats(symbol, np.cumsum(size)[doc])
        longest = np.zeros(m, np.int64)
        np.maximum.at(longest, doc, repeat)
        out["longest_repeat"][lo:hi] = longest
        begin = np.flatnonzero(repeat >= least)
        depth = np.zeros(len(starts) + 1, np.int64)
        np.add.at(depth, begin, 1)
        np.add.at(depth, begin + repeat[begin], -1)
        covered = np.cumsum(depth[:-1]) > 0
        out["n_repeat_words"][lo:hi] = np.bincount(doc[covered], minlength=m)
        out["covered_chars"][lo:hi] = np.bincount(doc[covered], weights=length[covered], minlength=m)
    return out


def _repeated(key: np.ndarray, doc: np.ndarray, m: int) -> np.ndarray:
    """How many items of each document equal an earlier one of it."""
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    again = (key[1:] == key[:-1]) & (doc[1:] == doc[:-1])
    return np.bincount(doc[1:][again], minlength=m)


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 8) -> DataFrame:
    """(id, counts of COLUMNS): one row per row of `docs`; repeats of `least` words and more count."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = profile(common.utf8(batch.column(1)), least)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[c]) for c in COLUMNS]], ["id", *COLUMNS])

    schema = f"id {kind}, " + ", ".join(f"{c} long" for c in COLUMNS)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(common.releasing(run), schema)


def passes(most_covered: float = 0.3, longest: int = LONGEST):
    """The verdict on a row of repetition()."""
    return (F.col("covered_chars") <= most_covered * F.col("word_chars")) & (F.col("longest_repeat") <= longest)
