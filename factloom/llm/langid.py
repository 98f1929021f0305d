"""Language identification by prediction with partial matching.

For every language one variable-order context tree over bytes is counted from labelled
texts and then frozen. The code length of a byte after a context is that of method C: a
byte seen after the context costs log2((total + distinct) / count); one that was not costs
the escape, log2((total + distinct) / distinct), plus its cost in the next shorter context;
below order 0 all 256 bytes cost 8 bits. A context that never occurred passes on for free. A
text's language is the one whose tree codes its bytes shortest.

The trees of all languages are laid out as one table, row = context of `order` bytes (every
context that any language saw), column = byte, entry = one code length per language, so a
whole text is coded by array look-ups. Bytes that no language saw all cost the same and share
a column; this is exact, as is passing unseen contexts on to their suffix.

The model is fitted on a bounded sample of labelled rows: at most `per_language` different ones of
each language, those with the smallest hashes of id and text, and at most `language_bytes` bytes of
them (one row at least). All other figures cover whole texts.

Nulls, empties, ties: a null text, or one without a letter, is `und` with score 0; rows whose
language or id is null teach nothing but are predicted; equal code lengths go to the language
first in code-point order; without any labelled row everything is `und`. Repeated rows are
returned as often as they occur, and teach as one; rows of one id with different texts are different
rows; every language that has a row is learned. A very long text is coded in pieces. An empty table
gives no row. Columns may have any names.

The table is broadcast. Its size is bounded by the sample, not the corpus: contexts x columns x
languages x 4 bytes, 17 MB for 4 languages, and up to some GB for hundreds; a fit whose table
would exceed `most_bytes` is refused, with what to lower (the order, or the sample).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import common

UNDETERMINED = "und"
_STEP = 1 << 18


def _counted(texts: list[bytes], order: int) -> np.ndarray:
    """(gram, order, count) of all grams of 1 to order+1 bytes; a gram is read as a base-256 number."""
    out = []
    for a, b in common.slices(texts, 1 << 22):
        raw, bounds = common.joined(texts[a:b])
        raw = raw.astype(np.int64)
        inside = np.ones(len(raw), bool)
        inside[bounds[1:] - 1] = False
        # position within its text, to keep grams from crossing texts
        place = np.arange(len(raw)) - np.repeat(bounds[:-1], np.diff(bounds))
        gram = np.zeros(len(raw), np.int64)
        for k in range(order + 1):
            shifted = np.concatenate((np.zeros(k, np.int64), raw[: len(raw) - k]))
            gram = gram + (shifted << (8 * k))
            value, count = np.unique(gram[inside & (place >= k)], return_counts=True)
            out.append(np.stack((value, np.full(len(value), k), count)))
    return np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)


class Model:
    """Frozen context trees of all languages."""

    def __init__(self, counts: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]], order: int, most_bytes: int = 512 << 20):
        """counts: language -> k -> (sorted grams of k+1 bytes, their counts)."""
        self.languages = sorted(counts)
        self.order = order
        if not self.languages:
            return
        rows = sum(len(np.unique(np.concatenate([own[k][0] >> 8 for own in counts.values() if k in own] or [np.zeros(0, np.int64)]))) for k in range(order + 1))
        size = 4 * rows * 256 * len(self.languages)
        if size > most_bytes:
            raise ValueError(f"the model's table may take {size >> 20} MB, {most_bytes >> 20} are allowed: lower the order or per_language")
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        grams = [[counts[lang].get(k, empty) for lang in self.languages] for k in range(order + 1)]
        seen = np.unique(np.concatenate([g for g, _ in grams[0]]))
        self.column = np.zeros(256, np.int64)  # 0: a byte that no language saw
        self.column[seen] = np.arange(1, len(seen) + 1)
        self.width = len(seen) + 1
        contexts = [np.zeros(1, np.int64)]  # by order: the contexts that some language saw
        tables = [self._coded(np.full((1, self.width, len(self.languages)), 8.0), contexts[0], grams[0])]
        self.next = []  # by order: row of (row of the shorter context, byte before it), or -1
        for k in range(1, order + 1):
            known = np.unique(np.concatenate([g >> 8 for g, _ in grams[k]]))
            # A context's suffix is known, because every text that has the one has the other.
            suffix = np.searchsorted(contexts[-1], known & ((1 << (8 * (k - 1))) - 1))
            tables.append(self._coded(tables[-1][suffix], known, grams[k]))
            step = np.full((len(contexts[-1]), self.width), -1, np.int32)
            step[suffix, self.column[known >> (8 * (k - 1))]] = np.arange(len(known))
            self.next.append(step)
            contexts.append(known)
        self.base = np.cumsum([0, *map(len, contexts)])[:-1].tolist()
        self.table = np.concatenate(tables).astype(np.float32)

    def _coded(self, shorter: np.ndarray, known: np.ndarray, grams: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Code lengths after each context, from those after its suffix."""
        out = shorter.copy()
        for i, (gram, n) in enumerate(grams):
            row = np.searchsorted(known, gram >> 8)
            total = np.bincount(row, weights=n, minlength=len(known))
            distinct = np.bincount(row, minlength=len(known))
            has = distinct > 0
            out[has, :, i] += np.log2((total[has] + distinct[has]) / distinct[has])[:, None]
            out[row, self.column[gram & 255], i] = np.log2((total + distinct)[row] / n)
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text under each language."""
        out = np.zeros((len(texts), len(self.languages)))
        flat = self.table.reshape(-1, len(self.languages))
        for a, b in common.slices(texts, _STEP):
            raw, bounds = common.joined(texts[a:b])
            for lo in range(0, len(raw), 4 * _STEP):  # a very long text in pieces, with its context before
                first = max(0, lo - self.order)
                hi = min(len(raw), lo + 4 * _STEP)
                col = self.column[raw[first:hi]]
                place = np.arange(first, hi)
                text = np.searchsorted(bounds, place, side="right") - 1
                depth = place - bounds[text]
                row = np.zeros(len(col), np.int64)
                best = np.zeros(len(col), np.int64)
                alive = np.ones(len(col), bool)
                for k in range(1, self.order + 1):
                    before = np.zeros(len(col), np.int64)
                    before[k:] = col[: len(col) - k]
                    alive &= depth >= k
                    alive[:k] = False
                    step = self.next[k - 1][np.where(alive, row, 0), before]
                    alive &= step >= 0
                    row = np.where(alive, step, 0)
                    best = np.where(alive, self.base[k] + step, best)
                bits = flat[best * self.width + col].astype(np.float64)
                bits[place == bounds[text + 1] - 1] = 0  # the separators
                bits, text = bits[lo - first :], text[lo - first :]
                cut = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
                np.add.at(out, a + text[cut], np.add.reduceat(bits, cut, axis=0))
        return out

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, bits per byte under that language) of each text. The score is the
        posterior of the language from the mean code lengths of a stretch of 64 bytes at most."""
        letters = np.array([_letter(t) for t in texts], bool)
        size = np.array([len(t) for t in texts], float)
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        mean = self.lengths(texts) / np.maximum(size, 1)[:, None]
        best = mean.argmin(axis=1)
        lead = (mean - mean.min(axis=1)[:, None]) * np.minimum(size, 64)[:, None]
        score = 1 / np.exp2(-lead).sum(axis=1) if len(texts) else np.zeros(0)
        return [self.languages[i] if ok else UNDETERMINED for i, ok in zip(best, letters)], np.where(letters, score, 0.0), mean.min(axis=1) if len(texts) else score


def _letter(text: bytes) -> bool:
    """Is there a letter? Most texts show one within their first words."""
    for at in range(0, len(text), 256):
        if text[at : at + 256].isalpha() or any(0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A for c in text[at : at + 256]):
            return True
    return not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace"))


def sampled(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, language_bytes: int = 32 << 20, seed: int = 11) -> DataFrame:
    """(lang, text): at most `per_language` different rows of each language, those with the smallest
    hashes of id and text, fewer if they pass `language_bytes` together (one at least; texts longer
    than that come last). Rows that are equal in id and text count once, whatever their number."""
    known = labelled.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    rows = known.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)).alias("key"), F.col(text_col).alias("text"))
    # Hashes are spread evenly over different rows, so a cut at twice the share asked for leaves about
    # twice as many of each language, however large it is; a language of which too few pass is cut again.
    size = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).collect()}
    share = {lang: min(1.0, (2 * per_language + 100) / max(1, n)) for lang, n in size.items()}
    found = None
    while share:
        low, whole = -(1 << 63), 1 << 64
        cut = {lang: min((1 << 63) - 1, low + int(whole * part)) for lang, part in share.items()}
        near = rows.filter(F.col("key") <= _by_language(cut)).groupBy("lang", "key").agg(F.first("text").alias("text"))
        near = common.materialise(near, "language-sample")
        enough = {r.lang: r.n for r in near.groupBy("lang").agg(F.count("*").alias("n")).collect()}
        share = {lang: min(1.0, 8 * part) for lang, part in share.items() if part < 1 and enough.get(lang, 0) < per_language}
        near = near.filter(~F.col("lang").isin(list(share)))
        found = near if found is None else found.unionByName(near)
    if found is None:
        return rows.select("lang", "text").limit(0)
    bytes_ = F.octet_length("text")
    order = Window.partitionBy("lang").orderBy(bytes_ > language_bytes, "key")
    before = F.coalesce(F.sum(bytes_).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = found.select("lang", "text", F.row_number().over(order).alias("rank"), (before + bytes_).alias("upto"))
    return ranked.filter((F.col("rank") == 1) | (F.col("rank") <= per_language) & (F.col("upto") <= language_bytes)).select("lang", "text")


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = 3, per_language: int = 400, language_bytes: int = 32 << 20, seed: int = 11) -> Model:
    """Count the trees over the sampled documents, in Spark, and collect the counts: their
    number is bounded by the sample. Every language with a row is learned."""
    sample = sampled(labelled, id_col, text_col, lang_col, per_language, language_bytes, seed)

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            langs = batch.column(0).to_pylist()
            texts = common.utf8(batch.column(1))
            for lang in sorted(set(langs)):
                gram, k, n = _counted([t for t, x in zip(texts, langs) if x == lang], order)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(k), pa.array(n)], ["lang", "gram", "k", "n"])

    sums = sample.mapInArrow(common.releasing(count), "lang string, gram long, k long, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))
    table = sums.toArrow().to_pandas()
    counts: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
    for (lang, k), part in table.groupby(["lang", "k"]):
        part = part.sort_values("gram")
        counts.setdefault(lang, {})[int(k)] = (part["gram"].to_numpy(np.int64), part["n"].to_numpy(np.int64))
    return Model(counts, order)


def _by_language(values: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) if isinstance(x, str) else F.lit(x).cast("long") for pair in values.items() for x in pair])[F.col("lang")]


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, bits_per_byte) per row."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lang, score, bits = shared.value.predict(common.utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], ["id", "lang_pred", "score", "bits_per_byte"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(common.releasing(run), f"id {kind}, lang_pred string, score double, bits_per_byte double")


def accepted(docs: DataFrame, model: Model, text_col: str = "text", least_score: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns as they are, with a predicted language and a score of at
    least `least_score`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lang, score, _ = shared.value.predict(common.utf8(batch.column(at)))
            yield batch.filter(pa.array([x != UNDETERMINED and s >= least_score for x, s in zip(lang, score)], pa.bool_()))

    return docs.mapInArrow(common.releasing(run), docs.schema)
