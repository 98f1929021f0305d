"""Token ids of whole texts from a tokenizer file of the tokenizers library, many texts at a time.

For byte-level BPE with the usual word pattern, ids are looked up by units. Between two runs of
visible characters the pattern makes the last character of the white space a piece of its own (a
space goes to what follows) and all before it one piece; white space at a text's end is one
piece. Within a run of ASCII and Latin letters without an apostrophe, pieces are the runs of
letters, of digits and of others; any other run is one unit, which is given to the pattern when
it is met first. So a text can be cut there without changing an id. The distinct units of a
slice of texts are found in numpy (by their bytes, not only a hash of them), the library's model
is asked for those that are not remembered, and the ids are gathered in one step.

Any other tokenizer, and any text that holds an added token, goes through the library whole.
"""

from __future__ import annotations

import os
from array import array
from itertools import accumulate

import numpy as np

from factloom.llm import common

#: Text that is worked on at a time; longer texts are cut between words.
SLICE = 1 << 21
#: Longest unit whose bytes are compared as two 8-byte numbers.
_SHORT = 16
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
#: Characters that Unicode calls white space beyond ASCII, in UTF-8 (fixed values).
_WIDE_SPACE = ["\x85", "\xa0", " ", *map(chr, range(0x2000, 0x200B)), " ", " ", " ", " ", "　"]
_WIDE_BYTES = {x.encode() for x in _WIDE_SPACE}


def _classes() -> np.ndarray:
    out = np.full(256, _ANY, np.uint8)
    out[0x21:0x7F] = _OTHER
    out[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = _LETTER
    out[list(b"0123456789")] = _DIGIT
    out[0x80:0xC0] = out[0xC3:0xC9] = _LETTER  # U+00C0 to U+023F, and what goes on a character
    out[0x27] = _ANY
    out[common.SPACE] = _SPACE
    return out


#: Classes of bytes: white space; letters, digits and others, whose runs are pieces; anything else.
_SPACE, _LETTER, _DIGIT, _OTHER, _ANY = range(5)
_CLASS = _classes()


def _classed(raw: np.ndarray) -> np.ndarray:
    """The class of each byte; all bytes of a visible run that holds `_ANY` are `_ANY`."""
    out = _CLASS[raw]
    out[:-1][(raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))] = _ANY  # the two signs among the letters
    odd = out == _ANY
    if not odd.any():
        return out
    for size in (2, 3):
        for lead in {x[0] for x in _WIDE_BYTES if len(x) == size}:
            for at in np.flatnonzero(raw[: len(raw) - size + 1] == lead).tolist():
                if raw[at : at + size].tobytes() in _WIDE_BYTES:
                    out[at : at + size] = _SPACE
    inside = np.concatenate(([False], out != _SPACE, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[0::2], edges[1::2]
    count = np.concatenate(([0], np.cumsum(odd)))
    whole = np.repeat(count[end] > count[start], end - start)
    out[np.flatnonzero(inside[1:-1])[whole]] = _ANY
    return out


def width_of(path: str) -> int:
    """Bytes of an id of a tokenizer file, without what encoding needs."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4


def cut(data: bytes, sizes: list[int]) -> list[bytes]:
    """Consecutive parts of these sizes."""
    ends = list(accumulate(sizes))
    return [data[a:b] for a, b in zip([0, *ends], ends)]


class Encoder:
    """`encode_all` gives the ids of texts. A worker remembers the ids of at most 2 * `most` units."""

    #: The word pattern of byte-level BPE (fixed value).
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str, most: int = 200_000):
        import json

        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.tokenize = self.library.model.tokenize
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        pre = kind.get("pre_tokenizer") or {}
        added = [x["content"] for x in kind.get("added_tokens", [])]
        self.plain = kind.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and (kind.get("model") or {}).get("type") == "BPE"
        self.plain &= kind.get("truncation") is None and kind.get("padding") is None and not any(x.split() != [x] for x in added)
        self.added = [x.encode() for x in added]
        self.pieces_of = regex.compile(self.PATTERN).findall
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")
        self.code = "H" if self.width == 2 else "I"
        self.most = most
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(shown)]
        self.letters = {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(rest)}}

    # --- single parts ---

    def whole(self, text: bytes) -> np.ndarray:
        """The ids of a text by the library's own encoding."""
        return np.array(self.library.encode(text.decode(), add_special_tokens=False).ids, self.dtype)

    def _pieces(self, unit: bytes) -> list[int]:
        """The ids of a unit from the library's model, piece by piece, bytes shown as letters."""
        if unit.isalnum():  # ASCII letters and digits show themselves
            shown = [unit.decode()] if unit.isalpha() or unit.isdigit() else self.pieces_of(unit.decode())
        elif unit[1:].isalpha() and unit[0] == 0x20:
            shown = ["\u0120" + unit[1:].decode()]
        else:
            shown = [x.encode().decode("latin-1").translate(self.letters) for x in self.pieces_of(unit.decode())]
        return [t.id for x in shown for t in self.tokenize(x)]

    def _known(self, units: list[bytes]) -> list[bytes]:
        """The ids of units, or of pieces of white space, remembered: when one generation is full
        it becomes the old one, and what is still used moves on."""
        if len(self.new) >= self.most:
            self.new, self.old = {}, self.new
        out = list(map(self.new.get, units))
        if None not in out:
            return out
        missing = [i for i, x in enumerate(out) if x is None]
        for i in missing:
            out[i] = self.old.get(units[i])
        missing_ = [i for i in missing if out[i] is None]
        for i, ids in zip(missing_, self._fresh([units[i] for i in missing_])):
            out[i] = ids
        self.new.update((units[i], out[i]) for i in missing)
        return out

    def _fresh(self, units: list[bytes]) -> list[bytes]:
        """The ids of units that are not remembered."""
        flat, size = array(self.code), []
        for unit in units:
            ids = self._pieces(unit)
            flat.extend(ids)
            size.append(len(ids))
        return cut(flat.tobytes(), [n * self.width for n in size])

    # --- many texts ---

    def encode_all(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where those of each start; one more at the end)."""
        sizes = np.zeros(len(texts) + 1, np.int64)
        out = [np.zeros(0, self.dtype)]
        for lo, hi in common.slices(texts, SLICE):
            for i, part in self._parts(texts, lo, hi):
                ids, bounds = part
                out.append(ids)
                sizes[i + 1 : i + len(bounds)] += np.diff(bounds)
        return np.concatenate(out), np.cumsum(sizes)

    def _parts(self, texts: list[bytes], lo: int, hi: int):
        """(first text, (ids, bounds)) of pieces of texts lo..hi-1, in order."""
        if not self.plain or any(x in t for x in self.added for t in texts[lo:hi]):
            for i in range(lo, hi):
                if self.plain and not any(x in texts[i] for x in self.added):
                    yield i, self._slice([texts[i]])
                else:
                    ids = self.whole(texts[i])
                    yield i, (ids, np.array([0, len(ids)]))
        elif hi == lo + 1:
            for piece in _cut(texts[lo]):
                yield lo, self._slice([piece])
        else:
            yield lo, self._slice(texts[lo:hi])

    def _slice(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw, bounds = common.joined(texts)
        data = raw.tobytes()
        kind = _classed(raw)
        edges = np.concatenate(([0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(raw)]))
        seen = np.flatnonzero(kind[edges[:-1]] != _SPACE)
        start, end = edges[seen], edges[seen + 1]
        first = np.searchsorted(start, bounds)  # number of the first unit of each text
        text = np.repeat(np.arange(len(texts)), np.diff(first))
        before = np.maximum(np.concatenate(([0], end[:-1])), bounds[text]) if len(start) else start
        gap = start - before
        lead = raw[start - (gap > 0)]
        spaced = (gap > 0) & (lead == 0x20)
        entries = [b"", *self._known([b"\n"])]
        prefix = np.where((gap == 1) & (lead == 0x0A), 1, 0)
        for j in np.flatnonzero((gap > 1) | (gap == 1) & (lead != 0x20) & (lead != 0x0A)).tolist():
            prefix[j] = len(entries)
            entries.append(self._white(data[before[j] : start[j]]))
        after = np.where(np.diff(first) > 0, end[np.maximum(first[1:] - 1, 0)] if len(end) else 0, bounds[:-1])
        trail = np.zeros(len(texts), np.int64)
        for i in np.flatnonzero(after < bounds[1:] - 1).tolist():
            trail[i] = len(entries)
            entries += self._known([data[after[i] : bounds[i + 1] - 1]])
        unit = self._units(raw, data, start - spaced, end, entries)
        # one place for the white space before each unit, one for the unit, one for each text's end
        place = np.zeros(2 * len(start) + len(texts), np.int64)
        place[2 * np.arange(len(start)) + text] = prefix
        place[2 * np.arange(len(start)) + text + 1] = unit
        place[2 * first[1:] + np.arange(len(texts))] = trail
        pool = np.frombuffer(b"".join(entries), self.dtype)
        size = np.fromiter(map(len, entries), np.int64, len(entries)) // self.width
        count = size[place]
        total = np.concatenate(([0], np.cumsum(count)))
        ids = pool[np.repeat((np.cumsum(size) - size)[place] - total[:-1], count) + np.arange(total[-1])]
        return ids, total[np.concatenate(([0], 2 * first[1:] + np.arange(len(texts)) + 1))]

    def _white(self, run: bytes) -> bytes:
        """The ids of white space before a visible run, without a space that goes to the run."""
        last = 1 if run[-1] < 0x80 else 2 if run[-2] >= 0xC0 else 3
        pieces = [run[:-last]] * (len(run) > last) + [run[-last:]] * (run[-1:] != b" ")
        return b"".join(self._known(pieces))

    def _units(self, raw: np.ndarray, data: bytes, start: np.ndarray, end: np.ndarray, entries: list[bytes]) -> np.ndarray:
        """The entry of each unit; entries of new units are added."""
        size = end - start
        padded = np.concatenate((raw, np.zeros(_SHORT, np.uint8)))
        eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
        head = eight[start] & _MASK[np.minimum(size, 8)]
        tail = eight[np.minimum(start + 8, len(raw))] & _MASK[np.clip(size - 8, 0, 8)]
        with np.errstate(over="ignore"):
            key = common.mix64(head ^ common.mix64(tail + size.astype(np.uint64)))
        short = np.flatnonzero(size <= _SHORT)
        order = short[np.argsort(key[short])]
        new = np.concatenate(([True], key[order[1:]] != key[order[:-1]])) if len(order) else np.zeros(0, bool)
        one = order[new]  # one unit of each key
        which = np.empty(len(size), np.int64)
        nth = np.cumsum(new) - 1
        which[order] = nth + len(entries)
        same = one[nth]
        odd = order[(head[order] != head[same]) | (tail[order] != tail[same]) | (size[order] != size[same])]  # equal keys of different units
        entries += self._known([data[a:b] for a, b in zip(start[one].tolist(), end[one].tolist())])
        rest = np.concatenate((np.flatnonzero(size > _SHORT), odd))
        which[rest] = np.arange(len(entries), len(entries) + len(rest))
        entries += self._known([data[a:b] for a, b in zip(start[rest].tolist(), end[rest].tolist())])
        return which


def _cut(text: bytes):
    """Pieces of a long text, cut before a single space between ASCII letters or digits."""
    at = 0
    while len(text) - at > 2 * SLICE:
        place = at + SLICE
        while 0 < (place := text.find(b" ", place)) < len(text) - 1 and not (text[place - 1 : place].isalnum() and text[place + 1 : place + 2].isalnum()):
            place += 1
        if not 0 < place < len(text) - 1:
            break
        yield text[at:place]
        at = place
    yield text[at:]
