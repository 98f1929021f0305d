"""Byte-level BPE from a file of ranks: texts to ids and back.

A text is cut by a pattern; each match (piece) is merged by itself. A piece that has a rank is one
id. Any other is merged pair by pair: of all pairs of neighbouring tokens whose bytes together
have a rank, the one of the lowest rank is merged, the leftmost of equal ones, until none is left.

A segment tree over the byte positions of a piece holds in each leaf the rank of the pair that
starts there (none at positions that a merge has swallowed), and in each node the smallest of its
leaves, the leftmost of equal ones, so that the root names the next merge. A merge changes three
leaves, at the token, at its live neighbour before it and at the one that it swallows, and the
nodes above them. Distinct pieces of like length are merged together, one row of a numpy array
each; a long piece has a tree of its own. So a piece of n bytes takes n log n steps.

Pieces are found and remembered as `encoder` does it. A worker holds the ranks, the table of pairs
and the ids of at most twice `remembered` units; a text is worked on in slices, so beside a text
and its ids memory does not grow with its length, but for pieces, which are merged whole.

Nulls, empties, ties: a null text has no ids, as an empty one. Rows with null or repeated ids and
equal rows come out as often as they stand there. An empty table gives an empty one. Other columns
do not matter, whatever their names are.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import common
from factloom.llm.encoder import Encoder, cut

#: Bytes from which on a piece is merged alone.
LONG = 256
#: Leaves of pieces that are merged together.
_TOGETHER = 1 << 18


def ranks_of(path: str) -> list[bytes]:
    """The bytes of each id of a file of ranks: a line for each, base64 and the rank."""
    with open(path, "rb") as f:
        lines = [line.split() for line in f if line.strip()]
    out: list[bytes] = [b""] * (1 + max(int(rank) for _, rank in lines))
    for token, rank in lines:
        out[int(rank)] = base64.b64decode(token)
    return out


class Ranks:
    """Ranks of pieces and of pairs of tokens."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {token: i for i, token in enumerate(tokens) if token}
        if missing := [b for b in range(256) if bytes([b]) not in self.rank]:
            raise ValueError(f"no rank for {len(missing)} single bytes")
        self.none = len(tokens)  # greater than any rank
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        rank = self.rank
        pairs = [(rank[t[:i]] * self.none + rank[t[i:]], r) for t, r in rank.items() for i in range(1, len(t)) if t[:i] in rank and t[i:] in rank]
        pairs.sort()
        self.keys = np.array([k for k, _ in pairs] + [1 << 62], np.int64)
        self.values = np.array([r for _, r in pairs] + [self.none], np.int64)
        every = np.arange(1 << 16)
        self.byte_pair = self.of_pairs(self.byte[every >> 8], self.byte[every & 255]).reshape(256, 256)

    @cache
    def packed(self, dtype: np.dtype) -> list[bytes]:
        """Each id by itself as bytes."""
        return cut(np.arange(self.none, dtype=dtype).tobytes(), [dtype.itemsize] * self.none)

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens, `none` without one."""
        key = left * self.none + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], self.none)


def merged_rows(ranks: Ranks, pieces: list[bytes], leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids of each) of pieces of 2 to `leaves` bytes, a power of two; a tree a row.

    A node holds rank * leaves + position, so the smaller of two is the lower rank, or the one
    further left. Node 1 is the root, nodes leaves..2*leaves-1 the leaves. Row and position
    address flat arrays; position `leaves` stands for the end of a piece.
    """
    n, levels = len(pieces), leaves.bit_length() - 1
    size = np.fromiter(map(len, pieces), np.int64, n)
    at = np.arange(leaves)
    raw = np.frombuffer(b"".join(x.ljust(leaves, b"\0") for x in pieces), np.uint8).reshape(n, leaves)
    inside = at < size[:, None]
    width = leaves + 1
    token = np.zeros((n, width), np.int64)
    token[:, :leaves] = ranks.byte[raw]
    after = np.minimum(np.broadcast_to(np.arange(1, width + 1), (n, width)), size[:, None]).copy()
    before = np.broadcast_to(np.arange(-1, leaves), (n, width)).copy()
    none = ranks.none * leaves
    tree = np.full((n, 2 * leaves), none, np.int64)
    pair = np.full((n, leaves), ranks.none, np.int64)
    pair[:, :-1] = np.where(inside[:, 1:], ranks.byte_pair[raw[:, :-1], raw[:, 1:]], ranks.none)
    tree[:, leaves:] = pair * leaves + at
    for level in range(levels):
        half = leaves >> level
        np.minimum(tree[:, half : 2 * half : 2], tree[:, half + 1 : 2 * half : 2], out=tree[:, half >> 1 : half])
    token, after, before, tree = (x.reshape(-1) for x in (token, after, before, tree))

    rows = np.arange(n)
    while len(rows := rows[tree[rows * (2 * leaves) + 1] < none]):
        root = tree[rows * (2 * leaves) + 1]
        here, rank = root & (leaves - 1), root >> levels
        line, end = rows * width, size[rows]
        gone = after[line + here]
        right = after[line + gone]
        left = before[line + here]
        token[line + here] = rank
        after[line + here] = right
        before[line + right] = here  # at the end nobody reads it
        has_right, has_left = right < end, left >= 0
        new_here = np.full(len(rows), ranks.none, np.int64)
        new_here[has_right] = ranks.of_pairs(rank[has_right], token[(line + right)[has_right]])
        new_left = ranks.of_pairs(token[(line + left)[has_left]], rank[has_left])
        # the leaves that change, then their nodes, level by level
        owner = np.concatenate((rows, rows, rows[has_left])) * (2 * leaves)
        place = np.concatenate((here, gone, left[has_left]))
        tree[owner + leaves + place] = np.concatenate((new_here, np.full(len(rows), ranks.none), new_left)) * leaves + place
        node = place + leaves
        for _ in range(levels):
            node >>= 1
            tree[owner + node] = np.minimum(tree[owner + 2 * node], tree[owner + 2 * node + 1])
    alive = np.zeros(n * width, bool)  # positions that are still reached from the first
    rows, where = np.arange(n), np.zeros(n, np.int64)
    while len(rows):
        alive[rows * width + where] = True
        where = after[rows * width + where]
        more = where < size[rows]
        rows, where = rows[more], where[more]
    return token[alive], alive.reshape(n, width).sum(axis=1)


def merged_alone(ranks: Ranks, piece: bytes) -> np.ndarray:
    """The ids of one long piece: the same tree in plain lists."""
    size = len(piece)
    leaves = 1 << (size - 1).bit_length()
    shift, none = leaves.bit_length() - 1, ranks.none << (leaves.bit_length() - 1)
    raw = np.frombuffer(piece, np.uint8)
    token = ranks.byte[raw].tolist()
    first = np.full(leaves, ranks.none, np.int64)
    first[: size - 1] = ranks.byte_pair[raw[:-1], raw[1:]]
    level = (first << shift) + np.arange(leaves)
    parts = [level]
    while len(level) > 1:
        level = np.minimum(level[0::2], level[1::2])
        parts.append(level)
    tree = [0, *np.concatenate(parts[::-1]).tolist()]
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    rank_of, tokens = ranks.rank.get, ranks.tokens

    def put(place: int, rank: int) -> None:
        node = leaves + place
        tree[node] = (rank << shift) + place
        while node > 1:
            node >>= 1
            a, b = tree[2 * node], tree[2 * node + 1]
            least = a if a < b else b
            if tree[node] == least:
                return
            tree[node] = least

    while (root := tree[1]) < none:
        here, rank = root & (leaves - 1), root >> shift
        gone = after[here]
        right, left = after[gone], before[here]
        token[here], after[here] = rank, right
        put(gone, ranks.none)
        if right < size:
            before[right] = here
            put(here, rank_of(tokens[rank] + tokens[token[right]], ranks.none))
        else:
            put(here, ranks.none)
        if left >= 0:
            put(left, rank_of(tokens[token[left]] + tokens[rank], ranks.none))
    out, at = [], 0
    while at < size:
        out.append(token[at])
        at = after[at]
    return np.array(out, np.int64)


def merged(ranks: Ranks, pieces: list[bytes], dtype: np.dtype) -> list[bytes]:
    """The packed ids of pieces, none of them empty."""
    out: list[bytes] = [b""] * len(pieces)
    single = ranks.packed(dtype)
    groups: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        whole = ranks.rank.get(piece)
        if whole is not None:
            out[i] = single[whole]
        elif len(piece) >= LONG:
            out[i] = merged_alone(ranks, piece).astype(dtype).tobytes()
        else:
            groups.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
    for leaves, members in groups.items():
        step = max(1, _TOGETHER // leaves)
        for lo in range(0, len(members), step):
            some = members[lo : lo + step]
            ids, count = merged_rows(ranks, [pieces[i] for i in some], leaves)
            for i, packed in zip(some, cut(ids.astype(dtype).tobytes(), (count * dtype.itemsize).tolist())):
                out[i] = packed
    return out


class RankEncoder(Encoder):
    """`encode_all` and `decode` by a file of ranks. A pattern other than the usual one of byte-level
    BPE cuts whole texts; the usual one lets texts be cut between words first."""

    def __init__(self, path: str, pattern: str, most: int):
        import regex

        self.ranks = Ranks(ranks_of(path))
        self.pieces_of = regex.compile(pattern).findall
        self.plain = pattern == self.PATTERN
        self.added: list[bytes] = []
        self.width = 2 if self.ranks.none <= 1 << 16 else 4
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")
        self.most = most
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        size = np.fromiter(map(len, self.ranks.tokens), np.int64, self.ranks.none)
        self.size, self.start = size, np.cumsum(size) - size
        self.pool = np.frombuffer(b"".join(self.ranks.tokens), np.uint8)

    def whole(self, text: bytes) -> np.ndarray:
        return np.frombuffer(self._fresh([text])[0], self.dtype)

    def _fresh(self, units: list[bytes]) -> list[bytes]:
        nth: dict[bytes, int] = {}
        parts = []
        for unit in units:
            if unit.isalpha() or unit.isdigit() or unit[:1] == b" " and unit[1:].isalpha():  # ASCII: one piece
                found = [unit]
            else:
                found = [x.encode() for x in self.pieces_of(unit.decode())] if self.plain or unit else []
            parts.append([nth.setdefault(x, len(nth)) for x in found])
        ids = merged(self.ranks, list(nth), self.dtype)
        return [ids[p[0]] if len(p) == 1 else b"".join([ids[i] for i in p]) for p in parts]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids."""
        ids = ids.astype(np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= self.ranks.none):
            raise ValueError("ids without bytes")
        size = self.size[ids]
        total = np.cumsum(size)
        return self.pool[np.repeat(self.start[ids] - (total - size), size) + np.arange(total[-1] if len(ids) else 0)].tobytes()


_encoders: dict[tuple, RankEncoder] = {}


def _encoder(path: str, pattern: str, remembered: int) -> RankEncoder:
    """One encoder a worker."""
    if (path, pattern, remembered) not in _encoders:
        _encoders.clear()
        _encoders[path, pattern, remembered] = RankEncoder(path, pattern, remembered)
    return _encoders[path, pattern, remembered]


def encoded(docs: DataFrame, ranks: str, pattern: str = RankEncoder.PATTERN, id_col: str = "doc_id", text_col: str = "text", remembered: int = 100_000) -> DataFrame:
    """(id, ids): the ids of each whole text, array<int>, by the file of ranks at `ranks`."""

    def run(batches):
        import pyarrow as pa

        encoder = _encoder(ranks, pattern, remembered)
        for batch in batches:
            ids, start = encoder.encode_all(common.utf8(batch.column(1)))
            lists = pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(ids.astype(np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(common.releasing(run), f"id {kind}, ids array<int>")


def decoded(coded: DataFrame, ranks: str, remembered: int = 100_000) -> DataFrame:
    """(id, ids, data): the bytes that the ids stand for; null ids have none."""

    def run(batches):
        import pyarrow as pa

        encoder = _encoder(ranks, RankEncoder.PATTERN, remembered)
        for batch in batches:
            lists = batch.column(1)
            texts = [encoder.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else b"" for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts, pa.binary())], ["id", "ids", "data"])

    kind = coded.schema["id"].dataType.simpleString()
    return coded.select("id", "ids").mapInArrow(common.releasing(run), f"id {kind}, ids array<int>, data binary")
