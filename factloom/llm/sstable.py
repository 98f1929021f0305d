"""Token ids in sorted-string tables, one file per range of document ids.

A shard holds documents in key order in compressed blocks: each entry is the length of the
prefix shared with the key before, the rest of the key, and the ids as little-endian 16- or
32-bit numbers. After the blocks come the sparse index (first key, offset, length of each
block), a Bloom filter of the keys, and a footer of fixed size, which ends the file:

    blocks | index | Bloom filter | footer
    footer: index offset, index length, filter length, documents, ids, width of an id,
            hashes of the filter, magic (little-endian, see _FOOTER)

A look-up reads the footer, asks the filter, finds the block by binary search in the index
and reads one block. Keys are 0x00 for a null id, 0x01 and the number with its sign bit
turned, big-endian, for an integer, 0x02 and UTF-8 for a string; bytes order as ids do,
nulls first. A shard file appears under its name when it is whole, so a task that is run
again replaces it.

Nulls, empties, ties: a null text is the empty text and holds the end id only; a null id is
the smallest key; rows with equal ids are kept all, next to each other; an empty table gives
no shard; ids are whole numbers or strings. The order of rows with equal ids is by their token ids,
and they are one shard, however many.
"""

from __future__ import annotations

import os
import struct
import zlib
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import common
from factloom.llm.encoder import Encoder, width_of

MAGIC = b"FLSST001"
_FOOTER = struct.Struct("<QQQQQBB8s")
BLOCK_BYTES = 1 << 16
END_ID = 2

def path_of(name: str = "byte_bpe_50k.json") -> str:
    """The file of a public tokenizer as installed on the machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


# --- files ----------------------------------------------------------------------


def key_of(doc_id) -> bytes:
    if doc_id is None:
        return b"\x00"
    if isinstance(doc_id, int):
        return b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))
    if not isinstance(doc_id, str):
        raise TypeError("ids must be whole numbers or strings")
    return b"\x02" + doc_id.encode()


def id_of(key: bytes):
    if key[:1] == b"\x00":
        return None
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[:1] == b"\x01" else key[1:].decode()


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int, hashes: int) -> list[int]:
    from xxhash import xxh3_128_intdigest

    h = xxh3_128_intdigest(key)
    a, b = h & 0xFFFFFFFFFFFFFFFF, h >> 64 | 1
    return [(a + i * b) % bits for i in range(hashes)]


class Writer:
    """One shard, entries in key order. Memory: one block, the index and the keys' filter."""

    def __init__(self, uri: str, width: int, hashes: int = 7, bits_per_key: int = 10):
        import zstandard

        self.file = common.AtomicFile(uri)
        self.pack = zstandard.ZstdCompressor(level=1).compress
        self.width, self.hashes, self.bits_per_key = width, hashes, bits_per_key
        self.block, self.first, self.last = bytearray(), b"", b""
        self.index: list[tuple[bytes, int, int]] = []
        self.hashed = bytearray()
        self.docs = self.ids = 0

    def add(self, key: bytes, ids: bytes) -> None:
        from xxhash import xxh3_128_digest

        if not self.block:
            self.first, self.last = key, b""
        common_ = len(os.path.commonprefix((self.last, key)))
        self.block += _varint(common_) + _varint(len(key) - common_) + _varint(len(ids)) + key[common_:] + ids
        self.last = key
        self.hashed += xxh3_128_digest(key)
        self.docs += 1
        self.ids += len(ids) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = self.pack(bytes(self.block))
            self.index.append((self.first, self.file.size, len(data)))
            self.file.write(data)
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        start = self.file.size
        index, last = bytearray(), b""
        for key, offset, length in self.index:
            n = len(os.path.commonprefix((last, key)))
            index += _varint(n) + _varint(len(key) - n) + key[n:] + _varint(offset) + _varint(length)
            last = key
        bits = max(64, self.docs * self.bits_per_key)
        # digests are big-endian: high half first
        halves = np.frombuffer(bytes(self.hashed), ">u8").reshape(-1, 2).astype(np.uint64)
        bloom = np.zeros(-(-bits // 8), np.uint8)
        bits = len(bloom) * 8
        for i in range(self.hashes):
            # (a + i*b) mod bits with a and b reduced first, so that nothing overflows
            place = (halves[:, 1] % np.uint64(bits) + np.uint64(i) * ((halves[:, 0] | np.uint64(1)) % np.uint64(bits))) % np.uint64(bits)
            np.bitwise_or.at(bloom, (place >> np.uint64(3)).astype(np.int64), (np.uint64(1) << (place & np.uint64(7))).astype(np.uint8))
        self.file.write(bytes(index))
        self.file.write(bloom.tobytes())
        self.file.write(_FOOTER.pack(start, len(index), len(bloom), self.docs, self.ids, self.width, self.hashes, MAGIC))
        self.file.close()


class Shard:
    """Reads one shard by ranges."""

    def __init__(self, uri: str):
        fs, path = common.filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.index_at, index_len, bloom_len, self.docs, self.ids, self.width, self.hashes, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a shard")
        data = self.file.read_at(index_len, self.index_at)
        self.bloom = self.file.read_at(bloom_len, self.index_at + index_len)
        self.keys: list[bytes] = []
        self.places: list[tuple[int, int]] = []
        at, last = 0, b""
        while at < len(data):
            n, at = _read_varint(data, at)
            more, at = _read_varint(data, at)
            last = last[:n] + data[at : at + more]
            offset, at = _read_varint(data, at + more)
            length, at = _read_varint(data, at)
            self.keys.append(last)
            self.places.append((offset, length))

    def block(self, i: int):
        """(key, ids as bytes) of block i."""
        import zstandard

        offset, length = self.places[i]
        data = zstandard.ZstdDecompressor().decompress(self.file.read_at(length, offset))
        at, last = 0, b""
        while at < len(data):
            n, at = _read_varint(data, at)
            more, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            last = last[:n] + data[at : at + more]
            at += more
            yield last, data[at : at + size]
            at += size

    def __iter__(self):
        for i in range(len(self.keys)):
            yield from self.block(i)

    def may_hold(self, key: bytes) -> bool:
        bits = len(self.bloom) * 8
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, bits, self.hashes))

    def get(self, doc_id) -> list[np.ndarray]:
        """The ids of every document with this id: filter, binary search, one block or few."""
        key = key_of(doc_id)
        if not self.may_hold(key):
            return []
        i = max(0, bisect_right(self.keys, key) - 1)
        while i > 0 and self.keys[i] == key:  # equal keys may fill several blocks
            i -= 1
        out = []
        for j in range(i, len(self.keys)):
            if self.keys[j] > key:
                break
            out += [np.frombuffer(ids, "<u2" if self.width == 2 else "<u4").astype(np.uint32) for k, ids in self.block(j) if k == key]
        return out

    def close(self) -> None:
        self.file.close()


@dataclass(frozen=True)
class Entry:
    """One shard in the manifest. base: ids in all shards before it."""

    uri: str
    docs: int
    ids: int
    base: int


_encoders: dict[tuple[str, int], Encoder] = {}


def _encoder(tokenizer: str, remembered: int) -> Encoder:
    """One encoder a worker."""
    if (tokenizer, remembered) not in _encoders:
        _encoders.clear()
        _encoders[tokenizer, remembered] = Encoder(tokenizer, remembered)
    return _encoders[tokenizer, remembered]


def encoded(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", remembered: int = 100_000, bounds: list[bytes] = ()) -> DataFrame:
    """(part, id, ids): the packed ids of each document with the end id, and how many of the
    ascending keys in `bounds` are not above its key."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        encoder = _encoder(tokenizer, remembered)
        for batch in batches:
            texts = common.utf8(batch.column(1))
            ids, start = encoder.encode_all(texts)
            ids = np.insert(ids, start[1:], END_ID).tobytes()
            ends = ((start[1:] + np.arange(1, len(start))) * encoder.width).tolist()
            part = [bisect_right(bounds, key_of(x)) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), batch.column(0), pa.array([ids[a:b] for a, b in zip([0, *ends], ends)], pa.binary())], ["part", "id", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(common.releasing(run), f"part int, id {kind}, ids binary")


def _bounds(docs: DataFrame, id_col: str, shard_docs: int) -> list[bytes]:
    """Keys at which a new shard begins, for about `shard_docs` documents in each: the smallest
    ids of the partitions of a range partitioning of the ids alone; no text is read."""
    ids = docs.select(F.col(id_col).alias("id"))
    spark = docs.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-ids.count() // shard_docs))
    firsts = ids.repartitionByRange(shards, F.col("id").asc_nulls_first()).groupBy(F.spark_partition_id().alias("part")).agg(F.min("id").alias("id"))
    return sorted(key_of(r.id) for r in firsts.collect())[1:]


def write(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", remembered: int = 100_000, shard_docs: int = 1 << 16) -> list[Entry]:
    """Encode and write all documents in ascending id order; returns the manifest, one entry a
    shard of about `shard_docs` documents or less. Texts are read once and encoded where they are
    read, so that only ids are exchanged. A worker remembers the ids of at most twice
    `remembered` units (about 0.2 KB each); fewer cost time, not results."""
    bounds = _bounds(docs, id_col, shard_docs)
    width = width_of(tokenizer)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        uri, shard = f"{folder}/shard-{part:06d}.sst", None
        try:
            for batch in batches:
                for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    shard = shard or Writer(uri, width)
                    shard.add(key_of(doc_id), ids)
            if shard:
                shard.close()
        except BaseException:
            if shard:
                shard.file.abandon()
            raise
        if shard:
            yield pa.RecordBatch.from_pylist([{"part": part, "uri": uri, "docs": shard.docs, "ids": shard.ids}])

    rows = encoded(docs, tokenizer, id_col, text_col, remembered, bounds).repartitionById(len(bounds) + 1, "part")
    sorted_ = rows.sortWithinPartitions(F.col("id").asc_nulls_first(), "ids").select("id", "ids")
    made = sorted(sorted_.mapInArrow(common.releasing(run), "part long, uri string, docs long, ids long").collect())
    out, base = [], 0
    for row in made:
        out.append(Entry(row.uri, row.docs, row.ids, base))
        base += row.ids
    return out


def read(spark, manifest: list[Entry], kind: str = "bigint") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files: where its ids start
    among all, their number with the end id, and the CRC-32 of the ids as 32-bit numbers."""
    schema = f"id {kind}, start long, n_tokens long, ids_crc32 long"
    if not manifest:
        return spark.createDataFrame([], schema)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(uri)
                at, cols = base, ([], [], [], [])
                for key, ids in shard:
                    wide = np.frombuffer(ids, "<u2" if shard.width == 2 else "<u4").astype("<u4")
                    for col, value in zip(cols, (id_of(key), at, len(wide), zlib.crc32(wide.tobytes()))):
                        col.append(value)
                    at += len(wide)
                shard.close()
                types = (common.arrow_type(kind), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["id", "start", "n_tokens", "ids_crc32"])

    shards = spark.createDataFrame([(e.uri, e.base) for e in manifest], "uri string, base long")
    return shards.repartition(min(len(manifest), 2048), "uri").mapInArrow(common.releasing(run), schema)


def lookup(manifest: list[Entry], doc_id) -> list[np.ndarray]:
    """The ids of the documents with this id, by binary search in each shard that may hold it."""
    out = []
    for entry in manifest:
        shard = Shard(entry.uri)
        out += shard.get(doc_id)
        shard.close()
    return out
