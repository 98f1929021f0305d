"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing. One record a page, its block an HTTP response whose body is the payload. Of pages
with equal payloads of at least `least_bytes` bytes, that with the largest id is a `response`
record; the others are `revisit` records, which keep the HTTP head (with the payload's length)
and name the response. With gzip, every record is a member of its own.

Reading. Archives are read in ranges. Tasks emit, for every place in their range that looks
like the start of a record, the offset of its successor: for plain files the end that its
Content-Length gives, for gzip the end of the member. Per file, pointer jumping from offset 0
then keeps the records on the chain from the file's start, so that record heads and gzip
members inside payloads are never taken for records. A second pass reads the kept ones.

Nulls, empties, ties: a null payload is an empty one; a null id is smaller than any other; a
null url is written as an empty target; of repeated rows with the largest id all are
responses. Heads and payloads may be of any length. A last record that is cut off is dropped;
if an archive's number of records is known and the chain keeps another, reading fails, so no
record is lost unseen. No pages give no archive. Ids are whole numbers or strings.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import common

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
PLAIN, GZIP = b"WARC/1.", b"\x1f\x8b\x08"
ARCHIVE_BYTES, RANGE_BYTES, PIECE = 512 << 20, 8 << 20, 1 << 18


_CONTROL = re.compile(r"[\x00-\x20\x7f]")  # written percent-encoded in a target


@dataclass(frozen=True)
class Archive:
    uri: str
    size: int
    records: int | None = None


def _urn(page_id) -> str:
    return "<urn:page:" + ("" if page_id is None else quote(str(page_id), safe="")) + ">"


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False, digest: bytes | None = None) -> bytes:
    """One WARC record; of a revisit the payload is left out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_CONTROL.sub(lambda m: f'%{ord(m[0]):02X}', url or '')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest or hashlib.sha1(payload).digest()).decode()}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", gzip: bool = True, least_bytes: int = 1000, broadcast_digests: int = 500_000, salts: int = 64
) -> list[Archive]:
    """Write all pages; returns the archives (their number follows partitions and bytes).

    Which payloads occur twice is found on (id, digest) rows. If at most `broadcast_digests` do,
    that table is broadcast, and payloads are written where they are read; else payloads are
    joined to it, those of one digest dealt out over `salts` keys."""
    spark = pages.sparkSession
    common.arrow_type(pages.schema[id_col].dataType.simpleString())
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    own = rows.filter(F.length("payload") >= least_bytes).select(F.col("digest").alias("_digest"), "id")
    shared = own.groupBy("_digest").agg(F.max("id").alias("best"), F.count("*").alias("n")).filter("n > 1").drop("n")
    shared = common.materialise(shared, "warc-shared")
    if shared.count() <= broadcast_digests:
        decided = rows.join(F.broadcast(shared), F.col("digest") == F.col("_digest"), "left")
    else:
        dealt = shared.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salt = F.pmod(F.xxhash64("id", "url"), F.lit(salts)).cast("int")
        decided = rows.withColumn("salt", salt).join(dealt, (F.col("digest") == F.col("_digest")) & (F.col("salt") == F.col("_salt")), "left")
    revisit = F.col("_digest").isNotNull() & ~F.col("id").eqNullSafe(F.col("best"))
    decided = decided.select("id", "url", "payload", "digest", revisit.alias("revisit"), "best")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, turn, out, made = TaskContext.get().partitionId(), 0, None, []
        try:
            for batch in batches:
                for page_id, url, body, digest, again, best in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None:
                        uri = f"{folder}/pages-{part:06d}-{turn:04d}.warc" + (".gz" if gzip else "")
                        out, n = common.AtomicFile(uri), 0
                    data = record(page_id, url, body, best, again, bytes.fromhex(digest))
                    if gzip:
                        member = zlib.compressobj(6, zlib.DEFLATED, 31)
                        data = member.compress(data) + member.flush()
                    out.write(data)
                    n += 1
                    if out.size >= ARCHIVE_BYTES:
                        out.close()
                        made.append({"uri": uri, "size": out.size, "records": n})
                        out, turn = None, turn + 1
            if out is not None:
                out.close()
                made.append({"uri": uri, "size": out.size, "records": n})
        except BaseException:
            if out is not None:
                out.abandon()
            raise
        if made:
            yield pa.RecordBatch.from_pylist(made)

    return [Archive(r.uri, r.size, r.records) for r in sorted(decided.mapInArrow(common.releasing(run), "uri string, size long, records long").collect())]


class _Source:
    """A file read forward in pieces from any offset."""

    def __init__(self, uri: str):
        fs, path = common.filesystem(uri)
        self.file = fs.open_input_file(path)
        self.size = self.file.size()
        self.at, self.data = 0, b""

    def read(self, offset: int, n: int) -> bytes:
        n = min(n, self.size - offset)
        if n <= 0:
            return b""
        if not (self.at <= offset and offset + n <= self.at + len(self.data)):
            self.at, self.data = offset, self.file.read_at(min(max(n, PIECE), self.size - offset), offset)
        return self.data[offset - self.at : offset - self.at + n]

    def close(self) -> None:
        self.file.close()


_FIRST = re.compile(rb"WARC/1\.[0-9]+\Z")


def _head(read, at: int) -> tuple[dict[str, str], int] | None:
    """(fields, length of the head with its empty line) of the plain record at `at`, or None if
    none starts there. Reading stops at the first line that no head can hold."""
    fields: dict[str, str] = {}
    line, size, data = 0, 4096, read(at, 4096)
    while True:
        end = data.find(b"\r\n", line)
        if end < 0:
            if len(data) < size or line == 0 and len(data) > 64:
                return None
            size *= 4
            data = read(at, size)
            continue
        text = data[line:end]
        if line == 0:
            if not _FIRST.match(text):
                return None
        elif not text:
            return (fields, end + 2) if fields.get("content-length", "").isdigit() else None
        else:
            name, colon, value = text.partition(b":")
            if not colon:
                return None
            fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
        line = end + 2


def _successor(source: _Source, at: int, gzip: bool) -> int | None:
    """Where the record that seems to start at `at` ends, or None if none starts there."""
    if not gzip:
        head = _head(source.read, at)
        return at + head[1] + int(head[0]["content-length"]) + 4 if head else None
    member, place, begin = zlib.decompressobj(31), at, b""
    try:
        while not member.eof:
            piece = source.read(place, PIECE)
            if not piece:
                return None
            place += len(piece)
            text = member.decompress(piece)
            if len(begin) < len(PLAIN):
                begin += text[: len(PLAIN)]
                if not begin.startswith(PLAIN[: len(begin)]):
                    return None
    except zlib.error:
        return None
    return place - len(member.unused_data) if begin.startswith(PLAIN) else None


def candidates(source: _Source, lo: int, hi: int, gzip: bool) -> tuple[np.ndarray, np.ndarray]:
    """Offsets in lo..hi-1 that look like records, and their successors."""
    magic = GZIP if gzip else PLAIN
    found, ends = [], []
    for at in range(lo, hi, RANGE_BYTES):
        data = source.read(at, min(RANGE_BYTES, hi - at) + len(magic) - 1)
        place = data.find(magic)
        while 0 <= place and at + place < hi:
            end = _successor(source, at + place, gzip)
            if end is not None:
                found.append(at + place)
                ends.append(end)
            place = data.find(magic, place + 1)
    return np.array(found, np.int64), np.array(ends, np.int64)


def reachable(offsets: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """Which records (offsets ascending) are on the chain from offset 0, by pointer jumping."""
    n = len(offsets)
    reach = np.zeros(n + 1, bool)
    if not n or offsets[0] != 0:
        return reach[:n]
    to = np.searchsorted(offsets, successors)
    to = np.where((to < n) & (offsets[np.minimum(to, n - 1)] == successors), to, n)
    jump = np.append(to, n)
    reach[0] = True
    for _ in range(max(1, n).bit_length() + 1):
        reach[jump[reach]] = True
        jump = jump[jump]
    return reach[:n]


def _ranges(archives: list[Archive], range_bytes: int) -> int:
    """Tasks for all ranges of all archives."""
    return min(1 << 16, max(1, sum(-(-a.size // range_bytes) for a in archives)))


def boundaries(spark: SparkSession, archives: list[Archive], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(uri, lo, hi, first, records): per range the first verified record and their number."""
    files = spark.createDataFrame([(a.uri, a.size, a.records) for a in archives], "uri string, size long, told long")
    ranges = files.select("uri", "size", "told", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("lo"))
    ranges = ranges.withColumn("hi", F.least("size", F.col("lo") + range_bytes)).repartition(_ranges(archives, range_bytes), "uri", "lo")

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            for uri, told, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("uri", "told", "lo", "hi"))):
                source = _Source(uri)
                offsets, ends = candidates(source, lo, hi, uri.endswith(".gz"))
                ends = np.where(ends > source.size, -1, ends)
                source.close()
                row = {"uri": uri, "told": told, "lo": lo, "hi": hi, "offsets": offsets.tobytes(), "successors": ends.tobytes()}
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row.values(), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], list(row))

    def chain(table):
        import pyarrow as pa

        table = table.sort_by("lo")
        parts = [np.frombuffer(x, np.int64) for x in table.column("offsets").to_pylist()]
        ends = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("successors").to_pylist()])
        good = reachable(np.concatenate(parts), ends) & (ends >= 0)
        told = table.column("told")[0].as_py()
        if told is not None and good.sum() != told:
            raise ValueError(f"{table.column('uri')[0]}: {good.sum()} records on the chain from the file's start, {told} were written")
        rows, at = [], 0
        for uri, lo, hi, part in zip(*(table.column(c).to_pylist() for c in ("uri", "lo", "hi")), parts):
            own = part[good[at : at + len(part)]]
            at += len(part)
            if len(own):
                rows.append({"uri": uri, "lo": lo, "hi": hi, "first": int(own[0]), "records": len(own)})
        schema = pa.schema([("uri", pa.string()), ("lo", pa.int64()), ("hi", pa.int64()), ("first", pa.int64()), ("records", pa.int64())])
        return pa.Table.from_pylist(rows, schema)

    scanned = ranges.select("uri", "told", "lo", "hi").mapInArrow(common.releasing(scan), "uri string, told long, lo long, hi long, offsets binary, successors binary")
    return scanned.groupBy("uri").applyInArrow(chain, "uri string, lo long, hi long, first long, records long")


def _records(source: _Source, first: int, count: int, gzip: bool):
    """(offset, fields, block) of `count` records from `first` on."""
    at = first
    for _ in range(count):
        if gzip:
            member, data, place = zlib.decompressobj(31), [], at
            while not member.eof:
                piece = source.read(place, PIECE)
                if not piece:
                    raise ValueError("a verified record ends early")
                place += len(piece)
                data.append(member.decompress(piece))
            end, whole = place - len(member.unused_data), b"".join(data)
            fields, head = _head(lambda o, n: whole[o : o + n], 0)
            yield at, fields, whole[head : head + int(fields["content-length"])]
        else:
            fields, head = _head(source.read, at)
            size = int(fields["content-length"])
            end = at + head + size + 4
            yield at, fields, source.read(at + head, size)
        at = end


def read(spark: SparkSession, archives: list[Archive], kind: str = "bigint", payloads: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(id, uri, offset, record_type, url, payload_bytes, payload_digest, refers_to[, payload]) of every
    verified record. The digest of a response is taken of the payload that was read, and must be
    the one in its head; the length is the HTTP head's."""
    schema = f"id {kind}, uri string, offset long, record_type string, url string, payload_bytes long, payload_digest string, refers_to {kind}" + ", payload binary" * payloads
    if not archives:
        return spark.createDataFrame([], schema)

    def named(urn: str | None):
        text = unquote((urn or "")[10:-1])
        return None if not text else int(text) if kind != "string" else text

    def run(batches):
        import pyarrow as pa

        own = common.arrow_type(kind)
        columns = [("id", own), ("uri", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", own)]
        arrow = pa.schema(columns + [("payload", pa.binary())] * payloads)
        for batch in batches:
            for uri, first, count in zip(*(batch.column(c).to_pylist() for c in ("uri", "first", "records"))):
                source, rows, held = _Source(uri), [], 0
                for offset, fields, block in _records(source, first, count, uri.endswith(".gz")):
                    http, _, body = block.partition(b"\r\n\r\n")
                    size = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(body))
                    told = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
                    if fields["warc-type"] == "response" and (hashlib.sha1(body).hexdigest() != told or len(body) != size):
                        raise ValueError(f"{uri} at {offset}: the payload is not the one in the head")
                    row = {"id": named(fields["warc-record-id"]), "uri": uri, "offset": offset, "record_type": fields["warc-type"], "url": fields.get("warc-target-uri", ""), "payload_bytes": size, "payload_digest": told, "refers_to": named(fields.get("warc-refers-to"))}
                    if payloads:
                        row["payload"] = body if fields["warc-type"] == "response" else None
                        held += len(body)
                    rows.append(row)
                    if len(rows) >= 5000 or held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, held = [], 0
                source.close()
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    # one task a range again: what the chain keeps is small and would be read by a single one
    kept = boundaries(spark, archives, range_bytes).repartition(_ranges(archives, range_bytes), "uri", "lo")
    return kept.mapInArrow(common.releasing(run), schema)
