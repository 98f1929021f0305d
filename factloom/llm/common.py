"""Shared parts: byte-level word scanning in numpy, and files in the cluster's shared folder.

Words here are maximal runs of bytes other than ASCII white space (0x20, 0x09-0x0D)
in UTF-8. `bytes.split()` cuts at exactly these six bytes, so the Python and the
numpy paths agree.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from factloom import session

_MASK = (1 << 64) - 1


def mixed(n: int, seed: int) -> np.ndarray:
    """n well-spread 64-bit numbers: the splitmix64 sequence from `seed`."""
    with np.errstate(over="ignore"):
        z = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        return mix64(z)


def mix64(z: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit numbers."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Two independent families of hashes; the first is used where one is enough.
_BYTE_CODE = (mixed(256, 7), mixed(256, 8))
_BASE = 0x9E3779B97F4A7C55  # odd, so that it has an inverse modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)
_pow_cache: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _pow_cache.get((base, 0))
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length() if n else 1)
        steps = np.full(size, base & _MASK, dtype=np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(steps)
        _pow_cache[(base, 0)] = have
    return have[:n]


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words in an array of UTF-8 bytes."""
    if len(raw) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.empty(len(raw) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(SPACE[raw], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """A 64-bit hash of every word: polynomial over random byte codes, then mixed."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        n = len(raw)
        total = np.empty(n + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(_BYTE_CODE[family][raw] * powers(_BASE, n), out=total[1:])
        return mix64((total[ends] - total[starts]) * powers(_BASE_INV, n)[starts])


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words[i:i+k] for each i in 0..n-k, from word hashes."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.empty(n + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(words * powers(_BASE, n), out=total[1:])
        return mix64((total[k:] - total[: n - k + 1]) * powers(_BASE_INV, n)[: n - k + 1])


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, a newline after each, and where each starts (one more at the end)."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8) if texts else np.zeros(0, np.uint8)
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
    return raw, bounds


def slices(texts: list[bytes], most: int):
    """Ranges of `texts` whose bytes sum to about `most`; one longer text is a range alone."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        if i > at and size + len(text) > most:
            yield at, i
            at, size = i, 0
        size += len(text)
    if at < len(texts):
        yield at, len(texts)


def utf8(column) -> list[bytes]:
    """An Arrow string column as UTF-8, null as the empty text."""
    import pyarrow as pa

    return [x if x is not None else b"" for x in column.cast(pa.large_binary()).to_pylist()]


def arrow_type(kind: str):
    """The Arrow type of a column of ids: whole numbers or strings."""
    import pyarrow as pa

    known = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}
    if kind not in known:
        raise TypeError(f"ids must be whole numbers or strings, not {kind}")
    return known[kind]


def release_memory() -> None:
    """Give back to the system what a finished task no longer needs: workers are kept and reused,
    and the allocators of Arrow and of C would hold their largest task's memory."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def releasing(run):
    """Wraps a function of Arrow batches: memory is released when its task ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


# --- files in the shared folder -------------------------------------------------


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run, below the shared one."""
    return f"{session.shared_root(spark)}/factloom/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, codec: str = "zstd", folder: str | None = None) -> DataFrame:
    """Write `df` to the shared folder (below the run's `folder`, if one is given) and read it back:
    the lineage ends there."""
    spark = df.sparkSession
    path = f"{folder}/{name}" if folder else f"{run_folder(spark, name)}/table"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remove_runs(spark: SparkSession) -> None:
    """Delete what all earlier runs of these operators left in the shared folder."""
    remove(spark, f"{session.shared_root(spark)}/factloom")


def filesystem(uri: str):
    """(file system, path) of a URI, on the driver or an executor."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class AtomicFile:
    """A file that appears under its name only when it is whole: task retries replace it."""

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.part)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)

    def abandon(self) -> None:
        self.out.close()
        self.fs.delete_file(self.part)
