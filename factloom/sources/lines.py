"""JSON lines as a source of its own, by byte ranges.

    spark.dataSource.register(JsonLines)
    spark.read.format("json_ranges").schema("doc_id long, text string, _bad string").option("path", ...).load()

A file is dealt out in ranges; a line belongs to the range in which it begins, so files of any
length are read by many tasks and each line once. Only the columns of the schema are taken out of
a line; absent ones are null. A line that is no JSON object, or has a value of another kind, is a
row whose columns are null and whose `_bad` is the line, if the schema has such a column; else it is
dropped. `_place` (string), if the schema has it, is file and offset, which orders lines as they
stand. Empty lines are no rows. Files are read through Arrow's file systems.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BAD, PLACE = "_bad", "_place"
_KINDS = {T.StringType: str, T.LongType: int, T.IntegerType: int, T.DoubleType: (int, float), T.BooleanType: bool}


def _opened(uri: str):
    from pyarrow import fs

    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri.removeprefix("file:")


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class JsonLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_ranges"

    def schema(self):
        raise ValueError("json_ranges needs a schema")

    def reader(self, schema):
        return _Reader(schema, self.options["path"], int(self.options.get("rangebytes", self.options.get("rangeBytes", 64 << 20))))


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, path: str, size: int):
        odd = [f.name for f in schema if type(f.dataType) not in _KINDS]
        if odd:
            raise ValueError(f"columns of these kinds are not read: {odd}")
        self.fields = [(f.name, _KINDS[type(f.dataType)], isinstance(f.dataType, T.DoubleType)) for f in schema]
        self.path, self.size = path, max(1, size)

    def partitions(self):
        from pyarrow import fs

        system, root = _opened(self.path)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
        out = [Range(p, at, min(n, at + self.size)) for p, n in files for at in range(0, n, self.size)]
        return out or [Range("", 0, 0)]

    def read(self, part):
        if part.end <= part.start:
            return
        system, _ = _opened(self.path)
        with system.open_input_file(part.path) as f:
            at, rest = part.start, b""
            if at:  # the line that is open where the range begins is another range's
                f.seek(at - 1)
                skipped = 0
                while True:
                    chunk = f.read(1 << 16)
                    cut = chunk.find(b"\n")
                    if cut >= 0 or not chunk:
                        break
                    skipped += len(chunk)
                at = at - 1 + skipped + cut + 1 if cut >= 0 else part.end
                f.seek(at)
            while at < part.end:
                chunk = f.read(1 << 20)
                *lines, rest = (rest + chunk).split(b"\n")
                for line in lines if chunk else [rest]:
                    if at >= part.end:
                        return
                    if line.strip():
                        row = self._row(line, part.path, at)
                        if row is not None:
                            yield row
                    at += len(line) + 1
                if not chunk:
                    return

    def _row(self, line: bytes, path: str, at: int):
        place = f"{path}:{at:020d}"
        try:
            value = json.loads(line)
            if isinstance(value, dict):
                out = []
                for name, kind, wide in self.fields:
                    x = None if name == BAD else place if name == PLACE else value.get(name)
                    if x is not None and (not isinstance(x, kind) or isinstance(x, bool) and kind is not bool):
                        raise ValueError(name)
                    out.append(float(x) if wide and x is not None else x)
                return tuple(out)
        except ValueError:
            pass
        if not any(name == BAD for name, *_ in self.fields):
            return None
        return tuple(line.decode("utf-8", "replace") if name == BAD else place if name == PLACE else None for name, *_ in self.fields)


def json_ranges(spark: SparkSession, path: str, schema: str, key: str | None = None, range_bytes: int = 64 << 20) -> DataFrame:
    """The lines of a file or folder; of lines with one key the last counts, in order of files and
    places."""
    spark.dataSource.register(JsonLines)
    wanted = f"{schema}, {PLACE} string" if key else schema
    rows = spark.read.format("json_ranges").schema(wanted).option("path", path).option("rangeBytes", str(range_bytes)).load()
    if key is None:
        return rows
    good = rows.filter(F.col(key).isNotNull())
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.col(PLACE).desc()))
    return good.withColumn("_last", last).filter("_last = 1").drop("_last", PLACE)
