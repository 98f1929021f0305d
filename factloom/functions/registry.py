"""Functions for SQL (the pluggable seam of section 2.14)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from factloom.functions import gazetteer, grammar, text


@F.udtf(returnType="owner string, segment long, n long, first long")
class Segments:
    """E13, W10 as a table function: segments(TABLE(rows) PARTITION BY owner ORDER BY place), rows of
    (owner, place, item, starts). A row that starts a segment opens the next one; rows before the
    first are segment 0. One row a segment: how many rows it has and its first item. Rows pass one
    by one; only the open segment is held."""

    def __init__(self):
        self.owner, self.segment, self.n, self.first = None, 0, 0, None

    def eval(self, row):
        if row["starts"]:
            if self.n:
                yield self._told()
            self.segment, self.n, self.first = self.segment + 1, 0, None
        self.owner = row["owner"]
        self.n += 1
        self.first = row["item"] if self.first is None or row["item"] is not None and row["item"] < self.first else self.first

    def terminate(self):
        if self.n:
            yield self._told()

    def _told(self):
        return self.owner, self.segment, self.n, self.first


def register_table_functions(spark: SparkSession) -> list[str]:
    """Makes the table functions callable from SQL; returns their names."""
    spark.udtf.register("segments", Segments)
    return ["segments"]


def register_udfs(spark: SparkSession, entries: list[gazetteer.Entry] | None = None) -> list[str]:
    """Makes the text functions that have no JVM form callable from SQL; returns their names."""
    found = {"nfc": text.nfc(), "parse_values": grammar.values_udf()}
    if entries:
        found["match_entities"] = gazetteer.mentions_udf(entries)
    for name, function in found.items():
        spark.udf.register(name, function)
    return sorted(found)
