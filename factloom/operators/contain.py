"""Which texts contain which (J26, F04, F31): n-grams as a seed, then an exact test.

A needle can only stand in texts that hold each of its trigrams; it looks at those of its rarest
one. Shorter needles go by their own length. The plan joins on grams, never all with all.

Nulls contain nothing and stand nowhere. The empty needle stands in every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 3


def _grams(text: Column, size: int) -> Column:
    if size == 0:
        return F.array(F.lit(""))
    places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(size))))


def containing(texts: DataFrame, needles: DataFrame, text_col: str = "text", needle_col: str = "needle") -> DataFrame:
    """(needle, text): each different needle with the different texts that contain it."""
    hay = texts.select(F.col(text_col).alias("text")).filter("text is not null").distinct()
    own = needles.select(F.col(needle_col).alias("needle")).filter("needle is not null").distinct()
    sized = own.withColumn("size", F.least(F.length("needle"), F.lit(SIZE)))
    sizes = [r.size for r in sized.select("size").distinct().collect()]  # four at most
    found = None
    for size in sorted(sizes):
        postings = hay.select(F.explode(_grams(F.col("text"), size)).alias("gram"), "text")
        often = postings.groupBy("gram").agg(F.count("*").alias("n"))
        seeds = sized.filter(F.col("size") == size).select("needle", F.explode(_grams(F.col("needle"), size)).alias("gram"))
        rarest = seeds.join(often, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("seed"))
        rarest = rarest.filter(F.col("seed.n") > 0).select("needle", F.col("seed.gram").alias("gram"))
        pairs = rarest.join(postings, "gram").filter(F.contains("text", "needle")).select("needle", "text")
        found = pairs if found is None else found.unionByName(pairs)
    return found if found is not None else own.select("needle", F.col("needle").alias("text")).limit(0)
