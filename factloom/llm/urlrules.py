"""URL filters as sort-merge range joins. DataFrame functions only.

A host is keyed by its labels in reverse, each followed by a dot: `a.example.net` becomes
`net.example.a.`. A rule for a host and its subdomains is then the interval of keys that start
with the rule's key, from `net.example.` up to `net.example/` (the character after the dot).
Intervals nest or are apart, so a sweep over sorted keys keeps a stack: every boundary of an
interval carries the hosts with rules that hold from there on (as many as the host has labels,
at most), and a url takes the last boundary before it.

A second sweep does the same below each host of that stack, over its key followed by the url's
path in UTF-8: a rule's path is the interval of paths that start with it, and every boundary
carries the innermost rule that holds from there on, which is the longest of its host. So a host
may have any number of rules. Of the rules of a url's hosts the longest (host and path together,
then host, then text) is the rule.

A sweep is cut into ranges: split points are taken from a bounded sample of the urls (those
with the smallest hashes), ranges are swept apart, and a range begins with what the boundaries
before it leave. A url's place is its key and a hash of its id, so that a host with a third of
all rows is spread over many ranges; rows with equal id, host and path are swept as one.

Nulls, empties, ties: a null url, or one without `://`, has an empty host and path. Of equal
rules with both verdicts `block` wins. Rules with a null host are ignored; a null path is `/`.
Without a rule the verdict is the default. Repeated rows are returned as often as they occur;
null ids are kept; an empty table gives an empty result. Urls may be of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import common

#: Rows of a range of a sweep, about; ranges at most, and sampled places for each.
RANGE_ROWS, RANGES, PER_RANGE = 200_000, 2048, 32


def host_of(url: Column) -> Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case."""
    rest = F.substring_index(_rest(url), "/", 1)
    host = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return _lowered(host)


def _lowered(host: Column) -> Column:
    """A-Z only, in hosts of urls and of rules alike."""
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    rest = _rest(url)
    cut = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return F.regexp_extract(cut, r"(?s)^[^/]*(.*)$", 1)


def _rest(url: Column) -> Column:
    """The url after its first `://`; empty if there is none or it is null."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)), F.lit(""))


def key_of(host: Column) -> Column:
    """Labels in reverse, each followed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def parsed(rules: DataFrame) -> DataFrame:
    """(key, host, path, rule, action) of distinct rules (host, path, action)."""
    whole = rules.filter(F.col("host").isNotNull()).select(_lowered(F.col("host")).alias("host"), F.coalesce("path", F.lit("/")).alias("path"), "action")
    one = whole.groupBy("host", "path").agg(F.min_by("action", F.when(F.col("action") == "block", 0).otherwise(1)).alias("action"))
    return one.select(key_of(F.col("host")).alias("key"), "host", "path", F.concat("host", "path").alias("rule"), "action")


def host_boundaries(rules: DataFrame) -> DataFrame:
    """(key, held): from this key on (to the next) exactly these hosts with rules hold for a host."""
    hosts = rules.select("key").distinct()
    # The hosts above a host: every prefix of its key that ends with a dot and is a rule's key.
    dots = F.filter(F.sequence(F.lit(1), F.length("key")), lambda i: F.substring(F.col("key"), i, F.lit(1)) == ".")
    above = hosts.select(F.col("key").alias("below"), F.explode(F.transform(dots, lambda i: F.substring(F.col("key"), F.lit(1), i))).alias("key"))
    held = above.join(hosts, "key").groupBy("below").agg(F.sort_array(F.collect_list("key")).alias("held"))
    opened = held.select(F.col("below").alias("key"), "held")
    closing = held.select(F.concat(F.expr("substring(below, 1, length(below) - 1)"), F.lit("/")).alias("key"), F.slice("held", F.lit(1), F.size("held") - 1).alias("held"))
    return opened.unionByName(closing).select(F.col("key").cast("binary").alias("key"), "held")


def _path_key(host_key: Column, path: Column) -> Column:
    """Host and path as bytes: the key of a host, zero, the path."""
    return F.concat(host_key.cast("binary"), F.lit(b"\0"), path.cast("binary"))


def path_boundaries(rules: DataFrame) -> DataFrame:
    """(key, held): from this host and path on (to the next) this rule is the innermost, or none is."""
    rule = F.struct(F.length("rule").alias("size"), F.length("host").alias("host_size"), "rule", "action")
    own = rules.select("key", "path", rule.alias("held"))
    shorter = own.select("key", "path", F.explode(F.transform(F.sequence(F.lit(0), F.length("path") - 1), lambda i: F.substring(F.col("path"), F.lit(1), i))).alias("start")).filter("path <> ''")
    outer = shorter.join(own.select("key", F.col("path").alias("start"), F.col("held").alias("outer")), ["key", "start"]).groupBy("key", "path").agg(F.max("outer").alias("outer"))
    both = own.join(outer, ["key", "path"], "left")
    opened = both.select(_path_key(F.col("key"), F.col("path")).alias("key"), "held")
    # no byte of UTF-8 is 0xFF, so this is behind all paths that start so, and before all others
    closing = both.select(F.concat(_path_key(F.col("key"), F.col("path")), F.lit(b"\xff")).alias("key"), F.col("outer").alias("held"))
    return opened.unionByName(closing)


def _split_points(places: DataFrame) -> list[tuple[bytes, int]]:
    """Places that cut the rows into ranges of about equal size, from a bounded sample. Long keys are
    cut short: a point need not be a place."""
    chance = F.xxhash64("salt", F.lit("sample"))  # not the salt itself, which is part of a place
    n = places.count()
    most = min(RANGES, n // RANGE_ROWS) * PER_RANGE
    if not most:
        return []
    # A cut at about twice the sample first, so that no task sends more than its share to the driver.
    cut = min((1 << 63) - 1, -(1 << 63) + int((1 << 64) * min(1.0, 2 * most / max(1, n))))
    near = places.select(F.substring("key", 1, 256).alias("key"), "salt", chance.alias("chance")).filter(F.col("chance") <= F.lit(cut).cast("long"))
    sample = sorted((bytes(r.key), r.salt) for r in near.orderBy("chance", "key", "salt").limit(most).collect())
    return [sample[i] for i in range(PER_RANGE, len(sample), PER_RANGE)]


def _range_of(key: Column, salt: Column, points: list[tuple[bytes, int]]) -> Column:
    """How many split points are at or before a place, in two steps of about the root of their number."""
    if not points:
        return F.lit(0)
    place = F.struct(key.alias("key"), salt.alias("salt"))
    literal = lambda p: F.struct(F.lit(p[0]).alias("key"), F.lit(p[1]).cast("long").alias("salt"))
    step = int(len(points) ** 0.5) + 1
    groups = [points[i : i + step] for i in range(0, len(points), step)]
    coarse = F.array(*[literal(g[0]) for g in groups])
    fine = F.array(*[F.array(*[literal(p) for p in g]) for g in groups])
    before = F.size(F.filter(coarse, lambda p: p <= place))
    inside = F.size(F.filter(F.element_at(fine, F.greatest(before, F.lit(1))), lambda p: p <= place))
    return F.when(before == 0, 0).otherwise((before - 1) * step + inside)


def _swept(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(row, held): each row (key, salt, row) with what the last boundary (key, held) at or before its
    key carries; null before the first, and where a boundary carries null."""
    spark = rows.sparkSession
    points = _split_points(rows)
    lowest = F.lit(-(1 << 63)).cast("long")
    # a struct around it, so that a boundary that carries null ends the one before
    turns = edges.select("key", lowest.alias("salt"), F.struct("held").alias("turn"))
    turns = turns.withColumn("range", _range_of(F.col("key"), F.col("salt"), points))
    # What the boundaries before a range leave: one row a range, so the window over them is small.
    last = turns.groupBy("range").agg(F.max_by("turn", "key").alias("turn"))
    ranges = spark.range(len(points) + 1).select(F.col("id").cast("int").alias("range"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.join(last, "range", "left").select("range", F.last("turn", ignorenulls=True).over(before).alias("turn"))
    none = F.lit(None).cast(rows.schema["row"].dataType).alias("row")
    begins = carried.select("range", F.lit(b"").alias("key"), lowest.alias("salt"), F.lit(0).alias("kind"), "turn", none)
    turns = turns.select("range", "key", "salt", F.lit(1).alias("kind"), "turn", none)
    own = rows.select(_range_of(F.col("key"), F.col("salt"), points).alias("range"), "key", "salt", F.lit(2).alias("kind"), F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"), "row")
    sweep = Window.partitionBy("range").orderBy("key", "kind", "salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = begins.unionByName(turns).unionByName(own).withColumn("turn", F.last("turn", ignorenulls=True).over(sweep))
    return out.filter("kind = 2").select("row", F.col("turn.held").alias("held"))


def judged(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) per row."""
    urls = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    one = urls.groupBy("id", "host", "path").agg(F.count("*").alias("n"))
    salt = F.xxhash64("id", "path")
    known = parsed(rules)
    places = one.select(key_of(F.col("host")).cast("binary").alias("key"), salt.alias("salt"), F.struct("id", "host", "path", "n").alias("row"))
    hosts = common.materialise(_swept(places, host_boundaries(known)).select("row.*", F.coalesce("held", F.array().cast("array<string>")).alias("held")), "urlrules")
    below = hosts.filter(F.size("held") > 0).select("id", "host", "path", "n", F.explode("held").alias("host_key"))
    places = below.select(_path_key(F.col("host_key"), F.col("path")).alias("key"), salt.alias("salt"), F.struct("id", "host", "path", "n").alias("row"))
    best = _swept(places, path_boundaries(known)).groupBy("row").agg(F.max("held").alias("best")).select("row.*", "best.rule", "best.action")
    none = F.lit(None).cast("string")
    rest = hosts.filter(F.size("held") == 0).select("id", "host", "path", "n", none.alias("rule"), none.alias("action"))
    every = best.unionByName(rest).withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return every.select("id", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))
