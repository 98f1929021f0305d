"""Graph operators on edge tables.

Edges have (src, dst, type) or more columns; a node is its key. Expansions are unrolled joins
on a frontier that is made distinct after each hop, so rows grow with nodes, not with paths.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def undirected(edges: DataFrame) -> DataFrame:
    """Every edge from both ends."""
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def nodes_of(nodes: DataFrame, label: str | None = None, key: str | None = None, **properties) -> DataFrame:
    """Nodes (label, key, ...) by label, key and equal properties. Plain equalities, so that a
    table partitioned by label and sorted by key is read at their places only."""
    rows = nodes if label is None else nodes.filter(F.col("label") == label)
    rows = rows if key is None else rows.filter(F.col("key") == key)
    for name, value in properties.items():
        rows = rows.filter(F.col(name).isNull() if value is None else F.col(name) == value)
    return rows


def optional(rows: DataFrame, edges: DataFrame, kind: str, at: str, name: str) -> DataFrame:
    """Each row with the other end of its edges of a type, and once with null if it has none."""
    own = edges.filter(F.col("type") == kind).select(F.col("src").alias("_src"), F.col("dst").alias(name)).distinct()
    return rows.join(own, F.col(at) == F.col("_src"), "left").drop("_src")


def upserted_nodes(before: DataFrame, new: DataFrame, on_create: tuple[str, ...] = (), order: str = "at") -> DataFrame:
    """Nodes (label, key, properties) merged: one row a (label, key), new properties over old ones
    unless they are null; those in `on_create` are kept once they are set. Of several new rows of a
    node the last by `order` counts, property by property."""
    properties = [c for c in new.columns if c not in ("label", "key", order)]
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("_new", order)))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("_new", order)))
    rows = before.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return rows.groupBy("label", "key").agg(*[(first if c in on_create else last)(c).alias(c) for c in properties], F.max(order).alias(order))


def with_labels(nodes: DataFrame) -> DataFrame:
    """One row a key, with all labels that it bears."""
    return nodes.groupBy("key").agg(F.sort_array(F.collect_set("label")).alias("labels"))


def neighborhood(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, hop) within `depth` hops of the start nodes (column node), the least hop."""
    if not 1 <= depth <= 3:
        raise ValueError("depth must be 1, 2 or 3")
    both = undirected(edges)
    frontier = start.select("node").distinct().withColumn("hop", F.lit(0))
    found = frontier
    for hop in range(1, depth + 1):
        step = frontier.join(both, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().withColumn("hop", F.lit(hop))
        frontier = step.join(found.select("node"), "node", "left_anti")
        found = found.unionByName(frontier)
    return found


def induced(edges: DataFrame, nodes: DataFrame, limit: int = 400) -> DataFrame:
    """Edges with both ends among the nodes, parallel ones collapsed, none from a node to itself."""
    keys = nodes.select("node").distinct()
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    inside = edges.join(keys, F.col("src") == F.col("node"), "left_semi").join(keys, F.col("dst") == F.col("node"), "left_semi")
    one = inside.filter("src <> dst").select(a.alias("a"), b.alias("b"), "type").distinct()
    return one.orderBy("a", "b", "type").limit(limit)


def document_counts(edges: DataFrame, documents: DataFrame) -> DataFrame:
    """Per node the distinct documents (column doc_id) within one or two undirected hops."""
    both = undirected(edges)
    docs = documents.select(F.col("doc_id").alias("node"))
    one = both.join(docs, F.col("dst") == F.col("node"), "left_semi").select("src", F.col("dst").alias("doc"))
    two = both.join(one.withColumnRenamed("src", "mid"), F.col("dst") == F.col("mid")).select("src", "doc")
    near = one.union(two).filter("src <> doc").distinct()
    return near.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("source_count"))


def document_count_changes(before: DataFrame, added: DataFrame, documents: DataFrame) -> DataFrame:
    """(node, source_count): by how much `document_counts` grows when edges are added. Only paths
    over an added edge are walked, and only what they reach is looked up in the edges before.
    Documents are nodes from their first edge on."""
    docs = documents.select(F.col("doc_id").alias("node")).distinct()
    old, new = undirected(before), undirected(added)
    every = old.select("src", "dst").union(new.select("src", "dst")).distinct()
    ends = lambda rows: rows.join(docs, F.col("dst") == F.col("node"), "left_semi")
    step = lambda first, then: first.select("src", F.col("dst").alias("mid")).join(then.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")
    fresh = new.select("src", "dst").distinct()
    near = fresh.select(F.col("dst").alias("src")).distinct()  # ends of added edges
    beyond = ends(every.join(near, "src", "left_semi"))
    until = every.join(near.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst")
    reached = ends(fresh).union(step(fresh, beyond)).union(step(until, ends(fresh))).filter("src <> dst").distinct()
    # which of these pairs had a path already
    from_here = old.join(reached.select("src").distinct(), "src", "left_semi").select("src", "dst")
    to_there = old.join(reached.select("dst").distinct(), "dst", "left_semi").select("src", "dst")
    known = from_here.union(step(from_here, to_there)).distinct()
    return reached.join(known, ["src", "dst"], "left_anti").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("source_count"))


def counts_changed(counts: DataFrame, changes: DataFrame) -> DataFrame:
    """Maintained counts, from the counts before and their changes."""
    return counts.select("node", "source_count").unionByName(changes).groupBy("node").agg(F.sum("source_count").alias("source_count"))


def adjacent(edges: DataFrame, start: DataFrame, wanted: Column, limit: int) -> DataFrame:
    """Neighbours of the start nodes that satisfy `wanted` on column node, without those."""
    near = undirected(edges).join(start.select(F.col("node").alias("_s")), F.col("src") == F.col("_s"), "left_semi").select(F.col("dst").alias("node")).distinct()
    return near.filter(wanted).join(start.select("node"), "node", "left_anti").orderBy("node").limit(limit)


def answer_subgraph(branches: dict[str, tuple[DataFrame, int]], documents: DataFrame, most_documents: int = 40) -> DataFrame:
    """For the first documents, per branch (doc_id, key) at most so many keys a
    document, each branch ranked before any join; the result is one list of edges."""
    ids = documents.select("doc_id").distinct().orderBy("doc_id").limit(most_documents)
    parts = []
    for name, (rows, most) in branches.items():
        own = rows.join(ids, "doc_id", "left_semi").select("doc_id", "key").distinct()
        nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("key"))
        parts.append(own.withColumn("nth", nth).filter(F.col("nth") <= most).select("doc_id", F.lit(name).alias("type"), F.col("key").cast("string").alias("key")))
    return reduce(DataFrame.unionByName, parts)


#: Branches of the process chain: type of edge, labels of its other end, how many of a process.
CHAIN = (("USES_MATERIAL", ("Material",), 6), ("PRODUCES_OUTPUT", ("Material", "Phase"), 6), ("OPERATES_AT_CONDITION", ("Condition",), 4), ("OPERATES_AT_CONDITION", ("Equipment",), 4))


def answer_graph(doc_ids: DataFrame, facts: DataFrame, edges: DataFrame, mentions: DataFrame, relations: DataFrame, authors: DataFrame, limit: int = 60, most_documents: int = 40) -> DataFrame:
    """The links (src, dst, type) around the documents of an answer, and links without dst for nodes
    alone: their processes (at most `limit`) with materials, outputs, conditions and equipment;
    equipment (15), facilities (15), contradictions between them (30) and authors (25).

    facts: doc_id, label, canon. edges: src, dst, dst_label, type. mentions: doc_id, label, canon.
    relations: rel, doc_a, doc_b. Each list is ranked by itself before anything is joined to it, so no
    branch multiplies another."""
    ids = doc_ids.select("doc_id").distinct().orderBy("doc_id").limit(most_documents)
    measured = facts.join(F.broadcast(ids), "doc_id", "left_semi")
    link = lambda rows, src, dst, kind: rows.select(F.col(src).cast("string").alias("src"), (F.lit(None) if dst is None else F.col(dst)).cast("string").alias("dst"), F.lit(kind).alias("type"))
    processes = measured.filter("label = 'Process'").select(F.col("canon").alias("src")).distinct().orderBy("src").limit(limit)
    parts = [link(processes, "src", None, "Process")]
    for kind, labels, most in CHAIN:
        own = edges.filter((F.col("type") == kind) & F.col("dst_label").isin(*labels)).join(F.broadcast(processes), "src", "left_semi").select("src", "dst").distinct()
        nth = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
        parts.append(link(own.withColumn("nth", nth).filter(F.col("nth") <= most), "src", "dst", kind))
    equipment = measured.filter("label = 'Equipment'").select("canon").distinct().orderBy("canon").limit(15)
    parts.append(link(equipment, "canon", None, "Equipment"))
    places = mentions.filter("label = 'Facility'").join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "canon").distinct().orderBy("doc_id", "canon").limit(15)
    parts.append(link(places, "doc_id", "canon", "MENTIONS"))
    against = relations.filter("rel = 'CONTRADICTS'").select(F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b")).filter("a < b").distinct()
    inside = against.join(F.broadcast(ids.select(F.col("doc_id").alias("a"))), "a", "left_semi").join(F.broadcast(ids.select(F.col("doc_id").alias("b"))), "b", "left_semi")
    parts.append(link(inside.orderBy("a", "b").limit(30), "a", "b", "CONTRADICTS"))
    own = authors.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "author").distinct().orderBy("doc_id", "author").limit(25)
    parts.append(link(own, "doc_id", "author", "AUTHORED_BY"))
    return reduce(DataFrame.unionByName, parts).distinct()


def merged_edges(edges: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """One edge per (src, dst, type, doc_id), its sources put together."""
    rows = edges.select("src", "dst", "type", "doc_id", F.array("source").alias("sources"))
    if before is not None:
        rows = rows.unionByName(before.select("src", "dst", "type", "doc_id", "sources"))
    return rows.groupBy("src", "dst", "type", "doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))


def experiments(facts: DataFrame) -> DataFrame:
    """Facts of one document under equal conditions are one experiment."""
    rows = facts.filter(F.coalesce("conditions", F.lit("")) != "")
    return rows.groupBy("doc_id", "conditions").agg(F.concat(F.col("doc_id").cast("string"), F.lit("::"), "conditions").alias("exp_id"), F.count("*").alias("facts"))


def shown_claims(experiments_: DataFrame, claims: DataFrame) -> DataFrame:
    """The claims of a document belong to each of its experiments."""
    return experiments_.select("exp_id", "doc_id").join(claims.select("doc_id", "claim").distinct(), "doc_id").select("exp_id", "claim")


def chained(facts: DataFrame) -> DataFrame:
    """Nodes and links that a list of facts shows when there is no graph."""
    link = lambda a, ta, b, tb: F.struct(a.cast("string").alias("src"), F.lit(ta).alias("src_label"), b.cast("string").alias("dst"), F.lit(tb).alias("dst_label"))
    rows = facts.select(F.explode(F.array(link(F.col("doc_id"), "Document", F.col("pkey"), "Parameter"), link(F.col("pkey"), "Parameter", F.col("canon"), "Entity"))).alias("e"))
    return rows.select("e.*").filter("src is not null and dst is not null").distinct()


def first_documents(*tracks: DataFrame, limit: int = 40) -> DataFrame:
    """Distinct documents of several tracks (doc_id, pos), in order of appearance."""
    rows = reduce(DataFrame.unionByName, [t.select("doc_id", F.struct(F.lit(i).alias("track"), "pos").alias("place")) for i, t in enumerate(tracks)])
    return rows.groupBy("doc_id").agg(F.min("place").alias("place")).orderBy("place", "doc_id").limit(limit).select("doc_id")
