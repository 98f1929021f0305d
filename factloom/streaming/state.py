"""Streams with keyed state (R02, R04): novelties of subscriptions and chains of versions.

Both keep their state in RocksDB, write it with the checkpoint, and go on from there after a
restart. Neither result depends on the order in which rows arrive, so once their input is drained
they hold what the batch operators give on all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from factloom.operators import lifecycle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MICROS_A_MILLI = 1000


def prepare(spark: SparkSession) -> None:
    """Streams that start from now on keep their state in RocksDB; a store chosen before stays."""
    if spark.conf.get(_PROVIDER, "").rpartition(".")[2] in ("", "HDFSBackedStateStoreProvider"):
        spark.conf.set(_PROVIDER, _ROCKSDB)


def _whole(rows: Iterator) -> Any:
    import pandas as pd

    return pd.concat(list(rows), ignore_index=True)


def _packed(**columns: Any) -> bytes:
    """Columns as one value of the state: no cell of them is handled on its own."""
    import pyarrow as pa

    table, out = pa.table(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(held: tuple | None, empty: dict[str, str]) -> dict[str, Any]:
    """The columns as arrays; empty ones, of these types, if nothing is held."""
    import numpy as np
    import pyarrow as pa

    if not held:
        return {name: np.empty(0, kind) for name, kind in empty.items()}
    table = pa.ipc.open_stream(pa.py_buffer(bytes(held[0]))).read_all()
    return {name: table.column(name).to_numpy().copy() for name in empty}


# --- subscriptions --------------------------------------------------------------

#: Microseconds that stand for no time at all.
NEVER = -(1 << 63)
#: Kinds of rows that the state is told.
HIT, SUBSCRIBED, MARKED = 0, 1, 2
#: Buckets of a query's documents in the state: a batch asks for those that it touches.
DOC_BUCKETS = 64
_USERS = {"user": "object", "seen": "int64", "new": "int64", "due": "int64", "own": "bool"}
_DOCS = {"doc": "object", "at": "int64"}


class Novelties(StatefulProcessor):
    """Per query and part of its users: the documents of the query, each with its latest time, and of each
    user what was last seen and how many documents are newer. A batch changes the counts by the times that
    it brings and takes away, so no document is kept or met once for each user. A mark moves what was
    last seen forward only, and the count is taken again from all times; documents that no user of the part
    can count any more go then. A document that comes late counts if it is newer than what was seen.
    While something is unseen, a timer reminds the user of it after `remind` milliseconds without a new
    document."""

    def __init__(self, remind: int):
        self.remind = remind

    def init(self, handle) -> None:
        self.handle = handle
        self.users = handle.getValueState("users", "data binary")
        self.docs = handle.getMapState("docs", "bucket int", "data binary")

    def _docs(self, bucket: int) -> dict[str, Any]:
        return _unpacked(self.docs.getValue((bucket,)), _DOCS)

    def _taken(self, hits) -> tuple[Any, Any]:
        """Keep the hits; (times that are new, times that they take the place of), sorted."""
        import numpy as np
        import pandas as pd

        came, gone = [np.empty(0, "int64")], [np.empty(0, "int64")]
        latest = hits.groupby("doc_id", sort=False).agg(at=("at", "max"), bucket=("bucket", "first"))
        for bucket, part in latest.groupby("bucket"):
            held, at = self._docs(int(bucket)), part["at"].to_numpy()
            place = pd.Index(held["doc"]).get_indexer(part.index)
            known = place >= 0
            old, now = held["at"][place[known]], at[known]
            later = now > old
            if not later.any() and known.all():
                continue
            times = held["at"].copy()
            times[place[known]] = np.maximum(now, old)
            docs = np.concatenate([held["doc"], part.index.to_numpy()[~known]])
            self.docs.updateValue((int(bucket),), (_packed(doc=docs, at=np.concatenate([times, at[~known]])),))
            came += [now[later], at[~known]]
            gone += [old[later]]
        return np.sort(np.concatenate(came)), np.sort(np.concatenate(gone))

    def _times(self, floor: int) -> Any:
        """All times, sorted; documents that are not newer than `floor` go."""
        import numpy as np

        times = [np.empty(0, "int64")]
        for (bucket,) in list(self.docs.keys()):
            held = self._docs(bucket)
            keep = held["at"] > floor
            if not keep.any():
                self.docs.removeKey((bucket,))
            elif not keep.all():
                self.docs.updateValue((bucket,), (_packed(doc=held["doc"][keep], at=held["at"][keep]),))
            times.append(held["at"][keep])
        return np.sort(np.concatenate(times))

    def _rows(self, key, users, which, reminder: bool):
        import pandas as pd

        return pd.DataFrame({"user": users["user"][which], "query": [key[0]] * int(which.sum()), "new": users["new"][which], "last_seen": users["seen"][which], "reminder": reminder})

    def handleInputRows(self, key, rows, timerValues):
        import numpy as np
        import pandas as pd

        batch = _whole(rows)
        hits, told = batch[batch["kind"] == HIT], batch[batch["kind"] != HIT]
        users = _unpacked(self.users.get(), _USERS)
        heard = told.groupby("user").agg(at=("at", "max"), kind=("kind", "min"))
        fresh = heard.index.difference(pd.Index(users["user"], dtype="object")).to_numpy()
        none = np.zeros(len(fresh), "int64")
        more = {"user": fresh, "seen": none + NEVER, "new": none, "due": none + NEVER, "own": none > 0}
        users = {c: np.concatenate([users[c], more[c]]) for c in _USERS}
        place = pd.Index(users["user"]).get_indexer(heard.index)
        seen, before = users["seen"], users["new"]
        moved, met = np.zeros(len(seen), "bool"), np.full(len(seen), len(hits) > 0)
        moved[place] = heard["at"].to_numpy() > seen[place]
        met[place] = True
        seen[place] = np.maximum(seen[place], heard["at"].to_numpy())
        users["own"][place] |= (heard["kind"] == SUBSCRIBED).to_numpy()
        floor = int(seen.min()) if len(seen) else NEVER
        came, gone = self._taken(hits[hits["at"] > floor])
        later = lambda times, than: len(times) - np.searchsorted(times, than, side="right")
        new = before + later(came, seen) - later(gone, seen)
        if moved.any():
            new[moved] = later(self._times(floor), seen[moved])
        new[seen == NEVER] = 0
        users["new"] = new
        if self.remind:
            due = timerValues.getCurrentProcessingTimeInMs() + self.remind
            users["due"][met] = np.where(users["own"][met] & (new[met] > 0), due, NEVER)
            self._timers(users["due"])
        self.users.update((_packed(**users),))
        which = users["own"] & met & ((new > 0) | (before > 0))
        if which.any():
            yield self._rows(key, users, which, False)

    def _timers(self, due) -> None:
        """Timers at the times when some user is due, and no others."""
        wanted, there = {int(x) for x in set(due.tolist()) if x != NEVER}, set(self.handle.listTimers())
        for timer in there - wanted:
            self.handle.deleteTimer(timer)
        for timer in wanted - there:
            self.handle.registerTimer(timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        users = _unpacked(self.users.get(), _USERS)
        due = (users["due"] != NEVER) & (users["due"] <= expiredTimerInfo.getExpiryTimeInMs())
        which = due & users["own"] & (users["new"] > 0)
        users["due"][due] = NEVER
        self.users.update((_packed(**users),))
        if which.any():
            yield self._rows(key, users, which, True)

    def close(self) -> None:
        pass


def _each_once(batches: Iterator) -> Iterator:
    """The different values of a task's only column."""
    import pyarrow as pa

    known: set = set()
    for batch in batches:
        values = [x for x in batch.column(0).unique().to_pylist() if x not in known]
        known.update(values)
        yield pa.RecordBatch.from_arrays([pa.array(values, batch.schema.field(0).type)], schema=batch.schema)


def novelties(hits: DataFrame, subscriptions: DataFrame, marks: DataFrame | None = None, remind: int = 0, parts: int = 8) -> DataFrame:
    """A stream of (user, query, new, last_seen, reminder), a row whenever a subscription's
    count may have changed, or a timer reminds of it. hits: a stream of (query, doc_id, at), at null
    if unknown; subscriptions: a table (user, query, last_seen); marks: a stream (user, query, at) of
    what users have seen since. With `remind` the stream runs on, as its timers go by the clock: it has
    to be stopped. Times are microseconds.

    A query's users are dealt out over `parts`, each of which gets the query's hits; a batch names each of
    its queries once, and that row meets the subscriptions. So a batch costs its hits times the parts,
    and the subscriptions of the queries that it touches, which are also the rows it puts out. A
    subscription that is entered later counts what comes from then on, and what its part still keeps."""
    name = lambda: F.coalesce(F.concat(F.lit("="), F.col("user").cast("string")), F.lit(""))
    micros = lambda c: F.coalesce(F.unix_micros(c), F.lit(NEVER))
    dealt = F.pmod(F.xxhash64("user"), F.lit(parts)).cast("int")
    kinds = dict(subscriptions.dtypes)
    told = lambda rows, kind: rows.withColumns({"user": name(), "kind": F.lit(kind), "doc_id": F.lit(None).cast("string"), "bucket": F.lit(0)}).withColumn("part", dealt)
    columns = ["query", "part", "kind", "user", "doc_id", "bucket", "at"]
    known = told(subscriptions.filter("query is not null").select("user", "query", micros("last_seen").alias("at")), SUBSCRIBED).select(columns)
    found = hits.select("query", F.col("doc_id").cast("string").alias("doc_id"), micros("at").alias("at")).filter("doc_id is not null and query is not null")
    named = found.select("query")
    once = named.mapInArrow(_each_once, named.schema).repartition("query").mapInArrow(_each_once, named.schema)
    rows = found.join(known.select("query", "part").distinct(), "query").withColumns({"kind": F.lit(HIT), "user": F.lit(""), "bucket": F.pmod(F.xxhash64("doc_id"), F.lit(DOC_BUCKETS)).cast("int")})
    rows = rows.select(columns).unionByName(once.join(known, "query").select(columns))
    if marks is not None:
        rows = rows.unionByName(told(marks.filter("query is not null and at is not null").select("user", "query", micros("at").alias("at")), MARKED).select(columns))
    schema = f"user string, query {kinds['query']}, new long, last_seen long, reminder boolean"
    prepare(rows.sparkSession)
    out = rows.groupBy("query", "part").transformWithStateInPandas(Novelties(remind), schema, "Update", "ProcessingTime" if remind else "None")
    return out.withColumn("user", F.when(F.col("user") != "", F.expr("substring(user, 2)")).cast(kinds["user"]))


# --- versions -------------------------------------------------------------------


#: Pieces of a key's slots in the state, and the new rows that are worked on at once.
PIECES, SPAN = 512, 100_000
_FACTS = ("slot", "pkey", "at")


class Chains(StatefulProcessor):
    """Per slot its facts with the time of their last extraction. A fact that comes late moves the
    versions of those after it; rows are put out for what is new or moved. Slots lie in pieces, each
    one value of the state; all slots of some pieces are worked on together, as columns."""

    def init(self, handle) -> None:
        self.chains = handle.getMapState("chains", "piece int", "data binary")

    def _held(self, piece: int):
        import pyarrow as pa

        held = self.chains.getValue((piece,))
        return pa.ipc.open_stream(pa.py_buffer(bytes(held[0]))).read_all() if held else None

    def handleInputRows(self, key, rows, timerValues):
        import numpy as np

        batch = _whole(rows).sort_values("piece", kind="stable")
        pieces = batch["piece"].to_numpy()
        ends = np.append(np.flatnonzero(pieces[1:] != pieces[:-1]) + 1, len(pieces))
        begin = 0
        for i, end in enumerate(ends):  # of whole pieces
            if end - begin >= SPAN or i == len(ends) - 1:
                out = self._told(batch.iloc[begin:end])
                begin = end
                if out is not None:
                    yield out

    def _told(self, new):
        import numpy as np
        import pyarrow as pa

        touched = np.unique(new["piece"].to_numpy())
        held = [(p, t) for p in touched.tolist() if (t := self._held(p)) is not None]
        n = sum(len(t) for _, t in held)
        table = pa.concat_tables([*(t for _, t in held), pa.table({"slot": pa.array(new["slot"], "string"), "pkey": pa.array(new["pkey"], "string"), "at": pa.array(new["at"], "int64")})])
        piece = np.concatenate([*(np.full(len(t), p) for p, t in held), new["piece"].to_numpy()])
        slot, fact = (table.column(c).combine_chunks().dictionary_encode().indices.to_numpy() for c in ("slot", "pkey"))
        at, was = table.column("at").to_numpy(), np.arange(len(table)) < n
        meant = np.zeros(slot.max() + 1, "bool")
        meant[slot[n:]] = True
        order = np.flatnonzero(meant[slot])
        order = order[np.lexsort((at[order], fact[order], slot[order]))]
        first = _starts(slot[order], fact[order])
        group = np.cumsum(first) - 1  # of one fact of one slot: one row at most was held
        last = order[np.append(np.flatnonzero(first)[1:], len(order)) - 1]
        version = _numbered(slot[last], at[last])
        old_at, old_version, there = (np.zeros(len(last), kind) for kind in ("int64", "int64", "bool"))
        before = was[order]
        old = order[before]
        there[group[before]] = True
        old_at[group[before]] = at[old]
        old_version[group[before]] = _numbered(slot[old], at[old])
        later = ~there | (old_at != at[last])
        if not later.any():
            return None
        changed = np.unique(piece[last[later]])
        rest = np.flatnonzero(was & ~meant[slot])
        keep = np.concatenate([rest, last])
        keep = keep[np.isin(piece[keep], changed)]
        keep = keep[np.argsort(piece[keep], kind="stable")]
        kept, place = table.take(pa.array(keep)), np.searchsorted(piece[keep], changed)
        for p, i, j in zip(changed.tolist(), place, np.append(place[1:], len(keep))):
            self.chains.updateValue((p,), (_packed(**{c: kept.column(c).slice(i, j - i) for c in _FACTS}),))
        tell = later | (old_version != version)
        return table.take(pa.array(last[tell])).to_pandas().assign(version=version[tell])

    def close(self) -> None:
        pass


def _starts(*keys) -> Any:
    """Where, in sorted rows, a key differs from that of the row before."""
    import numpy as np

    out = np.ones(len(keys[0]), "bool")
    if len(out):
        out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def _numbered(slot, at) -> Any:
    """One more than the number of strictly older facts of the slot, of each row."""
    import numpy as np

    order, place, out = np.lexsort((at, slot)), np.arange(len(slot)), np.empty(len(slot), "int64")
    of = lambda starts: np.maximum.accumulate(np.where(starts, place, 0))
    out[order] = of(_starts(slot[order], at[order])) - of(_starts(slot[order])) + 1
    return out


def slot_key() -> Column:
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in lifecycle.SLOT]), {"ignoreNullFields": "false"})


def versions(facts: DataFrame, buckets: int = 256) -> DataFrame:
    """A stream of changes (slot, pkey, at, version) to the chains of versions, from a stream of
    facts. Slots are dealt out over `buckets` keys, each with a map of pieces of its slots, so a batch
    asks the state for the pieces that it touches only, and writes those that change. A slot's chain is
    in one task's memory. Facts without a time of extraction have no version."""
    rows = facts.select(slot_key().alias("slot"), "pkey", F.unix_micros(F.col("extracted_at").cast("timestamp")).alias("at")).filter("at is not null and pkey is not null")
    prepare(rows.sparkSession)
    dealt = rows.withColumns({"bucket": F.pmod(F.xxhash64("slot"), F.lit(buckets)), "piece": F.pmod(F.xxhash64("slot", F.lit(1)), F.lit(PIECES)).cast("int")})
    return dealt.groupBy("bucket").transformWithStateInPandas(Chains(), "slot string, pkey string, at long, version long", "Update", "None")


def chains(changes: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """The kept changes as a table like `lifecycle.versions`: the slot's columns, of these types."""
    schema = ", ".join(f"{c} string" for c in lifecycle.SLOT)
    slot = F.from_json("slot", schema)
    return changes.select(*[slot[c].cast(kinds[c]).alias(c) for c in lifecycle.SLOT], "pkey", F.timestamp_micros("at").alias("extracted_at"), "version")
