"""Structured Streaming: change streams applied to a store, windows over events, and the replication state."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes, ids
from ..sources.store import delete, materialize


class Store:
    """A table kept as versions in folders of their own: ``base=N`` holds all rows, ``delta=N`` the changes of one batch (rows with ``op``).

    A version counts from when its writer has put the marker ``_SUCCESS`` there, so readers never see half a write, and a writer that is
    run again after a fault writes its version anew. A batch costs its own size; after ``compact_every`` deltas the next version is a base.
    Old versions stay until :meth:`vacuum`.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "id", compact_every: int = 16) -> None:
        self.spark, self.path, self.key, self.compact_every = spark, path.rstrip("/"), key, compact_every

    def versions(self) -> list[tuple[int, str]]:
        """(number, kind) of the finished versions, in order. Only a missing folder means that there are none; other faults are raised."""
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        out = []
        for status in fs.listStatus(root):
            kind, _, number = status.getPath().getName().partition("=")
            if kind in ("base", "delta") and fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                out.append((int(number), kind))
        return sorted(out)

    def current(self) -> int | None:
        known = self.versions()
        return known[-1][0] if known else None

    def read(self, version: int | None = None) -> DataFrame:
        """All rows as of a version, by default the last."""
        known = [(n, k) for n, k in self.versions() if version is None or n <= version]
        bases = [n for n, k in known if k == "base"]
        if not bases:
            raise ValueError(f"{self.path} has no snapshot")
        base = self.spark.read.parquet(f"{self.path}/base={bases[-1]}")
        deltas = [n for n, k in known if k == "delta" and n > bases[-1]]
        if not deltas:
            return base
        each = [self.spark.read.parquet(f"{self.path}/delta={n}").withColumn("__version", F.lit(n)) for n in deltas]
        newest = ids.latest_version(reduce(DataFrame.unionByName, each), [self.key], "__version").drop("__version")
        return changes.apply(base, newest)

    def replace(self, df: DataFrame) -> int:
        n = (self.current() or 0) + 1
        df.write.mode("overwrite").parquet(f"{self.path}/base={n}")
        return n

    def apply(self, rows: DataFrame) -> int:
        """One row for each id, with ``op``; writes these alone, unless it is time for a base."""
        known = self.versions()
        n = known[-1][0] + 1
        if len(known) - max(i for i, (_, k) in enumerate(known) if k == "base") > self.compact_every:
            return self.replace(changes.apply(self.read(), rows))
        rows.write.mode("overwrite").parquet(f"{self.path}/delta={n}")
        return n

    def vacuum(self, keep: int = 2) -> None:
        """Deletes what is older than the last ``keep`` bases."""
        known = self.versions()
        bases = [n for n, k in known if k == "base"][-keep:]
        for n, kind in known:
            if bases and n < bases[0]:
                delete(self.spark, f"{self.path}/{kind}={n}")


def apply_batches(store: Store, key: str = "id") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the newest version of each object of a batch replaces what the store has.

    A batch that is run again gives the same store, as applying a change twice changes nothing.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        store.apply(ids.latest_version(batch, [key]))

    return run


def run_updates(stream: DataFrame, store: Store, checkpoint: str):
    """Applies all that is there, and ends."""
    query = stream.writeStream.foreachBatch(apply_batches(store)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def tumbling(events: DataFrame, width: str, late: str = "1 hour", ts: str = "ts") -> DataFrame:
    stamped = events.withWatermark(ts, late) if events.isStreaming else events
    return stamped.groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, slide: str, late: str = "1 hour", ts: str = "ts") -> DataFrame:
    stamped = events.withWatermark(ts, late) if events.isStreaming else events
    return stamped.groupBy(F.window(ts, width, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, late: str = "1 hour", ts: str = "ts") -> DataFrame:
    stamped = events.withWatermark(ts, late) if events.isStreaming else events
    return stamped.groupBy("user_id", F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


# --- replication ---------------------------------------------------------------------------------------------------


def sequence_path(sequence: int) -> str:
    """Where a diff of a number lies in a replication directory: three groups of three digits."""
    s = f"{sequence:09d}"
    return f"{s[:3]}/{s[3:6]}/{s[6:]}"


def parse_state(text: str) -> dict:
    """sequence and timestamp of a state file."""
    own = dict(line.split("=", 1) for line in text.splitlines() if "=" in line and not line.startswith("#"))
    if "sequenceNumber" not in own or "timestamp" not in own:
        raise ValueError("a state file has a sequence number and a timestamp")
    return {"sequence": int(own["sequenceNumber"]), "timestamp": own["timestamp"].replace("\\:", ":")}


def import_state(objects: list[DataFrame], **settings: str) -> DataFrame:
    """(property, value) after an import: the settings, and the newest timestamp of the objects (ts) as import and current timestamp."""
    newest = reduce(DataFrame.unionByName, [o.agg(F.max("ts").alias("ts")) for o in objects]).agg(F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"))
    stamps = newest.select(F.explode(F.create_map(F.lit("import_timestamp"), "ts", F.lit("current_timestamp"), "ts")).alias("property", "value"))
    own = newest.sparkSession.createDataFrame(sorted(settings.items()), "property string, value string")
    return own.unionByName(stamps.filter("value is not null"))


def advanced(properties: DataFrame, newer: DataFrame) -> DataFrame:
    """Properties after changes: the current timestamp and sequence only ever grow, the import's own stays, others are replaced."""
    number = F.col("value").try_cast("bigint")
    both = properties.select("property", "value", F.lit(0).alias("round")).unionByName(newer.filter("property <> 'import_timestamp'").select("property", "value", F.lit(1).alias("round")))
    latest = both.groupBy("property").agg(F.max_by("value", "round").alias("last"), F.max("value").alias("text"), F.max(number).cast("string").alias("number"))
    grown = F.when(F.col("property") == "replication_sequence_number", F.col("number")).when(F.col("property").isin("current_timestamp", "replication_timestamp"), F.col("text")).otherwise(F.col("last"))
    return latest.select("property", grown.alias("value"))


class Replication:
    """The state of a store that follows a directory of diffs, kept in its properties table."""

    def __init__(self, base_url: str, sequence: int, timestamp: str) -> None:
        self.state = {"replication_base_url": base_url, "replication_sequence_number": str(sequence), "replication_timestamp": timestamp}

    def pending(self, newest: int, sizes: dict[int, int], max_bytes: int = 500_000_000) -> list[int]:
        """The next diffs to apply together: as many as fit, at least one."""
        own, total = [], 0
        for n in range(int(self.state["replication_sequence_number"]) + 1, newest + 1):
            total += sizes.get(n, 0)
            if own and total > max_bytes:
                break
            own.append(n)
        return own

    def done(self, sequence: int, timestamp: str) -> None:
        """Moves on, never back."""
        if sequence > int(self.state["replication_sequence_number"]):
            self.state |= {"replication_sequence_number": str(sequence), "replication_timestamp": max(timestamp, self.state["replication_timestamp"])}

    def properties(self, spark: SparkSession, old: DataFrame | None = None) -> DataFrame:
        new = spark.createDataFrame(sorted(self.state.items()), "property string, value string")
        return new if old is None else changes.upsert(old, new, ["property"])

    def follow(self, newest: Callable[[], int], size_of: Callable[[int], int], fetch: Callable[[int], tuple[DataFrame, str]], apply: Callable[[DataFrame], None], once: bool = False, max_bytes: int = 500_000_000, after: Callable[[], None] | None = None) -> int:
        """Applies diffs until the store has the newest (or one round of them): fetches as many as fit, merges them to the newest version of each
        object, applies them, moves on, and calls ``after``. Returns how many were applied."""
        applied = 0
        while True:
            first, last = int(self.state["replication_sequence_number"]) + 1, newest()
            own = self.pending(last, {n: size_of(n) for n in range(first, last + 1)}, max_bytes)
            if not own:
                return applied
            got = [fetch(n) for n in own]
            rows = reduce(DataFrame.unionByName, [f.withColumn("__diff", F.lit(n)) for n, (f, _) in zip(own, got, strict=True)])
            apply(ids.latest_version(rows, ["id"], "version", "__diff").drop("__diff"))
            self.done(own[-1], got[-1][1])
            applied += len(own)
            if after:
                after()
            if once:
                return applied

    def to_json(self) -> str:
        return json.dumps(self.state, sort_keys=True)


def settled(df: DataFrame, name: str) -> DataFrame:
    return materialize(df, name)
