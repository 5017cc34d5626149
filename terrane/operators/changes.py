"""Incremental maintenance: applying changes and finding all that depends on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply(stored: DataFrame, changes: DataFrame, op: str = "op", replace_created: bool = True) -> DataFrame:
    """The store after changes (one row for each id; op: create, modify or delete): deletes the changed, adds the new. Without ``replace_created``
    a create is only added, so what is stored under its id stays."""
    gone = (changes if replace_created else changes.filter(F.col(op) != "create")).select("id")
    new = changes.filter(F.col(op) != "delete").select(stored.columns)
    return stored.join(gone, "id", "left_anti").unionByName(new)


def changed_for_parents(changes: DataFrame, propagate_deletes: bool = False) -> DataFrame:
    """Ids of nodes or ways whose parents must be processed again: not those of version 1, which are new; deleted
    ones only if asked for."""
    rows = changes.filter(F.coalesce(F.col("version"), F.lit(0)) != 1)
    return (rows if propagate_deletes else rows.filter("op <> 'delete'")).select("id").distinct()


def parent_ways(ways: DataFrame, node_ids: DataFrame) -> DataFrame:
    refs = ways.select("id", F.explode("nodes").alias("ref"))
    return refs.join(node_ids.select(F.col("id").alias("ref")), "ref", "left_semi").select("id").distinct()


def parent_relations(rels: DataFrame, ids: DataFrame, kind: str) -> DataFrame:
    """Relations with a member of the kind among the ids. Relations of relations are not followed."""
    refs = rels.select("id", F.explode(F.filter("members", lambda m: m["type"] == kind)).alias("m")).select("id", F.col("m.ref").alias("ref"))
    return refs.join(ids.select(F.col("id").alias("ref")), "ref", "left_semi").select("id").distinct()


def closure(ways: DataFrame, rels: DataFrame, nodes_changed: DataFrame, ways_changed: DataFrame, rels_changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids of the ways and relations to derive again: the changed, and the parents of what changed or depends on it."""
    pending_ways = parent_ways(ways, nodes_changed).union(ways_changed.select("id")).distinct()
    pending_rels = parent_relations(rels, nodes_changed, "n").union(parent_relations(rels, pending_ways, "w")).union(rels_changed.select("id")).distinct()
    return pending_ways, pending_rels


def refresh(output: DataFrame, affected: DataFrame, derived: DataFrame, key: str = "id") -> DataFrame:
    """The output table without the rows of affected objects, and with their new rows."""
    return output.join(affected.select(F.col("id").alias(key)), key, "left_anti").unionByName(derived.select(output.columns))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Key/value rows in which the new ones replace the old."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def upsert_expired(old: DataFrame, tiles: DataFrame, now) -> DataFrame:
    """The expire table: a tile met again keeps ``first`` and moves ``last``."""
    key = ["zoom", "x", "y"]
    met = tiles.select(*key).distinct().withColumn("__now", now)
    both = old.join(met, key, "full_outer")
    return both.select(*key, F.coalesce("first", "__now").alias("first"), F.coalesce("__now", "last").alias("last"))


def take_expired(table: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The tiles to process, the oldest first, and the table without them."""
    taken = table.orderBy("first", "zoom", "x", "y")
    taken = taken.limit(limit) if limit else taken
    return taken, table.join(taken.select("zoom", "x", "y"), ["zoom", "x", "y"], "left_anti")
