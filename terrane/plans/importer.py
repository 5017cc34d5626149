"""An import from end to end: objects go to callbacks by type, callbacks insert into declared tables, relations mark members for a second
stage, and changes bring the tables up to date.

A callback is a function ``(objects, context) -> list[Insert]`` on all objects of a kind at once. Kinds are ``node``, ``way`` and
``relation`` for tagged objects, the same after ``untagged_``, and after ``deleted_`` for objects that a change deletes (ids and
attributes alone). Nodes have ``point``; ways ``points`` (array<struct<x,y>> of 1e-7 degrees, nulls for missing nodes).
Barriers between the phases are the dependencies of DataFrames; the hooks run where they stand.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import changes as C
from ..operators import expire as E
from ..operators import gather, ids
from ..operators.expire import ExpireOutput
from ..sources.store import discard, materialize
from .tables import Context, Table

KINDS = {"node": "N", "way": "W", "relation": "R"}


@dataclass
class Insert:
    """Rows for a table: ``objects`` (with their id) and the values of its columns; 0 to n inserts for each object."""

    table: str
    objects: DataFrame
    values: dict[str, Column]
    numbers: tuple[str, ...] = ()


@dataclass
class Graph:
    """Nodes (id, lon_e7, lat_e7, version, tags), ways (id, nodes, version, tags), relations (id, members, version, tags)."""

    nodes: DataFrame
    ways: DataFrame
    rels: DataFrame


Callback = Callable[[DataFrame, "Run"], list[Insert]]


@dataclass
class Config:
    """``select_members``: of relations, the (type n or w, id) of the members to process again in stage 2, where callbacks see
    ``run.stage == 2``. ``refs``: points of ways know their node, as in :func:`gather.located_ways`. ``hooks``: called after a kind, by ``after_nodes``, ``after_ways``, ``after_relations``."""

    tables: tuple[Table, ...]
    callbacks: dict[str, Callback]
    select_members: Callable[[DataFrame], DataFrame] | None = None
    refs: bool = False
    hooks: dict[str, Callable[[Run], None]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        known = {p + k for k in KINDS for p in ("", "untagged_", "deleted_")}
        if unknown := set(self.callbacks) - known:
            raise ValueError(f"unknown callback {sorted(unknown)[0]!r}")
        if unknown := set(self.hooks) - {"after_nodes", "after_ways", "after_relations"}:
            raise ValueError(f"unknown hook {sorted(unknown)[0]!r}")


@dataclass
class Result:
    graph: Graph
    tables: dict[str, DataFrame]
    rejected: DataFrame | None = None
    affected: dict[str, DataFrame] = field(default_factory=dict)
    counts: DataFrame | None = None
    expired: dict[str, DataFrame] = field(default_factory=dict)

    def drop_store(self) -> None:
        """The raw store goes; the tables stay, but changes can't be applied any more."""
        for name in ("nodes", "ways", "rels"):
            frame = getattr(self.graph, name)
            frame.unpersist()
            if hasattr(frame, "_stored_at"):
                discard(frame)
        self.graph = None


class Run(Context):
    """What callbacks see: mode, stage, properties, the whole graph, and the ids that tables already hold."""

    def __init__(self, config: Config, graph: Graph, mode: str, properties: dict[str, str] | None = None) -> None:
        super().__init__(mode, properties)
        self.config, self.graph = config, graph
        for t in config.tables:
            self.define_table(t)
        self.made: dict[str, list[DataFrame]] = {t.name: [] for t in config.tables}
        self.rejects: list[DataFrame] = []

    def insert(self, kind: str, inserts: list[Insert]) -> None:
        for each in inserts:
            table = self.tables.get(each.table)
            if table is None:
                raise ValueError(f"no table {each.table!r}")
            if not table.takes(KINDS[kind]) and table.ids != "none":
                raise ValueError(f"a {kind} can't go into the table {table.name!r}")
            rows, rejected = table.project(each.objects, each.values, F.lit(KINDS[kind]), F.col("id"), each.numbers)
            self.made[table.name].append(rows)
            self.rejects.append(rejected.select(F.lit(table.name).alias("table"), "column", "n"))

    def process(self, kind: str, objects: DataFrame, stage: int = 1) -> None:
        """Tagged and untagged objects to their callbacks; without tags at reading is what counts."""
        self.stage = stage
        if f := self.config.callbacks.get(kind):
            self.insert(kind, f(objects.filter(F.size("tags") > 0), self))
        if f := self.config.callbacks.get(f"untagged_{kind}"):
            self.insert(kind, f(objects.filter(F.size("tags") <= 0), self))

    def hook(self, name: str) -> None:
        if name in self.config.hooks:
            self.config.hooks[name](self)

    def rows(self, name: str) -> DataFrame | None:
        made = self.made[name]
        return reduce(DataFrame.unionByName, made) if made else None


def _marked(config: Config, rels: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Ids of the nodes and ways that relations mark; zero is no id."""
    if config.select_members is None:
        return None
    marked = config.select_members(rels).select("type", "id").filter("id <> 0").distinct()
    return marked.filter("type = 'n'").select("id"), marked.filter("type = 'w'").select("id")


def _derive(run: Run, nodes: DataFrame, ways: DataFrame, rels: DataFrame, marked: tuple[DataFrame, DataFrame] | None) -> None:
    """Callbacks over the given objects of the run's graph; marked nodes and ways go in stage 2 instead of stage 1."""
    points = gather.node_points(nodes)
    lines = gather.way_points(ways, run.graph.nodes, run.config.refs)
    run.process("node", points if marked is None else points.join(marked[0], "id", "left_anti"))
    run.hook("after_nodes")
    run.process("way", lines if marked is None else lines.join(marked[1], "id", "left_anti"))
    run.hook("after_ways")
    run.process("relation", gather.usable_relations(rels))
    run.hook("after_relations")
    if marked is not None:
        run.process("node", points.join(marked[0], "id", "left_semi"), 2)
        run.process("way", lines.join(marked[1], "id", "left_semi"), 2)
    run.stage = 1


def check_create(objects: DataFrame) -> DataFrame:
    """The objects; an error, when they are read, for deleted ones, which only changes may hold."""
    if "visible" not in objects.columns:
        return objects
    return objects.filter(F.when(F.coalesce("visible", F.lit(True)), True).otherwise(F.raise_error(F.lit("deleted objects outside append mode")).cast("boolean")))


def run_import(config: Config, graph: Graph, bbox: tuple[int, int, int, int] | None = None, extra_attributes: bool = False, properties: dict[str, str] | None = None) -> Result:
    """Creates all tables. ``bbox``: min lon, min lat, max lon, max lat in 1e-7 degrees; only nodes are filtered by it."""
    graph = Graph(*(check_create(x) for x in (graph.nodes, graph.ways, graph.rels)))
    if bbox:
        graph = Graph(ids.within(graph.nodes, *bbox), graph.ways, graph.rels)
    if extra_attributes:
        from ..functions.tags import with_attributes

        graph = Graph(*(x.withColumn("tags", with_attributes(F.col("tags"), osm_version=F.col("version"))) for x in (graph.nodes, graph.ways, graph.rels)))
    run = Run(config, graph, "create", properties)
    _derive(run, graph.nodes, graph.ways, graph.rels, _marked(config, gather.usable_relations(graph.rels)))
    tables = {t.name: rows for t in config.tables if (rows := run.rows(t.name)) is not None}
    counts = reduce(DataFrame.unionByName, [x.agg(F.lit(k).alias("kind"), F.count("*").alias("n"), F.max("id").alias("max_id")) for k, x in (("node", graph.nodes), ("way", graph.ways), ("relation", graph.rels))])
    return Result(graph, tables, reduce(DataFrame.unionByName, run.rejects) if run.rejects else None, counts=counts)


def _of_kind(table: Table, kind: str, affected: DataFrame) -> list[tuple[list[Column], DataFrame]]:
    return [(table.id_values(F.lit(KINDS[kind]), F.col("id")), affected)] if table.takes(KINDS[kind]) else []


def without(table: Table, rows: DataFrame, affected: dict[str, DataFrame]) -> DataFrame:
    """The table's rows but those of the affected objects, of the types that may be in it."""
    for kind, changed in affected.items():
        for values, objects in _of_kind(table, kind, changed):
            rows = rows.join(objects.select(*values), list(table.id_columns), "left_anti")
    return rows


def of_affected(table: Table, rows: DataFrame, affected: dict[str, DataFrame]) -> DataFrame:
    """The table's rows of the affected objects."""
    found = [rows.join(objects.select(*values), list(table.id_columns), "left_semi") for kind, changed in affected.items() for values, objects in _of_kind(table, kind, changed)]
    return reduce(DataFrame.unionByName, found).distinct() if len(found) > 1 else found[0]


def expired_tiles(config: Config, before: dict[str, DataFrame], made: dict[str, DataFrame | None], affected: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """(zoom, x, y) for each expire output: what the affected objects' geometries touched before and touch now. A create run expires nothing."""
    tiles: dict[str, list[tuple[DataFrame, ExpireOutput]]] = {}
    for t in config.tables:
        for e in t.expires:
            ident = F.concat_ws(":", *[F.col(c).cast("string") for c in t.id_columns]).alias("id")
            side = lambda rows: rows.select(ident, F.col(e.column).alias("g")).filter("g is not null")  # noqa: B023, E731
            old = side(of_affected(t, before[t.name], affected)) if t.name in before else None
            new = side(made[t.name]) if made.get(t.name) is not None else None
            if old is None and new is None:
                continue
            old, new = (new.limit(0) if old is None else materialize(old, "old")), (old.limit(0) if new is None else new)
            met = E.expire_changes(old, new, e.limits.maxzoom, e.config, e.diff, e.limits.max_tiles_geometry)
            rows = E.pyramid(met, e.limits.maxzoom, e.limits.minzoom if e.limits.minzoom is not None else e.limits.maxzoom)
            tiles.setdefault(e.output, []).append((rows, e.limits))
    return {name: E.overall(reduce(DataFrame.unionByName, [r for r, _ in own]).distinct(), min(x.max_tiles_overall for _, x in own)) for name, own in tiles.items()}


def run_append(config: Config, before: Result, nodes: DataFrame, ways: DataFrame, rels: DataFrame, properties: dict[str, str] | None = None) -> Result:
    """Brings the tables up to date with changes (rows like the graph's, with ``op``: create, modify or delete).

    Affected are the changed objects, the parents of changed nodes and ways (not of those in their first version or deleted), and the
    members that the old or the new version of a changed or pending relation marks. Their rows go and are derived anew.
    """
    old, stored = before.graph, zip(("nodes", "ways", "rels"), (before.graph.nodes, before.graph.ways, before.graph.rels), (nodes, ways, rels), strict=True)
    # the new raw store, and below the ids: written once, as many plans read them
    new = Graph(*(materialize(C.apply(a, b.select(*a.columns, "op")), name) for name, a, b in stored))
    pending_ways, pending_rels = C.closure(new.ways, new.rels, C.changed_for_parents(nodes), ways, rels)
    more = C.parent_relations(new.rels, C.changed_for_parents(ways), "w")
    pending_rels = materialize(pending_rels.union(more).distinct(), "pending")
    node_ids, run = nodes.select("id").distinct(), Run(config, new, "append", properties)
    touched = _marked(config, gather.usable_relations(old.rels.join(pending_rels, "id", "left_semi")).unionByName(gather.usable_relations(new.rels.join(pending_rels, "id", "left_semi"))))
    marked = _marked(config, gather.usable_relations(new.rels))
    if touched is not None:
        node_ids, pending_ways = ids.union_ids(node_ids, touched[0]), ids.union_ids(pending_ways, touched[1])
    node_ids, pending_ways = materialize(node_ids, "pending"), materialize(pending_ways, "pending")
    affected = {"node": node_ids, "way": pending_ways, "relation": pending_rels}
    for kind, changed in (("node", nodes), ("way", ways), ("relation", rels)):
        if f := config.callbacks.get(f"deleted_{kind}"):
            run.insert(kind, f(changed.filter("op = 'delete'").select("id", "version"), run))
    _derive(run, new.nodes.join(node_ids, "id", "left_semi"), new.ways.join(pending_ways, "id", "left_semi"), new.rels.join(pending_rels, "id", "left_semi"), marked)
    made_rows = {t.name: run.rows(t.name) for t in config.tables}
    for t in config.tables:
        if t.expires and made_rows[t.name] is not None:  # read by the table and by each expire output
            made_rows[t.name] = materialize(made_rows[t.name], t.name)
    tables = {}
    for t in config.tables:
        kept, made = before.tables.get(t.name), made_rows[t.name]
        if t.ids == "none":  # rows without ids can't be found again, so they only grow
            tables[t.name] = made if kept is None else kept if made is None else kept.unionByName(made)
        elif kept is not None:
            rest = without(t, kept, affected)
            tables[t.name] = rest if made is None else rest.unionByName(made)
        elif made is not None:
            tables[t.name] = made
    expired = expired_tiles(config, before.tables, made_rows, affected)
    return Result(new, tables, reduce(DataFrame.unionByName, run.rejects) if run.rejects else None, affected, expired=expired)
