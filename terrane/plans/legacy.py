"""The legacy tables: four fixed ones whose columns come from a style file."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as M
from ..functions import shapes as S
from ..functions import tags as G
from ..operators import gather

FLAGS = {"polygon", "linear", "nocache", "delete", "phstore", "nocolumn"}
# How a style's data types are stored.
INT_TYPES, REAL_TYPES = {"smallint", "integer", "bigint", "int2", "int4", "int8"}, {"real", "double", "double precision"}
RELATION_TYPES = ("route", "multipolygon", "boundary")


@dataclass(frozen=True)
class Rule:
    nodes: bool
    ways: bool
    tag: str
    kind: str
    flags: frozenset[str]


def parse_style(text: str) -> list[Rule]:
    """Rules of lines ``OsmType Tag DataType Flags``; everything after # is a comment."""
    rules = []
    for number, line in enumerate(text.splitlines(), 1):
        words = line.split("#", 1)[0].split()
        if not words:
            continue
        if len(words) < 3:
            raise ValueError(f"line {number}: a rule has at least three fields")
        kinds = set(words[0].split(","))
        if not kinds <= {"node", "way"}:
            raise ValueError(f"line {number}: unknown object type {words[0]!r}")
        flags = frozenset(words[3].split(",")) if len(words) > 3 else frozenset()
        if "delete" not in flags and ("*" in words[1] or "?" in words[1]):
            raise ValueError(f"line {number}: wildcards only in delete rules")
        kind = "int" if words[2] in INT_TYPES else "real" if words[2] in REAL_TYPES else "text"
        rules.append(Rule("node" in kinds, "way" in kinds, words[1], kind, flags & FLAGS))
    if not rules:
        raise ValueError("a style without rules")
    return rules


def for_kind(rules: list[Rule], kind: str) -> list[Rule]:
    return [r for r in rules if (r.nodes if kind == "node" else r.ways)]


def filter_tags(tags: Column, rules: list[Rule], kind: str, hstore: str = "none") -> Column:
    """The tags that rules keep: the first that matches a key decides; without one, hstore modes keep it."""
    own = for_kind(rules, kind)

    def keep(key: Column) -> Column:
        out = F.lit(hstore != "none") | G.matches_any(key, [f"{r.tag}*" for r in own if "phstore" in r.flags])
        for r in reversed(own):
            test = G.glob_match(key, r.tag) if "delete" in r.flags else key == r.tag
            out = F.when(test, F.lit("delete" not in r.flags)).otherwise(out)
        return out

    return F.map_filter(tags, lambda k, v: keep(k))


def columns(rules: list[Rule], kind: str) -> list[Rule]:
    return [r for r in for_kind(rules, kind) if not r.flags & {"delete", "phstore", "nocolumn"}]


def column_values(tags: Column, rules: list[Rule], kind: str) -> list[Column]:
    read = {"int": G.legacy_int, "real": G.legacy_real, "text": lambda c: c}
    return [read[r.kind](G.tag(tags, r.tag)).alias(r.tag) for r in columns(rules, kind)]


def has_column(tags: Column, rules: list[Rule], kind: str) -> Column:
    """Whether some tag has a column of its own, for the keep-matching-rows-only option."""
    names = [r.tag for r in columns(rules, kind)]
    return F.exists(F.map_keys(tags), lambda k: k.isin(*names))


def points(nodes: DataFrame, rules: list[Rule], hstore: str = "none", match_only: bool = False) -> DataFrame:
    rows = nodes.withColumn("tags", filter_tags(F.col("tags"), rules, "node", hstore)).filter(F.size("tags") > 0)
    rows = rows.filter(has_column(F.col("tags"), rules, "node")) if match_only else rows
    rest = [G.rest_column(F.col("tags"), [r.tag for r in columns(rules, "node")], hstore).alias("rest")] if hstore != "none" else []
    return rows.select("id", *column_values(F.col("tags"), rules, "node"), *rest, "lon_e7", "lat_e7")


def line_or_polygon(ways: DataFrame, rules: list[Rule], hstore: str = "none") -> DataFrame:
    """Ways with ``is_polygon``, ``is_road`` and ``z_order`` and their columns."""
    polygon = [r.tag for r in for_kind(rules, "way") if "polygon" in r.flags]
    closed = (F.size("nodes") > 2) & (F.get("nodes", F.lit(0)) == F.element_at("nodes", -1))
    said = ways.select("*", F.col("tags").alias("all_tags"))
    rows = said.withColumn("tags", filter_tags(F.col("tags"), rules, "way", hstore)).filter(F.size("tags") > 0)
    t = F.col("tags")
    return rows.select("id", *column_values(t, rules, "way"), G.z_order(t).alias("z_order"), G.is_road(t).alias("is_road"), G.is_polygon(t, polygon, closed, F.col("all_tags")).alias("is_polygon"), "nodes")


SPLIT_METRES, SPLIT_DEGREES = 100_000.0, 1.0


def _projected(line: Column, latlon: bool) -> Column:
    """Points of 1e-7 degrees in degrees, or in mercator metres."""
    deg = F.transform(line, lambda p: M.point(p["x"] / 1e7, p["y"] / 1e7))
    return deg if latlon else F.transform(deg, lambda p: M.to_mercator(p["x"], p["y"]))


def _way_area(rings: Column, latlon: bool, reproject_area: bool) -> Column:
    """Planar area in the target projection, or with ``reproject_area`` in mercator metres whatever the target."""
    if latlon and reproject_area:
        rings = F.transform(rings, lambda r: F.transform(r, lambda p: M.to_mercator(p["x"], p["y"])))
    return M.polygon_area(rings)


def _cut(rows: DataFrame, latlon: bool) -> DataFrame:
    """A row for each part of ``line``, cut where it is longer than the limit."""
    parts = S.segmentize_udf("line", F.lit(SPLIT_DEGREES if latlon else SPLIT_METRES))
    return rows.withColumn("line", F.explode(parts))


def lines_roads_polygons(ways: DataFrame, rules: list[Rule], hstore: str = "none", latlon: bool = False, reproject_area: bool = False) -> dict[str, DataFrame]:
    """The tables ``line``, ``roads`` and ``polygon`` of ways with ``points``: id, the rules' columns, z_order, and the line, or way_area and rings.

    A closed way that its tags call an area is a polygon, or nothing if its ring crosses itself; any other is a line, cut at 100 km
    (1 degree); roads have their lines in both tables. Ways with fewer than two known nodes are left out.
    """
    known = F.size(F.filter("points", lambda p: p["x"].isNotNull()))
    made = line_or_polygon(ways, rules, hstore).drop("nodes").join(ways.select("id", "points"), "id").filter(known > 1)
    area = made.filter("is_polygon").withColumn("rings", S.first_polygon(F.array(_projected(M.as_linestring(F.col("points")), latlon))))
    polygons = area.withColumn("way_area", _way_area(F.col("rings"), latlon, reproject_area))
    lines = made.filter("not is_polygon").withColumn("line", _projected(M.as_linestring(F.col("points")), latlon)).filter(F.col("line").isNotNull())
    cut = _cut(lines, latlon).drop("points", "is_polygon")
    return {"line": cut.drop("is_road"), "roads": cut.filter("is_road").drop("is_road"), "polygon": polygons.drop("points", "is_polygon", "is_road")}


def relation_tables(rels: DataFrame, way_points: DataFrame, rules: list[Rule], hstore: str = "none", latlon: bool = False, reproject_area: bool = False) -> dict[str, DataFrame]:
    """The same tables for relations, under negative ids: routes and boundaries as merged lines, multipolygons and boundaries as a row for each
    polygon, with the tags that a relation hands on."""
    kind = G.tag(F.col("tags"), "type")
    kept = filter_tags(F.map_filter("tags", lambda k, v: k != "type"), rules, "way", hstore)
    rows = relations(rels).withColumn("kept", kept).filter(F.size("kept") > 0)
    all_tags = F.map_concat(F.create_map(F.lit("type"), kind), F.col("kept"))
    rows = rows.withColumn("tags", all_tags).withColumn("boundary", G.makes_boundary(F.col("tags"))).withColumn("polygon", (G.tag(F.col("tags"), "type") == "multipolygon") & ~F.col("boundary"))
    own = gather.relation_lines(rels, way_points).withColumn("id", -F.col("id"))
    t = G.route_tags(F.col("tags"))
    joined = rows.join(own, "id").select("id", "boundary", "polygon", *column_values(t, rules, "way"), G.z_order(t).alias("z_order"), G.is_road(t).alias("is_road"), F.transform("lines", lambda x: _projected(x, latlon)).alias("lines"))
    lines = _cut(joined.filter("not polygon").withColumn("line", F.explode(S.line_merge_udf("lines"))), latlon).drop("lines", "boundary", "polygon")
    areas = joined.filter("boundary or polygon").withColumn("rings", F.explode(S.assemble_udf("lines")))
    areas = areas.withColumn("way_area", _way_area(F.col("rings"), latlon, reproject_area)).drop("lines", "boundary", "polygon", "is_road")
    return {"line": lines.drop("is_road"), "roads": lines.filter("is_road").drop("is_road"), "polygon": areas}


def relations(rels: DataFrame) -> DataFrame:
    """The relations that the legacy tables know, under negative ids."""
    return rels.filter(G.tag(F.col("tags"), "type").isin(*RELATION_TYPES)).withColumn("id", -F.col("id"))
