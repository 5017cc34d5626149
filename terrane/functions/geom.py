"""Whole geometries as one column, with the accessors of all kinds as native expressions.

A geometry is ``struct<kind string, srid int, parts array<struct<dim int, rings array<array<struct<x double, y double>>>>>>``. A part is a
point (one ring of one point), a line (one ring) or a polygon (its rings, the outer first); multi-geometries and collections
have several. A null column is a null geometry.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as G

POINTS = "array<struct<x:double,y:double>>"
PARTS = f"array<struct<dim:int,rings:array<{POINTS}>>>"
TYPE = f"struct<kind:string,srid:int,parts:{PARTS}>"


def _part(dim: int, rings: Column) -> Column:
    return F.struct(F.lit(dim).cast("int").alias("dim"), rings.cast(f"array<{POINTS}>").alias("rings"))


def geometry(kind: Column | str, parts: Column, srid: int = 4326) -> Column:
    """Null without parts."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.when(F.size(parts) > 0, F.struct(kind.alias("kind"), F.lit(srid).cast("int").alias("srid"), parts.cast(PARTS).alias("parts")))


def point(p: Column, srid: int = 4326) -> Column:
    return F.when(p.isNotNull(), geometry("POINT", F.array(_part(0, F.array(F.array(p)))), srid))


def line(points: Column, srid: int = 4326) -> Column:
    return F.when(F.size(points) >= 2, geometry("LINESTRING", F.array(_part(1, F.array(points))), srid))


def polygon(rings: Column, srid: int = 4326) -> Column:
    return F.when(F.size(rings) >= 1, geometry("POLYGON", F.array(_part(2, rings)), srid))


def _many(single: str, multi: str, parts: Column, srid: int, force_multi: bool) -> Column:
    return geometry(F.lit(multi) if force_multi else F.when(F.size(parts) == 1, single).otherwise(multi), parts, srid)


def multipoint(points: Column, srid: int = 4326, force_multi: bool = False) -> Column:
    """Points without a location are left out; one alone is a point."""
    known = F.filter(points, lambda p: p["x"].isNotNull())
    return _many("POINT", "MULTIPOINT", F.transform(known, lambda p: _part(0, F.array(F.array(p)))), srid, force_multi)


def multilinestring(lines: Column, srid: int = 4326, force_multi: bool = False) -> Column:
    return _many("LINESTRING", "MULTILINESTRING", F.transform(F.filter(lines, lambda x: F.size(x) >= 2), lambda x: _part(1, F.array(x))), srid, force_multi)


def multipolygon(polygons: Column, srid: int = 4326, force_multi: bool = False) -> Column:
    return _many("POLYGON", "MULTIPOLYGON", F.transform(polygons, lambda x: _part(2, x)), srid, force_multi)


def collection(points: Column, lines: Column, srid: int = 4326) -> Column:
    """Points and lines; the caller orders them by member if it needs that order."""
    known = F.filter(points, lambda p: p["x"].isNotNull())
    parts = F.concat(F.transform(known, lambda p: _part(0, F.array(F.array(p)))), F.transform(F.filter(lines, lambda x: F.size(x) >= 2), lambda x: _part(1, F.array(x))))
    return geometry("GEOMETRYCOLLECTION", parts, srid)


# --- accessors -----------------------------------------------------------------------------------------------------


def geometry_type(g: Column) -> Column:
    return F.coalesce(g["kind"], F.lit("NULL"))


def is_null(g: Column) -> Column:
    return g.isNull()


def srid(g: Column) -> Column:
    return g["srid"]


def equals(a: Column, b: Column) -> Column:
    """Same kind, projection and points; two nulls are equal."""
    return a.eqNullSafe(b)


def dimension(g: Column) -> Column:
    """0, 1 or 2; of a collection the highest."""
    return F.array_max(F.transform(g["parts"], lambda p: p["dim"]))


def num_geometries(g: Column) -> Column:
    return F.coalesce(F.when(g.isNotNull(), F.size(g["parts"])), F.lit(0))


def _rings(g: Column) -> Column:
    return F.flatten(F.transform(g["parts"], lambda p: p["rings"]))


def n_points(g: Column) -> Column:
    return F.coalesce(G.n_points(_rings(g)), F.lit(0))


def _of(g: Column, dim: int) -> Column:
    return F.filter(g["parts"], lambda p: p["dim"] == dim)


def _total(items: Column, f) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + f(x))


def area(g: Column) -> Column:
    return _total(_of(g, 2), lambda p: G.polygon_area(p["rings"]))


def length(g: Column) -> Column:
    """Of lines; polygons have none."""
    return _total(_of(g, 1), lambda p: G.length(F.get(p["rings"], F.lit(0))))


def centroid(g: Column) -> Column:
    """Of the parts of the highest dimension: the mean of points, lines weighted by length, polygons by area."""
    d = dimension(g)

    def mean(items: Column, weight, at) -> Column:
        whole = _total(items, weight)
        x, y = (_total(items, lambda i, k=k: weight(i) * F.coalesce(at(i)[k], F.lit(0.0))) for k in "xy")
        return F.when(whole != 0, G.point(x / whole, y / whole))

    points = mean(_of(g, 0), lambda p: F.lit(1.0), lambda p: F.get(F.get(p["rings"], F.lit(0)), F.lit(0)))
    lines = mean(_of(g, 1), lambda p: G.length(F.get(p["rings"], F.lit(0))), lambda p: G.centroid_line(F.get(p["rings"], F.lit(0))))
    # rings: outer ones count, inner ones count against
    marked = F.flatten(F.transform(_of(g, 2), lambda p: F.transform(p["rings"], lambda r, i: F.struct(r.alias("ring"), F.when(i == 0, 1.0).otherwise(-1.0).alias("sign")))))
    polygons = mean(marked, lambda r: r["sign"] * F.abs(G.ring_area(r["ring"])), lambda r: G.centroid_ring(r["ring"]))
    return F.when(d == 0, points).when(d == 1, lines).when(d == 2, polygons)


def bbox(g: Column) -> Column:
    """Of the points, lines and outer rings."""
    return G.bbox(F.flatten(F.transform(g["parts"], lambda p: F.get(p["rings"], F.lit(0)))))


def _with_parts(g: Column, parts: Column, srid_: Column | None = None) -> Column:
    return F.when(g.isNotNull(), F.struct(g["kind"].alias("kind"), (g["srid"] if srid_ is None else srid_).alias("srid"), parts.alias("parts")))


def _each_ring(g: Column, f) -> Column:
    return F.transform(g["parts"], lambda p: F.struct(p["dim"].alias("dim"), F.transform(p["rings"], f).alias("rings")))


def reverse(g: Column) -> Column:
    return _with_parts(g, _each_ring(g, lambda r: F.reverse(r)))


def transform(g: Column, to: int) -> Column:
    """From 4326 to 3857 or itself; any other pair is an error."""
    if to not in (4326, 3857):
        raise ValueError(f"unknown projection {to}")
    if to == 4326:
        return F.when(g["srid"] == 4326, g).when(g.isNotNull(), F.raise_error(F.lit("can only transform from 4326")).cast(TYPE))
    moved = _with_parts(g, _each_ring(g, lambda r: F.transform(r, lambda p: G.to_mercator(p["x"], p["y"]))), F.lit(3857).cast("int"))
    return F.when(g["srid"] == 4326, moved).when(g.isNotNull(), F.raise_error(F.lit("can only transform from 4326")).cast(TYPE))


def _single(g: Column, part: Column) -> Column:
    kind = F.element_at(F.array(F.lit("POINT"), F.lit("LINESTRING"), F.lit("POLYGON")), part["dim"] + 1)
    return F.struct(kind.alias("kind"), g["srid"].alias("srid"), F.array(part).alias("parts"))


def geometry_n(g: Column, n: Column) -> Column:
    """The n-th part, from 1; null outside."""
    part = F.when(n >= 1, F.get(g["parts"], (n - 1).cast("int")))
    return F.when(part.isNotNull(), _single(g, part))


def split_multi(g: Column) -> Column:
    """array of the parts as geometries; none for null."""
    return F.coalesce(F.transform(g["parts"], lambda p: _single(g, p)), F.array().cast(f"array<{TYPE}>"))


def parts_of(g: Column, dim: int) -> Column:
    """array<rings> of the parts of a dimension."""
    return F.transform(_of(g, dim), lambda p: p["rings"])
