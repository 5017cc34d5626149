"""Which regions an object lies in: a spatial join by cells.

Regions are cut into the cells of a fixed grid that their boxes cover, objects into the cells of their own boxes; the
equi-join on the cell finds candidates, which the box and, for polygons, an exact test confirm. A side of few rows, counted, is
broadcast; otherwise both stay distributed, so the number of regions needs no bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import fresh

CELL_E7 = 100_000_000
RINGS = "array<array<struct<x:double,y:double>>>"
#: A side of a join by cells is broadcast only if it was counted and has no more rows.
FEW = 100_000


def cells_of(lo_x: Column, lo_y: Column, hi_x: Column, hi_y: Column, cell: int) -> Column:
    span = lambda lo, hi: F.sequence(F.floor(lo / cell), F.floor(hi / cell))
    return F.flatten(F.transform(span(lo_x, hi_x), lambda i: F.transform(span(lo_y, hi_y), lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


def few(rows: DataFrame) -> bool:
    return rows.limit(FEW + 1).count() <= FEW


def by_cell(objects: DataFrame, regions: DataFrame, on: list[str]) -> DataFrame:
    """Both sides joined on their cells. The side that was counted as few rows is broadcast, the regions first; of two large ones neither is, though
    the files they come from may look small: they are told apart by shuffles."""
    if few(regions):
        return objects.join(F.broadcast(regions), on)
    if few(objects):
        return F.broadcast(objects).join(regions, on)
    return objects.hint("merge").join(regions, on)


def box_of(points: Column) -> list[Column]:
    """Least x and y, largest x and y of array<struct<x,y>>."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return [F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)]


def ring_side(ring: Column, x: Column, y: Column) -> Column:
    """1 inside the closed ring (array<struct<x,y>>), 0 outside, -1 on it: crossings of a ray."""
    def crossing(acc, i):
        a, b = F.get(ring, i - 1), F.get(ring, i)
        ax, ay, bx, by, px, py = (v.cast("double") for v in (a["x"], a["y"], b["x"], b["y"], x, y))
        cross = (bx - ax) * (py - ay) - (px - ax) * (by - ay)
        on = (cross == 0) & px.between(F.least(ax, bx), F.greatest(ax, bx)) & py.between(F.least(ay, by), F.greatest(ay, by))
        up = (ay <= py) & (by > py) & (cross > 0)
        downward = (by <= py) & (ay > py) & (cross < 0)
        return F.when(acc == -1, -1).when(on, F.lit(-1)).when(up | downward, 1 - acc).otherwise(acc)

    return F.when(F.size(ring) > 1, F.aggregate(F.sequence(F.lit(1), F.size(ring) - 1), F.lit(0), crossing)).otherwise(0)


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Whether the point is in the closed ring; points on it are inside."""
    return ring_side(ring, x, y) != 0


def in_rings(rings: Column, x: Column, y: Column) -> Column:
    """Whether the point is in the polygon: inside an odd number of rings, or on one."""
    sides = F.transform(rings, lambda r: ring_side(r, x, y))
    return F.exists(sides, lambda s: s == -1) | (F.aggregate(sides, F.lit(0), lambda a, s: a + s) % 2 == 1)


def located(objects: DataFrame, regions: DataFrame, cell: int = CELL_E7) -> DataFrame:
    """Distinct (id, name) of points (id, x, y) in regions (name, min_x, min_y, max_x, max_y, and optionally a ring or rings)."""
    cx, cy, at = fresh("cx"), fresh("cy"), fresh("cell")
    cut = regions.withColumn(at, F.explode(cells_of(F.col("min_x"), F.col("min_y"), F.col("max_x"), F.col("max_y"), cell))).select("*", F.col(at)["cx"].alias(cx), F.col(at)["cy"].alias(cy)).drop(at)
    points = objects.select("id", "x", "y", F.floor(F.col("x") / cell).alias(cx), F.floor(F.col("y") / cell).alias(cy))
    inside = F.col("x").between(F.col("min_x"), F.col("max_x")) & F.col("y").between(F.col("min_y"), F.col("max_y"))
    hit = by_cell(points, cut, [cx, cy]).filter(inside)
    if "ring" in regions.columns:
        hit = hit.filter(F.col("ring").isNull() | in_ring(F.col("ring"), F.col("x"), F.col("y")))
    if "rings" in regions.columns:
        hit = hit.filter(F.col("rings").isNull() | in_rings(F.col("rings"), F.col("x"), F.col("y")))
    return hit.select("id", "name").distinct()


def _segments(rows: DataFrame, key: list[str], rings: str, cell: int, names: tuple[str, str, str, str]) -> DataFrame:
    """A row for each segment of array<array<struct<x,y>>> and cell of its box."""
    n = F.size("r")
    pairs = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.struct(F.get("r", i).alias("a"), F.get("r", i + 1).alias("b")))
    each = rows.select(*key, F.explode(rings).alias("r")).filter(n > 1).select(*key, F.explode(pairs).alias("s"))
    ends = each.select(*key, *[F.col(f"s.{p}.{v}").cast("double").alias(x) for x, (p, v) in zip(names, (("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")), strict=True)])
    ax, ay, bx, by = map(F.col, names)
    return ends.select("*", F.explode(cells_of(F.least(ax, bx), F.least(ay, by), F.greatest(ax, bx), F.greatest(ay, by), cell)).alias("cell"))


def _meet() -> Column:
    """Whether the segments (ax, ay)-(bx, by) and (px, py)-(qx, qy) have a point in common."""
    c = F.col
    side = lambda ux, uy, vx, vy, x, y: (c(vx) - c(ux)) * (c(y) - c(uy)) - (c(vy) - c(uy)) * (c(x) - c(ux))
    s1, s2 = side("ax", "ay", "bx", "by", "px", "py"), side("ax", "ay", "bx", "by", "qx", "qy")
    s3, s4 = side("px", "py", "qx", "qy", "ax", "ay"), side("px", "py", "qx", "qy", "bx", "by")
    boxes = [(F.least(c(a), c(b)) <= F.greatest(c(p), c(q))) & (F.least(c(p), c(q)) <= F.greatest(c(a), c(b))) for a, b, p, q in (("ax", "bx", "px", "qx"), ("ay", "by", "py", "qy"))]
    return boxes[0] & boxes[1] & (F.signum(s1) * F.signum(s2) <= 0) & (F.signum(s3) * F.signum(s4) <= 0)


def located_shapes(objects: DataFrame, regions: DataFrame, cell: int = CELL_E7) -> DataFrame:
    """Distinct (id, name) of shapes (id, dim, rings: a line's or a polygon's) that meet polygons (name, rings).

    They meet where a shape's first vertex is in the polygon, a polygon's first vertex is in an area, or two segments meet. Segments are
    dealt to the cells of their boxes and joined there, so no pair of long shapes is compared in one task.
    """
    first = lambda rings: F.get(F.get(rings, F.lit(0)), F.lit(0))
    box = lambda rings: [b.alias(n) for n, b in zip(("min_x", "min_y", "max_x", "max_y"), box_of(F.get(rings, F.lit(0))), strict=True)]
    starts = objects.select("id", first(F.col("rings"))["x"].alias("x"), first(F.col("rings"))["y"].alias("y"))
    inside = located(starts, regions.select("name", "rings", *box(F.col("rings"))), cell)
    areas = objects.filter("dim = 2").select(F.col("id").alias("name"), "rings", *box(F.col("rings")))
    around = located(regions.select(F.col("name").alias("id"), first(F.col("rings"))["x"].alias("x"), first(F.col("rings"))["y"].alias("y")), areas, cell).select(F.col("name").alias("id"), F.col("id").alias("name"))
    mine = _segments(objects, ["id"], "rings", cell, ("ax", "ay", "bx", "by"))
    theirs = _segments(regions, ["name"], "rings", cell, ("px", "py", "qx", "qy"))
    crossing = by_cell(mine, theirs, ["cell"]).filter(_meet()).select("id", "name")
    return inside.unionByName(around.select(inside.columns)).unionByName(crossing).distinct()


class Locator:
    """Named regions: boxes, and polygons of geometries (4326); a multipolygon is one region for each polygon. Names may repeat."""

    def __init__(self, name: str, spark: SparkSession) -> None:
        self.name, self.spark, self.regions = name, spark, None

    def _add(self, rows: DataFrame) -> None:
        self.regions = rows if self.regions is None else self.regions.unionByName(rows)

    def add_bbox(self, name: str, min_x: float, min_y: float, max_x: float, max_y: float) -> None:
        ring = [(min_x, min_y), (max_x, min_y), (max_x, max_y), (min_x, max_y), (min_x, min_y)]
        self._add(self.spark.createDataFrame([(name, [ring])], f"name string, rings {RINGS}"))

    def add_from_table(self, rows: DataFrame) -> None:
        """(name, g): geometries; a kind other than polygon or multipolygon is an error when the rows are read."""
        wrong = F.raise_error(F.concat(F.lit("a region can't be a "), F.col("g.kind"))).cast("boolean")
        polygons = rows.filter(F.when(F.col("g.kind").isin("POLYGON", "MULTIPOLYGON"), True).otherwise(wrong))
        self._add(polygons.select("name", F.explode("g.parts").alias("p")).select("name", F.col("p.rings").cast(RINGS).alias("rings")))

    def _met(self, objects: DataFrame, cell: float) -> DataFrame:
        if self.regions is None:
            return objects.select("id", F.lit(None).cast("string").alias("name")).limit(0)
        parts = objects.select("id", F.explode("g.parts").alias("p")).select("id", "p.dim", "p.rings")
        return located_shapes(parts, self.regions, cell)

    def all_intersecting(self, objects: DataFrame, cell: float = 10.0) -> DataFrame:
        """(id, names) of geometries (id, g)."""
        return self._met(objects, cell).groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("names"))

    def first_intersecting(self, objects: DataFrame, cell: float = 10.0) -> DataFrame:
        return self._met(objects, cell).groupBy("id").agg(F.min("name").alias("name"))


def all_intersecting(objects: DataFrame, regions: DataFrame, cell: int = CELL_E7) -> DataFrame:
    """(id, names): the sorted set of region names."""
    return located(objects, regions, cell).groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("names"))


def first_intersecting(objects: DataFrame, regions: DataFrame, cell: int = CELL_E7) -> DataFrame:
    """(id, name): one region, always the one with the least name."""
    return located(objects, regions, cell).groupBy("id").agg(F.min("name").alias("name"))
