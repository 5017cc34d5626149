"""Tile expiry: which tiles a geometry touches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tiles as T
from ..sources.store import fresh

STEP = 0.4


@dataclass(frozen=True)
class ExpireConfig:
    """``mode``: full_area, boundary_only or hybrid, in which an area whose box is wider or higher than ``full_area_limit``
    expires by its boundary."""

    mode: str = "full_area"
    full_area_limit: float = 0.0
    buffer: float = 0.1

    def __post_init__(self) -> None:
        if self.mode.replace("-", "_") not in ("full_area", "boundary_only", "hybrid"):
            raise ValueError(f"unknown expire mode {self.mode!r}")


@dataclass(frozen=True)
class ExpireOutput:
    maxzoom: int
    minzoom: int | None = None
    max_tiles_geometry: int = 10_000_000
    max_tiles_overall: int = 50_000_000

    def __post_init__(self) -> None:
        if not 1 <= self.maxzoom <= 20:
            raise ValueError("maxzoom is from 1 to 20")
        if self.minzoom is not None and not 1 <= self.minzoom <= self.maxzoom:
            raise ValueError("minzoom is from 1 to maxzoom")
        if not all(1 <= x <= 50_000_000 for x in (self.max_tiles_geometry, self.max_tiles_overall)):
            raise ValueError("limits are from 1 to 50,000,000")


def box_tiles(x0: Column, y0: Column, x1: Column, y1: Column, zoom: int, clamp_low: bool) -> Column:
    """array<struct<x,y>> of the tiles of a box in units of tiles: x goes round the map, y stays on it."""
    width = 1 << zoom
    top = F.floor(y0)
    low = F.greatest(top, F.lit(0)) if clamp_low else top
    ys = F.filter(F.sequence(low, F.greatest(low, F.floor(y1))), lambda y: (y >= 0) & (y < width) & (y <= F.floor(y1)))
    return F.flatten(F.transform(F.sequence(F.floor(x0), F.floor(x1)), lambda x: F.transform(ys, lambda y: F.struct(F.pmod(x, F.lit(width)).cast("int").alias("x"), y.cast("int").alias("y")))))


def point_tiles(x: Column, y: Column, zoom: int, buffer: float = 0.1) -> Column:
    tx, ty = T.tile_coord(x, y, zoom)
    return F.array_distinct(box_tiles(tx - buffer, ty - buffer, tx + buffer, ty + buffer, zoom, True))


def expire_lines(segments: DataFrame, zoom: int, buffer: float = 0.1) -> DataFrame:
    """Distinct (id, x, y) of segments (id, ax, ay, bx, by) in mercator coordinates.

    A segment is walked from left to right in steps of 0.4 tiles, and each step's box with the buffer is expired. One over half
    the map's width goes over the date line instead. Steps and tiles are exploded as rows, so each stays a compiled
    expression over columns.
    """
    width = 1 << zoom
    (p, q), (r, s) = T.tile_coord(F.col("ax"), F.col("ay"), zoom), T.tile_coord(F.col("bx"), F.col("by"), zoom)
    c, swap = F.col, F.col("p") > F.col("r")
    rows = segments.select("id", p.alias("p"), q.alias("q"), r.alias("r"), s.alias("s"))
    rows = rows.select("id", *[F.when(swap, c(a)).otherwise(c(b)).alias(n) for n, a, b in (("x0", "r", "p"), ("y0", "s", "q"), ("x1", "p", "r"), ("y1", "q", "s"))])
    far = c("x1") - c("x0") > width / 2
    rows = rows.select("id", *[F.when(far, a).otherwise(b).alias(n) for n, a, b in (("sx", c("x1"), c("x0")), ("sy", c("y1"), c("y0")), ("ex", c("x0") + width, c("x1")), ("ey", c("y0"), c("y1")))])
    rows = rows.withColumn("size", F.sqrt((c("ex") - c("sx")) * (c("ex") - c("sx")) + (c("ey") - c("sy")) * (c("ey") - c("sy"))))
    unit = lambda a, b: F.when(c("size") > 0, (c(b) - c(a)) / c("size")).otherwise(0.0)
    rows = rows.withColumn("dx", unit("sx", "ex")).withColumn("dy", unit("sy", "ey"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(c("size") / STEP).cast("int") - 1))).alias("step"))
    a, b = c("step") * STEP, F.least((c("step") + 1) * STEP, c("size"))
    rows = rows.select("id", (c("sx") + c("dx") * a).alias("ux"), (c("sy") + c("dy") * a).alias("uy"), (c("sx") + c("dx") * b).alias("vx"), (c("sy") + c("dy") * b).alias("vy"))
    low, high = (lambda u, v: F.floor(F.least(u, v) - buffer)), (lambda u, v: F.floor(F.greatest(u, v) + buffer))
    rows = rows.select("id", F.explode(F.sequence(low("ux", "vx"), high("ux", "vx"))).alias("x"), low("uy", "vy").alias("lo"), high("uy", "vy").alias("hi")).distinct()
    rows = rows.select("id", F.pmod(c("x"), F.lit(width)).cast("int").alias("x"), F.explode(F.sequence("lo", "hi")).alias("y"))
    return rows.filter(c("y").between(0, width - 1)).select("id", "x", c("y").cast("int").alias("y")).distinct()


def edges_of(geoms: DataFrame) -> DataFrame:
    """(id, dim, ax, ay, bx, by) of geometries (id, g) in mercator coordinates: segments of lines and rings; points are segments of no length."""
    parts = geoms.select("id", F.explode("g.parts").alias("p")).select("id", "p.dim", F.explode("p.rings").alias("r"))
    n = F.size("r")
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.struct(F.get("r", i).alias("a"), F.get("r", i + 1).alias("b")))).otherwise(F.transform("r", lambda p: F.struct(p.alias("a"), p.alias("b"))))
    rows = parts.filter(n > 0).select("id", "dim", F.explode(pairs).alias("s"))
    return rows.select("id", "dim", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))


def fill_rows(edges: DataFrame, zoom: int) -> DataFrame:
    """Distinct (id, x, y) of the tiles inside areas by the even-odd rule, from their edges (id, ax, ay, bx, by).

    Every tile row's top edge is cut with the edges that span it, and the spans between two cuts are filled. Rows of tiles are
    exploded from edges, so an area's rows are dealt out like any others.
    """
    width = 1 << zoom
    (p, q), (r, s) = T.tile_coord(F.col("ax"), F.col("ay"), zoom), T.tile_coord(F.col("bx"), F.col("by"), zoom)
    rows = edges.select("id", p.alias("p"), q.alias("q"), r.alias("r"), s.alias("s")).filter("q <> s")
    low, high = F.least("q", "s"), F.greatest("q", "s")
    first, last = F.greatest(F.floor(low) + 1, F.lit(0)), F.least(F.floor(high), F.lit(width - 1))
    rows = rows.filter(first <= last).select("*", F.explode(F.sequence(first, last)).alias("y"))
    at = F.col("p") + (F.col("y") - F.col("q")) / (F.col("s") - F.col("q")) * (F.col("r") - F.col("p"))
    cuts = rows.select("id", "y", F.floor(F.least(F.greatest(at, F.lit(0.0)), F.lit(float(width - 1)))).alias("x")).groupBy("id", "y").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    spans = F.filter(F.transform(F.sequence(F.lit(0), F.size("xs") - 2, F.lit(2)), lambda i: F.struct(F.get("xs", i).alias("lo"), F.get("xs", i + 1).alias("hi"))), lambda v: v["hi"] > v["lo"])
    each = cuts.filter(F.size("xs") > 1).select("id", "y", F.explode(spans).alias("v"))
    rows = each.select("id", F.explode(F.sequence(F.col("v.lo"), F.col("v.hi") - 1)).alias("x"), "y")
    return rows.select("id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).distinct()


def expire_edges(edges: DataFrame, zoom: int, config: ExpireConfig = ExpireConfig(), most: int | None = None) -> DataFrame:
    """Distinct (id, x, y) that edges (id, dim, ax, ay, bx, by) touch: boundaries and lines by their segments, areas (dim 2) also inside,
    as the mode says, unless one tile holds the whole boundary. ``most``: an object that touches more tiles expires none; one whose box
    alone is longer than that is left out before its tiles are made.
    """
    c, size = F.col, T.CIRCUMFERENCE / (1 << zoom)
    box = edges.groupBy("id").agg(*[f(g(a, b)).alias(n) for n, f, g, a, b in (("x0", F.min, F.least, "ax", "bx"), ("y0", F.min, F.least, "ay", "by"), ("x1", F.max, F.greatest, "ax", "bx"), ("y1", F.max, F.greatest, "ay", "by"))])
    if most is not None:
        # over half the map's width a line goes the other way round, so only heights count there
        wide = F.when(c("x1") - c("x0") <= T.CIRCUMFERENCE / 2, c("x1") - c("x0")).otherwise(0.0)
        edges = edges.join(box.filter(F.greatest(wide, c("y1") - c("y0")) <= most * size).select("id"), "id", "left_semi")
    border = expire_lines(edges, zoom, config.buffer)
    mode = config.mode.replace("-", "_")
    tiles = border
    if mode != "boundary_only":
        many = border.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
        if mode == "hybrid":
            small = (c("x1") - c("x0") <= config.full_area_limit) & (c("y1") - c("y0") <= config.full_area_limit)
            many = many.join(box.filter(small).select("id"), "id", "left_semi")
        tiles = border.unionByName(fill_rows(edges.filter("dim = 2").join(many, "id", "left_semi"), zoom)).distinct()
    return tiles if most is None else limited(tiles, most)


def difference_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """The edges (id, dim, ax, ay, bx, by) that changed: of objects on both sides those of one side only, class by class; of others all.

    Edges of both sides cancel in pairs whatever their direction. What is left of areas bounds their symmetric difference, which the even-odd
    rule fills.
    """
    c = F.col
    back = (c("ax") > c("bx")) | ((c("ax") == c("bx")) & (c("ay") > c("by")))
    ends = lambda e: e.select("id", "dim", *[F.when(back, c(a)).otherwise(c(b)).alias(b) for a, b in (("bx", "ax"), ("by", "ay"), ("ax", "bx"), ("ay", "by"))])
    both = ends(edges_of(old)).unionByName(ends(edges_of(new)))
    return both.groupBy(*both.columns).agg(F.count("*").alias("n")).filter("n % 2 = 1").drop("n")


def expire_changes(old: DataFrame, new: DataFrame, zoom: int, config: ExpireConfig = ExpireConfig(), diff: bool = True, most: int | None = None) -> DataFrame:
    """Distinct (id, x, y) of what changed objects expire: geometries (id, g) before and after, in mercator coordinates. With ``diff`` only
    what differs, else both sides whole."""
    if diff:
        return expire_edges(difference_edges(old, new), zoom, config, most)
    # each side is filled for itself: what both cover would be outside by the even-odd rule
    return expire_edges(edges_of(old), zoom, config, most).unionByName(expire_edges(edges_of(new), zoom, config, most)).distinct()


def overall(tiles: DataFrame, most: int) -> DataFrame:
    """At most so many tiles (zoom, x, y), the first by zoom and quadkey: nothing is accepted beyond."""
    return tiles.orderBy("zoom", T.quadkey(F.col("x"), F.col("y"))).limit(most)


def limited(tiles: DataFrame, most: int) -> DataFrame:
    """Tiles of geometries within the limit; a geometry over it expires none."""
    sizes = tiles.groupBy("id").agg(F.count("*").alias("__n")).filter(F.col("__n") <= most)
    return tiles.join(sizes.select("id"), "id", "left_semi")


def pyramid(tiles: DataFrame, zoom: int, minzoom: int) -> DataFrame:
    """(zoom, x, y): tiles (x, y) of a zoom and their ancestors, each once."""
    return tiles.select("x", "y").distinct().select(F.explode(T.pyramid(zoom, minzoom, F.col("x"), F.col("y"))).alias("t")).select("t.*").distinct()


def symmetric_difference(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of one side only: what a change has to expire."""
    n = fresh("n")
    both = old.select(columns).withColumn(n, F.lit(1)).unionByName(new.select(columns).withColumn(n, F.lit(-1)))  # each side is read once
    net = both.groupBy(columns).agg(F.sum(n).alias(n)).filter(F.col(n) != 0)
    return net.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.abs(n)))).select(columns)


def tile_list(tiles: DataFrame) -> DataFrame:
    """Lines ``z/x/y`` in the order of their quadkeys within each zoom."""
    return tiles.orderBy("zoom", T.quadkey(F.col("x"), F.col("y"))).select(T.tile_text(F.col("zoom"), F.col("x"), F.col("y")).alias("value"))


def feature_collection(tiles: DataFrame) -> DataFrame:
    """One row: all features of :func:`geojson` in a collection with its coordinate system; for the few tiles that a viewer can hold."""
    features = F.concat_ws(",", F.sort_array(F.collect_list("value")))
    crs = '"crs":{"type":"name","properties":{"name":"urn:ogc:def:crs:EPSG::3857"}}'
    return geojson(tiles).agg(F.concat(F.lit('{"type":"FeatureCollection",' + crs + ',"features":['), features, F.lit("]}")).alias("value"))


def geojson(tiles: DataFrame) -> DataFrame:
    """One feature per tile, its extent as a polygon in mercator coordinates."""
    b = T.bounds(F.col("zoom"), F.col("x"), F.col("y"))
    ring = F.array(F.array(*[F.array(b[i], b[j]) for i, j in (("min_x", "min_y"), ("max_x", "min_y"), ("max_x", "max_y"), ("min_x", "max_y"), ("min_x", "min_y"))]))
    return tiles.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates")).alias("geometry"), F.struct("zoom", "x", "y").alias("properties"))).alias("value"))
