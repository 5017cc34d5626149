"""Derived tables for lower zoom levels."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import shapes as S
from ..functions import tiles as T
from ..functions.params import render
from ..sources.store import dealt, fresh, materialize, with_rank
from .locator import box_of, cells_of

#: The cells of each round of the isolation search are so many times as wide as those of the last.
GROWTH = 4
#: So many points without an answer are broadcast to all others; the first cells are made smaller until they hold so few pairs a point.
ASKERS, PAIRS = 1024, 64


def discrete_isolation(points: DataFrame) -> DataFrame:
    """``points`` (id, importance, x, y) with irank, discr_iso (squared distance to the nearest point that ranks higher) and dirank.

    Of points at one place all but the best have 0, and only the best can answer others. The nearest higher-ranked point is searched
    in rounds over grids of growing cells. In a round, a point without an answer meets the higher-ranked ones in its cell and the eight
    around, and an answer within a cell's width is final. Of points closer than a width, the lower-ranked always gets its answer, so a
    cell keeps a few askers at most, and each place is met by a few. The first cells are small enough that no cluster makes many
    pairs, whatever the extent; the last ``ASKERS`` points, counted, are broadcast to all places, so no cell of the whole
    extent is ever made.
    """
    ranked = with_rank(points.filter("importance > 0"), [F.desc("importance"), F.col("id")], "irank")
    ranked = materialize(ranked.withColumn("x", F.col("x").cast("double")).withColumn("y", F.col("y").cast("double")), "ranked")
    n, x0, x1, y0, y1 = ranked.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if n < 2:
        return ranked.withColumn("discr_iso", F.lit(None).cast("double")).withColumn("dirank", F.lit(0).cast("long"))
    places = materialize(ranked.groupBy(F.col("x").alias("ox"), F.col("y").alias("oy")).agg(F.min("irank").alias("o_rank")), "places")
    own = ranked.select("id", "irank", "x", "y").join(places, (F.col("x") == F.col("ox")) & (F.col("y") == F.col("oy")))
    answered = own.filter("irank > o_rank").select("id", F.lit(0.0).alias("discr_iso"))
    asking = materialize(own.filter("irank = o_rank and irank > 0").select("id", "irank", "x", "y"), "asking")
    square = (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy"))

    def cells(x: str, y: str, w: float) -> list[Column]:
        return [F.floor((F.col(c) - F.lit(low)) / w) for c, low in ((x, x0), (y, y0))]

    def pairs(w: float) -> int:
        return places.groupBy(*cells("ox", "oy", w)).count().agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0

    left = asking.count()
    cell = max(x1 - x0, y1 - y0, 1e-9) / math.sqrt(n)
    if left > ASKERS:
        # floors have to stay within a long
        while pairs(cell) > PAIRS * n and (x1 - x0 + y1 - y0) / cell < 2.0**60:
            cell /= GROWTH
    while left > ASKERS:
        around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        at, other_at = cells("x", "y", cell), cells("ox", "oy", cell)
        asked = asking.select("id", "irank", "x", "y", around.alias("d")).select("id", "irank", "x", "y", (at[0] + F.col("d.i")).alias("cx"), (at[1] + F.col("d.j")).alias("cy"))
        other = places.select("o_rank", "ox", "oy", other_at[0].alias("cx"), other_at[1].alias("cy"))
        near = asked.join(other, ["cx", "cy"]).filter("o_rank < irank").groupBy("id").agg(F.min(square).alias("discr_iso"))
        found = materialize(near.filter(F.col("discr_iso") <= cell * cell), "isolation")
        answered = answered.unionByName(found)
        asking = materialize(asking.join(found.select("id"), "id", "left_anti"), "asking")
        left, cell = asking.count(), cell * GROWTH
    last = places.join(F.broadcast(asking), F.col("o_rank") < F.col("irank")).groupBy("id").agg(F.min(square).alias("discr_iso"))
    answered = materialize(answered.unionByName(last), "isolation")
    top = fresh("top")
    first = ranked.filter("irank = 1").join(answered, "id").select((F.col("discr_iso") + 1).alias(top))
    iso = ranked.join(answered, "id", "left").join(F.broadcast(first)).withColumn("discr_iso", F.coalesce("discr_iso", top)).drop(top)  # one row
    return with_rank(iso, [F.desc("discr_iso"), F.col("id")], "dirank")


def tile_table(objects: DataFrame, zoom: int) -> DataFrame:
    """``objects`` (x, y in mercator coordinates) with the tile (tx, ty) they lie in."""
    tx, ty = T.tile_of(F.col("x"), F.col("y"), zoom)
    return objects.withColumn("tx", tx).withColumn("ty", ty)


def tile_sql(spark: SparkSession, template: str, tiles: Iterable[tuple[int, int, int]], **params) -> list[DataFrame]:
    """A templated statement for each tile, with {ZOOM}, {X}, {Y} and the parameters put in."""
    return [spark.sql(render(template, ZOOM=z, X=x, Y=y, **params)) for z, x, y in tiles]


def run_sql(spark: SparkSession, statements: str | list[str], if_has_rows: str | None = None, **params) -> bool:
    """Runs the statements, unless the probe query has no rows; tells whether they ran."""
    if if_has_rows and spark.sql(render(if_has_rows, **params)).isEmpty():
        return False
    for statement in [statements] if isinstance(statements, str) else statements:
        spark.sql(render(statement, **params))
    return True


def tiles_of_extent(boxes: DataFrame, zoom: int) -> DataFrame:
    """All tiles (x, y) that the extent of boxes (min_x, min_y, max_x, max_y, mercator) covers."""
    e = boxes.agg(F.min("min_x").alias("a"), F.min("min_y").alias("b"), F.max("max_x").alias("c"), F.max("max_y").alias("d"))
    x0, y1 = T.tile_of(F.col("a"), F.col("b"), zoom)
    x1, y0 = T.tile_of(F.col("c"), F.col("d"), zoom)
    return e.select(F.explode(F.sequence(x0, x1)).alias("x"), y0.alias("y0"), y1.alias("y1")).select("x", F.explode(F.sequence("y0", "y1")).alias("y"))


# --- rasters -------------------------------------------------------------------------------------------------------


def fill_polygon(rings: list[np.ndarray], size: int) -> np.ndarray:
    """Pixels whose centres are inside by the even-odd rule; rings in pixel coordinates."""
    out = np.zeros((size, size), bool)
    rows = np.arange(size) + 0.5
    for ring in rings:
        a, b = np.asarray(ring[:-1], float), np.asarray(ring[1:], float)
        for (x0, y0), (x1, y1) in zip(a, b, strict=True):
            if y0 == y1:
                continue
            lo, hi = sorted((y0, y1))
            r = np.flatnonzero((rows >= lo) & (rows < hi))
            xs = x0 + (rows[r] - y0) * (x1 - x0) / (y1 - y0)
            for row, x in zip(r, np.clip(np.ceil(xs - 0.5), 0, size).astype(int), strict=True):
                out[row, x:] ^= True
    return out


def _shifted(a: np.ndarray, dy: int, dx: int, fill: bool) -> np.ndarray:
    out = np.full_like(a, fill)
    h, w = a.shape
    out[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] = a[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]
    return out


def dilate(a: np.ndarray, k: int) -> np.ndarray:
    for _ in range(k):
        a = a | _shifted(a, 0, 1, False) | _shifted(a, 0, -1, False)
        a = a | _shifted(a, 1, 0, False) | _shifted(a, -1, 0, False)
    return a


def erode(a: np.ndarray, k: int) -> np.ndarray:
    return ~dilate(~a, k)


def open_close(a: np.ndarray, k: int) -> np.ndarray:
    """Small areas and gaps go: erode, dilate twice as much, erode."""
    return erode(dilate(erode(a, k), 2 * k), k)


def trace(a: np.ndarray) -> list[np.ndarray]:
    """The outlines of the set pixels as closed rings of pixel corners: outer ones clockwise in pixel axes (y down), holes the other way."""
    padded = np.pad(a, 1)
    out_of: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for dy, dx, (ay, ax), (by, bx) in ((-1, 0, (0, 0), (0, 1)), (0, 1, (0, 1), (1, 1)), (1, 0, (1, 1), (1, 0)), (0, -1, (1, 0), (0, 0))):
        edge = padded & ~_shifted(padded, -dy, -dx, False)
        for y, x in zip(*np.nonzero(edge), strict=True):
            out_of.setdefault((x - 1 + ax, y - 1 + ay), []).append((x - 1 + bx, y - 1 + by))
    rings = []
    while out_of:
        start = next(iter(out_of))
        ring, at, came = [start], start, None
        while True:
            ways = out_of[at]
            if len(ways) > 1 and came is not None:  # a touching corner: turn right, so that areas stay apart
                d = (at[0] - came[0], at[1] - came[1])
                ways.sort(key=lambda n: d[0] * (n[1] - at[1]) - d[1] * (n[0] - at[0]))
            nxt = ways.pop()
            if not ways:
                del out_of[at]
            came, at = at, nxt
            if at == start:
                ring.append(at)
                break
            d0 = (ring[-1][0] - ring[-2][0], ring[-1][1] - ring[-2][1]) if len(ring) > 1 else None
            if d0 and (d0[0] * (at[1] - ring[-1][1]) == d0[1] * (at[0] - ring[-1][0])):
                ring[-1] = at
            else:
                ring.append(at)
        rings.append(np.array(ring, float))
    return rings


def ring_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float(np.sum(x[:-1] * y[1:] - x[1:] * y[:-1]) / 2)


def check_raster(image_extent: int, image_buffer: int, margin: float) -> int:
    """Validates the parameters; returns the buffer rounded up to 64 pixels."""
    if not 1024 <= image_extent <= 65536 or image_extent & (image_extent - 1):
        raise ValueError("image_extent is a power of two from 1024 to 65536")
    if not 0 <= margin <= 0.5:
        raise ValueError("margin is from 0 to 0.5")
    return 64 * math.ceil(max(image_buffer, margin * image_extent) / 64)


def raster_union(polygons: DataFrame, zoom: int, extent: int = 1024, buffer: int = 10, min_area: float = 0.0, group: str | None = None, tiles: DataFrame | None = None) -> DataFrame:
    """The union of polygons (rings: array<array<struct<x,y>>>, mercator) by tile and group: rasterised, opened and closed, traced.

    A polygon goes to the tiles that its box covers. Returns (x, y[, group], ring array<struct<x,y>>, area) with a row for each
    outline; holes have a negative area.
    """
    return _union_by_tile(polygons.withColumn("shape", F.lit(0)), zoom, extent, 0, {0: lambda image: open_close(image, buffer) if buffer else image}, min_area, group, 0.0, tiles)


def builtup(sources: list[tuple[DataFrame, int]], zoom: int, extent: int = 1024, min_area: float = 0.0, tiles: DataFrame | None = None) -> DataFrame:
    """Several polygon tables, each with its own buffer in pixels, merged by tile into one set of outlines."""
    marked = [d.select("rings", F.lit(i).alias("shape")) for i, (d, _) in enumerate(sources)]
    rows = reduce(DataFrame.unionByName, marked)
    shapes = {i: (lambda image, k=k: open_close(image, k) if k else image) for i, (_, k) in enumerate(sources)}
    return _union_by_tile(rows, zoom, extent, 0, shapes, min_area, None, 0.0, tiles)


def vector_union(polygons: DataFrame, zoom: int, buffer_size: float = 10.0, margin: float = 0.0, extent: int = 1024, group: str | None = None, tiles: DataFrame | None = None) -> DataFrame:
    """The union of polygons by tile (and group), with gaps of less than twice ``buffer_size`` closed and spurs as narrow taken off.

    Buffers grow by the size, shrink by twice as much and grow again, on a raster of ``extent`` pixels a tile with round buffers, so
    outlines are exact to a pixel only. Sources within ``margin`` parts of a tile around it take part; the result lies in the tile.
    """
    size = T.CIRCUMFERENCE / (1 << zoom)
    pad = math.ceil(extent * margin) + 2 * math.ceil(buffer_size * extent / size) + 1
    radius = buffer_size * extent / size

    def shape(image: np.ndarray) -> np.ndarray:
        return grow(~grow(~grow(image, radius), 2 * radius), radius)

    return _union_by_tile(polygons.withColumn("shape", F.lit(0)), zoom, extent, pad, {0: shape}, 0.0, group, margin, tiles)


def grow(a: np.ndarray, radius: float) -> np.ndarray:
    """Every pixel within the radius of a set one."""
    out = a.copy()
    whole = int(radius)
    for dy in range(-whole, whole + 1):
        reach = int(math.sqrt(radius * radius - dy * dy))
        if dy == 0 and reach == 0:
            continue
        row, span = _shifted(a, dy, 0, False), 1
        # a run of reach pixels to both sides, doubled
        line = row
        while span < 2 * reach + 1:
            step = min(span, 2 * reach + 1 - span)
            line = line | _shifted(line, 0, step, False)
            span += step
        out |= np.pad(line, ((0, 0), (0, reach)))[:, reach:] if reach else line
    return out


def _union_by_tile(polygons: DataFrame, zoom: int, extent: int, pad: int, shapes: dict, min_area: float, group: str | None, margin: float, tiles: DataFrame | None) -> DataFrame:
    groups, size = [group] if group else [], T.CIRCUMFERENCE / (1 << zoom)
    outer = F.get("rings", F.lit(0))
    xs, ys = F.transform(outer, lambda p: p["x"]), F.transform(outer, lambda p: p["y"])
    wide = margin * size
    x0, y1 = T.tile_of(F.array_min(xs) - wide, F.array_min(ys) - wide, zoom)
    x1, y0 = T.tile_of(F.array_max(xs) + wide, F.array_max(ys) + wide, zoom)
    lo, hi = fresh("lo"), fresh("hi")
    cut = polygons.select("rings", "shape", *groups, F.explode(F.sequence(x0, x1)).alias("x"), y0.alias(lo), y1.alias(hi)).select("rings", "shape", *groups, "x", F.explode(F.sequence(lo, hi)).alias("y"))
    cut = cut if tiles is None else cut.join(tiles.select("x", "y").distinct(), ["x", "y"], "left_semi")
    rows = cut.select("x", "y", *groups, "shape", F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))).alias("rings"))

    def union(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = int(pdf.x.iloc[0]), int(pdf.y.iloc[0])
        left, top = x * size - T.CIRCUMFERENCE / 2, T.CIRCUMFERENCE / 2 - y * size
        whole = np.zeros((extent + 2 * pad, extent + 2 * pad), bool)
        for which, own in pdf.groupby("shape"):
            image = np.zeros_like(whole)
            for rings in own.rings:
                image |= fill_polygon([(np.array([list(p) for p in r]) - (left, top)) * (extent / size, -extent / size) + pad for r in rings], extent + 2 * pad)
            whole |= shapes[which](image)
        out = []
        for ring in trace(whole[pad : pad + extent, pad : pad + extent]):
            world = ring * (size / extent, -size / extent) + (left, top)
            area = ring_area(world)
            if abs(area) >= min_area:
                out.append({"x": x, "y": y, **({group: pdf[group].iloc[0]} if group else {}), "ring": [{"x": float(a), "y": float(b)} for a, b in world], "area": -area})
        return pd.DataFrame(out, columns=["x", "y", *groups, "ring", "area"])

    kind = f"{group} {polygons.schema[group].dataType.simpleString()}, " if group else ""
    return rows.groupBy("x", "y", *groups).applyInPandas(union, f"x int, y int, {kind}ring array<struct<x:double,y:double>>, area double")


def existing_deleted(stored: DataFrame, made: DataFrame, tiles: DataFrame) -> DataFrame:
    """A tile table after tiles (x, y) were made again: their old rows go, the new ones come."""
    return stored.join(tiles.select("x", "y").distinct(), ["x", "y"], "left_anti").unionByName(made)


# --- rivers --------------------------------------------------------------------------------------------------------


def area_widths(areas: DataFrame) -> DataFrame:
    """Areas (id, width, rings) with a width: twice the radius of the largest circle inside, where none is given."""
    asked = F.when(F.col("width").isNull(), F.col("rings"))
    return dealt(areas, "id").withColumn("width", F.coalesce("width", 2 * S.pole_udf(asked, F.lit(1.0))["distance"]))


def box_level(lo_x: Column, lo_y: Column, hi_x: Column, hi_y: Column) -> Column:
    """The least power of two that is as wide and high as the box; a cell of that width meets no box of the level in over two columns or rows."""
    return F.ceil(F.log2(F.greatest(hi_x - lo_x, hi_y - lo_y, F.lit(1e-6)))).cast("int")


def box_pairs(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Rows of both sides whose boxes (ax0, ay0, ax1, ay1 and bx0, by0, bx1, by1) have a point in common, each pair once.

    Boxes of each size have cells of that size. A pair meets in the cells of its larger box's size, in the one that holds the lower left
    corner of what the boxes share. A box lies in four cells at most of each size that the other side has, so what meets
    in a cell is near, however dense or mixed the boxes are.
    """
    at, level_a, level_b, cx, cy, level = map(fresh, ("at", "level_a", "level_b", "cx", "cy", "level"))
    boxes = [[F.col(f"{side}{k}") for k in ("x0", "y0", "x1", "y1")] for side in ("a", "b")]
    sides = [rows.withColumn(own, box_level(*box)) for rows, own, box in zip((mine, theirs), (level_a, level_b), boxes, strict=True)]
    # a handful: sizes are logarithmic
    found = [sorted(r[0] for r in rows.select(own).distinct().collect() if r[0] is not None) for rows, own in zip(sides, (level_a, level_b), strict=True)]

    def dealt(rows: DataFrame, own: str, box: list[Column], others: list[int]) -> DataFrame:
        larger = F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda v: v > F.col(own))
        each = rows.withColumn(level, F.explode(F.concat(F.array(own), larger)))
        wide = F.pow(F.lit(2.0), F.col(level))
        return each.withColumn(at, F.explode(cells_of(*box, wide))).select("*", F.col(at)["cx"].alias(cx), F.col(at)["cy"].alias(cy)).drop(at)

    a, b = dealt(sides[0], level_a, boxes[0], found[1]), dealt(sides[1], level_b, boxes[1], found[0])
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = boxes
    wide = F.pow(F.lit(2.0), F.col(level))
    meet = (ax0 <= bx1) & (bx0 <= ax1) & (ay0 <= by1) & (by0 <= ay1)
    once = (F.floor(F.greatest(ax0, bx0) / wide) == F.col(cx)) & (F.floor(F.greatest(ay0, by0) / wide) == F.col(cy))
    both = a.hint("merge").join(b, [level, cx, cy])
    return both.filter((F.col(level) == F.greatest(level_a, level_b)) & meet & once).drop(level, cx, cy, level_a, level_b)


def line_widths(lines: DataFrame, areas: DataFrame) -> DataFrame:
    """Lines (id, width, line) whose width is null get that of the areas (id, width, rings) that cover them together: the mean, weighted by
    the length inside each. Lines of two points, and those that areas leave uncovered anywhere, keep null.

    Lines meet areas whose boxes meet theirs; the parts of a line inside an area are intervals along the line, so whether all
    are covered shows by merging them.
    """
    box = lambda side, points: [v.alias(f"{side}{k}") for k, v in zip(("x0", "y0", "x1", "y1"), box_of(points), strict=True)]
    asked = lines.filter(F.col("width").isNull() & (F.size("line") > 2))
    mine = asked.select("id", "line", *box("a", F.col("line")))
    theirs = area_widths(areas).select(F.col("width").alias("area_width"), "rings", *box("b", F.get("rings", F.lit(0))))
    inside = dealt(box_pairs(mine, theirs), "id").select("id", "area_width", G.length(F.col("line")).alias("size"), F.explode(S.inside_udf("line", "rings")).alias("v"))
    own = inside.groupBy("id", "size").agg(F.array_sort(F.collect_list(F.struct(F.col("v.lo").alias("lo"), F.col("v.hi").alias("hi")))).alias("vs"), F.sum((F.col("v.hi") - F.col("v.lo")) * F.col("area_width")).alias("weighted"))
    slack = F.col("size") * 1e-9
    reach = F.aggregate("vs", F.lit(0.0), lambda a, v: F.when(v["lo"] <= a + slack, F.greatest(a, v["hi"])).otherwise(a))
    found = own.filter(reach >= F.col("size") - slack).select("id", (F.col("weighted") / F.col("size")).alias("found"))
    return lines.join(found, "id", "left").withColumn("width", F.coalesce("width", "found")).drop("found")


def river_segments(lines: DataFrame) -> DataFrame:
    """(id, way, from_node, to_node, width) of lines (id, width, line): a row for each segment; nodes are points, width 0 where none is known."""
    n = F.size("line")
    pairs = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.struct(F.get("line", i).alias("a"), F.get("line", i + 1).alias("b")))
    rows = lines.filter(n > 1).select(F.col("id").alias("way"), "width", F.posexplode(pairs).alias("i", "s"))
    return rows.select(F.struct("way", "i").alias("id"), "way", F.col("s.a").alias("from_node"), F.col("s.b").alias("to_node"), F.coalesce("width", F.lit(0.0)).alias("width"))


def chains(edges: DataFrame) -> DataFrame:
    """Edges (id, from_node, to_node, width) joined where exactly one ends and one begins: (chain, from_node, to_node, nodes, width), named by the
    first edge, a ring by its least; the width is the largest.

    No side of a join is broadcast: all hold about as many rows as there are edges, though their files are small.

    By pointer jumping: every edge knows an edge up its chain, which lies twice as far away after each round, so rounds grow as the
    logarithm of the longest chain.
    """
    ends = edges.select(F.col("from_node").alias("node"), F.lit(1).alias("begins")).unionByName(edges.select(F.col("to_node").alias("node"), F.lit(0).alias("begins")))
    order = ends.groupBy("node").agg(F.count("*").alias("n"), F.sum("begins").alias("begins")).filter("n = 2 and begins = 1").select("node")
    before = edges.select(F.col("id").alias("up"), F.col("to_node").alias("node")).hint("merge").join(order, "node")
    links = edges.select("id", F.col("from_node").alias("node")).hint("merge").join(before, "node").filter("id <> up").select("id", "up")
    state = edges.select("id").hint("merge").join(links, "id", "left").select("id", F.coalesce("up", "id").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("hops"), F.least("id", F.coalesce("up", "id")).alias("least"))

    def jumped(state: DataFrame) -> DataFrame:
        most = state.count()
        state, reach = materialize(state, "jumps"), 1
        while reach < 2 * most:
            above = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("hops").alias("more"), F.col("least").alias("low"))
            new = materialize(state.hint("merge").join(above, "up").select("id", F.col("next").alias("up"), (F.col("hops") + F.col("more")).alias("hops"), F.least("least", "low").alias("least"), (F.col("next") != F.col("up")).alias("moved")), "jumps")
            state, reach = new.drop("moved"), reach * 2
            if new.filter("moved").isEmpty():
                break
        return state

    state = materialize(state, "jumps")
    done = jumped(state)
    # an edge whose upper end isn't a root is on a ring, which is cut before its least edge
    roots = done.filter("id = up and hops = 0").select(F.col("id").alias("up"))
    ring = materialize(done.hint("merge").join(roots, "up", "left_anti").select("id", "least"), "rings")
    if not ring.isEmpty():
        heads = ring.filter("id = least").select("id", F.lit(True).alias("head"))
        cut = state.hint("merge").join(heads, "id", "left").select("id", F.when(F.col("head"), F.col("id")).otherwise(F.col("up")).alias("up"), F.when(F.col("head"), F.lit(0)).otherwise(F.col("hops")).cast("long").alias("hops"), "least")
        done = jumped(cut)
    rows = edges.hint("merge").join(done.select("id", F.col("up").alias("chain"), "hops"), "id")
    made = rows.groupBy("chain").agg(F.min_by("from_node", "hops").alias("from_node"), F.max_by("to_node", "hops").alias("to_node"), F.array_sort(F.collect_list(F.struct("hops", "from_node"))).alias("nodes"), F.max("width").alias("width"))
    return made.select("chain", "from_node", "to_node", F.concat(F.transform("nodes", lambda x: x["from_node"]), F.array("to_node")).alias("nodes"), "width")


def rivers(lines: DataFrame, areas: DataFrame) -> DataFrame:
    """River lines (id, width, line) as chains (chain, way, nodes, width): widths of areas carried onto the lines they cover, segments joined
    at nodes of order two, and every chain at least as wide as what flows into it."""
    whole = chains(river_segments(line_widths(lines, areas)))
    wide = propagate_width(whole.select(F.col("chain").alias("id"), "from_node", "to_node", "width", "nodes"))
    return wide.select(F.col("id").alias("chain"), F.col("id.way").alias("way"), "nodes", "width")


def propagate_width(edges: DataFrame) -> DataFrame:
    """River segments (id, from_node, to_node, width) with ``width`` at least that of what flows into them.

    Each round hands widths one segment down; only nodes whose width grew take part in the next. Widths only grow to a maximum
    that some segment has, so loops settle too, after as many rounds as the longest way that a width travels; :func:`chains` makes
    those ways short.
    """
    best = materialize(edges.groupBy(F.col("to_node").alias("node")).agg(F.max("width").alias("width")), "widths")
    grown = best
    while True:
        moved = edges.select("from_node", "to_node").join(grown, F.col("from_node") == F.col("node")).groupBy(F.col("to_node").alias("node")).agg(F.max("width").alias("new"))
        grown = materialize(moved.join(best, "node").filter("new > width").select("node", F.col("new").alias("width")), "grown")
        if grown.isEmpty():
            break
        best = materialize(best.unionByName(grown).groupBy("node").agg(F.max("width").alias("width")), "widths")
    inflow = fresh("in")
    come = best.select(F.col("node").alias("from_node"), F.col("width").alias(inflow))
    return edges.join(come, "from_node", "left").withColumn("width", F.greatest("width", F.coalesce(inflow, F.col("width")))).drop(inflow)


Generalizer = Callable[..., DataFrame]
STRATEGIES: dict[str, Generalizer] = {"discrete-isolation": discrete_isolation, "raster-union": raster_union, "builtup": builtup, "vector-union": vector_union, "rivers": rivers}


TILED = {"raster-union", "builtup", "vector-union"}


def run_gen(name: str, *tables, stored: DataFrame | None = None, expired: DataFrame | None = None, post: Callable[[DataFrame], None] | None = None, **params) -> DataFrame:
    """Runs a strategy on its tables. One that goes by tiles makes all that its sources cover, or in append mode those of ``expired`` (x, y), whose
    rows in ``stored`` it replaces. ``post`` is called with the result, say to gather statistics."""
    if name not in STRATEGIES:
        raise ValueError(f"unknown generalizer {name!r}: one of {', '.join(sorted(STRATEGIES))}")
    if "zoom" in params and not (isinstance(params["zoom"], int) and 0 <= params["zoom"] <= 20):
        raise ValueError("zoom is a whole number from 0 to 20")
    if expired is None:
        out = STRATEGIES[name](*tables, **params)
    elif name not in TILED or stored is None:
        raise ValueError(f"{name!r} can't be run for some tiles of a stored table")
    else:
        out = existing_deleted(stored, STRATEGIES[name](*tables, tiles=expired, **params), expired)
    if post:
        post(out)
    return out
