"""Map tiles: native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CIRCUMFERENCE = 40075016.68
MAX_ZOOM = 32


def tile_coord(x: Column, y: Column, zoom: int) -> tuple[Column, Column]:
    """Position of mercator coordinates in units of tiles."""
    width = float(1 << zoom)
    return (0.5 + x / CIRCUMFERENCE) * width, (0.5 - y / CIRCUMFERENCE) * width


def tile_of(x: Column, y: Column, zoom: int) -> tuple[Column, Column]:
    """The tile of mercator coordinates, clamped to the map."""
    most = (1 << zoom) - 1
    return tuple(F.least(F.greatest(F.floor(t), F.lit(0)), F.lit(most)).cast("int") for t in tile_coord(x, y, zoom))


def _spread(v: Column) -> Column:
    """The 32 bits of v on the even bits of a long."""
    # fixed values: the masks of the usual bit spreading
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def quadkey(x: Column, y: Column) -> Column:
    """x on the even bits, y on the odd ones."""
    return _spread(x.cast("long")).bitwiseOR(F.shiftleft(_spread(y.cast("long")), 1))


def _gather(v: Column) -> Column:
    v = v.bitwiseAND(F.lit(0x5555555555555555))
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        v = v.bitwiseOR(F.shiftrightunsigned(v, shift)).bitwiseAND(F.lit(mask))
    return v


def from_quadkey(key: Column) -> tuple[Column, Column]:
    return _gather(key), _gather(F.shiftrightunsigned(key, 1))


def down(key: Column, levels: int) -> Column:
    """The quadkey of the ancestor that many levels lower."""
    return F.shiftrightunsigned(key, 2 * levels)


def bounds(zoom: Column | int, x: Column, y: Column, margin: float = 0.0) -> Column:
    """Extent in mercator coordinates, with a margin in parts of the tile, clamped to the map."""
    zoom = F.lit(zoom) if isinstance(zoom, int) else zoom
    size = F.lit(CIRCUMFERENCE) / F.pow(F.lit(2.0), zoom)
    half, pad = CIRCUMFERENCE / 2, size * margin
    low = lambda v: F.greatest(v - pad, F.lit(-half))
    high = lambda v: F.least(v + pad, F.lit(half))
    return F.struct(low(x * size - half).alias("min_x"), low(half - (y + 1) * size).alias("min_y"), high((x + 1) * size - half).alias("max_x"), high(half - y * size).alias("max_y"))


def center(zoom: int, x: Column, y: Column) -> Column:
    size = CIRCUMFERENCE / (1 << zoom)
    return F.struct(((x + 0.5) * size - CIRCUMFERENCE / 2).alias("x"), (CIRCUMFERENCE / 2 - (y + 0.5) * size).alias("y"))


def tile_text(zoom: Column, x: Column, y: Column) -> Column:
    return F.concat_ws("/", zoom.cast("string"), x.cast("string"), y.cast("string"))


def parse_tile(text: Column) -> Column:
    """struct(zoom, x, y) of ``z/x/y``; null if it is no tile."""
    ok = text.rlike(r"^\d{1,2}/\d{1,10}/\d{1,10}$")
    part = F.split(text, "/")
    zoom, x, y = (F.get(part, i).try_cast("long") for i in range(3))
    width = F.expr("1L") * F.pow(F.lit(2.0), zoom).cast("long")
    return F.when(ok & (zoom <= MAX_ZOOM) & (x < width) & (y < width), F.struct(zoom.cast("int").alias("zoom"), x.alias("x"), y.alias("y")))


def pyramid(zoom: int, min_zoom: int, x: Column, y: Column) -> Column:
    """array<struct<zoom,x,y>>: the tile and its ancestors down to ``min_zoom``."""
    return F.array(*[F.struct(F.lit(z).alias("zoom"), F.shiftright(x, zoom - z).alias("x"), F.shiftright(y, zoom - z).alias("y")) for z in range(zoom, min_zoom - 1, -1)])


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)
