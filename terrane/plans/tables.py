"""Output tables: declared columns and ids, projection of objects into them, and how they are written."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import shapes as S
from ..functions import tags as G
from ..functions import tiles as T
from ..operators.expire import ExpireConfig, ExpireOutput
from ..sources.store import fresh

# The column types with their other names, and what they are stored as.
ALIASES = {"bool": "boolean", "smallint": "int2", "int": "int4", "integer": "int4", "bigint": "int8"}
STORED = {
    "text": "string", "boolean": "boolean", "int2": "smallint", "int4": "int", "int8": "bigint", "real": "float", "double": "double", "timestamp": "timestamp_ntz",
    "timestamptz": "timestamp", "hstore": "map<string,string>", "json": "string", "jsonb": "string", "direction": "smallint", "id_type": "string", "id_num": "bigint",
}
GEOMETRIES = ("geometry", "point", "linestring", "polygon", "multipoint", "multilinestring", "multipolygon", "geometrycollection")
ID_TYPES = {"node": "N", "way": "W", "relation": "R", "area": "WR", "any": "NWR", "tile": "", "none": ""}


@dataclass(frozen=True)
class Column_:
    """A declared column. ``create_only`` columns are in the table and never written; ``projection`` is a geometry's SRID."""

    name: str
    type: str = "text"
    not_null: bool = False
    create_only: bool = False
    projection: int | None = None
    sql_type: str | None = None

    def __post_init__(self) -> None:
        G.check_identifier(self.name)
        kind = ALIASES.get(self.type.lower(), self.type.lower())
        if kind not in STORED and kind not in GEOMETRIES:
            raise ValueError(f"unknown column type {self.type!r}")
        if self.projection is not None and kind not in GEOMETRIES:
            raise ValueError("only geometry columns have a projection")
        object.__setattr__(self, "type", kind)
        if kind in GEOMETRIES and self.projection is None:
            object.__setattr__(self, "projection", 3857)

    def coerced(self, value: Column, is_text: bool = True) -> Column:
        """A value in the column's type, null where it doesn't fit."""
        if self.type in GEOMETRIES or self.type in ("hstore", "json", "jsonb", "text", "id_type", "id_num"):
            return value
        if self.type == "boolean":
            return G.to_bool(value) if is_text else G.number_to_bool(value)
        if self.type == "direction":
            return G.to_direction(value) if is_text else G.number_to_direction(value)
        if self.type in ("int2", "int4", "int8"):
            bounds = {"int2": G.INT2, "int4": G.INT4, "int8": G.INT8}[self.type]
            return G.to_int(value, bounds) if is_text else G.number_to_int(value, bounds)
        if self.type in ("real", "double"):
            return (G.to_real(value) if is_text else value).cast(STORED[self.type])
        return (value.try_cast(STORED[self.type]) if is_text else G.to_timestamp(value)).cast(STORED[self.type])


@dataclass(frozen=True)
class Expires:
    """What a change of a geometry column expires: into which output (its name), how, and whether only what differs."""

    column: str
    output: str
    limits: ExpireOutput
    config: ExpireConfig = ExpireConfig()
    diff: bool = True


@dataclass(frozen=True)
class Table:
    """An output table. ``ids``: one of ID_TYPES; ``id_columns``: one packed column, or a type and an id column."""

    name: str
    columns: tuple[Column_, ...]
    ids: str = "any"
    id_columns: tuple[str, ...] = ("id",)
    cluster: bool = True
    unique_id: bool = False
    indexes: tuple[dict, ...] = field(default=())
    expires: tuple[Expires, ...] = field(default=())

    def __post_init__(self) -> None:
        for e in self.expires:
            own = next((c for c in self.columns if c.name == e.column), None)
            if own is None or own.type not in GEOMETRIES or own.projection != 3857:
                raise ValueError(f"only geometry columns in 3857 expire tiles, not {e.column!r}")
            if self.ids == "none":
                raise ValueError(f"{self.name} has no ids, so its changes can't expire tiles")
        G.check_identifier(self.name)
        if self.ids not in ID_TYPES:
            raise ValueError(f"unknown id type {self.ids!r}")
        names = [*self.id_columns * (self.ids != "none"), *(c.name for c in self.columns)]
        if len(set(names)) != len(names):
            raise ValueError(f"a column of {self.name} is declared twice")

    def takes(self, kind: str) -> bool:
        """Whether objects of the kind (N, W, R) may go in; relations may go in way tables."""
        return kind in ID_TYPES[self.ids] or (kind == "R" and self.ids == "way")

    def id_values(self, kind: Column, ident: Column) -> list[Column]:
        if self.ids == "none":
            return []
        if len(self.id_columns) == 2:
            return [kind.alias(self.id_columns[0]), ident.alias(self.id_columns[1])]
        # relations in tables of ways or areas have negative ids
        packed = G.pack_any_id(kind, ident) if self.ids == "any" else G.pack_area_id(kind, ident) if self.ids in ("area", "way") else ident
        return [packed.alias(self.id_columns[0])]

    def project(self, objects: DataFrame, values: dict[str, Column], kind: Column, ident: Column, numbers: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
        """(rows, rejected): the declared columns of the objects, and how many lack a column that must not be null.

        ``numbers`` names the values that are numbers rather than a tag's text. rejected: (column, n). Undeclared values are an error.
        """
        unknown = set(values) - {c.name for c in self.columns}
        if unknown:
            raise ValueError(f"{self.name} has no column {sorted(unknown)[0]!r}")
        each = [c.coerced(values[c.name], c.name not in numbers).alias(c.name) if c.name in values else F.lit(None).cast(c.sql_type or STORED.get(c.type, "binary")).alias(c.name) for c in self.columns if not c.create_only]
        rows = objects.select(*self.id_values(kind, ident), *each)
        must = [c.name for c in self.columns if c.not_null and not c.create_only]
        missing = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(c)) for c in must]) if must else F.lit(None).cast("string")
        told = rows.select(missing.alias("column")).filter("column is not null").groupBy("column").agg(F.count("*").alias("n"))
        return (rows.dropna(subset=must) if must else rows), told


    def duplicates(self, rows: DataFrame) -> DataFrame:
        """Ids on several rows (id columns, n), which a table with unique ids must not have."""
        return rows.groupBy(*self.id_columns).agg(F.count("*").alias("n")).filter("n > 1")

    def checked(self, rows: DataFrame) -> DataFrame:
        """The rows; with ``unique_id``, an error if an id is on several."""
        if self.unique_id and not (twice := self.duplicates(rows).limit(1)).isEmpty():
            raise ValueError(f"{self.name} has an id twice: {twice.first().asDict()}")
        return rows


def valid_rows(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose geometry (a whole one) is valid: points and null always, lines of two points, areas of closed rings that don't cross; those
    in 4326 aren't looked at."""
    g = F.col(column)
    rings = F.transform(F.filter(g["parts"], lambda p: p["dim"] == 2), lambda p: p["rings"])
    areas = F.forall(S.all_valid_udf(rings), lambda ok: ok)
    return rows.filter(g.isNull() | (g["srid"] == 4326) | (F.size(rings) == 0) | F.coalesce(areas, F.lit(False)))


def analyze(spark: SparkSession, table: str) -> None:
    """Statistics of a saved table for the optimizer, of all its columns."""
    spark.sql(f"analyze table {table} compute statistics for all columns")


def clustered(rows: DataFrame, x: Column, y: Column, zoom: int = 18, partitions: int | None = None) -> DataFrame:
    """Rows ranged by the quadkey of mercator coordinates, so that near objects share files and their min/max prune scans."""
    tx, ty = T.tile_of(x, y, zoom)
    q = fresh("quadkey")
    keyed = rows.withColumn(q, T.quadkey(tx, ty))
    ranged = keyed.repartitionByRange(partitions, q) if partitions else keyed.repartitionByRange(q)
    return ranged.sortWithinPartitions(q).drop(q)


def write(rows: DataFrame, path: str, backend: str = "parquet") -> None:
    """``null`` discards the rows after making them."""
    if backend == "null":
        rows.write.format("noop").mode("overwrite").save()
    else:
        rows.write.format(backend).mode("overwrite").save(path)


class Context:
    """What a configuration sees: mode, stage and properties, and the tables it declares."""

    def __init__(self, mode: str = "create", properties: dict[str, str] | None = None) -> None:
        if mode not in ("create", "append"):
            raise ValueError("mode is create or append")
        self.mode, self.stage, self.properties, self.tables = mode, 1, dict(properties or {}), {}

    def define_table(self, table: Table) -> Table:
        if table.name in self.tables:
            raise ValueError(f"table {table.name!r} is declared twice")
        self.tables[table.name] = table
        return table

    def run(self, objects: DataFrame, process: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """A callback on a kind of objects is a function from a DataFrame to the rows to insert."""
        return process(objects)
