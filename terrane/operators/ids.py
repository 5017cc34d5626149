"""Sets of ids and the merge of object versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_version(objects: DataFrame, key: list[str], version: str = "version", tie: str | None = None) -> DataFrame:
    """The newest version of each object of several inputs."""
    order = [F.col(version).desc_nulls_last()] + ([F.col(tie).desc_nulls_last()] if tie else [])
    return objects.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")


def order_violations(objects: DataFrame, kind: str = "type", ident: str = "id", position: str = "pos") -> DataFrame:
    """(reason, n) of an input that should be ordered by type and id: negative ids, duplicates, and wrong order.

    Order is checked against the row before, within parts of the input that ``position`` numbers; no global sort.
    """
    before = Window.partitionBy("__part").orderBy(position)
    rank = F.when(F.col(kind) == "n", 1).when(F.col(kind) == "w", 2).otherwise(3)
    rows = objects.withColumn("__part", F.floor(F.col(position) / 1_000_000)).withColumn("__rank", rank)
    rows = rows.withColumn("__was", F.lag(F.struct("__rank", F.col(ident).alias("__id"))).over(before)).withColumn("__is", F.struct("__rank", F.col(ident).alias("__id")))
    reason = F.when(F.col(ident) < 0, "negative id").when(F.col("__was") == F.col("__is"), "duplicate").when(F.col("__was") > F.col("__is"), "order")
    return rows.select(reason.alias("reason")).filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def union_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").union(b.select("id")).distinct()


def minus_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("id"), "id", "left_anti")


def in_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("id"), "id", "left_semi")


def within(nodes: DataFrame, min_lon: int, min_lat: int, max_lon: int, max_lat: int) -> DataFrame:
    """Nodes in a box of 1e-7 degrees; the comparison reaches the scan."""
    return nodes.filter(F.col("lon_e7").between(min_lon, max_lon) & F.col("lat_e7").between(min_lat, max_lat))
