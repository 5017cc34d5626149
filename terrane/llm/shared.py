"""Small helpers of all operators; tables in the shared folder are the engine's (``sources.store``)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import discard, fresh, materialize, shared_dir

__all__ = ["ascii_lower", "discard", "fresh", "int_lists", "leave_out", "materialize", "shared_dir", "table"]

#: Keys of rows that go are broadcast up to so many (some 100 MB); beyond, both sides are shuffled.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def int_lists(each: list[np.ndarray]) -> pa.Array:
    """list<int32> of arrays of 32-bit integers, without a step for each integer."""
    ends = np.cumsum([0, *map(len, each)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(each).astype(np.int32) if each else np.empty(0, np.int32)))


def ascii_lower(col):
    """Lower-case A-Z only, as a native expression.

    ``lower`` has a fast path but also changes letters beyond ASCII, so it serves only texts all of ASCII, which have as many
    bytes as characters; the others go through ``translate``.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, upper, upper.lower()))


def leave_out(df: DataFrame, keys: DataFrame, id_col: str, digest) -> DataFrame:
    """``df`` without the rows that ``keys`` (id, digest, gone; each key once) calls gone.

    A key that isn't gone says that several rows have it, of which the one with the least JSON form stays; it is found by a partial
    aggregation, so the rows of a key never meet in one task. ``digest`` is the expression on ``df`` that keys were made with.
    The keys are counted: up to ``BROADCAST_ROWS`` they are broadcast, so that texts stay where they are.
    """
    keys = materialize(keys, "keys")
    at_id, at_digest, gone = fresh("id"), fresh("digest"), fresh("gone")
    counted = keys.agg(F.count("*").alias("n"), F.count_if(~F.col("gone")).alias("repeated")).first()
    known = keys.select(F.col("id").alias(at_id), F.col("digest").alias(at_digest), F.col("gone").alias(gone))
    known = F.broadcast(known) if counted.n <= BROADCAST_ROWS else known
    own = fresh("own")
    rows = df.withColumn(own, digest)
    on = rows[id_col].eqNullSafe(F.col(at_id)) & (rows[own] == F.col(at_digest))
    if not counted.repeated:
        return rows.join(known, on, "left_anti").select(df.columns)
    marked = rows.join(known, on, "left")
    row, order = F.struct(*df.columns), F.to_json(F.struct(*df.columns))
    once = marked.filter(~F.col(gone)).groupBy(id_col, own).agg(F.min_by(row, order).alias(own + "r")).select(own + "r.*")
    return marked.filter(F.col(gone).isNull()).select(df.columns).unionByName(once)
