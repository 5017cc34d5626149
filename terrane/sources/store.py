"""Intermediate tables in the folder that driver and executors share, and global ranks without a single-task sort."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder, but only on a local master.

    On a cluster executors don't share the driver's folders, so tables written there would be lost: that is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="terrane-shared-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def fresh(name: str) -> str:
    """A column name that no input has."""
    return f"__{name}_{uuid.uuid4().hex[:12]}"


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: its lineage is cut, and a lost executor costs a reread.

    The table goes when the driver ends, since plans that are still lazy refer to it until then, or by :func:`discard`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)

    def forget() -> None:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM has ended before
            pass

    atexit.register(forget)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what :func:`materialize` wrote; no plan that is still to run may refer to it."""
    delete(df.sparkSession, df._stored_at)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over all shuffle partitions, for steps that cost far more than their bytes tell: neither few large row groups nor adaptive
    execution, which joins small partitions, leaves them to a few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def with_rank(df: DataFrame, order: list[Column], name: str, partitions: int | None = None) -> DataFrame:
    """``df`` with the 0-based rank of each row in a total order: ranges are sorted apart, then shifted by the rows before.

    The driver sees one count for each range. ``order`` must have no ties, or their ranks are arbitrary.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at, local, before_ = map(fresh, ("range", "local", "before"))
    ranged = materialize(df.repartitionByRange(n, *order).withColumn(at, F.spark_partition_id()), "ranges")
    counts = sorted((r[at], r["count"]) for r in ranged.groupBy(at).count().collect())
    before, rows = 0, []
    for k, count in counts:
        rows.append((k, before))
        before += count
    shift = df.sparkSession.createDataFrame(rows, f"{at} int, {before_} long")  # one row for each range
    number = F.row_number().over(Window.partitionBy(at).orderBy(*order)) - 1
    return ranged.withColumn(local, number).join(F.broadcast(shift), at).withColumn(name, F.col(before_) + F.col(local)).drop(at, local, before_)
