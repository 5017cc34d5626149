"""Exact deduplication with a heavy-hitter split. Native: DataFrame operations only.

1. Every text becomes the SHA-256 of its normalised form (A-Z lower-cased); the table (id, digest) is written once.
2. ``freqItems`` keeps a Misra-Gries summary of at most ``1 / support`` counters: no digest with more than
   ``support * rows`` rows is missed. Its candidates are counted exactly, which drops false ones.
3. The verified winners, ``1 / support`` rows at most whatever the input, are broadcast: their rows get their answer where
   they are and never meet in one task.
4. All other digests have a bounded share of the rows and go through one ordinary shuffle by digest.

Defined results: a null text is an empty one and equals other empty texts. Rows that repeat a doc_id and text are copies of
one row: each gets the same answer here, and :func:`drop_exact_copies` leaves one. A null id is smaller than any other id;
a group that has only null ids keeps them (:func:`drop_exact_copies`: one of them). An empty table gives an empty result. Only the id and text columns are read, so
extra columns, whatever their names, don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import ascii_lower, leave_out, materialize

SUPPORT = 1e-3


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).alias("id"), F.sha2(ascii_lower(text).cast("binary"), 256).alias("digest"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    keyed = materialize(digests(df, id_col, text_col), "digests")
    candidates = keyed.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    heavy = (
        keyed.join(F.broadcast(candidates), "digest", "left_semi").groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"), F.lit(True).alias("heavy"))
    )  # at most 1 / support rows
    seen = keyed.join(F.broadcast(materialize(heavy, "heavy")), "digest", "left")
    same = Window.partitionBy("digest")
    out = [F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")]
    frequent = seen.filter("heavy").select(*out)
    rest = seen.filter("heavy is null").select("id", "digest", F.max("id").over(same).alias("keep_id"), F.count(F.lit(1)).over(same).alias("group_size"))
    return frequent.unionByName(rest.select(*out))


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows that stay, with all their columns; of several rows with the same id and text, the one with the least JSON form.

    Only keys travel: the ids and digests of the rows that go, which are broadcast while they are few, so texts aren't shuffled.
    """
    found = exact_dedup(df, id_col, text_col, support)
    keys = found.groupBy(F.col(id_col).alias("id"), F.col("text_sha256").alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.bool_and("kept").alias("kept"))
    keys = keys.filter("not kept or n > 1").select("id", "digest", (~F.col("kept")).alias("gone"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return leave_out(df, keys, id_col, F.sha2(ascii_lower(text).cast("binary"), 256))
