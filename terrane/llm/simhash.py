"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``radius`` bits have a common variant within half the radius of either. Emitting
the whole half-radius ball of 64 bits costs 2,081 rows for each fingerprint at radius 4, many times the size of a document.
So the ball is taken on kept bits: the 64 bits are cut into ``blocks`` blocks; some block holds at least its share of
the differing bits, so on the others at most ``radius * (blocks - 1) // blocks`` bits differ, and the variants within half
of that are emitted for each block left out: 132 rows for three blocks. ``blocks=1`` is the plain ball. The variants are
shuffled, and colliding pairs are verified on all 64 bits, so no link is lost and none is added.

A bucket's members never become all their pairs: a search from member to member over the bucket gives a spanning forest of
its links, at most one link a member. A bucket of more than ``bucket_limit`` different fingerprints isn't searched; its
members go through the plain ball, where a common variant alone proves a link, so that the smallest member is linked to
the others: linear in the members, and exact.

Equal fingerprints are one row before all this, so copies cost nothing. Components are found by alternating large-star and
small-star rounds over tables in the shared folder.

Defined results: a null or blank text has fingerprint zero and links as any other; rows that repeat a doc_id are
reported each, a null id is no component's name unless all its ids are null; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, leave_out, materialize

RADIUS, BLOCKS, SHINGLE, BUCKET_LIMIT = 4, 3, 4, 4096


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the UTF-8 text: a bit is 1 if it is set in over half of the shingles' hashes."""
    from xxhash import xxh64_intdigest as xxh64

    words = (text or b"").lower().split()  # of bytes: A-Z, and ASCII white space only
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= size:
        return xxh64(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hashes = np.fromiter([xxh64(joined[a:b], 42) for a, b in zip(starts[: n - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64, n - size + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[i : i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py(), size) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(of, f"id {kind}, fp long")


def _balls(bits: list[int], radius: int) -> list[int]:
    """Masks that flip up to ``radius`` of the bits, as signed longs."""
    masks = [0]
    ring = [(0, 0)]
    for _ in range(radius):
        ring = [(m ^ (1 << bits[j]), j + 1) for m, i in ring for j in range(i, len(bits))]
        masks += [m for m, _ in ring]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def coarse_balls(radius: int = RADIUS, blocks: int = BLOCKS) -> list[tuple[int, list[int]]]:
    """For each block left out: the mask of kept bits and the flips to emit. One block: all bits are kept."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    out = []
    for b in range(blocks):
        kept = [i for i in range(64) if blocks == 1 or not edges[b] <= i < edges[b + 1]]
        most = radius if blocks == 1 else radius * (blocks - 1) // blocks
        mask = sum(1 << i for i in kept)
        out.append((mask - (1 << 64) if mask >> 63 else mask, _balls(kept, (most + 1) // 2)))
    return out


def _variants(nodes: DataFrame, balls: list[tuple[int, list[int]]]) -> DataFrame:
    """(variant, fp): variants of different blocks may coincide, which costs a verification only."""

    def ball(kept: int, flips: list[int]):
        return F.transform(F.array(*map(F.lit, flips)), lambda m: F.col("fp").bitwiseAND(F.lit(kept)).bitwiseXOR(m))

    each = [ball(kept, flips) for kept, flips in balls]
    return nodes.select("fp", F.explode(F.concat(*each) if len(each) > 1 else each[0]).alias("variant"))


def forest(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what is connected among different fingerprints (uint64): each new member is linked to one found before."""
    links, rest = [], members
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= radius
            found = rest[near]
            if len(found):
                links += [(int(at), int(x)) for x in found]
                queue += list(found)
                rest = rest[~near]
    return links


def _signed(x: list[int]) -> np.ndarray:
    return np.array(x, dtype=np.uint64).view(np.int64)


def _bucket_links(radius: int, limit: int):
    """Over rows sorted by (variant, fp): links (a, b) of small buckets, (fp, null) for each member of a large one."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # links and members already told, bounded: a miss only repeats a row
        kept_v, kept_f = np.empty(0, np.int64), np.empty(0, np.int64)
        large: int | None = None  # the variant of the bucket being streamed as large

        def told(a: list[int], b: list[int | None]) -> Iterator[pa.RecordBatch]:
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        def tell(members: list[int], a: list, b: list) -> None:
            for x in members:
                if (x, x) not in seen:
                    seen.add((x, x))
                    a.append(x)
                    b.append(None)

        def settle(v: np.ndarray, f: np.ndarray, last: bool) -> tuple[list[int], list[int | None]]:
            """Closes every bucket but the last one, which may go on in the next batch."""
            nonlocal large, kept_v, kept_f
            a: list[int] = []
            b: list[int | None] = []
            if not len(v):
                return a, b
            first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
            ends = np.append(first[1:], len(v))
            whole = len(first) if last else len(first) - 1
            for i in np.flatnonzero((ends[:whole] - first[:whole] > 1) | (v[first[:whole]] == large if large is not None else False)):
                members = np.unique(f[first[i] : ends[i]])
                if v[first[i]] == large or len(members) > limit:
                    tell(members.tolist(), a, b)
                    continue
                for x, y in forest(members.view(np.uint64), radius):
                    if (x, y) not in seen:
                        seen.add((x, y))
                        p, q = _signed([x, y]).tolist()
                        a.append(p)
                        b.append(q)
            kept_v, kept_f = (v[:0], f[:0]) if last else (v[first[-1] :], f[first[-1] :])
            if len(kept_v) and (kept_v[0] == large or len(kept_v) > limit and len(np.unique(kept_f)) > limit):
                large = int(kept_v[0])
                tell(np.unique(kept_f).tolist(), a, b)
                kept_v, kept_f = v[:0], f[:0]
            if len(seen) > 500_000:
                seen.clear()
            return a, b

        for batch in batches:
            v = np.concatenate((kept_v, batch.column(0).to_numpy()))
            f = np.concatenate((kept_f, batch.column(1).to_numpy()))
            yield from told(*settle(v, f, False))
        yield from told(*settle(kept_v, kept_f, True))

    return of


def links(nodes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(a, b): links among different fingerprints (column fp, distinct) that connect all that is within ``radius``."""
    # 8 bytes a node become a hundred rows and more: dealt anew first, as file splits would be far too few
    spread = nodes.repartition(max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), nodes.sparkSession.sparkContext.defaultParallelism), "fp")
    rows = _variants(spread, coarse_balls(radius, blocks))
    rows = rows.select("variant", "fp").repartition("variant").sortWithinPartitions("variant", "fp")
    found = materialize(rows.mapInArrow(_bucket_links(radius, bucket_limit), "a long, b long"), "links")
    pairs = found.filter("b is not null")
    members = found.filter("b is null").select(F.col("a").alias("fp")).distinct()
    full = _variants(members, coarse_balls(radius, 1))
    centres = full.groupBy("variant").agg(F.min("fp").alias("b"), F.max("fp").alias("__most")).filter("b < __most").drop("__most")
    stars = full.join(centres, "variant").filter("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b): every node a that isn't the smallest of its component, with that smallest node b.

    Alternates large-star and small-star; each round is written to the shared folder. Every round joins linear work;
    ``rounds`` only guards against a fault and is never reached by a graph of this kind (the rounds grow as the square of
    the logarithm of the nodes); reaching it raises.
    """
    cur = materialize(edges, "edges")
    before = None
    for _ in range(rounds):
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("x"), F.col("m").alias("y")), F.struct(F.col("a").alias("x"), F.col("m").alias("y")))).alias("e"))
        was, cur = cur, materialize(small.select(F.col("e.x").alias("a"), F.col("e.y").alias("b")).filter("a <> b").distinct(), "edges")
        discard(was)
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return cur
        before = now
    raise RuntimeError("components did not settle")


def _rooted(prints: DataFrame, radius: int, blocks: int, bucket_limit: int) -> DataFrame:
    """(fp, rep, root) of each different fingerprint: its smallest id, and its component's smallest fingerprint."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("id").alias("rep")), "nodes")
    roots = components(links(nodes.select("fp"), radius, blocks, bucket_limit))
    return nodes.join(roots, nodes.fp == roots.a, "left").select("fp", "rep", F.coalesce("b", "fp").alias("root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, blocks: int = BLOCKS, bucket_limit: int = BUCKET_LIMIT, size: int = SHINGLE) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (the component's smallest id)."""
    prints = materialize(fingerprints(df, id_col, text_col, size), "fingerprints")
    rooted = _rooted(prints, radius, blocks, bucket_limit)
    names = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_fp = rooted.join(names, "root").select("fp", "component_id")
    return prints.join(of_fp, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, blocks: int = BLOCKS, bucket_limit: int = BUCKET_LIMIT, size: int = SHINGLE) -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest id, nulls last, and of its texts the one with the least hash.

    Rows are told apart by id and text, so that an id's other texts, and different texts without an id, stay or go by their
    own components; rows that are equal in both are one. Only ids, hashes and fingerprints travel, no texts.
    """
    text = F.col(text_col).cast("string")
    digest = F.concat(F.hex(F.xxhash64(text)), F.hex(F.xxhash64(F.lit(1), text)))  # 128 bits
    keyed = df.select(F.struct(F.col(id_col).isNull().alias("late"), F.col(id_col).alias("id"), digest.alias("digest")).alias("key"), text.alias("text"))
    prints = materialize(fingerprints(keyed, "key", "text", size), "fingerprints").withColumnRenamed("id", "key")
    each = prints.groupBy("key", "fp").agg(F.count(F.lit(1)).alias("n"))
    rooted = _rooted(prints.withColumnRenamed("key", "id"), radius, blocks, bucket_limit)
    kept = rooted.groupBy("root").agg(F.min("rep").alias("key")).select("key", F.lit(True).alias("kept"))
    keys = each.join(kept, "key", "left").filter("kept is null or n > 1")
    return leave_out(df, keys.select("key.id", "key.digest", F.col("kept").isNull().alias("gone")), id_col, digest)
