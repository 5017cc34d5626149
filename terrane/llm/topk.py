"""Exact top-k inner-product search over norm buckets.

Vectors are integers (each component scaled and floored), ranged by length: logarithmic classes of lengths, the longest first,
are merged or dealt out to groups of about as many vectors each, and a group is cut into buckets by falling length.

1. Every query meets the first group, which holds the longest vectors, and takes its k-th best score there as a threshold
   ``theta``.
2. A later group is visited only by the queries whose threshold its longest vector can reach: |q| * longest >= theta. The other
   pairs of query and group are never made (:func:`visits`).
3. In a group, each bucket is met in turn with the query's threshold, which grows with the vectors met:

   * ``theta / (|q| * longest)`` is the bucket's local cosine threshold. Over 1, nothing in the bucket can enter: skipped.
   * A low threshold leaves cosines nothing to prune by, so length pruning takes the prefix of vectors long enough to reach
     ``theta``; its products are computed as one block.
   * A high threshold picks coordinate pruning: for the query's largest coordinates, a candidate's normalised coordinate must
     lie in an interval around the query's; only vectors inside all intervals are verified.

Bounds are rounded outward, so pruning never drops a candidate that ties. The k best of each group are merged by a second, small
shuffle. Groups grow with the input, from ``GROUP`` vectors to what ``GROUP_BYTES`` hold, so that a query's copies grow less.

Scores are exact: products run in doubles where the lengths bound them by 2^53, in 64-bit integers up to 2^63, and in Python's
integers beyond. A score outside the range of long is returned as the nearest long, and ranks as that one.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, neither as query nor as
candidate; a component whose scaled value leaves the range of doubles counts as the end of that range; a vector of another
dimension than a query's is no candidate for it; ties go to the smaller id; rows that repeat
an id are candidates each, and a query's own id is never one; of queries that share an id, the least vector asks; fewer than k candidates are all
returned; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

K, SCALE, BUCKET, QUERY_BLOCK, GROUP = 20, 64, 2048, 512, 8_192
#: Bytes of a group's vectors at most, and into how many groups vectors are dealt before groups grow.
GROUP_BYTES, GROUPS = 64 << 20, 64
LONG, MOST = 1 << 63, 1.7976931348623157e308


def quantize(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, v array<double>, length): floor(scale * x) of each component, whole numbers in doubles; only whole, finite vectors."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).filter(pa.array(batch.column(1).is_valid()))
            ids = batch.column(0).filter(pa.array(batch.column(1).is_valid()))
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls are NaN
            row = np.repeat(np.arange(len(sizes)), sizes)
            keep = (sizes > 0) & (np.bincount(row, ~np.isfinite(flat), len(sizes)) == 0)
            with np.errstate(over="ignore"):
                v = np.clip(np.floor(flat[keep[row]] * scale), -MOST, MOST)
            ends = np.cumsum([0, *sizes[keep].tolist()]).astype(np.int32)
            most = np.maximum.reduceat(np.abs(v), ends[:-1]) if len(v) else np.empty(0)
            safe = np.where(most > 0, most, 1.0)
            squares = np.add.reduceat((v / np.repeat(safe, sizes[keep])) ** 2, ends[:-1]) if len(v) else np.empty(0)
            with np.errstate(over="ignore"):
                length = np.minimum(np.sqrt(squares) * most, MOST)
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(keep)), pa.ListArray.from_arrays(pa.array(ends), pa.array(v)), pa.array(length)], ["id", "v", "length"])

    rows = df.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(of, "id long, v array<double>, length double")


def _most(v):
    """The largest absolute component."""
    return F.greatest(F.array_max(v), -F.array_min(v))


def length_of(v):
    """The length of a vector of doubles, without overflow."""
    most = _most(v)
    plain = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, c: a + c * c))
    scaled = F.least(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, c: a + (c / most) * (c / most))) * most, F.lit(MOST))
    return F.when(most == 0, 0.0).when(most.between(1e-100, 1e100), plain).otherwise(scaled)


class Best:
    """The k best of each query so far, as arrays: scores fall, ties by rising id. ``floor``: scores below can't enter."""

    def __init__(self, floor: np.ndarray, k: int) -> None:
        self.k, self.floor, self.score, self.id = k, floor, [np.empty(0, np.int64)] * len(floor), [np.empty(0, np.int64)] * len(floor)

    def theta(self, q: int) -> float:
        """The least score that can enter, or less."""
        return max(float(self.floor[q]), float(self.score[q][-1]) if len(self.score[q]) >= self.k else -math.inf)

    def least(self, q: int) -> int | None:
        """The same as an exact integer."""
        known = [int(self.floor[q])] if self.floor[q] > -math.inf else []
        return max([*known, *([int(self.score[q][-1])] if len(self.score[q]) >= self.k else [])], default=None)

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        if (t := self.least(q)) is not None:
            keep = score >= t
            score, ids = score[keep], ids[keep]
        if len(score):
            score, ids = np.concatenate((self.score[q], score)), np.concatenate((self.id[q], ids))
            order = np.lexsort((ids, ~score))[: self.k]  # ~: falls as the score rises, also at the ends of the range
            self.score[q], self.id[q] = score[order], ids[order]


def lengths(v: np.ndarray) -> np.ndarray:
    most = np.abs(v).max(axis=1, initial=0.0)
    safe = np.where(most > 0, most, 1.0)
    with np.errstate(over="ignore"):
        return np.minimum(np.sqrt(((v / safe[:, None]) ** 2).sum(axis=1)) * most, MOST)


def products(a: np.ndarray, b: np.ndarray, reach: float) -> np.ndarray:
    """Exact integer products of the rows of a and b, cut to the range of long. ``reach`` bounds every sum of absolute terms."""
    if reach < 2.0**53:
        return np.rint(a @ b.T).astype(np.int64)
    if reach < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = np.array([[int(x) for x in row] for row in a], object) @ np.array([[int(x) for x in row] for row in b], object).T
    return np.clip(whole, -LONG, LONG - 1).astype(np.int64)


class Bucket:
    """Vectors of similar length, the longest first, with their coordinates in sorted lists made when first asked for."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        norms = lengths(vectors)
        order = np.argsort(-norms, kind="stable")
        self.ids, self.v, self.norms = ids[order], np.ascontiguousarray(vectors[order]), norms[order]
        self.unit = self.v / np.maximum(self.norms, 1e-300)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.lists[f] = order, self.unit[order, f]
        return self.lists[f]


#: Below this local threshold the intervals of coordinate pruning hold nearly all vectors.
COORDINATE_FROM, FOCUS = 0.55, 4


def search_bucket(bucket: Bucket, q_ids: np.ndarray, q: np.ndarray, q_norms: np.ndarray, best: Best, stats: dict | None = None) -> None:
    longest = float(bucket.norms[0])
    stats = {} if stats is None else stats
    by_length: list[int] = []
    with np.errstate(over="ignore"):
        bounds = q_norms * longest * (1 + 1e-9)  # of sums of absolute terms too, by Cauchy and Schwarz
    for i in range(len(q)):
        theta = best.theta(i)
        reach = float(bounds[i])
        if theta == -math.inf or reach == 0:
            by_length.append(i)
            continue
        local = theta / reach
        if local > 1 + 1e-9:
            stats["skipped"] = stats.get("skipped", 0) + 1
            continue
        if local < COORDINATE_FROM:
            by_length.append(i)
            continue
        t = local - 1e-9  # outward
        unit = q[i] / q_norms[i]
        rows: np.ndarray | None = None
        for f in np.argsort(-np.abs(unit))[:FOCUS].tolist():
            order, values = bucket.sorted_list(f)
            slack = math.sqrt(max(0.0, 1 - t * t) * max(0.0, 1 - float(unit[f]) ** 2)) + 1e-9
            lo, hi = unit[f] * t - slack, unit[f] * t + slack
            # cosines above the threshold only move the interval's ends towards the query's coordinate, up to 1
            if unit[f] > t:
                hi = 1.0
            if -unit[f] > t:
                lo = -1.0
            a, b = np.searchsorted(values, lo, "left"), np.searchsorted(values, hi, "right")
            if rows is None:
                rows = order[a:b]
            else:
                x = bucket.unit[rows, f]
                rows = rows[(x >= lo) & (x <= hi)]
        stats["coordinate"] = stats.get("coordinate", 0) + 1
        stats["verified"] = stats.get("verified", 0) + len(rows)
        if len(rows):
            score = products(bucket.v[rows], q[i : i + 1], float(bounds[i]))[:, 0]
            other = bucket.ids[rows] != q_ids[i]
            best.add(i, score[other], bucket.ids[rows][other])
    if by_length:
        stats["length"] = stats.get("length", 0) + len(by_length)
        product = products(q[by_length], bucket.v, float(bounds[by_length].max()))
        for row, i in zip(product, by_length, strict=True):
            theta = best.theta(i)
            n = len(row) if theta <= 0 or q_norms[i] == 0 else int(np.searchsorted(-bucket.norms, -(theta / float(q_norms[i])) * (1 - 1e-9), "right"))
            row, ids = row[:n], bucket.ids[:n]
            keep = ids != q_ids[i]
            if (least := best.least(i)) is not None:
                keep &= row >= least
            elif len(row) > 4 * best.k:
                others = row[keep]  # the query's own rows, of which there may be many, take no place
                if len(others) > best.k:
                    keep &= row >= np.partition(others, len(others) - best.k)[len(others) - best.k]
            best.add(i, row[keep], ids[keep])


#: A length class holds vectors whose lengths differ by this factor at most.
CLASS_RATIO = 1.05


def _groups(vectors: DataFrame, group: int) -> list[tuple[int, int, int, float]]:
    """(class, first group, number of groups, longest length in those groups) of each length class, the longest first.

    A large class is dealt to several groups, small neighbours share one. The classes are logarithmic, a few thousand for all of a
    double's range; their counts are all that the driver sees.
    """
    counts = vectors.groupBy("class").agg(F.count("*").alias("n"), F.max("length").alias("longest")).collect()
    rows: list[tuple[int, int, int, float]] = []
    first, filled, longest = 0, 0, 0.0
    for r in sorted(counts, key=lambda r: -r["class"]):
        if filled and filled + r.n > group:
            first, filled = first + 1, 0
        longest = longest if filled else r.longest
        parts = max(1, math.ceil(r.n / group))
        rows.append((r["class"], first, parts, longest))
        if parts > 1:
            first, filled = first + parts, 0
        else:
            filled += r.n
    return rows


def visits(queries: DataFrame, longest: list[float], first: int) -> DataFrame:
    """``queries`` (id, v, length, theta) with ``at``: the groups from ``first`` on that hold vectors long enough to reach theta; a null
    theta is reached everywhere. Groups come by falling length, so they are the first ones."""
    reach = F.array(*map(F.lit, longest[first:]))  # a number for each group
    far = F.col("length") * (1 + 1e-9)
    n = F.when(F.col("theta").isNull() | (F.col("theta") <= 0), F.lit(len(longest) - first)).otherwise(F.size(F.filter(reach, lambda x: x * far >= F.col("theta"))))
    return queries.withColumn("n", n).filter("n > 0").withColumn("at", F.explode(F.sequence(F.lit(first), F.lit(first - 1) + F.col("n")))).drop("n")


def _search(k: int, bucket: int, query_block: int):
    """Over rows (at, dim, kind, id, theta, v) sorted so that a group's candidates, the longest first, precede the queries."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, buckets = None, []  # of the group: at most its vectors
        waiting: dict[int, list[tuple[np.ndarray, ...]]] = {0: [], 1: []}

        def taken(kind: int) -> tuple[np.ndarray, ...]:
            out = tuple(np.concatenate(x) for x in zip(*waiting[kind], strict=True))
            waiting[kind].clear()
            return out

        def candidates() -> None:
            if waiting[0]:
                ids, _, v = taken(0)
                buckets.extend(Bucket(ids[i : i + bucket], v[i : i + bucket]) for i in range(0, len(ids), bucket))

        def asked() -> Iterator[pa.RecordBatch]:
            candidates()
            if not waiting[1]:
                return
            ids, thetas, v = taken(1)
            for i in range(0, len(ids) if buckets else 0, query_block):
                q_ids, q = ids[i : i + query_block], v[i : i + query_block]
                best = Best(thetas[i : i + query_block], k)
                for b in buckets:
                    search_bucket(b, q_ids, q, lengths(q), best)
                sizes = [len(x) for x in best.score]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, sizes)), pa.array(np.concatenate(best.id)), pa.array(np.concatenate(best.score))], ["query_id", "vec_id", "score"])

        for batch in batches:
            at, dim, kind, ids = (batch.column(i).to_numpy() for i in range(4))
            # rounded down to a double: a threshold may be too low, never too high
            theta = np.array([-np.inf if x is None else np.nextafter(float(x), -np.inf) if abs(x) >= 1 << 53 else float(x) for x in batch.column(4).to_pylist()])
            flat = batch.column(5).flatten().to_numpy()
            ends = np.cumsum(dim, dtype=np.int64)
            cuts = np.flatnonzero((at[1:] != at[:-1]) | (dim[1:] != dim[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
                if (key := (at[lo], dim[lo])) != now:
                    yield from asked()
                    now, buckets = key, []
                if kind[lo] == 1:
                    candidates()
                waiting[int(kind[lo])].append((ids[lo:hi], theta[lo:hi], flat[ends[lo] - dim[lo] : ends[hi - 1]].reshape(hi - lo, dim[lo])))
            if sum(len(x[0]) for x in waiting[1]) >= query_block:
                yield from asked()
        yield from asked()

    return of


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, bucket: int = BUCKET, query_block: int = QUERY_BLOCK, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score). Both inputs (id, v, and length if known) as :func:`quantize` gives them; queries are a stated part of the rows.

    A group holds vectors of similar length, ``group`` of them or, in a large table, more (see above); their number grows with the input
    and so does the parallelism. Candidates are shuffled once; a query goes to the groups that it may have answers in.
    """
    if "length" not in vectors.columns:
        vectors, queries = (x.withColumn("length", length_of(F.col("v"))) for x in (vectors, queries))
    kind = F.when(F.col("length") == 0, F.lit(-(1 << 20))).otherwise(F.floor(F.log("length") / math.log(CLASS_RATIO))).cast("int")
    # numbered as written, so that rows are dealt out evenly whatever their ids and values
    vectors = materialize(vectors.withColumn("class", kind).withColumn("number", F.monotonically_increasing_id()), "vectors")
    total, dim = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    most = max(1, GROUP_BYTES // (24 * (dim or 1)))
    classes = _groups(vectors, max(1, min(max(group, math.ceil(total / GROUPS)), most) if group >= GROUP else group))
    longest: list[float] = []
    for _, first, parts, size in classes:
        longest += [size] * (first + parts - len(longest))
    if not classes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked = queries.groupBy("id").agg(F.min(F.struct("v", "length")).alias("q")).select("id", "q.*")
    table = vectors.sparkSession.createDataFrame([x[:3] for x in classes], "class int, first int, parts int")  # a row for each class
    dealt = vectors.join(F.broadcast(table), "class").withColumn("at", (F.col("first") + F.pmod("number", F.col("parts"))).cast("int"))

    def searched(own: DataFrame, against: DataFrame) -> DataFrame:
        columns = ["at", F.size("v").alias("dim"), "kind", "id", "theta", "v", "length"]
        rows = against.withColumn("theta", F.lit(None).cast("long")).withColumn("kind", F.lit(0)).select(*columns).unionByName(own.withColumn("kind", F.lit(1)).select(*columns))
        rows = rows.repartition("at").sortWithinPartitions("at", "dim", "kind", F.desc("length"), "id").select("at", "dim", "kind", "id", "theta", "v")
        return rows.mapInArrow(_search(k, bucket, query_block), "query_id long, vec_id long, score long")

    none = F.lit(None).cast("long")
    found = searched(visits(asked.withColumn("theta", none), longest[:1], 0), dealt.filter("at = 0"))
    if len(longest) > 1:
        found = materialize(found, "first")
        thetas = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("theta")).withColumnRenamed("query_id", "id")
        later = visits(asked.join(thetas, "id", "left"), longest, 1)
        found = found.unionByName(searched(later, dealt.filter("at > 0")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
