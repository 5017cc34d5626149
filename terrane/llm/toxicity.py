"""Toxicity by non-negative positive-unlabelled learning.

The classifier is linear in hashed features of words and their beginnings and trained with numpy from two sets only: confirmed toxic texts (P) and
texts without a usable label (U, which hold toxic ones too). Words that say nothing (in P no
more often than U's rate explains) are left out, and near-copies count once. The risk is the class-prior-corrected, non-negative
estimator: ``prior * R_P(+)`` plus ``R_U(-) - prior * R_P(-)``, where the second part, which estimates the risk on clean
texts, may not fall below zero; a mini-batch in which it does takes a step against its gradient instead.

The prior is the share of toxic ones among the usable labels, so labelled documents have to be like the others.

Training reads a bounded sample (``Settings.positives`` and ``Settings.unlabelled`` ids, the smallest by a hash; of rows that
share an id, the least text). Features are made, counted and chosen on the executors; the driver sees a count for each of at most
``2 ** bits`` features, and of the sample only the entries of the features that take part. The weights, as many, are
broadcast. Scoring covers every whole text.

Defined results: a null or empty text has the bias alone as its score; a null id is never a training row; an id with several labels has
the largest; texts that repeat score alike; with no positive to learn from every score is the class prior; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import int_lists, materialize

_WORD = re.compile(r"\w+")
PREFIXES = (4, 5, 6, 7, 8)


@dataclass(frozen=True)
class Settings:
    positives: int = 2500
    unlabelled: int = 5000
    bits: int = 18
    epochs: int = 30
    batch: int = 1024
    rate: float = 0.05
    significance: float = 25.0
    steps: int = 1500
    decay: float = 1e-5
    beta: float = 0.0
    gamma: float = 1.0
    seed: int = 7


def of_word(word: str, bits: int) -> tuple[int, ...]:
    """The hashed features of a word: itself and its beginnings, which words of one stem share."""
    mask = (1 << bits) - 1
    return tuple({crc32(x.encode("utf-8", "replace")) & mask for x in (word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n))})


def features(text: str | None, bits: int, known: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the text and the logarithms of their counts."""
    if len(known) > 100_000:
        known.clear()
    at: list[int] = []
    n: list[int] = []
    for word, count in Counter(_WORD.findall((text or "").lower())).items():
        if (own := known.get(word)) is None:
            own = known[word] = of_word(word, bits)
        at += own
        n += [count] * len(own)
    ids, where = np.unique(np.array(at, np.int64), return_inverse=True)
    return ids, np.log1p(np.bincount(where, n, len(ids)))


@dataclass
class Model:
    """``weights``: of the features that take part; the others are zero."""

    weights: dict[int, float]
    bias: float
    bits: int

    def score(self, text: str | None, known: dict[str, tuple[int, ...]]) -> float:
        """``known`` remembers which of a word's features take part; bounded."""
        if len(known) > 150_000:
            known.clear()
        counts: dict[int, int] = {}
        weights = self.weights
        for word, n in Counter(_WORD.findall((text or "").lower())).items():
            if (own := known.get(word)) is None:
                own = known[word] = tuple(f for f in of_word(word, self.bits) if f in weights)
            for f in own:
                counts[f] = counts.get(f, 0) + n
        z = self.bias + sum(weights[f] * math.log1p(n) for f, n in sorted(counts.items()))
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def copy_key(at: np.ndarray) -> str:
    """Three least features by a hash: rows that share them are copies or near-copies, which would count one text's words many times."""
    return ",".join(map(str, np.sort((at.astype(np.int64) * 0x9E3779B1) & 0xFFFFFFFF)[:3].tolist()))


class _Rows:
    """Sparse rows in one pair of arrays."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.starts = np.concatenate(([0], np.cumsum([len(a) for a, _ in rows]))).astype(np.int64)
        self.at = np.concatenate([a for a, _ in rows]) if rows else np.empty(0, np.int64)
        self.x = np.concatenate([x for _, x in rows]) if rows else np.empty(0)

    def __len__(self) -> int:
        return len(self.starts) - 1

    def take(self, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature, value) of the picked rows' entries."""
        lo, n = self.starts[picked], self.starts[picked + 1] - self.starts[picked]
        ends = np.cumsum(n)
        where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - ends + n, n)
        return np.repeat(np.arange(len(picked)), n), self.at[where], self.x[where]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def telling(seen: np.ndarray, common: np.ndarray, n_positive: int, n_unlabelled: int, significance: float) -> np.ndarray:
    """The features that take part: those in more of P than U's rate explains, by the deviance of a Poisson count."""
    expected = (common + 0.5) / (n_unlabelled + 1) * n_positive
    with np.errstate(divide="ignore", invalid="ignore"):
        deviance = np.where(seen > expected, 2 * (seen * np.log(seen / expected) - (seen - expected)), 0.0)
    return np.flatnonzero(deviance >= significance)


def risk(w: np.ndarray, p: tuple, u: tuple, n_p: int, n_u: int, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Of a mini-batch, with the logistic loss: ``prior * R_P(+)``, ``R_U(-) - prior * R_P(-)``, and the gradients of both.

    p, u: (row, feature, value) of the entries; the last weight is the bias.
    """
    (pr, pa_, px), (ur, ua, ux), dim = p, u, len(w) - 1
    zp = np.bincount(pr, px * w[pa_], n_p) + w[dim]
    zu = np.bincount(ur, ux * w[ua], n_u) + w[dim]

    def back(g: np.ndarray, r: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.bincount(a, x * g[r], dim + 1).astype(np.float64)  # integers where there is no entry
        out[dim] = g.sum()
        return out

    toxic = prior * np.logaddexp(0, -zp).mean()
    clean = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    of_toxic = back(prior * (_sigmoid(zp) - 1) / n_p, pr, pa_, px)
    of_clean = back(_sigmoid(zu) / n_u, ur, ua, ux) - back(prior * _sigmoid(zp) / n_p, pr, pa_, px)
    return float(toxic), float(clean), of_toxic, of_clean


def train(positive: list[tuple[np.ndarray, np.ndarray]], unlabelled: list[tuple[np.ndarray, np.ndarray]], kept: np.ndarray, prior: float, settings: Settings = Settings()) -> Model:
    """Minimises the non-negative risk by Adam. Rows: places in ``kept``, values. ``prior``: the share of toxic texts."""
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    base = math.log(prior / (1 - prior))
    if not positive or not unlabelled:
        return Model({}, base, settings.bits)
    p, u, rng = _Rows(positive), _Rows(unlabelled), np.random.default_rng(settings.seed)
    dim = len(kept)
    w = np.zeros(dim + 1)
    w[dim] = base
    m, v, step = np.zeros(dim + 1), np.zeros(dim + 1), 0
    per_epoch = max(1, math.ceil(len(u) / settings.batch))
    for _ in range(max(settings.epochs, math.ceil(settings.steps / per_epoch))):
        order = rng.permutation(len(u))
        for k in range(per_epoch):
            own = order[k * settings.batch : (k + 1) * settings.batch]
            picked = rng.integers(0, len(p), settings.batch)
            _, clean, of_toxic, of_clean = risk(w, p.take(picked), u.take(own), len(picked), len(own), prior)
            # where the risk on clean texts falls below zero, the step goes against its gradient
            g = of_toxic + of_clean if clean >= -settings.beta else -settings.gamma * of_clean
            g[:dim] += settings.decay * w[:dim]
            step += 1
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= settings.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(dict(zip(kept.tolist(), w[:dim].tolist(), strict=True)), float(w[dim]), settings.bits)


def held_out(id_col):
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def chosen_texts(df: DataFrame, labels: DataFrame, settings: Settings, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, float]:
    """(id, text, positive, unlabelled) of the sample, one row an id, and the prior: toxic among the usable labels. Held-out rows' labels are never read."""
    usable = labels.filter(~held_out(F.col(id_col)) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    counts = usable.agg(F.count("*"), F.sum("label")).first()
    rows = df.filter(~held_out(F.col(id_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    ids = rows.select("id").distinct().join(usable, "id", "left").select("id", (F.coalesce("label", F.lit(0)) == 1).alias("positive"), F.xxhash64("id", F.lit(settings.seed)).alias("h"))
    # U: a sample of all ids, whatever their labels; P: of those confirmed
    u = ids.orderBy("h", "id").limit(settings.unlabelled).select("id", F.lit(False).alias("positive"), F.lit(True).alias("unlabelled"))
    p = ids.filter("positive").orderBy("h", "id").limit(settings.positives).select("id", "positive", F.lit(False).alias("unlabelled"))
    both = p.unionByName(u).groupBy("id").agg(F.bool_or("positive").alias("positive"), F.bool_or("unlabelled").alias("unlabelled"))
    # the chosen ids are bounded by the settings
    return rows.join(F.broadcast(both), "id").groupBy("id", "positive", "unlabelled").agg(F.min("text").alias("text")), (counts[1] or 0) / max(1, counts[0])


def fit(df: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    texts, prior = chosen_texts(df, labels, settings, id_col, text_col, label_col)
    bits = settings.bits

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            made = [features(x.as_py(), bits, known) for x in batch.column(2)]
            lists = int_lists([a for a, _ in made])
            values = pa.ListArray.from_arrays(lists.offsets, pa.array(np.concatenate([np.empty(0), *(x for _, x in made)]).astype(np.float32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([copy_key(a) for a, _ in made], pa.string()), lists, values], ["positive", "unlabelled", "copy", "at", "x"])

    made = materialize(texts.select("positive", "unlabelled", "text").mapInArrow(of, "positive boolean, unlabelled boolean, copy string, at array<int>, x array<float>"), "features")
    # near-copies count once, in P and in U
    row = F.min(F.struct("at", "x")).alias("row")
    sides = made.filter("positive").groupBy("copy").agg(row).withColumn("positive", F.lit(True)).unionByName(made.filter("unlabelled").groupBy("copy").agg(row).withColumn("positive", F.lit(False)))
    sides = materialize(sides.select("positive", "copy", "row.*"), "sides")
    sizes = {r.positive: r["count"] for r in sides.groupBy("positive").count().collect()}
    counts = sides.select("positive", F.explode("at").alias("at")).groupBy("at").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u")).toArrow()
    seen, common = np.zeros(1 << bits), np.zeros(1 << bits)
    at = counts.column("at").to_numpy()
    seen[at], common[at] = counts.column("p").to_numpy(), counts.column("u").to_numpy()
    kept = telling(seen, common, sizes.get(True, 0), sizes.get(False, 0), settings.significance)
    shared = df.sparkSession.sparkContext.broadcast(kept)

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.full(1 << bits, -1)
        number[shared.value] = np.arange(len(shared.value))
        for batch in batches:
            places, values = [], []
            for a, x in zip(batch.column(2), batch.column(3), strict=True):
                own = number[a.values.to_numpy()]
                places.append(own[own >= 0])
                values.append(x.values.to_numpy()[own >= 0].tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), int_lists(places), pa.array(values, pa.list_(pa.float32()))], ["positive", "copy", "at", "x"])

    rows = sides.mapInArrow(only, "positive boolean, copy string, at array<int>, x array<float>").toArrow().sort_by([("positive", "ascending"), ("copy", "ascending")])
    split: tuple[list, list] = ([], [])
    for positive, a, x in zip(rows.column(0).to_pylist(), rows.column(2), rows.column(3), strict=True):
        split[0 if positive else 1].append((a.values.to_numpy(), x.values.to_numpy().astype(np.float64)))
    return train(*split, kept, prior, settings)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score, predicted."""
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.bits))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = Model(*shared.value), {}
        for batch in batches:
            found = np.fromiter((own.score(x.as_py(), known) for x in batch.column(2)), np.float64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    rows = df.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(of, f"{id_col} {kind}, held_out boolean, score double, predicted int")


def drop_toxic(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that the model doesn't call toxic, with all their columns, in one pass without a shuffle."""
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.bits))
    at = df.columns.index(text_col)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = Model(*shared.value), {}
        for batch in batches:
            yield batch.filter(pa.array([own.score(x.as_py(), known) < 0.5 for x in batch.column(at)], pa.bool_()))

    return df.mapInArrow(of, df.schema)
