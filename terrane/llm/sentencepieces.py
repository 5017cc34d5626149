"""SentencePiece encoding, decoding, and sampling of distinct segmentations by Gumbel top-k.

A text's segmentations into pieces of the vocabulary are the paths of a lattice. :func:`sample` draws ``k`` distinct ones without
replacement: every path has its log probability perturbed by a Gumbel variable, and an A-star search yields the paths in
falling perturbed order without listing them. The maximum over all paths is drawn first and a path is sampled for it; leaving
a path at one of its nodes gives a set of paths whose maximum is a Gumbel variable cut off at the path's own value, at the
sum of log probabilities up to the node. The search always opens the set with the largest maximum, draws its path, and splits the
rest of the set in the same way. The (k + 1)-th maximum gives each sample's inclusion probability.

Pieces never cross the chunks between white space, so the lattice falls into chunks, and all chunks of a batch of documents
are built, summed and sampled together with numpy: no step is taken for a single word. Random numbers are hashes of
the row's key, the sample, and the place, so a row's samples depend on nothing but its key and text.

The vocabulary is a BPE model, whose scores are merge ranks, not log probabilities. They become a Zipf distribution:
``log p = -alpha * log(rank + shift)``; every sum over paths is normalised, so no constant matters. Characters without
a piece fall back to their bytes, each as likely as the last rank.

Defined results: a null or empty text has one segmentation, without pieces; texts with fewer than k segmentations give all of
them; rows that repeat a key and text give the same samples; an empty table gives an empty result; extra columns are ignored.
Texts of any length are sampled whole: long ones by blocks of chunks, so memory (some 300 bytes a character of a block) grows
with the longest run without white space only, besides 20 bytes a character of the text itself.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import int_lists

SAMPLES, ALPHA, SHIFT, SEED = 2, 1.0, 20.0, 11
#: A text of over ``LONG`` characters is sampled by blocks of about ``BLOCK``.
LONG, BLOCK = 300_000, 200_000
GROWTH = 30.0
#: The last chunks of a batch whose paths are not at their ends are drawn as a whole.
FEW = 48


def normalized(text: str | None) -> str:
    """The text as the pieces spell it: a space is ``▁``, and one is put before."""
    return "▁" + text.replace(" ", "▁") if text else ""


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64) of unsigned longs."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _uniform(seeds: np.ndarray, *places) -> np.ndarray:
    h = seeds
    for p in places:
        h = _mix(h ^ np.asarray(p).astype(np.uint64))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def _keyed(seeds: np.ndarray, tag: int) -> np.ndarray:
    """``_uniform(_keyed(seeds, tag), place)`` is ``_uniform(seeds, tag, place)``: the first step, which all places of a text share."""
    return _mix(seeds ^ np.uint64(tag))


def _uniform_at(keyed: np.ndarray, doc_of: np.ndarray, place: np.ndarray, at: np.ndarray) -> np.ndarray:
    return _uniform(keyed[doc_of[at]], place[at])


class Vocabulary:
    """The pieces as a trie in flat arrays, their weights, and how they are spelled.

    A step of the trie is a lookup of (state, class of the character) in an open hash table, so that all places of a batch
    of texts step at once.
    """

    EMPTY = -1

    def __init__(self, model_path: str, alpha: float = ALPHA, shift: float = SHIFT) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.longest = max(len(pieces[i]) for i in plain)
        self.byte_id = np.zeros(256, np.int64)
        self.byte_id[[int(pieces[i][3:5], 16) for i in range(size) if sp.is_byte(i)]] = [i for i in range(size) if sp.is_byte(i)]
        # weights of pieces grow with their length by a constant to the power of it, which every path of a text shares
        self.weight = np.zeros(size)
        self.weight[plain] = [math.exp(-alpha * math.log(-sp.get_score(i) + shift)) * GROWTH ** len(pieces[i]) for i in plain]
        self.byte_weight = math.exp(-alpha * math.log(max(-sp.get_score(i) for i in plain) + shift))
        spelled = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.encode() for i, p in enumerate(pieces)]
        self.spelled, self.spelled_at = np.frombuffer(b"".join(spelled), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in spelled])))
        letters = sorted({c for i in plain for c in pieces[i]})
        self.kinds = np.zeros(0x110000, np.int16)
        self.kinds[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.bits = len(letters).bit_length()
        steps: dict[tuple[int, int], int] = {}
        ends = [-1]
        for i in plain:
            at = 0
            for c in pieces[i]:
                key = (at, int(self.kinds[ord(c)]))
                if key not in steps:
                    steps[key] = len(ends)
                    ends.append(-1)
                at = steps[key]
            ends[at] = i
        self.ends = np.array(ends, np.int32)
        self.mask = (1 << (4 * len(steps)).bit_length()) - 1
        self.keys, self.to = np.full(self.mask + 1, self.EMPTY, np.int64), np.zeros(self.mask + 1, np.int32)
        for (at, kind), to in steps.items():
            key = at << self.bits | kind
            slot = self._slot(key)
            while self.keys[slot] != self.EMPTY:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.to[slot] = key, to
        # the first step, which every place takes, by the class alone; no step leads back to the root
        self.first = np.zeros(len(letters) + 1, np.int32)
        self.first[[kind for at, kind in steps if not at]] = [to for (at, _), to in steps.items() if not at]

    def _slot(self, key):
        return ((key * 0x9E3779B1) >> 11) & self.mask

    def step(self, state: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the states have a step for the character's class, and where those lead."""
        key = state.astype(np.int64) << self.bits | kind
        slot = self._slot(key)
        seen = self.keys[slot]
        hit = seen == key
        late = np.flatnonzero(~hit & (seen != self.EMPTY))
        while len(late):
            slot[late] = (slot[late] + 1) & self.mask
            seen = self.keys[slot[late]]
            hit[late] = seen == key[late]
            late = late[(seen != key[late]) & (seen != self.EMPTY)]
        return hit, self.to[slot[hit]]

    def decode(self, ids: np.ndarray) -> bytes:
        """The normalised text that the ids spell, as UTF-8."""
        ids = ids.astype(np.int64)
        lo, n = self.spelled_at[ids], self.spelled_at[ids + 1] - self.spelled_at[ids]
        ends = np.cumsum(n)
        return self.spelled[np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - ends + n, n)].tobytes()


@lru_cache(maxsize=2)
def vocabulary(model_path: str, alpha: float) -> Vocabulary:
    """One for each worker."""
    return Vocabulary(model_path, alpha)


class Lattice:
    """The lattice of a batch of texts: for every place and length, the piece and its probability given the place.

    ``p[l, i]`` is the probability that the piece from place i has l + 1 characters, over all ways to the end of i's chunk. The
    backward sums run over all chunks at once, from their ends; they are scaled where they would leave the range of floats.
    """

    def __init__(self, voc: Vocabulary, spelled: list[str]) -> None:
        sizes = np.array([len(t) for t in spelled], np.int64)
        self.voc, self.doc_at = voc, np.concatenate(([0], np.cumsum(sizes + 1)))  # a separator after each text
        self.code = code = np.frombuffer("".join(t + "\n" for t in spelled).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.text_end = self.doc_at[:-1] + sizes
        n, longest = len(code), voc.longest
        kinds = np.concatenate((voc.kinds[code], np.zeros(longest, np.int16)))
        self.piece, self.p = np.full((longest, n), -1, np.int32), np.zeros((longest, n))
        state = voc.first[kinds[:n]]
        at = np.flatnonzero(state)
        state = state[at]
        for length in range(longest):
            if length:
                hit, state = voc.step(state, kinds[at + length])
                at = at[hit]
            if not len(at):
                break
            ends = voc.ends[state]
            there = np.flatnonzero(ends >= 0)
            ends, on = ends[there], at[there]
            self.piece[length][on], self.p[length][on] = ends, voc.weight[ends]
        fallback = self.piece[0] < 0
        n_bytes = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
        self.p[0, fallback] = voc.byte_weight ** n_bytes[fallback] * GROWTH
        space, line = code == 0x2581, code == 10
        first = (space & ~np.concatenate(([False], space[:-1]))) | line | np.concatenate(([True], line[:-1]))
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], n)
        inside = np.ones(len(starts), bool)
        inside[np.searchsorted(starts, self.text_end)] = False  # the separators
        self.starts, self.ends = starts[inside], ends[inside]
        self._backward()

    def _backward(self) -> None:
        order = np.argsort(-(self.ends - self.starts), kind="stable")
        ends, sizes = self.ends[order], (self.ends - self.starts)[order]
        longest, p = len(self.p), self.p
        alive = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), "right")  # chunks with so many characters
        sums = [np.ones(len(ends))]  # backward sums at the last ``longest`` distances from the ends
        for r, k in enumerate(alive.tolist(), 1):
            nodes = ends[:k] - r
            terms = [p[m][nodes] for m in range(min(r, longest))]  # no piece leaves its chunk
            total = np.zeros(k)
            for m, term in enumerate(terms):
                term *= sums[-1 - m][:k]
                total += term
            scale = 1 / total
            for m, term in enumerate(terms):
                term *= scale
                p[m][nodes] = term
            sums = [x[:k] for x in sums[1 - longest :]] + [total]
            if r % 8 == 0 and ((total < 1e-60) | (total > 1e60)).any():
                sums = [x / total for x in sums]

    def _choose(self, choice: np.ndarray, at: np.ndarray, uniform) -> None:
        """Sets, at these places, the length less one of a piece drawn from their probabilities."""
        u, total = uniform(at) * (1 - 1e-12), np.zeros(len(at))  # below the sum of a place's probabilities, as rounded
        choice[at] = 0
        for row in self.p[:-1]:
            total += row[at]
            on = np.flatnonzero(u >= total)
            if not len(on):
                break
            at, u, total = at[on], u[on], total[on]
            choice[at] += 1

    def walk(self, choice: np.ndarray, fixed: np.ndarray, uniform) -> np.ndarray:
        """The places that a path meets, in order. Its choices are drawn on the way (``uniform`` gives the numbers of places) and set, but those that are fixed."""
        seen = np.zeros(len(choice), bool)
        at, ends, drawn = self.starts, self.ends, False
        while len(at):
            if not drawn:
                drawn = len(at) <= FEW  # the places of the last chunks at once, since each step has its price
                ahead = np.concatenate([np.arange(a, b) for a, b in zip(at.tolist(), ends.tolist(), strict=True)]) if drawn else at
                self._choose(choice, ahead[~fixed[ahead]], uniform)
            seen[at] = True
            at = at + choice[at] + 1
            on = at < ends
            at, ends = at[on], ends[on]
        return np.flatnonzero(seen)

    def ids(self, at: np.ndarray, choice: np.ndarray) -> np.ndarray:
        """The ids of the pieces at the places of a path."""
        out = self.piece[choice[at], at].astype(np.int64)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            code = self.code[at[missing]]
            if (code < 0x80).all():
                out[missing] = self.voc.byte_id[code]
            else:
                spelled = [chr(c).encode("utf-8", "surrogatepass") for c in code.tolist()]
                n = np.ones(len(out), np.int64)
                n[missing] = [len(x) for x in spelled]
                begin = np.cumsum(n) - n
                out = np.repeat(out, n)
                for i, x in zip(begin[missing].tolist(), spelled, strict=True):
                    out[i : i + len(x)] = self.voc.byte_id[list(x)]
        return out.astype(np.uint32)


def _cut_gumbel(location: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables at the locations, given that they are at most ``top``."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        return np.where(location > -math.inf, location - np.log(np.exp(location - top) - np.log(u)), -math.inf)


class Path:
    """A path through every text: its choices, places, prefix sums, and the maxima of the sets left at its places.

    A class of the module: one made for every batch would be a reference cycle that keeps the batch's lattice.
    """

    def __init__(self, lat: Lattice, doc_of: np.ndarray, seeds: np.ndarray, place: np.ndarray, choice: np.ndarray, fixed: np.ndarray, top: np.ndarray, tag: int, since: np.ndarray) -> None:
        self.choice, self.at = choice, lat.walk(choice, fixed, partial(_uniform_at, _keyed(seeds, tag), doc_of, place))
        self.doc_at = np.searchsorted(self.at, lat.doc_at)
        p = lat.p[choice[self.at], self.at]
        self.log_p = np.log(p)
        self.prefix = np.empty_like(self.log_p)
        for a, b in zip(self.doc_at[:-1].tolist(), self.doc_at[1:].tolist(), strict=True):
            np.cumsum(self.log_p[a:b], out=self.prefix[a:b])
        doc = doc_of[self.at]
        with np.errstate(divide="ignore"):
            location = np.where(p < 1 - 1e-12, self.prefix - self.log_p + np.log1p(-np.minimum(p, 1.0)), -math.inf)
        self.left = _cut_gumbel(location, top[doc], _uniform_at(_keyed(seeds, tag + 1000), doc_of, place, self.at))
        self.left[self.at <= since[doc]] = -math.inf  # those sets are the earlier path's

    def of(self, d: int) -> slice:
        return slice(self.doc_at[d], self.doc_at[d + 1])


def sample_batch(voc: Vocabulary, texts: list[str | None], seeds: np.ndarray, k: int = SAMPLES) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text, up to k samples (ids, log probability, perturbed, log inclusion probability), by falling perturbed value."""
    lat, docs = Lattice(voc, [normalized(t) for t in texts]), len(texts)
    seeds = np.asarray(seeds, np.int64).view(np.uint64)
    doc_of = np.repeat(np.arange(docs), np.diff(lat.doc_at))
    place = np.arange(len(doc_of)) - lat.doc_at[doc_of]

    top = -np.log(-np.log(_uniform(seeds, 999)))
    of_batch = (lat, doc_of, seeds, place)
    size = len(doc_of)
    paths = [Path(*of_batch, np.zeros(size, np.int8), np.zeros(size, bool), top, 0, np.full(docs, -1))]
    used: dict[tuple[int, int, int], list[int]] = {}  # by document, path and place: the lengths gone at a set that was opened before
    found: list[list] = [[] for _ in range(docs)]

    def told(path: Path, which, value: np.ndarray) -> None:
        for d in which:
            own = path.of(d)
            found[d].append((lat.ids(path.at[own], path.choice), float(path.prefix[own][-1]) if own.stop > own.start else 0.0, float(value[d])))

    def next_set() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The largest maximum of each document's sets: its value, path and index."""
        value, which, index = np.full(docs, -math.inf), np.zeros(docs, np.int64), np.zeros(docs, np.int64)
        for r, path in enumerate(paths):
            for d in range(docs):
                own = path.of(d)
                if own.stop > own.start and path.left[(i := own.start + int(np.argmax(path.left[own])))] > value[d]:
                    value[d], which[d], index[d] = path.left[i], r, i
        return value, which, index

    told(paths[0], range(docs), top)
    value, which, index = next_set()
    for r in range(1, k):
        alive = np.flatnonzero(value > -math.inf).tolist()
        if not alive:
            break
        choice, fixed, since, rests = np.zeros(size, np.int8), np.zeros(size, bool), np.full(docs, np.iinfo(np.int64).max), []
        for d in alive:
            path, i = paths[which[d]], int(index[d])
            at = int(path.at[i])
            gone = used.setdefault((d, int(which[d]), at), [int(path.choice[at])])
            probs = lat.p[:, at].copy()
            probs[gone] = 0.0
            total = probs.sum()
            pick = int(np.searchsorted(np.cumsum(probs), float(_uniform(seeds[d : d + 1], r + 2000, at - int(lat.doc_at[d]))[0]) * total, "right"))
            pick = min(pick, int(np.flatnonzero(probs)[-1]))
            begin = int(lat.doc_at[d])
            choice[begin:at] = path.choice[begin:at]
            choice[at] = pick
            fixed[begin : at + 1] = True
            since[d] = at
            path.left[i] = -math.inf
            probs[pick] = 0.0
            rests.append((d, at, [*gone, pick], path.prefix[i] - path.log_p[i] + math.log(rest) if (rest := float(probs.sum())) > 1e-15 else -math.inf))
        path = Path(*of_batch, choice, fixed, value, r, since)
        for d, at, gone, location in rests:
            used[(d, len(paths), at)] = gone
            i = int(np.searchsorted(path.at, at))
            path.left[i] = _cut_gumbel(np.array([location]), value[d : d + 1], _uniform(seeds[d : d + 1], r + 3000, at - int(lat.doc_at[d])))[0]
        paths.append(path)
        told(path, alive, value)
        value, which, index = next_set()
    return [_with_inclusion(rows, float(v)) for rows, v in zip(found, value, strict=True)]


def _with_inclusion(rows: list[tuple[np.ndarray, float, float]], threshold: float) -> list[tuple[np.ndarray, float, float, float]]:
    # 1 - exp(-exp(x)) is exp(x) where that is small
    inclusion = [x if (x := lp - threshold) < -20 else math.log(-math.expm1(-math.exp(min(x, 700)))) for _, lp, _ in rows]
    return [(ids, lp, g, i) for (ids, lp, g), i in zip(rows, inclusion, strict=True)]


_START = re.compile("(?<=[^▁])▁|\n")


class LongPath:
    """A path through a long text by blocks: the choices (a byte a character), each block's ids and prefix sum before it, and
    the best sets left, of which no search opens more than k."""

    def __init__(self, n: int) -> None:
        self.choice, self.ids, self.before = np.zeros(n, np.int8), [], [0.0]
        self.sets: dict[int, tuple[float, float]] = {}  # by place: the maximum, the sum of log probabilities before the place

    def offer(self, values: np.ndarray, places: np.ndarray, before: np.ndarray, most: int) -> None:
        best = np.argsort(-values)[:most].tolist()
        own = [*self.sets.items(), *((int(places[i]), (float(values[i]), float(before[i]))) for i in best if values[i] > -math.inf)]
        self.sets = dict(sorted(own, key=lambda x: -x[1][0])[:most])


def sample_long(voc: Vocabulary, text: str | None, seed: int, k: int = SAMPLES, block: int = BLOCK) -> list[tuple[np.ndarray, float, float, float]]:
    """What :func:`sample_batch` gives for the text, with the lattice of one block of whole chunks at a time: each path goes over the blocks anew."""
    spelled, edges = normalized(text), [0]
    while edges[-1] < len(spelled):
        nxt = _START.search(spelled, edges[-1] + block)
        edges.append(nxt.start() if nxt else len(spelled))
    seeds = np.array([seed], np.int64).view(np.uint64)
    value = float(-np.log(-np.log(_uniform(seeds, 999)))[0])
    paths: list[LongPath] = []
    used: dict[tuple[int, int], list[int]] = {}
    found, origin, at = [], 0, -1
    most = k + 1

    def next_set() -> tuple[float, int, int]:
        return max(((v, i, place) for i, p in enumerate(paths) for place, (v, _) in p.sets.items()), default=(-math.inf, 0, -1))

    for r in range(k):
        if r:
            value, origin, at = next_set()
            if value == -math.inf:
                break
        path, since = LongPath(len(spelled)), at
        old = paths[origin] if r else path
        for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if hi <= at:  # before the set that is opened all is as it was
                path.choice[lo:hi] = old.choice[lo:hi]
                path.ids.append(old.ids[b])
                path.before.append(old.before[b + 1])
                continue
            lat = Lattice(voc, [spelled[lo:hi]])
            place = np.arange(lo, hi + 1)
            choice, fixed, rest = np.zeros(len(place), np.int8), np.zeros(len(place), bool), None
            if lo <= at:
                gone = used.setdefault((origin, at), [int(old.choice[at])])
                before = old.sets.pop(at)[1]
                probs = lat.p[:, at - lo].copy()
                probs[gone] = 0.0
                pick = int(np.searchsorted(np.cumsum(probs), float(_uniform(seeds, r + 2000, at)[0]) * probs.sum(), "right"))
                pick = min(pick, int(np.flatnonzero(probs)[-1]))
                choice[: at - lo], choice[at - lo] = old.choice[lo:at], pick
                fixed[: at - lo + 1] = True
                probs[pick] = 0.0
                used[(r, at)] = [*gone, pick]
                if (left := float(probs.sum())) > 1e-15:
                    rest = before + math.log(left)
            on = lat.walk(choice, fixed, lambda at: _uniform(np.repeat(seeds, len(at)), r, at + lo))  # noqa: B023  it is called before they change
            p = lat.p[choice[on], on]
            log_p = np.log(p)
            prefix = np.cumsum(np.concatenate(([path.before[-1]], log_p)))[1:]
            with np.errstate(divide="ignore"):
                location = np.where(p < 1 - 1e-12, prefix - log_p + np.log1p(-np.minimum(p, 1.0)), -math.inf)
            tops = _cut_gumbel(location, np.full(len(on), value), _uniform(np.repeat(seeds, len(on)), r + 1000, on + lo))
            tops[on + lo <= since] = -math.inf
            if rest is not None:
                tops[np.searchsorted(on, at - lo)] = _cut_gumbel(np.array([rest]), np.array([value]), _uniform(seeds, r + 3000, at))[0]
            path.offer(tops, on + lo, prefix - log_p, most)
            path.choice[lo:hi] = choice[: hi - lo]
            path.ids.append(lat.ids(on, choice))
            path.before.append(float(prefix[-1]))
        paths.append(path)
        found.append((np.concatenate(path.ids) if path.ids else np.empty(0, np.uint32), path.before[-1], value))
    return _with_inclusion(found, next_set()[0])


def sample(df: DataFrame, model_path: str, k: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, alpha: float = ALPHA, with_ids: bool = True, batch_chars: int = 30_000) -> DataFrame:
    """Up to k rows per input row: id, rank (from 1), n_tokens, ids_crc32, log_prob, perturbed, log_inclusion, round_trip, and the ids.

    ``round_trip``: decoding the ids gave the normalised text.
    """
    kind = df.schema[id_col].dataType.simpleString()
    names = ["rank", "n_tokens", "ids_crc32", "log_prob", "perturbed", "log_inclusion", "round_trip"] + ["ids"] * with_ids
    types = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.list_(pa.int32())][: len(names)]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(model_path, alpha)

        def told(rows: list) -> pa.RecordBatch:
            made, picked, each = [], [], []
            texts, seeds = [r[2] for r in rows], [r[1] for r in rows]
            sampled = [sample_long(voc, texts[0], seeds[0], k)] if len(texts[0] or "") > LONG else sample_batch(voc, texts, np.array(seeds, np.int64), k)
            for row, samples in zip(rows, sampled, strict=True):
                spelled = normalized(row[2]).encode()
                for rank, (ids, lp, g, inc) in enumerate(samples, 1):
                    made.append((rank, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), lp, g, inc, voc.decode(ids) == spelled))
                    picked.append(row[0])
                    each.append(ids)
            columns = [pa.array(picked, arrow_kind), *(pa.array(x, t) for x, t in zip(zip(*made, strict=True), types, strict=False))]
            return pa.RecordBatch.from_arrays([*columns, *[int_lists(each)] * with_ids], [id_col, *names])

        rows, chars = [], 0
        for batch in batches:
            arrow_kind = batch.column(0).type
            for key, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = text.as_py()
                if rows and len(text or "") > LONG:  # a long text goes alone
                    yield told(rows)
                    rows, chars = [], 0
                rows.append((key, h, text))
                chars += len(text or "")
                if chars >= batch_chars or len(rows) >= 1000:
                    yield told(rows)
                    rows, chars = [], 0
        if rows:
            yield told(rows)

    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(of, f"{id_col} {kind}, rank int, n_tokens long, ids_crc32 long, log_prob double, perturbed double, log_inclusion double, round_trip boolean" + ", ids array<int>" * with_ids)


def _by_batch(df: DataFrame, model_path: str, column: str, into: str, kind: str, arrow_kind: pa.DataType, apply) -> DataFrame:
    names = [*df.columns, into]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        at = names.index(column)
        for batch in batches:
            given = batch.column(at).to_pylist()
            done = iter(apply(sp, [x for x in given if x is not None]))
            made = [None if x is None else next(done) for x in given]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, arrow_kind)], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(of, f"{fields}, `{into}` {kind}")


def encode(df: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """The rows with the ids of the model's own segmentation."""
    return _by_batch(df, model_path, text_col, ids_col, "array<int>", pa.list_(pa.int32()), lambda sp, x: sp.encode(x, num_threads=1))


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """The rows with the text that the ids spell."""
    return _by_batch(df, model_path, ids_col, text_col, "string", pa.string(), lambda sp, x: sp.decode(x, num_threads=1))
