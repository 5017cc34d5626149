"""Vector bin packing of tokenised documents into training sequences.

Each task packs what it reads, in one pass and bounded memory, without a shuffle: full runs of ``capacity`` tokens of a long
document are sequences of their own; the remainders wait in a window of bounded size. A sequence is filled by the
dot-product heuristic: of the waiting pieces that fit, take the one whose demand (tokens, one segment, loss-bearing
tokens), weighted by how scarce each is, has the largest product with what the sequence has left. When none fits, a
piece is cut so that the sequence is filled exactly. What is left at a task's end is cut into sequences whose lengths
are powers of two, which need no padding.

Sequence ids hold the task's number in their upper bits. A task that is run again has to read the same rows in the same order,
which holds for tables in files; a frame that comes from a shuffle has to be written first (``materialize``), or a lost executor could tear
documents.

Loss: without ``loss_col`` every token bears loss, as in the query op5, whose contract leaves no other choice; tokens and
segments (64 a sequence) are the limits that compete there. With it, all three do.

Defined results: a null text is an empty one, whose only id is the end id; a document of any length is cut, never
shortened; rows that repeat a doc_id are packed each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import int_lists


#: Texts that are encoded together.
CHUNK = 256


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold at most, and how many pieces wait to be placed."""

    tokens: int = 4096
    segments: int = 64
    loss: int = 4096
    window: int = 512


# what the tokenizer takes for words, for texts whose characters are all in the ranges below
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_BEYOND = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027\u2030-\u205e\u20ac]|<\\||\x00")
# white space for ``str.split`` that is beyond those ranges
_SPACES = [*"\x1c\x1d\x1e\x1f\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B))]


class WordIds:
    """Ids of whole texts by a tokenizer that drops white space, lower-cases, and cuts texts into words before it merges.

    Words don't cross white space, so every chunk between spaces has its ids for itself, and each different chunk is merged once.
    New chunks are cut into words by a regular expression, which cuts as the tokenizer does where a text has only Latin letters
    and common signs, and merged together by ranks: a word's end is a zero byte there, which no such text holds. A text with any
    other character goes through the tokenizer as a whole. ``bound`` is the number of chunks that are remembered; beyond it, all
    are forgotten.
    """

    def __init__(self, path: str, end_id: int, bound: int = 250_000) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.end, self.bound = Tokenizer.from_file(path), np.uint32(end_id).tobytes(), bound
        # the usual names of bytes: printable ones stand for themselves, the others for characters from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        special = set(self.tokenizer.get_added_tokens_decoder())
        vocabulary = {x: i for x, i in self.tokenizer.get_vocab().items() if i not in special}
        ends = {i for x, i in vocabulary.items() if x.endswith("</w>")}
        ranks = {bytes(byte[c] for c in x.removesuffix("</w>")) + b"\0" * (i in ends): i for x, i in vocabulary.items()}
        if len(ranks) != len(vocabulary) or not ends:
            raise ValueError("the tokenizer marks no ends of words")
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.last[list(ends)] = True
        self.merger = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}
        self.beyond: set[str] = set()

    def _learn(self, chunks: list[str]) -> None:
        if _BEYOND.search(" ".join(chunks)):
            strange = {c for c in chunks if _BEYOND.search(c)}
            self.beyond |= strange
            self.known.update(dict.fromkeys(strange, b""))
            chunks = [c for c in chunks if c not in strange]
        words, sizes = [], []
        for low in " ".join(chunks).lower().split(" ") if chunks else ():
            if low.isalpha():
                words.append(low)
                sizes.append(1)
            else:
                own = _WORDS.findall(low)
                words += own
                sizes.append(len(own))
        ids = np.array(self.merger.encode_ordinary("\0".join([*words, ""])), np.uint32)
        ends = np.concatenate(([0], np.flatnonzero(self.last[ids]) + 1))
        if len(ends) != len(words) + 1:
            raise ValueError("the tokenizer marks no ends of words")
        data, at = ids.astype("<u4").tobytes(), (4 * ends[np.cumsum([0, *sizes])]).tolist()
        self.known.update(zip(chunks, [data[a:b] for a, b in zip(at, at[1:], strict=False)], strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, with the end id, as unsigned 32-bit numbers."""
        if len(self.known) > self.bound:
            self.known.clear()
            self.beyond.clear()
        each = [t.split() for t in texts]
        found = [list(map(self.known.get, chunks)) for chunks in each]
        gaps = [[i for i, x in enumerate(own) if x is None] for own in found]
        if new := {chunks[i]: None for chunks, own in zip(each, gaps, strict=True) for i in own}:
            self._learn(list(new))
        out = []
        for text, chunks, own, missing in zip(texts, each, found, gaps, strict=True):
            for i in missing:
                own[i] = self.known[chunks[i]]
            if (self.beyond and not self.beyond.isdisjoint(chunks)) or any(x in text for x in _SPACES):
                ids = np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, 0], np.uint32)
                ids[-1:] = np.frombuffer(self.end, np.uint32)
                out.append(ids)
            else:
                own.append(self.end)
                out.append(np.frombuffer(b"".join(own), "<u4"))
        return out


@lru_cache(maxsize=2)
def word_ids(path: str, end_id: int) -> WordIds:
    """One for each worker, which goes on from task to task."""
    return WordIds(path, end_id)


def loss_in(start: int, length: int, first_loss: int) -> int:
    """Loss-bearing tokens of a piece of a document whose tokens bear loss from ``first_loss`` on."""
    return max(0, start + length - max(start, first_loss))


class Packer:
    """Places pieces; ``done`` holds (sequence, offset, piece) for all that is placed. A piece: [key, start, length, first_loss]."""

    def __init__(self, limits: Limits) -> None:
        self.limits, self.sequence, self.done = limits, 0, []
        self.pieces: list[list] = []
        self.demand = np.zeros((0, 3))

    def add(self, key, length: int, first_loss: int = 0) -> None:
        full, start = self.limits.tokens, 0
        while length - start >= full and loss_in(start, full, first_loss) <= self.limits.loss:
            self.done.append((self.sequence, 0, [key, start, full, first_loss]))
            self.sequence += 1
            start += full
        if start < length:
            self.pieces.append([key, start, length - start, first_loss])
        if len(self.pieces) >= 2 * self.limits.window:
            self.fill(self.limits.window)

    def _demands(self) -> np.ndarray:
        return np.array([(p[2], 1, loss_in(p[1], p[2], p[3])) for p in self.pieces], np.float64).reshape(-1, 3)

    def fill(self, leave: int) -> None:
        """Fills sequences until ``leave`` pieces or less than a full sequence's tokens wait."""
        limits = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], np.float64)
        demand = self._demands()
        alive = np.ones(len(self.pieces), bool)
        waiting, total = len(self.pieces), demand.sum(axis=0)
        while waiting > leave and total[0] >= limits[0]:
            left, offset = limits.copy(), 0
            while left[0] > 0 and waiting:
                weight = total / limits / limits  # scarcity, per unit of demand and of what is left
                fits = alive & (demand <= left).all(axis=1)
                if left[1] <= 1:  # the last segment must fill what is left
                    fits &= demand[:, 0] == left[0]
                if fits.any():
                    i = int(np.argmax(np.where(fits, demand @ (weight * left), -1)))
                    take = int(demand[i, 0])
                else:
                    able = np.flatnonzero(alive & (demand[:, 0] > left[0]))
                    i = int(able[0]) if len(able) else int(np.argmax(np.where(alive, demand[:, 0], -1)))
                    key, start, length, first = self.pieces[i]
                    take = min(length, int(left[0]))
                    while take and loss_in(start, take, first) > left[2]:
                        take -= int(loss_in(start, take, first) - left[2])
                    if not take or left[1] < 1:
                        break
                key, start, length, first = self.pieces[i]
                self.done.append((self.sequence, offset, [key, start, take, first]))
                used = np.array([take, 1, loss_in(start, take, first)], np.float64)
                left -= used
                total -= used
                offset += take
                if take == length:
                    alive[i], waiting = False, waiting - 1
                else:
                    self.pieces[i] = [key, start + take, length - take, first]
                    demand[i] = (length - take, 1, loss_in(start + take, length - take, first))
                    total[1] += 1
            self.sequence += 1
        self.pieces = [p for p, a in zip(self.pieces, alive, strict=True) if a]

    def finish(self) -> None:
        """Places all that waits; the last tokens go to sequences of a power of two each."""
        self.fill(0)
        rest = sum(p[2] for p in self.pieces)
        while rest:
            room = 1 << (rest.bit_length() - 1)
            segments, loss, offset = self.limits.segments, self.limits.loss, 0
            while room > offset and segments and self.pieces:
                key, start, length, first = self.pieces[0]
                take = min(length, room - offset)
                take -= max(0, loss_in(start, take, first) - loss)
                if take <= 0:
                    break
                self.done.append((self.sequence, offset, [key, start, take, first]))
                offset, segments, loss, rest = offset + take, segments - 1, loss - loss_in(start, take, first), rest - take
                if take == length:
                    self.pieces.pop(0)
                else:
                    self.pieces[0] = [key, start + take, length - take, first]
            self.sequence += 1


def pack(df: DataFrame, tokenizer_path: str, end_id: int = 2, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", loss_col: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ``with_ids`` the ids.

    ``loss_col`` names a column with the number of a document's leading tokens that bear no loss (a prompt); by default
    all bear loss.
    """
    if min(limits.tokens, limits.segments, limits.loss, limits.window) < 1:
        raise ValueError("limits are at least 1")
    kind = df.schema[id_col].dataType.simpleString()
    columns = [F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")]
    columns.append(F.coalesce(F.col(loss_col).cast("long"), F.lit(0)).alias("first_loss") if loss_col else F.lit(0).cast("long").alias("first_loss"))
    schema = f"{id_col} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        words, packer = word_ids(tokenizer_path, end_id), Packer(limits)
        docs: dict[int, list] = {}  # of documents with waiting pieces: id, ids, tokens not yet placed
        arrow_kind: pa.DataType | None = None

        def placed() -> Iterator[pa.RecordBatch]:
            if not packer.done:
                return
            rows, each = [], []
            for sequence, offset, (key, start, length, _) in packer.done:
                doc_id, ids, waiting = docs[key]
                own = ids[start : start + length]
                rows.append((doc_id, start, length, zlib.crc32(own.astype("<u4").tobytes()), len(ids), base + sequence, offset))
                each.append(own)
                docs[key][2] = waiting - length
                if waiting == length:
                    del docs[key]
            packer.done.clear()
            arrays = [*(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [arrow_kind, *[pa.int64()] * 6], strict=True)), *[int_lists(each)] * with_ids]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(arrays)])

        key = 0
        for batch in batches:
            arrow_kind = batch.column(0).type
            for lo in range(0, batch.num_rows, CHUNK):
                part = batch.slice(lo, CHUNK)
                for doc_id, ids, first in zip(part.column(0).to_pylist(), words.encode(part.column(1).to_pylist()), part.column(2).to_pylist(), strict=True):
                    docs[key] = [doc_id, ids, len(ids)]
                    packer.add(key, len(ids), max(0, first))
                    key += 1
                    if len(packer.done) >= 2000:
                        yield from placed()
        packer.finish()
        yield from placed()

    return df.select(*columns).mapInArrow(of, schema)
