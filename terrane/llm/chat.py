"""Chat formatting at token level.

Each text is encoded by itself and the template's control strings are reserved ids spliced between the segments, so that no
content, whatever it says, can become a control id. In the readable form the control strings are text, so those occurring in
content are escaped: a backslash is doubled, and one is put after the first character of every control string. The loss
mask is the prefix sum of +1 and -1 at the ends of the assistant's segments.

Rows are encoded where they are, in any order; only then are the rows of a conversation brought together, by a sort within
partitions, and streamed. What travels is a turn's ids as 16-bit numbers (32-bit ones for larger vocabularies) and the ends of its segments: less than the
text. The readable form is decoded from the ids. A task holds one conversation at a time, whole, as its row does.

Defined results: a null text or role is empty; rows go by turn, those of equal turn by the bytes of role and text, a null turn first;
rows of a null conv_id are one conversation; repeated rows are turns of their own; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import int_lists

# The template's control strings, in the order of their reserved ids.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[OUT]", "[ROLE]", "[TEXT]", "[/ROLE]")
FIRST_RESERVED = 50_257
_ANY = "|".join(map(re.escape, CONTROLS))
_ESCAPE = re.compile(rf"\\|({_ANY})")
_OPEN = {"user": ("[INST]", "[/INST]"), "system": ("[SYS]", "[/SYS]"), "assistant": ("[OUT]", "</s>")}
_ROLE_OF = {opened: role for role, (opened, _) in _OPEN.items()}
RESERVED = {c: FIRST_RESERVED + i for i, c in enumerate(CONTROLS)}


def escape(text: str) -> str:
    """No control string is left in the result, and :func:`unescape` gives the text back."""
    return _ESCAPE.sub(lambda m: f"{m[1][0]}\\{m[1][1:]}" if m[1] else "\\\\", text) if "\\" in text or "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def turn_parts(role: str, text: str) -> list[tuple[str, bool, bool]]:
    """(string, is it a control, does it bear loss) of one turn."""
    if role in _OPEN:
        opened, closed = _OPEN[role]
        return [(opened, True, False), (escape(text), False, role == "assistant"), (closed, True, False)]
    return [("[ROLE]", True, False), (escape(role), False, False), ("[TEXT]", True, False), (escape(text), False, False), ("[/ROLE]", True, False)]


@lru_cache(maxsize=4)
def encoding(path: str):
    """A byte-level encoding without special tokens of its own, from a file of ranks."""
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def assemble(turns: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of a conversation. A turn: its ids, the ends of its segments in them, and each segment's loss, 0 or 1."""
    ids = np.concatenate([x for x, _, _ in turns]) if turns else np.empty(0, np.int32)
    step, at = np.zeros(len(ids) + 1, np.int64), 0
    for own, ends, loss in turns:
        np.add.at(step, at + np.concatenate(([0], ends[:-1])), loss)
        np.add.at(step, at + ends, -loss)
        at += len(own)
    return ids.astype(np.int32), np.cumsum(step)[:-1].astype(np.int8)


def shown_of(ids: np.ndarray, enc) -> str:
    """The readable form: control strings for the reserved ids, the escaped texts between."""
    cuts = np.flatnonzero(ids >= FIRST_RESERVED)
    parts = [enc.decode_bytes(ids[: cuts[0]].tolist() if len(cuts) else ids.tolist())]
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ids)], strict=True):
        parts += [CONTROLS[ids[a] - FIRST_RESERVED].encode(), enc.decode_bytes(ids[a + 1 : b].tolist())]
    return b"".join(parts).decode("utf-8")


def format_chats(df: DataFrame, ranks_path: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id, input_ids, loss_mask (0 or 1 for each id), formatted."""
    kind = df.schema[conv_col].dataType.simpleString()
    turn_kind = df.schema[turn_col].dataType.simpleString()
    rows = df.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text")))
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path)
        for batch in batches:
            data, ends, loss = [], [], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                parts = turn_parts(role, text)
                each = [[RESERVED[s]] if control else enc.encode_ordinary(s) for s, control, _ in parts]
                flat = np.array([i for x in each for i in x], np.uint32)
                wide = len(flat) > 0 and int(flat.max()) > 0xFFFF
                data.append((b"\1" + flat.astype("<u4").tobytes()) if wide else (b"\0" + flat.astype("<u2").tobytes()))
                ends.append(np.cumsum([len(x) for x in each]).astype("<u4").tobytes())
                loss.append(bytes(int(x) for _, _, x in parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary()), pa.array(ends, pa.binary()), pa.array(loss, pa.binary())], ["conv", "turn", "data", "ends", "loss"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path)
        now, turns, out, size = object(), [], [], 0
        arrow_kind: pa.DataType | None = None

        def said(turn: tuple) -> tuple[bytes, bytes]:
            """Role and text of a turn, to order turns of equal number by."""
            (role, text), *_ = read_back(np.concatenate(([RESERVED["<s>"]], turn[1])), np.zeros(len(turn[1]) + 1, np.int8), enc)[0]
            return role.encode(), text.encode()

        def close() -> None:
            nonlocal size
            if turns:
                start = (np.array([RESERVED["<s>"]], np.int32), np.array([1]), np.array([0]))
                if len({t[0] for t in turns}) < len(turns):
                    turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, said(t)))
                ids, mask = assemble([start, *(t[1:] for t in turns)])
                out.append((now, ids, mask, shown_of(ids, enc)))
                size += len(ids)
                turns.clear()

        def told() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if out:
                lengths = np.cumsum([0, *(len(x[1]) for x in out)]).astype(np.int32)
                masks = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate([x[2] for x in out])))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], arrow_kind), int_lists([x[1] for x in out]), masks, pa.array([x[3] for x in out], pa.string())], [conv_col, "input_ids", "loss_mask", "formatted"])
                out.clear()
                size = 0

        for batch in batches:
            arrow_kind = batch.column(0).type
            for conv, turn, data, ends, loss in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if conv != now:
                    close()
                    now = conv
                    if len(out) >= 500 or size > 2_000_000:
                        yield from told()
                ids = np.frombuffer(data, "<u4" if data[0] else "<u2", offset=1)
                turns.append((turn, ids.astype(np.int32), np.frombuffer(ends, "<u4").astype(np.int64), np.frombuffer(loss, np.uint8).astype(np.int64)))
        close()
        yield from told()

    encoded = rows.mapInArrow(encode, f"conv {kind}, turn {turn_kind}, data binary, ends binary, loss binary")
    sorted_rows = encoded.repartition("conv").sortWithinPartitions("conv", "turn")
    return sorted_rows.mapInArrow(join, f"{conv_col} {kind}, input_ids array<int>, loss_mask array<tinyint>, formatted string")


def read_back(ids: np.ndarray, mask: np.ndarray, enc) -> tuple[list[tuple[str, str]], list[str]]:
    """The turns (role, text) that the ids say, and the texts under the mask, all unescaped."""
    cuts = np.flatnonzero(ids >= FIRST_RESERVED)
    marks = [CONTROLS[i - FIRST_RESERVED] for i in ids[cuts].tolist()]
    between = [unescape(enc.decode_bytes(ids[a + 1 : b].tolist()).decode("utf-8")) for a, b in zip(cuts, np.append(cuts[1:], len(ids)), strict=True)]
    turns, i = [], 1
    while i < len(marks):
        if marks[i] in _ROLE_OF:
            turns.append((_ROLE_OF[marks[i]], between[i]))
            i += 2
        else:
            turns.append((between[i], between[i + 1]))
            i += 3
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask, [0]))))
    under = [unescape(enc.decode_bytes(ids[a:b].tolist()).decode("utf-8")) for a, b in edges.reshape(-1, 2)]
    return turns, under
