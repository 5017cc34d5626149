"""Secret scans with multipart credential linking.

Base spans (assignments, access identifiers, hex runs) are always reported. Beyond them, parts that prove nothing alone are
weak candidates: user or client identifiers, short or unlabelled secrets, endpoints. Each is an interval of the text; an
interval join within ``scope`` characters, by bisection over the sorted starts of each role, finds the complementary parts,
and a weak candidate is reported only when an identifier and a secret (base or weak, itself included) co-occur there; an
endpoint is reported when both do. An unlabelled secret is a whole run of 20 or more base64 characters, with a digit and
letters of both cases anywhere in it. The join tests for existence, so it never emits pairs.

Defined results: a null text is an empty one and has no span; rows that repeat are scanned each; texts are scanned whole;
offsets are code points, ends exclusive; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCOPE = 400
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "identifier", "short_secret", "opaque", "endpoint")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # a shorter run fails whole, so the longer ones are the same
_IDENTIFIER = re.compile(r"""(?:user_?name|user_?id|client_?id|account_?id|login|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""", re.I | re.A)
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])")  # whole runs of any length
_MIXED = tuple(re.compile(x) for x in ("[0-9]", "[A-Z]", "[a-z]"))
_ENDPOINT = re.compile(r"""(?:https?|postgres|postgresql|mysql|mongodb|redis|amqp|s3|ftp|ssh)://[^\s"'<>]+|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{4,}(?::\d{2,5})?""", re.I | re.A)
_LABELS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_IDS = ("username", "user_name", "userid", "user_id", "clientid", "client_id", "accountid", "account_id", "login", "keyid", "key_id")
_ENDS = ("://", "host", "endpoint", "server")

Span = tuple[int, str, int]  # start, kind, end


def base_spans(text: str, low: str | None = None) -> tuple[list[Span], list[Span]]:
    """The base spans, and the assignments whose value is too short for one."""
    low = text.lower() if low is None else low
    strong: list[Span] = []
    short: list[Span] = []
    if any(x in low for x in _LABELS):
        for m in _ASSIGN.finditer(text):
            size = m.end(2) - m.start(2)
            if size >= 12:
                strong.append((m.start(), "assign", m.end()))
            elif size >= 6:
                short.append((m.start(), "short_secret", m.end()))
    if "AKIA" in text:
        strong += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    strong += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return strong, short


class _Near:
    """Whether an interval of these lies within ``scope`` characters of another."""

    def __init__(self, spans: list[Span], scope: int) -> None:
        self.spans, self.scope = sorted(spans), scope
        self.starts = [s for s, _, _ in self.spans]
        self.reach: list[int] = []  # the largest end so far: intervals may hold others
        for _, _, e in self.spans:
            self.reach.append(max(e, self.reach[-1]) if self.reach else e)

    def of(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end + self.scope + 1)
        return i > 0 and self.reach[i - 1] >= start - self.scope


def spans(text: str | None, scope: int = SCOPE) -> list[Span]:
    """All spans, by start and then by kind as in KINDS."""
    text = text or ""
    low = text.lower()
    strong, short = base_spans(text, low)
    weak_ids = [(m.start(), "identifier", m.end()) for m in _IDENTIFIER.finditer(text)] if any(x in low for x in _IDS) else []
    identifiers = weak_ids + [s for s in strong if s[1] == "access"]
    found = list(strong)
    if identifiers:
        opaque = [(m.start(), "opaque", m.end()) for m in _OPAQUE.finditer(text) if all(x.search(m[0]) for x in _MIXED)]
        opaque = [o for o in opaque if not any(s[0] < o[2] and o[0] < s[2] for s in strong)] if len(opaque) * len(strong) < 10_000 else _outside(opaque, strong)
        secrets = short + opaque + [s for s in strong if s[1] != "access"]
        if secrets:
            by_id, by_secret = _Near(identifiers, scope), _Near(secrets, scope)
            found += [x for x in weak_ids if by_secret.of(x[0], x[2])] + [x for x in short + opaque if by_id.of(x[0], x[2])]
            if any(x in low for x in _ENDS):
                ends = [(m.start(), "endpoint", m.end()) for m in _ENDPOINT.finditer(text)]
                found += [x for x in ends if by_id.of(x[0], x[2]) and by_secret.of(x[0], x[2])]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def _outside(candidates: list[Span], others: list[Span]) -> list[Span]:
    near = _Near(others, -1)
    return [c for c in candidates if not near.of(c[0], c[2])]


def told(found: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in found)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per input row: id, spans (array of kind, start, end)."""
    kind = df.schema[id_col].dataType.simpleString()
    row = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[{"kind": k, "start": a, "end": b} for a, k, b in spans(x.as_py(), scope)] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, row)], [id_col, "spans"])

    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(of, f"{id_col} {kind}, spans array<struct<kind:string,start:long,end:long>>")


def scan_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Counts and digests derived from :func:`scan`'s spans."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return scan(df, id_col, text_col, scope).select(id_col, *map(count, BASE), F.sha2(F.array_join(F.transform(base, line), ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("spans", line), ",").alias("spans"))


def redact(df: DataFrame, text_col: str = "text", scope: int = SCOPE, mark: str = "[{kind}]", chars_col: str | None = "n_chars") -> DataFrame:
    """The rows with each span's text replaced by a mark; overlapping spans become one. ``chars_col`` follows the new length."""
    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None or not (found := spans(text, scope)):
                return text
            out, at = [], 0
            for a, kind, b in found:
                if a >= at:
                    out += [text[at:a], mark.format(kind=kind)]
                at = max(at, b)
            return "".join([*out, text[at:]])

        return texts.map(one, na_action="ignore")

    out = df.withColumn(text_col, clean(F.col(text_col).cast("string")))
    return out.withColumn(chars_col, F.length(text_col).cast(df.schema[chars_col].dataType)) if chars_col in df.columns else out


def digest_of(found: list[Span]) -> str:
    return hashlib.sha256(told([s for s in found if s[1] in BASE]).encode()).hexdigest()
