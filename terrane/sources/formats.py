"""Readers of the map-data interchange formats: XML, change files, one-object-per-line text, and the two binary forms.

Every reader gives the same three tables:

    nodes (id, version, ts, changeset, uid, user, op, lon_e7, lat_e7, tags)
    ways  (id, version, ts, changeset, uid, user, op, nodes, tags)
    rels  (id, version, ts, changeset, uid, user, op, members, tags)

``op`` is null in data files, and create, modify or delete in change files. Zero versions, changesets and uids and empty users
are null. Text formats are read in splits; a binary file is read block by block: PBF blobs are found by
a scan of their headers and dealt to tasks, o5m is one stream whose string table can't be entered in the middle.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INVALID = 2147483647
MEMBER = "struct<type:string,ref:bigint,role:string>"
ATTRIBUTES = "id bigint, version int, ts timestamp, changeset bigint, uid bigint, user string, op string"
OBJECT = f"{ATTRIBUTES}, kind string, lon_e7 int, lat_e7 int, nodes array<bigint>, members array<{MEMBER}>, tags map<string,string>"


@dataclass(frozen=True)
class Objects:
    nodes: DataFrame
    ways: DataFrame
    rels: DataFrame


def detect(path: str, given: str | None = None) -> str:
    """The format of a file by its suffix, after .gz or .bz2; ``given`` overrides it."""
    name = given or re.sub(r"\.(gz|bz2)$", "", path.rsplit("/", 1)[-1]).rsplit(".", 1)[-1]
    known = {"osm": "xml", "osh": "xml", "xml": "xml", "osc": "osc", "opl": "opl", "pbf": "pbf", "o5m": "o5m", "o5c": "o5m"}
    if name not in known:
        raise ValueError(f"unknown file format of {path!r}")
    return known[name]


def read(spark: SparkSession, path: str, given: str | None = None) -> Objects | XmlObjects:
    return {"xml": read_xml, "osc": read_osc, "opl": read_opl, "pbf": read_pbf, "o5m": read_o5m}[detect(path, given)](spark, path)


def _by_kind(df: DataFrame) -> Objects:
    """The three tables of rows (OBJECT)."""
    own = ["id", "version", "ts", "changeset", "uid", "user", "op"]
    return Objects(
        df.filter("kind = 'n'").select(*own, "lon_e7", "lat_e7", "tags"),
        df.filter("kind = 'w'").select(*own, "nodes", "tags"),
        df.filter("kind = 'r'").select(*own, "members", "tags"),
    )


# --- XML -----------------------------------------------------------------------------------------------------------

_TAG = "tag array<struct<_k:string,_v:string>>"
_ATTR = "_id bigint, _version int, _timestamp string, _changeset bigint, _uid bigint, _user string, _visible boolean"
# an explicit schema: inference makes a struct of a single child
_XML = {
    "node": f"{_ATTR}, _lat string, _lon string, {_TAG}",
    "way": f"{_ATTR}, nd array<struct<_ref:bigint>>, {_TAG}",
    "relation": f"{_ATTR}, member array<struct<_type:string,_ref:bigint,_role:string>>, {_TAG}",
}


def to_e7(text: Column) -> Column:
    """Degrees as text in units of 1e-7, exactly."""
    return F.coalesce(F.round(text.try_cast("decimal(20,10)") * 10_000_000, 0).cast("int"), F.lit(INVALID))


def _attributes(op: Column) -> list[Column]:
    zero = lambda c: F.when(F.col(c) != 0, F.col(c))
    return [
        F.col("_id").alias("id"), zero("_version").alias("version"), F.to_timestamp("_timestamp").alias("ts"), zero("_changeset").alias("changeset"), zero("_uid").alias("uid"),
        F.when(F.col("_user") != "", F.col("_user")).alias("user"), op.alias("op"),
    ]


def _tags() -> Column:
    return F.map_from_entries(F.coalesce(F.transform("tag", lambda t: F.struct(t["_k"].alias("key"), t["_v"].alias("value"))), F.array().cast("array<struct<key:string,value:string>>"))).alias("tags")


def _op(df: DataFrame) -> Column:
    return F.col("__op") if "__op" in df.columns else F.when(F.col("_visible") == False, "delete").cast("string")  # noqa: E712


def _nodes_of(n: DataFrame) -> DataFrame:
    return n.select(*_attributes(_op(n)), to_e7(F.col("_lon")).alias("lon_e7"), to_e7(F.col("_lat")).alias("lat_e7"), _tags())


def _ways_of(w: DataFrame) -> DataFrame:
    return w.select(*_attributes(_op(w)), F.coalesce(F.transform("nd", lambda x: x["_ref"]), F.array().cast("array<bigint>")).alias("nodes"), _tags())


def _rels_of(r: DataFrame) -> DataFrame:
    member = lambda m: F.struct(F.substring(m["_type"], 1, 1).alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role"))
    return r.select(*_attributes(_op(r)), F.coalesce(F.transform("member", member), F.array().cast(f"array<{MEMBER}>")).alias("members"), _tags())


#: A task reads so many bytes of an XML file, and on to the end of its last element.
XML_SPLIT = 32 << 20
_XML_FORMAT = "org.apache.spark.sql.execution.datasources.xml.XmlInputFormat"
# What the reader that enters a file anywhere would take wrongly, by what follows a "<": markup that may hold tags, ">" in an attribute, a space in an end tag
_UNSAFE = r"""^!(?!--)|^!--(?![\s\S]*-->)|^\?(?![\s\S]*\?>)|^[^>"']*(?:"[^">]*"[^>"']*|'[^'>]*'[^>"']*)*(?:"[^">]*>|'[^'>]*>)|^/[\w:]+\s"""


def _xml_rows(spark: SparkSession, path: str, tag: str, schema: str, whole: bool) -> DataFrame:
    """A row for each element of a name. Spark's own reader takes a file in one task: that is ``whole``, for files that can't be entered anywhere."""
    if whole:
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    conf = {"xmlinput.start": f"<{tag}>", "xmlinput.end": f"</{tag}>", "xmlinput.encoding": "UTF-8", "mapreduce.input.fileinputformat.split.maxsize": str(XML_SPLIT)}
    found = spark.sparkContext.newAPIHadoopFile(path.replace(",", "\\,"), _XML_FORMAT, "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.Text", conf=conf)
    rows = spark.createDataFrame(found.map(lambda row: (row[1],)), "value string")
    return rows.select(F.from_xml("value", schema).alias("o")).select("o.*")


def _one_piece(spark: SparkSession, path: str) -> bool:
    """Whether an XML file holds what tells elements apart only when it is read from its begin."""
    return bool(spark.read.option("lineSep", "<").text(path).filter(F.col("value").rlike(_UNSAFE)).take(1))


class XmlObjects:
    """The tables of :class:`Objects`, each made when it is asked for, since its first element is looked for then."""

    def __init__(self, frame) -> None:
        self._frame = frame

    nodes = cached_property(lambda self: _nodes_of(self._frame("node")))
    ways = cached_property(lambda self: _ways_of(self._frame("way")))
    rels = cached_property(lambda self: _rels_of(self._frame("relation")))


def read_xml(spark: SparkSession, path: str) -> XmlObjects:
    """A data file; each kind is a scan of its own, in splits."""
    whole = _one_piece(spark, path)
    return XmlObjects(lambda kind: _xml_rows(spark, path, kind, _XML[kind], whole))


def read_osc(spark: SparkSession, path: str) -> XmlObjects:
    """A change file: its create, modify and delete sections."""
    section = ", ".join(f"{k} array<struct<{_struct(s)}>>" for k, s in _XML.items())
    whole = _one_piece(spark, path)

    def frame(kind: str) -> DataFrame:
        own = [_xml_rows(spark, path, op, section, whole).select(F.explode(kind).alias("o")).select("o.*").withColumn("__op", F.lit(op)) for op in ("create", "modify", "delete")]
        return reduce(DataFrame.unionByName, own)

    return XmlObjects(frame)


def _struct(schema: str) -> str:
    return T._parse_datatype_string(schema).simpleString()[7:-1]


# --- one object per line -------------------------------------------------------------------------------------------


def unescape(text: Column) -> Column:
    """``%hex%`` escapes of code points."""
    pieces = F.split(text, "%")
    each = F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.decode(F.unhex(F.lpad(p, 8, "0")), "UTF-32")).otherwise(p))
    return F.when(text.contains("%"), F.array_join(each, "")).otherwise(text)


def read_opl(spark: SparkSession, path: str) -> Objects:
    lines = spark.read.text(path).filter(F.col("value").rlike("^[nwr]"))
    words = F.split("value", " ")

    def field(letter: str) -> Column:
        """What follows a letter in the first field that it starts, after the first."""
        found = F.get(F.filter(words, lambda w, i: (i > 0) & w.startswith(letter)), F.lit(0))
        return F.when(F.length(found) > 1, F.substring(found, F.lit(2), F.length(found)))

    zero = lambda c: F.when(c != 0, c)
    pairs = lambda t: F.transform(F.split(t, ","), lambda p: F.struct(unescape(F.get(F.split(p, "=", 2), F.lit(0))).alias("key"), unescape(F.get(F.split(p, "=", 2), F.lit(1))).alias("value")))
    member = lambda m: F.struct(F.substring(m, 1, 1).alias("type"), F.substring(F.get(F.split(m, "@", 2), F.lit(0)), F.lit(2), F.length(m)).cast("bigint").alias("ref"), unescape(F.get(F.split(m, "@", 2), F.lit(1))).alias("role"))
    head = F.get(words, F.lit(0))
    none = lambda kind: F.array().cast(kind)
    rows = lines.select(
        F.substring(head, F.lit(2), F.length(head)).cast("bigint").alias("id"), zero(field("v").try_cast("int")).alias("version"), F.try_to_timestamp(field("t")).alias("ts"),
        zero(field("c").try_cast("bigint")).alias("changeset"), zero(field("i").try_cast("bigint")).alias("uid"), unescape(field("u")).alias("user"), F.when(field("d") == "D", "delete").alias("op"),
        F.substring(head, 1, 1).alias("kind"), to_e7(field("x")).alias("lon_e7"), to_e7(field("y")).alias("lat_e7"),
        F.coalesce(F.when(field("N").isNotNull(), F.transform(F.split(field("N"), ","), lambda n: F.regexp_extract(n, r"^n(\d+)", 1).cast("bigint"))), none("array<bigint>")).alias("nodes"),
        F.coalesce(F.when(field("M").isNotNull(), F.transform(F.split(field("M"), ","), member)), none(f"array<{MEMBER}>")).alias("members"),
        F.map_from_entries(F.coalesce(F.when(field("T").isNotNull(), pairs(field("T"))), none("array<struct<key:string,value:string>>"))).alias("tags"),
    )
    return _by_kind(rows)


# --- PBF -----------------------------------------------------------------------------------------------------------


def varint(b: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        x = b[at]
        at += 1
        out |= (x & 127) << shift
        if x < 128:
            return out, at
        shift += 7


def zigzag(n: int) -> int:
    return n >> 1 ^ -(n & 1)


def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message: ints of varints, bytes of lengths and fixed numbers."""
    at = 0
    while at < len(b):
        key, at = varint(b, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(b, at)
        elif kind == 2:
            n, at = varint(b, at)
            value, at = b[at : at + n], at + n
        else:
            n = {1: 8, 5: 4}[kind]
            value, at = b[at : at + n], at + n
        yield key >> 3, value


def packed(b: bytes) -> list[int]:
    out, at = [], 0
    while at < len(b):
        n, at = varint(b, at)
        out.append(n)
    return out


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _sums(values: list[int]) -> list[int]:
    out, total = [], 0
    for v in values:
        total += zigzag(v)
        out.append(total)
    return out


def blob_data(blob: bytes) -> bytes:
    own = dict(fields(blob))
    if 1 in own:
        return own[1]
    if 3 in own:
        return zlib.decompress(own[3])
    raise ValueError("a blob's compression is unknown")


def pbf_block(data: bytes) -> Iterator[tuple]:
    """Rows (OBJECT) of a primitive block."""
    import datetime

    strings: list[str] = []
    groups, granularity, date_granularity, lat_off, lon_off = [], 100, 1000, 0, 0
    for n, v in fields(data):
        if n == 1:
            strings = [s.decode("utf-8", "replace") for k, s in fields(v) if k == 1]
        elif n == 2:
            groups.append(v)
        elif n == 17:
            granularity = v
        elif n == 18:
            date_granularity = v
        elif n == 19:
            lat_off = _signed(v)
        elif n == 20:
            lon_off = _signed(v)

    def when(n: int):
        return datetime.datetime.fromtimestamp(n * date_granularity / 1000, datetime.timezone.utc) if n else None

    e7 = lambda off, n: (off + granularity * n) // 100

    def info(b: bytes | None) -> tuple:
        own = dict(fields(b)) if b else {}
        gone = "delete" if own.get(6, 1) == 0 else None
        return (_signed(own.get(1, 0)) or None, when(own.get(2, 0)), own.get(3, 0) or None, own.get(4, 0) or None, strings[own.get(5, 0)] or None if strings else None, gone)

    def tags(own: dict) -> dict:
        return {strings[k]: strings[v] for k, v in zip(packed(own.get(2, b"")), packed(own.get(3, b"")))}

    for group in groups:
        for n, v in fields(group):
            own = dict(fields(v))
            if n == 1:
                yield (zigzag(own[1]), *info(own.get(4)), "n", e7(lon_off, zigzag(own[9])), e7(lat_off, zigzag(own[8])), None, None, tags(own))
            elif n == 2:
                ids, lats, lons = (_sums(packed(own.get(k, b""))) for k in (1, 8, 9))
                about = dict(fields(own[5])) if 5 in own else {}
                versions = packed(about.get(1, b"")) or [0] * len(ids)
                stamps, sets, uids, users = (_sums(packed(about.get(k, b""))) or [0] * len(ids) for k in (2, 3, 4, 5))
                visible = packed(about.get(6, b"")) or [1] * len(ids)
                keys, at = packed(own.get(10, b"")), 0
                for i, node in enumerate(ids):
                    mine = {}
                    while at < len(keys) and keys[at]:
                        mine[strings[keys[at]]] = strings[keys[at + 1]]
                        at += 2
                    at += 1
                    yield (node, versions[i] or None, when(stamps[i]), sets[i] or None, uids[i] or None, strings[users[i]] or None, None if visible[i] else "delete", "n", e7(lon_off, lons[i]), e7(lat_off, lats[i]), None, None, mine)
            elif n == 3:
                yield (_signed(own[1]), *info(own.get(4)), "w", None, None, _sums(packed(own.get(8, b""))), None, tags(own))
            elif n == 4:
                roles, refs, kinds = packed(own.get(8, b"")), _sums(packed(own.get(9, b""))), packed(own.get(10, b""))
                yield (_signed(own[1]), *info(own.get(4)), "r", None, None, None, [("nwr"[k], ref, strings[role]) for role, ref, k in zip(roles, refs, kinds)], tags(own))


def pbf_blobs(data: bytes) -> Iterator[tuple[str, int, int]]:
    """(type, start, size) of every blob in a file's bytes."""
    at = 0
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        head = dict(fields(data[at + 4 : at + 4 + n]))
        at += 4 + n
        yield head[1].decode(), at, head[3]
        at += head[3]


def read_pbf(spark: SparkSession, path: str) -> Objects:
    """The files' bytes come from Spark's binary reader, so that any store will do; blobs are dealt to tasks before decoding."""

    def cut(rows) -> Iterator:
        import pandas as pd

        for pdf in rows:
            for data in pdf["content"]:
                for kind, at, size in pbf_blobs(data):
                    if kind == "OSMData":
                        yield pd.DataFrame({"blob": [data[at : at + size]]})

    blobs = spark.read.format("binaryFile").load(path).select("content").mapInPandas(cut, "blob binary").repartition(max(1, spark.sparkContext.defaultParallelism))
    return _by_kind(blobs.rdd.flatMap(lambda r: pbf_block(blob_data(bytes(r.blob)))).toDF(OBJECT))


# --- o5m -----------------------------------------------------------------------------------------------------------


def o5m_objects(data: bytes) -> Iterator[tuple]:
    """Rows (OBJECT) of a file's bytes: numbers are differences to the last of their sort, strings may point back at a table of 15,000."""
    import datetime

    at, table = 0, []
    ids = {0x10: 0, 0x11: 0, 0x12: 0}
    stamp = changeset = lon = lat = ref = 0
    refs = {"n": 0, "w": 0, "r": 0}

    def text(b: bytes, p: int, pair: bool) -> tuple[tuple[bytes, ...], int]:
        if b[p] == 0:
            end = b.index(0, p + 1)
            first = b[p + 1 : end]
            if pair:
                end2 = b.index(0, end + 1)
                got, p = (first, b[end + 1 : end2]), end2 + 1
            else:
                got, p = (first,), end + 1
            if sum(map(len, got)) <= 250:
                table.insert(0, got)
                del table[15000:]
            return got, p
        n, p = varint(b, p)
        return table[n - 1], p

    def user(b: bytes, p: int) -> tuple[int, str, int]:
        if b[p] != 0:
            n, p = varint(b, p)
            got = table[n - 1]
            return varint(got[0], 0)[0] if got[0] else 0, got[1].decode("utf-8", "replace"), p
        uid, q = varint(b, p + 1)
        raw = b[p + 1 : q]
        end = b.index(0, q + 1)
        got = (raw if uid else b"", b[q + 1 : end])
        table.insert(0, got)
        del table[15000:]
        return uid, got[1].decode("utf-8", "replace"), end + 1

    while at < len(data):
        kind = data[at]
        at += 1
        if kind == 0xFF:
            table.clear()
            ids = dict.fromkeys(ids, 0)
            stamp = changeset = lon = lat = ref = 0
            refs = dict.fromkeys(refs, 0)
            continue
        if kind >= 0xF0:
            if kind == 0xFE:
                return
            continue
        size, at = varint(data, at)
        b, at = data[at : at + size], at + size
        if kind not in ids:
            continue
        n, p = varint(b, 0)
        ids[kind] += zigzag(n)
        version, p = varint(b, p)
        when, uid, name = None, 0, ""
        if version:
            n, p = varint(b, p)
            stamp += zigzag(n)
            if stamp:
                n, p = varint(b, p)
                changeset += zigzag(n)
                uid, name, p = user(b, p)
                when = datetime.datetime.fromtimestamp(stamp, datetime.timezone.utc)
        gone = p >= len(b)
        own_lon = own_lat = nodes = members = None
        if kind == 0x10 and not gone:
            n, p = varint(b, p)
            lon += zigzag(n)
            n, p = varint(b, p)
            lat += zigzag(n)
            own_lon, own_lat = lon, lat
        elif kind != 0x10 and not gone:
            n, p = varint(b, p)
            end = p + n
            if kind == 0x11:
                nodes = []
                while p < end:
                    n, p = varint(b, p)
                    ref += zigzag(n)
                    nodes.append(ref)
            else:
                members = []
                while p < end:
                    n, p = varint(b, p)
                    (raw,), p = text(b, p, False)
                    t = "nwr"[raw[0] - 48]
                    refs[t] += zigzag(n)
                    members.append((t, refs[t], raw[1:].decode("utf-8", "replace")))
        tags = {}
        while p < len(b):
            (k, v), p = text(b, p, True)
            tags[k.decode("utf-8", "replace")] = v.decode("utf-8", "replace")
        yield (ids[kind], version or None, when, changeset if when and changeset else None, uid or None, name or None, "delete" if gone else None, {0x10: "n", 0x11: "w", 0x12: "r"}[kind], own_lon, own_lat, nodes, members, tags)


def read_o5m(spark: SparkSession, path: str) -> Objects:
    files = spark.read.format("binaryFile").load(path).select("content")
    return _by_kind(files.rdd.flatMap(lambda r: o5m_objects(bytes(r.content))).toDF(OBJECT))
