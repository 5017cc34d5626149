"""Tag and text functions: native expressions over strings and map<string,string> columns."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT2, INT4, INT8 = (-(1 << 15), (1 << 15) - 1), (-(1 << 31), (1 << 31) - 1), (-(1 << 63), (1 << 63) - 1)
SPACE = r"[ \t\r\n\f\x0B]"


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- maps ----------------------------------------------------------------------------------------------------------


def grab_tag(tags: Column, key: str) -> tuple[Column, Column]:
    """The tag's value, and the tags without it."""
    return F.try_element_at(tags, F.lit(key)), F.map_filter(tags, lambda k, v: k != key)


def matches_any(key: Column, patterns: Iterable[str]) -> Column:
    """Exact keys, prefixes (``note:*``) and suffixes (``*:source``); a lone ``*`` matches all."""
    tests = []
    for p in patterns:
        if p.endswith("*"):
            tests.append(key.startswith(p[:-1]))
        elif p.startswith("*"):
            tests.append(key.endswith(p[1:]))
        else:
            tests.append(key == p)
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def clean_tags(tags: Column, patterns: Iterable[str]) -> Column:
    """Tags without those whose key matches; test ``size(...) = 0`` for "nothing left"."""
    patterns = list(patterns)
    return F.map_filter(tags, lambda k, v: ~matches_any(k, patterns))


def glob_to_regex(glob: str) -> str:
    """A regular expression of a pattern with ``*`` and ``?``."""
    special = set(r"\.[]{}()+-^$|")
    return "^" + "".join(".*" if x == "*" else "." if x == "?" else "\\" + x if x in special else x for x in glob) + "$"


def glob_match(text: Column, glob: str) -> Column:
    return text.rlike("(?s)" + glob_to_regex(glob))


def check_values(value: Column, allowed: Iterable[str], default: str | None = None) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default))


def with_attributes(tags: Column, **attributes: Column) -> Column:
    """Tags with an object's attributes added as ``osm_*``; absent ones add nothing."""
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in attributes.items()]), lambda e: e["value"].isNotNull())
    return F.map_concat(F.map_filter(tags, lambda k, v: ~k.isin(*attributes)), F.map_from_entries(entries))


def tags_text(tags: Column) -> Column:
    """Canonical text of the tags: ``key=value`` sorted by key, joined by ``;``."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def tags_json(tags: Column) -> Column:
    """JSON object with its keys sorted."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(tags))))


def prefix_column(tags: Column, prefix: str) -> Column:
    """Tags with the prefix, under what follows it; null if there is none."""
    own = F.map_filter(tags, lambda k, v: k.startswith(prefix) & (F.length(k) > len(prefix)))
    return F.when(F.size(own) > 0, F.transform_keys(own, lambda k, v: F.substring(k, F.lit(len(prefix) + 1), F.length(k))))


def rest_column(tags: Column, used: Iterable[str], mode: str) -> Column:
    """The map column of the legacy tables. ``norm``: keys without a column; ``all``: every key. Never z_order."""
    gone = ["z_order", *(used if mode == "norm" else ())]
    return F.map_filter(tags, lambda k, v: ~k.isin(*gone))


# --- strings -------------------------------------------------------------------------------------------------------


def trim_ws(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def split_string(text: Column, sep: str = ";") -> Column:
    """The trimmed, non-empty pieces."""
    return F.filter(F.transform(F.split(text, glob_to_regex(sep)[1:-1]), trim_ws), lambda x: x != "")


def split_unit(text: Column, default: str | None = None) -> Column:
    """struct(value, unit) of a number with an optional unit; null if the text is something else."""
    pattern = r"^(-?[0-9.]+) ?([A-Za-z]*)$"
    unit = F.regexp_extract(text, pattern, 2)
    value = F.regexp_extract(text, pattern, 1).try_cast("double")
    return F.when(text.rlike(pattern) & value.isNotNull(), F.struct(value.alias("value"), F.when(unit == "", F.lit(default)).otherwise(unit).alias("unit")))


def clamp(value: Column, low, high) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def has_prefix(text: Column, prefix: str) -> Column:
    return text.startswith(prefix)


def has_suffix(text: Column, suffix: str) -> Column:
    return text.endswith(suffix)


# --- coercions -----------------------------------------------------------------------------------------------------


def to_bool(text: Column) -> Column:
    return F.when(text.isin("yes", "true", "1"), True).when(text.isin("no", "false", "0"), False)


def number_to_bool(x: Column) -> Column:
    return x != 0


def to_direction(text: Column) -> Column:
    return F.when(text.isin("yes", "1"), 1).when(text.isin("no", "0"), 0).when(text == "-1", -1).cast("smallint")


def number_to_direction(x: Column) -> Column:
    return F.signum(x.cast("double")).cast("smallint")


def to_int(text: Column, bounds: tuple[int, int] = INT4) -> Column:
    """The whole text as a number in the bounds, else null; leading white space and a sign are allowed."""
    number = F.when(text.rlike(r"^\s*[+-]?\d{1,19}$"), F.regexp_replace(text, r"^\s*\+?", "")).try_cast("decimal(20,0)")
    kind = {INT2: "smallint", INT4: "int", INT8: "bigint"}[bounds]
    return F.when(number.between(F.lit(bounds[0]).cast("decimal(20,0)"), F.lit(bounds[1]).cast("decimal(20,0)")), number).cast(kind)


def number_to_int(x: Column, bounds: tuple[int, int] = INT4) -> Column:
    """A number with a fraction has no integer representation and becomes 0; out of bounds: null."""
    kind = {INT2: "smallint", INT4: "int", INT8: "bigint"}[bounds]
    return F.when(x != F.floor(x), F.lit(0)).when(x.between(*bounds), x).cast(kind)


def to_real(text: Column) -> Column:
    return F.when(text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.regexp_replace(text, r"\s", "")).try_cast("double")


def to_timestamp(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def _first_int(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("bigint")


def int32(x: Column) -> Column:
    """A long cut to its 32 lower bits, as a signed integer."""
    return (F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)).cast("int")


def legacy_int(text: Column) -> Column:
    """``a``, or the mean of ``a-b``, from the text's beginning; null beyond int4. Signs and leading white space are allowed.

    Halves are cut toward zero one by one and then the halves of what was cut, so that nothing overflows.
    """
    pattern = r"^\s*([+-]?\d{1,18})(?:-\s*([+-]?\d{1,18}))?"
    a, b = (_first_int(text, pattern, i) for i in (1, 2))
    half = lambda x: ((x - x % 2) / 2).cast("bigint")
    value = F.when(b.isNotNull(), half(a) + half(b) + half(a % 2 + b % 2)).otherwise(a)
    return F.when(value.between(*INT4), value).cast("int")


def legacy_real(text: Column) -> Column:
    """A number with a decimal comma or point and an exponent; the mean of ``a-b``; feet (the text ends in ``ft``) become metres.

    Infinities, NaN and hexadecimal numbers are null.
    """
    number = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
    dotted = F.regexp_replace(text, ",", ".")
    pattern = rf"^\s*({number})(?![eE])(?:-\s*({number})(?![eE]))?"
    a, b = (F.regexp_extract(dotted, pattern, i).try_cast("double") for i in (1, 2))
    value = F.when(b.isNotNull(), (a + b) / 2).otherwise(a)
    return F.when(dotted.endswith("ft"), value * 0.3048).otherwise(value)


def value_to_bool(text: Column, default: bool) -> Column:
    """Only the values that contradict the default change it."""
    return F.when(text.isin("yes", "true", "1"), True).otherwise(False) if not default else F.when(text.isin("no", "false", "0"), False).otherwise(True)


# --- derived tags of the legacy tables -----------------------------------------------------------------------------

# Offset in the drawing order, and whether the class belongs to the roads table.
HIGHWAYS = {
    "proposed": (1, False), "construction": (2, False), "steps": (10, False), "cycleway": (10, False), "bridleway": (10, False), "footway": (10, False),
    "path": (10, False), "track": (11, False), "service": (15, False), "tertiary_link": (24, False), "secondary_link": (25, True), "primary_link": (27, True),
    "trunk_link": (28, True), "motorway_link": (29, True), "raceway": (30, False), "pedestrian": (31, False), "living_street": (32, False), "road": (33, False),
    "unclassified": (33, False), "residential": (33, False), "tertiary": (34, False), "secondary": (36, True), "primary": (37, True), "trunk": (38, True), "motorway": (39, True),
}


def tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def z_order(tags: Column) -> Column:
    """100 for each layer, the highway's offset, 35 for a railway, 100 up for a bridge and down for a tunnel."""
    offsets = F.create_map(*[F.lit(x) for k, (n, _) in HIGHWAYS.items() for x in (k, n)])
    layer = F.coalesce(_first_int(tag(tags, "layer"), r"^\s*([+-]?\d{1,18})", 1), F.lit(0))
    return int32(
        100 * int32(layer).cast("bigint")
        + F.coalesce(F.try_element_at(offsets, tag(tags, "highway")), F.lit(0))
        + F.when(F.coalesce(tag(tags, "railway"), F.lit("")) != "", 35).otherwise(0)
        + F.when(value_to_bool(tag(tags, "bridge"), False), 100).otherwise(0)
        - F.when(value_to_bool(tag(tags, "tunnel"), False), 100).otherwise(0)
    )


def is_road(tags: Column) -> Column:
    road = tag(tags, "highway").isin(*[k for k, (_, r) in HIGHWAYS.items() if r])
    return F.coalesce(road, F.lit(False)) | (F.coalesce(tag(tags, "railway"), F.lit("")) != "") | F.coalesce(tag(tags, "boundary") == "administrative", F.lit(False))


def is_polygon(tags: Column, polygon_keys: Iterable[str], closed: Column, all_tags: Column | None = None) -> Column:
    """A closed way with a polygon key, unless ``area`` says otherwise; a coastline is always an area. ``all_tags``: the tags before a
    style filtered them, in which area and coastline are looked up."""
    keys, own = list(polygon_keys), tags
    has = F.exists(F.map_keys(own), lambda k: k.isin(*keys)) if keys else F.lit(False)
    tags = own if all_tags is None else all_tags
    area = tag(tags, "area")
    wanted = F.when(area.isNull(), has).when(has, value_to_bool(area, True)).otherwise(value_to_bool(area, False))
    return closed & (wanted | F.coalesce(tag(tags, "natural") == "coastline", F.lit(False)))


def route_network(tags: Column) -> Column:
    """The network class of a cycle or walking route (lcn, rcn, ncn, lwn, rwn, nwn), or null."""
    network = tag(tags, "network")
    known = network.isin("lcn", "rcn", "ncn", "lwn", "rwn", "nwn")
    return F.when(known, network)


def route_color(tags: Column) -> Column:
    color = tag(tags, "preferred_color")
    return F.when(color.isin("0", "1", "2", "3", "4"), color).otherwise("0")


def route_tags(tags: Column) -> Column:
    """The tags that a relation hands to its lines: all but ``type``; for a route also ``route_name``, its network's state and ref,
    and ``route_pref_color``. What the relation says itself stays."""
    network, state = route_network(tags), tag(tags, "state")
    told = F.when(state.isin("alternate", "connection"), state).otherwise("yes")
    color = tag(tags, "preferred_color")
    entry = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    made = F.array(
        entry(F.lit("route_name"), tag(tags, "name")),
        entry(network, told),
        entry(F.lit("route_pref_color"), F.when(color.isin("0", "1", "2", "3", "4"), color).otherwise("0")),
        entry(F.concat(network, F.lit("_ref")), tag(tags, "ref")),
    )
    own = F.map_filter(tags, lambda k, v: k != "type")
    new = F.filter(made, lambda e: e["key"].isNotNull() & e["value"].isNotNull() & ~F.map_contains_key(tags, F.coalesce(e["key"], F.lit(""))))
    return F.when(tag(tags, "type") == "route", F.map_concat(own, F.map_from_entries(new))).otherwise(own)


def makes_boundary(tags: Column) -> Column:
    """Relations whose rings are lines and polygons at once."""
    kind = tag(tags, "type")
    return F.coalesce((kind == "boundary") | ((kind == "multipolygon") & tag(tags, "boundary").isNotNull()), F.lit(False))


# --- JSON ----------------------------------------------------------------------------------------------------------


def _json_text(value: Column) -> Column:
    """A JSON string."""
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def json_of(value: Column, kind: T.DataType) -> Column:
    """JSON of any nested value: nulls are written, an empty array is an empty object, a double without a fraction an integer; the keys
    of maps are sorted and must be strings."""
    if isinstance(kind, T.StructType):
        parts = [F.concat(_json_text(F.lit(f.name)), F.lit(":"), json_of(value.getField(f.name), f.dataType)) for f in kind.fields]
        made = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, T.MapType):
        if not isinstance(kind.keyType, T.StringType):
            raise ValueError(f"incorrect data type {kind.keyType.simpleString()!r} as key")
        each = F.transform(F.array_sort(F.map_keys(value)), lambda k: F.concat(_json_text(k), F.lit(":"), json_of(F.element_at(value, k), kind.valueType)))
        made = F.concat(F.lit("{"), F.array_join(each, ","), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        each = F.array_join(F.transform(value, lambda x: json_of(x, kind.elementType)), ",")
        made = F.when(F.size(value) == 0, "{}").otherwise(F.concat(F.lit("["), each, F.lit("]")))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (value == F.floor(value)) & (F.abs(value) < 2.0**63)
        made = F.when(whole, F.when(whole, value).cast("bigint").cast("string")).otherwise(value.cast("string"))
    elif isinstance(kind, T.StringType):
        made = _json_text(value)
    elif isinstance(kind, (T.BooleanType, T.IntegralType)):
        made = value.cast("string")
    else:
        raise ValueError(f"invalid type {kind.simpleString()!r} for JSON")
    return F.when(value.isNull(), "null").otherwise(made)


# --- ids -----------------------------------------------------------------------------------------------------------


def pack_any_id(kind: Column, ident: Column) -> Column:
    """One number for any object: nodes as they are, ways negative, relations below -10^17."""
    return F.when(kind == "N", ident).when(kind == "W", -ident).otherwise(-ident - F.lit(10**17))


def pack_area_id(kind: Column, ident: Column) -> Column:
    return F.when(kind == "R", -ident).otherwise(ident)


def check_identifier(name: str) -> str:
    """The name, unless it is empty or has a character that identifiers of output tables must not have."""
    if not name or any(x in name for x in "\"',.;$%&/()<>{}=?^*#"):
        raise ValueError(f"special characters are not allowed in the identifier {name!r}")
    return name
