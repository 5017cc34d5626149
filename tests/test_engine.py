import duckdb
import pytest
from pyspark.sql import functions as F

from terrane.functions import tags as A
from terrane.functions import tiles as T
from terrane.operators import changes, expire, generalize
from terrane.plans import catalogue, legacy, tables
from terrane.sources import formats
from terrane.streaming import updates

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def key(row):
    return tuple(str(round(v, 6) if isinstance(v, float) else v) for v in row)


@pytest.mark.parametrize("name", ["way_linestring", "rel_multiline", "z_order_roads", "expire_lines", "locator_all", "affected_closure", "discrete_isolation", "event_sessions"])
def test_against_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    df = catalogue.queries()[name](spark, SMALL)
    want = con.sql(catalogue.oracle_sql()[name])
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(map(key, df.collect())) == sorted(key(r[i] for i in order) for r in want.fetchall())


def test_incremental_equals_full(spark):
    assert catalogue.queries()["incremental_equals_full"](spark, SMALL).first()[0] == 0


def test_number_coercions(spark):
    row = spark.range(1).select(A.number_to_int(F.lit(0.5)).alias("a"), A.number_to_int(F.lit(-0.5)).alias("b"), A.number_to_int(F.lit(40000), A.INT2).alias("c"), A.to_int(F.lit("99999999999")).alias("d"), A.to_int(F.lit("12x")).alias("e")).first()
    assert tuple(row) == (0, 0, None, None, None)


def test_tiles(spark):
    row = spark.range(1).select(T.parse_tile(F.lit("3/7/8")).alias("bad"), T.parse_tile(F.lit("3/7/1")).alias("ok"), F.size(expire.point_tiles(F.lit(0.0), F.lit(0.0), 10)).alias("corner"), expire.point_tiles(F.lit(20037508.34), F.lit(5.0), 10, 0.2).alias("edge")).first()
    assert row.bad is None and tuple(row.ok) == (3, 7, 1) and row.corner == 4
    assert {t.x for t in row.edge} == {0, 1023}
    four = spark.createDataFrame([(0, 0), (1, 0), (0, 1), (1, 1)], "x int, y int")
    assert expire.pyramid(four, 18, 17).count() == 5
    for fault in ({"maxzoom": 0}, {"maxzoom": 21}, {"maxzoom": 5, "minzoom": 6}):
        with pytest.raises(ValueError):
            expire.ExpireOutput(**fault)


def test_expire_of_a_moved_way(spark):
    import math

    def merc(lon, lat):
        return 6378137.0 * math.radians(lon), 6378137.0 * math.log(math.tan(math.pi / 4 + math.radians(lat) / 2))

    def found(points):
        at = [merc(*p) for p in points]
        rows = spark.createDataFrame([(1, *a, *b) for a, b in zip(at, at[1:])], "id int, ax double, ay double, bx double, by double")
        return {(r.x, r.y) for r in expire.expire_lines(rows, 8).collect()}

    want = {(x, 127) for x in range(127, 131)} | {(x, 128) for x in range(127, 130)}
    assert found([(0, 0), (2, 0), (2, 1), (4, 1)]) == want


def test_styles():
    rules = legacy.parse_style("node,way name text linear\nway wa* text delete # gone")
    assert [r.tag for r in legacy.columns(rules, "node")] == ["name"]
    for bad in ("", "node name", "relation name text", "node na* text linear"):
        with pytest.raises(ValueError):
            legacy.parse_style(bad)


def test_tables(spark):
    with pytest.raises(ValueError):
        tables.Column_("a", "nothing")
    with pytest.raises(ValueError):
        tables.Table("a;b", ())
    ctx = tables.Context()
    t = ctx.define_table(tables.Table("t", (tables.Column_("n", "int4", not_null=True),), ids="any"))
    with pytest.raises(ValueError):
        ctx.define_table(t)
    rows, told = t.project(spark.createDataFrame([("W", 3, "5"), ("R", 4, "x")], "k string, i long, v string"), {"n": F.col("v")}, F.col("k"), F.col("i"))
    assert [tuple(r) for r in rows.collect()] == [(-3, 5)] and [tuple(r) for r in told.collect()] == [("n", 1)]


OPL = """n10 v2 dV c5 t2020-01-02T03:04:05Z i7 uAl%20%ice Tamenity=cafe,name=a%2c%b x1.5 y-2.25
w20 v1 dV Thighway=primary Nn10,n11
r30 v1 dD
r31 v1 dV Ttype=route Mw20@main,n10@
"""
XML = """<osm><node id="10" version="2" timestamp="2020-01-02T03:04:05Z" lat="-2.25" lon="1.5"><tag k="amenity" v="cafe"/></node>
<way id="20" version="1"><nd ref="10"/><nd ref="11"/><tag k="highway" v="primary"/></way>
<relation id="31"><member type="way" ref="20" role="main"/></relation></osm>"""
OSC = '<osmChange><create><node id="1" version="1" lat="1" lon="2"/></create><delete><way id="2" version="3"/></delete></osmChange>'


def test_text_formats(spark, tmp_path):
    for name, text in (("a.opl", OPL), ("a.osm", XML), ("a.osc", OSC)):
        (tmp_path / name).write_text(text)
    o = formats.read(spark, str(tmp_path / "a.opl"))
    n = o.nodes.first()
    assert (n.id, n.version, n.user, n.lon_e7, n.lat_e7, n.tags) == (10, 2, "Al ice", 15000000, -22500000, {"amenity": "cafe", "name": "a,b"})
    assert o.ways.first().nodes == [10, 11]
    r = {x.id: x for x in o.rels.collect()}
    assert r[30].op == "delete" and [tuple(m) for m in r[31].members] == [("w", 20, "main"), ("n", 10, "")]
    x = formats.read(spark, str(tmp_path / "a.osm"))
    assert x.nodes.first().lon_e7 == 15000000 and x.ways.first().nodes == [10, 11] and x.rels.first().members[0].type == "w"
    c = formats.read(spark, str(tmp_path / "a.osc"))
    assert c.nodes.first().op == "create" and c.ways.first().op == "delete"
    with pytest.raises(ValueError):
        formats.detect("a.txt")


def _v(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _f(n, value):
    return _v(n << 3) + _v(value) if isinstance(value, int) else _v(n << 3 | 2) + _v(len(value)) + value


def _z(n):
    return n << 1 ^ n >> 63


def test_binary_formats(spark, tmp_path):
    import struct
    import zlib

    dense = _f(1, _v(_z(10)) + _v(_z(1))) + _f(8, _v(_z(-22500000)) + _v(_z(10))) + _f(9, _v(_z(15000000)) + _v(_z(5))) + _f(10, _v(1) + _v(2) + _v(0) + _v(0))
    way = _f(1, 20) + _f(2, _v(1)) + _f(3, _v(2)) + _f(8, _v(_z(10)) + _v(_z(1)))
    block = _f(1, b"".join(_f(1, s) for s in (b"", b"k", b"v"))) + _f(2, _f(2, dense)) + _f(2, _f(3, way))
    blob = _f(3, zlib.compress(block)) + _f(2, len(block))
    head = _f(1, b"OSMData") + _f(3, len(blob))
    (tmp_path / "a.pbf").write_bytes(struct.pack(">I", len(head)) + head + blob)
    o = formats.read(spark, str(tmp_path / "a.pbf"))
    n = {x.id: x for x in o.nodes.collect()}
    assert (n[10].lon_e7, n[10].lat_e7, n[10].tags, n[11].lon_e7) == (15000000, -22500000, {"k": "v"}, 15000005)
    assert o.ways.first().nodes == [10, 11] and o.ways.first().tags == {"k": "v"}

    node = _v(_z(10)) + _v(0) + _v(_z(15000000)) + _v(_z(-22500000)) + b"\0k\0v\0"
    refs = _v(_z(10)) + _v(_z(1))
    way = _v(_z(20)) + _v(0) + _v(len(refs)) + refs + _v(1)
    (tmp_path / "a.o5m").write_bytes(b"\xff" + b"\x10" + _v(len(node)) + node + b"\x11" + _v(len(way)) + way + b"\xfe")
    o = formats.read(spark, str(tmp_path / "a.o5m"))
    assert o.nodes.first().lon_e7 == 15000000 and o.nodes.first().tags == {"k": "v"}
    assert o.ways.first().nodes == [10, 11] and o.ways.first().tags == {"k": "v"}


def test_replication():
    assert updates.sequence_path(1234567) == "001/234/567"
    s = updates.parse_state("#x\nsequenceNumber=12\ntimestamp=2020-01-02T03\\:04\\:05Z")
    assert s == {"sequence": 12, "timestamp": "2020-01-02T03:04:05Z"}
    r = updates.Replication("u", 10, "2020")
    assert r.pending(13, {11: 400, 12: 200, 13: 1}, 500) == [11]
    r.done(9, "2019")
    assert r.state["replication_sequence_number"] == "10"


def test_generalizers(spark):
    import numpy as np

    a = np.zeros((20, 20), bool)
    a[5:15, 5:15] = True
    a[8:12, 8:12] = False
    areas = sorted(generalize.ring_area(r) for r in generalize.trace(a))
    assert sorted(abs(x) for x in areas) == [16, 100] and areas[0] < 0 < areas[1] and len(areas) == 2
    assert generalize.open_close(a, 3).sum() != a.sum()
    with pytest.raises(ValueError):
        generalize.check_raster(1000, 10, 0.0)
    with pytest.raises(ValueError):
        generalize.run_gen("nothing")
    edges = spark.createDataFrame([(1, 1, 2, 5.0), (2, 2, 3, 1.0), (3, 3, 1, 2.0), (4, 3, 4, 1.0)], "id int, from_node int, to_node int, width double")
    assert {r.id: r.width for r in generalize.propagate_width(edges).collect()} == {1: 5.0, 2: 5.0, 3: 5.0, 4: 5.0}


def test_expire_table(spark):
    old = spark.createDataFrame([(1, 0, 0, 1, 1)], "zoom int, x int, y int, first int, last int")
    new = spark.createDataFrame([(1, 0, 0), (1, 1, 0)], "zoom int, x int, y int")
    got = {(r.x, r.first, r.last) for r in changes.upsert_expired(old, new, F.lit(9)).collect()}
    assert got == {(0, 1, 9), (1, 9, 9)}


def test_line_merge_in_spark(spark):
    from terrane.functions import shapes as S

    rows = spark.createDataFrame([(1, [[(0.0, 0.0), (1.0, 0.0)], [(1.0, 0.0), (2.0, 0.0)]])], "id int, lines array<array<struct<x:double,y:double>>>")
    assert len(rows.select(S.line_merge_udf("lines").alias("m")).first().m) == 1


def test_wrappers_take_rings_of_different_lengths(spark):
    from terrane.functions import shapes as S

    outer, inner = [(0.0, 0.0), (6.0, 0.0), (6.0, 3.0), (6.0, 6.0), (0.0, 6.0), (0.0, 0.0)], [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (1.0, 1.0)]
    kind = "array<array<struct<x:double,y:double>>>"
    rows = spark.createDataFrame([(1, [outer, inner], [outer[:3], outer[2:]]), (2, None, None)], f"id int, rings {kind}, ways {kind}")
    area, pole, valid, tiles, made = S.spherical_area_udf("rings"), S.pole_udf("rings", F.lit(1.0)), S.is_valid_udf("rings"), S.area_tiles_udf("rings", F.lit(8)), S.assemble_udf("ways")
    full, empty = rows.select("id", area.alias("area"), pole.alias("pole"), valid.alias("ok"), tiles.alias("tiles"), made.alias("made")).orderBy("id").collect()
    assert full.area == S.polygon_area_wgs84([outer, inner])
    assert (full.pole.x, full.pole.y, full.pole.distance) == (lambda p: (*p[0], p[1]))(S.pole([outer, inner]))
    assert full.ok is True
    assert [(t.x, t.y) for t in full.tiles] == sorted(S.fill_rows([outer, inner], 8))
    assert [[[(p.x, p.y) for p in r] for r in polygon] for polygon in full.made] == S.assemble([outer[:3], outer[2:]])
    assert tuple(empty[1:]) == (None,) * 5


def test_rivers_width_of_all_lines(spark):
    from terrane.plans import catalogue

    d = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity").collect()
    edges = [(r[0], r[1] % 400, r[1] % 400 + 1 + r[2] % 3, float(r[3])) for r in lines]
    into: dict = {}
    want = []
    for e in sorted(edges, key=lambda e: e[1]):  # segments lead to higher nodes
        width = max(e[3], into.get(e[1], 0.0))
        into[e[2]] = max(width, into.get(e[2], 0.0))
        want.append((e[0], e[1], e[2], width))
    got = catalogue.rivers_width(spark, d).collect()
    assert sorted((r.id, r.from_node, r.to_node, float(r.width)) for r in got) == sorted(want)
