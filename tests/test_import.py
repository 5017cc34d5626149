"""Imports, legacy tables, geometries, regions, expiry and rivers: the registered queries against their SQL, and what SQL doesn't show."""

import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from terrane.functions import geom as M
from terrane.functions import geometry as G
from terrane.functions import params as P
from terrane.functions import shapes as S
from terrane.functions import tags as A
from terrane.operators import expire, generalize, locator
from terrane.plans import importer, tables
from terrane.streaming import updates

AT = "/root/testdata/sf0.001"
NAMES = """legacy_polygons legacy_roads import_lines append_equals_import read_xml_nodes read_osc_nodes read_opl_ways geometry_accessors geometry_centroids geometry_parts route_tags legacy_repairs
z_order_layers json_nested locator_areas expire_hybrid line_merge_count raster_union_append ewkb_points rivers_width river_chains discrete_isolation dispatch_untagged post_import_state valid_geometries expire_queue""".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in os.listdir(AT):
        con.execute(f"create view {t.split('.')[0]} as select * from '{AT}/{t}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    mine, want = entry.queries()[name](spark, AT), db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(mine.columns)
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in mine.select(names).collect())


def test_configuration_errors(spark):
    geom = tables.Column_("geom", "point")
    with pytest.raises(ValueError, match="3857"):
        tables.Table("t", (tables.Column_("geom", "point", projection=4326),), expires=(tables.Expires("geom", "x", expire.ExpireOutput(10)),))
    with pytest.raises(ValueError, match="no ids"):
        tables.Table("t", (geom,), ids="none", expires=(tables.Expires("geom", "x", expire.ExpireOutput(10)),))
    with pytest.raises(ValueError, match="unknown callback"):
        importer.Config((), {"area": lambda o, r: []})
    t = tables.Table("t", (geom,), ids="node", id_columns=("id",), unique_id=True)
    with pytest.raises(ValueError, match="twice"):
        t.checked(spark.createDataFrame([(1, "a"), (1, "b")], "id long, v string"))
    gone = spark.createDataFrame([(1, False)], "id long, visible boolean")
    with pytest.raises(Exception, match="deleted objects"):
        importer.check_create(gone).collect()
    where = locator.Locator("x", spark)
    where.add_from_table(spark.range(1).select(F.lit("a").alias("name"), M.line(F.array(G.point(F.lit(0.0), F.lit(0.0)), G.point(F.lit(1.0), F.lit(0.0)))).alias("g")))
    with pytest.raises(Exception, match="LINESTRING"):
        where.regions.collect()
    with pytest.raises(ValueError, match="as key"):
        A.json_of(F.lit(1), spark.createDataFrame([], "m map<int,int>").schema["m"].dataType)


def test_params():
    p = P.Params(a=1, b=2.5, c=True, d=None, e="x")
    assert P.render("{a} {b} {c} [{d}] {e} {{z}}", p) == "1 2.5 true [] x {z}"
    assert p.get_double("a") == 1.0 and p.get_int("zz", 7) == 7 and p.get_bool("c") and p.get_identifier("none") == ""
    for wrong in (lambda: p.get_int("b"), lambda: p.get_bool("a"), lambda: p.get_string("zz"), lambda: P.render("{nope}", p), lambda: P.Params(a="b;c").get_identifier("a")):
        with pytest.raises(ValueError):
            wrong()


def test_store_of_deltas(spark, tmp_path):
    store = updates.Store(spark, str(tmp_path / "s"), compact_every=3)
    with pytest.raises(ValueError, match="no snapshot"):
        store.read()
    want = {i: 0 for i in range(10)}
    store.replace(spark.createDataFrame(list(want.items()), "id long, v long"))
    for batch in range(1, 8):
        rows = [(batch, batch, "modify"), (100 + batch, batch, "create"), (9 - batch, 0, "delete")]
        store.apply(spark.createDataFrame(rows, "id long, v long, op string"))
        want |= {batch: batch, 100 + batch: batch}
        want.pop(9 - batch, None)
        assert {r.id: r.v for r in store.read().collect()} == want
    kinds = [k for _, k in store.versions()]
    assert kinds.count("base") >= 2 and kinds.count("delta") >= 4
    os.makedirs(tmp_path / "s" / "delta=99")  # a write that never ended
    assert {r.id: r.v for r in store.read().collect()} == want
    store.vacuum(1)
    assert {r.id: r.v for r in store.read().collect()} == want and store.versions()[0][1] == "base"


def test_replication_loop(spark):
    state, seen = updates.Replication("u", 3, "t3"), []

    def fetch(n):
        return spark.createDataFrame([(1, n, "modify"), (n, 1, "create")], "id long, version long, op string"), f"t{n}"

    calls = []
    done = state.follow(lambda: 8, lambda n: 100, fetch, lambda rows: seen.append(sorted((r.id, r.version) for r in rows.collect())), max_bytes=200, after=lambda: calls.append(1))
    assert done == 5 and len(calls) == 3 and state.state["replication_sequence_number"] == "8" and state.state["replication_timestamp"] == "t8"
    assert seen == [[(1, 5), (4, 1), (5, 1)], [(1, 7), (6, 1), (7, 1)], [(1, 8), (8, 1)]]


def test_isolation_of_clusters(spark):
    """Points in one far cluster, at one place, and spread; more of them than are broadcast."""
    rng = np.random.default_rng(1)
    xy = np.concatenate((rng.normal(size=(900, 2)) * 1e-4, np.zeros((60, 2)), rng.random((500, 2)) * 1e6))
    rows = [(i, float(rng.integers(1, 500)), float(x), float(y)) for i, (x, y) in enumerate(xy)]
    got = {r.id: r.discr_iso for r in generalize.discrete_isolation(spark.createDataFrame(rows, "id long, importance double, x double, y double")).collect()}
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    at = np.array([r[2:] for r in order])
    for k in range(1, len(order)):
        d = ((at[:k] - at[k]) ** 2).sum(axis=1).min()
        assert math.isclose(got[order[k][0]], d, rel_tol=1e-12, abs_tol=1e-30), k
    assert math.isclose(got[order[0][0]], got[order[1][0]] + 1)


def test_inside_intervals():
    square = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)], [(1.0, 1.0), (1.0, 3.0), (3.0, 3.0), (3.0, 1.0), (1.0, 1.0)]]
    flat = lambda line: [x for v in S.inside_intervals(line, square) for x in v]
    assert flat([(-1.0, 2.0), (5.0, 2.0)]) == pytest.approx([1.0, 2.0, 4.0, 5.0])
    assert flat([(-1.0, 0.5), (2.0, 0.5), (5.0, 0.5)]) == pytest.approx([1.0, 5.0])
    assert flat([(-1.0, 0.0), (5.0, 0.0)]) == pytest.approx([1.0, 5.0])  # along an edge
    assert flat([(6.0, 6.0), (7.0, 7.0)]) == []


def test_fill_and_limits(spark):
    size = 40075016.68 / 16
    ring = lambda *ps: F.array(*[G.point(F.lit(x * size - 20037508.34), F.lit(20037508.34 - y * size)) for x, y in ps])
    ell = ring((1.5, 1.5), (6.5, 1.5), (6.5, 3.5), (3.5, 3.5), (3.5, 6.5), (1.5, 6.5), (1.5, 1.5))
    g = spark.range(1).select(F.lit(1).alias("id"), M.polygon(F.array(ell), 3857).alias("g"))
    edges = expire.edges_of(g)
    tiles = {(r.x, r.y) for r in expire.expire_edges(edges, 4).collect()}
    assert tiles == {(x, y) for x in range(1, 7) for y in range(1, 4)} | {(x, y) for x in range(1, 4) for y in range(1, 7)}
    border = {(r.x, r.y) for r in expire.expire_edges(edges, 4, expire.ExpireConfig("boundary_only")).collect()}
    assert tiles - border == {(2, 2), (2, 3), (2, 4), (2, 5), (3, 2), (4, 2), (5, 2)} - border and (2, 2) not in border
    assert expire.expire_edges(edges, 4, most=len(tiles)).count() == len(tiles) and expire.expire_edges(edges, 4, most=len(tiles) - 1).count() == 0
    assert expire.expire_edges(edges, 20, most=100).count() == 0  # told by its box alone
    assert expire.expire_changes(g, g, 4).count() == 0 and expire.expire_changes(g, g, 4, diff=False).count() == len(tiles)
    text = expire.feature_collection(spark.createDataFrame([(1, 0, 0), (1, 1, 0)], "zoom int, x int, y int")).first().value
    assert text.startswith('{"type":"FeatureCollection","crs":') and text.count('"Feature"') == 2
