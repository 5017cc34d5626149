"""What shows only on large tables or odd rows, on small ones: plans without large broadcasts, and rows that small copies of the tables don't hold."""

from __future__ import annotations

import random
import time
import tracemalloc

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from terrane.functions import shapes as S
from terrane.operators import expire, generalize, locator
from terrane.sources import formats

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tables(spark, tmp_path, **rows):
    """A folder of tables: those given as (columns, rows), the others as in SF."""
    for name in ("nation", "region", "customer", "supplier", "part", "orders", "lineitem", "events"):
        own = spark.read.parquet(f"{SF}/{name}.parquet")
        if name in rows:
            columns, values = rows[name]
            given = spark.createDataFrame(values, columns)
            rest = own.drop(*given.columns).limit(1)
            own = given.join(F.broadcast(rest)).select(*[F.col(f.name).cast(f.dataType) for f in own.schema])
        own.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def same_as_sql(spark, query, folder):
    con = duckdb.connect()
    for name in ("nation", "region", "customer", "supplier", "part", "orders", "lineitem", "events"):
        path = f"{folder}/{name}.parquet" if folder == SF else f"{folder}/{name}.parquet/*.parquet"
        con.execute(f"create view {name} as select * from '{path}'")
    got = entry.queries()[query](spark, folder)
    want = con.execute(entry.oracle_sql()[query]).fetchall()
    own = [tuple(r) for r in got.select(*[d[0] for d in con.description]).collect()]
    assert want and sorted(own, key=repr) == sorted(want, key=repr)


def test_large_sides_of_cells_are_shuffled(spark, monkeypatch):
    square = lambda at, n: F.array(F.array(*[F.struct((at + a * n).alias("x"), (at + b * n).alias("y")) for a, b in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0))]))
    objects = spark.range(8).select("id", F.lit(2).alias("dim"), square(F.col("id") % 2 * 49.0 + 1, 1).alias("rings"))
    regions = spark.range(3).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("name"), square(F.col("id") * 0.5, 5).alias("rings"))
    want = {(i, f"r{j}") for i in (0, 2, 4, 6) for j in range(3)}
    assert {tuple(r) for r in locator.located_shapes(objects, regions, 10).collect()} == want
    monkeypatch.setattr(locator, "FEW", 2, raising=False)
    made = locator.located_shapes(objects, regions, 10)
    assert "Broadcast" not in plan(made)
    assert {tuple(r) for r in made.collect()} == want


def test_box_pairs_are_those_that_meet_once(spark):
    rng = random.Random(3)
    boxes = lambda n: [(i, x, y, x + rng.choice([0.0, 1.0, 7.0, 300.0]), y + rng.choice([0.0, 0.5, 40.0])) for i, x, y in ((i, float(rng.randint(-200, 200)), float(rng.randint(-50, 50))) for i in range(n))]
    a, b = boxes(80), boxes(90)
    frame = lambda rows, s, key: spark.createDataFrame(rows, f"{key} long, {s}x0 double, {s}y0 double, {s}x1 double, {s}y1 double")
    pairs = generalize.box_pairs(frame(a, "a", "i"), frame(b, "b", "j")).select("i", "j")
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])
    assert sorted(map(tuple, pairs.collect())) == want


def test_pole_of_long_boxes_is_soon_found():
    begun = time.monotonic()
    for i in range(300):
        at, far = S.pole([[(i - 1.0, 0.0), (i + 11.0, 0.0), (i + 11.0, 4.0), (i - 1.0, 4.0), (i - 1.0, 0.0)]])
        assert at == (i + 5.0, 2.0) and far == 2.0
    assert time.monotonic() - begun < 10
    # no box: a slanted strip, twice as wide as the root of a half
    assert S.pole([[(0.0, 0.0), (10.0, 10.0), (9.0, 11.0), (-1.0, 1.0), (0.0, 0.0)]])[1] == pytest.approx(0.5**0.5, abs=0.012)


@pytest.mark.parametrize("query", ["geom_reverse", "geom_npoints", "geom_centroid_points", "geometry_n", "ewkb_lines", "expire_lines", "way_linestring", "line_merge_count", "legacy_lines", "import_lines", "import_rejects", "append_equals_import"])
def test_nodes_at_one_place_are_points_of_their_own(spark, tmp_path, query):
    # parts 0 and 144,000 lie at one place
    ways = {0: [0, 144_000], 1: [0, 144_000, 5], 2: [21, 21, 0, 144_000, 0], 3: [5, 5], 4: [5, 21, 144_000]}
    lines = [(k, n, part) for k, parts in ways.items() for n, part in enumerate(parts)]
    folder = tables(
        spark, tmp_path, part=("p_partkey long", [(k,) for k in (0, 5, 21, 144_000)]), lineitem=("l_orderkey long, l_linenumber int, l_partkey long", lines),
        orders=("o_orderkey long, o_custkey long, o_orderstatus string", [(k, k // 2, "O") for k in ways]), customer=("c_custkey long, c_name string", [(k, f"c{k}") for k in range(3)]),
    )
    same_as_sql(spark, query, folder)


@pytest.fixture(scope="module")
def mixed(tmp_path_factory):
    """Six copies of SF whose rows refer to parts and customers of any copy. Parts of two copies lie at one place (their keys differ by
    144,000), so some ways meet two nodes of one place in a row; copies whose ways keep to their own parts never do."""
    folder, con, some = tmp_path_factory.mktemp("mixed"), duckdb.connect(), lambda salt: f"(hash(t, k, {salt}) % 6)::bigint"
    shifted = {
        "customer": "c_custkey + k * 1000 as c_custkey", "supplier": "s_suppkey as s_suppkey", "part": "p_partkey + k * 144000 as p_partkey", "events": "event_id + k * 100000 as event_id",
        "orders": f"o_orderkey + k * 10000 as o_orderkey, (o_custkey + {some(1)} * 1000)::bigint as o_custkey",
        "lineitem": f"l_orderkey + k * 10000 as l_orderkey, (l_partkey + {some(2)} * 144000)::bigint as l_partkey",
    }
    for name in ("nation", "region", *shifted):
        rows = f"select t.* replace ({shifted[name]}) from '{SF}/{name}.parquet' t, range(6) r(k)" if name in shifted else f"select * from '{SF}/{name}.parquet'"
        (folder / f"{name}.parquet").mkdir()
        con.execute(f"copy ({rows}) to '{folder}/{name}.parquet/0.parquet' (format parquet)")
    return str(folder)


@pytest.mark.parametrize("query", ["expire_lines", "geom_centroid_points", "geom_npoints", "geom_reverse", "geometry_n", "import_lines", "import_rejects"])
def test_ways_over_nodes_of_all_copies(spark, mixed, query):
    same_as_sql(spark, query, mixed)


def test_created_nodes_are_beside_stored_ones(spark, tmp_path):
    same_as_sql(spark, "apply_changes_nodes", tables(spark, tmp_path, part=("p_partkey long", [(99,), (5,), (1_000_099,), (6,)])))


def test_nodes_that_move_over_the_date_line(spark, tmp_path):
    far = [k for k in range(200_000) if k * 7919 % 36000 >= 35_650 and (k + 1) % 50 == 0 and (k + 1) % 3 == 1]
    same_as_sql(spark, "append_expiry", tables(spark, tmp_path, part=("p_partkey long", [(k,) for k in far])))


def test_chains_broadcast_nothing(spark):
    edges = spark.range(40).select("id", F.col("id").cast("string").alias("from_node"), (F.col("id") + 1).cast("string").alias("to_node"), F.lit(1.0).alias("width"))
    made = generalize.chains(edges)
    assert "Broadcast" not in plan(made)
    assert [(r["chain"], len(r["nodes"])) for r in made.collect()] == [(0, 41)]


def test_lines_of_a_batch_are_not_held_as_objects():
    # 1,000 relations of 10 lines, end to end; 440,000 points
    rows = pa.array([[[{"x": float(10 * j + i), "y": float(k)} for i in range(44)] for j in range(10)] for k in range(1000)])
    tracemalloc.start()
    merged = S.line_merge_udf.func(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(merged) == 1000 and merged.null_count == 0
    assert peak < 30e6  # the numbers take 7 MB, objects would take 100


def test_nested_arrays_hold_nulls_and_empty_rows():
    square, tie = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)], [(0, 0), (1, 1), (1, 0), (0, 1), (0, 0)]
    line = lambda points: [{"x": float(x), "y": float(y)} for x, y in points]
    rows = pa.array([None, [line(square)], [], [line(tie)], [None, line(square)], [line(square), line([(5, 5), (6, 5), (5, 6), (5, 5)])]], pa.list_(pa.list_(pa.struct({"x": pa.float64(), "y": pa.float64()}))))
    for given in (rows, pa.concat_arrays([rows, rows])[3:][3:]):
        made = S.assemble_udf.func(given).to_pylist()
        assert [None if v is None else [len(rings) for rings in v] for v in made] == [None, [1], None, None, [1], [1, 1]]
        assert S.line_merge_udf.func(given).to_pylist()[:3] == [None, [line(square)], []]


@pytest.mark.parametrize("query", ["way_polygon", "legacy_polygons"])
def test_rings_are_assembled_once(spark, query):
    made = plan(entry.queries()[query](spark, SF)).splitlines()
    assert sum("EvalPython" in x and "assemble" in x for x in made) == 1


@pytest.mark.parametrize("odd", ["", "<!-- <node id='9'/> -->", "<node id='7' user='a>b'/>", "<node id='7'><tag k='a' v='b'/></node >", "<!-- plain -->"])
def test_xml_files_are_read_in_splits(spark, tmp_path, monkeypatch, odd):
    nodes = [f'<node id="{i}" lat="1.5" lon="-2"' + ('/>' if i % 2 else f'>\n <tag k="é" v="/&gt;{"x" * (i % 40)}"/></node>\n') for i in range(100, 400)]
    (tmp_path / "a.osm").write_text("<?xml version='1.0'?><osm>" + "".join(nodes) + odd + '<way id="1"><nd ref="100"/></way></osm>')
    monkeypatch.setattr(formats, "XML_SPLIT", 700, raising=False)
    made = formats.read(spark, str(tmp_path / "a.osm"))
    rows = made.nodes.select("id", "lon_e7", "lat_e7", F.size("tags").alias("n")).collect()
    assert sorted(r.id for r in rows) == ([7] if "'7'" in odd else []) + list(range(100, 400))
    assert {(r.lon_e7, r.lat_e7, r.n) for r in rows if r.id >= 100} == {(-20000000, 15000000, 0), (-20000000, 15000000, 1)}
    assert [tuple(r) for r in made.ways.select("id", "nodes").collect()] == [(1, [100])] and made.rels.count() == 0
    assert (made.nodes.rdd.getNumPartitions() > 10) == (odd in ("", "<!-- plain -->"))


def test_symmetric_difference_reads_each_side_once(spark):
    old, new = ([(1, [1]), (1, [1]), (2, [2]), (None, None), (5, None)], [(1, [1]), (2, [2]), (2, [2]), (2, [2]), (None, None), (None, None)])
    frame = lambda rows: spark.createDataFrame(rows, "id int, line array<int>")
    made = expire.symmetric_difference(frame(old), frame(new), ["id", "line"])
    assert sum("Scan ExistingRDD" in x for x in plan(made).splitlines()) == 2
    assert sorted(map(tuple, made.collect()), key=repr) == sorted([(1, [1]), (2, [2]), (2, [2]), (None, None), (5, None)], key=repr)


@pytest.mark.parametrize("query", ["expire_lines", "geom_centroid_points", "geom_npoints", "geom_reverse", "geometry_n", "import_lines", "import_rejects", "append_equals_import", "rel_multiline", "rel_bbox", "split_multi", "geom_area_bbox_ring"])
def test_missing_nodes_are_points_of_the_queries(spark, tmp_path, query):
    # no parts 9, 10 and 11, no order 7, no customer 3
    ways = {0: [0, 9, 5], 1: [9, 0], 2: [0, 9, 0], 3: [9, 10, 11], 4: [5, 9, 9, 21], 5: [9, 9], 6: [5, 21], 7: [0, 5, 21], 8: [21, 9, 10, 0, 5]}
    lines = [(k, n, part) for k, parts in ways.items() for n, part in enumerate(parts)]
    folder = tables(
        spark, tmp_path, part=("p_partkey long", [(k,) for k in (0, 5, 21)]), lineitem=("l_orderkey long, l_linenumber int, l_partkey long", lines),
        orders=("o_orderkey long, o_custkey long, o_orderstatus string", [(k, k // 2 if k < 8 else 3, "O") for k in ways if k != 7]), customer=("c_custkey long, c_name string", [(k, f"c{k}") for k in range(3)]),
    )
    same_as_sql(spark, query, folder)
