"""Readers, codecs and stores."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from cityloom.functions import geometry as g
from cityloom.operators import constraints
from cityloom.sources import codec, export, overpass, regions, stores


def snapshot(tmp_path):
    ring = [{"lat": 0, "lon": 0}, {"lat": 0, "lon": 2}, {"lat": 2, "lon": 2}, {"lat": 0, "lon": 0}]
    data = {"elements": [
        {"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"amenity": "hospital", "name": "H"}},
        {"type": "node", "id": 1, "lat": 9.0, "lon": 9.0, "tags": {"amenity": "school"}},
        {"type": "node", "id": 2, "lat": 1.0, "lon": 4.0}, {"type": "node", "id": 3, "lat": 5.0, "lon": 4.0},
        {"type": "way", "id": 1, "geometry": ring, "tags": {"building": "yes"}},
        {"type": "way", "id": 5, "nodes": [2, 1, 3], "tags": {"highway": "primary"}},
        {"type": "way", "id": 6, "center": {"lat": 3.0, "lon": 3.5}, "tags": {"shop": "chemist"}}]}
    (tmp_path / "a.json").write_text(json.dumps(data))
    (tmp_path / "b.json").write_text(json.dumps({"elements": []}))
    return str(tmp_path)


def test_snapshot_layers(spark, tmp_path):
    e = overpass.read_elements(spark, snapshot(tmp_path))
    fac = {r.osm_id: (r.category, r.x, r.y) for r in overpass.extract_layer(e, "facilities").collect()}
    assert fac[6] == ("pharmacy", 3.5, 3.0)
    assert fac[1] == ("hospital", 2.0, 1.0)  # the first arrival counts
    b = overpass.extract_layer(e, "buildings").collect()
    assert [(r.osm_id, r.kind) for r in b] == [(1, "yes")]
    ways = overpass.with_node_geometry(e.where("NOT (type = 'node' AND lat = 9)"))
    line = overpass.extract_layer(ways, "roads").where("kind = 'primary'").head()
    assert [tuple(v) for v in line.rings[0]] == [(4., 1.), (2., 1.), (4., 5.)]


def test_repair_touches_polygons_only(spark):
    line, open_ring = [[(0., 0.), (1., 1.)]], [[(0., 0.), (0., 2.), (2., 2.), (2., 0.)]]
    bow = [[(0., 0.), (0., 2.), (2., 0.), (2., 2.)]]
    df = spark.createDataFrame([(1, line, False), (2, open_ring, True), (3, bow, True)],
                               f"id int, rings {g.RINGS}, poly boolean")
    out = {r.id: r for r in overpass.repair_polygons(df, is_polygon=F.col("poly")).withColumn(
        "a", g.area("rings")).collect()}
    assert len(out[1].rings[0]) == 2 and out[2].a == 4.0 and out[2].valid and not out[3].valid


def test_single_parts_keep_holes(spark):
    outer = [(0., 0.), (9., 0.), (9., 9.), (0., 9.), (0., 0.)]
    hole = [(1., 1.), (1., 2.), (2., 2.), (2., 1.), (1., 1.)]
    other = [(20., 0.), (21., 0.), (21., 1.), (20., 1.), (20., 0.)]
    df = spark.createDataFrame([([outer, hole, other],)], f"rings {g.RINGS}")
    got = overpass.single_parts(df).select(g.area("rings").alias("a")).collect()
    assert sorted(r.a for r in got) == [1.0, 80.0]


def test_codec(spark):
    wkb = struct.pack("<BIdd", 1, 1, 3.0, 4.0)
    ewkb = struct.pack("<BIIdd", 1, 1 | 0x20000000, 4326, 3.0, 4.0)
    rows = [("SRID=4326;POINT(3 4)",), ("POLYGON((0 0,1 0,1 1,0 0),(0.1 0.1,0.2 0.1,0.2 0.2,0.1 0.1))",),
            (wkb.hex(),), (ewkb.hex(),), ("junk",), (None,), ("MULTILINESTRING((0 0,1 1),(2 2,3 3))",)]
    df = spark.createDataFrame(rows, "g string")
    got = codec.decoded(df, "g").collect()
    assert [(r.kind, r.srid, len(r.rings)) for r in got] == [
        ("Point", 4326, 1), ("Polygon", None, 2), ("Point", None, 1), ("Point", 4326, 1),
        ("MultiLineString", None, 2)]
    raw = spark.createDataFrame([(bytearray(wkb),)], "g binary")
    assert codec.decoded(raw, "g").head().rings[0][0].x == 3.0


def test_result_store(spark, tmp_path):
    rows = [(i, 7, "site_suitability" if i % 2 else "risk", f"2024-01-0{i} 00:00:00",
             json.dumps({"provenance": {"parameter_hash": f"h{i % 2}"}})) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "result_id long, scenario_id long, analysis_type string,"
                                     " created_at string, result_json string").withColumn(
        "created_at", F.col("created_at").cast("timestamp"))
    store = stores.ResultStore(spark, str(tmp_path / "r"))
    store.save(df)
    assert [r.result_id for r in store.list_for_scenario(7, "risk").collect()] == [4, 2]
    assert store.find_by_hash("h1").head().result_id == 5
    assert store.get(3).head().analysis_type == "SITE_SUITABILITY"


def test_scenario_store_and_hash(spark, tmp_path):
    store = stores.ScenarioStore(spark, str(tmp_path / "s"))
    schema = "scenario_id long, version int, name string, status string"
    store.put_headers(spark.createDataFrame([(1, 1, "A", "draft")], schema))
    store.put_headers(spark.createDataFrame([(1, 2, None, "review")], schema))
    assert tuple(store.headers().head()) == (1, 2, "A", "review")
    df = spark.createDataFrame([({"b": "1", "a": "2"},), ({"a": "2", "b": "1"},), ({"a": "3"},)],
                               "p map<string,string>")
    h = stores.provenance(F.lit(1), F.lit("x"), F.lit("0.1"), F.lit(2), F.col("p"), F.lit(32643))
    digests = [r.h for r in df.select(h["parameter_hash"].alias("h")).collect()]
    assert digests[0] == digests[1] != digests[2] and len(digests[0]) == 64


def test_partition_reload_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "layers")
    df = spark.createDataFrame([(1, "a", "roads"), (2, "b", "roads")], "id int, region string, layer string")
    stores.write_layer(df, path)
    stores.write_layer(df.where("region = 'a'"), path, "overwrite")
    back = spark.read.parquet(path)
    assert back.count() == 2 and regions.loaded(back, "b") and not regions.loaded(back, "c")


def test_unknown_layer_is_refused(spark):
    with pytest.raises(KeyError):
        export.features_geojson(spark.range(1), "secrets", "Point")


def test_multi_part_shapes_stay_apart(spark):
    two = "MULTIPOLYGON(((0 0,10 0,10 10,0 10,0 0)),((20 0,30 0,30 10,20 10,20 0),(21 1,22 1,22 2,21 2,21 1)))"
    turned = "POLYGON((0 0,0 10,10 10,10 0,0 0))"
    df = codec.decoded(spark.createDataFrame([(1, two), (2, turned)], "id int, g string"), "g")
    before = {r.id: r.a for r in df.select("id", g.area("rings").alias("a")).collect()}
    assert before == {1: 199.0, 2: 100.0}
    fixed = overpass.repair_polygons(df)
    got = {r.id: r for r in fixed.select("id", g.area("rings").alias("a"), "valid", F.to_json(
        export.geometry("MultiPolygon")).alias("j")).collect()}
    assert got[1].a == 199.0 and got[1].valid and got[2].a == 100.0
    shape = json.loads(got[1].j)
    assert [len(p) for p in shape["coordinates"]] == [1, 2]
    assert sorted(r.a for r in overpass.single_parts(fixed).select(g.area("rings").alias("a")).collect()) == [99., 100., 100.]


def test_buffered_ring_constraint_covers_like_a_box(spark):
    def ring(x0, y0, x1, y1):
        return [[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]
    box = "minx double, miny double, maxx double, maxy double"
    p = spark.createDataFrame([(1, 100., ring(12., 0., 22., 10.), 12., 0., 22., 10.)], f"id int, area double, rings {g.RINGS}, {box}")
    c = spark.createDataFrame([(7, "x", "soft", .5, 5., ring(0., 0., 10., 10.), 0., 0., 10., 10.)],
                              f"c_id int, c_type string, c_severity string, c_weight double, c_buffer double, c_rings {g.RINGS}, "
                              + ", ".join("c_" + b for b in box.split(", ")))
    both = [constraints.constraint_hits(p, c, key=["id"], rings=r).head().overlap for r in (False, True)]
    assert abs(both[0] - 0.30) < 0.01 and abs(both[0] - both[1]) < 1e-6


def test_first_arrivals_are_narrow(spark):
    """Nothing is sorted before the exchange, and what no later step reads is not exchanged."""
    rows = [(1, "way", 1, {"highway": "trunk", "lanes": "3"}, "b"), (1, "way", 0, {"lanes": "4"}, None), (2, "node", 0, {}, "c")]
    e = spark.createDataFrame(rows, "id long, type string, pos int, tags map<string,string>, note string")
    first = {r.id: (r.lanes, r.road_class, r.note) for r in overpass.ingest_roads(e).collect()}
    assert first == {1: (4, "residential", None), 2: (2, "residential", "c")}
    plan = overpass.ingest_roads(e).select("id", "lanes")._jdf.queryExecution().executedPlan().toString()
    assert "Sort" in plan[:plan.index("Exchange")] and "Sort" not in plan[plan.index("Exchange"):]
    assert "note" not in plan[:plan.index("Exchange")] and "tags" not in plan[:plan.index("Exchange")]
