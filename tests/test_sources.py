"""Sources, sinks and streaming forms on hand-made files."""

import json
import sqlite3

from pyspark.sql import functions as F

from aerotrace.operators import extract, network, windows
from aerotrace.sources import osm, records
from aerotrace.sources.sqlite import TrackSource
from aerotrace.streaming import online


def record(n, flio="A", x0=0.0):
    data = [{"time": f"t{i}", "properties": {"x": x0 + i, "z": 2.0 * i, "originLon": "108.5" if i % 2 else 108.5, "originLat": "34.1", "angle_self": 10.0}} for i in range(n)]
    return {"cfno": "c", "flio": flio, "pointcount": n, "data": data}


def test_records_scan_unwraps_arrays_and_isolates_failures(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(record(3)))
    (tmp_path / "b.json").write_text(json.dumps([record(2, "D"), record(9)]))
    (tmp_path / "c.json").write_text("{broken")
    (tmp_path / "manifest.json").write_text(json.dumps({"files": []}))
    (tmp_path / "x.truth.json").write_text(json.dumps(record(1)))
    rows = records.read_records(spark, str(tmp_path))
    assert sorted((r.file.rsplit("/")[-1], len(r.data)) for r in rows.collect()) == [("a.json", 3), ("b.json", 2)]
    assert sum(r._corrupt_record is not None for r in records.read_records(spark, str(tmp_path), bad=True).collect()) == 1
    assert records.read_records(spark, str(tmp_path), limit=1).count() == 1
    flat = records.samples(rows)
    assert flat.count() == 5 and flat.where("origin_lon = 108.5").count() == 5


def test_records_sink_round_trip_and_skip(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for k in range(3):
        (src / f"r{k}.json").write_text(json.dumps(record(4 + k)))
    flat = records.samples(records.read_records(spark, str(src))).withColumn("traj_id", F.regexp_extract("traj_id", "([^/]+)\\.json$", 1))
    docs = records.as_records(flat, ["flio"], ["x", "z"])
    records.write_records(docs.where("traj_id <> 'r2'"), out)
    records.write_records(docs, out)  # only r2 is new
    back = spark.read.json(out)
    assert back.count() == 3 and sorted(r.pointcount for r in back.collect()) == [4, 5, 6]
    assert [p.properties.x for p in back.where("traj_id = 'r1'").first().data] == [0.0, 1.0, 2.0, 3.0, 4.0]


def test_bundle_and_manifest(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(record(3)))
    slim = records.slim(records.read_records(spark, str(tmp_path)), ["cfno", "flio"], ["x", "z"])
    b = records.bundle(slim)
    row = b.first()
    import hashlib

    assert row.bytes == len(row.json.encode()) and row.sha1 == hashlib.sha1(row.json.encode()).hexdigest()[:12]
    m = json.loads(records.manifest(b, "XX", "src").first().value)
    assert m["n_files"] == 1 and m["n_points"] == 3


OSM = """<?xml version="1.0"?><osm>
<node id="1" lat="34.0" lon="108.0"/><node id="2" lat="34.001" lon="108.0"/><node id="3" lat="34.001" lon="108.001"/><node id="4" lat="34.002" lon="108.0"><tag k="aeroway" v="gate"/></node><node id="5" lat="35" lon="109"/>
<way id="10"><nd ref="1"/><nd ref="2"/><nd ref="4"/><tag k="aeroway" v="taxiway"/></way>
<way id="11"><nd ref="2"/><nd ref="3"/><nd ref="99"/><tag k="aeroway" v="taxiway"/></way>
<way id="12"><nd ref="5"/><nd ref="1"/><tag k="highway" v="service"/></way>
<relation id="20"><member type="way" ref="12"/><tag k="aeroway" v="aerodrome"/></relation></osm>"""


def test_osm_clean_split_and_names(spark, tmp_path):
    path = tmp_path / "m.osm"
    path.write_text(OSM)
    t = osm.read_osm(spark, str(path))
    kept = network.keep_closure(osm.aeroway(t["ways"]), t["way_nodes"], t["members"], osm.aeroway(t["relations"]), osm.aeroway(t["nodes"]))
    got = {(r.kind, r.id) for r in kept.collect()}
    assert got == {("relation", 20), ("way", 10), ("way", 11), ("way", 12)} | {("node", i) for i in (1, 2, 3, 4, 5, 99)}
    assert [(r.way, r.node) for r in network.dangling(t["way_nodes"], t["nodes"]).collect()] == [(11, 99)]
    lines = osm.polylines(t)
    assert {r.node for r in lines.collect()} == {1, 2, 3, 4}
    pieces = network.split_at_junctions(lines.select("way", "pos", "node"))
    assert {(r.way, r.piece): 0 for r in pieces.collect()}.keys() == {(10, 0), (10, 1), (11, 0)}
    flat = osm.projected(lines, t["nodes"])
    assert flat.where("abs(x) < 1e6 and z is not null").count() == 5
    osm.write_osm({**t, "ways": t["ways"]}, str(tmp_path / "out"))
    again = osm.read_osm(spark, str(tmp_path / "out" / "way"))
    assert again["way_nodes"].count() == 8


def test_network_document_round_trip(spark, tmp_path):
    seg = spark.createDataFrame([("N-0", 0, 0, 0.0, 0.0, 10.0, 0.0), ("N-0", 0, 1, 10.0, 0.0, 20.0, 0.0), ("N-1", 1, 0, 20.0, 0.0, 20.0, 9.0)], "pathname string, path_no int, seg_idx int, ax double, az double, bx double, bz double")
    edges = network.strict_edges(network.snapped_nodes(network.path_ends(seg)))
    moves = network.transitions(seg.select("pathname").distinct(), edges)
    a = network.anchors(seg)
    doc = records.network_document(seg, moves, a, edges)
    doc.coalesce(1).write.text(str(tmp_path / "net"))
    back = records.read_network(spark, str(tmp_path / "net"))
    assert back["segments"].select("pathname", "seg_idx", "bx").exceptAll(seg.select("pathname", "seg_idx", "bx")).isEmpty()
    assert back["segments"].count() == 3 and back["anchors"].count() == a.count() and back["transitions"].count() == moves.count()
    assert network.compare(moves, back["transitions"], ["src", "dst"]).isEmpty()


def test_whole_network_document(spark, tmp_path):
    seg = spark.createDataFrame([("N-0", 0, 0, 0.0, 0.0, 10.0, 0.0), ("N-0", 0, 1, 10.0, 0.0, 20.0, 0.0), ("N-1", 1, 0, 20.0, 0.0, 20.0, 9.0)], "pathname string, path_no int, seg_idx int, ax double, az double, bx double, bz double")
    ends, paths, a = network.path_ends(seg), seg.select("pathname").distinct(), network.anchors(seg)
    strict = network.strict_edges(network.snapped_nodes(ends))
    space = network.space_edges(network.segment_ends(seg), strict, network.path_direction(seg))
    total, nodes = network.total_edges(strict, space), network.greedy_nodes(ends, ["pathname", "side"])
    meta = network.meta(paths, nodes, seg, a, strict, space, total, network.components(paths, total))
    doc = records.network_document(seg, network.transitions(paths, total), a, total, strict, space, nodes, meta)
    value = json.loads(doc.first()[0])
    assert {"meta", "paths", "path_dict", "nodes", "adjacency", "adjacency_strict", "transition_matrix", "segments", "internal_points"} <= set(value)
    assert value["segments"]["N-1"] == [{"idx": 0, "a": [20.0, 0.0], "b": [20.0, 9.0], "len": 9.0, "dir": 90.0}] and value["meta"]["n_nodes"] == 3
    doc.coalesce(1).write.text(str(tmp_path / "net"))
    back = records.whole_network(spark, str(tmp_path / "net"))
    assert {(r.pathname, r.start, r.end) for r in back["path_dict"].collect()} == {("N-0", 0, 1), ("N-1", 1, 2)}
    assert {(r.node, r.x, r.z, tuple(r.paths)) for r in back["nodes"].collect()} == {(0, 0.0, 0.0, ("N-0",)), (1, 20.0, 0.0, ("N-0", "N-1")), (2, 20.0, 9.0, ("N-1",))}
    assert back["adjacency_strict"].count() == strict.count() == 2 and back["meta"].first().n_segments == 3
    # a document of paths only
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "net.json").write_text(json.dumps({"paths": value["paths"]}))
    old = records.whole_network(spark, str(tmp_path / "old"))
    assert {(r.src, r.dst) for r in old["adjacency"].collect()} == {("N-0", "N-1"), ("N-1", "N-0")} and old["transitions"].count() == 4 and old["anchors"].count() == a.count()


def test_compare_takes_keys_of_any_type(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([("1", "x"), ("3", "y")], "k string, v string")
    assert {(r.k, r.status) for r in network.compare(a, b, ["k"]).collect()} == {("2", "missing"), ("3", "extra")}


def test_sqlite_source_prunes_days_and_rows(spark, tmp_path):
    for day in ("20240501", "20240502", "20240503"):
        (tmp_path / day).mkdir()
        with sqlite3.connect(tmp_path / day / f"{day}000000.db") as db:
            db.execute("create table track (flight_id, craft, flight_no, send_data_at, flight_transform_x, flight_transform_z, flight_rotation, speed, flight_type, craft_site, position_x)")
            rows = [("f1", "c", "n", 100 + i, str(10.0 * i), 5.0 * i, "bad" if i == 1 else "3", "2.5", "t", "s", 0) for i in range(3)] + [(None, "c", "n", 1, "1", "1", "1", "1", "t", "s", 0), ("f2", "c", "n", 7, "oops", "4", "1", "1", "t", "s", 0)]
            db.executemany("insert into track values (?,?,?,?,?,?,?,?,?,?,?)", rows)
    spark.dataSource.register(TrackSource)
    rows = spark.read.format("aerotrace_sqlite").option("days", "20240501:20240502").load(str(tmp_path))
    assert rows.count() == 8 and rows.select("day").distinct().count() == 2
    good = extract.tolerant(rows)
    assert good.count() == 6 and good.where("flight_rotation is null").count() == 2
    boxed = spark.read.format("aerotrace_sqlite").option("box", "5,15,0,10").load(str(tmp_path)).select("flight_id", "send_data_at")
    assert {(r.flight_id, r.send_data_at) for r in boxed.collect()} == {("f1", 101)}
    totals = extract.daily_totals(good.withColumn("traj_id", F.col("flight_id")))
    assert {(r.day, r.points) for r in totals.collect()} == {("20240501", 3), ("20240502", 3), (None, 6)}


def test_extraction_chain_classifies_and_resamples(spark):
    n = 80
    rows = [(1, 1000 + i, 10.0 * i if i < 60 else 590.0, 0.0, "p") for i in range(n)] + [(2, 1000 + i, 5000.0, 5000.0, "p") for i in range(n)]
    raw = spark.createDataFrame(rows, "traj_id long, t long, x double, z double, event_type string")
    features = spark.createDataFrame([("runway", 0.0, -5.0, 200.0, -5.0), ("stand", 590.0, 5.0, 600.0, 5.0), ("apron", 580.0, 0.0, 620.0, 0.0)], "kind string, ax double, az double, bx double, bz double")
    rings = spark.createDataFrame([], "ring int, ax double, az double, bx double, bz double")
    out, kinds = extract.trajectories(raw, features, rings)
    assert [(r.traj_id, r.movement) for r in kinds.collect()] == [(1, "A")]
    got = out.orderBy("sec").collect()
    assert {r.traj_id for r in got} == {1} and got[0].sec == 1000 and got[1].x == 10.0
    runways = spark.createDataFrame([("05L", 0.0, -5.0, 200.0, -5.0)], "name string, ax double, az double, bx double, bz double")
    names = extract.runway_of(raw.withColumn("seq", F.col("t")), runways)
    assert {(r.traj_id, r.name) for r in names.collect()} == {(1, "05L"), (2, "")}


def test_stream_filter_equals_batch(spark, tmp_path):
    from aerotrace.operators import estimator

    rows = spark.createDataFrame([(k, i, 3.0 * i + k, float(i % 3), 5.0, None) for k in (1, 2) for i in range(12)], "traj_id long, seq long, x double, z double, angle_self double, angle_graph double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = online.filtered(stream.select("traj_id", "seq", "x", "z")).writeStream.format("memory").queryName("filtered").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = {(r.traj_id, r.seq): (r.kf_x, r.kf_vz) for r in estimator.motion(rows).collect()}
    live = {(r.traj_id, r.seq): (r.kf_x, r.kf_vz) for r in spark.table("filtered").collect()}
    assert live.keys() == batch.keys() and all(abs(a - b) < 1e-9 for k in live for a, b in zip(live[k], batch[k], strict=True))


def test_names_and_first_per_second(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "base string, first int")
    assert {r.name for r in windows.numbered_names(rows, "base", "first").collect()} == {"a", "a_2", "b"}
