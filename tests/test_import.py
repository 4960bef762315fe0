"""Import of whole feeds, tables and graphs that are published together, circles on the grid and parts of journeys."""

import json
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from wayloom.functions import scalars as S
from wayloom.operators import corridor, graph, lineage, raptor
from wayloom.plans import engine, load
from wayloom.sources import feeds, places

FILES = {
    "agency.txt": ["agency_id", "a"],
    "stops.txt": ["stop_id,stop_name,stop_lat,stop_lon,location_type", "A,Alpha,-37.0,144.0,", "B,Beta,-37.05,144.0,0", "C,Gamma,-37.1,144.0,", "P,Parent,-37.1,144.0,1", "A,Again,-30.0,140.0,"],
    "routes.txt": ["route_id,route_short_name,route_long_name,route_type,route_color,route_text_color", "r1,R1,Line 1,3,ff0000,"],
    "calendar.txt": ["service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date", "s,1,1,1,1,1,1,1,19950101,20011231"],
    "calendar_dates.txt": ["service_id,date,exception_type", "s,19990101,2"],
    "trips.txt": ["route_id,service_id,trip_id,direction_id,shape_id", "r1,s,t1,0,sh", "r1,s,t2,0,sh"],
    "stop_times.txt": ["trip_id,arrival_time,departure_time,stop_id,stop_sequence", *(f"t{t},{h:02}:{m:02}:00,,{s},{i}" for t, h in ((1, 8), (2, 9)) for i, (s, m) in enumerate((("A", 10), ("B", 20), ("C", 30)), 1)), "t9,08:00:00,,A,1"],
    "shapes.txt": ["shape_id,shape_pt_lat,shape_pt_lon,shape_pt_sequence", *(f"sh,{-37 - i / 60},144.0,{i}" for i in range(7))],
}


def feed(folder, **changed):
    folder.mkdir(parents=True)
    for name, rows in (FILES | {f"{k}.txt": v for k, v in changed.items()}).items():
        (folder / name).write_text("\n".join(rows) + "\n")
    return str(folder)


def test_import_and_search(spark, tmp_path):
    target = str(tmp_path / "tables")
    assert not load.is_ready(spark, target)
    with pytest.raises(FileNotFoundError):
        load.tables_of(spark, target)
    with pytest.raises(FileNotFoundError):
        load.import_feeds(spark, str(tmp_path / "none"), target)
    sizes = load.import_feeds(spark, feed(tmp_path / "feed"), target)
    assert sizes == {"stops": 3, "routes": 1, "calendar": 1, "calendar_dates": 1, "trips": 2, "patterns": 1, "pattern_stops": 3, "stop_times": 6, "shape_meta": 1, "shapes": 3}
    double = feed(tmp_path / "double", stop_times=[*FILES["stop_times.txt"], "t1,08:40:00,,B,3"])
    with pytest.raises(ValueError, match="duplicate key"):
        load.import_feeds(spark, double, target)
    assert load.tables_of(spark, target)["stop_times"].count() == 6  # as before
    e = engine.Engine.from_tables(spark, target)
    q = spark.createDataFrame([(1, -37.0, 144.0, -37.1, 144.0, 8 * 3600), (2, None, 144.0, -37.1, 144.0, 0), (3, -37.0, 144.0, None, None, 0)], "query_id long, o_lat double, o_lon double, d_lat double, d_lon double, depart_sec long")
    rows = {(r["query_id"], r["status"], r["arrival_sec"], r["legs"]) for r in e.route(q).collect()}
    assert (1, "OK", 8 * 3600 + 1800, 1) in rows
    assert {(x, s) for x, s, *_ in rows if x > 1} == {(2, "NO_STOPS_NEAR_ORIGIN"), (3, "NO_STOPS_NEAR_DESTINATION")}
    first = lineage.published(spark, f"{target}/graph")
    assert engine.Engine.from_tables(spark, target).graph().count() == e.graph().count()
    assert lineage.published(spark, f"{target}/graph") == first  # read, not built again


def test_first_incoming_zip(tmp_path):
    assert load.incoming(str(tmp_path)) is None
    for name in ("b.zip", "a.zip", "0.txt"):
        (tmp_path / "incoming" / name).write_text("")
    assert load.incoming(str(tmp_path)).endswith("a.zip")


def test_a_graph_that_was_not_finished_leaves_the_old(spark, tmp_path):
    e = spark.createDataFrame([(1, 2, "walk", 0.5, None)], "src long, dst long, kind string, cost double, via_pattern long")
    graph.persist(e, "a", str(tmp_path / "g"))
    with pytest.raises(Exception, match="broken"):
        graph.persist(e.where(F.raise_error(F.lit("broken")).isNull()), "b", str(tmp_path / "g"))
    assert graph.load(spark, "a", str(tmp_path / "g")).count() == 1
    assert graph.load(spark, "b", str(tmp_path / "g")) is None
    graph.persist(e.limit(0), "b", str(tmp_path / "g"))
    assert graph.load(spark, "b", str(tmp_path / "g")) is None
    assert graph.load(spark, "a", str(tmp_path / "g")) is None


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000.0 * math.asin(math.sqrt(min(h, 1.0)))


PLACES = [(1, -37.0, 144.0), (2, 0.0, 179.999), (3, 0.0, -179.999), (4, 89.99, 10.0), (5, -60.0, -170.0), (6, None, 3.0)]


def test_circles_on_the_grid_against_brute_force(spark):
    spots = [(-37 + i * 0.004, 144 + (i * 7 % 11) * 0.006) for i in range(12)] + [(0.01 * i, 179.99 - i * 0.5) for i in range(6)] + [(0.005, -179.985), (89.98, -170.0), (89.0, 60.0), (-59.0, 175.0), (-60.0, -150.0)]
    stops = spark.createDataFrame([(i + 1, round(a * 1e6), round(b * 1e6)) for i, (a, b) in enumerate(spots)], "stop_pk long, stop_lat long, stop_lon long")
    at = spark.createDataFrame(PLACES, "query_id long, at_lat double, at_lon double")
    for most in (3, 40):
        want = {(q, i) for q, *p in PLACES[:-1] for _, i in sorted((metres(p, s), i + 1) for i, s in enumerate(spots))[:most]}
        got = [(r["query_id"], r["stop_pk"]) for r in corridor.ranked(at, stops, most).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    for radius in (900.0, 60_000.0, 3_000_000.0):
        want = sorted((q, i + 1) for q, *p in PLACES[:-1] for i, s in enumerate(spots) if metres(p, s) <= radius)
        assert sorted((r["query_id"], r["stop_pk"]) for r in corridor.around(at, stops, radius).collect()) == want
    assert corridor.ranked(at, stops.limit(0), 3).count() == 0
    assert corridor.ranked(at.limit(0), stops, 3).count() == 0


def test_lines_choice_and_comparison(spark):
    point = "struct<latitude:double,longitude:double>"
    legs = spark.createDataFrame([(1, 1, 2, [(2.0, 2.0), (3.0, 3.0)]), (1, 1, 1, [(1.0, 1.0), (2.0, 2.0)]), (1, 1, 3, [(3.0, 3.1), (4.0, 4.0)]), (1, 2, 1, [(5.0, 5.0)]), (1, 2, 2, [(5.0, 5.0)]), (1, 3, 1, None)], f"query_id long, journey_no long, leg_no long, coords array<{point}>")
    lines = {r["journey_no"]: [tuple(p) for p in r["coords"]] for r in raptor.journey_lines(legs).collect()}
    assert lines == {1: [(1, 1), (2, 2), (3, 3), (3, 3.1), (4, 4)], 2: [(5, 5)]}
    columns = "query_id long, journey_no int, arrival_sec long, legs long"
    a = spark.createDataFrame([(1, 1, 100, 2), (1, 2, 110, 1), (2, 1, 50, 1)], columns)
    b = spark.createDataFrame([(1, 1, 100, 1), (3, 1, 9, 1)], columns)
    rows = {r["query_id"]: tuple(r)[1:] for r in raptor.compared(a, b).collect()}
    assert rows == {1: (2, 1, True, False), 2: (1, 0, None, None), 3: (0, 1, None, None)}
    wanted = spark.createDataFrame([(1, 1), (2, 5), (2, -1)], "query_id long, place int")
    assert [tuple(r) for r in raptor.chosen(a, wanted).select("query_id", "journey_no").collect()] == [(1, 2)]


def test_places_and_labels(spark):
    answers = spark.createDataFrame([(1, json.dumps({"places": [{"id": "x", "displayName": {"text": "X"}, "formattedAddress": "1 St", "location": {"latitude": 1.5, "longitude": 2}}, {"id": "y"}]})), (2, "{}"), (3, "no"), (4, None)], "n long, answer string")
    assert sorted(tuple(r) for r in places.places(answers).collect()) == [(1, 0, "x", "X", "1 St", 1.5, 2.0), (1, 1, "y", "Unknown", "", 0.0, 0.0)]
    one = spark.range(1).select(S.duration_text(F.lit(59.96)).alias("a"), S.duration_text(F.lit(90)).alias("b"), S.size_text(F.lit(1572864)).alias("c"), S.strip_scheme(F.lit("file:///a")).alias("d"), S.text_color(F.lit("bad")).alias("e"), S.text_color(F.lit("00ff00")).alias("f"), S.transfer_label(F.lit("A"), F.lit("B"), F.lit(10.0), F.lit(1.4)).alias("g"), S.transfer_label(F.lit("A"), F.lit("A"), F.lit(0.0), F.lit(1.4)).alias("h")).first()
    assert tuple(one) == ("60.0s", "1.5m", "1.5 MB", "/a", "#FFFFFF", "#00FF00", "A → B (~1 min walk)", "A")


def test_a_file_in_many_splits_is_numbered_as_a_plain_read(spark, tmp_path):
    rng = random.Random(2)
    lines = ["﻿stop_id, name", ""] + [rng.choice([f's{i},"a, {i}"', f"s{i}, plain {i} \r", " ", f"s{i}", f's{i},"say ""x"" {i}",more']) for i in range(20_000)]
    for feed_ in ("one", "two"):
        (tmp_path / feed_).mkdir()
        (tmp_path / feed_ / "agency.txt").write_text("x")
        (tmp_path / feed_ / "stops.txt").write_bytes("\n".join(lines[: 20_002 if feed_ == "one" else 3000]).encode())
    found = feeds.discover(str(tmp_path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        rows = feeds.read(spark, found, "stops.txt", ["stop_id", "name", "gone"])
        assert rows.rdd.getNumPartitions() > 20
        got = sorted(tuple(r) for r in rows.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    wanted = []
    for agency, feed_ in enumerate(found, 1):
        with open(f"{feed_.path}/stops.txt", encoding="utf-8", newline="\n") as f:
            wanted += [(agency, i, r.get("stop_id"), r.get("name"), r.get("gone")) for i, r in enumerate(feeds.records(f))]
    assert got == sorted(wanted)
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("agency.txt", "x")
        z.writestr("stops.txt", "\n".join(lines))
    zipped = feeds.read(spark, feeds.discover(str(tmp_path / "z.zip")), "stops.txt", ["stop_id", "name"])
    assert sorted(tuple(r) for r in zipped.collect()) == [x[:4] for x in sorted(wanted) if x[0] == 1]


def test_broken_references_leave_the_old_tables(spark, tmp_path):
    target = str(tmp_path / "tables")
    load.import_feeds(spark, feed(tmp_path / "feed"), target)
    before = lineage.published(spark, target)
    broken = feed(tmp_path / "broken", routes=FILES["routes.txt"][:1], calendar=FILES["calendar.txt"][:1], calendar_dates=[FILES["calendar_dates.txt"][0], "other,19990101,1"])
    with pytest.raises(ValueError, match="patterns: 1 rows with unknown route_id, agency, such as r1, 1; trips: 2 rows with unknown service_id, agency, such as s, 1"):
        load.import_feeds(spark, broken, target)
    assert lineage.published(spark, target) == before
    dated = feed(tmp_path / "dated", calendar=FILES["calendar.txt"][:1])
    assert load.import_feeds(spark, dated, target)["trips"] == 2  # a service may stand in calendar_dates only


def test_older_versions_are_removed_on_request(spark, tmp_path):
    path = str(tmp_path / "kept")
    assert lineage.clean(spark, path) == []
    for n in (1, 2, 3):
        lineage.publish({"numbers": spark.range(n)}, f"m{n}", path)
    with pytest.raises(ValueError):
        lineage.clean(spark, path, 0)
    assert len(lineage.clean(spark, path, 2)) == 1
    (tmp_path / "kept" / "unfinished").mkdir()
    assert len(lineage.clean(spark, path)) == 1
    version, mark, folder = lineage.published(spark, path)
    assert (version, mark, spark.read.parquet(f"{folder}/numbers").count()) == (3, "m3", 3)
    assert sorted(x.name for x in (tmp_path / "kept").iterdir()) == sorted([folder.rsplit("/", 1)[1], "unfinished", "versions"])
