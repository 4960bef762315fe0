"""Micro-networks with answers that can be worked out by hand."""

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from wayloom.functions import scalars as S
from wayloom.operators import corridor, etl, geometry, graph, raptor, timetable
from wayloom.plans import engine
from wayloom.sources import feeds

METRE = 1e6 / 111_194.9


def ps(spark, *patterns):
    rows = [(p + 1, s, i + 1) for p, stops in enumerate(patterns) for i, s in enumerate(stops)]
    return spark.createDataFrame(rows, "pattern_pk long, stop_pk long, stop_sequence long")


def line(spark, *metres):
    """Stops 1, 2, ... on a meridian, so many metres from the first."""
    return spark.createDataFrame([(i + 1, round(-37e6 + m * METRE), 144_000_000, 1) for i, m in enumerate(metres)], "stop_pk long, stop_lat long, stop_lon long, agency long")


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_clique_and_loop(spark):
    assert pairs(graph.ride_edges(ps(spark, [1, 2, 3])), "src", "dst") == [(1, 2), (1, 3), (2, 3)]
    assert pairs(graph.ride_edges(ps(spark, [1, 2, 1])), "src", "dst") == [(1, 2), (2, 1)]


@pytest.mark.parametrize(("n", "edges"), [(60, 1770), (61, 1830), (100, 2549)])
def test_stride(spark, n, edges):
    assert graph.ride_edges(ps(spark, list(range(1, n + 1)))).count() == edges


def test_walk_edges_and_brute_force(spark):
    stops = line(spark, 0, 400, 800, 1200)
    assert pairs(graph.walk_edges(stops), "src", "dst") == [(1, 2), (2, 1), (2, 3), (3, 2), (3, 4), (4, 3)]


def test_pack_round_trip(spark):
    e = graph.edges(line(spark, 0, 400), ps(spark, [1, 2, 1]))
    assert pairs(graph.unpack(graph.pack(e)), *e.columns[:4]) == pairs(e, *e.columns[:4])


def test_persist_needs_the_signature(spark, tmp_path):
    e = graph.edges(line(spark, 0, 400), ps(spark, [1, 2]))
    assert graph.load(spark, "a", str(tmp_path / "g")) is None
    graph.persist(e, "a", str(tmp_path / "g"))
    assert graph.load(spark, "a", str(tmp_path / "g")).count() == e.count()
    assert graph.load(spark, "b", str(tmp_path / "g")) is None


def bfs(spark, rides, walks, origins, ends, transfers=5):
    rows = [(a, b, "transit", 1.0, 1) for a, b in rides] + [(a, b, "walk", 0.5, None) for a, b in walks]
    edges = spark.createDataFrame(rows, "src long, dst long, kind string, cost double, via_pattern long")
    o, d = (spark.createDataFrame([(1, x) for x in xs], "query_id long, stop_pk long") for xs in (origins, ends))
    found, tree, hits = corridor.levels(edges, o, d, transfers)
    return found, hits, [tuple(r["path"]) for r in corridor.paths(found, tree, hits, o, d).orderBy("path_no").collect()]


def test_walks_are_one_hop(spark):
    found, _, _ = bfs(spark, [(9, 9)], [(1, 2), (2, 1), (2, 3), (3, 2)], [1], [99])
    assert pairs(found, "stop_pk", "level") == [(1, 0), (2, 0)]


def test_siblings_and_margin(spark):
    # O1 1, O2 2, M 3, D1 4, D2 5
    _, hits, paths = bfs(spark, [(1, 4), (2, 4), (1, 3), (3, 5), (3, 4)], [], [1, 2], [4, 5])
    assert hits.first()["first_hit"] == 1
    assert sorted(paths) == [(1, 3, 5), (1, 4), (2, 4)]


def test_mutual_walks_end(spark):
    _, _, paths = bfs(spark, [(1, 2), (1, 3)], [(2, 3), (3, 2)], [1], [2])
    assert sorted(paths) == [(1, 2), (1, 3, 2)]


def test_seeds(spark):
    stops = line(spark, 100, 200, 300, 400, 500)
    places = spark.createDataFrame([(1, -37.0, 144.0)], "query_id long, at_lat double, at_lon double")
    routes = spark.createDataFrame([(1, "r1"), (2, "r1"), (3, "r1"), (3, "r2"), (5, "r2")], "stop_pk long, route string")
    assert {r["stop_pk"] for r in corridor.seeds(places, stops, routes).collect()} == {1, 3, 4, 2}


def net(spark):
    """X, Y, Z on one trip; the origin is at X, Y is 500 m away."""
    stops = line(spark, 0, 500, 60_000)
    times = spark.createDataFrame([(1, 1, 1, 1, 28_850, 28_900), (1, 1, 2, 2, 29_450, 29_500), (1, 1, 3, 3, 30_000, 30_020)], "trip_pk long, pattern_pk long, stop_pk long, stop_sequence long, arrival_sec long, departure_sec long")
    q = spark.createDataFrame([(1, -37.0, 144.0, -37.0 + 60_000 * METRE / 1e6, 144.0, 28_800)], "query_id long, o_lat double, o_lon double, d_lat double, d_lon double, depart_sec long")
    return stops, times, q


def test_lowest_sequence_boards_first(spark):
    stops, times, q = net(spark)
    found = raptor.search(q, stops, ps(spark, [1, 2, 3]), times)
    best = raptor.journeys(found).where("legs > 0").collect()
    assert [(r["arrival_sec"], r["legs"]) for r in best][0] == (30_000, 1)
    ride = [x for x in best[0]["legs_taken"] if x["kind"] == "transit"][0]
    assert (ride["from_pk"], ride["to_pk"], ride["board_seq"], ride["alight_seq"]) == (1, 3, 1, 3)


def test_trip_numbered_otherwise_never_rides(spark):
    stops, times, q = net(spark)
    shifted = times.withColumn("stop_sequence", F.col("stop_sequence") * 10)
    found = raptor.search(q, stops, ps(spark, [1, 2, 3]), shifted)
    assert found.found.where("legs > 0").count() == 0


def test_pareto_keeps_ties(spark):
    rows = [(1, 100, 500.0, 2), (1, 110, 200.0, 2), (1, 100, 500.0, 2), (1, 120, 500.0, 3)]
    found = spark.createDataFrame(rows, "query_id long, arrival_sec long, total_walk_m double, legs long")
    assert sorted(tuple(r)[1:] for r in raptor.pareto(found).collect()) == [(100, 500.0, 2), (100, 500.0, 2), (110, 200.0, 2)]


def test_services(spark):
    days = {d: 1 for d in S.WEEKDAYS}
    cal = spark.createDataFrame([("S", 1, *days.values(), "19980101", "19981231")], "service_id string, agency long, " + ", ".join(f"{d} long" for d in S.WEEKDAYS) + ", start_date string, end_date string")
    dates = spark.createDataFrame([("S", 1, "19980609", 2)], "service_id string, agency long, date string, exception_type long")
    args = (cal, dates, ("19980608", 1), ("19980609", 2))
    assert timetable.active_services(*args).count() == 0
    assert [r["shift"] for r in timetable.active_services(*args, strict=True).collect()] == [0]


def test_scalars(spark):
    row = spark.range(1).select(
        S.parse_time(F.lit("")).alias("a"), S.parse_time(F.lit("25:10:00")).alias("b"), S.parse_time(F.lit("7:05")).alias("c"),
        S.half_up(F.lit(-2.5)).alias("d"), S.half_up(F.lit(2.5)).alias("e"), S.parse_key(F.lit("2:aus:vic:_1")).alias("f"),
        S.hex_color(F.lit(" #ff00aa ")).alias("g"), S.hex_color(F.lit("xyz")).alias("h"), S.route_type(F.lit(1650))["label"].alias("i"),
        S.format_hhmm(F.lit(87_300)).alias("j"), S.window_sec(F.lit(60.0)).alias("k"), S.route_type(F.lit(12))["label"].alias("l"),
    ).first()
    assert (row["a"], row["b"], row["c"], row["d"], row["e"]) == (0, 90_600, 25_500, -2, 3)
    assert tuple(row["f"]) == (2, "aus:vic:_1") and (row["g"], row["h"], row["i"], row["j"], row["k"], row["l"]) == ("#FF00AA", "", "Transit", "00:15", 11_700.0, "Monorail")


def test_csv_modes():
    text = '"a, ""b"" c", 5 '
    assert feeds.split_line(text) == ["a, b c", "5"] and feeds.split_line(text, rfc4180=True)[0] == 'a, "b" c'
    rows = list(feeds.records(iter(["﻿id, name\r\n", "\n", "1,x,extra\n", "2\n"])))
    assert rows == [{"id": "1", "name": "x"}, {"id": "2", "name": ""}]


def test_feeds_in_zips(spark, tmp_path):
    inner = tmp_path / "inner.zip"
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("agency.txt", "x")
        z.writestr("stops.txt", "stop_id,stop_lat\nb,2\n")
    with zipfile.ZipFile(tmp_path / "outer.zip", "w") as z:
        z.writestr("feedA/agency.txt", "x")
        z.writestr("feedA/stops.txt", "stop_id,stop_lat\na,1\n")
        z.write(inner, "inner.zip")
        z.writestr("bad.zip", "not a zip")
    inner.unlink()
    found = feeds.discover(str(tmp_path))
    assert len(found) == 2 and feeds.discover(str(tmp_path / "none")) == []
    rows = feeds.read(spark, found, "stops.txt", ["stop_id", "stop_lat", "stop_name"]).collect()
    assert sorted((r["agency"], r["stop_id"], r["stop_lat"], r["stop_name"]) for r in rows) == [(1, "a", "1", None), (2, "b", "2", None)]


def test_decimate_in_file_order(spark):
    rows = spark.createDataFrame([("s", i, 10 - i) for i in range(8)], "shape_id string, _ord long, seq long")
    assert pairs(etl.decimate(rows), "_ord") == [(0,), (3,), (6,)]


def test_duplicate_key_raises(spark):
    with pytest.raises(ValueError, match="duplicate key"):
        etl.unique_or_raise(spark.createDataFrame([(1,), (1,)], "a long"), ["a"])


def test_numbering_is_by_order(spark):
    rows = spark.createDataFrame([(x,) for x in (30, 10, 20, 50, 40)], "o long")
    assert pairs(etl.number(rows, ["o"], "n"), "o", "n") == [(10, 1), (20, 2), (30, 3), (40, 4), (50, 5)]


def test_hull():
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    assert set(geometry.hull([*square, (0.5, 0.5)])) == set(square)


def test_crowded_cells_are_dealt_in_blocks(spark, monkeypatch):
    stops = line(spark, *range(0, 600, 20), 5_000, 5_030)

    def near():
        at = spark.createDataFrame([(q, -37 + q * 1e-4, 144.0) for q in range(40)], "query_id long, at_lat double, at_lon double")
        return pairs(graph.near_pairs(stops, 100), "a", "b"), pairs(corridor.around(at, stops, 300), "query_id", "stop_pk")

    plain = near()
    monkeypatch.setattr(graph, "HOT", 16)
    assert near() == plain
    spread = spark.range(50).select(F.col("id").alias("a"), F.lit(0).alias("y"), F.lit(0).alias("x"))
    placed = spark.range(30).select(F.col("id").alias("b"), F.lit(0).alias("y"), F.lit(0).alias("x"))
    met = graph.met_in_cells(spread, placed, "a", "b", 50)
    assert pairs(met, "a", "b") == [(a, b) for a in range(50) for b in range(30)]
    keys = met.groupBy(*[F.pmod(F.xxhash64(c), F.lit(4)) for c in "ab"]).count()
    assert keys.count() > 4


def test_a_corridor_of_few_stops_is_widened_once(spark):
    # two stops 4 km apart; beside the middle, one stop 1.2 km off (within 350 + 900 m) and one 2 km off (within 700 + 1600 m)
    east = 1e6 / (111_320 * 0.79864)
    spots = [(0, 0), (4_000, 0), (2_000, 1_150), (2_000, 2_000), (2_000, 2_500), (100, 1_500)]
    stops = spark.createDataFrame([(i + 1, round(-37e6 + up * METRE), round(144e6 + across * east), 1) for i, (up, across) in enumerate(spots)], "stop_pk long, stop_lat long, stop_lon long, agency long")
    path = spark.createDataFrame([(1, 1, [1, 2])], "query_id long, path_no int, path array<bigint>")
    none = spark.createDataFrame([], "query_id long, stop_pk long")
    assert pairs(corridor.tapered(path, stops, none), "stop_pk", "widened") == [(1, True), (2, True), (3, True), (4, True)]
    near = spark.createDataFrame([(1, pk) for pk in range(101, 106)], "query_id long, stop_pk long")
    assert pairs(corridor.tapered(path, stops, near), "stop_pk", "widened") == [(pk, False) for pk in [1, 2, 3, *range(101, 106)]]
    # still few after the wider taper: what it gives is taken all the same
    few = corridor.tapered(path, stops.where("stop_pk < 3"), none)
    assert pairs(few, "stop_pk", "widened") == [(1, True), (2, True)]


def test_shape_slices_in_both_orders(spark):
    stops = line(spark, 0, 1_000, 2_000, 2_010)
    on = ps(spark, [1, 2, 3, 4])
    shapes = spark.createDataFrame([(1, round(-37e6 + i * 500 * METRE), 144_000_000, i + 1) for i in range(5)], "shape_pk long, shape_pt_lat long, shape_pt_lon long, shape_pt_sequence long")
    patterns = spark.createDataFrame([(1, "sh")], "pattern_pk long, shape_id string")
    legs = spark.createDataFrame([(1, 1, i, "transit", a, b, 1, 1, 4) for i, (a, b) in enumerate([(1, 2), (3, 1), (3, 4)])], "query_id long, journey_no long, leg_no long, kind string, from_pk long, to_pk long, pattern_pk long, board_seq long, alight_seq long")

    def metres(turned):
        rows = raptor.with_coords(legs, stops, on, shapes, patterns, turned).orderBy("leg_no").collect()
        return [[round((p["latitude"] + 37) * 1e6 / METRE) for p in r["coords"]] for r in rows]

    assert metres(False) == [[0, 500, 1000], [0, 500, 1000, 1500, 2000], [2000]]
    assert metres(True) == [[0, 500, 1000], [2000, 1500, 1000, 500, 0], [2000, 2010]]


def test_walks_are_found_from_a_frontier_only(spark, monkeypatch):
    stops = line(spark, *range(0, 3_000, 100), 0, 5_000)
    front = spark.createDataFrame([(1, 3, "x"), (2, 3, "y"), (1, 20, "z"), (1, 32, "far"), (1, 99, "unknown")], "query_id long, src long, own string")
    want = pairs(graph.both_ways(graph.near_pairs(stops, 450.0)).join(front, "src"), "query_id", "own", "src", "dst", "dist_m")
    walks = graph.Walks.between(stops, 450.0)
    assert len(want) > 20 and pairs(walks.from_(front, 5), "query_id", "own", "src", "dst", "dist_m") == want
    monkeypatch.setattr(graph, "SMALL", 0)
    for hot in (8192, 4):
        monkeypatch.setattr(graph, "HOT", hot)
        assert pairs(walks.from_(front, 5), "query_id", "own", "src", "dst", "dist_m") == want


def test_a_search_makes_no_table_of_all_walks(spark, monkeypatch):
    def all_pairs(*_):
        raise AssertionError("all pairs of near stops")

    stops, times, q = net(spark)
    for module in (graph, raptor):
        monkeypatch.setattr(module, "near_pairs", all_pairs)
    found = raptor.journeys(raptor.search(q, stops, ps(spark, [1, 2, 3]), times))
    assert found.where("legs > 0").count() > 0


def test_the_departure_index_is_bounded_by_seconds(spark):
    rows = [(trip, 1, 1, 1, 28_800 + trip // 50, 28_820 + trip // 50) for trip in range(500)]
    times = spark.createDataFrame(rows, "trip_pk long, stop_sequence long, stop_pk long, pattern_pk long, arrival_sec long, departure_sec long")
    held = [d for r in timetable.departure_index(times).where("bucket = 32").collect() for d in r["here"]]
    assert [(d["departure_sec"], d["trip_pk"]) for d in held] == [(28_820 + i, 50 * i) for i in range(10)]


def test_levels_find_the_walks_of_their_arrivals_only(spark, monkeypatch):
    stops, on = line(spark, 0, 300, 5_000, 5_300, 9_000), ps(spark, [2, 3], [4, 5])
    o, d = (spark.createDataFrame([(1, x)], "query_id long, stop_pk long") for x in (1, 5))
    want = [pairs(x, *x.columns) for x in corridor.levels(graph.edges(stops, on), o, d)]

    def all_pairs(*_):
        raise AssertionError("all pairs of near stops")

    monkeypatch.setattr(graph, "near_pairs", all_pairs)
    assert [pairs(x, *x.columns) for x in corridor.levels(graph.ride_edges(on), o, d, stops=stops)] == want
    q = spark.createDataFrame([(1, -37.0, 144.0, -37.0 + 9_000 * METRE / 1e6, 144.0)], "query_id long, o_lat double, o_lon double, d_lat double, d_lon double")
    none = stops.limit(0)
    eng = engine.Engine(stops, on.select("pattern_pk", F.lit(1).alias("agency"), F.lit("r").alias("route_id")).distinct(), on, none, none, none, none)
    assert eng.corridor(q)["how"].count() == 1


def test_distances_are_computed_once_for_places(spark, monkeypatch):
    # 30 stops at each of 3 places, 300 m apart, and one of them with more stops than a row holds
    stops = line(spark, *[m for m in (0, 300, 600) for _ in range(30)], *[600] * 10)
    where = [0] * 30 + [300] * 30 + [600] * 40
    want = sorted((a + 1, b + 1) for a, x in enumerate(where) for b, y in enumerate(where) if a != b and abs(x - y) <= 450)
    grid, n = graph.on_grid(stops, 450.0)
    assert graph.at_places(grid, n).count() == 3
    for size in (1024, 7):
        monkeypatch.setattr(graph, "LIST", size)
        assert pairs(graph.walk_edges(stops), "src", "dst") == want
        assert pairs(graph.near_pairs(stops, 450.0), "a", "b") == [(a, b) for a, b in want if a < b]
    assert {r["dist_m"] for r in graph.near_pairs(stops, 450.0, both=True, whole=True).collect()} == {0, 300}


def test_walks_are_packed_where_they_are_made(spark, monkeypatch):
    """The texts are those of packing all edges, for shared places, blocks of a cell, and stops without a position or a walk;
    the pairs of a place are grouped in the task that met them."""
    stops = line(spark, *[m for m in (0, 300, 600) for _ in range(3)], 5_000, 9_000).union(spark.createDataFrame([(12, None, None, 1)], "a long, b long, c long, d long"))
    on = ps(spark, [1, 5, 10, 12, 77, 2, 1], [9, 8, 5])
    want = pairs(graph.pack(graph.edges(stops, on)), "stop_pk", "edges")
    edges = graph.edges(stops, on)
    assert {s for s, _ in want} == {*range(1, 11), 12, 77}
    for size, rows in ((1024, 1_000_000), (2, 3)):
        monkeypatch.setattr(graph, "LIST", size)
        monkeypatch.setattr(graph, "PART_ROWS", rows)
        packed = graph.packed(stops, on)
        assert pairs(packed, "stop_pk", "edges") == want
    key = lambda df: sorted(tuple(map(str, r)) for r in df.select(edges.columns).collect())
    assert key(graph.unpack(packed)) == key(edges)
    plan = packed._jdf.queryExecution().executedPlan().toString()
    above, below = plan.index("collect_list(pks"), plan.index("partial_collect_list(pks")
    assert above < below and "Exchange" not in plan[above:below]


def test_footpaths_are_rounded_before_their_pairs_are_written_out(spark):
    rng = random.Random(5)
    stops = spark.createDataFrame([(i, -37_000_000 + rng.randrange(40_000), 144_000_000 + rng.randrange(40_000), 1) for i in range(150)] + [(200 + i, -37_000_000 + i * 15_109, 144_000_000, 1) for i in range(4)], "stop_pk long, stop_lat long, stop_lon long, agency long")
    whole = raptor.footpaths(stops, raptor.Options(), whole=True)
    at, other = corridor.points(stops), corridor.points(stops).toDF("dst", "b_lat", "b_lon")
    dist = S.haversine_m(F.col("lat"), F.col("lon"), F.col("b_lat"), F.col("b_lon"))
    want = at.withColumnRenamed("stop_pk", "src").crossJoin(other).where(F.col("src") != F.col("dst")).withColumn("d", dist).where("d <= 1680")
    assert pairs(whole, "src", "dst", "dist_m") == pairs(want.withColumn("dist_m", F.round("d").cast("bigint")), "src", "dst", "dist_m")
    assert "round(" not in whole._jdf.queryExecution().executedPlan().toString()
    odd = [0.0, 0.49999999999999994, 0.5, 1.5, 2.4999999999999996, 2.5, 1679.5, 1679.4999999999998, 4503599627370495.5]
    rows = spark.createDataFrame([(x,) for x in odd], "x double").select(S.round_half(F.col("x")).alias("a"), F.round("x").cast("bigint").alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rides_of_a_long_pattern_are_not_one_task(spark, monkeypatch):
    on = ps(spark, list(range(1, 201)), [5, 6, 5], [300, 301])
    n, step = 200, 200 // 40
    want = {(a + 1, b + 1): 1 for a in range(n) for b in range(a + 1, n) if b == n - 1 or b % step == 0}
    want = sorted((*k, min(v, want.get(k, v))) for k, v in (want | {(300, 301): 3, (5, 6): want.get((5, 6), 2), (6, 5): 2}).items())
    got = graph.ride_edges(on)
    assert pairs(got, "src", "dst", "via_pattern") == want
    assert "row_number" not in plan_of(graph.positions(on)) and "hashpartitioning(src#" in plan_of(got)
    assert "dst" not in "".join(x for x in plan_of(got).splitlines() if "hashpartitioning" in x)
    monkeypatch.setattr(graph, "SMALL", 0)
    assert pairs(graph.ride_edges(on), "src", "dst", "via_pattern") == want


def raw_times(spark):
    rows = [("a", "A", "1", "7:00:00", ""), ("a", "B", "2", "7:10:00", "7:11:00"), ("a", "X", "3", "7:20:00", ""), ("b", "A", "x", "25:00:00", ""), ("z", "A", "1", "7:00:00", ""), ("z", "X", "2", "7:00:00", ""), (None, "A", "1", "", ""), ("b", None, "1", "", "")]
    raw = spark.createDataFrame([(1, *r, i) for i, r in enumerate(rows)], "agency long, trip_id string, stop_id string, stop_sequence string, arrival_time string, departure_time string, _ord long")
    trips = spark.createDataFrame([(1, "a", 11), (1, "b", 12), (2, "z", 13)], "agency long, trip_id string, trip_pk long")
    return raw, trips, spark.createDataFrame([(1, "A", 21), (1, "B", 22), (2, "X", 23), (1, "unused", 24)], "agency long, stop_id string, stop_pk long")


def test_stop_times_shuffle_rows_once(spark, monkeypatch):
    raw, trips, stops = raw_times(spark)
    want = [(11, 1, 21, 25_200, 25_200, 0), (11, 2, 22, 25_800, 25_860, 1), (12, 0, 21, 90_000, 90_000, 3)]
    for small in (200_000, 3):  # 3: only the stops that the rows name are few
        monkeypatch.setattr(etl, "SMALL", small)
        rows = etl.stop_times(raw, trips, stops)
        assert sorted(map(tuple, rows.collect())) == want
        plan = rows.hint("x")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("strategy=broadcast") == 1


def test_rejects_meet_the_trips_once(spark):
    raw, trips, stops = raw_times(spark)
    rows = etl.stop_time_rejects(raw, trips.union(trips), stops.union(stops))
    assert pairs(rows, "reason", "n_rows") == [("unknown_stop", 2), ("unknown_trip", 3)]
    joins = [x for x in rows._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert len(joins) == 2


def test_groups_are_not_held_by_the_tasks_of_a_scan(spark, tmp_path):
    from wayloom.plans import queries

    found = spark.createDataFrame([(q, a, float(w), n) for q in (1, 2) for a in range(5) for w in (3, 7) for n in (1, 2)], "query_id long, arrival_sec long, total_walk_m double, legs long")
    front = raptor.pareto(found)
    assert pairs(front, "query_id", "arrival_sec", "total_walk_m", "legs") == [(1, 0, 3.0, 1), (2, 0, 3.0, 1)]
    assert front._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == 1
    times = spark.createDataFrame([(s, t, n) for s in (1, 2) for t in range(9) for n in (1, 2)], "stop_pk long, trip_pk long, stop_sequence long")
    rows = queries.agg_stop_trip_index(lambda _: times)
    assert pairs(rows, "stop_pk", "trip_pk", "n_visits", "last_seq") == [(s, t, 2, 2) for s in (1, 2) for t in range(9)]
    assert "RepartitionByExpression" in rows._jdf.queryExecution().optimizedPlan().toString()
