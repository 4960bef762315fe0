"""The search, its skyline and its paths against plain Python on random networks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayloom.functions import scalars as S
from wayloom.operators import corridor, debug, raptor, timetable
from wayloom.plans import engine

R = 6371000.0


def metres(a, b):
    (la, lo), (lb, ob) = a, b
    h = math.sin(math.radians(lb - la) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(lb)) * math.sin(math.radians(ob - lo) / 2) ** 2
    return 2 * R * math.asin(math.sqrt(min(h, 1.0)))


def secs(m, o):
    return math.floor(m / o.speed + 0.5)


class Network:
    """A random network: stops on a plane of some kilometres, patterns that may meet a stop twice, trips in disorder."""

    def __init__(self, seed, n_stops=40, n_patterns=9, trips=6):
        rng = random.Random(seed)
        self.stops = {i: (-37.0 + rng.randrange(0, 90_000) / 1e6, 144.0 + rng.randrange(0, 90_000) / 1e6) for i in range(1, n_stops + 1)}
        self.patterns = {p: [rng.randrange(1, n_stops + 1) for _ in range(rng.randrange(2, 8))] for p in range(1, n_patterns + 1)}
        self.times, pk = [], 0
        for p, line in self.patterns.items():
            for _ in range(trips):
                pk, at = pk + 1, 28_000 + rng.randrange(9000)
                for i, s in enumerate(line):
                    self.times.append((pk, p, s, i + 1, at, at + 20))
                    at += rng.randrange(60, 900)
        self.queries = [(q, *self.stops[rng.randrange(1, n_stops + 1)], *self.stops[rng.randrange(1, n_stops + 1)], 28_800 + rng.randrange(600)) for q in range(1, 4)]

    def tables(self, spark):
        stops = spark.createDataFrame([(i, round(la * 1e6), round(lo * 1e6), 1) for i, (la, lo) in self.stops.items()], "stop_pk long, stop_lat long, stop_lon long, agency long")
        lines = spark.createDataFrame([(p, s, i + 1) for p, line in self.patterns.items() for i, s in enumerate(line)], "pattern_pk long, stop_pk long, stop_sequence long")
        times = spark.createDataFrame(self.times, "trip_pk long, pattern_pk long, stop_pk long, stop_sequence long, arrival_sec long, departure_sec long")
        queries = spark.createDataFrame(self.queries, "query_id long, o_lat double, o_lon double, d_lat double, d_lon double, depart_sec long")
        return queries, stops, lines, times

    def search(self, query, o):
        """(labels of each step by stop: (arr, legs, walk), candidates) of plain rounds."""
        _, ola, olo, dla, dlo, depart = query
        near = sorted((metres((ola, olo), at), s) for s, at in self.stops.items())[: o.nearby]
        ends = {s: d for d, s in sorted((metres((dla, dlo), at), s) for s, at in self.stops.items())[: o.nearby]}
        marked = {s: (depart + secs(d, o), 0, d) for d, s in near}
        best, steps, found = {s: x[0] for s, x in marked.items()}, [marked], []
        add = lambda labels: found.extend((x[0] + secs(ends[s], o), x[2] + ends[s], x[1]) for s, x in labels.items() if s in ends)
        add(marked)
        for _ in range(o.rounds):
            top = min((f[0] for f in found), default=None)
            go = {s: metres(self.stops[s], (dla, dlo)) for s in marked}
            live = {s: x for s, x in marked.items() if not o.prune or top is None or x[0] + go[s] / o.assumed_speed <= top}
            by_near = sorted(live, key=lambda s: (go[s], s))[: o.most_marked // 4]
            turn = sorted(live, key=lambda s: (s not in by_near, live[s][0] + go[s] / o.assumed_speed, s))[: o.most_marked]
            live = {s: x for s, x in live.items() if s in turn or s in by_near}
            rode = {}
            for p, line in self.patterns.items():
                choice = min(((i + 1, dep, t, q, s) for i, s in enumerate(line) if s in live for t, tp, ts, q, _, dep in self.times if tp == p and ts == s and dep >= live[s][0]), default=None)
                if choice is None:
                    continue
                _, _, trip, seq, stop = choice
                for t, _, s, q, arr, _ in self.times:
                    if t == trip and q > seq:
                        new = (arr, live[stop][1] + 1, live[stop][2])
                        if arr < best.get(s, 1 << 60) and (s not in rode or new < rode[s]):
                            rode[s] = new
            after = best | {s: x[0] for s, x in rode.items()}
            walked = {}
            for s, x in rode.items():
                for s2, at in self.stops.items():
                    d = metres(self.stops[s], at)
                    if s2 != s and d <= o.transfer_m:
                        new = (x[0] + secs(d, o), x[1], x[2] + d)
                        if new[0] < after.get(s2, 1 << 60) and (s2 not in walked or new < walked[s2]):
                            walked[s2] = new
            if not rode:
                break
            best = after | {s: x[0] for s, x in walked.items()}
            marked = rode | walked
            steps += [rode, walked]
            add(marked)
        return steps, found


def beats(a, b):
    return all(x <= y for x, y in zip(a, b)) and a != b


@pytest.mark.parametrize("seed", [1])
def test_search_matches_plain_rounds(spark, seed):
    net = Network(seed)
    o = raptor.Options(rounds=3, nearby=6, most_marked=12, transfer_walk_sec=400)
    searched = raptor.search(*net.tables(spark), o)
    assert not any("array" in t for step in searched.steps for _, t in step.dtypes)  # labels are rows of fixed width
    got = {}
    for i, step in enumerate(searched.steps):
        for r in step.collect():
            got[(r.query_id, i, r.stop_pk)] = (r.arr, r.legs, round(r.walk_m, 3))
    wanted, fronts = {}, {}
    for q in net.queries:
        steps, found = net.search(q, o)
        wanted |= {(q[0], i, s): (x[0], x[1], round(x[2], 3)) for i, step in enumerate(steps) for s, x in step.items()}
        fronts[q[0]] = sorted((f[0], round(f[1], 3), f[2]) for f in found if not any(beats(g, f) for g in found))
    assert got == wanted
    found = {}
    for j in raptor.journeys(searched, o).collect():
        found.setdefault(j.query_id, []).append((j.arrival_sec, round(j.total_walk_m, 3), j.legs))
        legs = [x for x in j.legs_taken]
        assert sum(x.kind == "transit" for x in legs) == j.legs
        assert not legs or legs[-1].end_sec == j.arrival_sec or legs[-1].kind == "transit"
        for a, b in zip(legs, legs[1:]):
            assert a.end_sec <= b.start_sec and (a.to_pk == b.from_pk)
        for x in legs:
            if x.kind == "transit":
                own = {(t, q): (s, a, d) for t, _, s, q, a, d in net.times}
                assert own[(x.trip_pk, x.board_seq)][::2] == (x.from_pk, x.start_sec) and own[(x.trip_pk, x.alight_seq)][:2] == (x.to_pk, x.end_sec)
    assert {q: sorted(f) for q, f in found.items()} == fronts


def test_index_holds_the_stops_boarded_at_once_each(spark, monkeypatch):
    net, o, made = Network(5), raptor.Options(rounds=3, nearby=3, transfer_walk_sec=100), []
    real = timetable.departure_index
    monkeypatch.setattr(timetable, "departure_index", lambda times, *more: (made.append({r.stop_pk for r in times.select("stop_pk").distinct().collect()}), real(times, *more))[1])
    queries, stops, lines, times = net.tables(spark)
    rows = lambda found: sorted(map(tuple, found.select("query_id", "stop_pk", "step", "arrival_sec", "legs").collect()))
    one, trips = queries.where("query_id = 1"), times.select("trip_pk", "pattern_pk").distinct()
    searched = raptor.search(one, stops, lines, times, o)
    live = [{r.stop_pk for r in table.collect()} for table in searched.live]
    assert made and sum(map(len, made)) == len(set().union(*made)) and set().union(*made) <= set().union(*live)
    assert made[0] <= live[0] and len(live[0]) == 3
    assert rows(raptor.search(one, stops, lines, times.drop("pattern_pk"), o, trips=trips).found) == rows(searched.found)


def test_shuffled_frontier_gives_the_same(spark, monkeypatch):
    net, o = Network(4), raptor.Options(rounds=2, nearby=5, transfer_walk_sec=300)
    rows = lambda: sorted(map(tuple, raptor.journeys(raptor.search(*net.tables(spark), o), o).select("query_id", "arrival_sec", "legs", "stop_pk").collect()))
    broadcast = rows()
    monkeypatch.setattr(raptor, "SMALL", -1)
    assert rows() == broadcast


def test_a_round_boards_from_all_stops_that_it_marks(spark):
    """450 stops are walked to, and only the one farthest from the destination, with the worst score, has a line to it."""
    net, o = Network(1), raptor.Options(rounds=1, nearby=450)
    net.stops = {i: (-37.0 + i * 2e-6, 144.0) for i in range(1, 451)} | {1: (-37.001, 144.0), 900: (-37.0, 144.3)}
    net.times = [(1, 1, 1, 1, 40_000, 40_020), (1, 1, 900, 2, 40_900, 40_920)]
    net.patterns, net.queries = {1: [1, 900]}, [(1, -37.0, 144.0, -37.0, 144.3, 28_800)]
    searched = raptor.search(*net.tables(spark), o)
    assert searched.live[0].count() == 450
    assert [tuple(r) for r in searched.found.where("legs > 0 AND stop_pk = 900").select("arrival_sec", "legs").collect()] == [(40_900, 1)]


def test_boarding_without_an_index_is_the_same(spark, monkeypatch):
    """First departures sought in windows of a minute and more, where the stop times are too many for an index."""
    monkeypatch.setattr(raptor, "MOST_CALLS", 0)
    real, widths = raptor.first_departures, []
    monkeypatch.setattr(raptor, "first_departures", lambda times, wanted, trips, width, last: (widths.append(width), real(times, wanted, trips, 60, last))[1])
    net, o = Network(7), raptor.Options(rounds=2, nearby=6, transfer_walk_sec=400)
    queries, stops, lines, times = net.tables(spark)
    searched = raptor.search(queries, stops, lines, times.drop("pattern_pk"), o, trips=times.select("trip_pk", "pattern_pk").distinct())
    got = {(r.query_id, i, r.stop_pk): (r.arr, r.legs, round(r.walk_m, 3)) for i, step in enumerate(searched.steps) for r in step.collect()}
    whole = raptor.Options(**(vars(o) | {"most_marked": 1_000_000}))
    assert widths and got == {(q[0], i, s): (x[0], x[1], round(x[2], 3)) for q in net.queries for i, step in enumerate(net.search(q, whole)[0]) for s, x in step.items()}


def test_boarding_reads_one_row_of_the_index(spark):
    rng = random.Random(3)
    times = [(t, t % 3, s, 1, d, d) for t in range(400) for s in (1, 2) for d in [rng.choice([rng.randrange(90_000), 28_800, 28_799, 29_700])]] + [(999, 1, 1, 1, None, None)]
    table = spark.createDataFrame(times, "trip_pk long, pattern_pk long, stop_pk long, stop_sequence long, arrival_sec long, departure_sec long")
    wanted = [(i, rng.choice([1, 2]), rng.randrange(3), rng.choice([rng.randrange(95_000), 28_800, 0, 900])) for i in range(300)]
    asked = spark.createDataFrame(wanted, "key long, stop_pk long, pattern_pk long, tau long")
    index = timetable.departure_index(table)
    read = asked.withColumn("bucket", timetable.bucket_of(F.col("tau"))).join(index, ["stop_pk", "pattern_pk", "bucket"]).groupBy("key").agg(F.count("*").alias("rows"), F.max(F.size("here")).alias("held")).collect()
    assert max(r.rows for r in read) == 1
    assert index.groupBy("stop_pk", "pattern_pk", "bucket").count().where("count > 1").isEmpty()
    got = {r.key: (r.departure_sec, r.trip_pk) for r in timetable.next_departure(index, asked).collect()}
    for key, stop, pattern, tau in wanted:
        later = [(d, t) for t, p, s, _, _, d in times if p == pattern and s == stop and d is not None and d >= tau]
        assert got.get(key) == (min(later) if later else None)


def test_skyline_matches_brute_force(spark):
    rng = random.Random(8)
    rows = [(q, rng.randrange(100, 100 + 40 * q), float(rng.randrange(40)), rng.randrange(6), i, 0) for q in (1, 2, 3) for i in range(300)]
    rows += rows[:40]
    found = spark.createDataFrame(rows, "query_id long, arrival_sec long, total_walk_m double, legs long, stop_pk long, step int")
    front = [r for r in rows if not any(o[0] == r[0] and beats(o[1:4], r[1:4]) for o in rows)]
    assert sorted(map(tuple, raptor.pareto(found).select(found.columns).collect())) == sorted(front)
    assert "NestedLoop" not in raptor.pareto(found)._jdf.queryExecution().toString()
    for r in raptor.dominance(found).collect():
        own = (r.arrival_sec, r.total_walk_m, r.legs)
        by = sorted((f[1], f[3], f[2], f[4], f[5]) for f in front if f[0] == r.query_id and beats(f[1:4], own))
        assert (tuple(r.beaten_by) if r.beaten_by else None) == (by[0] if by else None)


def simple_paths(links, origins, dest, most_stops):
    out, todo = [], [(dest,)]
    while todo:
        path = todo.pop()
        if path[0] in origins:
            out.append(path)
        elif len(path) < most_stops:
            todo += [(p, *path) for p, c in links if c == path[0] and p not in path]
    return out


@pytest.mark.parametrize("seed", range(2))
def test_paths_match_brute_force(spark, seed):
    rng = random.Random(seed)
    n = 16
    rides = {(rng.randrange(n), rng.randrange(n)) for _ in range(45)}
    walks = {x for _ in range(7) for a, b in [(rng.randrange(n), rng.randrange(n))] for x in [(a, b), (b, a)] if a != b}
    edges = spark.createDataFrame([(a, b, "transit", 1.0, 1) for a, b in rides] + [(a, b, "walk", 0.5, None) for a, b in walks], "src long, dst long, kind string, cost double, via_pattern long")
    origins, ends = [0, 1], [13, 14, 15]
    o = spark.createDataFrame([(1, x) for x in origins], "query_id long, stop_pk long")
    d = spark.createDataFrame([(1, x, i) for i, x in enumerate(ends)], "query_id long, stop_pk long, rank int")
    found, tree, hits = corridor.levels(edges, o, d)
    level = {r.stop_pk: r.level for r in found.collect()}
    links = {(r.parent, r.child) for r in tree.collect()}
    sizes = []
    got = [(tuple(r.path)) for r in corridor.paths(found, tree, hits, o, d, 5, sizes).orderBy("path_no").collect()]
    wanted = []
    if hit := hits.first():
        for e in ends:
            if level.get(e, 99) <= hit.first_hit + corridor.MARGIN:
                wanted += sorted(simple_paths(links, origins, e, 29), key=lambda p: (len(p), p))
    assert got == wanted[:5]
    beside = max((sum(1 for p, c in links if level[p] == level[c] and c == x) for x in level), default=0)
    assert all(s <= 5 * n * len(ends) * 2 ** min(beside, 4) for s in sizes)


def test_frontier_grows_with_stops_not_with_paths(spark):
    """Layers of eight stops, each linked with all of the next: 8^5 paths, and never more than 24 for each stop."""
    layers = [[100 * i + k for k in range(8)] for i in range(6)]
    rides = [(a, b) for x, y in zip(layers, layers[1:]) for a in x for b in y] + [(b, 999) for b in layers[-1]]
    edges = spark.createDataFrame([(a, b, "transit", 1.0, 1) for a, b in rides], "src long, dst long, kind string, cost double, via_pattern long")
    o, d = (spark.createDataFrame([(1, x) for x in xs], "query_id long, stop_pk long") for xs in (layers[0], [999]))
    found, tree, hits = corridor.levels(edges, o, d, 7)
    sizes = []
    got = [tuple(r.path) for r in corridor.paths(found, tree, hits, o, d, 24, sizes).orderBy("path_no").collect()]
    assert max(sizes) <= 24 * 8
    assert got == sorted(got) and len(set(got)) == 24 and got[0] == (0, 100, 200, 300, 400, 500, 999) and got[23] == (0, 100, 200, 300, 402, 507, 999)


def labels(spark, step, *rows):
    ddl = "query_id long, stop_pk long, " + ", ".join(f"{c} {t}" for c, t in raptor.HELD.items()) + ", step int"
    return spark.createDataFrame([(1, stop, arr, 0, 0.0, None, None, None, None, None, None, None, None, step) for stop, arr in rows], ddl)


def test_every_verdict_of_a_failed_search(spark):
    """Round 0 marks stop 1; round 1 rides to stop 2, which the trim of round 2 takes out."""
    searched = raptor.Searched(None, [labels(spark, 0, (1, 100)), labels(spark, 1, (2, 200)), labels(spark, 2)], [labels(spark, 0, (1, 100)), labels(spark, 2)])
    lines = {1: [1, 9], 2: [2, 9], 3: [9, 1], 4: [7, 9], 5: [1, 9], 6: [1, 9]}
    pattern_stops = spark.createDataFrame([(p, s, i + 1) for p, line in lines.items() for i, s in enumerate(line)], "pattern_pk long, stop_pk long, stop_sequence long")
    times = [(p, p, s, i + 1, 150 + 10 * i, 150 + 10 * i) for p, line in lines.items() if p < 5 for i, s in enumerate(line)] + [(6, 6, 1, 1, 99, 99), (6, 6, 9, 2, 160, 160)]
    near = spark.createDataFrame([(1, 9), (1, 8)], "query_id long, stop_pk long")
    told = debug.diagnosed(near, searched, pattern_stops, spark.createDataFrame(times, "trip_pk long, pattern_pk long, stop_pk long, stop_sequence long, arrival_sec long, departure_sec long"))
    got = {(r.stop_pk, r.pattern_pk): (r.verdict, r.at_pk, r.at_round, r.trip_pk, r.departure_sec) for r in told.collect()}
    assert got == {
        (8, None): ("not served", None, None, None, None),
        (9, 1): ("upstream", 1, 0, 1, 150),
        (9, 2): ("trimmed", 2, 1, None, None),
        (9, 3): ("downstream only", 1, 0, None, None),
        (9, 4): ("never marked", None, None, None, None),
        (9, 5): ("no trips", None, None, None, None),
        (9, 6): ("upstream", 1, 0, None, None),
    }
    assert {v for v, *_ in got.values()} == set(debug.VERDICTS)


def test_a_failed_search_is_told_from_the_stops_it_names(spark, monkeypatch):
    made, real = [], timetable.departure_index
    monkeypatch.setattr(timetable, "departure_index", lambda times, *more: (made.append(sorted(r.stop_pk for r in times.select("stop_pk").distinct().collect())), real(times, *more))[1])
    searched = raptor.Searched(None, [labels(spark, 0, (1, 100)), labels(spark, 1), labels(spark, 2)], [labels(spark, 0, (1, 100))])
    lines = spark.createDataFrame([(1, 1, 1), (1, 5, 2), (1, 9, 3)], "pattern_pk long, stop_pk long, stop_sequence long")
    times = spark.createDataFrame([(4, s, i, 140 + 10 * i, 140 + 10 * i) for s, i in ((1, 1), (5, 2), (9, 3))], "trip_pk long, stop_pk long, stop_sequence long, arrival_sec long, departure_sec long")
    near = spark.createDataFrame([(1, 9)], "query_id long, stop_pk long")
    told = debug.diagnosed(near, searched, lines, times, trips=spark.createDataFrame([(4, 1)], "trip_pk long, pattern_pk long"))
    assert [tuple(r) for r in told.collect()] == [(1, 9, 1, "upstream", 1, 0, 4, 150)] and made == [[1]]


def test_steps_are_numbered_through_rounds(spark):
    net, o = Network(2), raptor.Options(rounds=2, nearby=5, transfer_walk_sec=300)
    searched = raptor.search(*net.tables(spark), o)
    made = debug.events(net.tables(spark)[0], net.tables(spark)[1], None, searched).cache()
    steps = debug.flattened(made).orderBy("query_id", "step_no").collect()
    for q in {s.query_id for s in steps}:
        own = [s for s in steps if s.query_id == q]
        assert [s.step_no for s in own] == list(range(len(own))) and [(s.round, s.place) for s in own] == sorted((s.round, s.place) for s in own)
        assert all(s.payload.chain[-1] == s.payload.stop_pk and s.payload.chain[-2] == s.payload.from_pk for s in own)
    counts = {(c.query_id, c.round): (c.n_steps, c.before) for c in debug.step_counts(made).collect()}
    for (q, r), (n, before) in counts.items():
        assert n == sum(s.query_id == q and s.round == r for s in steps) and before == sum(s.query_id == q and s.round < r for s in steps)


def test_a_trip_of_tomorrow_is_caught_over_midnight_in_strict_mode(spark):
    metre = 1e6 / 111_194.9
    stops = spark.createDataFrame([(1, -37_000_000, 144_000_000, 1), (2, round(-37e6 + 60_000 * metre), 144_000_000, 1)], "stop_pk long, stop_lat long, stop_lon long, agency long")
    patterns = spark.createDataFrame([(1, "r", 1, 0, None, 1)], "pattern_pk long, route_id string, agency long, direction_id long, shape_id string, trip_pk long")
    lines = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "pattern_pk long, stop_pk long, stop_sequence long")
    trips = spark.createDataFrame([(1, "t", 1, 1, "S")], "trip_pk long, trip_id string, agency long, pattern_pk long, service_id string")
    times = spark.createDataFrame([(1, 1, 1, 900, 900), (1, 2, 2, 2700, 2700)], "trip_pk long, stop_pk long, stop_sequence long, arrival_sec long, departure_sec long")
    days = {d: int(i == 2) for i, d in enumerate(S.WEEKDAYS)}
    calendar = spark.createDataFrame([("S", 1, *days.values(), "19980101", "19981231")], "service_id string, agency long, " + ", ".join(f"{d} long" for d in days) + ", start_date string, end_date string")
    dates = spark.createDataFrame([], "service_id string, agency long, date string, exception_type long")
    q = spark.createDataFrame([(1, -37.0, 144.0, -37.0 + 60_000 * metre / 1e6, 144.0, 85_800)], "query_id long, o_lat double, o_lon double, d_lat double, d_lon double, depart_sec long")
    rides = {}
    for strict in (False, True):
        rows = engine.Engine(stops, patterns, lines, trips, times, calendar, dates, strict=strict).route(q).where("legs > 0").collect()
        rides[strict] = [(r.arrival_sec, [x.trip_pk for x in r.legs_taken if x.kind == "transit"]) for r in rows]
    assert rides == {False: [], True: [(86_400 + 2700, [-1])]}


def with_calendar(spark, net, **more):
    """An engine over a random network whose trips run every day."""
    _, stops, lines, times = net.tables(spark)
    patterns = spark.createDataFrame([(p, f"r{p}", 1, 0, None, 1) for p in net.patterns], "pattern_pk long, route_id string, agency long, direction_id long, shape_id string, trip_pk long")
    trips = times.select("trip_pk", "pattern_pk").distinct().selectExpr("trip_pk", "CAST(trip_pk AS string) AS trip_id", "1L AS agency", "pattern_pk", "'S' AS service_id")
    calendar = spark.createDataFrame([("S", 1, *[1] * 7, "19980101", "19981231")], "service_id string, agency long, " + ", ".join(f"{d} long" for d in S.WEEKDAYS) + ", start_date string, end_date string")
    dates = spark.createDataFrame([], "service_id string, agency long, date string, exception_type long")
    return engine.Engine(stops, patterns, lines, trips, times.drop("pattern_pk"), calendar, dates, **more)


def test_network_corridors_are_a_flag(spark, monkeypatch):
    """Queries without a seed path use every stop and every trip of their window, without a row for each; one query
    beside them keeps its own corridor."""
    net, o = Network(5), raptor.Options(rounds=2, nearby=6, transfer_walk_sec=300)
    net.queries = [(1, *net.queries[0][1:]), (2, *net.queries[1][1:]), (3, *net.queries[2][1:5], 30_000), (4, *net.queries[2][1:5], 90_000)]
    eng, queries = with_calendar(spark, net, options=o), net.tables(spark)[0]
    every = corridor.paths
    monkeypatch.setattr(corridor, "paths", lambda *a, **k: every(*a, **k).where("query_id = 1"))
    monkeypatch.setattr(corridor, "LEAST_PATTERNS", 1)
    found = eng.corridor(queries)
    assert {r.query_id for r in found["network"].collect()} == {2, 3, 4}
    assert {r.query_id for name in ("stops", "patterns") for r in found[name].collect()} == {1}
    # what each may ride, against plain Python
    times = eng.timetable(queries, found)
    got = {(r.query_id, r.trip_pk, r.stop_sequence) for r in times.where("query_id > 1").collect()}
    want = set()
    for q, la, lo, lb, ob, depart in net.queries[1:]:
        w0 = spark.range(1).select(S.window_sec(F.lit(metres((la, lo), (lb, ob)) / 1000)).cast("int")).first()[0]
        for w in (w0, *timetable.WIDER_WINDOWS):
            runs = {t[0] for t in net.times if depart - timetable.BOARD_BUFFER <= t[5] <= depart + w}
            if runs:
                want |= {(q, t[0], t[3]) for t in net.times if t[0] in runs}
                break
    assert got == want and {q for q, *_ in want} == {2, 3}
    # the journeys are those of a search of the whole network
    cols = ["query_id", "journey_no", "arrival_sec", "total_walk_m", "legs", "stop_pk"]
    mine = {tuple(r) for r in eng._run(queries, found, None)[0].select(cols).where("query_id > 1").collect()}
    plain = raptor.journeys(raptor.search(queries.where("query_id > 1"), eng.stops, eng.pattern_stops, times, o), o)
    assert mine == {tuple(r) for r in plain.select(cols).collect()} and any(r[4] for r in mine)
    status = {r.query_id: r.status for r in eng.route(queries).select("query_id", "status").distinct().collect()}
    assert status[4] == "NO_SERVICE_WALK_ONLY" and status[2] in ("OK", "NO_ROUTE")
    kinds = {(r.query_id, r["count"]) for r in eng.events(queries).where("kind = 'corridor_network'").groupBy("query_id").count().collect()}
    assert kinds == {(2, 1), (3, 1), (4, 1)}
    assert {r.verdict for r in eng.diagnose(queries).where("query_id > 1").collect()}.isdisjoint({"outside the corridor"})


def test_a_thousand_network_queries(spark, monkeypatch):
    net = Network(6)
    net.queries = [(q, *net.queries[q % 3][1:5], 28_800 + q) for q in range(1000)]
    queries = net.tables(spark)[0]
    every = corridor.paths
    monkeypatch.setattr(corridor, "paths", lambda *a, **k: every(*a, **k).where("false"))
    eng = with_calendar(spark, net, options=raptor.Options(rounds=1, transfer_walk_sec=300))  # every stop is near enough to walk to
    found = eng.corridor(queries)
    assert found["stops"].isEmpty() and found["network"].count() == 1000
    assert eng._run(queries, found, None)[0].select("query_id").distinct().count() == 1000
