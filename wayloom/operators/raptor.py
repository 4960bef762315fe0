"""Round-based earliest-arrival search over a batch of queries, and the Pareto-optimal journeys.

A label is one row of fixed width: when a query arrives at a stop in a step, and which label of an earlier step it came
from. Step 0 holds the walks to the first stops, step 2r - 1 the rides of round r, step 2r the walks behind them; a query
has one label for each stop and step. Each step is a table of its own that no later one changes, so a journey is read by
following pointers from its last label through the steps backwards, for the journeys that are kept only.

Walks are found on a grid from the stops that a round's rides reach, never between all stops. A round reads the timetable
twice, as it lies: the departures of stops that no round before boarded at go into the departure index, of which a boarding
takes one row; rides are the rows of the boarded trips. A round boards from every stop that it marked and that a pattern
serves; these labels are broadcast where their count says that they're few, and shuffled where not. Within a step everything
is read as it stood at its start.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import corridor, timetable
from .corridor import points, ranked
from .graph import Walks, near_pairs
from .lineage import SMALL, cut, hinted

LEG = "struct<kind:string,from_pk:bigint,to_pk:bigint,trip_pk:bigint,pattern_pk:bigint,board_seq:bigint,alight_seq:bigint,start_sec:bigint,end_sec:bigint,dist_m:double>"
LEG_FIELDS = [x.split(":") for x in LEG[7:-1].split(",")]
#: What a label holds besides query_id and stop_pk, in the order that decides between labels of one stop and step.
HELD = {"arr": "bigint", "legs": "bigint", "walk_m": "double", "from_pk": "bigint", "from_step": "int", "trip_pk": "bigint", "pattern_pk": "bigint", "board_seq": "bigint", "alight_seq": "bigint", "start_sec": "bigint", "dist_m": "double"}


#: Stop times that the departure index of a search is made of, at most.
MOST_CALLS = 5_000_000


@dataclass(frozen=True)
class Options:
    speed: float = 1.4
    rounds: int = 5
    nearby: int = 50
    most_marked: int | None = None  # labels that a round boards from, at most; None: all of them
    transfer_walk_sec: int = 1200
    assumed_speed: float = 10.0
    prune: bool = False  # leave out labels that can't beat the best arrival at assumed_speed; loses journeys of faster trips

    @property
    def transfer_m(self) -> float:
        return self.speed * self.transfer_walk_sec


def walk_secs(metres: Column, speed: float) -> Column:
    return S.half_up(metres / speed).cast("bigint")


def _label(stop_pk: str | Column, **values: Column) -> list[Column]:
    stop = F.col(stop_pk) if isinstance(stop_pk, str) else stop_pk
    return [F.col("query_id"), stop.alias("stop_pk"), *[values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in HELD.items()]]


def _from_origin(rows: DataFrame, o: Options) -> DataFrame:
    """Labels of walks from the origin; rows: (query_id, stop_pk, depart_sec, dist_m)."""
    return rows.select(*_label("stop_pk", arr=F.col("depart_sec") + walk_secs(F.col("dist_m"), o.speed), legs=F.lit(0), walk_m=F.col("dist_m"), start_sec=F.col("depart_sec"), dist_m=F.col("dist_m")))


def seed(queries: DataFrame, stops: DataFrame, o: Options) -> DataFrame:
    """The labels of the stops nearest each origin. queries: (query_id, o_lat, o_lon, d_lat, d_lon, depart_sec)."""
    near = ranked(queries.selectExpr("query_id", "o_lat AS at_lat", "o_lon AS at_lon"), stops, o.nearby)
    return _from_origin(near.join(queries.select("query_id", "depart_sec"), "query_id"), o)


def destinations(queries: DataFrame, stops: DataFrame, o: Options) -> DataFrame:
    return ranked(queries.selectExpr("query_id", "d_lat AS at_lat", "d_lon AS at_lon"), stops, o.nearby).select("query_id", "stop_pk", F.col("dist_m").alias("final_m"))


def candidates(labels: DataFrame, ends: DataFrame, o: Options) -> DataFrame:
    """A journey for each label (with its step) at a stop near the destination; of a round's ride and walk to one stop
    the walk, which is earlier."""
    rows = labels.join(ends, ["query_id", "stop_pk"])
    rows = rows.withColumn("_last", F.max("step").over(Window.partitionBy("query_id", "stop_pk", F.ceil(F.col("step") / 2)))).where("step = _last")
    arrival = F.col("arr") + walk_secs(F.col("final_m"), o.speed)
    return rows.select("query_id", "stop_pk", "step", "final_m", "arr", arrival.alias("arrival_sec"), (F.col("walk_m") + F.col("final_m")).alias("total_walk_m"), "legs")


def prune(marked: DataFrame, best: DataFrame, to_go: DataFrame, o: Options) -> DataFrame:
    """Marked labels that can still beat the best arrival. to_go: (query_id, stop_pk, go_m)."""
    rows = marked.join(to_go, ["query_id", "stop_pk"], "left").join(best, "query_id", "left")
    return rows.where(F.col("best_sec").isNull() | F.col("go_m").isNull() | (F.col("arr") + F.col("go_m") / o.assumed_speed <= F.col("best_sec"))).drop("best_sec")


def trim(marked: DataFrame, seed_stops: DataFrame | None, o: Options) -> DataFrame:
    """At most most_marked labels a query: stops of seed paths, a quarter nearest the destination, then by score."""
    by = Window.partitionBy("query_id")
    rows = marked
    if seed_stops is not None:
        rows = rows.join(seed_stops.select("query_id", "stop_pk").distinct().withColumn("_seed", F.lit(0)), ["query_id", "stop_pk"], "left").withColumn("_seed", F.coalesce("_seed", F.lit(1)))
    else:
        rows = rows.withColumn("_seed", F.lit(1))
    rows = rows.withColumns({"_near": F.row_number().over(by.orderBy(F.desc("_seed"), F.coalesce("go_m", F.lit(float("inf"))), "stop_pk")), "_all": F.count("*").over(by)})
    tier = F.when(F.col("_seed") == 0, 0).when(F.col("_near") <= o.most_marked // 4, 1).otherwise(2)
    rows = rows.withColumn("_tier", tier)
    score = F.col("arr") + F.coalesce("go_m", F.lit(0.0)) / o.assumed_speed
    rows = rows.withColumn("_turn", F.row_number().over(by.orderBy("_tier", score, "stop_pk")))
    return rows.where((F.col("_tier") < 2) | (F.col("_all") <= o.most_marked) | (F.col("_turn") <= o.most_marked)).drop("_seed", "_near", "_all", "_tier", "_turn")


def board(marked: DataFrame, index: DataFrame, pattern_stops: DataFrame) -> DataFrame:
    """The trip that each query boards on each pattern: at its lowest marked stop with a departure in time, the first
    such departure. marked: labels with their step; index: timetable.departure_index, one row of which each marked stop
    of a pattern reads."""
    keys = [k for k in ("query_id", "stop_pk", "pattern_pk", "bucket") if k in index.columns]
    at = marked.select("query_id", "stop_pk", "step", "arr", "legs", "walk_m", timetable.bucket_of(F.col("arr")).alias("bucket"))
    at = if_smaller(at, marked).join(pattern_stops.select("stop_pk", "pattern_pk", F.col("stop_sequence").alias("pattern_seq")), "stop_pk")
    return lowest(index.join(if_smaller(at, marked), keys).withColumn("d", timetable.first_from(F.col("arr"))).where("d IS NOT NULL"))


def lowest(rows: DataFrame) -> DataFrame:
    """Of the departures d that each query may take on a pattern, the first at its lowest stop."""
    first = F.min(F.struct("pattern_seq", "d.departure_sec", "d.trip_pk", "d.stop_sequence", "stop_pk", "legs", "walk_m", "step"))
    return rows.groupBy("query_id", "pattern_pk").agg(first.alias("b")).select("query_id", "pattern_pk", "b.*").drop("pattern_seq")


def if_smaller(df: DataFrame, like: DataFrame) -> DataFrame:
    """df, marked for broadcast if the table it was made from was counted and found small."""
    return F.broadcast(df) if getattr(like, "_small", False) else df


def counted(df: DataFrame, times: int = 1) -> tuple[DataFrame, int]:
    """A cut table with its number of rows; tables made of it, of up to `times` as many rows, may be broadcast if small."""
    df = cut(df)
    n = df.count()
    df._small = n * times <= SMALL
    return df, n


def ride(boarded: DataFrame, stop_times: DataFrame, pattern_stops: DataFrame) -> DataFrame:
    """A label at each later stop of the boarded trips. Trip and pattern must number their stops alike."""
    keys = [k for k in ("query_id", "trip_pk") if k in stop_times.columns]
    starts = pattern_stops.select("pattern_pk", F.col("stop_sequence").alias("board_seq")).distinct()
    b = boarded.select("query_id", "trip_pk", "pattern_pk", F.col("stop_pk").alias("board_pk"), F.col("stop_sequence").alias("board_seq"), F.col("departure_sec").alias("board_sec"), "legs", "walk_m", "step").join(starts, ["pattern_pk", "board_seq"], "left_semi")
    later = stop_times.select(*keys, "stop_pk", "stop_sequence", "arrival_sec")
    rows = later.join(if_smaller(b, boarded), keys).where(F.col("stop_sequence") > F.col("board_seq")).join(pattern_stops.select("pattern_pk", "stop_pk", "stop_sequence"), ["pattern_pk", "stop_pk", "stop_sequence"], "left_semi")
    return rows.select(*_label("stop_pk", arr=F.col("arrival_sec"), legs=F.col("legs") + 1, walk_m=F.col("walk_m"), from_pk=F.col("board_pk"), from_step=F.col("step"), trip_pk=F.col("trip_pk"), pattern_pk=F.col("pattern_pk"), board_seq=F.col("board_seq"), alight_seq=F.col("stop_sequence"), start_sec=F.col("board_sec")))


def relax(labels: DataFrame, best: DataFrame) -> DataFrame:
    """The earliest of the labels at each stop, where it is earlier than the best known arrival."""
    least = labels.groupBy("query_id", "stop_pk").agg(F.min(F.struct(*HELD)).alias("l")).select("query_id", "stop_pk", "l.*")
    known = best.groupBy("query_id", "stop_pk").agg(F.min("arr").alias("_have"))
    return least.join(known, ["query_id", "stop_pk"], "left").where(F.col("_have").isNull() | (F.col("arr") < F.col("_have"))).drop("_have")


def walk_on(labels: DataFrame, n_labels: int, walks: Walks, o: Options) -> DataFrame:
    """One walk from each label (with its step), n_labels of them, to every stop within reach of its own."""
    own = labels.select("query_id", F.col("stop_pk").alias("src"), "arr", "legs", "walk_m", "step")
    rows = walks.from_(own, n_labels)
    return rows.select(*_label("dst", arr=F.col("arr") + walk_secs(F.col("dist_m"), o.speed), legs=F.col("legs"), walk_m=F.col("walk_m") + F.col("dist_m"), from_pk=F.col("src"), from_step=F.col("step"), start_sec=F.col("arr"), dist_m=F.col("dist_m")))


def footpaths(stops: DataFrame, o: Options, whole: bool = False) -> DataFrame:
    return near_pairs(stops, o.transfer_m, both=True, whole=whole).select(F.col("a").alias("src"), F.col("b").alias("dst"), "dist_m")


@dataclass
class Searched:
    """found: candidates of all rounds; steps: the labels of each step, tables that journeys are read from; live: the
    labels that each round boarded from, pruned and trimmed."""

    found: DataFrame
    steps: list[DataFrame]
    live: list[DataFrame]

    def marked(self) -> DataFrame:
        """(query_id, round, stop_pk, arr): the stops that each round marked, each with its last label."""
        rounds = [self.steps[0].select("query_id", F.lit(0).alias("round"), "stop_pk", "arr")]
        for i in range(1, len(self.steps) - 1, 2):
            rounds.append(last_of(self.steps[i], self.steps[i + 1]).select("query_id", F.lit((i + 1) // 2).alias("round"), "stop_pk", "arr"))
        return reduce(DataFrame.unionByName, rounds)


def last_of(rode: DataFrame, walked: DataFrame) -> DataFrame:
    """Of the labels of a round's two steps, those that walks made where both have one."""
    return rode.join(walked.select("query_id", "stop_pk"), ["query_id", "stop_pk"], "left_anti").unionByName(walked)


def first_departures(stop_times: DataFrame, wanted: DataFrame, trips: DataFrame | None, width: int, last: int) -> DataFrame:
    """What timetable.next_departure finds, without an index: (query_id, stop_pk, pattern_pk, d) for each wanted (query_id,
    stop_pk, pattern_pk, tau) that has a departure at tau or later, d being the first. stop_times and trips: as of search.
    last: the last departure of all.

    Departures are sought in windows behind tau, the first `width` seconds wide, each later one eight times as wide, until
    all are found or the last departure is passed. Only the stop times in a window of a stop that still lacks one meet their
    trips; the timetable is filtered as it lies.
    """
    own = [k for k in ("query_id",) if k in stop_times.columns]
    keys = ["query_id", "stop_pk", "pattern_pk"]
    rest, n = counted(wanted)
    since, found, begin = rest.agg(F.min("tau")).first()[0], [], 0  # one row
    while n and since + begin <= last:
        at = if_smaller(rest.select("query_id", "stop_pk", "tau").distinct(), rest)
        late = F.col("departure_sec") - F.col("tau")
        calls = stop_times.join(at, [*own, "stop_pk"]).where((late >= begin) & (late < begin + width))
        calls, _ = counted(calls.select(*([] if trips is not None else ["pattern_pk"]), "query_id", "stop_pk", "trip_pk", "stop_sequence", "arrival_sec", "departure_sec"))
        if trips is not None:
            calls = trips.select("trip_pk", "pattern_pk").join(if_smaller(calls, calls), "trip_pk")
        first = F.min(F.struct("departure_sec", "trip_pk", "stop_sequence", "arrival_sec")).alias("d")
        found.append(cut(calls.join(if_smaller(rest.select(*keys), rest), keys, "left_semi").groupBy(*keys).agg(first)))
        rest, n = counted(rest.join(found[-1], keys, "left_anti"))
        begin, width = begin + width, width * 8
    none = wanted.select(*keys, F.lit(None).cast("struct<departure_sec:bigint,trip_pk:bigint,stop_sequence:bigint,arrival_sec:bigint>").alias("d")).where("false")
    return reduce(DataFrame.unionByName, found, none)


class Departures:
    """What the rounds of a search board. No query boards before the least of the batch sets out (`since`; None: there is
    none).

    The departure index is made for the stops that rounds board at only, once for each, as long as their stop times are
    MOST_CALLS at most. Beyond that it would shuffle and write nearly the whole timetable: each round then seeks the first
    departures behind its labels in the timetable as it lies (first_departures).
    """

    def __init__(self, stop_times: DataFrame, pattern_stops: DataFrame, trips: DataFrame | None, since: int | None):
        self.stop_times = stop_times if since is None else stop_times.where(F.col("departure_sec") >= since)
        self.pattern_stops, self.served, self.trips, self.since = pattern_stops, pattern_stops.select("stop_pk").distinct(), trips, since
        self.own = tuple(k for k in ("query_id",) if k in stop_times.columns)
        self.stops: list[DataFrame] = []
        self.parts: list[DataFrame] = []
        self.held, self.rate = 0, None  # stop times in the index; where it is given up, those of a stop in a second
        self.last = None

    def board(self, live: DataFrame, n_live: int) -> DataFrame | None:
        """What each query boards on each pattern at its live labels, n_live of them: see board(). None if nothing leaves."""
        index = None if self.rate else self.at(live)
        if not self.rate:
            return None if index is None else board(live, index, self.pattern_stops)
        at = live.select("query_id", "stop_pk", "step", "arr", "legs", "walk_m").join(self.pattern_stops.select("stop_pk", "pattern_pk", F.col("stop_sequence").alias("pattern_seq")), "stop_pk")
        wanted = at.select("query_id", "stop_pk", "pattern_pk", F.col("arr").alias("tau")).distinct()
        first = first_departures(self.stop_times, wanted, self.trips, max(int(SMALL / (self.rate * n_live)), 60), self.last)
        return lowest(at.join(first, ["query_id", "stop_pk", "pattern_pk"]))

    def at(self, live: DataFrame) -> DataFrame | None:
        """The index of the stops so far and those of live labels (query_id, stop_pk, ...); None if there are none, or if
        it is given up (rate)."""
        on = [*self.own, "stop_pk"]
        stops = live.select(*on).distinct().join(self.served, "stop_pk", "left_semi").select(*on)
        if self.stops:
            stops = stops.join(reduce(DataFrame.unionByName, self.stops), on, "left_anti")
        stops, n = counted(stops)
        if n:
            calls = timetable.calls_at(self.stop_times, if_smaller(stops, stops))
            n_calls, first, last = calls.agg(F.count("departure_sec"), F.min("departure_sec"), F.max("departure_sec")).first()  # one row
            if self.held + n_calls > MOST_CALLS:
                self.rate, self.last = n_calls / n / (last - first + 1), self.stop_times.agg(F.max("departure_sec")).first()[0]
                return None
            self.held += n_calls
            self.stops.append(stops)
            self.parts.append(cut(timetable.departure_index(timetable.calls_at(self.stop_times, if_smaller(stops, stops), self.trips), self.own)))
        return reduce(DataFrame.unionByName, self.parts) if self.parts else None


def search(queries: DataFrame, stops: DataFrame, pattern_stops: DataFrame, stop_times: DataFrame, o: Options = Options(), allowed: DataFrame | None = None, seed_stops: DataFrame | None = None, whole: DataFrame | None = None, trips: DataFrame | None = None) -> Searched:
    """Searches for a batch of queries.

    stop_times: (trip_pk, pattern_pk, stop_pk, stop_sequence, arrival_sec, departure_sec), with query_id where each query
    has its own; with trips (trip_pk, pattern_pk) without pattern_pk, which is looked up for the stops boarded at. allowed:
    (query_id, stop_pk) of each query's corridor; None for the whole network. whole: (query_id) of the queries that may use
    every stop all the same.
    """
    def inside(rows: DataFrame) -> DataFrame:
        return rows if allowed is None else corridor.inside(rows, allowed, whole)

    queries, n_queries = counted(queries)
    place, pattern_stops = cut(points(stops)), cut(pattern_stops)
    n_patterns = pattern_stops.select("pattern_pk").distinct().count()
    if allowed is None:
        first, ends = seed(queries, stops, o), destinations(queries, stops, o)
    else:
        first, ends = _within(queries, place, allowed, o)
        if whole is not None:  # their nearest stops are found on the grid
            free = queries.join(whole, "query_id", "left_semi")
            first, ends = first.unionByName(seed(free, stops, o)), ends.unionByName(destinations(free, stops, o))
    index = Departures(stop_times, pattern_stops, trips, queries.agg(F.min(F.coalesce("depart_sec", F.lit(-1 << 31)))).first()[0])  # one row
    steps, ends = [cut(first.withColumn("step", F.lit(0)))], cut(ends)
    ends._small = n_queries * o.nearby <= SMALL
    walks = Walks.between(stops, o.transfer_m)
    goal = if_smaller(queries.select("query_id", "d_lat", "d_lon"), queries)
    marked, tried = steps[0], []
    for turn in range(1, o.rounds + 1):
        known = reduce(DataFrame.unionByName, steps)
        go = S.haversine_m(F.col("lat"), F.col("lon"), F.col("d_lat"), F.col("d_lon"))
        near = marked.select("query_id", "stop_pk").join(place, "stop_pk").join(goal, "query_id").select("query_id", "stop_pk", go.alias("go_m"))
        top = candidates(known, if_smaller(ends, ends), o).groupBy("query_id").agg(F.min("arrival_sec").alias("best_sec"))
        live = prune(marked, top, near, o) if o.prune else marked.join(near, ["query_id", "stop_pk"], "left")
        if o.most_marked is not None:
            live = trim(live, seed_stops, o)
        live = cut(live.drop("go_m"))
        tried.append(live)
        # most stops that are walked to have no pattern: they're left out before the labels meet departures
        live, n = counted(live.join(index.served, "stop_pk", "left_semi").select(live.columns), times=8)
        if not n:
            break
        boarded = index.board(live, n)
        if boarded is None:
            break
        boarded._small = n_queries * n_patterns <= SMALL
        rode, n = counted(relax(inside(ride(boarded, stop_times, pattern_stops)), known).withColumn("step", F.lit(2 * turn - 1)))
        if not n:
            break
        walked = cut(relax(inside(walk_on(rode, n, walks, o)), known.unionByName(rode)).withColumn("step", F.lit(2 * turn)))
        marked = last_of(rode, walked)
        steps += [rode, walked]
    return Searched(cut(candidates(reduce(DataFrame.unionByName, steps), if_smaller(ends, ends), o)), steps, tried)


def _within(queries: DataFrame, place: DataFrame, allowed: DataFrame, o: Options) -> tuple[DataFrame, DataFrame]:
    """Seed labels and destinations among each query's allowed stops."""
    rows = allowed.join(place, "stop_pk").join(if_smaller(queries, queries), "query_id")
    from_o = S.haversine_m(F.col("o_lat"), F.col("o_lon"), F.col("lat"), F.col("lon"))
    to_d = S.haversine_m(F.col("d_lat"), F.col("d_lon"), F.col("lat"), F.col("lon"))
    rows = rows.withColumns({"dist_m": from_o, "final_m": to_d})

    def nearest(by: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(by, "stop_pk"))
        return rows.withColumn("rank", rank).where(F.col("rank") <= o.nearby)

    return _from_origin(nearest("dist_m"), o), nearest("final_m").select("query_id", "stop_pk", "final_m")


def pareto(found: DataFrame, most_legs: int = Options.rounds) -> DataFrame:
    """Candidates that no other beats: none is as good in arrival, walk and legs and better in one. Equal ones stay.

    The least walk of each (arrival, legs) is taken behind a shuffle, whose parts are of a size, where a scan's are not: a
    scan of few large files would hold most of the groups in each of its tasks. A sweep over arrivals then keeps, for each
    number of legs, the least walk so far with as many or fewer. legs must be `most_legs` at most. A query is one sweep
    over its distinct arrival seconds. The front is broadcast if it's small.
    """
    least = found.select("query_id", "arrival_sec", "legs", "total_walk_m").repartition("query_id", "arrival_sec", "legs").groupBy("query_id", "arrival_sec", "legs").agg(F.min("total_walk_m").alias("total_walk_m"))
    before = Window.partitionBy("query_id").orderBy("arrival_sec").rangeBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("query_id").orderBy("arrival_sec").rangeBetween(0, 0)

    def upto(n: int) -> Column:
        return F.min(F.when(F.col("legs") <= n, F.col("total_walk_m")))

    rows = least.withColumns({f"b{n}": upto(n).over(before) for n in range(most_legs + 1)} | {f"s{n}": upto(n).over(same) for n in range(most_legs + 1)})
    of_legs = [F.get(F.array(*[f"{x}{n}" for n in range(most_legs + 1)]), (F.col("legs") - i).cast("int")) for x, i in (("b", 0), ("s", 1))]
    # as good with fewer legs at the same second, or at an earlier one
    beaten = reduce(lambda x, y: x | y, [F.coalesce(w <= F.col("total_walk_m"), F.lit(False)) for w in of_legs])
    front = hinted(rows.where(~beaten).select("query_id", "arrival_sec", "legs", "total_walk_m"))
    return found.join(front, ["query_id", "arrival_sec", "legs", "total_walk_m"], "left_semi").select(found.columns)


def dominance(found: DataFrame, most_legs: int = Options.rounds) -> DataFrame:
    """found with the candidate that beats each one, null for those that none beats: of the journeys of the front, the
    first in (arrival_sec, legs, total_walk_m, stop_pk, step) that is as good in all and better in one.

    The front is small: a row for each of its arrivals and numbers of legs is what a candidate meets.
    """
    best = pareto(found, most_legs).groupBy("query_id", "arrival_sec", "legs", "total_walk_m").agg(F.min(F.struct("stop_pk", "step")).alias("k"))
    best = best.select("query_id", F.struct("arrival_sec", "legs", "total_walk_m", "k.stop_pk", "k.step").alias("by"))
    fronts = best.groupBy("query_id").agg(F.array_sort(F.collect_list("by")).alias("front"))  # one query's journeys
    own = (F.col("arrival_sec"), F.col("legs"), F.col("total_walk_m"))

    def beats(x: Column) -> Column:
        theirs = (x["arrival_sec"], x["legs"], x["total_walk_m"])
        return reduce(lambda a, b: a & b, [t <= m for t, m in zip(theirs, own, strict=True)]) & reduce(lambda a, b: a | b, [t < m for t, m in zip(theirs, own, strict=True)])

    return found.join(fronts, "query_id").withColumn("beaten_by", F.get(F.filter("front", beats), F.lit(0))).drop("front")


def traced(winners: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """winners (query_id, stop_pk, step, ...) with trace, the legs that led to each: a pointer that moves on as often as
    there are steps at most. The labels are broadcast, once for all moves, where their count says that they are small;
    else each move joins, of the one step's labels that it can lead to, those that it does lead to."""
    leg = {"kind": F.when(F.col("trip_pk").isNull(), "walk").otherwise("transit"), "to_pk": F.col("stop_pk"), "end_sec": F.col("arr")}
    own = F.struct(*[leg.get(name, F.col(name) if name in HELD else F.lit(None)).cast(kind).alias(name) for name, kind in LEG_FIELDS])
    def labels_of(table: DataFrame) -> DataFrame:
        return table.select("query_id", F.col("stop_pk").alias("at_pk"), F.col("step").alias("at_step"), own.alias("leg"), F.col("from_pk").alias("up_pk"), F.col("from_step").alias("up_step"))

    small = sum(table.count() for table in steps) <= SMALL
    labels = cut(labels_of(reduce(DataFrame.unionByName, steps))) if small else None  # one leaf, however many steps
    on = ["query_id", "at_pk", "at_step"]
    rows = winners.withColumns({"at_pk": F.col("stop_pk"), "at_step": F.col("step")})
    for step in reversed(range(len(steps))):
        if small:
            rows = rows.join(F.broadcast(labels), on, "left")
        else:
            rows = cut(rows)
            rows = rows.join(labels_of(steps[step]).join(rows.select(*on).distinct(), on, "left_semi"), on, "left")
        here = F.col("leg").isNotNull()
        rows = rows.withColumns({"at_pk": F.when(here, F.col("up_pk")).otherwise(F.col("at_pk")), "at_step": F.when(here, F.col("up_step")).otherwise(F.col("at_step"))}).withColumnRenamed("leg", f"leg_{step}").drop("up_pk", "up_step")
    met = [f"leg_{step}" for step in range(len(steps))]
    return rows.withColumn("trace", F.filter(F.array(*met), lambda x: x.isNotNull())).drop("at_pk", "at_step", *met)


def journeys(searched: Searched, o: Options = Options()) -> DataFrame:
    """The Pareto-optimal candidates, ranked by arrival, with the last walk added to their legs."""
    best = traced(cut(pareto(searched.found, o.rounds)), searched.steps)
    walk = {"kind": F.lit("walk"), "from_pk": F.col("stop_pk"), "start_sec": F.col("arr"), "end_sec": F.col("arrival_sec"), "dist_m": F.col("final_m")}
    last = F.struct(*[walk.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in LEG_FIELDS])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("arrival_sec", "legs", "total_walk_m", "stop_pk"))
    return best.withColumns({"journey_no": rank, "trace": F.concat("trace", F.array(last))}).select("query_id", "journey_no", "arrival_sec", "total_walk_m", "legs", "stop_pk", F.filter("trace", lambda x: (x["kind"] != "walk") | (x["dist_m"] > 1)).alias("legs_taken"))


def journey_legs(found: DataFrame) -> DataFrame:
    rows = found.select("query_id", "journey_no", F.posexplode("legs_taken").alias("leg_no", "leg"))
    return rows.select("query_id", "journey_no", (F.col("leg_no") + 1).alias("leg_no"), "leg.*")


def nearest_point(curve: Column, lat: Column, lon: Column) -> Column:
    """The place, from 0 on, of the point of a curve nearest to a position; the first of several."""
    return F.array_min(F.transform(curve, lambda p, i: F.struct(S.haversine_m(lat, lon, p["latitude"], p["longitude"]).alias("d"), i.alias("i"))))["i"]


def shape_slice(curve: Column, i0: Column, i1: Column, ends: Column | None = None) -> Column:
    """The points of a curve from one place to another, in the curve's order. With ends, an array of the two positions
    of a ride, in the order of the ride: turned round where it runs against the curve, and the straight line between
    the ends where both places are the same."""
    part = F.slice(curve, F.least(i0, i1) + 1, F.abs(i1 - i0) + 1)
    if ends is None:
        return part
    return F.when(i0 == i1, ends).when(i0 > i1, F.reverse(part)).otherwise(part)


def with_coords(legs: DataFrame, stops: DataFrame, pattern_stops: DataFrame, shapes: DataFrame, patterns: DataFrame, turned: bool = False) -> DataFrame:
    """Ride legs with coords: the slice of the pattern's shape between the points nearest both stops, in the
    shape's order or, turned, in the ride's (shape_slice); without a shape the stops between. shapes: (shape_pk,
    shape_pt_lat, shape_pt_lon, shape_pt_sequence), shape_pk being the pattern's. Only shapes of legs are read."""
    rides = legs.where("kind = 'transit'")
    place = points(stops)
    a = place.select(F.col("stop_pk").alias("from_pk"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    b = place.select(F.col("stop_pk").alias("to_pk"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"))
    rides = rides.join(a, "from_pk").join(b, "to_pk")
    shaped = patterns.where("shape_id IS NOT NULL").select("pattern_pk")
    curve = shapes.withColumnRenamed("shape_pk", "pattern_pk").join(rides.select("pattern_pk").distinct(), "pattern_pk", "left_semi").join(shaped, "pattern_pk", "left_semi")
    curve = curve.groupBy("pattern_pk").agg(F.array_sort(F.collect_list(F.struct(F.col("shape_pt_sequence").alias("seq"), S.unpack_coord(F.col("shape_pt_lat")).alias("latitude"), S.unpack_coord(F.col("shape_pt_lon")).alias("longitude")))).alias("curve"))  # one shape
    line = pattern_stops.join(rides.select("pattern_pk").distinct(), "pattern_pk", "left_semi").join(place, "stop_pk").groupBy("pattern_pk").agg(F.array_sort(F.collect_list(F.struct(F.col("stop_sequence").alias("seq"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude")))).alias("line"))
    rows = rides.join(curve, "pattern_pk", "left").join(line, "pattern_pk", "left")

    rows = rows.withColumns({f"i{i}": nearest_point(F.col("curve"), F.col(f"{x}_lat"), F.col(f"{x}_lon")) for i, x in enumerate("ab")})

    def plain(points_: Column) -> Column:
        return F.transform(points_, lambda p: F.struct(p["latitude"].alias("latitude"), p["longitude"].alias("longitude")))

    ends = F.array(*[F.struct(F.col(f"{x}_lat").alias("latitude"), F.col(f"{x}_lon").alias("longitude")) for x in "ab"])
    cut_ = shape_slice(plain(F.col("curve")), F.col("i0"), F.col("i1"), ends if turned else None)
    between = plain(F.filter("line", lambda p: p["seq"].between(F.col("board_seq"), F.col("alight_seq"))))
    return rows.select("query_id", "journey_no", "leg_no", "pattern_pk", "from_pk", "to_pk", F.coalesce(cut_, between).alias("coords"))


def journey_lines(legs: DataFrame) -> DataFrame:
    """(query_id, journey_no, coords): the coords of a journey's legs in a row (query_id, journey_no, leg_no, coords);
    where a leg starts at the last point so far, within 1e-9 degrees, that point stands once."""
    def joined(so_far: Column, coords: Column) -> Column:
        a, b = F.get(so_far, F.size(so_far) - 1), F.get(coords, F.lit(0))
        same = (F.abs(a["latitude"] - b["latitude"]) < 1e-9) & (F.abs(a["longitude"] - b["longitude"]) < 1e-9)
        return F.concat(so_far, F.when(same, F.slice(coords, 2, F.greatest(F.size(coords), F.lit(1)))).otherwise(coords))

    rows = legs.where("coords IS NOT NULL").groupBy("query_id", "journey_no").agg(F.array_sort(F.collect_list(F.struct("leg_no", "coords"))).alias("l"))  # the legs of one journey
    empty = F.slice(F.get("l.coords", F.lit(0)), 1, 0)
    return rows.select("query_id", "journey_no", F.aggregate("l.coords", empty, joined).alias("coords"))


def chosen(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """The journeys at the wanted places (query_id, place), counted from 0; one out of bounds chooses none."""
    return found.join(wanted.select("query_id", (F.col("place") + 1).alias("journey_no")), ["query_id", "journey_no"], "left_semi")


def compared(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two sets of journeys, query by query: how many each has, and whether their first journeys arrive at the same
    time with the same number of transfers (null: one of them has none)."""
    def best(found: DataFrame, name: str) -> DataFrame:
        top = F.min(F.struct("journey_no", "arrival_sec", F.greatest(F.col("legs") - 1, F.lit(0)).alias("transfers")))
        return found.groupBy("query_id").agg(F.count("journey_no").alias(f"n_{name}"), top.alias(name))

    rows = best(first, "first").join(best(second, "second"), "query_id", "full")
    return rows.select("query_id", *[F.coalesce(f"n_{x}", F.lit(0)).alias(f"n_{x}") for x in ("first", "second")], *[(F.col(f"first.{x}") == F.col(f"second.{x}")).alias(f"same_{x.partition('_')[0]}") for x in ("arrival_sec", "transfers")])
