"""Journeys for batches of queries, end to end."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import corridor, debug, graph, raptor, timetable
from ..operators.lineage import cut, hinted
from . import load


def _shifted(rows: DataFrame) -> DataFrame:
    """Stop times of trips' runs, with the shift of the day that each runs on."""
    return rows.withColumns({"trip_pk": timetable.run_pk(F.col("trip_pk"), F.col("shift")), "arrival_sec": F.col("arrival_sec") + F.col("shift"), "departure_sec": F.col("departure_sec") + F.col("shift")})


@dataclass
class Engine:
    """A timetable, ready for searches. queries: (query_id, o_lat, o_lon, d_lat, d_lon, depart_sec)."""

    stops: DataFrame
    patterns: DataFrame
    pattern_stops: DataFrame
    trips: DataFrame
    stop_times: DataFrame
    calendar: DataFrame
    calendar_dates: DataFrame
    today: tuple[str, int] = ("19980608", 1)
    tomorrow: tuple[str, int] = ("19980609", 2)
    options: raptor.Options = field(default_factory=raptor.Options)
    edges: DataFrame | None = None
    strict: bool = False  # each service day by itself, tomorrow's runs a day later and with their trips' keys negated
    graph_path: str | None = None  # where the stop graph is kept from one engine to the next

    @classmethod
    def from_views(cls, view: Callable[[str], DataFrame], **more) -> Engine:
        return cls(*(view(f"t_{name}") for name in ("stops", "patterns", "pattern_stops", "trips", "stop_times", "calendar", "calendar_dates")), **more)

    @classmethod
    def from_tables(cls, spark: SparkSession, path: str, **more) -> Engine:
        """An engine over imported tables, which keeps its stop graph beside them."""
        found = load.tables_of(spark, path)
        return cls.from_views(lambda name: found[name.removeprefix("t_")], **{"graph_path": f"{path}/graph"} | more)

    def graph(self) -> DataFrame:
        if self.edges is None:
            self.edges = cut(graph.edges(self.stops, self.pattern_stops)) if self.graph_path is None else self._kept_graph(self.graph_path)
        return self.edges

    def _kept_graph(self, path: str) -> DataFrame:
        """The graph at a path, built and written anew if there is none of these stops and patterns."""
        mark = graph.mark_of(self.stops, self.pattern_stops)
        kept = graph.load(self.stops.sparkSession, mark, path)
        if kept is None:
            graph.persist(graph.edges(self.stops, self.pattern_stops), mark, path)
            kept = graph.load(self.stops.sparkSession, mark, path)
        return cut(graph.edges(self.stops, self.pattern_stops)) if kept is None else kept

    def corridor(self, queries: DataFrame) -> dict[str, DataFrame | None]:
        kept = self.edges is not None or self.graph_path is not None  # else the corridor finds the walks that it takes
        return corridor.resolve(queries, self.stops, self.pattern_stops, self.patterns, self.graph() if kept else None)

    def timetable(self, queries: DataFrame, found: dict[str, DataFrame | None], window: int | None = None) -> DataFrame:
        """(query_id, trip_pk, pattern_pk, stop_pk, stop_sequence, arrival_sec, departure_sec) that each query may use:
        active trips of its patterns that leave its stops in its window, at its stops. The window is the first of the
        initial and the wider ones in which the query has a trip. A query of the whole network gets the trips of its
        window alone, met by quarters of an hour."""
        services = timetable.active_services(self.calendar, self.calendar_dates, self.today, self.tomorrow, self.strict)
        scoped = self._scoped(queries, found, services, window)
        if found["network"] is None:
            return scoped
        free = queries.join(found["network"], "query_id", "left_semi").select("query_id", "depart_sec", self._first_window(window).alias("w0"))
        running = timetable.running_trips(self.trips, self.patterns, services)
        rows = cut(_shifted(running.join(self.stop_times, "trip_pk")).select("trip_pk", "pattern_pk", "stop_pk", "stop_sequence", "arrival_sec", "departure_sec"))
        return cut(scoped.unionByName(timetable.trips_in_windows(rows, free, timetable.WIDER_WINDOWS if window is None else ()).join(rows, "trip_pk").select(scoped.columns)))

    @staticmethod
    def _first_window(window: int | None) -> Column:
        km = S.haversine_m(F.col("o_lat"), F.col("o_lon"), F.col("d_lat"), F.col("d_lon")) / 1000
        return F.lit(window) if window else S.window_sec(km).cast("int")

    def _scoped(self, queries: DataFrame, found: dict[str, DataFrame | None], services: DataFrame, window: int | None) -> DataFrame:
        """timetable() of the queries that have stops and patterns of their own."""
        running = cut(timetable.running_trips(self.trips, found["patterns"], services))
        wanted = queries.select("query_id", "depart_sec", self._first_window(window).alias("w0"))
        widest = max(timetable.WIDER_WINDOWS)
        # the stop times of no query's stops are left out before they are shuffled to their trips
        calls = self.stop_times.join(hinted(found["stops"].select("stop_pk").distinct()), "stop_pk", "left_semi")
        rows = found["patterns"].join(running, "pattern_pk").join(calls, "trip_pk").join(found["stops"], ["query_id", "stop_pk"], "left_semi").join(wanted, "query_id")
        rows = _shifted(rows)
        late = F.col("departure_sec") - F.col("depart_sec")
        rows = rows.withColumn("stage", F.when((late < -timetable.BOARD_BUFFER) | (late > widest), None).when(late <= F.col("w0"), 0).when(late <= timetable.WIDER_WINDOWS[0], 1).otherwise(2))
        rows = cut(rows.select("query_id", "trip_pk", "pattern_pk", "stop_pk", "stop_sequence", "arrival_sec", "departure_sec", "stage"))
        trips = rows.groupBy("query_id", "trip_pk").agg(F.min("stage").alias("stage")).where("stage IS NOT NULL")
        least = trips.groupBy("query_id").agg(F.min("stage").alias("stage"))
        return cut(rows.drop("stage").join(trips.join(least, ["query_id", "stage"], "left_semi") if window is None else trips.where("stage = 0"), ["query_id", "trip_pk"], "left_semi"))

    def _run(self, queries: DataFrame, found: dict[str, DataFrame | None], window: int | None) -> tuple[DataFrame, DataFrame, raptor.Searched]:
        times = self.timetable(queries, found, window)
        seeds = found["paths"].select("query_id", F.explode("path").alias("stop_pk"))
        searched = raptor.search(queries, self.stops, self.pattern_stops, times, self.options, found["stops"], seeds, found["network"])
        return raptor.journeys(searched, self.options), times, searched

    def route(self, queries: DataFrame) -> DataFrame:
        """Journeys (query_id, status, journey_no, arrival_sec, total_walk_m, legs, legs_taken); a query without any
        ride is searched again with a ten-hour window. status: OK, NO_ROUTE, NO_SERVICE_WALK_ONLY,
        NO_STOPS_NEAR_ORIGIN (no stop may be used, or no position), NO_STOPS_NEAR_DESTINATION (no position)."""
        asked, queries = queries, queries.where("o_lat IS NOT NULL AND o_lon IS NOT NULL AND d_lat IS NOT NULL AND d_lon IS NOT NULL")
        found = self.corridor(queries)
        first, times, _ = self._run(queries, found, None)
        first = cut(first)
        served = times.select("query_id").distinct()
        rode = first.where("legs > 0").select("query_id").distinct()
        again = cut(queries.join(rode, "query_id", "left_anti").join(served, "query_id", "left_semi"))
        best = first
        if not again.isEmpty():
            second, _, _ = self._run(again, found, timetable.WIDER_WINDOWS[0])
            best = first.join(again, "query_id", "left_anti").unionByName(second)
        best = cut(best)
        rode = best.where("legs > 0").select("query_id").distinct().withColumn("_rode", F.lit(True))
        stopped = found["stops"].select("query_id").distinct()
        if found["network"] is not None and not self.stops.isEmpty():
            stopped = stopped.union(found["network"])
        stopped = stopped.withColumn("_stops", F.lit(True))
        no_origin = F.col("o_lat").isNull() | F.col("o_lon").isNull()
        no_end = F.col("d_lat").isNull() | F.col("d_lon").isNull()
        status = F.when(no_origin, "NO_STOPS_NEAR_ORIGIN").when(no_end, "NO_STOPS_NEAR_DESTINATION").when(F.col("_stops").isNull(), "NO_STOPS_NEAR_ORIGIN").when(F.col("_rode"), "OK").when(F.col("_served"), "NO_ROUTE").otherwise("NO_SERVICE_WALK_ONLY")
        marks = asked.select("query_id", "o_lat", "o_lon", "d_lat", "d_lon").join(stopped, "query_id", "left").join(rode, "query_id", "left").join(served.withColumn("_served", F.lit(True)), "query_id", "left")
        return marks.select("query_id", status.alias("status")).join(best, "query_id", "left")

    def diagnose(self, queries: DataFrame) -> DataFrame:
        """For each stop near a destination, how far the search got: (query_id, stop_pk, verdict)."""
        found = self.corridor(queries)
        _, times, searched = self._run(queries, found, None)
        history = searched.marked()
        near = raptor.destinations(queries, self.stops, self.options)
        served = self.pattern_stops.select("stop_pk").distinct().withColumn("_served", F.lit(True))
        inside = corridor.inside(near.select("query_id", "stop_pk"), found["stops"], found["network"]).withColumn("_inside", F.lit(True))
        ran = times.select("query_id", "stop_pk").distinct().withColumn("_ran", F.lit(True))
        marked = history.groupBy("query_id", "stop_pk").agg(F.min("round").alias("_round"))
        rows = near.join(served, "stop_pk", "left").join(inside, ["query_id", "stop_pk"], "left").join(ran, ["query_id", "stop_pk"], "left").join(marked, ["query_id", "stop_pk"], "left")
        verdict = F.when(F.col("_served").isNull(), "not served by any pattern").when(F.col("_inside").isNull(), "outside the corridor").when(F.col("_ran").isNull(), "no trips in the window").when(F.col("_round").isNull(), "never reached").otherwise(F.concat(F.lit("reached in round "), F.col("_round").cast("string")))
        return rows.select("query_id", "stop_pk", verdict.alias("verdict"))

    def explain(self, queries: DataFrame) -> DataFrame:
        """For each stop near a destination and each pattern of the corridor there, how near the rounds came to riding to
        it: debug.diagnosed."""
        found = self.corridor(queries)
        _, times, searched = self._run(queries, found, None)
        return debug.diagnosed(raptor.destinations(queries, self.stops, self.options), searched, self.pattern_stops, times, found["patterns"], found["network"])

    def events(self, queries: DataFrame) -> DataFrame:
        """All that a search of these queries reports: debug.events."""
        found = self.corridor(queries)
        return debug.events(queries, self.stops, found, self._run(queries, found, None)[2])
