"""Calendars, time windows and the part of the timetable that a journey search needs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

BOARD_BUFFER = 900
QUARTER = 900  # seconds in a bucket of the departure index
WIDER_WINDOWS = (36_000, 72_000)


def runs_on(date: str, dow: int) -> Column:
    """Whether a calendar row runs on a day; dates compare as text."""
    return (F.col(S.WEEKDAYS[dow]) == 1) & (F.col("start_date") <= date) & (F.col("end_date") >= date)


def day_services(calendar: DataFrame, calendar_dates: DataFrame, date: str, dow: int) -> tuple[DataFrame, DataFrame]:
    """(active, removed) services (agency, service_id) of a day."""
    keys = ["agency", "service_id"]
    of_day = calendar_dates.where(F.col("date") == date)
    removed = of_day.where("exception_type = 2").select(keys).distinct()
    added = of_day.where("exception_type = 1").select(keys)
    return calendar.where(runs_on(date, dow)).select(keys).union(added).distinct().join(removed, keys, "left_anti"), removed


def active_services(calendar: DataFrame, calendar_dates: DataFrame, today: tuple[str, int], tomorrow: tuple[str, int], strict: bool = False) -> DataFrame:
    """(agency, service_id, shift). By default both days' services together, and what tomorrow removes is removed
    from today as well; strict keeps each day's own set, tomorrow's shifted by a day."""
    first, _ = day_services(calendar, calendar_dates, *today)
    second, gone = day_services(calendar, calendar_dates, *tomorrow)
    if strict:
        return first.withColumn("shift", F.lit(0)).union(second.withColumn("shift", F.lit(86_400)))
    return second.union(first.join(gone, ["agency", "service_id"], "left_anti")).distinct().withColumn("shift", F.lit(0))


def active_trips(trips: DataFrame, patterns: DataFrame, services: DataFrame) -> DataFrame:
    """Trips on wanted patterns (pattern_pk) whose (agency, service_id) is active."""
    return trips.join(patterns.select("pattern_pk").distinct(), "pattern_pk", "left_semi").join(services, ["agency", "service_id"], "left_semi")


def running_trips(trips: DataFrame, patterns: DataFrame, services: DataFrame) -> DataFrame:
    """(trip_pk, pattern_pk, shift) of the trips on wanted patterns whose service is active, once for each day that it
    runs on; services: (agency, service_id, shift)."""
    rows = trips.join(patterns.select("pattern_pk").distinct(), "pattern_pk", "left_semi")
    return rows.join(services, ["agency", "service_id"]).select("trip_pk", "pattern_pk", "shift").distinct()


def run_pk(trip_pk: Column, shift: Column) -> Column:
    """The key of a trip's run on a day: the trip's own today, the same negated tomorrow."""
    return F.when(shift > 0, -trip_pk).otherwise(trip_pk)


def in_window(departure: Column, depart_sec: int, window: int) -> Column:
    return departure.between(max(0, depart_sec - BOARD_BUFFER), depart_sec + window)


def window_trips(stop_times: DataFrame, trips: DataFrame, stops: DataFrame, depart_sec: int, window: int) -> DataFrame:
    """trip_pk of the active trips that leave a wanted stop within the window."""
    rows = stop_times.where(in_window(F.col("departure_sec"), depart_sec, window))
    return rows.join(stops.select("stop_pk"), "stop_pk", "left_semi").join(trips.select("trip_pk"), "trip_pk", "left_semi").select("trip_pk").distinct()


def window_stage(stop_times: DataFrame, trips: DataFrame, stops: DataFrame, depart_sec: int, first: int, wider: tuple[int, ...] = WIDER_WINDOWS) -> DataFrame:
    """(stage, trip_pk) of the first window that has trips: each trip's least stage is found in one pass."""
    stages = [first, *wider]
    rows = stop_times.where(in_window(F.col("departure_sec"), depart_sec, max(stages)))
    rows = rows.join(stops.select("stop_pk"), "stop_pk", "left_semi").join(trips.select("trip_pk"), "trip_pk", "left_semi")
    stage = reduce(lambda later, i: F.when(in_window(F.col("departure_sec"), depart_sec, stages[i]), i).otherwise(later), reversed(range(len(stages))), F.lit(None).cast("int"))
    each = rows.withColumn("stage", stage).groupBy("trip_pk").agg(F.min("stage").alias("stage"))
    least = each.agg(F.min("stage").alias("stage"))
    return each.join(F.broadcast(least), "stage").select("stage", "trip_pk")  # one row


def trips_in_windows(stop_times: DataFrame, queries: DataFrame, wider: tuple[int, ...] = WIDER_WINDOWS, quarter: int = QUARTER) -> DataFrame:
    """(query_id, trip_pk) of the trips that leave any stop in a query's window, the first of its own (w0) and the wider
    ones that has a departure. queries: (query_id, depart_sec, w0).

    Which window that is, the distinct seconds of departure tell, bounded by the day; trips and queries then meet by the
    quarters of that window alone.
    """
    def near(left: DataFrame, right: DataFrame, most: Column) -> DataFrame:
        bucket = F.explode(F.sequence(F.floor((F.col("depart_sec") - BOARD_BUFFER) / quarter), F.floor((F.col("depart_sec") + most) / quarter)))
        met = left.withColumn("bucket", bucket).join(right.withColumn("bucket", F.floor(F.col("departure_sec") / quarter)), "bucket")
        return met.where(F.col("departure_sec").between(F.col("depart_sec") - BOARD_BUFFER, F.col("depart_sec") + most))

    seconds = stop_times.select("departure_sec").distinct()
    steps = [F.col("w0"), *map(F.lit, wider)]
    late = F.col("departure_sec") - F.col("depart_sec")
    first = F.coalesce(*[F.when(late <= w, F.struct(F.lit(i).alias("i"), w.cast("int").alias("w"))) for i, w in enumerate(steps)])
    own = near(queries, seconds, F.greatest(*steps) if wider else F.col("w0")).groupBy("query_id", "depart_sec").agg(F.min(first)["w"].alias("w"))
    leaves = stop_times.select("trip_pk", "departure_sec").distinct()
    return near(own, leaves, F.col("w")).select("query_id", "trip_pk").distinct()


def scoped_stop_times(stop_times: DataFrame, trip_pks: DataFrame, stops: DataFrame, trips: DataFrame) -> DataFrame:
    """The stop times of window trips at wanted stops, with their pattern."""
    rows = stop_times.join(stops.select("stop_pk"), "stop_pk", "left_semi").join(trip_pks.select("trip_pk"), "trip_pk", "left_semi")
    return rows.join(trips.select("trip_pk", "pattern_pk"), "trip_pk")


def pattern_meta(patterns: DataFrame, routes: DataFrame) -> DataFrame:
    """Patterns with their route's name, type and colour."""
    name = S.route_name(F.col("route_short_name"), F.col("route_long_name"))
    rows = patterns.join(routes, ["route_id", "agency"])
    return rows.select("pattern_pk", "route_id", "agency", "direction_id", "shape_id", name.alias("route_name"), F.coalesce("route_type", F.lit(3)).alias("route_type"), S.route_color(F.col("route_color"), F.coalesce("route_type", F.lit(3)), name).alias("color"))


def departure_board(stop_times: DataFrame) -> DataFrame:
    """(stop_pk, hour, departures): each stop's departures in order, a page for each hour; null hours come last."""
    entry = F.struct("departure_sec", "trip_pk", "stop_sequence", "arrival_sec")
    return stop_times.groupBy("stop_pk", F.floor(F.col("departure_sec") / 3600).alias("hour")).agg(F.array_sort(F.collect_list(entry)).alias("departures"))


def calls_at(stop_times: DataFrame, at: DataFrame, trips: DataFrame | None = None) -> DataFrame:
    """The stop times at the stops of `at` (stop_pk, or query_id and stop_pk). With trips (trip_pk, pattern_pk), stop times
    hold no pattern and look it up there, behind the choice of stops, so that only the rows of these are shuffled."""
    rows = stop_times.join(at, at.columns, "left_semi")
    return rows if trips is None else rows.join(trips.select("trip_pk", "pattern_pk"), "trip_pk")


def departure_index(stop_times: DataFrame, keys: tuple[str, ...] = (), quarter: int = QUARTER) -> DataFrame:
    """(keys, stop_pk, pattern_pk, bucket, here, after): for each quarter of an hour up to the last departure of a pattern
    at a stop, the departures in it, in order, and the first one after it. Of departures in the same second the first in
    (trip_pk, stop_sequence, arrival_sec) stands for all, since whoever waits takes that one: the index is bounded by the
    seconds of the day, and one shuffle serves its three steps.

    Whoever waits from some time on finds the next departure in the one row of that time's bucket. `here` holds what one
    pattern does at one stop in a quarter of an hour, so it's short however long the day's timetable is.
    """
    by = [*keys, "stop_pk", "pattern_pk"]
    rows = stop_times.where("departure_sec IS NOT NULL").select(*by, "departure_sec", "trip_pk", "stop_sequence", "arrival_sec").repartition(*by)
    rows = rows.groupBy(*by, "departure_sec").agg(F.min(F.struct("trip_pk", "stop_sequence", "arrival_sec")).alias("d"))
    one = F.struct("departure_sec", "d.trip_pk", "d.stop_sequence", "d.arrival_sec")
    rows = rows.groupBy(*by, F.floor(F.col("departure_sec") / quarter).alias("full")).agg(F.array_sort(F.collect_list(one)).alias("held"))
    line = Window.partitionBy(*by).orderBy("full")
    rows = rows.withColumns({"since": F.coalesce(F.lag("full").over(line) + 1, F.least(F.col("full"), F.lit(0))), "next": F.lead(F.get("held", F.lit(0))).over(line)})
    rows = rows.withColumn("bucket", F.explode(F.sequence("since", "full")))  # empty quarters before it point to it
    own = F.col("bucket") == F.col("full")
    return rows.select(*by, "bucket", F.when(own, F.col("held")).otherwise(F.slice("held", 1, 0)).alias("here"), F.when(own, F.col("next")).otherwise(F.get("held", F.lit(0))).alias("after"))


def bucket_of(time: Column, quarter: int = QUARTER) -> Column:
    return F.greatest(F.floor(time / quarter), F.lit(0))


def first_from(time: Column) -> Column:
    """The first departure at `time` or later, in the row of departure_index of its bucket."""
    return F.coalesce(F.get(F.filter("here", lambda d: d["departure_sec"] >= time), F.lit(0)), F.col("after"))


def next_departure(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """As-of join: for each wanted (key, stop_pk, pattern_pk, tau) the first departure at tau or later, by one row of
    departure_index each."""
    rows = wanted.withColumn("bucket", bucket_of(F.col("tau"))).join(index, ["stop_pk", "pattern_pk", "bucket"])
    return rows.withColumn("d", first_from(F.col("tau"))).where("d IS NOT NULL").select("key", "stop_pk", "pattern_pk", "tau", "d.*")
