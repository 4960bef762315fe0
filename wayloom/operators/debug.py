"""What a search did, as tables: why it failed, pattern by pattern, and a stream of typed events of all its stages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import corridor, raptor, timetable
from .lineage import cut, hinted

VERDICTS = ("not served", "no trips", "upstream", "trimmed", "downstream only", "never marked")


def diagnosed(near: DataFrame, searched: raptor.Searched, pattern_stops: DataFrame, stop_times: DataFrame, patterns: DataFrame | None = None, whole: DataFrame | None = None, trips: DataFrame | None = None) -> DataFrame:
    """(query_id, stop_pk, pattern_pk, verdict, at_pk, at_round, trip_pk, departure_sec): for each stop near a destination
    (query_id, stop_pk) and each pattern that serves it, how near the rounds came to riding there.

    `not served`: no pattern (of the query's, if patterns (query_id, pattern_pk) are given and it isn't in whole) calls there. `no trips`: none of
    its trips does. `upstream`: a stop before it was boarded from; the boarding is replayed at the lowest such stop, and
    trip_pk and departure_sec are what it finds, null if nothing leaves any more. `trimmed`: one was reached, but the trim
    took it out in that round. `downstream only`: only stops behind it were. A stop that a pattern meets twice counts by
    its first place. stop_times and trips: as of raptor.search; only the calls at stops near a destination, and at those that
    a boarding is replayed at, are taken of them.
    """
    near = cut(near.select("query_id", "stop_pk").distinct())
    own = tuple(k for k in ("query_id",) if k in stop_times.columns)
    lines = pattern_stops.groupBy("pattern_pk", "stop_pk").agg(F.min("stop_sequence").alias("seq"))
    served = near.join(lines, "stop_pk")
    if patterns is not None:
        served = corridor.inside(served, patterns.select("query_id", "pattern_pk").distinct(), whole, "pattern_pk")
    keys = [*own, "stop_pk", "pattern_pk"]
    ran = timetable.calls_at(stop_times, hinted(near.select(*own, "stop_pk").distinct()), trips).select(*keys).distinct().withColumn("ran", F.lit(True))
    rows = near.join(served, ["query_id", "stop_pk"], "left").join(ran, keys, "left")
    # what was marked in each round, and whether it was still there when the next round boarded
    live = [table.select("query_id", "stop_pk", F.lit(i).alias("round"), F.lit(True).alias("live")) for i, table in enumerate(searched.live)]
    marks = searched.marked().select("query_id", F.col("stop_pk").alias("at_pk"), F.col("round").alias("at_round"))
    if live:
        marks = marks.join(reduce(DataFrame.unionByName, live).withColumnsRenamed({"stop_pk": "at_pk", "round": "at_round"}), ["query_id", "at_pk", "at_round"], "left")
    else:
        marks = marks.withColumn("live", F.lit(None).cast("boolean"))
    marks = marks.withColumn("live", F.coalesce("live", F.col("at_round") >= len(live)))  # nothing trims the last round's
    met = marks.join(lines.select("pattern_pk", F.col("stop_pk").alias("at_pk"), F.col("seq").alias("at_seq")), "at_pk").join(served, ["query_id", "pattern_pk"])
    up = F.col("at_seq") < F.col("seq")
    first = F.struct("at_round", "at_seq", "at_pk")
    told = met.groupBy("query_id", "stop_pk", "pattern_pk").agg(
        F.min(F.when(up & F.col("live"), F.struct("at_seq", "at_round", "at_pk"))).alias("up"), F.min(F.when(up & ~F.col("live"), first)).alias("gone"), F.min(F.when(~up & F.col("live"), first)).alias("down")
    )
    rows = rows.join(told, ["query_id", "stop_pk", "pattern_pk"], "left")
    verdict = F.when(F.col("pattern_pk").isNull(), "not served").when(F.col("ran").isNull(), "no trips").when(F.col("up").isNotNull(), "upstream").when(F.col("gone").isNotNull(), "trimmed").when(F.col("down").isNotNull(), "downstream only").otherwise("never marked")
    rows = rows.withColumn("verdict", verdict)

    def of(name: str) -> Column:
        return F.when(F.col("verdict") == "upstream", F.col(f"up.{name}")).when(F.col("verdict") == "trimmed", F.col(f"gone.{name}")).when(F.col("verdict") == "downstream only", F.col(f"down.{name}"))

    rows = cut(rows.select("query_id", "stop_pk", "pattern_pk", "verdict", of("at_pk").alias("at_pk"), of("at_round").alias("at_round")))
    # the boarding again, at the earliest time that the stop was ever reached
    at = hinted(rows.where("verdict = 'upstream'").select(*own, F.col("at_pk").alias("stop_pk")).distinct())
    index = timetable.departure_index(timetable.calls_at(stop_times, at, trips), own)
    tau = reduce(DataFrame.unionByName, searched.steps).groupBy("query_id", F.col("stop_pk").alias("at_pk")).agg(F.min("arr").alias("tau"))
    again = rows.where("verdict = 'upstream'").select("query_id", "pattern_pk", "at_pk").distinct().join(tau, ["query_id", "at_pk"]).withColumn("bucket", timetable.bucket_of(F.col("tau")))
    on = [*own, "at_pk", "pattern_pk", "bucket"]
    again = again.join(index.withColumnRenamed("stop_pk", "at_pk"), on).withColumn("d", timetable.first_from(F.col("tau"))).select("query_id", "pattern_pk", "at_pk", "d.trip_pk", "d.departure_sec")
    return rows.join(again.withColumn("verdict", F.lit("upstream")), ["query_id", "pattern_pk", "at_pk", "verdict"], "left").select("query_id", "stop_pk", "pattern_pk", "verdict", "at_pk", "at_round", "trip_pk", "departure_sec")


# --- events --------------------------------------------------------------------------------------

PAYLOAD = {"stop_pk": "bigint", "from_pk": "bigint", "pattern_pk": "bigint", "at_sec": "bigint", "lat": "double", "lon": "double", "radius_m": "double", "chain": "array<bigint>"}


def _events(rows: DataFrame, kind: str, index: Column, place: Column, **payload: Column) -> DataFrame:
    values = F.struct(*[payload.get(name, F.lit(None)).cast(type_).alias(name) for name, type_ in PAYLOAD.items()])
    return rows.select("query_id", F.lit(kind).alias("kind"), index.cast("int").alias("index"), place.cast("bigint").alias("place"), values.alias("payload"))


def events(queries: DataFrame, stops: DataFrame, found: dict[str, DataFrame | None] | None, searched: raptor.Searched | None) -> DataFrame:
    """(query_id, kind, index, place, payload): one table of all that a search reports.

    index is the level, round or path that an event belongs to, place its place in it. Kinds: corridor_stop, corridor_network (a
    query that may use every stop: one event, not one for each stop), seed_path (one
    event for each stop), bfs_level, tree_edge, boundary_left, boundary_right, circle (the walks around both ends),
    round_marked, route_check (a ride that a round kept, with the chain of stops that led to it).
    """
    made, by = [], F.col("stop_pk")
    if found is not None:
        made.append(_events(found["stops"], "corridor_stop", F.lit(0), by, stop_pk=by))
        if found["network"] is not None:
            made.append(_events(found["network"], "corridor_network", F.lit(0), F.lit(0)))
        on = raptor.points(stops)
        line = found["paths"].select("query_id", "path_no", F.posexplode("path").alias("pos", "stop_pk")).join(on, "stop_pk")
        made.append(_events(line, "seed_path", F.col("path_no"), F.col("pos"), stop_pk=by, lat=F.col("lat"), lon=F.col("lon")))
        made.append(_events(found["levels"], "bfs_level", F.col("level"), by, stop_pk=by))
        tree = found["tree"].withColumn("place", F.row_number().over(Window.partitionBy("query_id", "level").orderBy("parent", "child")))
        made.append(_events(tree, "tree_edge", F.col("level"), F.col("place"), stop_pk=F.col("child"), from_pk=F.col("parent")))
        edge = corridor.boundary(found["paths"], stops)
        made += [_events(edge, f"boundary_{side}", F.col("path_no"), F.col("sample"), lat=F.col(f"{side}_lat"), lon=F.col(f"{side}_lon")) for side in ("left", "right")]
        made += [_events(queries, "circle", F.lit(0), F.lit(i), lat=F.col(f"{end}_lat"), lon=F.col(f"{end}_lon"), radius_m=F.lit(corridor.WALK_RADIUS_M)) for i, end in enumerate("od")]
    if searched is not None:
        made.append(_events(searched.marked(), "round_marked", F.col("round"), by, stop_pk=by, at_sec=F.col("arr")))
        for i in range(1, len(searched.steps), 2):
            rode = raptor.traced(searched.steps[i], searched.steps[: i + 1])
            made.append(_events(rode, "route_check", F.lit((i + 1) // 2), by, stop_pk=by, from_pk=F.col("from_pk"), pattern_pk=F.col("pattern_pk"), at_sec=F.col("arr"), chain=F.col("trace.to_pk")))
    return reduce(DataFrame.unionByName, made)


def flattened(events_: DataFrame) -> DataFrame:
    """(query_id, step_no, round, place, payload): a query's route checks in one row of steps from 0 on, round by round."""
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("index", "place"))
    return events_.where("kind = 'route_check'").select("query_id", (order - 1).alias("step_no"), F.col("index").alias("round"), "place", "payload")


def step_counts(events_: DataFrame) -> DataFrame:
    """(query_id, round, n_steps, before): the steps of each round, and those of the rounds before."""
    counts = events_.where("kind = 'route_check'").groupBy("query_id", F.col("index").alias("round")).agg(F.count("*").alias("n_steps"))
    before = F.coalesce(F.sum("n_steps").over(Window.partitionBy("query_id").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("before", before)
