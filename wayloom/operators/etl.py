"""From a feed's text rows to the surrogate-keyed tables. Raw tables have agency and _ord, a row's place in its file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .lineage import SMALL, cut, hinted


def number(df: DataFrame, order: list[str], name: str, first: int = 1) -> DataFrame:
    """Number rows from `first` in an order: sorted ranges are numbered each for itself, then shifted by the sizes of
    those before, a table with a row for each range."""
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    rows = rows.withColumns({"_p": F.shiftright("_m", 33), "_m": F.col("_m").bitwiseAND((1 << 33) - 1)})
    before = F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = rows.groupBy("_p").agg(F.count("*").alias("n")).select("_p", before.alias("_before"))
    return rows.join(F.broadcast(shifts), "_p").withColumn(name, (F.col("_before") + F.col("_m") + first).cast("bigint")).drop("_p", "_m", "_before")


def orphans(tables: dict[str, DataFrame], references: list[tuple[str, list[str], list[str]]]) -> DataFrame:
    """(table, columns, n, example): for each reference (table, columns, parents) that is broken, how many rows have a key
    that no parent holds, and the least such key. Null keys refer to nothing."""
    found = []
    for name, columns, parents in references:
        keys = tables[name].dropna(subset=columns).groupBy(*columns).agg(F.count("*").alias("n"))
        for parent in parents:
            keys = keys.join(tables[parent].select(*columns), columns, "left_anti")
        text = F.concat_ws(", ", *[F.col(c).cast("string") for c in columns])
        found.append(keys.agg(F.sum("n").alias("n"), F.min(text).alias("example")).where("n > 0").select(F.lit(name).alias("table"), F.lit(", ".join(columns)).alias("columns"), "n", "example"))
    return reduce(DataFrame.unionByName, found)


def first_wins(df: DataFrame, key: list[str], order: str = "_ord") -> DataFrame:
    """INSERT OR IGNORE: of rows with one key the first stays."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    return df.withColumn("_r", rank).where("_r = 1").drop("_r")


def last_wins(df: DataFrame, key: list[str], order: str = "_ord") -> DataFrame:
    """Of rows with one key the last stays, at the place of the first."""
    by = Window.partitionBy(*key)
    return df.withColumns({"_r": F.row_number().over(by.orderBy(F.desc(order))), "_first": F.min(order).over(by)}).where("_r = 1").drop("_r", order).withColumnRenamed("_first", order)


def unique_or_raise(df: DataFrame, key: list[str]) -> DataFrame:
    """A plain INSERT: a repeated key is an error."""
    again = df.groupBy(*key).count().where("count > 1").limit(1).collect()
    if again:
        raise ValueError(f"duplicate key {key}: {again[0].asDict()}")
    return df


def stops(raw: DataFrame, first_pk: int = 1) -> DataFrame:
    """Stops proper with a position; the first row of an id counts."""
    rows = raw.withColumns({"stop_lat": S.pack_coord(F.col("stop_lat")), "stop_lon": S.pack_coord(F.col("stop_lon"))}).where("stop_lat IS NOT NULL AND stop_lon IS NOT NULL").where(F.coalesce("location_type", F.lit("")).isin("", "0"))
    rows = number(first_wins(rows, ["agency", "stop_id"]), ["agency", "_ord"], "stop_pk", first_pk)
    return rows.select("stop_pk", "stop_id", "stop_name", "stop_lat", "stop_lon", "agency")


def routes(raw: DataFrame) -> DataFrame:
    kind = F.coalesce(S.parse_int(F.coalesce("route_type", F.lit("3"))), F.lit(3))
    text = F.when(F.coalesce("route_text_color", F.lit("")) == "", "#FFFFFF").otherwise(S.hex_color(F.col("route_text_color")))
    rows = raw.select("route_id", F.coalesce("route_short_name", F.lit("")).alias("route_short_name"), F.coalesce("route_long_name", F.lit("")).alias("route_long_name"), kind.alias("route_type"), S.hex_color(F.coalesce("route_color", F.lit(""))).alias("route_color"), text.alias("route_text_color"), "agency", "_ord")
    return first_wins(rows, ["route_id", "agency"]).drop("_ord")


def calendar(raw: DataFrame) -> DataFrame:
    days = [F.coalesce(S.parse_int(F.col(d)), F.lit(0)).alias(d) for d in S.WEEKDAYS]
    return first_wins(raw.select("service_id", "agency", *days, "start_date", "end_date", "_ord"), ["service_id", "agency"]).drop("_ord")


def calendar_dates(raw: DataFrame) -> DataFrame:
    kind = F.coalesce(S.parse_int(F.coalesce("exception_type", F.lit("1"))), F.lit(1))
    return first_wins(raw.select("service_id", "agency", "date", kind.alias("exception_type"), "_ord"), ["service_id", "agency", "date"]).drop("_ord")


def trips(raw: DataFrame, first_pk: int = 1) -> DataFrame:
    """trip_pk is given to every row; of rows with one id the last counts, at the place of the first."""
    rows = number(raw, ["agency", "_ord"], "trip_pk", first_pk)
    rows = rows.withColumns({"direction_id": F.coalesce(S.parse_int(F.col("direction_id")), F.lit(0)), "shape_id": F.nullif("shape_id", F.lit("")), "service_id": F.coalesce("service_id", F.lit(""))})
    return last_wins(rows, ["agency", "trip_id"]).select("trip_pk", "trip_id", "agency", "route_id", "direction_id", "shape_id", "service_id", "_ord")


def stop_times(raw: DataFrame, known_trips: DataFrame, known_stops: DataFrame) -> DataFrame:
    """Times are parsed and stops found before the one shuffle, which meets the trips: stops that are few are broadcast, or
    else those of them that the rows name, if these are few."""
    departure = F.coalesce(F.nullif("departure_time", F.lit("")), F.col("arrival_time"))
    rows = raw.select("agency", "trip_id", "stop_id", F.coalesce(S.parse_int(F.col("stop_sequence")), F.lit(0)).alias("stop_sequence"), S.parse_time(F.col("arrival_time")).alias("arrival_sec"), S.parse_time(departure).alias("departure_sec"), "_ord")
    at = known_stops.select("agency", "stop_id", "stop_pk")
    if at.count() > SMALL:
        at = at.join(raw.select("agency", "stop_id").distinct(), ["agency", "stop_id"], "left_semi")
    rows = rows.join(hinted(at), ["agency", "stop_id"]).drop("stop_id").join(known_trips.select("agency", "trip_id", "trip_pk"), ["agency", "trip_id"])
    return rows.select("trip_pk", "stop_sequence", "stop_pk", "arrival_sec", "departure_sec", "_ord")


def stop_time_rejects(raw: DataFrame, known_trips: DataFrame, known_stops: DataFrame) -> DataFrame:
    """(reason, rows): those of unknown trips, and of the rest those at unknown stops. Rows meet the trips once and are
    counted by stop before they meet the stops, so that no task takes the rows of a busy stop."""
    trip, stop = ["agency", "trip_id"], ["agency", "stop_id"]
    rows = raw.select(*trip, "stop_id").join(known_trips.select(*trip).distinct().withColumn("_trip", F.lit(True)), trip, "left")
    each = rows.groupBy(*stop, "_trip").agg(F.count("*").alias("n"))
    each = each.join(known_stops.select(*stop).distinct().withColumn("_stop", F.lit(True)), stop, "left")
    reason = F.when(F.col("_trip").isNull(), "unknown_trip").when(F.col("_stop").isNull(), "unknown_stop")
    return each.withColumn("reason", reason).where("reason IS NOT NULL").groupBy("reason").agg(F.sum("n").alias("n_rows"))


def sequences(times: DataFrame) -> DataFrame:
    """(trip_pk, stops): each trip's stops in order of sequence, ties in file order. A trip's rows are few."""
    order = "_ord" if "_ord" in times.columns else "stop_pk"
    entry = F.struct("stop_sequence", F.col(order).alias("o"), "stop_pk")
    return times.groupBy("trip_pk").agg(F.array_sort(F.collect_list(entry)).alias("s")).select("trip_pk", F.col("s.stop_pk").alias("stops"), F.col("s.stop_sequence").alias("seqs"))


def patterns(times: DataFrame, trip_rows: DataFrame, first_pk: int = 1) -> DataFrame:
    """Trips with one (agency, route, direction, stop list) share a pattern. The first in file order is its
    representative and gives shape, stops and sequence numbers.

    The trips' lists are shuffled as hashes of 128 bits; lists of representatives alone are carried on.
    """
    each = sequences(times).join(trip_rows, "trip_pk")
    key = F.md5(F.array_join("stops", ",").cast("binary"))
    first = F.min(F.struct("_ord", "trip_pk", "shape_id", "stops", "seqs"))
    groups = each.withColumn("list", key).groupBy("agency", "route_id", "direction_id", "list").agg(first.alias("f"), F.count("*").alias("n_trips"))
    rows = groups.select("agency", "route_id", "direction_id", "list", "n_trips", "f.*")
    return number(rows, ["agency", "_ord"], "pattern_pk", first_pk)


def trip_patterns(times: DataFrame, trip_rows: DataFrame, found: DataFrame) -> DataFrame:
    """(trip_pk, trip_id, agency, pattern_pk, service_id) of the trips with stop times."""
    each = sequences(times).join(trip_rows, "trip_pk").withColumn("list", F.md5(F.array_join("stops", ",").cast("binary")))
    return each.join(found.select("agency", "route_id", "direction_id", "list", "pattern_pk"), ["agency", "route_id", "direction_id", "list"]).select("trip_pk", "trip_id", "agency", "pattern_pk", "service_id")


def pattern_stops(found: DataFrame) -> DataFrame:
    rows = found.select("pattern_pk", F.explode(F.arrays_zip("stops", "seqs")).alias("s"))
    return rows.select("pattern_pk", F.col("s.stops").alias("stop_pk"), F.col("s.seqs").alias("stop_sequence"))


def decimate(points: DataFrame, key: str = "shape_id", order: str = "_ord", every: int = 3) -> DataFrame:
    """Each shape's first point and every third after it, in file order."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return points.withColumn("_r", rank).where(F.col("_r") % every == 0).drop("_r")


def shapes(raw: DataFrame) -> DataFrame:
    """(shape_pk, shape_id, agency, shape_pt_lat, shape_pt_lon, shape_pt_sequence): valid points, every third."""
    rows = raw.withColumns({"shape_pt_lat": S.pack_coord(F.col("shape_pt_lat")), "shape_pt_lon": S.pack_coord(F.col("shape_pt_lon")), "shape_pt_sequence": S.parse_int(F.col("shape_pt_sequence"))})
    rows = rows.where("shape_pt_lat IS NOT NULL AND shape_pt_lon IS NOT NULL").withColumn("_key", F.struct("agency", "shape_id"))
    kept = decimate(rows, "_key").drop("_key")
    ids = number(kept.groupBy("agency", "shape_id").agg(F.min("_ord").alias("_ord")), ["agency", "_ord"], "shape_pk").drop("_ord")
    return kept.join(ids, ["agency", "shape_id"]).select("shape_pk", "shape_id", "agency", "shape_pt_lat", "shape_pt_lon", "shape_pt_sequence")


def next_pk(table: DataFrame, column: str) -> DataFrame:
    return table.agg((F.coalesce(F.max(column), F.lit(0)) + 1).alias("next_pk"))
