"""Import of feeds: from the files below a path to the ten tables, published together."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..functions import scalars as S
from ..operators import etl
from ..operators.lineage import cut, publish, published
from ..sources import feeds

COLUMNS = {
    "stops": ["stop_id", "stop_name", "stop_lat", "stop_lon", "location_type"],
    "routes": ["route_id", "route_short_name", "route_long_name", "route_type", "route_color", "route_text_color"],
    "calendar": ["service_id", *S.WEEKDAYS, "start_date", "end_date"],
    "calendar_dates": ["service_id", "date", "exception_type"],
    "trips": ["trip_id", "route_id", "direction_id", "shape_id", "service_id"],
    "stop_times": ["trip_id", "stop_id", "stop_sequence", "arrival_time", "departure_time"],
    "shapes": ["shape_id", "shape_pt_lat", "shape_pt_lon", "shape_pt_sequence"],
}
# of a table with one of these keys no two rows may share it; routes, calendars and stops keep the first row instead
KEYS = {"stop_times": ["trip_pk", "stop_sequence"], "pattern_stops": ["pattern_pk", "stop_sequence"], "shapes": ["shape_pk", "shape_pt_sequence"]}
# (table, columns, tables one of which must hold each key)
REFERENCES = [
    ("patterns", ["route_id", "agency"], ["routes"]),
    ("patterns", ["trip_pk"], ["trips"]),
    ("trips", ["service_id", "agency"], ["calendar", "calendar_dates"]),
    ("trips", ["pattern_pk"], ["patterns"]),
    ("pattern_stops", ["pattern_pk"], ["patterns"]),
    ("pattern_stops", ["stop_pk"], ["stops"]),
    ("stop_times", ["trip_pk"], ["trips"]),
    ("stop_times", ["stop_pk"], ["stops"]),
    ("shapes", ["shape_pk"], ["shape_meta"]),
]
TABLES = ("stops", "routes", "calendar", "calendar_dates", "trips", "patterns", "pattern_stops", "stop_times", "shape_meta", "shapes")


def incoming(folder: str) -> str | None:
    """The first zip, by name, of a folder's `incoming`, which is made if it isn't there."""
    path = os.path.join(folder, "incoming")
    os.makedirs(path, exist_ok=True)
    return next((os.path.join(path, name) for name in sorted(os.listdir(path)) if name.endswith(".zip")), None)


def tables(spark: SparkSession, found: list[feeds.Feed]) -> dict[str, DataFrame]:
    """The ten tables of some feeds, numbered through all of them in order."""
    raw = {name: feeds.read(spark, found, f"{name}.txt", columns) for name, columns in COLUMNS.items()}
    stops, trips = cut(etl.stops(raw["stops"])), cut(etl.trips(raw["trips"]))
    times = cut(etl.stop_times(raw["stop_times"], trips, stops))
    patterns = cut(etl.patterns(times, trips))
    shapes = cut(etl.shapes(raw["shapes"].where("shape_id <> ''")))
    return {
        "stops": stops,
        "routes": etl.routes(raw["routes"]),
        "calendar": etl.calendar(raw["calendar"]),
        "calendar_dates": etl.calendar_dates(raw["calendar_dates"]),
        "trips": etl.trip_patterns(times, trips, patterns),
        "patterns": patterns.select("pattern_pk", "route_id", "agency", "direction_id", "shape_id", "trip_pk"),
        "pattern_stops": etl.pattern_stops(patterns),
        "stop_times": times.drop("_ord"),
        "shape_meta": shapes.select("shape_pk", "shape_id", "agency").distinct(),
        "shapes": shapes.select("shape_pk", "shape_pt_lat", "shape_pt_lon", "shape_pt_sequence"),
    }


def import_feeds(spark: SparkSession, source: str, target: str, check: bool = True) -> dict[str, int]:
    """Import all feeds below a path; returns the rows of each table. An error leaves the tables before as they were:
    no feed at all, or, with check, a repeated key or one that its parent table doesn't hold."""
    found = feeds.discover(source)
    if not found:
        raise FileNotFoundError(f"no {feeds.MARKER} below {source}")
    made = tables(spark, found)
    if check:
        for name, key in KEYS.items():
            etl.unique_or_raise(made[name], key)
        if broken := etl.orphans(made, REFERENCES).collect():  # a row for each broken reference
            raise ValueError("; ".join(f"{r['table']}: {r['n']} rows with unknown {r['columns']}, such as {r['example']}" for r in broken))
    publish(made, ",".join(f.label for f in found), target)
    return {name: rows.count() for name, rows in tables_of(spark, target).items()}


def is_ready(spark: SparkSession, path: str) -> bool:
    return published(spark, path) is not None


def tables_of(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables last imported to a path."""
    found = published(spark, path)
    if found is None:
        raise FileNotFoundError(f"no tables have been imported to {path}")
    return {name: spark.read.parquet(f"{found[2]}/{name}") for name in TABLES}
