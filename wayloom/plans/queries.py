"""Registered queries of the transit engine over the adapter tables, and the same as SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import corridor, debug, etl, geometry, graph, raptor, timetable
from ..operators.lineage import cut, hinted, parts_for
from ..sources import adapter, feeds, places
from . import engine

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

DEPART, TODAY, TOMORROW = 28_800, ("19980608", 1), ("19980609", 2)
FROM_PK, TO_PK = 1, 40


def query(body: str | None = None, views: tuple[str, ...] = ()):
    """Register a function of a table getter under its name; body is SQL over the views."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: adapter.view(spark, sf_dir, name))
        if body is not None:
            SQL[f.__name__] = (adapter.with_views(*views) + "\n" if views else "") + body.strip()
        return f

    return register


def ctes(views: tuple[str, ...], named: str, select: str) -> str:
    """SQL with further named parts after the views."""
    return adapter.with_views(*views) + ",\n" + named.strip() + "\n" + select.strip()


def haversine_sql(a_lat: str, a_lon: str, b_lat: str, b_lon: str) -> str:
    h = f"pow(sin(radians({b_lat} - {a_lat}) / 2), 2) + cos(radians({a_lat})) * cos(radians({b_lat})) * pow(sin(radians({b_lon} - {a_lon}) / 2), 2)"
    return f"(2 * 6371000.0::DOUBLE * asin(sqrt(least({h}, 1.0))))"


# --- scans --------------------------------------------------------------------------------


@query("SELECT stop_pk, stop_id, stop_name, stop_lat / 1e6::DOUBLE AS lat, stop_lon / 1e6::DOUBLE AS lon, agency FROM t_stops", ("t_stops",))
def scan_stops(t):
    return t("t_stops").select("stop_pk", "stop_id", "stop_name", S.unpack_coord(F.col("stop_lat")).alias("lat"), S.unpack_coord(F.col("stop_lon")).alias("lon"), "agency")


@query("SELECT route_id, coalesce(route_short_name, '') AS short_name, coalesce(route_type, 3) AS route_type, agency, CAST(dense_rank() OVER (ORDER BY agency, route_id) AS BIGINT) AS route_no FROM t_routes", ("t_routes",))
def scan_routes(t):
    rows = t("t_routes").select("route_id", F.coalesce("route_short_name", F.lit("")).alias("short_name"), F.coalesce("route_type", F.lit(3)).alias("route_type"), "agency")
    return etl.number(rows, ["agency", "route_id"], "route_no")


@query("SELECT p.pattern_pk, p.route_id, p.agency, p.direction_id, p.shape_id, r.route_type FROM t_patterns p LEFT JOIN t_routes r ON r.route_id = p.route_id AND r.agency = p.agency", ("t_patterns", "t_routes"))
def scan_patterns(t):
    return t("t_patterns").join(t("t_routes").select("route_id", "agency", "route_type"), ["route_id", "agency"], "left").select("pattern_pk", "route_id", "agency", "direction_id", "shape_id", "route_type")


@query("SELECT DISTINCT p.agency, p.shape_id, p.pattern_pk AS shape_pk FROM t_patterns p WHERE p.shape_id IS NOT NULL", ("t_patterns",))
def scan_shape_index(t):
    return t("t_patterns").where("shape_id IS NOT NULL").select("agency", "shape_id", F.col("pattern_pk").alias("shape_pk")).distinct()


@query("SELECT pattern_pk, stop_sequence, stop_pk FROM t_pattern_stops ORDER BY pattern_pk, stop_sequence", ("t_pattern_stops",))
def scan_pattern_stops(t):
    return t("t_pattern_stops").select("pattern_pk", "stop_sequence", "stop_pk").orderBy("pattern_pk", "stop_sequence")


@query("SELECT s.stop_pk, s.stop_name FROM t_stops s JOIN (SELECT CAST(unnest([3, 5, 8, 13, 21, 21]) AS BIGINT) AS pk) j ON j.pk = s.stop_pk GROUP BY ALL", ("t_stops",))
def json_each_unnest(t):
    stops = t("t_stops")
    wanted = stops.limit(1).select(F.explode(F.from_json(F.lit("[3,5,8,13,21,21]"), "array<bigint>")).alias("stop_pk"))
    return stops.join(wanted, "stop_pk", "left_semi").select("stop_pk", "stop_name")


# as many as there are orders, so that the load grows with the tables
QUERIES["gen_synthetic_stop_times"] = lambda spark, sf_dir: feeds.synthetic_stop_times(spark, adapter.view(spark, sf_dir, "orders").count())
SQL["gen_synthetic_stop_times"] = "SELECT i // 20 + 1 AS trip_pk, i % 20 AS stop_sequence, i % 9000 + 1 AS stop_pk, 18000 + i % 86400 AS arrival_sec, 18020 + i % 86400 AS departure_sec FROM (SELECT row_number() OVER () - 1 AS i FROM orders) a"


@query("SELECT stop_pk, concat(stop_id, '|', stop_name, ', no. ', agency, '||', stop_lat) AS fields, CAST(4 AS BIGINT) AS n FROM t_stops", ("t_stops",))
def src_csv_split(t):
    """The csv splitter over a line of each stop, with a quoted comma, blanks around fields and an empty one."""
    lines = t("t_stops").select("stop_pk", F.concat("stop_id", F.lit(' , "'), "stop_name", F.lit(", no. "), F.col("agency").cast("string"), F.lit('",,\t'), F.col("stop_lat").cast("string")).alias("line"))

    def split(batches):
        for pdf in batches:
            fields = [feeds.split_line(x) for x in pdf["line"]]
            yield pdf[["stop_pk"]].assign(fields=["|".join(f) for f in fields], n=[len(f) for f in fields])

    return lines.mapInPandas(split, "stop_pk long, fields string, n long")


# --- set, range and calendar filters -------------------------------------------------------


@query("SELECT pattern_pk, stop_pk, stop_sequence FROM t_pattern_stops WHERE stop_pk IN (SELECT stop_pk FROM t_pattern_stops WHERE pattern_pk IN (1, 2))", ("t_pattern_stops",))
def filter_in_set(t):
    return t("t_pattern_stops").join(t("t_pattern_stops").where("pattern_pk IN (1, 2)").select("stop_pk"), "stop_pk", "left_semi").select("pattern_pk", "stop_pk", "stop_sequence")


@query(f"SELECT trip_pk, stop_sequence, stop_pk, departure_sec FROM t_stop_times WHERE departure_sec BETWEEN {DEPART - 900} AND {DEPART + 9000}", ("t_stop_times",))
def filter_time_window(t):
    return t("t_stop_times").where(timetable.in_window(F.col("departure_sec"), DEPART, 9000)).select("trip_pk", "stop_sequence", "stop_pk", "departure_sec")


@query("SELECT service_id, agency FROM t_calendar WHERE monday = 1 AND start_date <= '19980608' AND end_date >= '19980608'", ("t_calendar",))
def filter_calendar_day(t):
    return t("t_calendar").where(timetable.runs_on(*TODAY)).select("service_id", "agency")


@query(ctes(("t_stops",), "b AS (SELECT min(stop_lat) / 1e6::DOUBLE AS s, max(stop_lat) / 1e6::DOUBLE AS n, min(stop_lon) / 1e6::DOUBLE AS w, max(stop_lon) / 1e6::DOUBLE AS e FROM t_stops WHERE stop_pk IN (1, 40, 77))", f"""
SELECT stop_pk FROM t_stops, b WHERE stop_lat / 1e6 BETWEEN s - 1250 / 111320.0::DOUBLE AND n + 1250 / 111320.0::DOUBLE
AND stop_lon / 1e6 BETWEEN w - 1250 / 111320.0::DOUBLE / greatest(0.1, cos(radians((s + n) / 2))) AND e + 1250 / 111320.0::DOUBLE / greatest(0.1, cos(radians((s + n) / 2)))"""))
def filter_bbox(t):
    stops = t("t_stops")
    path = corridor.points(stops.where("stop_pk IN (1, 40, 77)")).select(F.lit(1).alias("query_id"), F.lit(1).alias("path_no"), "lat", "lon")
    return corridor.in_bbox(stops, corridor.bbox(path, 1250.0)).select("stop_pk")


_H = haversine_sql("o.stop_lat / 1e6::DOUBLE", "o.stop_lon / 1e6::DOUBLE", "s.stop_lat / 1e6::DOUBLE", "s.stop_lon / 1e6::DOUBLE")


def _od(t, pairs=((FROM_PK, TO_PK),)) -> DataFrame:
    """queries (query_id, o_lat, o_lon, d_lat, d_lon, depart_sec) between pairs of stops."""
    p = corridor.points(t("t_stops"))
    rows = None
    for i, (a, b) in enumerate(pairs):
        one = p.where(F.col("stop_pk") == a).select(F.lit(i + 1).cast("bigint").alias("query_id"), F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"))
        one = one.join(p.where(F.col("stop_pk") == b).select(F.lit(i + 1).cast("bigint").alias("query_id"), F.col("lat").alias("d_lat"), F.col("lon").alias("d_lon"), F.lit(DEPART).cast("bigint").alias("depart_sec")), "query_id")
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query(f"SELECT DISTINCT s.stop_pk FROM t_stops s, t_stops o WHERE o.stop_pk IN ({FROM_PK}, {TO_PK}) AND {_H} <= 900", ("t_stops",))
def filter_radius(t):
    return corridor.near_ends(_od(t), t("t_stops")).select("stop_pk")


@query("SELECT p.pattern_pk, p.route_id FROM t_patterns p JOIN t_routes r USING (route_id, agency) WHERE coalesce(nullif(r.route_short_name, ''), nullif(r.route_long_name, ''), '?') = 'R7'", ("t_patterns", "t_routes"))
def diag_route_probe(t):
    return timetable.pattern_meta(t("t_patterns"), t("t_routes")).where("route_name = 'R7'").select("pattern_pk", "route_id")


# --- joins --------------------------------------------------------------------------------

NAME_SQL = "coalesce(nullif(route_short_name, ''), nullif(route_long_name, ''), '?')"


def type_sql(code: str) -> tuple[str, str]:
    """SQL for category and label of a route type."""
    out = []
    for k in (0, 1):
        whens = " ".join([f"WHEN {code} = {c} THEN '{v[k]}'" for c, v in S.BASIC_TYPES.items()] + [f"WHEN {code} BETWEEN {100 * c} AND {100 * c + 99} THEN '{v[k]}'" for c, v in S.HUNDRED_TYPES.items()])
        out.append(f"CASE {whens} ELSE '{S.OTHER_TYPE[k]}' END")
    return out[0], out[1]


def color_sql(color: str, code: str, name: str) -> str:
    bare = f"upper(regexp_replace(trim({color}), '^#', ''))"
    regional = " OR ".join(f"contains(lower({name}), '{x}')" for x in S.REGIONAL_NAMES)
    whens = " ".join(f"WHEN ({type_sql(code)[0]}) = '{k}' THEN '{v}'" for k, v in S.CATEGORY_COLORS.items())
    return f"CASE WHEN regexp_full_match({bare}, '[0-9A-F]{{6}}') THEN '#' || {bare} WHEN ({type_sql(code)[0]}) = 'rail' AND ({regional}) THEN '{S.REGIONAL_COLOR}' {whens} ELSE '{S.OTHER_COLOR}' END"


@query(f"SELECT p.pattern_pk, p.route_id, {NAME_SQL} AS route_name, r.route_type, {color_sql('route_color', 'r.route_type', NAME_SQL)} AS color FROM t_patterns p JOIN t_routes r ON r.route_id = p.route_id AND r.agency = p.agency", ("t_patterns", "t_routes"))
def join_pattern_route(t):
    return timetable.pattern_meta(t("t_patterns"), t("t_routes")).select("pattern_pk", "route_id", "route_name", "route_type", "color")


_SERVICES = f"""
cal(d, agency, service_id) AS (
  SELECT 0, agency, service_id FROM t_calendar WHERE monday = 1 AND start_date <= '{TODAY[0]}' AND end_date >= '{TODAY[0]}'
  UNION SELECT 0, agency, service_id FROM t_calendar_dates WHERE date = '{TODAY[0]}' AND exception_type = 1
  UNION SELECT 1, agency, service_id FROM t_calendar WHERE tuesday = 1 AND start_date <= '{TOMORROW[0]}' AND end_date >= '{TOMORROW[0]}'
  UNION SELECT 1, agency, service_id FROM t_calendar_dates WHERE date = '{TOMORROW[0]}' AND exception_type = 1),
gone AS (SELECT CASE date WHEN '{TODAY[0]}' THEN 0 ELSE 1 END AS d, agency, service_id FROM t_calendar_dates WHERE date IN ('{TODAY[0]}', '{TOMORROW[0]}') AND exception_type = 2),
days AS (SELECT * FROM cal c WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.d = c.d AND g.agency = c.agency AND g.service_id = c.service_id)),
active AS (SELECT agency, service_id FROM days WHERE d = 1 UNION
           SELECT agency, service_id FROM days x WHERE d = 0 AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.d = 1 AND g.agency = x.agency AND g.service_id = x.service_id))"""


def _active(t) -> DataFrame:
    return timetable.active_services(t("t_calendar"), t("t_calendar_dates"), TODAY, TOMORROW)


@query(ctes(("t_calendar", "t_calendar_dates"), _SERVICES, "SELECT agency, service_id FROM active"))
def setop_active_services(t):
    return _active(t).select("agency", "service_id")


_TRIPS = _SERVICES + ", wanted AS (SELECT t.* FROM t_trips t JOIN active USING (agency, service_id))"


def _trips(t) -> DataFrame:
    return timetable.active_trips(t("t_trips"), t("t_patterns"), _active(t))


@query(ctes(("t_calendar", "t_calendar_dates", "t_trips"), _TRIPS, "SELECT trip_pk, pattern_pk, service_id FROM wanted"))
def join_active_trips(t):
    return _trips(t).select("trip_pk", "pattern_pk", "service_id")


_WINDOW = _TRIPS + f", seen AS (SELECT DISTINCT trip_pk FROM t_stop_times JOIN wanted USING (trip_pk) WHERE departure_sec BETWEEN {DEPART - 900} AND {DEPART + 9000})"
_WINDOW_VIEWS = ("t_calendar", "t_calendar_dates", "t_trips", "t_stop_times", "t_stops")


def _window(t) -> DataFrame:
    return timetable.window_trips(t("t_stop_times"), _trips(t), t("t_stops"), DEPART, 9000)


@query(ctes(_WINDOW_VIEWS, _WINDOW, "SELECT trip_pk FROM seen"))
def join_window_trips(t):
    return _window(t)


@query(ctes(_WINDOW_VIEWS, _WINDOW, "SELECT s.trip_pk, s.stop_sequence, s.stop_pk, s.arrival_sec, s.departure_sec, w.pattern_pk FROM t_stop_times s JOIN seen USING (trip_pk) JOIN wanted w USING (trip_pk)"))
def join_scoped_stop_times(t):
    return timetable.scoped_stop_times(t("t_stop_times"), _window(t), t("t_stops"), t("t_trips")).select("trip_pk", "stop_sequence", "stop_pk", "arrival_sec", "departure_sec", "pattern_pk")


@query(ctes(_WINDOW_VIEWS, _TRIPS + f", st AS (SELECT trip_pk, min(CASE WHEN departure_sec BETWEEN {DEPART - 900} AND {DEPART + 9000} THEN 0 WHEN departure_sec BETWEEN {DEPART - 900} AND {DEPART + 36000} THEN 1 ELSE 2 END) AS stage FROM t_stop_times JOIN wanted USING (trip_pk) WHERE departure_sec BETWEEN {DEPART - 900} AND {DEPART + 72000} GROUP BY trip_pk)", "SELECT CAST(stage AS INTEGER) AS stage, trip_pk FROM st WHERE stage = (SELECT min(stage) FROM st)"))
def load_window_stage(t):
    return timetable.window_stage(t("t_stop_times"), _trips(t), t("t_stops"), DEPART, 9000)


@query("SELECT p.pattern_pk, count(DISTINCT t.trip_pk) AS n_trips, count(*) AS n_rows FROM t_trips t JOIN t_patterns p USING (pattern_pk) JOIN t_stop_times s ON s.trip_pk = t.trip_pk GROUP BY 1", ("t_patterns", "t_trips", "t_stop_times"))
def load_full_network(t):
    return t("t_stop_times").join(t("t_trips").select("trip_pk", "pattern_pk"), "trip_pk").groupBy("pattern_pk").agg(F.count_distinct("trip_pk").alias("n_trips"), F.count("*").alias("n_rows"))


@query("SELECT DISTINCT pattern_pk FROM t_pattern_stops WHERE stop_pk IN (1, 2, 40)", ("t_pattern_stops",))
def join_patterns_for_stops(t):
    wanted = t("t_stops").where("stop_pk IN (1, 2, 40)").select(F.lit(1).alias("query_id"), "stop_pk")
    return corridor.patterns_of(wanted, t("t_pattern_stops")).select("pattern_pk")


@query("SELECT stop_pk, string_agg(DISTINCT route_id, ',' ORDER BY route_id) AS routes FROM t_pattern_stops JOIN t_patterns USING (pattern_pk) GROUP BY stop_pk", ("t_pattern_stops", "t_patterns"))
def join_routes_for_stops(t):
    rows = t("t_pattern_stops").join(t("t_patterns").select("pattern_pk", "route_id"), "pattern_pk")
    return rows.groupBy("stop_pk").agg(F.array_join(F.array_sort(F.collect_set("route_id")), ",").alias("routes"))


_BOARD = f"w AS (SELECT stop_pk, pattern_pk, CAST({DEPART} + stop_pk % 600 AS BIGINT) AS tau FROM t_pattern_stops), r AS (SELECT w.*, s.trip_pk, s.departure_sec, row_number() OVER (PARTITION BY w.stop_pk, w.pattern_pk ORDER BY s.departure_sec, s.trip_pk, s.stop_sequence) AS r FROM w JOIN t_trips t USING (pattern_pk) JOIN t_stop_times s ON s.trip_pk = t.trip_pk AND s.stop_pk = w.stop_pk WHERE s.departure_sec >= tau)"


@query(ctes(("t_pattern_stops", "t_trips", "t_stop_times"), _BOARD, "SELECT stop_pk, pattern_pk, trip_pk, departure_sec FROM r WHERE r = 1"))
def raptor_board(t):
    wanted = t("t_pattern_stops").select(F.lit(1).alias("key"), "stop_pk", "pattern_pk", (F.lit(DEPART) + F.col("stop_pk") % 600).alias("tau")).distinct()
    times = t("t_stop_times").join(t("t_trips").select("trip_pk", "pattern_pk"), "trip_pk")
    return timetable.next_departure(timetable.departure_index(times), wanted).select("stop_pk", "pattern_pk", "trip_pk", "departure_sec")


@query(ctes(("t_stops",), f"r AS (SELECT s.stop_pk, CAST(round({_H}) AS BIGINT) AS dist_m, row_number() OVER (ORDER BY {_H}, s.stop_pk) AS rank FROM t_stops s, t_stops o WHERE o.stop_pk = {FROM_PK})", "SELECT stop_pk, dist_m, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 50"))
def knn_stops(t):
    return corridor.ranked(_od(t).selectExpr("query_id", "o_lat AS at_lat", "o_lon AS at_lon"), t("t_stops"), 50).select("stop_pk", F.round("dist_m").cast("bigint").alias("dist_m"), "rank")


# --- the stop graph ------------------------------------------------------------------------

_RIDES = "rides AS (SELECT a.stop_pk AS src, b.stop_pk AS dst, min(a.pattern_pk) AS via_pattern FROM t_pattern_stops a JOIN t_pattern_stops b ON a.pattern_pk = b.pattern_pk AND a.stop_sequence < b.stop_sequence AND a.stop_pk <> b.stop_pk GROUP BY 1, 2)"
_A = haversine_sql("a.stop_lat / 1e6::DOUBLE", "a.stop_lon / 1e6::DOUBLE", "b.stop_lat / 1e6::DOUBLE", "b.stop_lon / 1e6::DOUBLE")
_WALKS = f"walks AS (SELECT a.stop_pk AS src, b.stop_pk AS dst, {_A} AS dist_m FROM t_stops a JOIN t_stops b ON a.stop_pk <> b.stop_pk AND abs(a.stop_lat - b.stop_lat) <= 16000 WHERE {_A} <= 1680)"
_EDGES = _RIDES + ", " + _WALKS + ", edges AS (SELECT src, dst, 'transit' AS kind, 1.0::DOUBLE AS cost, via_pattern FROM rides UNION ALL SELECT src, dst, 'walk', 0.5::DOUBLE, NULL FROM walks WHERE dist_m <= 450)"
_NET = ("t_stops", "t_pattern_stops")


@query(ctes(_NET, _RIDES, "SELECT src, dst, via_pattern FROM rides"))
def graph_transit_edges(t):
    return graph.ride_edges(t("t_pattern_stops")).select("src", "dst", "via_pattern")


@query(ctes(_NET, _WALKS, "SELECT src, dst, CAST(round(dist_m) AS BIGINT) AS dist_m FROM walks WHERE dist_m <= 450"))
def graph_walk_edges(t):
    return graph.near_pairs(t("t_stops"), graph.WALK_M, both=True, whole=True).select(F.col("a").alias("src"), F.col("b").alias("dst"), "dist_m")


@query(ctes(_NET, _WALKS, "SELECT src, dst, CAST(round(dist_m) AS BIGINT) AS dist_m FROM walks"))
def raptor_footpaths(t):
    return raptor.footpaths(t("t_stops"), raptor.Options(), whole=True)


@query(ctes(_NET, _EDGES, "SELECT * FROM edges"))
def graph_edges(t):
    return graph.edges(t("t_stops"), t("t_pattern_stops"))


@query(ctes(_NET, _RIDES, "SELECT src, count(*) AS n_out, min(via_pattern) AS first_pattern FROM rides GROUP BY src"))
def graph_edge_dedup(t):
    return graph.ride_edges(t("t_pattern_stops")).groupBy("src").agg(F.count("*").alias("n_out"), F.min("via_pattern").alias("first_pattern"))


_STRIDE = """p AS (SELECT pattern_pk, stop_pk, row_number() OVER (PARTITION BY pattern_pk ORDER BY stop_sequence, stop_pk) - 1 AS pos, count(*) OVER (PARTITION BY pattern_pk) AS n
 FROM (SELECT trip_pk % 5 AS pattern_pk, trip_pk AS stop_sequence, trip_pk AS stop_pk FROM t_trips) s)"""


@query(ctes(("t_trips",), _STRIDE, "SELECT a.stop_pk AS src, b.stop_pk AS dst, min(a.pattern_pk) AS via_pattern FROM p a JOIN p b ON a.pattern_pk = b.pattern_pk AND a.pos < b.pos AND a.stop_pk <> b.stop_pk WHERE b.n <= 60 OR b.pos = b.n - 1 OR b.pos % greatest(b.n // 40, 1) = 0 GROUP BY 1, 2"))
def graph_stride_edges(t):
    long = t("t_trips").select((F.col("trip_pk") % 5).alias("pattern_pk"), F.col("trip_pk").alias("stop_sequence"), F.col("trip_pk").alias("stop_pk"))
    return graph.ride_edges(long).select("src", "dst", "via_pattern")


@query(ctes(_NET, _RIDES, "SELECT src AS stop_pk, string_agg(concat(dst, chr(31), 'transit', chr(31), via_pattern), chr(30) ORDER BY dst) AS edges FROM rides GROUP BY src"))
def graph_pack_edges(t):
    return graph.pack(graph.ride_edges(t("t_pattern_stops")))


@query(ctes(_NET, _EDGES, "SELECT * FROM edges"))
def graph_unpack_edges(t):
    return graph.unpack(graph.packed(t("t_stops"), t("t_pattern_stops")))


@query("SELECT concat('2:', (SELECT count(*) FROM t_stops), ':', (SELECT count(*) FROM t_pattern_stops)) AS signature", _NET)
def graph_signature(t):
    return graph.signature(t("t_stops"), t("t_pattern_stops")).select("signature")


# --- aggregates ----------------------------------------------------------------------------


@query("SELECT count(*) AS n_stops FROM t_stops", ("t_stops",))
def agg_count(t):
    return t("t_stops").agg(F.count("*").alias("n_stops"))


@query("SELECT coalesce(max(trip_pk), 0) + 1 AS next_pk FROM t_trips", ("t_trips",))
def agg_next_pk(t):
    return etl.next_pk(t("t_trips"), "trip_pk")


@query("SELECT DISTINCT pattern_pk, service_id FROM t_trips", ("t_trips",))
def agg_distinct(t):
    return t("t_trips").select("pattern_pk", "service_id").distinct()


@query("SELECT stop_pk, CAST(floor(departure_sec / 3600.0) AS BIGINT) AS hour, string_agg(concat(departure_sec, '/', trip_pk, '/', stop_sequence), ' ' ORDER BY departure_sec, trip_pk, stop_sequence) AS board FROM t_stop_times GROUP BY 1, 2", ("t_stop_times",))
def agg_departure_board(t):
    board = timetable.departure_board(t("t_stop_times"))
    return board.select("stop_pk", "hour", F.array_join(F.transform("departures", lambda d: F.concat_ws("/", d["departure_sec"].cast("string"), d["trip_pk"].cast("string"), d["stop_sequence"].cast("string"))), " ").alias("board"))


@query("SELECT stop_pk, trip_pk, count(*) AS n_visits, max(stop_sequence) AS last_seq FROM t_stop_times GROUP BY 1, 2", ("t_stop_times",))
def agg_stop_trip_index(t):
    # nearly every row is a group of its own: grouped behind the shuffle, not in the tasks of a scan of few large files
    rows = t("t_stop_times").select("stop_pk", "trip_pk", "stop_sequence")
    rows = rows.repartition(parts_for(rows.sparkSession, rows.count()), "stop_pk", "trip_pk")
    return rows.groupBy("stop_pk", "trip_pk").agg(F.count("*").alias("n_visits"), F.max("stop_sequence").alias("last_seq"))


# --- import --------------------------------------------------------------------------------


@query("SELECT o_custkey, o_orderkey AS first_order FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1")
def sink_insert_or_ignore(t):
    return etl.first_wins(t("orders"), ["o_custkey"], "o_orderkey").select("o_custkey", F.col("o_orderkey").alias("first_order"))


def _raw_stops(t) -> DataFrame:
    k = F.col("c_custkey")
    lat = F.when(k % 11 == 0, "n/a").otherwise(F.concat(F.lit("-37."), F.lpad((k % 100000).cast("string"), 5, "0")))
    return t("customer").select(F.lit(1).cast("bigint").alias("agency"), k.alias("_ord"), F.concat(F.lit("S"), (k % 700).cast("string")).alias("stop_id"), F.col("c_name").alias("stop_name"), lat.alias("stop_lat"), F.lit("144.5x").alias("stop_lon"), F.when(k % 5 == 0, "1").when(k % 3 == 0, "0").otherwise("").alias("location_type"))


@query("""WITH raw AS (SELECT c_custkey AS ord, concat('S', c_custkey % 700) AS stop_id, c_name AS stop_name, concat('-37.', lpad((c_custkey % 100000)::VARCHAR, 5, '0'))::DOUBLE AS lat FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 5 <> 0),
one AS (SELECT *, row_number() OVER (PARTITION BY stop_id ORDER BY ord) AS r FROM raw)
SELECT CAST(row_number() OVER (ORDER BY ord) AS BIGINT) AS stop_pk, stop_id, stop_name, CAST(floor(lat * 1e6 + 0.5) AS BIGINT) AS stop_lat, CAST(144500000 AS BIGINT) AS stop_lon, CAST(1 AS BIGINT) AS agency FROM one WHERE r = 1""")
def etl_stops(t):
    return etl.stops(_raw_stops(t))


@query("SELECT route_id, route_short_name, route_long_name, route_type, CASE WHEN regexp_full_match(upper(regexp_replace(route_color, '^#', '')), '[0-9A-F]{6}') THEN '#' || upper(regexp_replace(route_color, '^#', '')) ELSE '' END AS route_color, '#FFFFFF' AS route_text_color, agency FROM t_routes", ("t_routes",))
def etl_routes(t):
    raw = t("t_routes").withColumns({"route_type": F.concat(F.col("route_type").cast("string"), F.lit(" x")), "route_text_color": F.lit(""), "_ord": F.lit(0)})
    return etl.routes(raw)


@query("SELECT service_id, agency, sunday, monday, tuesday, wednesday, thursday, friday, saturday, start_date, end_date FROM t_calendar", ("t_calendar",))
def etl_calendar(t):
    raw = t("t_calendar").withColumns({d: F.col(d).cast("string") for d in S.WEEKDAYS} | {"_ord": F.lit(0)})
    return etl.calendar(raw.union(raw.withColumns({"sunday": F.lit("9"), "_ord": F.lit(1)})))


@query("SELECT service_id, agency, date, exception_type FROM t_calendar_dates", ("t_calendar_dates",))
def etl_calendar_dates(t):
    raw = t("t_calendar_dates").withColumns({"exception_type": F.when(F.col("exception_type") == 2, "2"), "_ord": F.lit(0)})
    return etl.calendar_dates(raw)


def _raw_trips(t) -> DataFrame:
    k = F.col("o_orderkey")
    return t("orders").select(F.lit(1).cast("bigint").alias("agency"), k.alias("_ord"), F.concat(F.lit("T"), (k % 9973).cast("string")).alias("trip_id"), F.concat(F.lit("R"), (F.col("o_custkey") % 60).cast("string")).alias("route_id"), F.when(k % 2 == 0, "").otherwise("1").alias("direction_id"), F.when(k % 3 == 0, "").otherwise("sh").alias("shape_id"), F.col("o_orderpriority").alias("service_id"))


@query("""WITH raw AS (SELECT *, concat('T', o_orderkey % 9973) AS trip_id, row_number() OVER (ORDER BY o_orderkey) AS pk FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY o_orderkey DESC) AS r, min(o_orderkey) OVER (PARTITION BY trip_id) AS first_at FROM raw)
SELECT CAST(pk AS BIGINT) AS trip_pk, trip_id, concat('R', o_custkey % 60) AS route_id, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END AS BIGINT) AS direction_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'sh' END AS shape_id, o_orderpriority AS service_id, first_at FROM r WHERE r = 1""")
def etl_trips(t):
    return etl.trips(_raw_trips(t)).select("trip_pk", "trip_id", "route_id", "direction_id", "shape_id", "service_id", F.col("_ord").alias("first_at"))


def _raw_times(t) -> DataFrame:
    k = F.col("trip_pk")
    clock = F.concat_ws(":", F.floor(F.col("arrival_sec") / 3600).cast("string"), F.floor(F.col("arrival_sec") % 3600 / 60).cast("string"), (F.col("arrival_sec") % 60).cast("string"))
    return t("t_stop_times").select(F.lit(1).cast("bigint").alias("agency"), F.concat(F.lit("T"), (k - 1).cast("string")).alias("trip_id"), F.concat(F.lit("S:"), (F.col("stop_pk") - 1).cast("string")).alias("stop_id"), F.col("stop_sequence").cast("string").alias("stop_sequence"), clock.alias("arrival_time"), F.when(k % 4 == 0, "").otherwise(clock).alias("departure_time"), F.lit(0).alias("_ord"))


@query("SELECT t.trip_pk, s.stop_sequence, s.stop_pk, s.arrival_sec, s.arrival_sec AS departure_sec FROM t_stop_times s JOIN t_trips t USING (trip_pk) WHERE trip_pk % 7 <> 0 AND stop_pk % 5 <> 0", ("t_stop_times", "t_trips"))
def etl_stop_times(t):
    return etl.stop_times(_raw_times(t), t("t_trips").where("trip_pk % 7 <> 0"), t("t_stops").where("stop_pk % 5 <> 0")).drop("_ord")


@query("SELECT CASE WHEN trip_pk % 7 = 0 THEN 'unknown_trip' ELSE 'unknown_stop' END AS reason, count(*) AS n_rows FROM t_stop_times WHERE (trip_pk % 7 = 0 OR stop_pk % 5 = 0) GROUP BY 1", ("t_stop_times",))
def etl_stop_times_rejects(t):
    return etl.stop_time_rejects(_raw_times(t), t("t_trips").where("trip_pk % 7 <> 0"), t("t_stops").where("stop_pk % 5 <> 0"))


_SEQ = "seqs AS (SELECT trip_pk, string_agg(stop_pk::VARCHAR, ',' ORDER BY stop_sequence) AS stops FROM t_raw_stop_times GROUP BY trip_pk)"
_PAT = _SEQ + """, each AS (SELECT s.trip_pk, s.stops, t.trip_pk % 60 AS route, t.trip_pk % 2 AS dir FROM seqs s JOIN t_trips t USING (trip_pk)),
g AS (SELECT route, dir, stops, min(trip_pk) AS rep, count(*) AS n_trips FROM each GROUP BY 1, 2, 3),
pats AS (SELECT *, CAST(row_number() OVER (ORDER BY rep) AS BIGINT) AS pattern_pk FROM g)"""
_RAW = ("t_raw_stop_times", "t_trips")


def _trip_rows(t) -> DataFrame:
    k = F.col("trip_pk")
    return t("t_trips").select("trip_pk", "trip_id", "agency", (k % 60).alias("route_id"), (k % 2).alias("direction_id"), F.lit(None).cast("string").alias("shape_id"), "service_id", k.alias("_ord"))


def _patterns(t) -> DataFrame:
    return etl.patterns(t("t_raw_stop_times"), _trip_rows(t))


@query(ctes(_RAW, _SEQ, "SELECT trip_pk, stops FROM seqs"))
def etl_trip_sequences(t):
    return etl.sequences(t("t_raw_stop_times")).select("trip_pk", F.array_join("stops", ",").alias("stops"))


@query(ctes(_RAW, _PAT, "SELECT pattern_pk, route AS route_id, dir AS direction_id, rep AS trip_pk, n_trips, stops FROM pats"))
def etl_pattern_synthesis(t):
    return _patterns(t).select("pattern_pk", "route_id", "direction_id", "trip_pk", "n_trips", F.array_join("stops", ",").alias("stops"))


@query(ctes(_RAW, _PAT, "SELECT e.trip_pk, p.pattern_pk FROM each e JOIN pats p USING (route, dir, stops)"))
def etl_trip_pattern(t):
    return etl.trip_patterns(t("t_raw_stop_times"), _trip_rows(t), _patterns(t)).select("trip_pk", "pattern_pk")


@query(ctes(_RAW, _PAT, "SELECT p.pattern_pk, r.stop_pk, r.stop_sequence FROM pats p JOIN t_raw_stop_times r ON r.trip_pk = p.rep"))
def etl_pattern_stops(t):
    return etl.pattern_stops(_patterns(t))


@query(ctes(("t_shapes",), "r AS (SELECT *, row_number() OVER (PARTITION BY shape_pk ORDER BY shape_pt_sequence) - 1 AS r FROM t_shapes)", "SELECT shape_pk, shape_pt_lat, shape_pt_lon, shape_pt_sequence FROM r WHERE r % 3 = 0"))
def etl_shape_decimate(t):
    return etl.decimate(t("t_shapes"), "shape_pk", "shape_pt_sequence")


@query("""WITH raw AS (SELECT 1 + c_custkey % 3 AS agency, c_custkey AS ord, concat('S', c_custkey % 50) AS stop_id FROM customer),
one AS (SELECT *, row_number() OVER (PARTITION BY agency, stop_id ORDER BY ord) AS r FROM raw)
SELECT CAST(row_number() OVER (ORDER BY agency, ord) AS BIGINT) AS stop_pk, stop_id, CAST(agency AS BIGINT) AS agency FROM one WHERE r = 1""")
def etl_multi_feed(t):
    raw = t("customer").select((F.col("c_custkey") % 3 + 1).alias("agency"), F.col("c_custkey").alias("_ord"), F.concat(F.lit("S"), (F.col("c_custkey") % 50).cast("string")).alias("stop_id"), F.lit("x").alias("stop_name"), F.lit("1").alias("stop_lat"), F.lit("2").alias("stop_lon"), F.lit("").alias("location_type"))
    return etl.stops(raw).select("stop_pk", "stop_id", "agency")


# --- scalar functions ----------------------------------------------------------------------

def scalar(views: tuple[str, ...], base: str, sql: str):
    """Register a query that selects columns made by scalar functions from one table."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: adapter.view(spark, sf_dir, base).select(*f())
        SQL[f.__name__] = (adapter.with_views(*views) + "\n" if views else "") + f"SELECT {sql} FROM {base}"
        return f

    return register


_ST = (("t_stop_times",), "t_stop_times")
_SP = (("t_stops",), "t_stops")
_RT = (("t_routes",), "t_routes")


@scalar(*_SP, f"stop_pk, CAST(round({haversine_sql('-37.8', '144.9', 'stop_lat / 1e6::DOUBLE', 'stop_lon / 1e6::DOUBLE')}) AS BIGINT) AS dist_m")
def fn_haversine():
    return ["stop_pk", F.round(S.haversine_m(F.lit(-37.8), F.lit(144.9), S.unpack_coord(F.col("stop_lat")), S.unpack_coord(F.col("stop_lon")))).cast("bigint").alias("dist_m")]


@scalar(*_SP, "stop_pk, CAST(floor((stop_lat / 1e6::DOUBLE) * 1e6 + 0.5) AS BIGINT) AS packed, CAST(floor((-2.5)::DOUBLE + 0.5) AS BIGINT) AS half")
def fn_pack_coord():
    return ["stop_pk", S.pack_coord((F.col("stop_lat") / 1e6).cast("string")).alias("packed"), S.half_up(F.lit(-2.5)).alias("half")]


@scalar(*_ST, "trip_pk, stop_sequence, arrival_sec AS parsed, CAST(0 AS BIGINT) AS blank")
def fn_parse_time():
    s = F.col("arrival_sec")
    clock = F.concat_ws(":", F.floor(s / 3600).cast("string"), F.floor(s % 3600 / 60).cast("string"), (s % 60).cast("string"))
    return ["trip_pk", "stop_sequence", S.parse_time(clock).alias("parsed"), S.parse_time(F.lit(" ")).alias("blank")]


@scalar(*_RT, "route_id, CAST(regexp_extract(concat(' ', route_type, 'px'), '^\\s*([+-]?[0-9]+)', 1) AS BIGINT) AS n, CAST(NULL AS BIGINT) AS none")
def fn_parse_int():
    return ["route_id", S.parse_int(F.concat(F.lit(" "), F.col("route_type").cast("string"), F.lit("px"))).alias("n"), S.parse_int(F.lit("x1")).alias("none")]


@scalar(*_ST, "trip_pk, stop_sequence, concat(lpad(((departure_sec // 3600) % 24)::VARCHAR, 2, '0'), ':', lpad(((departure_sec % 3600) // 60)::VARCHAR, 2, '0')) AS hhmm")
def fn_format_hhmm():
    return ["trip_pk", "stop_sequence", S.format_hhmm(F.col("departure_sec")).alias("hhmm")]


@scalar(*_ST, "trip_pk, stop_sequence, concat(lpad(((departure_sec // 3600) % 24)::VARCHAR, 2, '0'), ':', lpad(((departure_sec % 3600) // 60)::VARCHAR, 2, '0'), ':', lpad((departure_sec % 60)::VARCHAR, 2, '0')) AS hhmmss")
def fn_format_hhmmss():
    return ["trip_pk", "stop_sequence", S.format_hhmmss(F.col("departure_sec")).alias("hhmmss")]


@scalar(*_RT, "route_id, CASE WHEN regexp_full_match(upper(regexp_replace(route_color, '^#', '')), '[0-9A-F]{6}') THEN '#' || upper(regexp_replace(route_color, '^#', '')) ELSE '' END AS color")
def fn_hex_color():
    return ["route_id", S.hex_color(F.col("route_color")).alias("color")]


@scalar(*_RT, f"route_id, {type_sql('route_type')[0]} AS category, {type_sql('route_type')[1]} AS label")
def fn_route_type():
    kind = S.route_type(F.col("route_type"))
    return ["route_id", kind["category"].alias("category"), kind["label"].alias("label")]


@scalar(*_RT, f"route_id, {color_sql('route_color', 'route_type', 'route_long_name')} AS color")
def fn_route_color():
    return ["route_id", S.route_color(F.col("route_color"), F.col("route_type"), F.col("route_long_name")).alias("color")]


@scalar(*_RT, "route_id, CASE WHEN regexp_matches(upper(regexp_replace(trim(route_color), '^#', '')), '^[0-9A-F]{6}$') THEN concat('#', upper(regexp_replace(trim(route_color), '^#', ''))) ELSE '#FFFFFF' END AS text_color")
def fn_text_color():
    return ["route_id", S.text_color(F.col("route_color")).alias("text_color")]


@scalar(*_RT, f"route_id, {NAME_SQL} AS route_name")
def fn_route_name():
    return ["route_id", S.route_name(F.col("route_short_name"), F.col("route_long_name")).alias("route_name")]


@scalar(*_RT, "concat(agency, ':', route_id) AS key, agency AS key_agency, route_id AS key_id")
def fn_key_roundtrip():
    key = S.make_key(F.col("agency"), F.col("route_id"))
    return [key.alias("key"), S.parse_key(key)["agency"].alias("key_agency"), S.parse_key(key)["id"].alias("key_id")]


@scalar((), "orders", "o_orderkey, strftime(o_orderdate, '%Y%m%d') AS day, CAST(dayofweek(o_orderdate) AS BIGINT) AS dow")
def fn_service_day():
    return ["o_orderkey", S.service_date(F.col("o_orderdate")).alias("day"), S.weekday(F.col("o_orderdate")).alias("dow")]


@scalar((), "events", "event_id, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) AS secs")
def fn_secs_midnight():
    return ["event_id", S.secs_midnight(F.col("ts")).alias("secs")]


@scalar(*_SP, "stop_pk, CAST(round((stop_pk % 2000) / 1.4::DOUBLE) AS BIGINT) AS walk_sec, CAST(round(1.4::DOUBLE * 1200) AS BIGINT) AS radius_m")
def fn_walk():
    return ["stop_pk", F.round(S.walk_sec((F.col("stop_pk") % 2000).cast("double"), F.lit(1.4))).cast("bigint").alias("walk_sec"), F.lit(round(raptor.Options().transfer_m)).cast("bigint").alias("radius_m")]


@scalar(*_SP, "stop_pk, CAST(least(18000, greatest(9000, (stop_pk % 200) * 150 + 2700)) AS BIGINT) AS window_sec")
def fn_window():
    return ["stop_pk", S.window_sec((F.col("stop_pk") % 200).cast("double")).cast("bigint").alias("window_sec")]


@scalar(*_SP, "stop_pk, CAST(floor((stop_lat / 1e6::DOUBLE) / 0.006::DOUBLE) AS BIGINT) AS y, CAST(floor((stop_lon / 1e6::DOUBLE) / 0.006::DOUBLE) AS BIGINT) AS x")
def fn_grid_cell():
    return ["stop_pk", S.grid_cell(S.unpack_coord(F.col("stop_lat"))).alias("y"), S.grid_cell(S.unpack_coord(F.col("stop_lon"))).alias("x")]


_SEG = """bx AS (SELECT stop_pk, 0.05::DOUBLE * 111320 * cos(radians((-37.9)::DOUBLE)) AS bx, 0.08::DOUBLE * 111320 AS up, (stop_lon / 1e6::DOUBLE - 144.9) * 111320 * cos(radians((-37.9)::DOUBLE)) AS px, (stop_lat / 1e6::DOUBLE + 37.9) * 111320 AS py FROM t_stops),
tt AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (px * bx + py * up) / (bx * bx + up * up))) AS t FROM bx)"""


@query(ctes(("t_stops",), _SEG, "SELECT stop_pk, CAST(round(sqrt(pow(px - t * bx, 2) + pow(py - t * up, 2))) AS BIGINT) AS dist_m, CAST(round(t * 1000000) AS BIGINT) AS t_micro FROM tt"))
def fn_dist_segment(t):
    p = corridor.points(t("t_stops"))
    d = S.segment_distance(F.col("lat"), F.col("lon"), F.lit(-37.9), F.lit(144.9), F.lit(-37.9) + 0.08, F.lit(144.9) + 0.05)
    return p.select("stop_pk", F.round(d["dist_m"]).cast("bigint").alias("dist_m"), F.round(d["t"] * 1e6).cast("bigint").alias("t_micro"))


@scalar(*_SP, "stop_pk, CAST(round((350 + 900 * sin(pi() * ((stop_pk % 101) / 100.0::DOUBLE))) * 1000) AS BIGINT) AS width_mm")
def fn_taper():
    return ["stop_pk", F.round(S.taper_width((F.col("stop_pk") % 101) / 100, corridor.WIDTH_M, corridor.TAPER_M) * 1000).cast("bigint").alias("width_mm")]


@scalar(*_SP, "stop_pk, CASE WHEN stop_pk % 5 = 0 THEN stop_name ELSE concat(stop_name, ' → ', stop_id, ' (~', greatest(1, CAST(floor((stop_pk * 7 % 3000) / 1.4::DOUBLE / 60 + 0.5) AS BIGINT)), ' min walk)') END AS label")
def fn_transfer_label():
    to = F.when(F.col("stop_pk") % 5 == 0, F.col("stop_name")).otherwise(F.col("stop_id"))
    return ["stop_pk", S.transfer_label(F.col("stop_name"), to, (F.col("stop_pk") * 7 % 3000).cast("double"), F.lit(1.4)).alias("label")]


@scalar(*_SP, "stop_pk, CASE WHEN stop_pk >= 60 THEN printf('%.1fm', ((stop_pk * 10 + 30) // 60) / 10.0::DOUBLE) ELSE printf('%.1fs', stop_pk::DOUBLE) END AS took, printf('%.1f MB', floor(stop_pk * 262144 / 1048576.0::DOUBLE * 10 + 0.5) / 10) AS size, regexp_replace(concat('file:///', stop_id), '^file://', '') AS path")
def fn_pretty():
    return ["stop_pk", S.duration_text(F.col("stop_pk")).alias("took"), S.size_text(F.col("stop_pk") * 262144).alias("size"), S.strip_scheme(F.concat(F.lit("file:///"), F.col("stop_id"))).alias("path")]


@query("""SELECT stop_pk, CAST(0 AS INTEGER) AS pos, stop_id AS place_id, CASE WHEN stop_pk % 3 = 0 THEN 'Unknown' ELSE stop_name END AS name, CASE WHEN stop_pk % 2 = 0 THEN '' ELSE stop_id END AS address, CASE WHEN stop_pk % 5 = 0 THEN 0.0::DOUBLE ELSE stop_lat / 4::DOUBLE END AS latitude, CASE WHEN stop_pk % 5 = 0 THEN 0.0::DOUBLE ELSE stop_lon / 4::DOUBLE END AS longitude FROM t_stops WHERE stop_pk % 7 <> 0
UNION ALL SELECT stop_pk, CAST(1 AS INTEGER), stop_id, 'Unknown', '', 0.0::DOUBLE, 0.0::DOUBLE FROM t_stops WHERE stop_pk % 7 <> 0""", ("t_stops",))
def src_places(t):
    """Answers of a place search, one for each stop, some without places and places without fields."""
    pk = F.col("stop_pk")
    spot = F.struct((F.col("stop_lat") / 4).alias("latitude"), (F.col("stop_lon") / 4).alias("longitude"))
    full = F.struct(F.col("stop_id").alias("id"), F.when(pk % 3 != 0, F.struct(F.col("stop_name").alias("text"))).alias("displayName"), F.when(pk % 2 != 0, F.col("stop_id")).alias("formattedAddress"), F.when(pk % 5 != 0, spot).alias("location"))
    bare = F.struct(F.col("stop_id").alias("id"), F.lit(None).cast("struct<text:string>").alias("displayName"), F.lit(None).cast("string").alias("formattedAddress"), F.lit(None).cast("struct<latitude:double,longitude:double>").alias("location"))
    answer = F.when(pk % 7 == 0, "{}").otherwise(F.to_json(F.struct(F.array(full, bare).alias("places"))))
    return places.places(t("t_stops").select("stop_pk", answer.alias("answer")))


@scalar(*_SP, "stop_pk, printf('%.4f,%.4f->%.4f,%.4f|5', floor(stop_lat / 1e6::DOUBLE * 1e4 + 0.5) / 1e4, floor(stop_lon / 1e6::DOUBLE * 1e4 + 0.5) / 1e4, -37.8::DOUBLE, 144.9::DOUBLE) AS key")
def fn_cache_key():
    return ["stop_pk", S.cache_key(S.unpack_coord(F.col("stop_lat")), S.unpack_coord(F.col("stop_lon")), F.lit(-37.8), F.lit(144.9), corridor.TRANSFERS).alias("key")]


@scalar(*_SP, "stop_pk, concat('Walk (~', greatest(1, CAST(floor((stop_pk * 7 % 3000) / 1.4::DOUBLE / 60 + 0.5) AS BIGINT)), ' min)') AS label")
def fn_walk_label():
    return ["stop_pk", S.walk_label((F.col("stop_pk") * 7 % 3000).cast("double"), F.lit(1.4)).alias("label")]


@scalar(*_SP, "stop_pk, printf('%.6f,%.6f', stop_lat / 1e6::DOUBLE, stop_lon / 1e6::DOUBLE) AS key")
def fn_point_key():
    return ["stop_pk", S.point_key(S.unpack_coord(F.col("stop_lat")), S.unpack_coord(F.col("stop_lon"))).alias("key")]


@query("SELECT pattern_pk, (list(stop_pk ORDER BY stop_sequence))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS middle FROM t_pattern_stops GROUP BY pattern_pk", ("t_pattern_stops",))
def fn_midpoint(t):
    lists = t("t_pattern_stops").groupBy("pattern_pk").agg(F.array_sort(F.collect_list(F.struct("stop_sequence", "stop_pk"))).alias("s"))
    return lists.select("pattern_pk", S.midpoint(F.col("s.stop_pk")).alias("middle"))


@scalar((), "orders", "o_orderkey, CAST((((o_orderkey % 200) - 100) % 60 + 60) % 60 AS BIGINT) AS minute, CAST((((o_orderkey % 100) - 50) % 24 + 24) % 24 AS BIGINT) AS hour, CASE datediff('day', DATE '1998-06-08', o_orderdate::DATE) WHEN 0 THEN 'Today' WHEN 1 THEN 'Tomorrow' ELSE 'later' END AS day")
def fn_clamp_clock():
    k = F.col("o_orderkey")
    label = S.day_label(F.to_date("o_orderdate"), F.lit("1998-06-08").cast("date"))
    return ["o_orderkey", S.clamp_minutes(k % 200 - 100).alias("minute"), S.clamp_hours(k % 100 - 50).alias("hour"), F.when(label.isin("Today", "Tomorrow"), label).otherwise("later").alias("day")]


# --- seeds, breadth-first levels and corridors ---------------------------------------------

_NEAR = f"near AS (SELECT s.stop_pk, {_H} AS d, row_number() OVER (ORDER BY {_H}, s.stop_pk) AS rank FROM t_stops s, t_stops o WHERE o.stop_pk = {FROM_PK})"
_SEEDS = _NEAR + """, inside AS (SELECT * FROM near WHERE rank <= 120 AND CASE WHEN (SELECT count(*) FROM near WHERE rank <= 120 AND d <= 1000) < 4 THEN rank <= 4 ELSE d <= 1000 END),
routed AS (SELECT i.stop_pk, i.rank, r.route FROM inside i LEFT JOIN (SELECT DISTINCT stop_pk, route_id AS route FROM t_pattern_stops JOIN t_patterns USING (pattern_pk)) r USING (stop_pk)),
flags AS (SELECT stop_pk, rank, max(CASE WHEN route IS NULL OR rank = first THEN 1 ELSE 0 END) AS fresh FROM (SELECT *, min(rank) OVER (PARTITION BY route) AS first FROM routed) x GROUP BY 1, 2),
turns AS (SELECT *, row_number() OVER (ORDER BY fresh DESC, rank) AS turn, sum(fresh) OVER () AS n FROM flags)"""
_SEED_VIEWS = ("t_stops", "t_pattern_stops", "t_patterns")


def _stop_routes(t) -> DataFrame:
    return t("t_pattern_stops").join(t("t_patterns").select("pattern_pk", "route_id"), "pattern_pk").select("stop_pk", F.col("route_id").alias("route")).distinct()


@query(ctes(_SEED_VIEWS, _SEEDS, "SELECT stop_pk, CAST(rank AS INTEGER) AS rank FROM turns WHERE turn <= 40 AND turn <= greatest(n, 4)"))
def seed_select(t):
    return corridor.seeds(_od(t).selectExpr("query_id", "o_lat AS at_lat", "o_lon AS at_lon"), t("t_stops"), _stop_routes(t)).select("stop_pk", "rank")


def _bfs_sql(levels: int) -> str:
    """Levels 0 to `levels`: l<i> is what rides reach, w<i> what walks add, b<i> both, a<i> all so far. A level is boarded
    from if no level more than MARGIN before it holds the destination."""
    out = [f"l0(v) AS (SELECT {FROM_PK}::BIGINT)"]
    for i in range(levels + 1):
        if i:
            on = "".join(f" AND NOT EXISTS (SELECT 1 FROM b{j} WHERE v = {TO_PK})" for j in range(i - 1 - corridor.MARGIN))
            out.append(f"l{i}(v) AS (SELECT DISTINCT dst FROM tr JOIN b{i - 1} ON src = v WHERE dst NOT IN (SELECT v FROM a{i - 1}){on})")
        before = f"(SELECT v FROM a{i - 1} UNION SELECT v FROM l{i})" if i else "(SELECT v FROM l0)"
        out.append(f"w{i}(v) AS (SELECT DISTINCT dst FROM wk JOIN l{i} ON src = v WHERE dst NOT IN {before}{walked(i)})")
        out.append(f"b{i} AS (SELECT v FROM l{i} UNION SELECT v FROM w{i})")
        out.append(f"a{i} AS (SELECT v FROM b{i}{f' UNION SELECT v FROM a{i - 1}' if i else ''})")
    out.append("lv AS (" + " UNION ALL ".join(f"SELECT v, {i} AS level FROM b{i}" for i in range(levels + 1)) + ")")
    return ", ".join(out)


def walked(level: int) -> str:
    """No level is walked from after the last, or more than MARGIN levels after the first hit."""
    if level > corridor.TRANSFERS:
        return " AND false"
    return "".join(f" AND NOT EXISTS (SELECT 1 FROM b{j} WHERE v = {TO_PK})" for j in range(level - corridor.MARGIN))


_DEPTH = corridor.TRANSFERS + 1
_BFS = _EDGES + ", tr AS (SELECT src, dst FROM edges WHERE kind = 'transit'), wk AS (SELECT src, dst FROM edges WHERE kind = 'walk'), " + _bfs_sql(_DEPTH)
_TREE = " UNION ".join([f"SELECT src AS parent, dst AS child, {i} AS level FROM wk JOIN l{i} ON src = v WHERE dst IN (SELECT v FROM b{i}) AND src <> dst{walked(i)}" for i in range(_DEPTH + 1)] + [f"SELECT src, dst, {i} FROM tr JOIN b{i - 1} ON src = v WHERE dst IN (SELECT v FROM l{i})" for i in range(1, _DEPTH + 1)])


def _levels(t, transfers: int = corridor.TRANSFERS):
    one = t("t_stops").select(F.lit(1).alias("query_id"), "stop_pk")
    return corridor.levels(graph.ride_edges(t("t_pattern_stops")), one.where(F.col("stop_pk") == FROM_PK), one.where(F.col("stop_pk") == TO_PK), transfers, t("t_stops"))


@query(ctes(_NET, _BFS, "SELECT v AS stop_pk, level FROM lv"))
def bfs_levels(t):
    return _levels(t)[0].select("stop_pk", "level")


@query(ctes(_NET, _BFS, _TREE))
def bfs_tree_edges(t):
    return _levels(t)[1].select("parent", "child", "level").distinct()


@query(ctes(_NET, _BFS, f"SELECT CAST(min(level) AS INTEGER) AS first_hit FROM lv WHERE v = {TO_PK} HAVING min(level) IS NOT NULL"))
def bfs_first_hit(t):
    return _levels(t)[2].select("first_hit")


def _paths(t) -> tuple[DataFrame, DataFrame]:
    """The seed paths and the levels that they were found on."""
    one = t("t_stops").select(F.lit(1).alias("query_id"), "stop_pk")
    origins, ends = one.where(F.col("stop_pk") == FROM_PK), one.where(F.col("stop_pk") == TO_PK)
    found, tree, hits = _levels(t)
    return corridor.paths(found, tree, hits, origins, ends), found


@query()
def bfs_paths(t):
    return _paths(t)[0].select("path_no", F.array_join("path", ">").alias("path"))


_PATH = "line AS (SELECT p.pos, s.stop_lat / 1e6::DOUBLE AS lat, s.stop_lon / 1e6::DOUBLE AS lon FROM (VALUES (0, 1), (1, 77), (2, 40)) p(pos, pk) JOIN t_stops s ON s.stop_pk = p.pk), seg0 AS (SELECT pos, lat AS a_lat, lon AS a_lon, lead(lat) OVER (ORDER BY pos) AS b_lat, lead(lon) OVER (ORDER BY pos) AS b_lon FROM line), seg1 AS (SELECT *, " + haversine_sql("a_lat", "a_lon", "b_lat", "b_lon") + " AS len FROM seg0 WHERE b_lat IS NOT NULL), seg AS (SELECT *, coalesce(sum(len) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef, sum(len) OVER () AS total FROM seg1)"


def _path(t) -> DataFrame:
    return t("t_stops").limit(1).select(F.lit(1).alias("query_id"), F.lit(1).alias("path_no"), F.array(*[F.lit(x).cast("bigint") for x in (1, 77, 40)]).alias("path"))


@query(ctes(("t_stops",), _PATH, "SELECT pos, CAST(round(len) AS BIGINT) AS length_m FROM seg"))
def path_segments(t):
    return corridor.segments(corridor.polylines(_path(t), t("t_stops"))).select("pos", F.round("length_m").cast("bigint").alias("length_m"))


@query(ctes(("t_stops",), _PATH, "SELECT pos, CAST(round(bef) AS BIGINT) AS before_m, CAST(round(total) AS BIGINT) AS total_m FROM seg"))
def corridor_arc_length(t):
    return corridor.segments(corridor.polylines(_path(t), t("t_stops"))).select("pos", F.round("before_m").cast("bigint").alias("before_m"), F.round("total_m").cast("bigint").alias("total_m"))


def tag_sql(width: float, taper: float) -> str:
    return f""", xy AS (SELECT s.stop_pk, g.*, (b_lon - a_lon) * 111320 * cos(radians(a_lat)) AS bx, (b_lat - a_lat) * 111320 AS ey, (s.stop_lon / 1e6::DOUBLE - a_lon) * 111320 * cos(radians(a_lat)) AS px, (s.stop_lat / 1e6::DOUBLE - a_lat) * 111320 AS py FROM t_stops s, seg g),
along AS (SELECT *, CASE WHEN bx * bx + ey * ey = 0 THEN 0 ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, (px * bx + py * ey) / (bx * bx + ey * ey))) END AS t FROM xy),
tagged AS (SELECT DISTINCT stop_pk FROM along WHERE sqrt(pow(px - t * bx, 2) + pow(py - t * ey, 2)) <= {width} + {taper} * sin(pi() * (bef + t * len) / total))"""


@query(ctes(("t_stops",), _PATH + tag_sql(350, 900), "SELECT stop_pk FROM tagged"))
def corridor_tag_stops(t):
    return corridor.tag_stops(_path(t), t("t_stops")).select("stop_pk")


@query(ctes(("t_stops",), _PATH + tag_sql(700, 1600), "SELECT stop_pk FROM tagged"))
def corridor_widen(t):
    return corridor.tag_stops(_path(t), t("t_stops"), corridor.WIDER_WIDTH_M, corridor.WIDER_TAPER_M).select("stop_pk")


_ENDS = f"ends AS (SELECT DISTINCT s.stop_pk FROM t_stops s, t_stops o WHERE o.stop_pk IN ({FROM_PK}, {TO_PK}) AND {_H} <= 900)"


@query(ctes(("t_stops",), _PATH + tag_sql(350, 900) + ", " + _ENDS, "SELECT stop_pk, false AS widened FROM (SELECT stop_pk FROM tagged UNION SELECT stop_pk FROM ends) u"))
def corridor_tapered(t):
    return corridor.tapered(_path(t), t("t_stops"), corridor.near_ends(_od(t), t("t_stops")).withColumn("query_id", F.lit(1))).select("stop_pk", "widened")


@query(ctes(("t_stops",), _PATH + """, target AS (SELECT i AS sample, i / 20.0::DOUBLE * (SELECT max(total) FROM seg) AS target FROM range(0, 21) r(i)),
pick AS (SELECT sample, target, coalesce((SELECT min(pos) FROM seg WHERE bef + len >= target), (SELECT max(pos) FROM seg)) AS pos FROM target),
p AS (SELECT sample, target / total AS gt, a_lat + (b_lat - a_lat) * CASE WHEN len > 0 THEN (target - bef) / len ELSE 0 END AS lat, a_lon + (b_lon - a_lon) * CASE WHEN len > 0 THEN (target - bef) / len ELSE 0 END AS lon, b_lat - a_lat AS dlat, b_lon - a_lon AS dlon FROM pick JOIN seg USING (pos)),
q AS (SELECT *, dlon * 111320 * cos(radians(lat)) AS dx, dlat * 111320 AS dy FROM p),
o AS (SELECT *, (350 + 900 * sin(pi() * gt)) / CASE WHEN dx * dx + dy * dy = 0 THEN 1 ELSE sqrt(dx * dx + dy * dy) END AS k FROM q)""", "SELECT CAST(sample AS INTEGER) AS sample, CAST(round((lat + dx * k / 111320) * 1000000) AS BIGINT) AS left_lat, CAST(round((lon - dy * k / (111320 * cos(radians(lat)))) * 1000000) AS BIGINT) AS left_lon, CAST(round((lat - dx * k / 111320) * 1000000) AS BIGINT) AS right_lat, CAST(round((lon + dy * k / (111320 * cos(radians(lat)))) * 1000000) AS BIGINT) AS right_lon FROM o"))
def corridor_boundary(t):
    b = corridor.boundary(_path(t), t("t_stops"))
    return b.select("sample", *[F.round(F.col(c) * 1e6).cast("bigint").alias(c) for c in ("left_lat", "left_lon", "right_lat", "right_lon")])


@query("SELECT DISTINCT pattern_pk FROM t_pattern_stops WHERE stop_pk IN (1, 77, 40)", ("t_pattern_stops",))
def corridor_seed_patterns(t):
    core = _path(t).select("query_id", F.explode("path").alias("stop_pk"))
    return corridor.patterns_of(core, t("t_pattern_stops")).select("pattern_pk")


@query(ctes(("t_stops", "t_pattern_stops"), _ENDS, "SELECT DISTINCT stop_pk FROM (SELECT stop_pk FROM t_pattern_stops WHERE pattern_pk IN (SELECT pattern_pk FROM t_pattern_stops WHERE stop_pk IN (1, 77, 40)) UNION ALL SELECT stop_pk FROM ends UNION ALL SELECT CAST(unnest([1, 77, 40]) AS BIGINT)) u"))
def setop_corridor_union(t):
    core = _path(t).select("query_id", F.explode("path").alias("stop_pk"))
    derived = corridor.patterns_of(core, t("t_pattern_stops")).join(t("t_pattern_stops"), "pattern_pk").select("stop_pk")
    return derived.union(corridor.near_ends(_od(t), t("t_stops")).select("stop_pk")).union(core.select("stop_pk")).distinct()


@query("SELECT count(*) > 0 AS covered FROM t_pattern_stops WHERE stop_pk IN (1, 2, 3)", ("t_pattern_stops",))
def setop_coverage(t):
    derived = t("t_pattern_stops").select("stop_pk").distinct()
    return derived.join(t("t_stops").where("stop_pk <= 3"), "stop_pk", "left_semi").agg((F.count("*") > 0).alias("covered"))


@query()
def corridor_resolve(t):
    found = corridor.resolve(_od(t), t("t_stops"), t("t_pattern_stops"), t("t_patterns"))
    kinds = found["stops"].groupBy("query_id").count().select("query_id", F.lit("stops").alias("what"), F.col("count").alias("n")).union(found["patterns"].groupBy("query_id").count().select("query_id", F.lit("patterns"), "count"))
    if found["network"] is not None:  # the sizes of the network, two rows, for each of these
        sizes = t("t_stops").agg(F.lit("stops").alias("what"), F.count("*").alias("n")).union(t("t_patterns").agg(F.lit("patterns"), F.count("*")))
        kinds = kinds.union(found["network"].join(F.broadcast(sizes)).select("query_id", "what", "n"))
    return kinds.join(found["how"], "query_id")


# --- the search ----------------------------------------------------------------------------

_SEC = "CAST(floor(d / 1.4::DOUBLE + 0.5) AS BIGINT)"
_SEARCH_VIEWS = ("t_stops", "t_pattern_stops", "t_trips", "t_stop_times")
_SEED_LABELS = _NEAR + f""", s0 AS (SELECT stop_pk, {DEPART} + {_SEC} AS arr, d AS walk_m FROM near WHERE rank <= 50)"""
_FIRST = _SEED_LABELS + f""", bd AS (SELECT s.stop_pk AS board_pk, s.walk_m, t.pattern_pk, t.trip_pk, x.stop_sequence, x.departure_sec, row_number() OVER (PARTITION BY t.pattern_pk ORDER BY p.stop_sequence, x.departure_sec, t.trip_pk, x.stop_sequence) AS r
 FROM s0 s JOIN t_pattern_stops p ON p.stop_pk = s.stop_pk JOIN t_trips t ON t.pattern_pk = p.pattern_pk JOIN t_stop_times x ON x.trip_pk = t.trip_pk AND x.stop_pk = s.stop_pk WHERE x.departure_sec >= s.arr),
rd AS (SELECT x.stop_pk, x.arrival_sec AS arr, b.walk_m FROM bd b JOIN t_stop_times x ON x.trip_pk = b.trip_pk AND x.stop_sequence > b.stop_sequence JOIN t_pattern_stops p ON p.pattern_pk = b.pattern_pk AND p.stop_pk = x.stop_pk AND p.stop_sequence = x.stop_sequence WHERE b.r = 1),
r1 AS (SELECT stop_pk, arr, walk_m FROM (SELECT *, row_number() OVER (PARTITION BY stop_pk ORDER BY arr, walk_m) AS r FROM rd) q WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM s0 WHERE s0.stop_pk = q.stop_pk AND s0.arr <= q.arr)),
af AS (SELECT stop_pk, min(arr) AS arr FROM (SELECT stop_pk, arr FROM s0 UNION ALL SELECT stop_pk, arr FROM r1) u GROUP BY 1),
""" + _WALKS + """, fp AS (SELECT w.dst AS stop_pk, r1.arr + CAST(floor(w.dist_m / 1.4::DOUBLE + 0.5) AS BIGINT) AS arr, r1.walk_m + w.dist_m AS walk_m FROM r1 JOIN walks w ON w.src = r1.stop_pk),
f1 AS (SELECT stop_pk, arr, walk_m FROM (SELECT *, row_number() OVER (PARTITION BY stop_pk ORDER BY arr, walk_m) AS r FROM fp) q WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM af WHERE af.stop_pk = q.stop_pk AND af.arr <= q.arr)),
m1 AS (SELECT * FROM f1 UNION ALL SELECT * FROM r1 WHERE stop_pk NOT IN (SELECT stop_pk FROM f1))"""
_PLAIN = raptor.Options(rounds=1, prune=False, most_marked=1_000_000)


def _searched(t, o: raptor.Options = raptor.Options(), pairs=((FROM_PK, TO_PK),)):
    return raptor.search(_od(t, pairs), t("t_stops"), t("t_pattern_stops"), t("t_stop_times"), o, trips=t("t_trips"))


@query(ctes(_SEARCH_VIEWS, _SEED_LABELS, "SELECT stop_pk, arr FROM s0"))
def raptor_seed(t):
    return raptor.seed(_od(t), t("t_stops"), raptor.Options()).select("stop_pk", "arr")


@query(ctes(_SEARCH_VIEWS, _FIRST, "SELECT stop_pk, arr FROM m1"))
def raptor_round1(t):
    return _searched(t, _PLAIN).marked().where("round = 1").select("stop_pk", "arr")


@query(ctes(_SEARCH_VIEWS, _FIRST, "SELECT stop_pk, arr FROM r1"))
def raptor_relax(t):
    best, _ = raptor.counted(raptor.seed(_od(t), t("t_stops"), _PLAIN).withColumn("step", F.lit(0)))
    # one round boards at the seeds alone, so the index is theirs; trips are looked up for its rows
    at = t("t_stop_times").join(hinted(best.select("stop_pk").distinct()), "stop_pk", "left_semi")
    index = timetable.departure_index(at.join(t("t_trips").select("trip_pk", "pattern_pk"), "trip_pk"))
    boarded, _ = raptor.counted(raptor.board(best, index, t("t_pattern_stops")))
    rode = raptor.ride(boarded, t("t_stop_times"), t("t_pattern_stops"))
    return raptor.relax(rode, best).select("stop_pk", "arr")


_CAND = _FIRST + f""", dn AS (SELECT stop_pk, d FROM (SELECT s.stop_pk, {_H} AS d, row_number() OVER (ORDER BY {_H}, s.stop_pk) AS rank FROM t_stops s, t_stops o WHERE o.stop_pk = {TO_PK}) q WHERE rank <= 50),
cand AS (SELECT l.stop_pk, l.arr + {_SEC} AS arrival_sec, l.walk_m + d AS walk_m, l.legs FROM (SELECT stop_pk, arr, walk_m, 0 AS legs FROM s0 UNION ALL SELECT stop_pk, arr, walk_m, 1 FROM m1) l JOIN dn USING (stop_pk))"""


@query(ctes(_SEARCH_VIEWS, _CAND, "SELECT stop_pk, CAST(legs AS BIGINT) AS legs, arrival_sec, CAST(round(walk_m) AS BIGINT) AS walk_m FROM cand"))
def raptor_candidates(t):
    return _searched(t, _PLAIN).found.select("stop_pk", "legs", "arrival_sec", F.round("total_walk_m").cast("bigint").alias("walk_m"))


@query(ctes(_SEARCH_VIEWS, _CAND, "SELECT min(arrival_sec) AS best_sec FROM cand"))
def raptor_best_arrival(t):
    return _searched(t, _PLAIN).found.agg(F.min("arrival_sec").alias("best_sec"))


@query(ctes(_SEARCH_VIEWS, _CAND, "SELECT stop_pk, CAST(legs AS BIGINT) AS legs, arrival_sec, CAST(round(walk_m) AS BIGINT) AS walk_m FROM cand c WHERE NOT EXISTS (SELECT 1 FROM cand o WHERE o.arrival_sec <= c.arrival_sec AND o.walk_m <= c.walk_m AND o.legs <= c.legs AND (o.arrival_sec < c.arrival_sec OR o.walk_m < c.walk_m OR o.legs < c.legs))"))
def pareto_front(t):
    return raptor.pareto(_searched(t, _PLAIN).found).select("stop_pk", "legs", "arrival_sec", F.round("total_walk_m").cast("bigint").alias("walk_m"))


_GO = _FIRST + ", go AS (SELECT m1.stop_pk, m1.arr, " + haversine_sql("s.stop_lat / 1e6::DOUBLE", "s.stop_lon / 1e6::DOUBLE", "o.stop_lat / 1e6::DOUBLE", "o.stop_lon / 1e6::DOUBLE") + f" AS go_m FROM m1 JOIN t_stops s USING (stop_pk), t_stops o WHERE o.stop_pk = {TO_PK})"


def _marked(t):
    history = _searched(t, _PLAIN).marked().where("round = 1").select("query_id", "stop_pk", "arr")
    go = S.haversine_m(F.col("lat"), F.col("lon"), F.col("d_lat"), F.col("d_lon"))
    to_go = history.select("query_id", "stop_pk").join(corridor.points(t("t_stops")), "stop_pk").join(_od(t), "query_id").select("query_id", "stop_pk", go.alias("go_m"))
    return history, to_go


@query(ctes(_SEARCH_VIEWS, _GO, "SELECT stop_pk FROM go WHERE arr + go_m / 10 <= 31000"))
def raptor_prune(t):
    marked, to_go = _marked(t)
    best = _od(t).select("query_id", F.lit(31_000).alias("best_sec"))
    return raptor.prune(marked, best, to_go, raptor.Options()).select("stop_pk")


@query(ctes(_SEARCH_VIEWS, _GO + ", tr AS (SELECT *, row_number() OVER (ORDER BY go_m, stop_pk) AS near FROM go), sc AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN near <= 25 THEN 1 ELSE 2 END, arr + go_m / 10, stop_pk) AS turn FROM tr)", "SELECT stop_pk FROM sc WHERE near <= 25 OR turn <= 100"))
def raptor_trim(t):
    marked, to_go = _marked(t)
    return raptor.trim(marked.join(to_go, ["query_id", "stop_pk"]), None, raptor.Options(most_marked=100)).select("stop_pk")


@query(ctes(_SEARCH_VIEWS, _GO + """, sd AS (SELECT DISTINCT stop_pk FROM t_pattern_stops WHERE pattern_pk = 1), tr AS (SELECT go.*, sd.stop_pk IS NOT NULL AS seeded, row_number() OVER (ORDER BY CASE WHEN sd.stop_pk IS NULL THEN 0 ELSE 1 END, go_m, go.stop_pk) AS near FROM go LEFT JOIN sd ON sd.stop_pk = go.stop_pk),
sc AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN seeded THEN 0 WHEN near <= 10 THEN 1 ELSE 2 END, arr + go_m / 10, stop_pk) AS turn FROM tr)""", "SELECT stop_pk, seeded FROM sc WHERE seeded OR near <= 10 OR turn <= 40"))
def raptor_trim_seeds(t):
    """The trim with the stops of a seed path, which stay however far they are: here the stops of one pattern."""
    marked, to_go = _marked(t)
    seeds = t("t_pattern_stops").where("pattern_pk = 1").select(F.lit(1).alias("query_id"), "stop_pk").distinct()
    left = raptor.trim(marked.join(to_go, ["query_id", "stop_pk"]), seeds, raptor.Options(most_marked=40))
    return left.join(seeds.select("stop_pk", F.lit(True).alias("seeded")), "stop_pk", "left").select("stop_pk", F.coalesce("seeded", F.lit(False)).alias("seeded"))


PAIRS = ((FROM_PK, TO_PK), (5, 100), (17, 133))


def _journeys(t) -> DataFrame:
    return raptor.journeys(_searched(t, pairs=PAIRS))


@query()
def raptor_rounds(t):
    return _searched(t, pairs=PAIRS).marked().groupBy("query_id", "round").agg(F.count("*").alias("n_marked"), F.min("arr").alias("first_arr"))


@query()
def journey_rank(t):
    return _journeys(t).select("query_id", "journey_no", "arrival_sec", "legs", F.round("total_walk_m").cast("bigint").alias("walk_m"))


@query()
def journey_legs(t):
    return raptor.journey_legs(_journeys(t)).withColumn("dist_m", F.round("dist_m").cast("bigint"))


@query()
def journey_segments(t):
    legs = raptor.with_coords(raptor.journey_legs(_journeys(t)), t("t_stops"), t("t_pattern_stops"), t("t_shapes"), t("t_patterns"))
    return legs.select("query_id", "journey_no", "leg_no", "pattern_pk", F.size("coords").alias("n_points"), S.point_key(F.element_at("coords", 1)["latitude"], F.element_at("coords", 1)["longitude"]).alias("first_point"))


_TRIM_SIDE = "SELECT e.pattern_pk, e.from_pk, e.to_pk, c.i, {d} AS d FROM e JOIN c USING (pattern_pk) JOIN t_stops s ON s.stop_pk = e.{end}"
_TRIM_D = haversine_sql("s.stop_lat / 1e6::DOUBLE", "s.stop_lon / 1e6::DOUBLE", "c.lat / 1e6::DOUBLE", "c.lon / 1e6::DOUBLE")
_TRIM = f"""c AS (SELECT shape_pk AS pattern_pk, shape_pt_lat AS lat, shape_pt_lon AS lon, row_number() OVER (PARTITION BY shape_pk ORDER BY shape_pt_sequence, shape_pt_lat, shape_pt_lon) - 1 AS i FROM t_shapes),
e AS (SELECT DISTINCT a.pattern_pk, a.stop_pk AS from_pk, b.stop_pk AS to_pk FROM t_pattern_stops a JOIN t_pattern_stops b ON b.pattern_pk = a.pattern_pk),
n0 AS (SELECT pattern_pk, from_pk, to_pk, i AS i0 FROM (SELECT *, row_number() OVER (PARTITION BY pattern_pk, from_pk, to_pk ORDER BY d, i) AS r FROM ({_TRIM_SIDE.format(d=_TRIM_D, end='from_pk')}) x) y WHERE r = 1),
n1 AS (SELECT pattern_pk, from_pk, to_pk, i AS i1 FROM (SELECT *, row_number() OVER (PARTITION BY pattern_pk, from_pk, to_pk ORDER BY d, i) AS r FROM ({_TRIM_SIDE.format(d=_TRIM_D, end='to_pk')}) x) y WHERE r = 1)"""


@query(ctes(("t_stops", "t_pattern_stops", "t_shapes"), _TRIM, """SELECT n.pattern_pk, n.from_pk, n.to_pk, CAST(abs(i1 - i0) + 1 AS INTEGER) AS n_points, lo.lat AS first_lat, CAST(CASE WHEN i0 = i1 THEN 2 ELSE abs(i1 - i0) + 1 END AS INTEGER) AS n_turned, CASE WHEN i0 = i1 THEN s.stop_lat ELSE c0.lat END AS turned_lat
FROM (SELECT * FROM n0 JOIN n1 USING (pattern_pk, from_pk, to_pk)) n JOIN c lo ON lo.pattern_pk = n.pattern_pk AND lo.i = least(i0, i1) JOIN c c0 ON c0.pattern_pk = n.pattern_pk AND c0.i = i0 JOIN t_stops s ON s.stop_pk = n.from_pk"""))
def shape_trim(t):
    """The slice of each pattern's shape between any two of its stops, in the shape's order and in the ride's."""
    stops = t("t_pattern_stops").select("pattern_pk", "stop_pk")
    legs = stops.withColumnRenamed("stop_pk", "from_pk").join(stops.withColumnRenamed("stop_pk", "to_pk"), "pattern_pk").distinct()
    legs = legs.select(F.lit(1).alias("query_id"), F.lit(1).alias("journey_no"), F.lit(1).alias("leg_no"), F.lit("transit").alias("kind"), "from_pk", "to_pk", "pattern_pk", F.lit(0).alias("board_seq"), F.lit(0).alias("alight_seq"))
    legs = legs.join(t("t_patterns").where("shape_id IS NOT NULL").select("pattern_pk"), "pattern_pk", "left_semi")
    sides = []
    for turned, n, lat in ((False, "n_points", "first_lat"), (True, "n_turned", "turned_lat")):
        rows = raptor.with_coords(legs, t("t_stops"), t("t_pattern_stops"), t("t_shapes"), t("t_patterns"), turned)
        sides.append(rows.select("pattern_pk", "from_pk", "to_pk", F.size("coords").alias(n), F.round(F.get("coords", F.lit(0))["latitude"] * 1e6).cast("bigint").alias(lat)))
    return sides[0].join(sides[1], ["pattern_pk", "from_pk", "to_pk"])


@query()
def shape_points_for_journeys(t):
    used = raptor.journey_legs(_journeys(t)).where("kind = 'transit'").select(F.col("pattern_pk").alias("shape_pk")).distinct()
    return t("t_shapes").join(used, "shape_pk", "left_semi")


def _summary(t, found: DataFrame) -> DataFrame:
    rows = raptor.journey_legs(found).join(timetable.pattern_meta(t("t_patterns"), t("t_routes")).select("pattern_pk", "route_name"), "pattern_pk", "left")
    named = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "transit", F.struct("leg_no", "route_name")))), lambda x: x["route_name"]), " → ")
    return rows.groupBy("query_id", "journey_no").agg(F.round(F.sum("dist_m")).cast("bigint").alias("walk_m"), F.greatest(F.count_if(F.col("kind") == "transit") - 1, F.lit(0)).alias("transfers"), named.alias("routes"), S.format_hhmm(F.max("end_sec")).alias("arrival"))


@query()
def journey_summary(t):
    return _summary(t, _journeys(t))


# journeys of one round, for a whole batch of queries, with SQL: the front, its order, its choice and its summary
_FRONT = _CAND + """, fr AS (SELECT c.*, row_number() OVER (ORDER BY arrival_sec, legs, walk_m, stop_pk) AS journey_no FROM cand c WHERE NOT EXISTS (SELECT 1 FROM cand o WHERE o.arrival_sec <= c.arrival_sec AND o.walk_m <= c.walk_m AND o.legs <= c.legs AND (o.arrival_sec < c.arrival_sec OR o.walk_m < c.walk_m OR o.legs < c.legs)))"""
_JOURNEY = "SELECT journey_no, arrival_sec, CAST(legs AS BIGINT) AS legs, CAST(round(walk_m) AS BIGINT) AS walk_m FROM fr"


def _one_round(t) -> DataFrame:
    return raptor.journeys(_searched(t, _PLAIN), _PLAIN)


def _journey(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("journey_no").cast("bigint").alias("journey_no"), "arrival_sec", "legs", F.round("total_walk_m").cast("bigint").alias("walk_m"))


def _placed(t, by: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(by, "journey_no")).cast("bigint").alias("place")
    return _one_round(t).select(place, F.col("journey_no").cast("bigint").alias("journey_no"), "arrival_sec", "legs", F.round("total_walk_m").cast("bigint").alias("walk_m"))


for _name, _by in {"one_round_sort_arrival": "arrival_sec", "one_round_sort_walking": "total_walk_m", "one_round_sort_transfers": "legs"}.items():
    QUERIES[_name] = lambda spark, sf_dir, by=_by: _placed(lambda n: adapter.view(spark, sf_dir, n), by)
    SQL[_name] = ctes(_SEARCH_VIEWS, _FRONT, f"SELECT row_number() OVER (ORDER BY {'walk_m' if _by == 'total_walk_m' else _by}, journey_no) AS place, journey_no, arrival_sec, CAST(legs AS BIGINT) AS legs, CAST(round(walk_m) AS BIGINT) AS walk_m FROM fr")


@query(ctes(_SEARCH_VIEWS, _FRONT, _JOURNEY + " WHERE journey_no = (SELECT max(journey_no) FROM fr)"))
def one_round_select(t):
    """The last place of the list, chosen by its number."""
    found = _one_round(t)
    return _journey(raptor.chosen(found, found.groupBy("query_id").agg((F.max("journey_no") - 1).alias("place"))))


@query(ctes(_SEARCH_VIEWS, _FRONT, "SELECT journey_no, CAST(round(walk_m) AS BIGINT) AS walk_m, CAST(greatest(legs - 1, 0) AS BIGINT) AS transfers, concat(lpad(CAST(arrival_sec // 3600 % 24 AS VARCHAR), 2, '0'), ':', lpad(CAST(arrival_sec % 3600 // 60 AS VARCHAR), 2, '0')) AS arrival FROM fr"))
def one_round_summary(t):
    return _summary(t, _one_round(t)).select(F.col("journey_no").cast("bigint").alias("journey_no"), "walk_m", "transfers", "arrival")


@query(ctes(_SEARCH_VIEWS, _FRONT, """SELECT c.stop_pk, CAST(c.legs AS BIGINT) AS legs, c.arrival_sec, CAST(round(c.walk_m) AS BIGINT) AS walk_m, b.stop_pk AS by_stop, b.arrival_sec AS by_arrival, CAST(b.legs AS BIGINT) AS by_legs
 FROM cand c LEFT JOIN LATERAL (SELECT * FROM fr WHERE fr.arrival_sec <= c.arrival_sec AND fr.walk_m <= c.walk_m AND fr.legs <= c.legs AND (fr.arrival_sec < c.arrival_sec OR fr.walk_m < c.walk_m OR fr.legs < c.legs) ORDER BY fr.arrival_sec, fr.legs, fr.walk_m, fr.stop_pk LIMIT 1) b ON true"""))
def dominance_trace(t):
    rows = raptor.dominance(_searched(t, _PLAIN).found, _PLAIN.rounds)
    return rows.select("stop_pk", "legs", "arrival_sec", F.round("total_walk_m").cast("bigint").alias("walk_m"), F.col("beaten_by.stop_pk").alias("by_stop"), F.col("beaten_by.arrival_sec").alias("by_arrival"), F.col("beaten_by.legs").alias("by_legs"))


@query(ctes(("t_stop_times", "t_pattern_stops"), "c AS (SELECT stop_pk, arrival_sec, CAST(trip_pk % 977 AS DOUBLE) AS walk_m, stop_sequence % 6 AS legs FROM t_stop_times)", "SELECT stop_pk, arrival_sec, CAST(walk_m AS BIGINT) AS walk_m, legs FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.stop_pk = c.stop_pk AND o.arrival_sec <= c.arrival_sec AND o.walk_m <= c.walk_m AND o.legs <= c.legs AND (o.arrival_sec < c.arrival_sec OR o.walk_m < c.walk_m OR o.legs < c.legs))"))
def pareto_fronts(t):
    """The front of each stop's visits by arrival, walk and legs: a batch of sweeps with thousands of rows."""
    found = t("t_stop_times").select(F.col("stop_pk").alias("query_id"), "arrival_sec", (F.col("trip_pk") % 977).cast("double").alias("total_walk_m"), (F.col("stop_sequence") % 6).alias("legs"))
    return raptor.pareto(found).select(F.col("query_id").alias("stop_pk"), "arrival_sec", F.col("total_walk_m").cast("bigint").alias("walk_m"), "legs")


for _name, _order in {"journey_sort_arrival": ["arrival_sec"], "journey_sort_walking": ["total_walk_m"], "journey_sort_transfers": ["legs"]}.items():
    QUERIES[_name] = lambda spark, sf_dir, order=_order: _journeys(lambda n: adapter.view(spark, sf_dir, n)).orderBy("query_id", *order, "journey_no").select("query_id", "journey_no", "arrival_sec", "legs", F.round("total_walk_m").cast("bigint").alias("walk_m"))


@query()
def journey_select(t):
    found = _journeys(t)
    first = found.select("query_id", F.lit(0).alias("place")).distinct()
    return raptor.chosen(found, first).select("query_id", "arrival_sec", "legs")


@query()
def journey_compare(t):
    """Journeys of one round with and without the prune, which must not change the first."""
    pruned, whole = (raptor.journeys(_searched(t, raptor.Options(rounds=1, prune=p))) for p in (True, False))
    return raptor.compared(pruned, whole)


@query()
def journey_lines(t):
    legs = raptor.with_coords(raptor.journey_legs(_journeys(t)), t("t_stops"), t("t_pattern_stops"), t("t_shapes"), t("t_patterns"))
    return raptor.journey_lines(legs).select("query_id", "journey_no", F.size("coords").alias("n_points"))


@query()
def debug_rounds(t):
    return _searched(t).marked().select("round", "stop_pk", "arr")


@query(ctes(_NET, _BFS, "SELECT CAST(level AS INTEGER) AS level, n, CAST(sum(n) OVER (ORDER BY level) AS BIGINT) AS shown FROM (SELECT level, count(*) AS n FROM lv GROUP BY level) c"))
def debug_cumulative_reveal(t):
    found = _levels(t)[0]
    return found.groupBy("level").agg(F.count("*").alias("n")).withColumn("shown", F.sum("n").over(Window.orderBy("level")))


@query()
def debug_bfs_candidates(t):
    paths, found = _paths(t)
    ends = paths.select("path_no", F.element_at("path", -1).alias("stop_pk"))
    found = found.select("stop_pk", "level")
    last = found.agg(F.max("level").alias("last"))
    return ends.join(found, "stop_pk", "left").join(F.broadcast(last)).select("path_no", "stop_pk", F.coalesce("level", "last").alias("level"))  # one row


_STEPS = _FIRST + """, rk AS (SELECT x.stop_pk, x.arrival_sec AS arr, b.walk_m, b.board_pk, b.pattern_pk FROM bd b JOIN t_stop_times x ON x.trip_pk = b.trip_pk AND x.stop_sequence > b.stop_sequence JOIN t_pattern_stops p ON p.pattern_pk = b.pattern_pk AND p.stop_pk = x.stop_pk AND p.stop_sequence = x.stop_sequence WHERE b.r = 1),
st AS (SELECT k.stop_pk, k.board_pk, k.pattern_pk, k.arr FROM (SELECT *, row_number() OVER (PARTITION BY stop_pk ORDER BY arr, walk_m, board_pk) AS r FROM rk) k WHERE r = 1 AND stop_pk IN (SELECT stop_pk FROM r1))"""


@query(ctes(_SEARCH_VIEWS, _STEPS, "SELECT CAST(row_number() OVER (ORDER BY stop_pk) - 1 AS BIGINT) AS step_no, CAST(1 AS INTEGER) AS round, stop_pk, board_pk, pattern_pk, arr, concat(board_pk, '>', stop_pk) AS chain FROM st"))
def debug_flatten_steps(t):
    """The rides of one round as steps, each with the chain of stops that led to it."""
    steps = debug.flattened(debug.events(_od(t), t("t_stops"), None, _searched(t, _PLAIN)))
    return steps.select(F.col("step_no").cast("bigint").alias("step_no"), "round", "payload.stop_pk", F.col("payload.from_pk").alias("board_pk"), "payload.pattern_pk", F.col("payload.at_sec").alias("arr"), F.array_join("payload.chain", ">").alias("chain"))


@query()
def debug_events(t):
    """All events of a search, counted by kind and index."""
    return engine.Engine.from_views(t).events(_od(t)).groupBy("query_id", "kind", "index").agg(F.count("*").alias("n"))


@query()
def debug_step_counts(t):
    return debug.step_counts(debug.events(_od(t, PAIRS), t("t_stops"), None, _searched(t, pairs=PAIRS)))


@query(ctes(_SEARCH_VIEWS, _CAND + """, ln AS (SELECT pattern_pk, stop_pk, min(stop_sequence) AS seq FROM t_pattern_stops GROUP BY 1, 2),
mk AS (SELECT stop_pk, arr, 0 AS round FROM s0 UNION ALL SELECT stop_pk, arr, 1 FROM m1), ta AS (SELECT stop_pk, min(arr) AS tau FROM (SELECT stop_pk, arr FROM mk UNION ALL SELECT stop_pk, arr FROM r1) u GROUP BY 1),
sv AS (SELECT dn.stop_pk, ln.pattern_pk, ln.seq, EXISTS (SELECT 1 FROM t_trips t JOIN t_stop_times x ON x.trip_pk = t.trip_pk WHERE t.pattern_pk = ln.pattern_pk AND x.stop_pk = dn.stop_pk) AS ran FROM dn LEFT JOIN ln ON ln.stop_pk = dn.stop_pk),
mt AS (SELECT sv.stop_pk, sv.pattern_pk, sv.seq, mk.stop_pk AS at_pk, mk.round, q.seq AS at_seq, q.seq < sv.seq AS up FROM sv JOIN ln q ON q.pattern_pk = sv.pattern_pk JOIN mk ON mk.stop_pk = q.stop_pk),
bu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stop_pk, pattern_pk ORDER BY at_seq, round, at_pk) AS r FROM mt WHERE up) x WHERE r = 1),
bw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stop_pk, pattern_pk ORDER BY round, at_seq, at_pk) AS r FROM mt WHERE NOT up) x WHERE r = 1),
vd AS (SELECT sv.stop_pk, sv.pattern_pk, CASE WHEN sv.pattern_pk IS NULL THEN 'not served' WHEN NOT sv.ran THEN 'no trips' WHEN bu.at_pk IS NOT NULL THEN 'upstream' WHEN bw.at_pk IS NOT NULL THEN 'downstream only' ELSE 'never marked' END AS verdict,
 bu.at_pk AS up_pk, bu.round AS up_round, bw.at_pk AS down_pk, bw.round AS down_round FROM sv LEFT JOIN bu ON bu.stop_pk = sv.stop_pk AND bu.pattern_pk = sv.pattern_pk LEFT JOIN bw ON bw.stop_pk = sv.stop_pk AND bw.pattern_pk = sv.pattern_pk)""",
"""SELECT v.stop_pk, v.pattern_pk, v.verdict, CASE v.verdict WHEN 'upstream' THEN up_pk WHEN 'downstream only' THEN down_pk END AS at_pk, CAST(CASE v.verdict WHEN 'upstream' THEN up_round WHEN 'downstream only' THEN down_round END AS INTEGER) AS at_round,
 CASE v.verdict WHEN 'upstream' THEN (SELECT min(x.departure_sec) FROM t_trips t JOIN t_stop_times x ON x.trip_pk = t.trip_pk WHERE t.pattern_pk = v.pattern_pk AND x.stop_pk = v.up_pk AND x.departure_sec >= (SELECT tau FROM ta WHERE ta.stop_pk = v.up_pk)) END AS departure_sec FROM vd v"""))
def diag_patterns(t):
    """One round, every stop near the destination: how near each of its patterns came to riding there."""
    searched = _searched(t, _PLAIN)
    return debug.diagnosed(raptor.destinations(_od(t), t("t_stops"), _PLAIN), searched, t("t_pattern_stops"), t("t_stop_times"), trips=t("t_trips")).select("stop_pk", "pattern_pk", "verdict", "at_pk", "at_round", "departure_sec")


@query()
def load_scoped_index(t):
    q, e = _od(t), engine.Engine.from_views(t)
    return e.timetable(q, e.corridor(q)).groupBy("query_id").agg(F.count("*").alias("n_rows"), F.count_distinct("trip_pk").alias("n_trips"))


@query()
def route_retry(t):
    return engine.Engine.from_views(t).route(_od(t, PAIRS)).select("query_id", "status", "journey_no", "arrival_sec", "legs")


@query()
def diag_failure(t):
    return engine.Engine.from_views(t).diagnose(_od(t))


@query()
def geo_convex_hull(t):
    return geometry.convex_hulls(corridor.points(t("t_stops")).select((F.col("stop_pk") % 5).alias("group_id"), "lat", "lon"))
