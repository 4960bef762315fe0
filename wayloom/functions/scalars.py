"""Scalar functions of the engine as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M, DEGREE_M, MICRO = 6_371_000.0, 111_320.0, 1e6
WEEKDAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")

# Route types of the transit feed specification, basic codes and hundreds of the extended ones.
BASIC_TYPES = {
    0: ("tram", "Tram"), 1: ("metro", "Metro"), 2: ("rail", "Train"), 3: ("bus", "Bus"), 4: ("ferry", "Ferry"), 5: ("cable", "Cable Car"),
    6: ("aerial", "Aerial Lift"), 7: ("funicular", "Funicular"), 11: ("bus", "Trolleybus"), 12: ("rail", "Monorail"),
}
HUNDRED_TYPES = {
    1: ("rail", "Train"), 2: ("coach", "Coach"), 3: ("rail", "Train"), 4: ("rail", "Train"), 5: ("metro", "Metro"), 6: ("metro", "Underground"),
    7: ("bus", "Bus"), 8: ("bus", "Trolleybus"), 9: ("tram", "Tram"), 10: ("ferry", "Water"), 11: ("other", "Air"), 12: ("ferry", "Ferry"),
    13: ("aerial", "Aerial Lift"), 14: ("funicular", "Funicular"), 15: ("other", "Taxi"), 17: ("other", "Transit"),
}
OTHER_TYPE = ("other", "Transit")
# Colours by category where a feed has none, and names that mark regional rail.
CATEGORY_COLORS = {"tram": "#EAB308", "bus": "#F97316", "ferry": "#0EA5E9", "metro": "#2563EB", "coach": "#8F1A95"}
REGIONAL_COLOR, OTHER_COLOR, TEXT_COLOR = "#8F1A95", "#2563EB", "#FFFFFF"
REGIONAL_NAMES = ("v/line", "regional", "albury", "ballarat", "bairnsdale", "bendigo", "echuca", "geelong", "maryborough", "shepparton", "swan hill", "traralgon", "warrnambool", "seymour")


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres between two points in degrees."""
    up, across = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    h = up * up + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * across * across
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def half_up(x: Column) -> Column:
    """Round halves towards plus infinity."""
    return F.floor(x + 0.5)


def round_half(x: Column) -> Column:
    """x, 0 or more, to the nearest whole number, halves up: F.round(x), whose decimals take a hundred times as long."""
    whole = F.floor(x)
    return whole + (x - whole >= 0.5).cast("bigint")


def parse_int(text: Column) -> Column:
    """The integer that a text starts with; null if none."""
    return F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint")


def parse_float(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double")


def pack_coord(text: Column) -> Column:
    """Degrees as text to whole millionths; null if not a number."""
    return half_up(parse_float(text) * MICRO)


def unpack_coord(micro: Column) -> Column:
    return micro / F.lit(MICRO)


def parse_time(text: Column) -> Column:
    """H:M:S to seconds of the service day, past 24 hours as well; blank is 0, parts that are missing are 0."""
    parts = F.split(F.trim(text), ":")
    seconds = F.lit(0).cast("bigint")
    for i, each in enumerate((3600, 60, 1)):
        seconds = seconds + F.coalesce(parse_int(F.get(parts, F.lit(i))), F.lit(0)) * each
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", 0).otherwise(seconds).cast("bigint")


def _two(x: Column) -> Column:
    return F.lpad(x.cast("bigint").cast("string"), 2, "0")


def format_hhmm(seconds: Column) -> Column:
    return F.concat(_two(F.floor(seconds / 3600) % 24), F.lit(":"), _two(F.floor((seconds % 3600) / 60)))


def format_hhmmss(seconds: Column) -> Column:
    return F.concat(format_hhmm(seconds), F.lit(":"), _two(seconds % 60))


def hex_color(text: Column, missing: str | None = "") -> Column:
    """#RRGGBB in capitals; `missing` where the text isn't a colour."""
    bare = F.upper(F.regexp_replace(F.trim(text), "^#", ""))
    return F.when(bare.rlike("^[0-9A-F]{6}$"), F.concat(F.lit("#"), bare)).otherwise(F.lit(missing))


def route_type(code: Column) -> Column:
    """struct(category, label) of a route type."""

    def pair(values: tuple[str, str]) -> Column:
        return F.struct(F.lit(values[0]).alias("category"), F.lit(values[1]).alias("label"))

    out = F.when(code == 0, pair(BASIC_TYPES[0]))
    for k, v in BASIC_TYPES.items():
        out = out.when(code == k, pair(v)) if k else out
    for k, v in HUNDRED_TYPES.items():
        out = out.when((code >= 100 * k) & (code < 100 * k + 100), pair(v))
    return out.otherwise(pair(OTHER_TYPE))


def fallback_color(code: Column, name: Column) -> Column:
    category = route_type(code)["category"]
    out = F.when((category == "rail") & F.lower(name).rlike("|".join(REGIONAL_NAMES)), REGIONAL_COLOR)
    for k, v in CATEGORY_COLORS.items():
        out = out.when(category == k, v)
    return out.otherwise(OTHER_COLOR)


def route_color(color: Column, code: Column, name: Column) -> Column:
    return F.coalesce(hex_color(color, None), fallback_color(code, name))


def text_color(color: Column) -> Column:
    return F.coalesce(hex_color(color, None), F.lit("#FFFFFF"))


def route_name(short: Column, long: Column) -> Column:
    return F.coalesce(F.nullif(short, F.lit("")), F.nullif(long, F.lit("")), F.lit("?"))


def make_key(agency: Column, id_: Column) -> Column:
    return F.concat(agency.cast("string"), F.lit(":"), id_)


def parse_key(key: Column) -> Column:
    """struct(agency, id): split at the first colon; ids hold colons themselves."""
    return F.struct(F.substring_index(key, ":", 1).cast("bigint").alias("agency"), F.substr(key, F.locate(":", key) + 1).alias("id"))


def service_date(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd")


def weekday(day: Column) -> Column:
    """0 for Sunday."""
    return (F.dayofweek(day) - 1).cast("bigint")


def secs_midnight(at: Column) -> Column:
    return (F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)).cast("bigint")


def walk_sec(metres: Column, speed: Column) -> Column:
    return metres / speed


def window_sec(km: Column, per_km: int = 150, flat: int = 2700, least: int = 9000, most: int = 18000) -> Column:
    return F.least(F.lit(float(most)), F.greatest(F.lit(float(least)), km * per_km + flat))


def grid_cell(degrees: Column, cell: float = 0.006) -> Column:
    return F.floor(degrees / cell)


def segment_distance(lat: Column, lon: Column, a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column) -> Column:
    """struct(dist_m, t): metres from a point to a segment on a plane around its start, and where along it."""
    wide = F.cos(F.radians(a_lat)) * DEGREE_M
    bx, by, px, py = (b_lon - a_lon) * wide, (b_lat - a_lat) * DEGREE_M, (lon - a_lon) * wide, (lat - a_lat) * DEGREE_M
    length = bx * bx + by * by
    t = F.when(length == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * bx + py * by) / length)))
    dx, dy = px - t * bx, py - t * by
    return F.struct(F.sqrt(dx * dx + dy * dy).alias("dist_m"), t.alias("t"))


def taper_width(t: Column, least: float, k: float) -> Column:
    return least + k * F.sin(F.pi() * t)


def round_coord(degrees: Column) -> Column:
    return half_up(degrees * 1e4) / 1e4


def cache_key(o_lat: Column, o_lon: Column, d_lat: Column, d_lon: Column, transfers: int) -> Column:
    four = [F.format_string("%.4f", round_coord(x)) for x in (o_lat, o_lon, d_lat, d_lon)]
    return F.concat(four[0], F.lit(","), four[1], F.lit("->"), four[2], F.lit(","), four[3], F.lit(f"|{transfers}"))


def walk_label(metres: Column, speed: Column) -> Column:
    minutes = F.greatest(F.lit(1), half_up(walk_sec(metres, speed) / 60))
    return F.concat(F.lit("Walk (~"), minutes.cast("bigint").cast("string"), F.lit(" min)"))


def transfer_label(from_name: Column, to_name: Column, metres: Column, speed: Column) -> Column:
    minutes = F.greatest(F.lit(1), half_up(walk_sec(metres, speed) / 60)).cast("bigint").cast("string")
    return F.when(from_name == to_name, from_name).otherwise(F.concat(from_name, F.lit(" → "), to_name, F.lit(" (~"), minutes, F.lit(" min walk)")))


def duration_text(seconds: Column) -> Column:
    """Minutes or seconds to one decimal; halves of the shortest decimal form go up."""
    return F.when(seconds >= 60, F.format_string("%.1fm", seconds / 60)).otherwise(F.format_string("%.1fs", seconds.cast("double")))


def size_text(n_bytes: Column) -> Column:
    return F.format_string("%.1f MB", n_bytes / (1024 * 1024))


def strip_scheme(path: Column) -> Column:
    return F.regexp_replace(path, "^file://", "")


def point_key(lat: Column, lon: Column) -> Column:
    return F.format_string("%.6f,%.6f", lat, lon)


def midpoint(points: Column) -> Column:
    return F.get(points, F.floor(F.size(points) / 2).cast("int"))


def clamp_minutes(m: Column) -> Column:
    return F.pmod(m, F.lit(60))


def clamp_hours(h: Column) -> Column:
    return F.pmod(h, F.lit(24))


def day_label(day: Column, today: Column) -> Column:
    ahead = F.datediff(day, today)
    return F.when(ahead == 0, "Today").when(ahead == 1, "Tomorrow").otherwise(F.date_format(day, "EEE d MMM"))
