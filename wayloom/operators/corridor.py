"""Which stops and patterns a journey may use: seeds, breadth-first levels, seed paths and tapered corridors.

All tables carry query_id, so that many searches run as one batch.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .graph import WALK_M, Walks, met_in_cells, ride_edges
from .lineage import cut

SEED_RADIUS_M, LEAST_SEEDS, MOST_SEEDS = 1000.0, 4, 40
WALK_RADIUS_M = 900.0
NEAREST_M, HALF_EARTH_M = 2000.0, 20_100_000.0
WIDTH_M, TAPER_M, WIDER_WIDTH_M, WIDER_TAPER_M, LEAST_STOPS = 350.0, 900.0, 700.0, 1600.0, 8
TRANSFERS, MARGIN, MOST_PATHS, LEAST_PATTERNS, BOUNDARY_SAMPLES = 5, 1, 24, 3, 20


def points(stops: DataFrame) -> DataFrame:
    return stops.select("stop_pk", S.unpack_coord(F.col("stop_lat")).alias("lat"), S.unpack_coord(F.col("stop_lon")).alias("lon"))


def around(places: DataFrame, stops: DataFrame, radius_m: float) -> DataFrame:
    """(query_id, stop_pk, dist_m) of the stops within radius_m of each place (query_id, at_lat, at_lon), by an
    equi-join on grid cells; places without a position have none.

    A cell is at least as wide as the radius at the latitude of every place; near a pole, or for radii of continents,
    one cell spans all longitudes. A place near the date line is looked for from both sides. Cells that many places
    look into are dealt in blocks.
    """
    known = places.where("at_lat IS NOT NULL AND at_lon IS NOT NULL")
    high, n = known.agg(F.max(F.abs("at_lat")), F.count("*")).first()  # one row
    high = high or 0.0
    tall = radius_m / 111_000.0
    reach = math.cos(math.radians(min(high, 90.0)))
    part = math.sin(math.radians(tall)) / reach if tall < 20 and high + tall < 89.0 else 1.0
    wide = 1.01 * math.degrees(math.asin(part)) if part < 0.5 else 720.0
    sides = F.explode(F.filter(F.array(*[F.col("at_lon") + turn for turn in (-360, 0, 360)]), lambda x: F.abs(x) <= 180 + wide))
    if wide == 720.0:
        sides = F.col("at_lon")
    spread = known.select("query_id", "at_lat", "at_lon", sides.alias("side"))
    spread = spread.select("query_id", "at_lat", "at_lon", S.grid_cell(F.col("at_lat"), tall).alias("y0"), S.grid_cell(F.col("side"), wide).alias("x0"))
    near = F.array(*[F.struct((F.col("y0") + dy).alias("y"), (F.col("x0") + dx).alias("x")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    spread = spread.select("query_id", "at_lat", "at_lon", F.explode(near).alias("c")).select("query_id", "at_lat", "at_lon", "c.y", "c.x").distinct()
    placed = points(stops).withColumns({"y": S.grid_cell(F.col("lat"), tall), "x": S.grid_cell(F.col("lon"), wide)})
    dist = S.haversine_m(F.col("at_lat"), F.col("at_lon"), F.col("lat"), F.col("lon"))
    met = met_in_cells(spread.withColumn("_row", F.xxhash64("query_id", "at_lat", "at_lon")), placed, "_row", "stop_pk", 27 * n)
    return met.select("query_id", "stop_pk", dist.alias("dist_m")).where(F.col("dist_m") <= radius_m)


def ranked(places: DataFrame, stops: DataFrame, most: int) -> DataFrame:
    """(query_id, stop_pk, dist_m, rank): the `most` stops nearest each place (query_id, at_lat, at_lon).

    Circles widen for the places whose circle holds too few stops; a circle with enough holds the nearest.
    """
    left, done, radius = places.select("query_id", "at_lat", "at_lon"), None, NEAREST_M
    enough = min(most, stops.count())
    by = F.row_number().over(Window.partitionBy("query_id").orderBy("dist_m", "stop_pk"))
    while True:
        rows = cut(around(left, stops, radius).withColumn("rank", by).where(F.col("rank") <= most))
        full = rows.groupBy("query_id").count().where(F.col("count") >= enough)
        kept = rows if radius > HALF_EARTH_M else rows.join(full, "query_id", "left_semi")
        done = kept if done is None else done.unionByName(kept)
        left = left.where("at_lat IS NOT NULL AND at_lon IS NOT NULL").join(full, "query_id", "left_anti")
        if radius > HALF_EARTH_M or left.isEmpty():
            return done
        radius *= 4


def seeds(places: DataFrame, stops: DataFrame, stop_routes: DataFrame, radius_m: float = SEED_RADIUS_M, least: int = LEAST_SEEDS, most: int = MOST_SEEDS) -> DataFrame:
    """(query_id, stop_pk, rank): seed stops, nearest first, that each bring a route no nearer seed has.

    A stop stays if it has no routes or is the first of one of its routes; then the first `most`, and if these are
    fewer than `least`, the nearest others as well. stop_routes: (stop_pk, route).
    """
    near = ranked(places, stops, 3 * most)
    by = Window.partitionBy("query_id")
    near = near.withColumn("_in", F.sum((F.col("dist_m") <= radius_m).cast("int")).over(by))
    near = near.where(F.when(F.col("_in") < least, F.col("rank") <= least).otherwise(F.col("dist_m") <= radius_m)).drop("_in")
    routed = near.join(stop_routes.select("stop_pk", "route").distinct(), "stop_pk", "left")
    first = F.min("rank").over(Window.partitionBy("query_id", "route"))
    kept = routed.withColumn("_new", F.col("route").isNull() | (first == F.col("rank"))).groupBy("query_id", "stop_pk", "rank").agg(F.max("_new").alias("_new"))
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_new"), "rank"))
    fresh = F.sum(F.col("_new").cast("int")).over(by)
    return kept.withColumns({"_turn": turn, "_fresh": fresh}).where((F.col("_turn") <= most) & (F.col("_turn") <= F.greatest(F.col("_fresh"), F.lit(least)))).select("query_id", "stop_pk", "rank")


def levels(edges: DataFrame, origins: DataFrame, destinations: DataFrame, transfers: int = TRANSFERS, stops: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Breadth-first levels by boardings: (query_id, stop_pk, level), tree edges (query_id, parent, child, level) and
    (query_id, first_hit).

    At each level stops one walk from the arrivals join it, then one ride leads to the next. A stop keeps all parents
    of its own level. A query stops MARGIN levels after the first that holds a destination; at most transfers + 1
    levels are boarded from. With stops, the walks of each level's arrivals are found among these, WALK_M at most; without,
    edges hold the walks as well.
    """
    rides = edges.where("kind = 'transit'").select("src", "dst")
    if stops is None:
        walks = edges.where("kind = 'walk'").select("src", "dst")
    else:
        rides, walks = cut(rides), Walks.between(stops, WALK_M)

    def walked_from(front: DataFrame) -> DataFrame:
        if stops is None:
            return front.join(walks, "src")
        return walks.from_(front, front.count()).drop("dist_m")

    cap = max(1, transfers) + 1
    arrived = cut(origins.select("query_id", "stop_pk").distinct())
    pieces = [arrived.withColumn("level", F.lit(0))]  # each level's stops, each table made once
    tree, goals = [], destinations.select("query_id", "stop_pk").distinct()
    for level in range(cap):
        seen = reduce(DataFrame.unionByName, pieces)
        hits = _hits(seen, goals)
        # one walk from what has arrived and isn't done
        done = hits.where(F.col("first_hit") + MARGIN < level)
        front = arrived.join(done, "query_id", "left_anti").select("query_id", F.col("stop_pk").alias("src"))
        known = seen.select("query_id", F.col("stop_pk").alias("dst"), F.col("level").alias("have"))
        step = walked_from(front).join(known, ["query_id", "dst"], "left").where(F.col("have").isNull() | (F.col("have") == level)).where("src <> dst")
        walked = cut(step.select("query_id", F.col("src").alias("parent"), F.col("dst").alias("child"), F.lit(level).alias("level"), F.col("have").isNull().alias("new")).distinct())
        fresh = walked.where("new").select("query_id", F.col("child").alias("stop_pk"), "level").distinct()
        # one ride from all that stands at this level, unless a walk has reached a destination in time
        seen = seen.unionByName(fresh)
        done = _hits(seen, goals).where(F.col("first_hit") + MARGIN < level)
        board = front.unionByName(fresh.select("query_id", F.col("stop_pk").alias("src"))).join(done, "query_id", "left_anti")
        rode = cut(board.join(rides, "src").join(seen.select("query_id", F.col("stop_pk").alias("dst")), ["query_id", "dst"], "left_anti").select("query_id", F.col("src").alias("parent"), F.col("dst").alias("child"), F.lit(level + 1).alias("level")).distinct())
        arrived = rode.select("query_id", F.col("child").alias("stop_pk")).distinct()
        pieces += [fresh, arrived.withColumn("level", F.lit(level + 1))]
        tree += [walked.drop("new"), rode]
        if rode.isEmpty():
            break
    seen = cut(reduce(DataFrame.unionByName, pieces))
    # what the last level's rides reach is never boarded from
    hits = _hits(seen.where(F.col("level") < cap), goals)
    return seen, cut(reduce(DataFrame.unionByName, tree)), cut(hits)


def _hits(seen: DataFrame, goals: DataFrame) -> DataFrame:
    """(query_id, first_hit): the first level with a destination."""
    return seen.join(goals, ["query_id", "stop_pk"], "left_semi").groupBy("query_id").agg(F.min("level").alias("first_hit"))


def paths(found: DataFrame, tree: DataFrame, hits: DataFrame, origins: DataFrame, destinations: DataFrame, most: int = MOST_PATHS, sizes: list[int] | None = None) -> DataFrame:
    """(query_id, path): simple paths from origins back from each destination found in time, `most` a query in the
    order of destination, number of stops and path. destinations: (query_id, stop_pk[, rank]).

    All partial paths of a turn have the same number of stops. Of those with the same destination, first stop and other
    stops on that stop's level, the `most` first are kept: what can be put before one can be put before all, since
    parents never lie on a higher level. And a destination is left once `most` paths stand before all it can still give.
    So the frontier grows with the stops, not with the paths. sizes, if given, receives the rows of each turn.
    """
    rank = "rank" if "rank" in destinations.columns else "stop_pk"
    ends = destinations.select("query_id", "stop_pk", F.col(rank).alias("dest")).join(found, ["query_id", "stop_pk"]).join(hits, "query_id").where(F.col("level") <= F.col("first_hit") + MARGIN)
    none = F.array().cast("array<bigint>")
    partial = cut(ends.select("query_id", "dest", F.col("stop_pk").alias("head"), "level", F.array("stop_pk").alias("path"), none.alias("beside")))
    dests = partial.select("query_id", "dest").distinct()
    first = origins.select("query_id", F.col("stop_pk").alias("head")).distinct().withColumn("done", F.lit(True))
    links = tree.select("query_id", "parent", F.col("child").alias("head")).distinct().join(found.select("query_id", F.col("stop_pk").alias("parent"), F.col("level").alias("above")), ["query_id", "parent"])
    links, complete = cut(links), []
    for _ in range(4 * (TRANSFERS + 2)):
        marked = partial.join(first, ["query_id", "head"], "left")
        complete.append(cut(marked.where("done").select("query_id", "dest", "path")))
        counts = reduce(DataFrame.unionByName, complete).groupBy("query_id", "dest").agg(F.count("*").alias("n"))
        upto = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("query_id").orderBy("dest"))  # the destinations of one query
        enough = dests.join(counts, ["query_id", "dest"], "left").withColumn("upto", upto).where(F.col("upto") >= most).select("query_id", "dest")
        rest = marked.where("done IS NULL").join(enough, ["query_id", "dest"], "left_anti")
        grown = rest.join(links, ["query_id", "head"]).where(~F.array_contains("path", F.col("parent")))
        beside = F.when(F.col("above") == F.col("level"), F.array_sort(F.concat("beside", F.array("head")))).otherwise(none)
        grown = grown.select("query_id", "dest", F.col("parent").alias("head"), F.col("above").alias("level"), F.concat(F.array("parent"), "path").alias("path"), beside.alias("beside"))
        place = F.row_number().over(Window.partitionBy("query_id", "dest", "head", "beside").orderBy("path"))
        partial = cut(grown.withColumn("_place", place).where(F.col("_place") <= most).drop("_place"))
        if sizes is not None:
            sizes.append(partial.count())
        if partial.isEmpty():
            break
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("dest", F.size("path"), "path"))
    return reduce(DataFrame.unionByName, complete).withColumn("path_no", order).where(F.col("path_no") <= most).select("query_id", "path_no", "path")


def segments(polylines: DataFrame) -> DataFrame:
    """Segments of polylines (query_id, path_no, pos, lat, lon): each point with the next, its length, the length
    before it and the whole."""
    along = Window.partitionBy("query_id", "path_no").orderBy("pos")
    rows = polylines.withColumns({"b_lat": F.lead("lat").over(along), "b_lon": F.lead("lon").over(along)}).where("b_lat IS NOT NULL")
    rows = rows.withColumn("length_m", S.haversine_m(F.col("lat"), F.col("lon"), F.col("b_lat"), F.col("b_lon")))
    before = F.coalesce(F.sum("length_m").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum("length_m").over(Window.partitionBy("query_id", "path_no"))
    return rows.select("query_id", "path_no", "pos", F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), "b_lat", "b_lon", "length_m", before.alias("before_m"), total.alias("total_m"))


def polylines(found_paths: DataFrame, stops: DataFrame) -> DataFrame:
    rows = found_paths.select("query_id", "path_no", F.posexplode("path").alias("pos", "stop_pk"))
    return rows.join(points(stops), "stop_pk").select("query_id", "path_no", "pos", "stop_pk", "lat", "lon")


def bbox(found: DataFrame, margin_m: float) -> DataFrame:
    """The box of each path, widened by margin_m."""
    box = found.groupBy("query_id", "path_no").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    up = margin_m / S.DEGREE_M
    across = up / F.greatest(F.lit(0.1), F.cos(F.radians((F.col("s") + F.col("n")) / 2)))
    return box.select("query_id", "path_no", (F.col("s") - up).alias("s"), (F.col("n") + up).alias("n"), (F.col("w") - across).alias("w"), (F.col("e") + across).alias("e"))


def in_bbox(stops: DataFrame, boxes: DataFrame) -> DataFrame:
    """(query_id, path_no, stop_pk, lat, lon) of stops in the boxes, by an equi-join on tenths of a degree.

    Each box covers a bounded number of cells, so that no pair of a stop and a far box is made.
    """
    cells = boxes.select("*", F.explode(F.sequence(F.floor(F.col("s") * 10), F.floor(F.col("n") * 10))).alias("y")).select("*", F.explode(F.sequence(F.floor(F.col("w") * 10), F.floor(F.col("e") * 10))).alias("x"))
    placed = points(stops).withColumns({"y": F.floor(F.col("lat") * 10), "x": F.floor(F.col("lon") * 10)})
    rows = cells.join(placed, ["y", "x"]).where(F.col("lat").between(F.col("s"), F.col("n")) & F.col("lon").between(F.col("w"), F.col("e")))
    return rows.select("query_id", "path_no", "stop_pk", "lat", "lon")


def tag_stops(found_paths: DataFrame, stops: DataFrame, width_m: float = WIDTH_M, taper_m: float = TAPER_M) -> DataFrame:
    """(query_id, stop_pk) within a path's tapered width: wide in the middle, narrow at the ends."""
    return _tagged(found_paths, stops, (width_m, taper_m)).select("query_id", "stop_pk")


def _tagged(found_paths: DataFrame, stops: DataFrame, *widths: tuple[float, float]) -> DataFrame:
    """(query_id, stop_pk, width): of (width, taper) pairs, narrow to wide, the place of the first that holds the stop."""
    lines = polylines(found_paths, stops)
    parts = segments(lines).where("total_m > 0")
    near = in_bbox(stops, bbox(lines, sum(widths[-1])))
    rows = near.join(parts, ["query_id", "path_no"])
    at = S.segment_distance(F.col("lat"), F.col("lon"), F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    rows = rows.select("query_id", "stop_pk", at.alias("d"), "before_m", "length_m", "total_m")
    along = (F.col("before_m") + F.col("d.t") * F.col("length_m")) / F.col("total_m")
    first = F.coalesce(*[F.when(F.col("d.dist_m") <= S.taper_width(along, *w), F.lit(i)) for i, w in enumerate(widths)])
    # filtered behind the aggregate: a filter before it would be pushed below the distance and measure it again
    return rows.select("query_id", "stop_pk", first.alias("width")).groupBy("query_id", "stop_pk").agg(F.min("width").alias("width")).where("width IS NOT NULL")


def tapered(found_paths: DataFrame, stops: DataFrame, near_ends: DataFrame) -> DataFrame:
    """The fallback corridor (query_id, stop_pk, widened): tagged stops and those near the ends; where these are
    fewer than LEAST_STOPS, those of a wider taper. Both widths are measured in one pass."""
    tagged = _tagged(found_paths, stops, (WIDTH_M, TAPER_M), (WIDER_WIDTH_M, WIDER_TAPER_M))
    both = cut(tagged.unionByName(near_ends.select("query_id", "stop_pk", F.lit(0).alias("width"))).groupBy("query_id", "stop_pk").agg(F.min("width").alias("width")))
    enough = both.groupBy("query_id").agg((F.count_if(F.col("width") == 0) >= LEAST_STOPS).alias("enough"))
    return both.join(enough, "query_id").where(~F.col("enough") | (F.col("width") == 0)).select("query_id", "stop_pk", (~F.col("enough")).alias("widened"))


def near_ends(queries: DataFrame, stops: DataFrame, radius_m: float = WALK_RADIUS_M) -> DataFrame:
    """(query_id, stop_pk) within walking distance of either end."""
    ends = queries.selectExpr("query_id", "o_lat AS at_lat", "o_lon AS at_lon").union(queries.selectExpr("query_id", "d_lat", "d_lon"))
    return around(ends, stops, radius_m).select("query_id", "stop_pk").distinct()


def patterns_of(stops: DataFrame, pattern_stops: DataFrame) -> DataFrame:
    """(query_id, pattern_pk) of the patterns that touch a query's stops."""
    return stops.select("query_id", "stop_pk").join(pattern_stops.select("stop_pk", "pattern_pk"), "stop_pk").select("query_id", "pattern_pk").distinct()


def boundary(found_paths: DataFrame, stops: DataFrame, width_m: float = WIDTH_M, taper_m: float = TAPER_M, samples: int = BOUNDARY_SAMPLES) -> DataFrame:
    """(query_id, path_no, sample, left and right points) of each path's outline."""
    parts = segments(polylines(found_paths, stops)).where("total_m > 0")
    rows = parts.select("*", F.explode(F.sequence(F.lit(0), F.lit(samples))).alias("sample")).withColumn("target", F.col("sample") / samples * F.col("total_m"))
    # the first segment that reaches the target, or the last
    reach = F.when(F.col("before_m") + F.col("length_m") >= F.col("target"), F.col("pos"))
    pick = F.coalesce(F.min(reach).over(Window.partitionBy("query_id", "path_no", "sample")), F.max("pos").over(Window.partitionBy("query_id", "path_no", "sample")))
    rows = rows.withColumn("pick", pick).where("pos = pick")
    part = F.when(F.col("length_m") > 0, (F.col("target") - F.col("before_m")) / F.col("length_m")).otherwise(0.0)
    rows = rows.withColumns({"lat": F.col("a_lat") + (F.col("b_lat") - F.col("a_lat")) * part, "lon": F.col("a_lon") + (F.col("b_lon") - F.col("a_lon")) * part})
    wide = F.cos(F.radians("lat")) * S.DEGREE_M
    dx, dy = (F.col("b_lon") - F.col("a_lon")) * wide, (F.col("b_lat") - F.col("a_lat")) * S.DEGREE_M
    length = F.sqrt(dx * dx + dy * dy)
    size = F.when(length == 0, 1.0).otherwise(length)
    width = S.taper_width(F.col("target") / F.col("total_m"), width_m, taper_m)
    d_lat, d_lon = dx / size * width / S.DEGREE_M, -dy / size * width / wide
    return rows.select("query_id", "path_no", "sample", (F.col("lat") + d_lat).alias("left_lat"), (F.col("lon") + d_lon).alias("left_lon"), (F.col("lat") - d_lat).alias("right_lat"), (F.col("lon") - d_lon).alias("right_lon"))


def inside(rows: DataFrame, allowed: DataFrame, whole: DataFrame | None, key: str = "stop_pk") -> DataFrame:
    """rows (query_id, key, ...) that lie in their query's corridor; allowed: distinct (query_id, key). Queries in whole
    (query_id, distinct; None: there are none) keep all their rows."""
    on = ["query_id", key]
    if whole is None:
        return rows.join(allowed.select(*on), on, "left_semi")
    marked = rows.join(allowed.select(*on, F.lit(True).alias("_in")), on, "left").join(whole.select("query_id", F.lit(True).alias("_all")), "query_id", "left")
    return marked.where("_in OR _all").select(*rows.columns)


def resolve(queries: DataFrame, stops: DataFrame, pattern_stops: DataFrame, patterns: DataFrame, edges: DataFrame | None = None) -> dict[str, DataFrame | None]:
    """The corridor of each query: allowed stops, patterns, how it was found ('seed', 'tapered' or 'network'), paths.

    queries: (query_id, o_lat, o_lon, d_lat, d_lon). Seed paths' patterns are taken if there are enough and both ends
    are served; else the tapered corridor; else the whole network. Queries of the whole network have no rows among
    stops and patterns: network names them (None: there are none), and inside() lets all their rows through. Without edges
    the stop graph is that of stops and pattern_stops, of which only the walks that a level takes are made.
    """
    routes = pattern_stops.join(patterns.select("pattern_pk", "agency", "route_id"), "pattern_pk").select("stop_pk", S.make_key(F.col("agency"), F.col("route_id")).alias("route")).distinct()
    origins = cut(seeds(queries.selectExpr("query_id", "o_lat AS at_lat", "o_lon AS at_lon"), stops, routes))
    ends = cut(seeds(queries.selectExpr("query_id", "d_lat AS at_lat", "d_lon AS at_lon"), stops, routes))
    found, tree, hits = levels(ride_edges(pattern_stops), origins, ends, stops=stops) if edges is None else levels(edges, origins, ends)
    lines = cut(paths(found, tree, hits, origins, ends))
    core = lines.select("query_id", F.explode("path").alias("stop_pk")).distinct()
    chosen = cut(patterns_of(core, pattern_stops))
    derived = cut(chosen.join(pattern_stops, "pattern_pk").select("query_id", "stop_pk").distinct())
    walkable = near_ends(queries, stops)
    served = [derived.join(x.select("query_id", "stop_pk"), ["query_id", "stop_pk"], "left_semi").select("query_id").distinct() for x in (origins, ends)]
    good = cut(chosen.groupBy("query_id").count().where(F.col("count") >= LEAST_PATTERNS).select("query_id").join(served[0], "query_id", "left_semi").join(served[1], "query_id", "left_semi"))
    rest = lines.join(good, "query_id", "left_anti")
    buffer = queries.select("query_id", F.lit(0).cast("bigint").alias("stop_pk"), F.lit(False).alias("widened")).limit(0)
    if not rest.isEmpty():
        buffer = cut(tapered(rest, stops, walkable.join(rest.select("query_id").distinct(), "query_id", "left_semi")))
    how = queries.select("query_id").join(good.withColumn("g", F.lit(True)), "query_id", "left").join(buffer.select("query_id").distinct().withColumn("b", F.lit(True)), "query_id", "left")
    how = cut(how.select("query_id", F.when(F.col("g"), "seed").when(F.col("b"), "tapered").otherwise("network").alias("how")))
    network = cut(how.where("how = 'network'").select("query_id").distinct())
    seed_stops = derived.union(walkable).union(core).join(good, "query_id", "left_semi")
    stop_rows = seed_stops.union(buffer.select("query_id", "stop_pk")).distinct()
    pattern_rows = chosen.join(good, "query_id", "left_semi").union(patterns_of(buffer, pattern_stops)).distinct()
    return {"stops": cut(stop_rows), "patterns": cut(pattern_rows), "network": None if network.isEmpty() else network, "how": how, "paths": lines, "origins": origins, "destinations": ends, "levels": found, "tree": tree, "hits": hits}
