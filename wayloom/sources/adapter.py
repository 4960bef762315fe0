"""Transit tables made from general tables by integer arithmetic, for queries that other engines can repeat.

Each view is one SELECT that Spark and DuckDB read alike; `{name}` stands for a table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("customer", "orders", "lineitem", "nation", "events")
VIEWS = {
    "t_stops": """
        SELECT CAST(c_custkey + 1 AS BIGINT) AS stop_pk, concat('S:', c_custkey) AS stop_id, concat('Stop ', c_custkey) AS stop_name,
               CAST(-37900000 + ((c_custkey * c_custkey * 31 + c_custkey * 7919) % 1009) * 180 AS BIGINT) AS stop_lat,
               CAST(144900000 + ((c_custkey * c_custkey * 17 + c_custkey * 104729) % 1013) * 220 AS BIGINT) AS stop_lon,
               CAST(1 AS BIGINT) AS agency
        FROM {customer}""",
    "t_pattern_stops": """
        SELECT CAST(2 * a.r + d.d + 1 AS BIGINT) AS pattern_pk,
               CAST(((37 * a.r + b.k * (a.r % 11 + 1)) % m.m) + 1 AS BIGINT) AS stop_pk,
               CAST(CASE WHEN d.d = 0 THEN b.k + 1 ELSE 12 - b.k END AS BIGINT) AS stop_sequence
        FROM range(0, 60) a(r) CROSS JOIN range(0, 12) b(k) CROSS JOIN range(0, 2) d(d)
        CROSS JOIN (SELECT least(count(*), 600) AS m FROM {customer}) m""",
    "t_trips": """
        SELECT CAST(o_orderkey + 1 AS BIGINT) AS trip_pk, concat('T', o_orderkey) AS trip_id, CAST(1 AS BIGINT) AS agency,
               CAST(o_custkey % 120 + 1 AS BIGINT) AS pattern_pk, o_orderpriority AS service_id
        FROM {orders}""",
    "t_patterns": """
        SELECT CAST(2 * a.r + d.d + 1 AS BIGINT) AS pattern_pk, concat('aus:', a.r) AS route_id, CAST(1 AS BIGINT) AS agency,
               CAST(d.d AS BIGINT) AS direction_id,
               CASE WHEN (2 * a.r + d.d + 1) % 4 = 0 THEN NULL ELSE concat('sh:', 2 * a.r + d.d + 1) END AS shape_id, f.trip_pk
        FROM range(0, 60) a(r) CROSS JOIN range(0, 2) d(d)
        LEFT JOIN (SELECT pattern_pk, min(trip_pk) AS trip_pk FROM {t_trips} GROUP BY pattern_pk) f ON f.pattern_pk = 2 * a.r + d.d + 1""",
    "t_routes": """
        SELECT concat('aus:', r) AS route_id, CASE WHEN r % 4 = 0 THEN '' ELSE concat('R', r) END AS route_short_name,
               concat('Line ', r) AS route_long_name,
               CAST(CASE r % 13 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 WHEN 5 THEN 5 WHEN 6 THEN 6 WHEN 7 THEN 7
                    WHEN 8 THEN 11 WHEN 9 THEN 12 WHEN 10 THEN 400 WHEN 11 THEN 700 ELSE 1650 END AS BIGINT) AS route_type,
               CASE r % 3 WHEN 0 THEN concat('ff00', lpad(CAST(r AS VARCHAR(9)), 2, '0')) WHEN 1 THEN concat('#00ff', lpad(CAST(r AS VARCHAR(9)), 2, '0')) ELSE 'bad' END AS route_color,
               CAST(1 AS BIGINT) AS agency
        FROM range(0, 60) a(r)""",
    "t_stop_times": """
        SELECT t.trip_pk, p.stop_sequence, p.stop_pk,
               CAST((t.trip_pk * 61) % 72000 + 14400 + (p.stop_sequence - 1) * 180 AS BIGINT) AS arrival_sec,
               CAST((t.trip_pk * 61) % 72000 + 14400 + (p.stop_sequence - 1) * 180 + 20 AS BIGINT) AS departure_sec
        FROM {t_trips} t JOIN {t_pattern_stops} p ON p.pattern_pk = t.pattern_pk""",
    "t_services": """
        SELECT o_orderpriority AS service_id, CAST(row_number() OVER (ORDER BY o_orderpriority) AS BIGINT) AS sid
        FROM (SELECT DISTINCT o_orderpriority FROM {orders}) s""",
    "t_calendar": """
        SELECT service_id, CAST(1 AS BIGINT) AS agency,
               CAST(CASE WHEN sid % 3 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS sunday, CAST(CASE WHEN (sid + 1) % 3 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS monday,
               CAST(CASE WHEN (sid + 2) % 3 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS tuesday, CAST(CASE WHEN (sid + 3) % 3 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS wednesday,
               CAST(CASE WHEN (sid + 4) % 3 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS thursday, CAST(CASE WHEN (sid + 5) % 3 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS friday,
               CAST(CASE WHEN (sid + 6) % 3 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS saturday,
               '19950101' AS start_date, '20011231' AS end_date
        FROM {t_services}""",
    "t_calendar_dates": """
        SELECT s.service_id, CAST(1 AS BIGINT) AS agency, concat('199806', lpad(CAST(n_nationkey + 1 AS VARCHAR(9)), 2, '0')) AS date,
               CAST(n_nationkey % 2 + 1 AS BIGINT) AS exception_type
        FROM {nation} n JOIN {t_services} s ON s.sid = n_nationkey % 5 + 1""",
    "t_shapes": """
        SELECT p.pattern_pk AS shape_pk, s.stop_lat + j.j * 150 AS shape_pt_lat, s.stop_lon + j.j * 150 AS shape_pt_lon,
               CAST((p.stop_sequence - 1) * 3 + j.j + 1 AS BIGINT) AS shape_pt_sequence
        FROM {t_pattern_stops} p JOIN {t_stops} s ON s.stop_pk = p.stop_pk CROSS JOIN range(0, 3) j(j)
        WHERE p.pattern_pk % 4 <> 0""",
    "t_raw_stop_times": """
        SELECT CAST(l_orderkey + 1 AS BIGINT) AS trip_pk,
               CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS BIGINT) AS stop_sequence,
               CAST(l_suppkey % 3 + 1 AS BIGINT) AS stop_pk
        FROM {lineitem}""",
}


def _needs(name: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", VIEWS[name])))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(VIEWS[name], **{n: view(spark, sf_dir, n) for n in _needs(name)})


def with_views(*names: str, recursive: bool = False) -> str:
    """The WITH clause that defines views, and those that they need, for another engine."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in TABLES and name not in order:
            for n in _needs(name):
                add(n)
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + "RECURSIVE " * recursive + ",\n".join(f"{n} AS ({re.sub(r'[{}]', '', VIEWS[n])})" for n in order)
