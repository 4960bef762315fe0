"""Convex hulls of groups of points."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The corners of the convex hull, counter-clockwise; all points if there are fewer than three."""
    ordered = sorted(set(points))
    if len(ordered) < 3:
        return ordered

    def half(path):
        kept: list[tuple[float, float]] = []
        for p in path:
            while len(kept) > 1 and (kept[-1][0] - kept[-2][0]) * (p[1] - kept[-2][1]) - (kept[-1][1] - kept[-2][1]) * (p[0] - kept[-2][0]) <= 0:
                kept.pop()
            kept.append(p)
        return kept[:-1]

    return half(ordered) + half(reversed(ordered))


def convex_hulls(points: DataFrame, parts: int = 64) -> DataFrame:
    """(group_id, corner_no, lat, lon). Each part of a group is reduced to its own hull first, so that no task holds
    a whole group; the hull of these hulls is the group's."""
    schema = "group_id long, lat double, lon double"

    def reduce_part(pdf: pd.DataFrame) -> pd.DataFrame:
        corners = hull(list(zip(pdf["lon"], pdf["lat"], strict=True)))
        return pd.DataFrame({"group_id": pdf["group_id"].iloc[0], "lat": [c[1] for c in corners], "lon": [c[0] for c in corners]})

    few = points.withColumn("part", F.pmod(F.xxhash64("lat", "lon"), F.lit(parts))).groupBy("group_id", "part").applyInPandas(lambda pdf: reduce_part(pdf), schema)
    whole = few.groupBy("group_id").applyInPandas(lambda pdf: reduce_part(pdf).assign(corner_no=lambda d: range(len(d))), schema + ", corner_no long")
    return whole.withColumn("corner_no", F.row_number().over(Window.partitionBy("group_id").orderBy("corner_no")))
