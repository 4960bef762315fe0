"""Connected components of a link table, by least labels and pointer jumping on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connect(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, comp): for each node of links (a, b), a label that it shares with all nodes it can reach.

    labels: (node, comp) found before, whose components the links may join; its nodes are in the result as well.
    Each turn every component takes the least label next to it, then labels point to their own labels' labels.
    """
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    if labels is not None:
        links = links.join(labels.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "left").join(labels.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left")
        links = links.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct()
        nodes = nodes.join(labels, "node", "left_anti").select("node", F.col("node").alias("comp")).unionByName(labels.select("node", "comp"))
    else:
        nodes = nodes.select("node", F.col("node").alias("comp"))
    edges = common.checkpoint(links.union(links.select("b", "a")).toDF("a", "b").distinct())
    roots = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp"))
    before = None
    while True:
        near = edges.join(roots.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        least = roots.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = least.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        moved = common.written(least.join(jump, "comp", "left").select("node", "old", F.least("comp", "up").alias("comp")))
        roots = moved.select("node", "comp")
        common.discard(before)
        before = moved
        if moved.where("comp <> old").isEmpty():
            break
    out = nodes.join(roots.select(F.col("node").alias("comp"), F.col("comp").alias("root")), "comp", "left")
    found = common.written(out.select("node", F.coalesce("root", "comp").alias("comp")))
    common.discard(before)
    return found
