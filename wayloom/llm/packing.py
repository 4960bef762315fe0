"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

A document longer than a bin fills whole bins with its first words; its last piece is packed like the others. Bins
stand in order of their residual room and carry bitmaps of the sources and duplicate clusters that they hold. For
each piece, longest first, successor search starts at the least residual that can hold it and goes on to larger
ones until a bin has no conflict: the same duplicate cluster never meets itself in a bin, and a source has at most
`per_source` pieces in a bin. If none is left, a new bin opens.

Spark deals the pieces out to shards of about `shard_rows` pieces by a hash of id and cluster, so that any source or
cluster is spread over all shards and each shard is a bounded group. Rows that agree in both more than HOT times are
spread by their place in the table as well. Only ids, sizes and hashes travel; no text is shuffled.

Defined results: null or blank texts take no room: one row, no bin. A null source counts as a source. Repeated rows
are packed each for itself, in different bins (they are one cluster). An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

CAPACITY, PER_SOURCE, SHARD_ROWS, HOT = 4096, 4, 4000, 50
SCHEMA = "doc_id long, piece long, first_word long, n_words long, bin_id long, bin_words long"


def best_fit(sizes: Iterable[int], sources: Iterable[int], clusters: Iterable[int], capacity: int, per_source: int) -> list[int]:
    """The bin of each piece, for pieces in the order given."""
    rooms: list[tuple[int, int]] = []  # (residual, bin), in order
    planes: list[list[int]] = []  # of each bin: bitmaps of the sources with at least 1, 2, ... pieces
    held: list[int] = []  # of each bin: a bitmap of clusters
    placed = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        source_bit, cluster_bit = 1 << source, 1 << cluster
        at = bisect_left(rooms, (size, -1))
        while at < len(rooms) and (held[rooms[at][1]] & cluster_bit or planes[rooms[at][1]][-1] & source_bit):
            at += 1
        if at < len(rooms):
            room, chosen = rooms.pop(at)
        else:
            room, chosen = capacity, len(held)
            held.append(0)
            planes.append([0] * per_source)
        held[chosen] |= cluster_bit
        for k, plane in enumerate(planes[chosen]):
            if not plane & source_bit:
                planes[chosen][k] |= source_bit
                break
        if room > size:
            insort(rooms, (room - size, chosen))
        placed.append(chosen)
    return placed


def cluster_of(text: Column) -> Column:
    """Documents with the same words, case and spacing aside, are duplicates of each other."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), common.GAP, " ")))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster: Column | None = None, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each piece: doc_id, piece, first_word, n_words, bin_id, bin_words (the words in that bin)."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        common.n_words(F.col(text_col)).alias("size"),
        F.xxhash64(F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit(""))).alias("source"),
        (cluster_of(F.col(text_col)) if cluster is None else F.xxhash64(cluster)).alias("cluster"),
    )
    rows = common.checkpoint(rows.withColumns({"key": F.xxhash64("doc_id", "cluster", F.lit(7)), "place": F.monotonically_increasing_id()}))
    n_shards = max(1, -(-rows.count() // shard_rows))
    hot = rows.groupBy("key").count().where(F.col("count") > HOT).select("key", F.lit(True).alias("hot"))
    rows = rows.join(hot, "key", "left").withColumn("shard", F.pmod(F.when(F.col("hot"), F.xxhash64("key", "place")).otherwise(F.col("key")), F.lit(n_shards))).drop("key", "place", "hot")

    def pack_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        pdf = pdf.sort_values(["size", "doc_id", "cluster"], ascending=[False, True, True], kind="stable")
        out, taken = [], 0
        last = pdf["size"] % capacity
        ends = pdf[last > 0].assign(last=last[last > 0]).sort_values(["last", "doc_id", "cluster"], ascending=[False, True, True], kind="stable")
        bins = best_fit(ends["last"].tolist(), pd.factorize(ends["source"])[0].tolist(), pd.factorize(ends["cluster"])[0].tolist(), capacity, per_source)
        taken = max(bins, default=-1) + 1
        if len(ends):
            whole = (ends["size"] // capacity).to_numpy()
            out.append(pd.DataFrame({"doc_id": ends["doc_id"].to_numpy(), "piece": whole, "first_word": whole * capacity, "n_words": ends["last"].to_numpy(), "bin_id": bins}))
        long = pdf[pdf["size"] >= capacity]
        if len(long):
            whole = (long["size"] // capacity).to_numpy()
            ids = long["doc_id"].repeat(whole)
            piece = pd.Series(whole).map(range).explode().to_numpy().astype("int64")
            out.append(pd.DataFrame({"doc_id": ids.to_numpy(), "piece": piece, "first_word": piece * capacity, "n_words": capacity, "bin_id": range(taken, taken + len(piece))}))
        packed = pd.concat(out) if out else pd.DataFrame({k: pd.Series(dtype="int64") for k in ("doc_id", "piece", "first_word", "n_words", "bin_id")})
        packed["bin_words"] = packed.groupby("bin_id")["n_words"].transform("sum")
        packed["bin_id"] = packed["bin_id"].astype("int64") + (shard << 32)
        none = pdf[pdf["size"] == 0]
        if len(none):
            packed = pd.concat([packed.astype({"bin_id": "Int64", "bin_words": "Int64"}), pd.DataFrame({"doc_id": none["doc_id"].to_numpy(), "piece": 0, "first_word": 0, "n_words": 0, "bin_id": pd.array([None] * len(none), "Int64"), "bin_words": pd.array([None] * len(none), "Int64")})])
        return packed

    return rows.groupBy("shard").applyInPandas(pack_shard, SCHEMA)
