"""Approximate nearest neighbours by an adaptive dimension scan over probed lists.

A spherical k-means on a bounded sample gives the lists, of about LIST_ROWS vectors each as long as there are at most
MOST_LISTS of them: the sample grows with the table from LEAST_FIT to MOST_FIT vectors, EACH to a list. Every vector
goes to the list of its nearest centre. How many of its nearest lists a query probes is calibrated on 256 of the sample, drawn at random, against
their exact neighbours in it, so that data with clusters probe few lists and data without probe many. Vectors are rotated by a random orthogonal
matrix and scanned in blocks of columns: after each block a hypothesis test compares the partial distance, scaled up
to all dimensions, with the distance of the k-th nearest so far, and abandons candidates that are surely farther (the
k that this distance comes from always stay). The rest get their exact cosine in double precision on the original vectors.

Lists are dealt out in cells of about CELL vectors and CELL queries, so that a list with a third of all rows (or of
all queries) is scanned by many tasks. Each task holds one cell's vectors; queries stream past them.

Defined results: vectors that are null, zero, or hold null or non-finite components, rows without an id, and vectors
of another length than most of the table take no part. Rows of one id count once. Ties go to the smaller id. Fewer
candidates than k give fewer rows; an empty table gives none. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_FIT, MOST_FIT, EACH, LIST_ROWS, MOST_LISTS, CELL, ROUNDS = 8192, 65_536, 8, 512, 8192, 2048, 8
MOST_FIT_BYTES = 64 << 20  # of these vectors as doubles
AIM, LEAST_CANDIDATES, COLUMNS, SLACK = 0.97, 256, 16, 2.1
FIXED_SEED = 20240


@dataclass
class Index:
    dims: int
    centres: np.ndarray
    rotation: np.ndarray
    probes: int


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each unit vector."""
    return np.concatenate([(x[s : s + 1024] @ centres.T).argmax(axis=1) for s in range(0, len(x), 1024)]) if len(x) else np.zeros(0, np.int64)


def _usable(ids: pa.Array, vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors (doubles) of the rows that take part."""
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    good = (lengths == dims) & ids.is_valid().to_numpy(zero_copy_only=False)
    if not good.any():
        return np.zeros(0, np.int64), np.zeros((0, dims))
    chosen = pa.array(good)
    x = vectors.filter(chosen).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dims)
    i = ids.filter(chosen).cast(pa.int64()).to_numpy(zero_copy_only=False)
    most = np.abs(x).max(axis=1) if dims else np.zeros(len(x))
    fine = np.isfinite(x).all(axis=1) & (most > 0)
    x, i, most = x[fine], i[fine], most[fine]
    odd = (most > 1e100) | (most < 1e-100)  # squares would leave the range of doubles; cosines don't change
    return i, np.where(odd[:, None], x / most[:, None], x)


def build(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5) -> Index | None:
    """Centres and the number of probed lists, from the vectors of the commonest length that come first by a hash of their
    id: MOST_FIT of them at most, and as many as MOST_FIT_BYTES hold."""
    held = vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(vector_col).alias("v"))
    common_length = held.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), F.desc("dims")).first()
    if common_length is None:
        return None
    n, dims = common_length["k"], common_length["dims"]
    fit = int(np.clip(n // LIST_ROWS * EACH, LEAST_FIT, min(MOST_FIT, max(MOST_FIT_BYTES // (8 * max(dims, 1)), 256))))
    sample = held.where(F.size("v") == dims).orderBy(F.xxhash64("i"), "i").limit(fit).toArrow()
    rng = np.random.default_rng(FIXED_SEED)
    ids, x = _usable(sample.column("i").combine_chunks(), sample.column("v").combine_chunks(), dims)
    if not len(x):
        return None
    x = _unit(x[np.unique(ids, return_index=True)[1]])
    lists = int(np.clip(n // LIST_ROWS, 1, min(MOST_LISTS, max(len(x) // EACH, 1))))
    centres = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(ROUNDS):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        size = np.sqrt((sums * sums).sum(axis=1))
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-12)[:, None], centres)
    near = _nearest(x, centres)
    own = np.random.default_rng(FIXED_SEED).choice(len(x), min(len(x), 256), replace=False)  # x is in order of ids
    asked = x[own]
    close = asked @ x.T
    close[np.arange(len(asked)), own] = -2
    best = np.argsort(-close, axis=1, kind="stable")[:, :k]
    order = np.argsort(-(asked @ centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(lists)[None].repeat(len(asked), 0), axis=1)
    needed = np.sort(np.take_along_axis(place, near[best], axis=1).ravel())  # the place of each neighbour's list
    probes = int(needed[min(int(AIM * len(needed)), len(needed) - 1)]) + 1
    rotation = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
    return Index(dims, centres, rotation, min(probes, lists))


def _probed(index: Index, q: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which lists each query probes: its nearest `probes`, and more while they hold too few vectors."""
    order = np.argsort(-(_unit(q) @ index.centres.T), axis=1, kind="stable")
    held = np.cumsum(sizes[order], axis=1) - sizes[order]
    chosen = (np.arange(len(sizes)) < index.probes) | (held < LEAST_CANDIDATES)
    out = np.zeros_like(chosen)
    np.put_along_axis(out, order, chosen, axis=1)
    return out


def scan(index: Index, ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int):
    """(query, id, score) of each query's k nearest among x, itself left out."""
    unit, asked = _unit(x), _unit(q)
    rotated, r = (unit @ index.rotation).astype("f4"), (asked @ index.rotation).astype("f4")
    own = q_ids[:, None] == ids[None, :]
    blocks = [slice(s, min(s + COLUMNS, index.dims)) for s in range(0, index.dims, COLUMNS)]
    squares = [(rotated[:, b] ** 2).sum(axis=1) for b in blocks]
    part = np.maximum(squares[0] + (r[:, blocks[0]] ** 2).sum(axis=1, keepdims=True) - 2 * r[:, blocks[0]] @ rotated[:, blocks[0]].T, 0)
    part[own] = np.inf
    few = min(k, len(x))
    seeds = np.argpartition(part, few - 1, axis=1)[:, :few]
    whole = ((rotated[seeds] - r[:, None]) ** 2).sum(axis=2)
    whole[np.take_along_axis(own, seeds, axis=1)] = np.inf
    bound = whole.max(axis=1)  # of the k-th nearest so far, at most
    stays = np.zeros(part.shape, bool)
    np.put_along_axis(stays, seeds, True, axis=1)
    seen = blocks[0].stop
    row, col = np.nonzero((stays | (part * (index.dims / seen) <= bound[:, None] * (1 + SLACK / np.sqrt(seen)) ** 2 + 1e-6)) & ~own)
    left, seed = part[row, col], stays[row, col]
    for b in blocks[1:]:  # the columns of the next block, for those still in
        left = left + ((rotated[col, b] - r[row, b]) ** 2).sum(axis=1)
        seen = b.stop
        slack = (1 + SLACK / np.sqrt(seen)) ** 2 if seen < index.dims else 1.0
        stay = seed | (left * (index.dims / seen) <= bound[row] * slack + 1e-5)
        row, col, left, seed = row[stay], col[stay], left[stay], seed[stay]
    a, c = q[row], x[col]
    score = (a * c).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((c * c).sum(axis=1)))
    order = np.lexsort((ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return q_ids[row[rank < k]], ids[col[rank < k]], score[rank < k]


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row that is_query marks, among all other rows."""
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    index = build(vectors, id_col, vector_col, k)
    if index is None:
        return spark.createDataFrame([], result)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    lists = len(index.centres)
    everything = np.full(lists, LEAST_CANDIDATES)

    def counted(batches):
        held, asked = np.zeros(lists, np.int64), np.zeros(lists, np.int64)
        for batch in batches:
            ids, x = _usable(batch.column(0), batch.column(1), index.dims)
            if not len(x):
                continue
            held += np.bincount(_nearest(_unit(x), index.centres), minlength=lists)
            q = _usable(batch.filter(batch.column(2)).column(0), batch.filter(batch.column(2)).column(1), index.dims)[1]
            if len(q):
                asked += _probed(index, q, everything).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(lists)), pa.array(held), pa.array(asked)], names=["list", "held", "asked"])

    sums = rows.mapInArrow(counted, "list long, held long, asked long").groupBy("list").agg(F.sum("held").alias("held"), F.sum("asked").alias("asked")).collect()  # a row for each list: MOST_LISTS at most
    sizes, loads = np.zeros(lists, np.int64), np.zeros(lists, np.int64)
    for r in sums:
        sizes[r["list"]], loads[r["list"]] = r["held"], r["asked"]
    v_parts, q_parts = np.maximum(-(-sizes // CELL), 1), np.maximum(-(-loads // CELL), 1)
    cell_of = np.concatenate([[0], np.cumsum(v_parts * q_parts)])

    def dealt(batches):
        for batch in batches:
            ids, x = _usable(batch.column(0), batch.column(1), index.dims)
            if len(x):
                of = _nearest(_unit(x), index.centres)
                copies = q_parts[of]
                row = np.repeat(np.arange(len(x)), copies)
                turn = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
                yield cells(cell_of[of[row]] + (ids[row] * 2654435761 % 2**31) % v_parts[of[row]] * q_parts[of[row]] + turn, 0, ids[row], x[row])
            asked = batch.filter(batch.column(2))
            ids, q = _usable(asked.column(0), asked.column(1), index.dims)
            for s in range(0, len(q), 64):
                row, of = np.nonzero(_probed(index, q[s : s + 64], sizes))
                copies = v_parts[of]
                turn = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                row, of = np.repeat(row, copies), np.repeat(of, copies)
                yield cells(cell_of[of] + turn * q_parts[of] + (ids[s + row] * 2654435761 % 2**31) % q_parts[of], 1, ids[s + row], q[s + row])

    def cells(cell: np.ndarray, kind: int, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        flat = pa.array(np.ascontiguousarray(x).ravel())
        vectors_ = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, index.dims, dtype=np.int32)), flat)
        return pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(np.full(len(ids), kind, np.int32)), pa.array(ids), vectors_], names=["cell", "kind", "id", "v"])

    def scanned(batches):
        cell, ids, x = -1, [], []
        ready = None
        for batch in batches:
            all_cells, kinds, all_ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            all_x = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, index.dims)
            cuts = np.flatnonzero(np.diff(all_cells) | np.diff(kinds)) + 1
            for a, b in zip(np.append(0, cuts), np.append(cuts, len(all_cells)), strict=True):
                if all_cells[a] != cell:
                    cell, ids, x, ready = all_cells[a], [], [], None
                if kinds[a] == 0:
                    ids.append(all_ids[a:b])
                    x.append(all_x[a:b])
                    continue
                if not ids:
                    continue
                if ready is None:
                    own, first = np.unique(np.concatenate(ids), return_index=True)
                    ready = own, np.concatenate(x)[first]
                for s in range(a, b, 256):
                    q_ids, first = np.unique(all_ids[s : min(s + 256, b)], return_index=True)
                    found = scan(index, *ready, q_ids, all_x[s : min(s + 256, b)][first], k)
                    yield pa.RecordBatch.from_arrays([pa.array(f) for f in found], names=["query_id", "vec_id", "score"])

    dealt_out = rows.mapInArrow(dealt, "cell long, kind int, id long, v array<double>").repartition("cell").sortWithinPartitions("cell", "kind", "id")
    found = dealt_out.mapInArrow(scanned, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    nearest = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", nearest).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
