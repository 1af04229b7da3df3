"""Exact top-k inner products by Fagin's threshold algorithm.

Candidates are dealt by hash into blocks, queries into blocks, and each pair of blocks is one group of a cogroup: the
query set is a stated share of all rows and meets all rows in blocks, so no task holds more than two blocks. In a
group, the candidate block has one list for each dimension, sorted by component. A query reads its lists from the side
its own sign favours, in rounds of doubling depth; new candidates are scored in full, and it stops when the bound for
anything unread (the sum of its components times the lists' frontiers) falls below the k-th score. Equal scores must
still be read, so the stop is strict. A first pass over one block gives every query a floor, its k-th score there; the
other blocks are left unread where their first frontiers are below the floor, and left early where the bound falls below
it. Each block gives its k best; their union holds the k best of all.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import make_importable, quoted, stored

#: Rows of a candidate block and of a query block.
CANDIDATES, QUERIES = 2048, 2048
FIRST_DEPTH = 16


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component; null for a null vector or one with null or non-finite components."""
    fine = vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of long lists as float64; short ones are padded with zeros."""
    out = np.zeros((len(column), width))
    if len(column):
        flat = column.combine_chunks()
        sizes = flat.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        values = flat.flatten().to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(sizes)), sizes)
        out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def threshold_search(query: np.ndarray, ids: np.ndarray, block: np.ndarray, lists: np.ndarray, own: int, k: int, floor: float | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows and scores of the k best of one block, less such as are below floor, and how many rows were scored.

    lists: for each dimension the rows in ascending order of their component.
    """
    rows, dims = len(ids), np.flatnonzero(query)
    down = query[dims] > 0

    def bound(read: int) -> float:
        return np.where(down, block[lists[rows - read, dims], dims], block[lists[read - 1, dims], dims]) @ query[dims]

    seen = np.zeros(rows, dtype=bool)
    found, scores = np.empty(0, dtype=np.int64), np.empty(0, dtype=block.dtype)
    if floor is not None and bound(1) < floor:
        return found, scores, 0
    depth, read = 0, min(FIRST_DEPTH, rows)
    while True:
        # Sorted access: the next rows of each list, from its best end.
        front = np.concatenate([lists[rows - read : rows - depth, dims[down]].ravel(), lists[depth:read, dims[~down]].ravel()])
        if not len(dims):
            front, read = np.arange(rows), rows
        new = np.unique(front[~seen[front]])
        seen[new] = True
        new = new[ids[new] != own]
        found, scores = np.concatenate([found, new]), np.concatenate([scores, block[new] @ query])
        order = np.lexsort((ids[found], -scores))[:k]
        found, scores = found[order], scores[order]
        if read < rows:
            last = bound(read)
            if (len(found) == k and last < scores[-1]) or (floor is not None and last < floor):
                return found, scores, int(seen.sum())
        else:
            return found, scores, rows
        depth, read = read, min(rows, read * 2)


def _search(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        asked_rows, found_rows, scores_of = [], [], []
        if candidates.num_rows and queries.num_rows:
            width = max(max(t["v"].combine_chunks().value_lengths().to_pylist()) for t in (candidates, queries))
            ids, block, asked = candidates["id"].to_numpy(), matrix(candidates["v"], width), matrix(queries["v"], width)
            most = np.abs(block).max(initial=0) * np.abs(asked).max(initial=0) * max(width, 1)
            if most >= 2.0**53:  # beyond exact doubles: the same search on 64-bit integers
                if most >= 2.0**62:
                    raise OverflowError("scores need more than 62 bits: scale the vectors down")
                block, asked = block.astype(np.int64), asked.astype(np.int64)
            lists = np.argsort(block, axis=0, kind="stable")
            for at, (query, own, floor) in enumerate(zip(asked, queries["id"].to_pylist(), queries["floor"].to_pylist())):
                rows, scores, _ = threshold_search(query, ids, block, lists, own, k, floor)
                asked_rows.append(np.full(len(rows), at))
                found_rows.append(rows)
                scores_of.append(scores.astype(np.int64))
        empty = np.empty(0, np.int64)
        at, rows = np.concatenate([empty, *asked_rows]), np.concatenate([empty, *found_rows])
        columns = [pa.array(np.asarray(t[c].to_numpy())[x] if t.num_rows else empty) for t, c, x in ((queries, "id", at), (queries, "key", at), (candidates, "id", rows), (candidates, "n", rows))]
        return pa.table([*columns, pa.array(np.concatenate([empty, *scores_of]))], schema=_FOUND)

    return run


_FOUND = pa.schema([(c, pa.int64()) for c in ("query_id", "key", "vec_id", "n", "score")])


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is_query marks, the k rows of highest integer inner product but itself.

    Components become floor(scale * x). Ties go to the smaller vec_id; fewer than k candidates give them all. Null
    vectors and those with null or non-finite components take no part, nor do rows with a null id; vectors of unequal
    length meet as if padded with zeros. Repeated rows are candidates of their own each; equal query rows are one query,
    different vectors under one id are queries of their own, and no row is a candidate of a query with its id. Empty
    tables give an empty result. Scores are exact up to 62 bits; larger ones fail loudly.
    """
    make_importable(vectors.sparkSession)
    all_rows = stored(
        vectors.select(quoted(vec_id).cast("long").alias("id"), integers(quoted(vector), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
        .where("id is not null and v is not null").groupBy("id", "v").agg(F.count("*").alias("n"), F.max("q").alias("q"))
    )
    counts = all_rows.agg(F.count("*").alias("n"), F.count_if("q").alias("q")).first()
    blocks, query_blocks = max(1, math.ceil(counts["n"] / CANDIDATES)), max(1, math.ceil(counts["q"] / QUERIES))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    spread = lambda low, high: F.explode(F.sequence(F.lit(low), F.lit(high)))
    candidates = all_rows.select("id", "v", "n", dealt(blocks).alias("cb"))
    # Aliases tell the two sides of the cogroup apart.
    queries = all_rows.where("q").select(F.col("id").alias("id"), F.col("v").alias("v"), F.xxhash64("v").alias("key"), dealt(query_blocks).alias("qb"))

    def searched(held: DataFrame, asked: DataFrame) -> DataFrame:
        repeated = held.select("*", spread(0, query_blocks - 1).alias("qb"))
        return repeated.groupBy("cb", "qb").cogroup(asked.groupBy("cb", "qb")).applyInArrow(_search(k), ", ".join(f"{c} long" for c in _FOUND.names))

    first = stored(searched(candidates.where("cb = 0"), queries.select("*", F.lit(0).alias("cb"), F.lit(None).cast("long").alias("floor"))))
    local = first
    if blocks > 1:
        floors = first.groupBy(F.col("query_id").alias("id"), "key").agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
        seeded = queries.join(floors, ["id", "key"], "left").select("id", "v", "key", "qb", "floor", spread(1, blocks - 1).alias("cb"))
        local = first.unionByName(searched(candidates.where("cb > 0"), seeded))
    best = W.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    each = local.select("query_id", "key", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(k)))))
    return each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
