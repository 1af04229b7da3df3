"""Embedding near-dedup by collision counting over sorted one-dimensional projections.

Equal vectors are merged into classes first, so a group of copies of any size is one row. A window on a single projection
holds a fixed share of all rows (a third at a cosine of 0.95 in 64 dimensions), so windows over the whole table would
collide for a fixed share of all pairs. The lists are therefore sorted region by region: repeated sign patterns of random
projections, coarse windows themselves, make regions whose number of bits follows the table's size and whose number of
repeats is calculated so that a pair at the threshold meets in one of them with probability RECALL. In a region every
projection (orthonormal directions) is sorted, every vector opens a window of fixed half-width around its own place in
each sorted list, and collisions are counted for each pair. Pairs that collide on enough projections are verified by their
cosine in double precision. Enough is calibrated: the count that a pair at the threshold reaches with probability RECALL,
or less if the true pairs of SAMPLE rows, compared with all rows, reach less. A region over BLOCK rows is split into
blocks that meet pairwise, whatever its size: nothing is capped. A pair counts in the first repeat where it meets. Tasks
return link counts and a spanning forest for each region, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import make_importable, map_rows, quoted, stored
from .components import connected_components

#: Wanted rows of a region, most rows of a block, projections, half-width in standard deviations at the threshold.
REGION, BLOCK, PROJECTIONS, WIDTH = 512, 1024, 16, 2.0
RECALL = 0.9999
#: Rows whose true pairs with all rows calibrate the collision count.
SAMPLE = 64
SEED = 20240


def plan(n: int, threshold: float) -> tuple[int, int]:
    """Bits of a sign pattern and repeats for n rows."""
    bits = max(0, math.ceil(math.log2(max(n, 1) / REGION)))
    same = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    repeats = 1 if same >= 1 else max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - same)))
    return bits, repeats


def collisions_needed(projections: int) -> int:
    """The greatest count that a pair at the threshold reaches with probability RECALL."""
    p, below = math.erf(WIDTH / math.sqrt(2)), 0.0
    for count in range(projections + 1):
        below += math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if below > 1 - RECALL:
            return count
    return projections


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row reachable from each of n rows over the pairs (a, b)."""
    low = np.arange(n)
    while True:
        new = low.copy()
        least = np.minimum(low[a], low[b])
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = np.minimum(new, new[new])
        if np.array_equal(new, low):
            return low
        low = new


def _features(vec: str) -> Callable:
    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            out: list[bytes | None] = []
            for v in batch.column(batch.schema.get_field_index(vec)).to_pylist():
                x = np.array(v, dtype=np.float64) if v and None not in v else None
                norm = np.linalg.norm(x / np.abs(x).max()) * np.abs(x).max() if x is not None and np.isfinite(x).all() and np.abs(x).max() > 0 else 0.0
                out.append((x / norm).tobytes() if norm > 0 and math.isfinite(norm) else None)
            return [pa.array(out, pa.binary())]

        return work

    return make


def _signs(bits: int, repeats: int) -> Callable:
    """The sign patterns of each unit vector, one for each repeat, as longs."""

    def make():
        known: dict[int, np.ndarray] = {}

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            units = batch.column(batch.schema.get_field_index("unit")).to_pylist()
            out = []
            for u in units:
                x = np.frombuffer(u)
                if len(x) not in known:
                    known[len(x)] = np.random.default_rng(SEED).normal(size=(len(x), max(1, bits) * repeats))
                side = (x @ known[len(x)] > 0)[: bits * repeats].reshape(repeats, bits) if bits else np.zeros((repeats, 0), bool)
                out.append(side @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(repeats, np.int64))
            offsets = np.arange(len(out) + 1, dtype=np.int32) * repeats
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out) if out else np.empty(0, np.int64), pa.int64()))]

        return work

    return make


def _spots(units: np.ndarray) -> np.ndarray:
    """Places on each projection: at most PROJECTIONS orthonormal directions."""
    d = units.shape[1]
    return (units @ np.linalg.qr(np.random.default_rng(SEED + 1).normal(size=(d, min(PROJECTIONS, d))))[0]).astype(np.float32)


def half_width(d: int, threshold: float) -> np.float32:
    return np.float32(WIDTH * math.sqrt(max(0.0, 2 - 2 * threshold) / d) + 1e-6)


def _collisions(queries: np.ndarray, listed: np.ndarray, half: np.float32) -> np.ndarray:
    """Of each query and listed row, the number of projections where the row lies in the query's window of the sorted list."""
    count, place = np.zeros((len(queries), len(listed)), dtype=np.uint8), np.empty(len(listed), np.uint32)
    for p in range(queries.shape[1]):
        order = np.argsort(listed[:, p], kind="stable")
        line = listed[order, p]
        place[order] = np.arange(len(listed), dtype=np.uint32)
        begin = np.searchsorted(line, queries[:, p] - half, "left").astype(np.uint32)
        end = np.searchsorted(line, queries[:, p] + half, "right").astype(np.uint32)
        count += place[None, :] - begin[:, None] < (end - begin)[:, None]  # places before begin wrap around
    return count


def calibrate(classes: DataFrame, threshold: float) -> dict[int, int]:
    """Collisions needed for each number of projections that the true pairs of SAMPLE rows show, compared with all rows; at most the calculated count."""
    sample = [(r["id"], np.frombuffer(r["unit"])) for r in classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]
    shared = classes.sparkSession.sparkContext.broadcast(sample)  # SAMPLE rows

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_width: dict[int, list] = {}
        for i, u in shared.value:
            by_width.setdefault(len(u), []).append((i, u))
        for batch in batches:
            ids, units = batch.column("id").to_numpy(), [np.frombuffer(u) for u in batch.column("unit").to_pylist()]
            for d, asked in by_width.items():
                rows = [k for k, u in enumerate(units) if len(u) == d]
                if not rows:
                    continue
                listed, queries = np.stack([units[k] for k in rows]), np.stack([u for _, u in asked])
                true = queries @ listed.T >= threshold
                true &= np.array([i for i, _ in asked])[:, None] != ids[rows][None, :]
                if true.any():
                    found = _collisions(_spots(queries), _spots(listed), half_width(d, threshold))[true].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), min(PROJECTIONS, d))), pa.array(found)], names=["m", "collided"])

    needed = {}
    seen = classes.select("id", "unit").mapInArrow(counts, "m long, collided long").groupBy("m", "collided").agg(F.count("*").alias("n")).collect()  # PROJECTIONS squared rows at most
    for m in {r["m"] for r in seen}:
        hist = {r["collided"]: r["n"] for r in seen if r["m"] == m}
        total = sum(hist.values())
        reached = [c for c in range(m + 1) if sum(n for k, n in hist.items() if k >= c) >= RECALL * total]
        needed[m] = min(collisions_needed(m), max(reached))
    return needed


def _links(threshold: float, repeats: int, needed: dict[int, int]) -> Callable[[pa.Table], pa.Table]:
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, weight = table["id"].to_numpy(), table["n"].to_numpy()
        units = np.stack([np.frombuffer(u) for u in table["unit"].to_pylist()])
        codes = table["codes"].combine_chunks().flatten().to_numpy().reshape(len(ids), repeats)
        turn, i, j = (table[c][0].as_py() for c in ("t", "i", "j"))
        block = table["block"].to_numpy()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        spots, half = _spots(units), half_width(units.shape[1], threshold)
        m = spots.shape[1]
        need = needed.get(m, collisions_needed(m))
        found_a, found_b = [], []
        for at in range(0, len(left), 256):
            rows = left[at : at + 256]
            x, y = np.nonzero(_collisions(spots[rows], spots[right], half) >= need)
            a, b = rows[x], right[y]
            keep = a < b if i == j else a != b
            a, b = a[keep], b[keep]
            for part in range(0, len(a), 65536):
                pa_, pb = a[part : part + 65536], b[part : part + 65536]
                same = np.einsum("ij,ij->i", units[pa_], units[pb]) >= threshold
                pa_, pb = pa_[same], pb[same]
                first = ~(codes[pa_, :turn] == codes[pb, :turn]).any(axis=1)
                found_a.append(pa_[first])
                found_b.append(pb[first])
        a = np.concatenate(found_a) if found_a else np.empty(0, np.int64)
        b = np.concatenate(found_b) if found_b else np.empty(0, np.int64)
        links = np.bincount(a, weight[b], len(ids)) + np.bincount(b, weight[a], len(ids))
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        root = ids[order][forest(len(ids), place[a], place[b])][place]
        on = np.flatnonzero(links > 0)
        return pa.table([pa.array(ids[on]), pa.array(links[on].astype(np.int64)), pa.array(root[on])], schema=schema)

    return run


def near_vectors(df: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for each row of df: vec_id, n_links, component_id, kept.

    n_links counts the other rows at a cosine of at least threshold, component_id is the smallest id reachable over
    links (itself included), kept marks the row that is its component's id. Null and zero vectors and those with null or
    non-finite components link with nothing, nor do vectors of unequal length with each other. Rows that share an id
    are one node of the graph. A row with a null id links with nothing, has no component and is kept. An empty table
    gives an empty result.
    """
    make_importable(df.sparkSession)
    rows = df.select(quoted(vec_id).cast("long").alias("vec_id"), quoted(vector).alias("vector"))
    rows = map_rows(rows, [T.StructField("unit", T.BinaryType())], _features("vector")).drop("vector")
    rows = stored(rows.withColumn("unit", F.when(F.col("vec_id").isNotNull(), F.col("unit"))))
    usable = rows.where("unit is not null")
    key = [F.xxhash64("unit").alias("ha"), F.xxhash64(F.lit(1), "unit").alias("hb")]
    classes = stored(usable.select("*", *key).groupBy("ha", "hb").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("unit").alias("unit")))
    bits, repeats = plan(classes.count(), threshold)
    coded = stored(map_rows(classes, [T.StructField("codes", T.ArrayType(T.LongType()))], _signs(bits, repeats)))
    region = ["t", "code", "d"]
    placed = coded.select("id", "n", F.octet_length("unit").alias("d"), F.posexplode("codes").alias("t", "code"))
    sizes = placed.groupBy(*region).agg(F.count("*").alias("size")).where("size > 1")
    members = placed.join(sizes, region).select(*region, "id", F.ceil(F.col("size") / BLOCK).cast("int").alias("k"))
    own = F.pmod(F.xxhash64("id"), F.col("k")).cast("int")
    pairs = members.select(*region, "id", own.alias("block"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    pairs = pairs.select(*region, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", F.col("id").alias("member"))
    full = pairs.join(coded.select("id", "n", "unit", "codes"), F.col("member") == F.col("id")).drop("member")
    found = stored(full.groupBy(*region, "i", "j").applyInArrow(_links(threshold, repeats, calibrate(coded, threshold)), "id long, links long, root long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = coded.select("id", "ha", "hb", "n").join(links, "id", "left").join(parts, "id", "left").select(
        "ha", "hb", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")
    )
    marked = rows.select("vec_id", *key, F.col("unit").isNotNull().alias("usable"))
    joined = marked.join(known, ["ha", "hb"], "left")
    component = F.when(F.col("usable"), F.col("component")).otherwise(F.col("vec_id"))
    return joined.select(
        "vec_id", F.when(F.col("usable"), F.col("n_links")).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
