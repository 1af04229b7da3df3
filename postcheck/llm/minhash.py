"""MinHash near-dedup with an LSH forest.

A document's set is its distinct five-word shingles. Documents of equal word sequences are merged into classes first, so
exact copies of any number are one row. Each class has 128 min-hashes, kept as 32 groups of four 16-bit values; the
forest's 32 orders read these groups cyclically from 32 starting points and are sorted by them, range-partitioned over
the cluster, with the borders of neighbouring partitions joined afterwards. Rows that share the first group of an order
form its regions. A pair at 0.75 shares a given group with probability 0.32 and one of the 32 with 0.999995.

First round: the neighbours of a row in a sorted order are those of the longest common prefix with it. Each row keeps the
FRIENDS neighbours of the longest prefixes over all orders; these linear many candidates are screened by signature,
confirmed on full shingle sets and joined into components.

Centre rounds: where a region of CENTRE_LEAST rows or more holds several components, its rows are compared with one row of another component, the
most popular one: that which shares its groups with the most rows over all orders. Many variants of one original, which
resemble it more than each other, differ from it in other places each, so the original is their regions' centre. Each
round costs a row at most one comparison for each of its regions, and components grow before the next.

Second round, the exact way for the rest: only where a region still holds several components, its rows carry their full
sets, and all pairs between different components whose signatures agree well enough are confirmed inside the task, the
likeliest first; it returns the links that join components, at most one for each row. Pairs inside a component cannot
change the result: blocks that one component fills do not meet each other. Depth adapts to the region: one with more
than REGION * REGION pairs of different components is replaced by the regions that its rows share in one more group, for
every other group; a pair at 0.75 that shares one group shares another with probability 0.99999, and two more with
0.9999, so a deeper cut costs next to no link. After DEEPEST groups, blocks meet whatever the region's size.
Signatures agree well enough from the count that a pair at the threshold reaches with probability RECALL.
"""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import make_importable, map_rows, quoted, stored
from .components import connected_components

HASHES, ORDERS = 128, 32
#: Groups that an order is sorted by, neighbours that a row keeps in the first round.
DEPTH, FRIENDS = 3, 4
#: Region size whose pairs are compared without a deeper cut, rows of a block, most groups of a region's prefix.
REGION, BLOCK, DEEPEST = 4096, 1024, 3
#: Chance that a pair at the threshold passes the signature screen, and min-hashes of the screen's first part.
RECALL, FIRST = 0.9999, 48
SHINGLE, THRESHOLD = 5, 75
#: Rows of a region from which its centre is worth a round; the second round compares smaller ones whole for less.
CENTRE_LEAST = 256
#: Most centre rounds; they end earlier where no region holds several components or none were joined.
CENTRE_ROUNDS = 4
#: Copies of a centre's signature and text among which the rows that meet it are dealt.
COPIES = 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space: exactly what bytes.lower and bytes.split do."""
    return (text or "").encode().lower().split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_set(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer words than SHINGLE make one, none make none."""
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(SHINGLE, len(w))
    out = np.full(len(w) - width + 1, np.uint64(width), dtype=np.uint64)
    for i in range(width):
        out = _mixed(out * _MIX + w[i : len(w) - width + 1 + i])
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


@lru_cache(1)
def _parameters() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(77)
    return draw.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 2**63, HASHES, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """32 longs of four 16-bit min-hashes each."""
    a, b = _parameters()
    low = np.full(HASHES, np.uint64(2**64 - 1), dtype=np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(low, (shingles[at : at + 1024, None] * a + b).min(axis=0), out=low)
    return (_mixed(low) >> np.uint64(48)).astype(np.uint16).view(np.int64)


def _features() -> Callable[[pa.RecordBatch], list[pa.Array]]:
    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        n, ha, hb, sig = [], [], [], []
        for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
            words = words_of(text)
            shingles = shingle_set(words)
            digest = np.frombuffer(hashlib.blake2b(b" ".join(words), digest_size=16).digest(), np.int64)
            n.append(len(shingles))
            ha.append(digest[0])
            hb.append(digest[1])
            sig.append(signature(shingles) if len(shingles) else np.empty(0, np.int64))
        offsets = np.cumsum([0, *map(len, sig)], dtype=np.int32)
        flat = np.concatenate(sig) if sig else np.empty(0, np.int64)
        return [pa.array(n, pa.int64()), pa.array(ha, pa.int64()), pa.array(hb, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]

    return work


@lru_cache
def agreement_needed(hashes: int, recall: float) -> int:
    """The greatest count of equal min-hashes, out of `hashes`, that a pair at the threshold reaches with probability recall."""
    p, below = THRESHOLD / 100, 0.0
    for count in range(hashes + 1):
        below += math.comb(hashes, count) * p**count * (1 - p) ** (hashes - count)
        if below > 1 - recall:
            return count
    return hashes


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over a sorted partition: each row with its predecessor in the region and the length of their common prefix.

    Only rows that share their region with a neighbour, and the partition's first and last, come out.
    """
    names = ["t", *"abc"[:DEPTH], "id"]
    kept, begin = None, True

    def out(rows: list[np.ndarray], same: np.ndarray, lcp: np.ndarray, before: np.ndarray, after: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
        use = np.flatnonzero(same | after | edge)
        columns = [pa.array(x[use]) for x in rows]
        columns += [pa.array(before[use], mask=~same[use]), pa.array(lcp[use]), pa.array((same | after)[use]), pa.array(edge[use])]
        return pa.RecordBatch.from_arrays(columns, names=[*names, "before", "lcp", "member", "edge"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in names]
        if kept is not None:
            rows = [np.concatenate([k, x]) for k, x in zip(kept[0], rows)]
        n = len(rows[0])
        lcp, equal = np.zeros(n, np.int32), rows[0][1:] == rows[0][:-1]
        for x in rows[1:-1]:
            equal = equal & (x[1:] == x[:-1])
            lcp[1:] += equal
        before = np.concatenate([rows[-1][:1], rows[-1][:-1]])
        if kept is not None:
            lcp[0], before[0] = kept[1], kept[2]
        same = lcp > 0
        edge = np.zeros(n, bool)
        edge[0] = begin
        begin = begin and n == 1
        yield out([x[:-1] for x in rows], same[:-1], lcp[:-1], before[:-1], same[1:], edge[:-1])
        kept = [x[-1:] for x in rows], lcp[-1], before[-1]
    if kept is not None:
        lcp = np.array([kept[1]], np.int32)
        yield out(kept[0], lcp > 0, lcp, np.array([kept[2]], np.int64), np.array([False]), np.array([True]))


def sorted_orders(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, score) of neighbours in the sorted orders, score their common prefixes' sum, and (t, code, id) of the regions of two rows or more."""
    groups = [f"get(sig, (t + {d}) % {ORDERS}) AS {c}" for d, c in enumerate("abc"[:DEPTH])]
    keys = classes.select("id", F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))).alias("t"), "sig").selectExpr("t", *groups, "id")
    place = keys.columns
    ordered = keys.repartitionByRange(*place).sortWithinPartitions(*place)
    fields = [*keys.schema.fields, T.StructField("before", T.LongType()), T.StructField("lcp", T.IntegerType()), T.StructField("member", T.BooleanType()), T.StructField("edge", T.BooleanType())]
    near = stored(ordered.mapInArrow(_neighbours, T.StructType(fields)))
    # Two rows for each partition: the window over them is bounded by the number of partitions.
    line = W.orderBy(*place)
    edges = near.where("edge")
    alike = lambda step: (step("t").over(line) == F.col("t")) & (step("a").over(line) == F.col("a"))
    edges = edges.select("t", "a", "id", "member", F.when(alike(F.lag), F.lag("id").over(line)).alias("other"), F.coalesce(alike(F.lag) | alike(F.lead), F.lit(False)).alias("met"))
    pairs = near.where("before is not null").select("before", "id", "lcp").union(edges.where("other is not null").select("other", "id", F.lit(1)))
    pairs = pairs.select(F.least("before", "id").alias("a"), F.greatest("before", "id").alias("b"), "lcp").groupBy("a", "b").agg(F.sum("lcp").alias("score"))
    members = near.where("member and not edge").select("t", "a", "id").union(edges.where("member or met").select("t", "a", "id"))
    return pairs, members.withColumnRenamed("a", "code")


def friends(pairs: DataFrame) -> DataFrame:
    """(a, b) of the FRIENDS best neighbours of each row; a row has at most two in each order, so its list is bounded."""
    each = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other"), "score"), F.struct(F.col("b").alias("id"), F.col("a").alias("other"), "score"))).alias("x")).select("x.*")
    best = each.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "other")), asc=False), 1, FRIENDS).alias("best"))
    pair = best.select("id", F.explode("best.other").alias("other"))
    return pair.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def _agree(hashes: np.ndarray, sizes: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs that pass the screen, as places in rows and columns, with their counts of equal min-hashes."""
    if len(rows) * len(columns) <= 1024:
        count = (hashes[:FIRST, rows, None] == hashes[:FIRST, None, columns]).sum(axis=0)
    else:
        count = np.zeros((len(rows), len(columns)), dtype=np.uint8)
        for k in range(FIRST):
            count += hashes[k, rows][:, None] == hashes[k, columns][None, :]
    x, y = sizes[rows][:, None], sizes[columns][None, :]
    count[100 * np.minimum(x, y) < THRESHOLD * np.maximum(x, y)] = 0
    x, y = np.nonzero(count >= agreement_needed(FIRST, 1 - (1 - RECALL) / 2))
    total = (hashes[:, rows[x]] == hashes[:, columns[y]]).sum(axis=0)
    ok = total >= agreement_needed(HASHES, 1 - (1 - RECALL) / 2)
    return x[ok], y[ok], total[ok]


def _screen() -> Callable[[pa.RecordBatch], list[pa.Array]]:
    need = agreement_needed(HASHES, RECALL)

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        a, b = (batch.column(batch.schema.get_field_index(c)).flatten().to_numpy().view(np.uint16).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
        return [pa.array((a == b).sum(axis=1) >= need)]

    return work


def _beside(pairs: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """(a, b, {value}_a, {value}_b). The first of a pair may be in any number of pairs: its rows are dealt among COPIES."""
    left = rows.select(F.col("id").alias("a"), F.col(value).alias(f"{value}_a")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    left = left.join(pairs.select("a").distinct(), "a", "left_semi")
    right = rows.select(F.col("id").alias("b"), F.col(value).alias(f"{value}_b"))
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(COPIES)).cast("int"))
    return dealt.join(right, "b").join(left, ["a", "part"]).select("a", "b", f"{value}_a", f"{value}_b")


def screened(pairs: DataFrame, classes: DataFrame, dealt: bool = False) -> DataFrame:
    """The pairs (a, b) whose signatures agree well enough; dealt where an a may be in very many."""
    if dealt:
        joined = _beside(pairs, classes, "sig")
    else:
        left = classes.select(F.col("id").alias("a"), F.col("sig").alias("sig_a"))
        right = classes.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"))
        joined = pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b")
    return map_rows(joined, [T.StructField("near", T.BooleanType())], _screen, rows=4096).where("near").select("a", "b")


def centre_pairs(placed: DataFrame) -> DataFrame:
    """(a, b): each row b of a large region of several components with the region's most popular row a of another component; once each."""
    mixed = placed.groupBy("t", "code").agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high")).where((F.col("low") < F.col("high")) & (F.col("size") >= CENTRE_LEAST)).select("t", "code", "size")
    rows = stored(placed.join(mixed, ["t", "code"]))
    popular = rows.groupBy("id").agg(F.sum("size").alias("met"))
    best = rows.join(popular, "id").groupBy("t", "code", "component").agg(F.max(F.struct("met", (-F.col("id")).alias("low"))).alias("best"))
    best = stored(best.select("t", "code", F.struct("best.met", "best.low", "component").alias("best")))
    first = best.groupBy("t", "code").agg(F.max("best").alias("first"))
    second = best.join(first, ["t", "code"]).where("best.component <> first.component").groupBy("t", "code").agg(F.max("best").alias("second"))
    centres = first.join(second, ["t", "code"]).select("t", "code", F.col("first.component").alias("own"), (-F.col("first.low")).alias("one"), (-F.col("second.low")).alias("two"))
    met = rows.join(centres, ["t", "code"])
    return met.select(F.when(F.col("component") != F.col("own"), F.col("one")).otherwise(F.col("two")).alias("a"), F.col("id").alias("b")).distinct()


def _blocks(table: pa.Table) -> tuple:
    table = table.combine_chunks().sort_by("id")
    ids, sizes, block = (table[c].to_numpy() for c in ("id", "n", "block"))
    sig = np.ascontiguousarray(table["sig"].combine_chunks().flatten().to_numpy()).reshape(len(ids), ORDERS)
    hashes = np.ascontiguousarray(sig.view(np.uint16).T)
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    return table, ids, sizes, sig, hashes, np.flatnonzero(block == i), np.flatnonzero(block == j), i == j


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return len(x) + len(y) > both and 100 * both >= THRESHOLD * (len(x) + len(y) - both)


def _crossing(table: pa.Table) -> pa.Table:
    """Second round: confirm all pairs of different components that agree well enough, each in the first order where it meets; return links that join components."""
    table, ids, sizes, sig, hashes, left, right, same = _blocks(table)
    sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
    names, group = np.unique(table["component"].to_numpy(), return_inverse=True)
    root = list(range(len(names)))

    def top(g: int) -> int:
        while root[g] != g:
            root[g] = root[root[g]]
            g = root[g]
        return g

    t = table["t"][0].as_py()
    out = []
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        x, y, agree = _agree(hashes, sizes, rows, right)
        a, b = rows[x], right[y]
        fresh = (group[a] != group[b]) & ~(sig[a, :t] == sig[b, :t]).any(axis=1)
        if same:
            fresh &= a < b
        a, b, agree = a[fresh], b[fresh], agree[fresh]
        for k in np.argsort(-agree.astype(np.int16), kind="stable").tolist():
            g, h = top(group[a[k]]), top(group[b[k]])
            if g != h and _linked(sets[a[k]], sets[b[k]]):
                root[max(g, h)] = min(g, h)
                out.append((ids[a[k]], ids[b[k]]))
    a, b = (np.array([p[i] for p in out], dtype=np.int64) for i in (0, 1))
    return pa.table([pa.array(a), pa.array(b)], schema=_PAIRS)


def _confirm() -> Callable[[pa.RecordBatch], list[pa.Array]]:
    kept: OrderedDict[int, np.ndarray] = OrderedDict()
    def shingles(doc: int, text: str) -> np.ndarray:
        if doc not in kept:
            if len(kept) >= 64:
                kept.popitem(last=False)
            kept[doc] = shingle_set(words_of(text))
        return kept[doc]

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for a, b, x, y in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "b", "text_a", "text_b"))):
            out.append(_linked(shingles(a, x), shingles(b, y)))
        return [pa.array(out, pa.bool_())]

    return work


def confirmed(pairs: DataFrame, texts_of: DataFrame, dealt: bool = False) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold; texts_of has the texts by id. Dealt where an a may be in very many."""
    if dealt:
        joined = _beside(pairs, texts_of, "text")
        return stored(map_rows(joined, [T.StructField("linked", T.BooleanType())], _confirm, rows=256).where("linked").select("a", "b"))
    left = texts_of.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts_of.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return stored(map_rows(joined, [T.StructField("linked", T.BooleanType())], _confirm, rows=256).where("linked").select("a", "b"))


def _shingles() -> Callable[[pa.RecordBatch], list[pa.Array]]:
    return lambda batch: [pa.array([shingle_set(words_of(t)).tobytes() for t in batch.column(batch.schema.get_field_index("text")).to_pylist()], pa.binary())]


def _meet(dealt: DataFrame, meets: Column) -> DataFrame:
    met = dealt.withColumn("other", F.explode(meets))
    return met.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")


def _mixed_regions(placed: DataFrame) -> DataFrame:
    """(t, code, shared, own, crossing) of the regions of several components: blocks of the small ones together, of each large one, and pairs between components."""
    large = F.col("rows") > BLOCK
    count = lambda rows: F.ceil(rows / BLOCK).cast("int")
    parts = placed.groupBy("t", "code", "component").agg(F.count("*").alias("rows"))
    mixed = parts.groupBy("t", "code").agg(
        F.count("*").alias("components"),
        count(F.sum(F.when(large, 0).otherwise(F.col("rows")))).alias("shared"),
        # One entry for each BLOCK rows of the region at most.
        F.array_sort(F.collect_list(F.when(large, F.struct("component", count(F.col("rows")).alias("k"))))).alias("own"),
        (F.pow(F.sum(F.col("rows").cast("double")), 2) - F.sum(F.pow(F.col("rows").cast("double"), 2))).alias("crossing"),
    )
    return mixed.where("components > 1").drop("components")


def adapted(placed: DataFrame, classes: DataFrame) -> DataFrame:
    """The regions of several components in `placed` (t, code, id, component), those with too many pairs cut deeper.

    Their rows get the block in which they meet: (t, code, id, component, block, low, high, blocks). A component of more
    than BLOCK rows of a region fills blocks of its own, low to high - 1; the other rows share blocks, with low = high = 0.
    """
    done, level = [], placed.select("t", "code", "id", "component", F.lit(-1).alias("last"))
    for depth in range(1, DEEPEST + 1):
        mixed = stored(_mixed_regions(level))
        deep = F.col("crossing") > float(REGION) ** 2
        fit = mixed if depth == DEEPEST else mixed.where(~deep)
        rows = (
            level.drop("last").join(fit, ["t", "code"])
            .withColumn("k", F.expr("coalesce(get(filter(own, x -> x.component = component), 0).k, 0)"))
            .withColumn("low", F.expr("if(k = 0, 0, shared + aggregate(filter(own, x -> x.component < component), 0, (s, x) -> s + x.k))"))
            .withColumn("block", F.col("low") + F.pmod(F.xxhash64("id"), F.when(F.col("k") > 0, F.col("k")).otherwise(F.col("shared"))).cast("int"))
        )
        blocks = F.expr("shared + aggregate(own, 0, (s, x) -> s + x.k)").alias("blocks")
        done.append(stored(rows.select("t", "code", "id", "component", "block", "low", (F.col("low") + F.col("k")).alias("high"), blocks)))
        if depth == DEEPEST or mixed.where(deep).isEmpty():
            break
        more = level.join(mixed.where(deep).select("t", "code"), ["t", "code"]).join(classes.select("id", "sig"), "id")
        more = more.select("t", "code", "id", "component", "sig", "last", F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))).alias("next")).where("next <> t and next > last")
        level = stored(more.select("t", F.xxhash64("code", "next", F.get("sig", F.col("next"))).alias("code"), "id", "component", F.col("next").alias("last")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _others(several: DataFrame) -> DataFrame:
    """Second round: every block meets itself and every other one, less the blocks that its own component fills."""
    meets = F.expr("filter(sequence(0, blocks - 1), x -> x < low or x >= high)")
    return _meet(several, meets).drop("low", "high", "blocks")


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of df: doc_id, n_shingles, component_id, kept.

    Words are runs without ASCII white space, A-Z lower-cased; a set is the distinct five-word shingles, the whole
    sequence for fewer words, and empty without words. Rows link if 100 * intersection >= 75 * union; component_id is
    the smallest doc_id reachable, itself included; kept marks the row that is its component's id. Rows without words (null, empty or blank texts)
    link with nothing. Rows that share a doc_id are one node of the graph. A row with a null doc_id links with nothing,
    has no component and is kept. Other columns are ignored; an empty table gives an empty result.
    """
    make_importable(df.sparkSession)
    rows = df.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text"))
    made = map_rows(
        rows,
        [T.StructField("n", T.LongType()), T.StructField("ha", T.LongType()), T.StructField("hb", T.LongType()), T.StructField("sig", T.ArrayType(T.LongType()))],
        _features,
    )
    features = stored(made.drop("text"))
    usable = features.where("n > 0 and doc_id is not null")
    # Rows of a class have the same set, so any row's signature is the class's.
    classes = stored(usable.groupBy("ha", "hb").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    pairs, members = sorted_orders(classes)
    # The texts of documents that meet others move once, for both rounds. The ids grow with the corpus, so the join is a
    # sort-merge join at every size.
    texts_of = stored(rows.select(F.col("doc_id").alias("id"), "text").join(members.select("id").distinct().hint("merge"), "id", "left_semi"))
    links = confirmed(stored(screened(friends(pairs), classes)), texts_of)
    # Components grow by the links of each round, which join only some of them.
    parts = connected_components(links)
    labelled = lambda: stored(members.join(parts, "id", "left").select("t", "code", "id", F.coalesce("component", "id").alias("component")))
    placed = labelled()
    for _ in range(CENTRE_ROUNDS):
        more = confirmed(stored(screened(centre_pairs(placed), classes, dealt=True)), texts_of, dealt=True)
        if more.isEmpty():
            break
        parts = connected_components(more, known=parts)
        placed = labelled()
    several = adapted(placed, classes)
    open_ids = several.select("id").distinct()
    sets = map_rows(texts_of.join(open_ids, "id", "left_semi"), [T.StructField("shingles", T.BinaryType())], _shingles, rows=256).drop("text")
    full = several.join(classes.drop("ha", "hb").join(sets, "id"), "id")
    second = stored(_others(full).groupBy("t", "code", "i", "j").applyInArrow(_crossing, "a long, b long"))
    parts = connected_components(second, known=parts)
    named = classes.select("ha", "hb", "id").join(parts, "id", "left").select("ha", "hb", F.coalesce("component", "id").alias("component"))
    joined = features.select("doc_id", "n", "ha", "hb").join(named, ["ha", "hb"], "left")
    component = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def keep_one(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of df without those whose document another one of its group stands for."""
    gone = near_duplicates(df, text, doc_id).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return df.join(gone, quoted(doc_id) == F.col("__gone"), "left_anti")
