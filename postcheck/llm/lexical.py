"""Exact ranked lexical search by NRA: sequential reads of impact-sorted postings, score intervals for each document.

Documents stay in their partitions. One narrow pass turns each text into its length and the occurrences of the items'
terms; corpus statistics are aggregates of that table. A second narrow pass cuts each partition into blocks of
documents. In a block every term has one list of postings, highest impact first. For an item its lists are read in step,
in rounds of growing depth and never by random access: what has been read of a document is the lower end of its
score, what the unread lists could still add at their frontiers the upper end. Documents whose upper end is below the
bar, the k-th lower end or that of earlier blocks of the task, are out; once the frontiers' sum is below it no new
document can enter. Reading goes on until every document left has a single score, so that members, ties and scores are
all settled. Each task returns its k best of each item, and their union is ranked in two salted steps.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import make_importable, map_rows, quoted, stored

#: Documents of a block, first depth of a read and the factor by which depths grow.
BLOCK, FIRST_DEPTH, DEEPER = 8192, 128, 4
#: (item, term) pairs of a batch of items: what a worker holds of the items, whatever their number.
BATCH = 1_000_000
#: Parts in which an item's local results are ranked before they meet.
SALT = 32
#: One term in the JVM's regular expressions: ASCII digits and letters and everything beyond ASCII (fixed value).
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LETTERS = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TO_TERMS = bytes(b if b in _LETTERS else 0x20 for b in range(256)).lower()


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order: maximal runs of TERM, A-Z lower-cased."""
    return (text or "").encode().translate(_TO_TERMS).split()


def _occurrences(shared) -> Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]]:
    def make():
        ids = {t: i for i, t in enumerate(shared.value)}.get

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            n, at, terms, tfs = [], [0], [], []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                words = terms_of(text)
                found = Counter(map(ids, words))
                found.pop(None, None)
                n.append(len(words))
                terms.extend(found.keys())
                tfs.extend(found.values())
                at.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            return [pa.array(n, pa.int64()), *lists]

        return work

    return make


def nra(lists: list[tuple[np.ndarray, np.ndarray]], rows: int, k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """All rows of a block that can be among the k best and reach max(floor, 1), with their scores, and how many postings were read.

    lists: (rows, impacts) of each term, impacts positive and descending. More than k rows come out only where ties or fewer than k known lower ends leave them in.
    """
    lower = np.zeros(rows, np.int64)
    seen = np.zeros((len(lists), rows), bool)
    alive = np.zeros(rows, bool)
    # Sums stay below 2 ** 53, so bounds in doubles are exact.
    frontier = np.array([impacts[0] for _, impacts in lists], dtype=np.float64)
    closed, depth, step, read = False, 0, FIRST_DEPTH, 0
    while True:
        for t, (docs, impacts) in enumerate(lists):
            part, gain = docs[depth : depth + step], impacts[depth : depth + step]
            if not len(part):
                continue
            read += len(part)
            if closed:
                live = alive[part]
                part, gain = part[live], gain[live]
            lower[part] += gain
            seen[t, part] = True
            if not closed:
                alive[part] = True
            frontier[t] = impacts[depth + step] if depth + step < len(impacts) else 0
        depth, step = depth + step, step * DEEPER
        left = np.flatnonzero(alive)
        low = lower[left]
        bar = max(floor, int(np.partition(low, len(low) - k)[len(low) - k]) if len(low) >= k else 0, 1)
        high = low + frontier @ ~seen[:, left]
        inside = high >= bar
        closed = closed or frontier.sum() < bar
        if closed:
            alive[left[~inside]] = False
            left, low, high = left[inside], low[inside], high[inside]
            if (low == high).all():
                return left, low, read


def _search(shared, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def block_of(docs: list[pa.RecordBatch], total: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        table = pa.Table.from_batches(docs).combine_chunks()
        ids, n = table["doc_id"].to_numpy(), table["n"].to_numpy()
        sizes = table["terms"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        term, tf = (table[c].combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        m = 100 - 50 + 50 * n * total // length
        share = 1_000_000_000 * tf // (1000 * tf + 20 * m[doc])
        order = np.lexsort((doc, -share, term))
        term = term[order]
        return ids, doc[order], share[order], np.searchsorted(term, np.arange(term[-1] + 2 if len(term) else 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, total, length = shared.value
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(items)

        def search(docs: list[pa.RecordBatch]) -> None:
            ids, doc, share, begin = block_of(docs, total, length)
            for i, (_, terms) in enumerate(items):
                lists = []
                for t in terms:
                    if t + 1 < len(begin) and begin[t + 1] > begin[t] and weights[t] > 0:
                        own = slice(begin[t], begin[t + 1])
                        impacts = share[own] * weights[t]
                        lists.append((doc[own][impacts > 0], impacts[impacts > 0]))
                lists = [x for x in lists if len(x[0])]
                if not lists:
                    continue
                kept, scores = best[i]
                rows, found, _ = nra(lists, len(ids), k, int(scores[-1]) if len(scores) == k else 0)
                kept, scores = np.concatenate([kept, ids[rows]]), np.concatenate([scores, found])
                order = np.lexsort((kept, -scores))[:k]
                best[i] = kept[order], scores[order]

        held, rows = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, BLOCK - rows)
                batch = batch.slice(part.num_rows)
                held.append(part)
                rows += part.num_rows
                if rows == BLOCK:
                    search(held)
                    held, rows = [], 0
        if rows:
            search(held)
        for i, (item, _) in enumerate(items):
            if len(best[i][0]):
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(best[i][0]), pa.int64()), pa.array(best[i][0]), pa.array(best[i][1])], names=["item_id", "doc_id", "score"])

    return run


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, term) once each; rows of one item_id are one item. Null ids and texts have none."""
    lower = F.translate(quoted(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return items.select(quoted(item_id).cast("long").alias("item_id"), F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("term")).where("item_id is not null").distinct()


def weight(df: Column, n: Column) -> Column:
    """A term's weight from the number of documents that hold it, of n with any term."""
    return F.floor(1000 * F.log((2 * n + 2).cast("double") / (2 * df + 1))).cast("long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: for each item the k documents of highest score, all of them if fewer score above 0.

    Equal scores go by ascending doc_id; ranks are unique. Null, empty and termless texts take no part in the statistics
    and are never found. Rows with a null doc_id or item_id take no part at all. Rows that share a doc_id are documents of
    their own each; rows that share an item_id are one item with the terms of all. Other columns are ignored. An empty
    table of either kind gives an empty result. Very long texts are read whole. Items go through in batches of about
    BATCH (item, term) pairs, each with one pass over the documents, so what workers hold of them is bounded.
    """
    spark = docs.sparkSession
    make_importable(spark)
    asked = stored(item_terms(items, item_id, item_text))
    batches = max(1, math.ceil(asked.count() / BATCH))
    texts = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text")).where("doc_id is not null")
    numbers = [T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))]
    out = None
    for at in range(batches):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(batches)) == at).toArrow().sort_by([("item_id", "ascending"), ("term", "ascending")])
        terms = own["term"].combine_chunks().dictionary_encode() if own.num_rows else None
        words = [x.encode() for x in terms.dictionary.to_pylist()] if terms is not None else []
        by_item: dict[int, list[int]] = {}
        for item, t in zip(own["item_id"].to_pylist(), terms.indices.to_pylist() if terms is not None else []):
            by_item.setdefault(item, []).append(t)
        features = stored(map_rows(texts, numbers, _occurrences(spark.sparkContext.broadcast(words))).drop("text").where("n > 0"))
        total = features.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(1)).alias("length")).first()
        held = features.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
        # One row for each term of the batch at most.
        weights = {r["t"]: r["w"] for r in held.select("t", weight(F.col("df"), F.lit(total["n"]).cast("long")).alias("w")).collect()}
        shared = spark.sparkContext.broadcast((list(by_item.items()), [weights.get(t, 0) for t in range(len(words))], total["n"], total["length"]))
        local = features.mapInArrow(_search(shared, k), "item_id long, doc_id long, score long")
        out = local if out is None else out.unionByName(local)
    best = lambda *keys: F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "doc_id"))
    salted = out.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALT)))
    first = salted.withColumn("rank", best("item_id", "salt")).where(F.col("rank") <= k)
    return first.withColumn("rank", best("item_id")).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
