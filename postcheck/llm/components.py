"""Connected components of an edge table by minimum labels with pointer jumping; all state stays in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Rounds after which the loop gives up; labels at least halve their distance in each.
ROUNDS = 60


def _settle(pairs: DataFrame) -> DataFrame:
    """(id, component) of the ids in pairs (a, b). Each id meets itself too, so a round is two joins with the labels and one aggregation."""
    ends = lambda *xs: F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in xs]))
    both = stored(pairs.select(ends("ab", "ba", "aa", "bb").alias("x")).select("x.*").distinct())
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")))
    for _ in range(ROUNDS):
        own = F.max(F.when(F.col("a") == F.col("b"), F.col("component"))).alias("was")
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(own, F.min("component").alias("near"))
        jump = labels.select(F.col("id").alias("at"), F.col("component").alias("beyond"))
        after = stored(near.join(jump, near["near"] == jump["at"]).select(F.col("a").alias("id"), "was", F.least("near", "beyond").alias("component")))
        labels = after.select("id", "component")
        if after.where("component <> was").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", known: DataFrame | None = None) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in an edge. Nulls take no part; loops and repeats are harmless.

    known: the result for other edges, which go on to count: the new edges join its components, so only these are settled again.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    if known is None:
        return _settle(pairs)
    for end in ("a", "b"):
        pairs = pairs.join(known.select(F.col("id").alias(end), F.col("component").alias(f"{end}_in")), end, "left")
    pairs = stored(pairs.select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b")).where("a <> b").distinct())
    if pairs.isEmpty():
        return known
    joined = _settle(pairs)
    moved = joined.select(F.col("id").alias("at"), F.col("component").alias("beyond"))
    old = known.join(moved, known["component"] == moved["at"], "left").select("id", F.coalesce("beyond", "component").alias("component"))
    return stored(old.unionByName(joined.join(known.select("id"), "id", "left_anti")))
