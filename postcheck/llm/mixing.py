"""Mixing sources to target weights by entropy balancing.

Of all document rates between 0 and a cap, take those nearest to 1 in relative entropy whose words meet each source's
target. The dual is convex with one multiplier for each source, and its solution tilts exponentially:
rate = min(cap, exp(multiplier * size / mean size of the source)). Newton's step needs two sums for each source, so an
iteration is one aggregation by source over the distinct (source, size) pairs; steps are kept inside a bracket that
every evaluation narrows, so the tilt converges for any target between nothing and the cap.

Rates become copies by order sampling: floor(rate) copies, and one more for the documents whose hash over fraction is
below the source's cut-off. The cut-off is found by refining hash bins, so the words taken miss the target by one
document at most, reruns agree, and no window holds more than one source's bins. A source with a third of all rows is
only ever pre-aggregated by (source, size) and (source, bin). All of it is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut, partitions, quoted, stored

#: Bins of each refinement, and refinements: together finer than the hash.
BINS, LEVELS = 1024, 4
NEWTON_STEPS, TOLERANCE = 40, 1e-9
#: Equal rows that one task numbers.
CHUNK = 10_000


def exact_sum(value: Column) -> Column:
    """A sum that does not depend on the order of its rows: six decimals, added as decimals."""
    return F.sum(value.cast("decimal(38,6)")).cast("double")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Targets by water filling. totals: source, words (one row for each source, so its windows are as small as the catalogue of sources).

    Sources in code-point order, null last, take the weights in turn. A target stops at cap times the words; what is
    left over is shared again by weight until none is above, which is min(cap * words, level * weight) for one level.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.array(*[F.lit(float(x)) for x in weights])
    ranked = totals.select("source", "words", F.get(w, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))).alias("weight"))
    by = W.orderBy((F.col("words") / F.col("weight")), F.col("source").isNull(), F.col("source"))
    upto, whole = by.rowsBetween(W.unboundedPreceding, W.currentRow), W.partitionBy(F.lit(1))
    level = ranked.select(
        "*",
        (F.sum("words").over(whole) * share).alias("size"),
        F.coalesce(F.sum(F.col("words") * cap).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("full"),
        (F.sum("weight").over(whole) - F.sum("weight").over(upto) + F.col("weight")).alias("open"),
    ).select("source", "words", "weight", ((F.col("size") - F.col("full")) / F.col("open")).alias("level"))
    # Levels rise while the next source is full at them and fall afterwards: the right one is the highest.
    first = F.max("level").over(whole)
    ordered = level.select("source", "words", "weight", first.alias("level"))
    target = F.least(F.col("words") * F.lit(float(cap)), F.coalesce(F.col("level") * F.col("weight"), F.col("words") * F.lit(float(cap))))
    return ordered.select("source", "words", target.cast("double").alias("target"))


def _tilt(cap: float) -> Column:
    """The rate for the multiplier `m` and the scaled size `x`."""
    return F.least(F.lit(float(cap)), F.exp(F.least(F.col("m") * F.col("x"), F.lit(50.0))))


def balance(sizes: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """Newton on the dual: source, mean, m for the table of (source, size, n)."""
    known = targets.select(F.col("source").alias("s"), "mean")
    counted = sizes.where("size > 0").join(known, F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "n", (F.col("size") / F.col("mean")).alias("x"))
    counted = cut(counted)
    # lo and hi bracket the multiplier; a target at its cap needs no step.
    state = cut(targets.where("words > 0").select(
        "source", "mean", "target", F.lit(0.0).alias("m"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"),
        (F.col("target") >= F.col("words") * cap * (1 - 1e-12)).alias("full"), F.lit(False).alias("done"),
    ))
    for _ in range(NEWTON_STEPS):
        now = state.where("not done and not full").select(F.col("source").alias("s"), "m")
        sums = counted.join(now, F.col("source").eqNullSafe(F.col("s"))).select("s", "n", "size", "x", _tilt(cap).alias("rate")).groupBy("s").agg(
            exact_sum(F.col("n") * F.col("size") * F.col("rate")).alias("got"),
            exact_sum(F.when(F.col("rate") < cap, F.col("n") * F.col("size") * F.col("x") * F.col("rate"))).alias("slope"),
        )
        joined = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left")
        miss = F.col("got") - F.col("target")
        lo = F.when(miss < 0, F.col("m")).otherwise(F.col("lo"))
        hi = F.when(miss > 0, F.col("m")).otherwise(F.col("hi"))
        step = F.col("m") - F.try_divide(miss, F.col("slope"))
        wide = F.when(lo <= -1e6, F.col("m") * 2 - 1).when(hi >= 1e6, F.col("m") * 2 + 1).otherwise((lo + hi) / 2)
        inside = step.isNotNull() & (step > lo) & (step < hi) & (F.abs(step - F.col("m")) <= 2 + F.abs(F.col("m")))
        done = F.col("got").isNull() | (F.abs(miss) <= F.greatest(F.col("target") * TOLERANCE, F.lit(1e-6))) | F.coalesce(hi - lo < 1e-13, F.lit(False))
        state = cut(joined.select(
            "source", "mean", "target",
            F.when(done | F.col("done") | F.col("full"), F.col("m")).when(inside, step).otherwise(wide).alias("m"),
            F.when(done, F.col("lo")).otherwise(lo).alias("lo"),
            F.when(done, F.col("hi")).otherwise(hi).alias("hi"),
            "full", (F.col("done") | F.col("full") | done).alias("done"),
        ))
        if state.where("not done").isEmpty():
            break
    return state


def _cut_offs(parts: DataFrame) -> DataFrame:
    """source, wanted, level, bin for each source: parts has source, size, fraction, v in [0, 1).

    Documents are taken in the order of v = hash / fraction until their words reach the sum of size * fraction.
    """
    wanted = stored(parts.groupBy("source").agg(exact_sum(F.col("size") * F.col("fraction")).alias("wanted")).select("source", "wanted", F.lit(0.0).alias("lo")))
    width = 1.0
    for level in range(LEVELS):
        width /= BINS
        at = F.floor((F.col("v") - F.col("lo")) / F.lit(width))
        near = wanted.select(F.col("source").alias("s"), "wanted", "lo")
        inside = parts.join(near, F.col("source").eqNullSafe(F.col("s"))).where((F.col("v") >= F.col("lo")) & (F.col("v") < F.col("lo") + F.lit(width * BINS)))
        bins = inside.select("source", "wanted", "lo", at.alias("bin"), "size").groupBy("source", "wanted", "lo", "bin").agg(F.sum("size").alias("words"))
        run = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
        before = bins.select("*", (F.sum("words").over(run) - F.col("words")).alias("before"))
        # The last bin that begins below what is wanted holds the cut-off.
        pick = before.where(F.col("before") <= F.col("wanted")).groupBy("source").agg(
            F.max_by(F.struct((F.col("lo") + F.col("bin") * width).alias("lo"), (F.col("wanted") - F.col("before")).alias("wanted"), F.col("words").alias("words")), "bin").alias("p")
        )
        wanted = stored(pick.select("source", F.col("p.wanted").alias("wanted"), F.col("p.lo").alias("lo"), F.col("p.words").alias("words")))
    # The last bin is as fine as one document: it is taken whole if that comes nearer.
    return wanted.select("source", (F.col("lo") + F.when(F.col("wanted") * 2 >= F.col("words"), F.lit(width)).otherwise(F.lit(0.0))).alias("limit"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, rate, copies, taken.

    size is the number of words (null text: 0), source_size and target are its source's, copies how often the mix takes
    it (at most ceil(cap)), taken = size * copies. Sources are ordered by code point, null is a source of its own and
    the last. Documents of size 0 have rate 1 and taken 0. Repeated rows and ids are documents of their own: rows equal in
    id, source and size are numbered, and each number draws for itself. Other columns are ignored, whatever their names.
    An empty table gives an empty result. Results depend on the rows only, not on their order or partitions: sums are exact. Per-source tables are written before they are joined, so that their known size
    decides between a broadcast and a join whose hot partitions are split.
    """
    rows = docs.select(quoted(doc_id).alias("doc_id"), quoted(source).alias("source"), n_words(quoted(text)).alias("size"))
    # Equal rows are counted first and numbered in chunks, so that no task holds all of a row that is repeated often.
    equal = rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n)
    chunks = equal.select("*", F.explode(upto(F.floor((F.col("n") - 1) / CHUNK))).alias("chunk"))
    chunks = chunks.repartition(partitions(docs.sparkSession), "doc_id", "source", "size", "chunk")
    last = F.least(F.col("n") - F.col("chunk") * CHUNK, F.lit(CHUNK)) - 1
    base = stored(chunks.select("doc_id", "source", "size", (F.col("chunk") * CHUNK).alias("from"), F.explode(upto(last)).alias("number")).select(
        "doc_id", "source", "size", (F.col("from") + F.col("number")).alias("number")))
    sizes = cut(base.groupBy("source", "size").agg(F.count("*").alias("n")))
    totals = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("docs"))
    goals = source_targets(totals.select("source", "words"), weights, share, cap)
    targets = stored(goals.join(totals.select(F.col("source").alias("s"), "docs"), F.col("source").eqNullSafe(F.col("s"))).select(
        "source", "words", "target", F.greatest(F.col("words") / F.col("docs"), F.lit(1e-9)).alias("mean")))
    tilt = stored(balance(sizes, targets, cap))
    known = targets.join(tilt.select(F.col("source").alias("s"), "m", "full"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    rated = base.join(known.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "source", "size", "number", F.col("words").alias("source_size"), "target",
        F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("full"), F.lit(float(cap))).otherwise(
            F.least(F.lit(float(cap)), F.exp(F.least(F.col("m") * F.col("size") / F.col("mean"), F.lit(50.0))))).alias("rate"),
    )
    fraction = F.col("rate") - F.floor("rate")
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "source", "size", "number"), 12).cast("double") + 0.5) / F.lit(float(2**52))
    drawn = stored(rated.select("*", fraction.alias("fraction"), F.when(fraction > 0, F.least(u / fraction / F.lit(BINS), F.lit(0.999999999999))).alias("v")))
    limits = stored(_cut_offs(drawn.where("size > 0 and fraction > 0").select("source", "size", "fraction", "v")))
    copies = (F.floor("rate") + F.when(F.col("v") < F.col("limit"), 1).otherwise(0)).cast("long")
    return drawn.join(limits.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select(
        "doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def take(docs: DataFrame, mixed: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The mix itself: the rows of docs as many times as mixed says, which is mix() of the same docs.

    Rows equal in id, source and size share their copies evenly, the first by the hash of their text taking what is left
    over. Rows that mixed lacks stay once. All columns are kept and none is added; an empty table stays empty.
    """
    total = mixed.groupBy("doc_id", "source", "size").agg(F.count("*").alias("__n"), F.sum("copies").alias("__copies"))
    total = total.withColumnsRenamed({"doc_id": "__id", "source": "__source", "size": "__size"})
    same = quoted(doc_id).eqNullSafe(F.col("__id")) & quoted(source).eqNullSafe(F.col("__source")) & (n_words(quoted(text)) == F.col("__size"))
    joined = docs.join(total, same, "left")
    many = F.coalesce(F.col("__n") > 1, F.lit(False))
    rank = F.row_number().over(W.partitionBy("__id", "__source", "__size").orderBy(F.xxhash64(quoted(text))))
    spread = joined.where(many).withColumn("__rank", rank)
    share = F.floor(F.col("__copies") / F.col("__n")) + (F.col("__rank") <= F.col("__copies") % F.col("__n")).cast("long")
    once = joined.where(~many).withColumn("__take", F.coalesce("__copies", F.lit(1)))
    both = once.unionByName(spread.withColumn("__take", share).drop("__rank"))
    return both.select(*[quoted(c) for c in docs.columns], F.explode(F.array_repeat(F.lit(1), F.col("__take").cast("int"))).alias("__copy")).drop("__copy")
