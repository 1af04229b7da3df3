"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

From at most `sample` labelled rows (a documented bound) three things are fitted: a lexicon of words and word beginnings that mark the positive class,
boosted trees on dense features, and an isotonic map from margins to probabilities on a quarter of each class that neither lexicon nor trees have seen.
Scoring is a narrow pass over all whole texts: an Arrow map makes the features, the fitted trees run in the JVM.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, bound, held, map_rows, quoted, stored, texts

#: Labelled rows to fit on, lexicon entries, least documents of an entry, word beginnings taken as terms.
SAMPLE, LEXICON, SUPPORT, BEGINNINGS = 20_000, 2_000, 4, (4, 5)
#: Words remembered by a worker, in each of two generations.
MEMO_SIZE = 30_000
TREES, DEPTH, STEP, SEED = 20, 3, 0.3, 11
#: Second-person words (en, de, fr, es).
SECOND_PERSON = frozenset("you your yours yourself u du dich dir dein deine euch ihr tu te toi ton ta vous votre usted ti tus vosotros".split())
#: Characters that stand for letters in disguised words.
DISGUISE = str.maketrans("013457@$!", "oieastasi")
NEAR = 3
FEATURES = ("density", "strong", "hits", "distinct", "near_you", "you", "capitals", "shouted", "marks", "punctuation", "disguised", "disguised_hits", "repeats", "length")
_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[0134579@$!*]++[^\W\d_]++)+")
_REPEAT = re.compile(r"([^\W\d_])\1\1")
_PUNCTUATION = re.compile(r"[^\w\s]+")
#: A word that is no term, no second person and not in capitals.
_PLAIN = (0.0, False, 0, "")


class Lexicon:
    """Weights of words: of the word itself or else of its longest beginning that is a term (terms of beginnings end in *)."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights
        self.memo = Memo(self.about, MEMO_SIZE)

    def look_up(self, word: str) -> float:
        if word in self.weights:
            return self.weights[word]
        return max((self.weights.get(word[:n] + "*", 0.0) for n in BEGINNINGS if len(word) >= n), default=0.0)

    def about(self, word: str) -> tuple[float, bool, int, str]:
        """Weight, whether it is a second person, its letters if it is in capitals, and its lower-case form."""
        low = word.lower()
        weight, you, shouted = self.look_up(low), low in SECOND_PERSON, len(word) if len(word) > 1 and word.isupper() else 0
        return (weight, you, shouted, low) if weight > 0 or you or shouted else _PLAIN


def features(text: str, lexicon: Lexicon) -> tuple[float, ...]:
    """The dense features of a whole text; an empty one has zeros."""
    words = _WORD.findall(text)
    n = max(1, len(words))
    marked = [(i, x) for i, x in enumerate(map(lexicon.memo.__getitem__, words)) if x is not _PLAIN]
    hits = [i for i, x in marked if x[0] > 0]
    you = [i for i, x in marked if x[1]] if hits else []
    shouted = [x[2] for _, x in marked if x[2]]
    near, at = 0, 0
    for i in hits:
        while at < len(you) and you[at] < i - NEAR:
            at += 1
        near += at < len(you) and you[at] <= i + NEAR
    masked = [m.lower().translate(DISGUISE).replace("*", "") for m in _MASKED.findall(text)]
    letters = max(1, sum(map(len, words)))
    return (
        sum(x[0] for _, x in marked) / n, max((x[0] for _, x in marked), default=0.0), float(len(hits)), float(len({x[3] for _, x in marked if x[0] > 0})),
        near / max(1, len(hits)), len(you) / n, sum(shouted) / letters, len(shouted) / n,
        (text.count("!") + text.count("?")) / n, sum(map(len, _PUNCTUATION.findall(text))) / max(1, len(text)), len(masked) / n,
        float(sum(lexicon.look_up(m) > 0 for m in masked)), len(_REPEAT.findall(text)) / n, float(len(words)),
    )


def with_features(df: DataFrame, weights: dict[str, float], text: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(weights)  # at most LEXICON entries

    def make():
        weights = shared.value
        lexicon = held(("lexicon", tuple(weights.items())), lambda: Lexicon(weights))

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            rows = [features(t, lexicon) for t in texts(batch, text)]
            return [pa.array([r[i] for r in rows], pa.float64()) for i in range(len(FEATURES))]

        return work

    return map_rows(df, [T.StructField(f"__{f}", T.DoubleType()) for f in FEATURES], make)


def _terms(sample: DataFrame) -> DataFrame:
    """(term, before) for each word of the sample: the word itself and its beginnings, with the word before it."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    # Words hold letters only, so a space parts the two; strings are made distinct by hash, structs would be compared all with all.
    pairs = bound(words, lambda w: F.zip_with(w, F.concat(F.array(F.lit("")), w), lambda word, before: F.concat(word, F.lit(" "), before)))
    each = sample.select(F.explode(F.array_distinct(pairs)).alias("p")).where("p is not null")
    each = each.select(F.substring_index("p", " ", 1).alias("word"), F.substring_index("p", " ", -1).alias("before"))
    starts = [F.when(F.char_length("word") >= n, F.concat(F.substring("word", 1, n), F.lit("*"))) for n in BEGINNINGS]
    return each.select("before", F.explode(F.array_compact(F.array(F.col("word"), *starts))).alias("term"))


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Terms of the sample (text, label) by smoothed log-odds of their occurrences, at most LEXICON of them.

    A term's support is the number of different words before it, so that copies of one text lend it no weight.
    """
    total = sample.agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")).first()
    pos, neg = (total["pos"] or 0) + 1.0, (total["neg"] or 0) + 1.0
    least = max(SUPPORT, 0.01 * pos)
    marked = stored(_terms(sample.where("label = 1")).groupBy("term").agg(F.count_distinct("before").alias("pos")).where(F.col("pos") >= least))
    others = _terms(sample.where("label = 0")).join(marked.select("term"), "term", "left_semi").groupBy("term").agg(F.count_distinct("before").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / F.lit(pos)) - F.log((F.coalesce("neg", F.lit(0)) + 0.5) / F.lit(neg))
    best = marked.join(others, "term", "left").select("term", "pos", odds.alias("odds")).where(F.col("odds") >= 2.5)
    return {r["term"]: float(r["odds"]) for r in best.orderBy(F.desc("odds"), F.desc("pos"), "term").limit(LEXICON).collect()}


def score(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    label: str = "toxic",
    folds: int = 5,
    sample: int = SAMPLE,
) -> DataFrame:
    """Append held_out, score and predicted to every row of docs.

    Fitted on the `sample` labelled ids of least hash whose crc32(id as text) modulo folds is not 0; those with 0 are held out.
    Only the text goes into a score. Null texts count as empty and get a score too. Labels that are null or neither 0
    nor 1 are ignored; an id with several labels takes the greatest, repeated documents of an id all count. Without
    labels of both classes every score is the share of the positive class (0 without any); with a single id of a class
    there is nothing to hold back, and all three are fitted on all chosen rows. Null ids are not held out. Other columns stay; those
    named like the results are replaced; an empty table stays empty.
    """
    docs = docs.select(*[quoted(c) for c in docs.columns if c not in ("held_out", "score", "predicted")])
    fold = F.pmod(F.crc32(quoted(doc_id).cast("string").cast("binary")), F.lit(folds))
    chosen = (
        labels.where(F.col(label).isin(0, 1) & quoted(doc_id).isNotNull() & (fold != 0))
        .groupBy(quoted(doc_id).alias("__id")).agg(F.max(F.col(label).cast("int")).alias("label"))
        .orderBy(F.xxhash64("__id"), "__id").limit(sample)
    )
    # At most `sample` pairs of id and label: a bounded broadcast, so the texts are not shuffled.
    fit = stored(docs.select(quoted(doc_id).alias("__doc"), quoted(text).alias("text")).join(F.broadcast(chosen), F.col("__doc") == F.col("__id")).select("__id", "label", "text"))
    shares = {r["label"]: r["n"] for r in fit.groupBy("label").agg(F.count("*").alias("n")).collect()}
    held = F.coalesce(fold == 0, F.lit(False)).alias("held_out")
    if len(shares) < 2:
        known = float(shares.get(1, 0) > 0)
        return docs.select("*", held, F.lit(known).alias("score"), F.lit(int(known)).alias("predicted"))
    # A quarter of each class's ids (of at most `sample`) by hash, the second one first: two ids are enough for both parts.
    place = F.row_number().over(W.partitionBy("label").orderBy(F.xxhash64("__id", F.lit(3)), "__id"))
    parts = fit.select("label", "__id").distinct().select("__id", (place % 4 == 2).alias("later"))
    fit = stored(fit.join(F.broadcast(parts), "__id"))
    both = fit.where("later").select("label").distinct().count() == 2
    weights = learn_lexicon(fit.where("not later") if both else fit)
    assemble = VectorAssembler(inputCols=[f"__{f}" for f in FEATURES], outputCol="__features")
    ready = stored(with_features(fit, weights, "text").drop("text").repartition(4, "__id"))
    ready = assemble.transform(ready).select("__features", "label", "later")
    early, later = (ready.where("not later"), ready.where("later")) if both else (ready, ready)
    boosted = GBTClassifier(labelCol="label", featuresCol="__features", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=SEED, predictionCol="__p")
    trees = boosted.setRawPredictionCol("__raw").setProbabilityCol("__prob").fit(early)
    margin = vector_to_array("__raw")[1]
    calibrate = IsotonicRegression(labelCol="label", featuresCol="__margin", predictionCol="__score").fit(trees.transform(later).select("label", margin.alias("__margin")))
    scored = calibrate.transform(trees.transform(assemble.transform(with_features(docs, weights, text))).withColumn("__margin", margin))
    value = F.least(F.greatest(F.col("__score"), F.lit(0.0)), F.lit(1.0))
    return scored.select(*[quoted(c) for c in docs.columns], held, value.alias("score"), (value >= 0.5).cast("int").alias("predicted"))
