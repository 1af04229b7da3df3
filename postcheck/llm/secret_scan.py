"""Secret scans: candidates by shape, false positives removed by a random forest.

A candidate is a run of printable ASCII in a word: between quotes, brackets and the like, and again between the marks
! # ? & , where it holds some, so that neither JSON, calls, query strings and trailing marks nor marks inside a password
hide it. It has at least MIN_LENGTH characters and a digit, unless a name before = or : announces it (of any length, with a
word such as Bearer between them or not) or its format is known. What stands before = or : and holds a digit, but announces
nothing, may be the first half of a secret: then the whole is a candidate besides the part behind. Key blocks of several words (from -----BEGIN ... PRIVATE KEY----- to its END) are candidates as a whole. A candidate
is judged on its length, character transitions (how often its classes follow each other, and how rare its pairs of
characters are among the dictionary's), dictionary coverage, path marks and neighbouring words. Extraction, features and scoring are DataFrame functions and the
JVM's random forest: no Python runs on the executors. Texts are read once and only candidates move.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, quoted, stored

MIN_LENGTH = 12
#: Labelled findings to fit on, trees and their depth.
SAMPLE, TREES, DEPTH, SEED = 20_000, 20, 6, 5
#: Fixed value: words that announce a secret.
ANNOUNCED = r"(?i)(passw|passphrase|pwd|(?<![a-z])pw(?![a-z])|secret|token|api|key|auth|credential|bearer)"
#: Published key formats.
KNOWN = "(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,})"
_ASSIGNED = r"""[=:]["'`(<\[{\\]*$"""
_CANDIDATE = r"^(?=.*[0-9]).*[\x21-\x7e]{12}|" + KNOWN
#: Fixed value: words between an announcement and its value.
_SCHEME = r"""[=:]["'`(<\[{\\]* ?["'`]*(?i:bearer|basic|token)$"""
_LED = r"""[=:]["'`(<\[{\\]*$|(?i:bearer|basic|token)$"""
_START, _END = r"[A-Za-z0-9_+/@$%~^*.=:-]", r"[A-Za-z0-9_+/@$%~^*=-]"
# A name of any length, what assigns, opening marks, and the beginning of a value; nothing is given back, so a long run costs in proportion.
_NAME = r"""([A-Za-z0-9_.-]++)["'`\\]*+[=:]++>?+["'`(<\[{\\]*+""" + f"(?={_START})"
_RUN = r"""[\x21-\x7e&&[^"'`<>()\[\]{};\\|]]"""
_PART = r"""[\x21-\x7e&&[^"'`<>()\[\]{};\\|!#?&,]]"""
_PIECES = [f"(?:{_NAME})?{_START}(?:{inside}*{_END})?" for inside in (_RUN, _PART)]
_SPLIT = f"(?s)^(?:{_NAME})?(.*)$"
#: Fixed value: a private key in its armour.
_BLOCK = r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----"
#: Transitions between classes of characters: name, first and second class.
STEPS = (("lower_upper", "a-z", "A-Z"), ("upper_lower", "A-Z", "a-z"), ("letter_digit", "a-zA-Z", "0-9"), ("digit_letter", "0-9", "a-zA-Z"))
FEATURES = ("length", "digits", "upper", "lower", "symbols", "transitions", *(s[0] for s in STEPS), "rarity", "variety", "hex", "coverage", "slashes", "dots", "at", "url", "announced_left", "announced_before", "assigned", "quoted_word", "right_word")


def candidates(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, pos (word position), value, left (name before = or :), before (two words), after (one word)."""
    words = F.split(quoted(text), r"[\x20\x09-\x0D]+")
    led = lambda before: before.rlike(ANNOUNCED) & (before.rlike(_ASSIGNED) | before.rlike(_SCHEME))

    def shaped(w: Column) -> Column:
        told = lambda x: x.rlike(ANNOUNCED) & x.rlike("[=:]")
        at = F.filter(
            F.sequence(F.lit(0), F.size(w) - 1),
            lambda i: F.get(w, i).rlike(_CANDIDATE) | told(F.get(w, i)) | (F.get(w, i - 1).rlike(_LED) & led(F.concat_ws(" ", F.get(w, i - 2), F.get(w, i - 1)))),
        )
        return F.transform(
            at,
            lambda i: F.struct(
                i.alias("pos"),
                F.get(w, i).alias("word"),
                F.concat_ws(" ", F.get(w, i - 2), F.get(w, i - 1)).alias("before"),
                F.coalesce(F.get(w, i + 1), F.lit("")).alias("after"),
            ),
        )

    found = df.where(quoted(text).isNotNull()).select(quoted(doc_id).alias("doc_id"), F.explode(bound(words, shaped)).alias("c"))
    pieces = F.array_distinct(F.concat(*[F.regexp_extract_all("c.word", F.lit(p), F.lit(0)) for p in _PIECES]))
    part = lambda n: F.regexp_extract("piece", _SPLIT, n)
    runs = found.select("doc_id", "c.pos", "c.word", F.explode(pieces).alias("piece"), "c.before", "c.after")
    halves = F.struct(part(2).alias("value"), part(1).alias("left"))
    whole = F.when(part(1).rlike("[0-9]") & ~part(1).rlike(ANNOUNCED), F.struct(F.col("piece").alias("value"), F.lit("").alias("left")))
    split = runs.select("doc_id", "pos", "word", F.inline(F.array_compact(F.array(halves, whole))), "before", "after")
    announced = F.col("left").rlike(ANNOUNCED) | led(F.col("before"))
    shapely = (F.char_length("value") >= MIN_LENGTH) & F.col("value").rlike("[0-9]")
    single = split.where((F.col("value") != "") & (shapely | announced | F.col("value").rlike(f"^{KNOWN}$")))
    # The position of a block is that of its first word: the number of white-space runs before it.
    whole = df.where(quoted(text).contains("PRIVATE KEY-----")).select(quoted(doc_id).alias("doc_id"), quoted(text).alias("t"), F.explode(F.array_distinct(F.regexp_extract_all(quoted(text), F.lit(_BLOCK), F.lit(0)))).alias("value"))
    ahead = F.expr("left(t, instr(t, value) - 1)")
    blocks = whole.select("doc_id", F.regexp_count(ahead, F.lit(r"[\x20\x09-\x0D]+")).alias("pos"), F.col("value").alias("word"), "value", F.lit("").alias("left"), F.lit("").alias("before"), F.lit("").alias("after"))
    return single.unionByName(blocks)


def coverage(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(value, coverage): the share of a value's characters in runs of letters that the dictionary (word) holds."""
    values = found.select("value").distinct()
    runs = values.select("value", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    return runs.join(dictionary, "word").groupBy("value").agg((F.sum(F.char_length("word")) / F.char_length("value")).alias("coverage"))


def rarity(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(value, rarity): the mean of -log of the share that a value's pairs of characters have among the dictionary's pairs, each seen once more."""
    pairs = lambda c: F.when(F.char_length(c) > 1, F.transform(F.sequence(F.lit(1), F.char_length(c) - 1), lambda i: c.substr(i, F.lit(2))))
    counts = dictionary.select(F.explode(pairs(F.col("word"))).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    # At most 26 * 26 rows: dictionary words hold a to z only.
    shares = stored(counts.where(F.col("pair").rlike("^[a-z]{2}$")))
    total = (shares.agg(F.sum("n")).first()[0] or 0) + 26 * 26
    values = found.select("value").distinct().select("value", F.explode(pairs(F.lower("value"))).alias("pair"))
    known = values.join(F.broadcast(shares), "pair", "left").groupBy("value")
    return known.agg((F.log(F.lit(float(total))) - F.avg(F.log(F.coalesce("n", F.lit(0)) + 1))).alias("rarity"))


def with_features(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    v, n = F.col("value"), F.char_length("value")
    share = lambda pattern: F.regexp_count(v, F.lit(pattern)) / n
    flag = lambda c: c.cast("double")
    runs = F.regexp_count(v, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+"))
    covered, rare = coverage(found, dictionary), rarity(found, dictionary)
    return found.join(covered, "value", "left").join(rare, "value", "left").select(
        *[quoted(c) for c in found.columns],
        n.cast("double").alias("__length"),
        share("[0-9]").alias("__digits"),
        share("[A-Z]").alias("__upper"),
        share("[a-z]").alias("__lower"),
        share("[^a-zA-Z0-9]").alias("__symbols"),
        (runs / n).alias("__transitions"),
        *[share(f"[{a}](?=[{b}])").alias(f"__{name}") for name, a, b in STEPS],
        F.coalesce("rarity", F.lit(0.0)).alias("__rarity"),
        (F.size(F.array_distinct(F.split(v, ""))) / n).alias("__variety"),
        flag(v.rlike("^([0-9a-f]+|[0-9A-F]+)$")).alias("__hex"),
        F.coalesce("coverage", F.lit(0.0)).alias("__coverage"),
        share("/").alias("__slashes"),
        share(r"\.").alias("__dots"),
        flag(v.contains("@")).alias("__at"),
        flag(F.col("word").contains("://")).alias("__url"),
        flag(F.col("left").rlike(ANNOUNCED)).alias("__announced_left"),
        flag(F.col("before").rlike(ANNOUNCED)).alias("__announced_before"),
        flag((F.col("left") != "") | F.col("before").rlike("[=:]$")).alias("__assigned"),
        flag(F.col("word").rlike("[\"'`]")).alias("__quoted_word"),
        flag(F.col("after").rlike(r"^\p{L}+[.,]?$")).alias("__right_word"),
    )


def dictionary_table(df: DataFrame, words: Iterable[str]) -> DataFrame:
    """A dictionary (word) from a bounded list, such as a tokenizer's vocabulary."""
    rows = sorted({(w.lower(),) for w in words if len(w) >= 3 and w.isascii() and w.isalpha()})
    return df.sparkSession.createDataFrame(rows, "word string")


def scan(docs: DataFrame, findings: DataFrame, dictionary: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """One row for each candidate: doc_id, pos, value, score, is_secret.

    findings holds labelled candidates (columns of candidates() and label 0 or 1), dictionary known words. At most
    `sample` findings of least hash are fitted on. Null, empty and blank texts have no candidates; equal candidates at
    several places are all returned, as are those of repeated rows. Null ids are kept. Without labels of both classes
    the score is the share of the positive class (0 without any). Empty tables give an empty result.
    """
    order = F.xxhash64("doc_id", "pos", "value")
    chosen = stored(findings.where("label in (0, 1)").select("doc_id", "pos", "word", "value", "left", "before", "after", "label").orderBy(order, "doc_id", "pos", "value").limit(sample))
    shares = {r["label"]: r["count"] for r in chosen.groupBy("label").count().collect()}
    found = candidates(docs, text, doc_id)
    if len(shares) < 2:
        known = float(shares.get(1, 0) > 0)
        return found.select("doc_id", "pos", "value", F.lit(known).alias("score"), F.lit(known >= 0.5).alias("is_secret"))
    assemble = VectorAssembler(inputCols=[f"__{f}" for f in FEATURES], outputCol="__features")
    ready = assemble.transform(with_features(chosen, dictionary)).select("__features", "label")
    forest = RandomForestClassifier(labelCol="label", featuresCol="__features", numTrees=TREES, maxDepth=DEPTH, seed=SEED, predictionCol="__p", rawPredictionCol="__raw", probabilityCol="__prob").fit(ready)
    judged = forest.transform(assemble.transform(with_features(stored(found), dictionary)))
    score = vector_to_array("__prob")[1]
    return judged.select("doc_id", "pos", "value", score.alias("score"), (score >= 0.5).alias("is_secret"))


def weak_label(found: DataFrame) -> Column:
    """A label for findings nobody has looked at: published key formats and announced random values are 1; addresses, numbers, times, scheme words and file names are 0; the rest null."""
    v = F.col("value")
    announced = F.col("left").rlike(ANNOUNCED) | F.col("before").rlike(ANNOUNCED)
    random = v.rlike("^[0-9a-f]{16,}$") | (v.rlike("^[A-Za-z0-9_+/=-]{20,}$") & v.rlike("[0-9]") & v.rlike("[A-Za-z]"))
    # Numbers and times (2026-01-16T10:00:07Z), and the scheme word before an announced value.
    plain = v.rlike(r"^[0-9.:\-/ +TZ]+$") | v.rlike("^(?i:bearer|basic|token)$") | v.contains("@") | F.col("word").contains("://") | v.rlike(r"\.(com|org|net|html?|py|txt)\b")
    return F.when(v.rlike(f"^{KNOWN}$") | v.startswith("-----BEGIN "), 1).when(announced & random, 1).when(plain, 0)
