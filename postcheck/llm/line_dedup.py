"""Line dedup: drop lines that many documents share.

Lines are exploded and hashed (128 bits, so that distinct keys do not meet at any corpus size); the distinct documents
of each hash are counted; hashes over the threshold mark positions; each text is reassembled by position. Only hashes,
ids and positions are exploded: the text itself moves once, when the dropped positions come back to its row. A line
that a third of all documents hold is counted by (hash, row) first and its join partition is split by adaptive
execution, so no task holds a hot line alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, UPPER, bound, quoted, stored


def line_keys(text: Column) -> Column:
    """The key of each line: white space stripped at both ends, A-Z lower-cased."""
    lines = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "\n", -1)
    return F.transform(lines, lambda x: F.btrim(x, F.lit(SPACE)))


def _hash(key: Column) -> Column:
    """128 bits of a key as a struct of two seeded 64-bit hashes."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


def drop_common_lines(
    df: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    min_documents: int = 10,
    min_chars: int = 1,
    stats: bool = True,
) -> DataFrame:
    """Replace each text by the lines that stay, joined by newlines; with stats, append n_lines and n_dropped.

    A key of at least min_chars code points that is found in at least min_documents documents loses all its lines,
    everywhere. Documents are told apart by doc_id; rows of one id count once, a null id is an id of its own. A null
    or empty text is one empty line and becomes the empty text (its key has no code points, so it is never dropped
    for min_chars of 1 or more). A text that loses every line becomes empty. Every row is returned, repeated rows too;
    other columns are kept and n_lines and n_dropped replace columns of the same name. An empty table stays empty.
    """
    names = [c for c in df.columns if not stats or c not in ("n_lines", "n_dropped")]
    # A row is found again by the 128-bit hash of its id and text; equal rows share their dropped positions.
    tagged = df.select(
        F.struct(*[quoted(c) for c in names]).alias("row"),
        F.xxhash64(quoted(doc_id), quoted(text)).alias("ra"),
        F.xxhash64(F.lit(1), quoted(doc_id), quoted(text)).alias("rb"),
    )
    exploded = df.select(
        quoted(doc_id).alias("doc"),
        F.xxhash64(quoted(doc_id), quoted(text)).alias("ra"),
        F.xxhash64(F.lit(1), quoted(doc_id), quoted(text)).alias("rb"),
        F.posexplode(F.transform(line_keys(quoted(text)), lambda x: F.when(F.char_length(x) >= min_chars, _hash(x)))).alias("pos", "h"),
    ).where("h is not null").select("doc", "ra", "rb", "pos", F.col("h.a").alias("ha"), F.col("h.b").alias("hb"))
    common = stored(
        exploded.groupBy("ha", "hb", "doc").agg(F.lit(1).alias("one"))
        .groupBy("ha", "hb").agg(F.count("*").alias("docs"))
        .where(F.col("docs") >= min_documents).select("ha", "hb")
    )
    dropped = (
        exploded.join(common, ["ha", "hb"]).groupBy("ra", "rb").agg(F.collect_set("pos").alias("drop"))
    )
    joined = tagged.join(dropped, ["ra", "rb"], "left")
    lines = F.split(F.coalesce(F.col("row").getField(text), F.lit("")), "\n", -1)
    # array_except hashes, so a text of many lines costs in proportion; the positions stay in order.
    stay = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("drop"))
    kept = bound(lines, lambda x: F.transform(stay(x), lambda i: F.get(x, i)))
    out = [
        F.when(F.col("drop").isNull(), F.coalesce(F.col("row").getField(c), F.lit(""))).otherwise(F.array_join(kept, "\n")).alias(c)
        if c == text
        else F.col("row").getField(c).alias(c)
        for c in names
    ]
    if stats:
        n_lines = F.size(lines).cast("long")
        out += [n_lines.alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped")]
    return joined.select(*out)
