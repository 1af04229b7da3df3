"""Questions about leftovers and the answers to them, as tables. The model itself is outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BATCH, SHOWN = 15, 5
#: The answers' vocabulary.
ANSWERS = ("SAME_PERSON", "SAME_POST", "DIFFERENT", "UNSURE")
_ITEM = "struct<row:string,verdict:string,confidence:double,rationale_en:string,rationale_zh:string>"


def row_key() -> Column:
    return F.concat(F.col("campaign"), F.lit("|"), F.col("no"), F.lit("|r"), F.col("excel_row").cast("string"))


def questions(verdicts: DataFrame) -> DataFrame:
    """row, batch, question, payload for reviews and dead links that have candidates (at most SHOWN each in the payload).

    Batches number the rows of one campaign, so that no window spans the whole table.
    """
    asked = verdicts.where(F.col("status").isin("REVIEW", "LINK_ERROR") & (F.size("candidates") > 0))
    kind = F.when(F.endswith("tier", F.lit("name-conflict")), "same_person").otherwise("same_post")
    reason = F.when(F.col("review_reason") == "", "link unresolvable").otherwise(F.col("review_reason"))
    tracker = F.struct("name", F.col("post_date").cast("string").alias("post_date"), F.col("status").alias("status_so_far"), reason.alias("reason"))
    payload = F.to_json(F.struct(row_key().alias("row"), kind.alias("question"), tracker.alias("tracker"), F.struct("note_id", "author_id").alias("resolved"), F.slice("candidates", 1, SHOWN).alias("candidates")))
    place = F.row_number().over(W.partitionBy("campaign").orderBy("excel_row"))
    return asked.select("campaign", row_key().alias("row"), F.floor((place - 1) / BATCH).alias("batch"), kind.alias("question"), payload.alias("payload"))


def parse_answers(df: DataFrame, text: str) -> DataFrame:
    """One row for each answered item: row, verdict, confidence, rationale_en, rationale_zh, position.

    A code fence is taken off; the whole text, its widest {...} and its widest [...] are tried in turn, a bare array is taken
    as the items. A reading with a bad item (vocabulary, confidence outside 0 to 1, no row or rationale) is rejected and
    the next one tried; a text without a good reading gives no rows.
    """
    bare = F.regexp_replace(F.trim(F.col(text)), r"(?s)^```\w*\s*|\s*```$", "")
    tries = []
    for piece in (bare, F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.regexp_extract(bare, r"(?s)(\[.*\])", 1)):
        tries += [F.from_json(piece, f"struct<items:array<{_ITEM}>>")["items"], F.when(F.startswith(F.trim(piece), F.lit("[")), F.from_json(piece, f"array<{_ITEM}>"))]
    whole = lambda x: x["row"].isNotNull() & x["rationale_en"].isNotNull() & x["rationale_zh"].isNotNull()
    fine = lambda items: F.forall(items, lambda x: F.coalesce(x["verdict"].isin(*ANSWERS) & x["confidence"].between(0, 1) & whole(x), F.lit(False)))
    items = F.coalesce(*[F.when(fine(t), t) for t in tries])
    return df.withColumn("items", items).where(F.col("items").isNotNull()).select(*[c for c in df.columns if c != text], F.posexplode("items").alias("position", "i")).select("*", "i.*").drop("i")


def apply_answers(verdicts: DataFrame, answers: DataFrame) -> DataFrame:
    """Append answer, answer_confidence and answer_note; the last answer of a row counts, unknown rows are ignored, no status changes."""
    one = answers.groupBy("row").agg(F.max_by(F.struct("verdict", "confidence"), "position").alias("a"))
    joined = verdicts.withColumn("__row", row_key()).join(one.withColumnRenamed("row", "__r"), F.col("__row") == F.col("__r"), "left")
    note = F.when((F.col("a.verdict") == "UNSURE") & (F.col("status") != "REVIEW"), "unsure: verify by hand").otherwise("")
    return joined.select(*[f"`{c}`" for c in verdicts.columns], F.col("a.verdict").alias("answer"), F.col("a.confidence").alias("answer_confidence"), note.alias("answer_note"))


def summary_text(counts: DataFrame) -> DataFrame:
    """One line in two languages from (status, n)."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("status", F.col("n").cast("string").alias("n")))), lambda x: F.concat(x["status"], F.lit("="), x["n"])), ", ")
    return counts.agg(F.concat(F.lit("Run summary: "), line).alias("en"), F.concat(F.lit("运行摘要: "), line).alias("zh"))
