"""Agreement of annotations with labelled references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .match import MISLABEL, TEXT
from .output import latest


def classify_annotation(c: Column) -> Column:
    """Collapse an annotation to its class, rules in order."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return (
        F.when(t == "", "MATCH")
        .when(F.startswith(t, F.lit(TEXT["NO_BLOGGER"])), TEXT["NO_BLOGGER"])
        .when(F.startswith(t, F.lit(TEXT["NO_POST"])), TEXT["NO_POST"])
        .when(F.startswith(t, F.lit("人工")) | F.contains(t, F.lit(TEXT["REVIEW"])), TEXT["REVIEW"])
        .when(F.startswith(F.lower(t), F.lit("check")) | F.contains(t, F.lit("链接")), TEXT["LINK_ERROR"])
        .when(F.contains(t, F.lit("标注错误")) | F.contains(t, F.lit("名字")), MISLABEL)
        .otherwise(t)
    )


def load_labels(df: DataFrame) -> DataFrame:
    return df.select("campaign", "no", F.coalesce("annotation", F.lit("")).alias("annotation"))


def compare_labels(labels: DataFrame, verdicts: DataFrame, noise: DataFrame | None = None) -> DataFrame:
    """campaign, no, want, got, agrees, excused, by_id; of repeated tracker keys the last row counts. verdicts: campaign, no, name, post_date, excel_row, tier, annotation."""
    last = latest(verdicts, ["campaign", "no"], "excel_row").select("campaign", "no", "name", "post_date", "tier", F.col("annotation").alias("__got"))
    out = labels.join(last, ["campaign", "no"], "left").withColumn("want", classify_annotation(F.col("annotation"))).withColumn("got", F.when(F.col("tier").isNotNull(), classify_annotation(F.col("__got"))).otherwise("MISSING"))
    if noise is not None:
        known = noise.select(F.col("name").alias("__n"), F.col("post_date").alias("__d")).distinct()
        out = out.join(known, (F.col("name") == F.col("__n")) & (F.col("post_date") == F.col("__d")), "left").withColumn("excused", F.col("__n").isNotNull() & (F.col("want") != F.col("got")))
    else:
        out = out.withColumn("excused", F.lit(False))
    return out.select("campaign", "no", "want", "got", (F.col("want") == F.col("got")).alias("agrees"), "excused", F.coalesce(F.startswith("tier", F.lit("1:")) | F.startswith("tier", F.lit("2:")), F.lit(False)).alias("by_id"))


def confusion(compared: DataFrame) -> DataFrame:
    return compared.groupBy("want", "got").agg(F.count("*").alias("n"))


def acceptance(compared: DataFrame, allowed: int = 2) -> DataFrame:
    agree, excused = F.count_if("agrees"), F.count_if("excused")
    return compared.agg(
        F.count("*").alias("total"), agree.alias("agree"), excused.alias("excused"), F.count_if(~F.col("agrees") & ~F.col("excused") & F.col("by_id")).alias("id_proven"),
        F.count_if(~F.col("agrees") & ~F.col("excused") & ~F.col("by_id")).alias("unexplained"), (agree + excused >= F.count("*") - allowed).alias("accepted"),
    )


def table_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows on one side only, with repeats."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
