"""Header remapping: signatures of layouts, checks of proposals and approvals, and their application to cell tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.coerce import cell_text
from ..functions.forms import header_key
from ..sources.bind import EFFICIENCY, EXPORT, TRACKER

MAX_COLUMNS, MAX_SHEETS, MAX_ROWS, SAMPLE_CHARS = 24, 6, 15, 60
#: Header keys by kind and field.
FIELDS = {"tracker": TRACKER, "export": EXPORT | {"weighted_eng": "weightedeng."}, "efficiency": EFFICIENCY}
#: Fields that an approval must map.
REQUIRED = {"tracker": ("name", "post_link"), "export": ("blogger", "post_id"), "efficiency": tuple(EFFICIENCY)}


def field_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, f, h, f in REQUIRED[k]) for k, fields in FIELDS.items() for f, h in fields.items()], "kind string, field string, header string, required boolean")


def _top(cells: DataFrame) -> DataFrame:
    sheets = cells.select("workbook", "sheet", "sheet_no").distinct().withColumn("rank", F.dense_rank().over(W.partitionBy("workbook").orderBy("sheet_no"))).where(F.col("rank") <= MAX_SHEETS).select("workbook", "sheet")
    near = cells.where((F.col("row") <= MAX_ROWS) & (F.col("col") <= MAX_COLUMNS))
    return near.join(sheets, ["workbook", "sheet"], "left_semi").withColumn("text", cell_text(F.col("v_str"), F.col("v_num")))


def candidate_signatures(cells: DataFrame) -> DataFrame:
    """(workbook, sheet, sheet_no, row, sig) of every non-empty row near the top; trailing blanks do not count."""
    filled = _top(cells).where("text <> ''")
    rows = filled.groupBy("workbook", "sheet", "sheet_no", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("m"), F.max("col").alias("last"))
    texts = F.transform(F.sequence(F.lit(1), F.col("last")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("")))
    return rows.select("workbook", "sheet", "sheet_no", "row", F.substring(F.sha2(F.to_json(F.struct(texts.alias("cells"), "row", "sheet")), 256), 1, 32).alias("sig"))


def lookup_mapping(signatures: DataFrame, approved: DataFrame, kind: str) -> DataFrame:
    """The approved mapping of each workbook: the first row in sheet order whose signature, sheet and row were approved."""
    a = approved.where(F.col("kind") == kind).select("sig", F.col("sheet").alias("__sheet"), "header_row", "columns", "approved_by")
    hit = signatures.join(a, "sig").where((F.col("sheet") == F.col("__sheet")) & (F.col("row") == F.col("header_row")))
    return hit.withColumn("__k", F.row_number().over(W.partitionBy("workbook").orderBy("sheet_no", "row"))).where("__k = 1").drop("__k", "__sheet")


def validate_proposal(proposals: DataFrame, kind: str, sheets: DataFrame) -> DataFrame:
    """(id, sheet, header_row, field, col): known sheets and header rows only, unknown fields dropped, columns in range and used once (the first field keeps it), others null.

    proposals: id, sheet, header_row, columns (map from field to column).
    """
    order = F.array(*[F.lit(f) for f in FIELDS[kind]])
    good = proposals.join(sheets.select("sheet").distinct(), "sheet", "left_semi").where(F.col("header_row").between(1, MAX_ROWS))
    rows = good.select("id", "sheet", "header_row", F.explode("columns").alias("field", "col")).withColumn("o", F.array_position(order, F.col("field"))).where("o > 0")
    ranged = rows.withColumn("col", F.when(F.col("col").between(1, MAX_COLUMNS), F.col("col")))
    k = F.row_number().over(W.partitionBy("id", "col").orderBy("o"))
    return ranged.withColumn("col", F.when(k == 1, F.col("col"))).select("id", "sheet", "header_row", "field", "col")


def validate_approval(mapping: DataFrame, kind: str) -> DataFrame:
    """(id, error, what): required fields without a column, and columns of several fields. mapping: id, field, col."""
    need = F.array(*[F.lit(f) for f in REQUIRED[kind]])
    have = mapping.groupBy("id").agg(F.collect_set(F.when(F.col("col").isNotNull(), F.col("field"))).alias("have"))
    missing = have.select("id", F.lit("missing").alias("error"), F.explode(F.array_except(need, "have")).alias("what"))
    twice = mapping.where("col is not null").groupBy("id", "col").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate"), F.col("col").cast("string"))
    return missing.union(twice)


def apply_mapping(cells: DataFrame, mapping: DataFrame, kind: str) -> DataFrame:
    """Cells with canonical headers at the mapped columns; other headers that collide with one are marked as original. mapping: workbook, sheet, header_row, columns."""
    names = F.create_map(*[F.lit(x) for pair in FIELDS[kind].items() for x in pair])
    m = mapping.select("workbook", "sheet", "header_row", F.explode("columns").alias("field", "__col")).where("__col is not null").select("workbook", "sheet", F.col("header_row").alias("row"), F.col("__col").alias("col"), F.element_at(names, F.col("field")).alias("__name"))
    used = m.groupBy("workbook", "sheet", "row").agg(F.collect_set("__name").alias("__used"))
    out = cells.join(m, ["workbook", "sheet", "row", "col"], "left").join(used, ["workbook", "sheet", "row"], "left")
    clash = F.coalesce(F.array_contains("__used", header_key(F.col("v_str"))), F.lit(False))
    value = F.when(F.col("__name").isNotNull(), F.col("__name")).when(clash, F.concat(F.lit("(original) "), F.col("v_str"))).otherwise(F.col("v_str"))
    return out.withColumn("v_str", value).select(*cells.columns)


def column_choices(cells: DataFrame, header: DataFrame, samples: int = 2) -> DataFrame:
    """(workbook, sheet, col, header, samples) for the non-empty columns; header: workbook, sheet, header_row."""
    rows = cells.join(header, ["workbook", "sheet"]).where(F.col("row").between(F.col("header_row"), F.col("header_row") + samples)).withColumn("text", cell_text(F.col("v_str"), F.col("v_num")))
    out = rows.groupBy("workbook", "sheet", "col").agg(
        F.max(F.when(F.col("row") == F.col("header_row"), F.col("text"))).alias("header"),
        F.transform(F.array_sort(F.collect_list(F.when((F.col("row") > F.col("header_row")) & (F.col("text") != ""), F.struct("row", "text")))), lambda x: x["text"]).alias("samples"))
    return out.withColumn("header", F.coalesce("header", F.lit(""))).where((F.col("header") != "") | (F.size("samples") > 0))


def provenance(mapping: DataFrame, kind: str, auto: bool) -> DataFrame:
    return mapping.select("workbook", F.lit(kind).alias("kind"), "sheet", "header_row", "columns", F.lit(auto).alias("auto"), "approved_by")


def structural_sample(cells: DataFrame) -> DataFrame:
    """(workbook, sheet, row, col, text) near the top, texts cut, trailing empty rows dropped."""
    top = _top(cells).withColumn("text", F.substring("text", 1, SAMPLE_CHARS))
    last = top.where("text <> ''").groupBy("workbook", "sheet").agg(F.max("row").alias("last"))
    return top.join(last, ["workbook", "sheet"]).where(F.col("row") <= F.col("last")).select("workbook", "sheet", "row", "col", "text")
