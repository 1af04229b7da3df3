"""Binding of irregular sheets: a table of cells becomes tracker, export, roster and efficiency rows.

cells: workbook, sheet, sheet_no, row, col (from 1), v_str, v_num, v_ts, link. Thousands of workbooks bind at once: every
step groups or joins by (workbook, sheet).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.coerce import cell_text, is_home_market, parse_date, parse_int, parse_number
from ..functions.forms import add_forms, header_key

MAX_HEADER_ROW, BLANK_RUN = 15, 200
SHEET = ["workbook", "sheet"]
#: Header keys by field.
TRACKER = {"campaign": "campaign", "no": "no", "name": "name", "post_date": "postdate", "post_link": "postlink", "like_n": "like", "collection": "collection", "comment_n": "comment", "impression": "impression", "ttl_engagement": "ttlengagement"}
EXPORT = {"blogger": "blogger", "username": "username", "post_id": "postid", "post_date": "postdate", "likes_retweet": "likes_retweet", "share_favorites": "share_favorites", "engagement": "engagement", "comments": "comments", "link_target": "link"}
WEIGHTED = ("weightedeng.", "weightedeng", "weightedengagement")
ROSTER = {"name": "name", "namebis": "namebis", "dmrid": "dmrid", "country": "country", "in_china": "in_china_reports", "redbook_id": "redbook_id", "followers": "redbook_followers"}
EFFICIENCY = {"no": "no", "campaign": "campaign", "type_raw": "type", "level_raw": "level", "name": "name", "fanbase_raw": "fanbase(k)", "post_date": "postdate", "post_link": "postlink", "impression": "impression", "like_n": "like", "collection": "collection", "comment_n": "comment", "ttl_engagement": "ttlengagement", "price": "price"}


def find_header(cells: DataFrame, required: Sequence[str], max_row: int = MAX_HEADER_ROW, last_wins: bool = False, ascii_only: bool = False) -> DataFrame:
    """(workbook, sheet, sheet_no, header_row, key, col): the smallest row whose keys include all required ones; a repeated header keeps its first column, or its last."""
    top = cells.where(F.col("row") <= max_row).select(*SHEET, "sheet_no", "row", "col", header_key(cell_text(F.col("v_str"), F.col("v_num")), ascii_only).alias("key")).where("key <> ''")
    need = F.array(*[F.lit(k) for k in required])
    rows = top.groupBy(*SHEET, "sheet_no", "row").agg(F.collect_set("key").alias("keys")).where(F.size(F.array_except(need, "keys")) == 0)
    first = rows.groupBy(*SHEET, "sheet_no").agg(F.min("row").alias("row"))
    pick = F.max("col") if last_wins else F.min("col")
    return top.join(first, [*SHEET, "sheet_no", "row"]).groupBy(*SHEET, "sheet_no", F.col("row").alias("header_row"), "key").agg(pick.alias("col"))


def first_sheet(header: DataFrame) -> DataFrame:
    """Of each workbook only the first sheet that has the header."""
    chosen = header.groupBy("workbook").agg(F.min("sheet_no").alias("sheet_no"))
    return header.join(chosen, ["workbook", "sheet_no"])


def truncate_after_blank_run(df: DataFrame, part: Sequence[str], row: str = "row", n: int = BLANK_RUN) -> DataFrame:
    """Rows before the first gap of more than n blank rows; df has the non-blank rows."""
    w = W.partitionBy(*part).orderBy(row)
    gap = F.coalesce(F.col(row) - F.lag(row).over(w) > n, F.lit(False))
    return df.withColumn("__gap", gap).withColumn("__cut", F.max("__gap").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).where("not __cut").drop("__gap", "__cut")


def forward_fill(df: DataFrame, col: str, part: Sequence[str], order: str) -> DataFrame:
    """Empty values take the last value above; before the first they are empty."""
    w = W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(col, F.coalesce(F.last(F.nullif(F.col(col), F.lit("")), ignorenulls=True).over(w), F.lit("")))


def link_value(link: Column, text: Column, strict: bool = False) -> Column:
    """The hyperlink's target, else the text (strict: only if it is a URL)."""
    shown = F.trim(F.coalesce(text, F.lit("")))
    shown = F.when(F.startswith(shown, F.lit("http")), shown).otherwise("") if strict else shown
    return F.coalesce(F.nullif(F.trim(link), F.lit("")), shown)


def grid(cells: DataFrame, header: DataFrame, fields: dict[str, str], filled: Callable[[], Column]) -> DataFrame:
    """One row for each sheet row below the header with a struct cell (text, num, ts, link) for each field; missing columns are null.

    Rows that are not filled count as blank: they are dropped before the rows after a long blank run are.
    """
    names = {key: f for f, key in fields.items()}
    mapped = header.where(F.col("key").isin(*names)).withColumnRenamed("col", "__col")
    body = cells.join(mapped, SHEET + ["sheet_no"]).where((F.col("row") > F.col("header_row")) & (F.col("col") == F.col("__col")))
    cell = F.struct(cell_text(F.col("v_str"), F.col("v_num")).alias("text"), F.col("v_num").alias("num"), F.col("v_ts").alias("ts"), F.coalesce("link", F.lit("")).alias("link"))
    out = body.groupBy(*SHEET, F.col("row").alias("excel_row")).agg(*[F.max(F.when(F.col("key") == key, cell)).alias(f) for f, key in fields.items()])
    return truncate_after_blank_run(out.where(filled()), SHEET, "excel_row")


def _text(name: str) -> Column:
    return F.coalesce(F.col(f"{name}.text"), F.lit(""))


def _int(name: str) -> Column:
    return F.coalesce(F.col(f"{name}.num").cast("bigint"), parse_int(F.col(f"{name}.text")))


def _float(name: str) -> Column:
    return F.coalesce(F.col(f"{name}.num"), parse_number(F.col(f"{name}.text")))


def _date(name: str, as_of: Column) -> Column:
    return parse_date(F.col(f"{name}.text"), as_of, F.col(f"{name}.num"), F.col(f"{name}.ts"))


def _link(name: str, strict: bool = False) -> Column:
    return link_value(F.col(f"{name}.link"), F.col(f"{name}.text"), strict)


def _named() -> Column:
    """A row with a name or a link."""
    return (_text("name") != "") | (_link("post_link") != "")


def bind_tracker(cells: DataFrame, as_of: Column) -> DataFrame:
    """Tracker rows of the first sheet with NAME and POST LINK; rows with neither are dropped, campaigns filled down."""
    g = grid(cells, first_sheet(find_header(cells, ("name", "postlink"))), TRACKER, _named)
    rows = g.select(*SHEET, "excel_row", _text("campaign").alias("campaign"), _text("no").alias("no"), _text("name").alias("name"), _date("post_date", as_of).alias("post_date"), _link("post_link").alias("post_link"),
                    *[_int(c).alias(c) for c in ("like_n", "collection", "comment_n", "impression", "ttl_engagement")])
    return forward_fill(rows, "campaign", SHEET, "excel_row")


def bind_export(cells: DataFrame, as_of: Column) -> DataFrame:
    """Export rows of the first sheet with BLOGGER and POSTID; rows with neither are dropped."""
    fields = EXPORT | {f"w{i}": key for i, key in enumerate(WEIGHTED)}
    g = grid(cells, first_sheet(find_header(cells, ("blogger", "postid"))), fields, lambda: (_text("blogger") != "") | (_text("post_id") != ""))
    rows = g.select(*SHEET, "excel_row", _text("blogger").alias("blogger"), _text("username").alias("username"), F.lower(_text("post_id")).alias("post_id"), _text("post_id").alias("post_id_raw"),
                    F.coalesce(F.col("post_date.ts"), F.to_timestamp(_date("post_date", as_of))).alias("post_date"), *[_int(c).alias(c) for c in ("likes_retweet", "share_favorites", "engagement", "comments")],
                    _link("link_target", True).alias("link_target"), F.coalesce(*[_float(f"w{i}") for i in range(len(WEIGHTED))]).alias("weighted_eng"))
    return rows


def bind_roster(cells: DataFrame, kind: str) -> DataFrame:
    """Roster rows of the kind's sheet, home market only, with their name forms; rows_scanned counts all rows of the sheet with a name."""
    other = {"micro": "macro", "macro": "micro"}[kind]
    key = header_key(F.col("sheet"))
    usable = cells.where(F.contains(key, F.lit(kind)) & ~F.contains(key, F.lit(other)))
    g = grid(usable, first_sheet(find_header(usable, ("name", "redbook_id"), last_wins=True)), ROSTER, lambda: (_text("name") != "") | (_text("namebis") != ""))
    rows = g.select(*SHEET, F.col("excel_row").alias("roster_row"), *[_text(c).alias(c) for c in ("name", "namebis", "dmrid", "country")], "in_china", F.lower(_text("redbook_id")).alias("redbook_id"), _int("followers").alias("followers"))
    sheet = W.partitionBy(*SHEET)
    flagged, placed = F.max(F.col("in_china").isNotNull()).over(sheet), F.max(F.col("country") != "").over(sheet)
    home = F.when(flagged, F.upper(F.coalesce(F.col("in_china.text"), F.lit(""))) == "YES").when(placed, is_home_market(F.col("country"))).otherwise(True)
    kept = rows.withColumn("rows_scanned", F.count("*").over(sheet)).withColumn("home", home).where("home").drop("home", "in_china")
    return add_forms(add_forms(kept, "name", "n_"), "namebis", "b_")


def _efficiency_sheet(cells: DataFrame) -> DataFrame:
    """Cells of the sheet MASTER KOL LIST, else of the first sheet."""
    named = header_key(F.col("sheet")) == "masterkollist"
    pick = cells.groupBy("workbook").agg(F.coalesce(F.min(F.when(named, F.col("sheet_no"))), F.min("sheet_no")).alias("sheet_no"))
    return cells.join(pick, ["workbook", "sheet_no"])


def bind_efficiency(cells: DataFrame, as_of: Column) -> DataFrame:
    """Efficiency rows of the sheet MASTER KOL LIST, else of the first sheet; all headers are required."""
    usable = _efficiency_sheet(cells)
    g = grid(usable, find_header(usable, tuple(EFFICIENCY.values())), EFFICIENCY | {"mcn": "mcn", "cpm_src": "cpm", "cpe_src": "cpe"}, _named)
    rows = g.select(*SHEET, "excel_row", *[_text(c).alias(c) for c in ("campaign", "no", "name", "type_raw", "level_raw", "mcn")], _date("post_date", as_of).alias("post_date"), _link("post_link").alias("post_link"),
                    *[_float(c).alias(c) for c in ("fanbase_raw", "price", "cpm_src", "cpe_src")], *[_int(c).alias(c) for c in ("impression", "like_n", "collection", "comment_n", "ttl_engagement")])
    return forward_fill(rows, "campaign", SHEET, "excel_row")


def missing_headers(cells: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(workbook, missing): required headers that no row near the top of the efficiency sheet has (rule V1); a workbook whose headers are spread over several rows lacks those outside its best row."""
    need = F.array(*[F.lit(k) for k in fields.values()])
    top = _efficiency_sheet(cells).where(F.col("row") <= MAX_HEADER_ROW).groupBy("workbook", "row").agg(F.collect_set(header_key(cell_text(F.col("v_str")))).alias("keys"))
    lacking = F.array_except(need, "keys")
    return top.groupBy("workbook").agg(F.min_by(lacking, F.struct(F.size(lacking), "row")).alias("missing")).where(F.size("missing") > 0)


def above_header(cells: DataFrame, header: DataFrame) -> DataFrame:
    """(workbook, sheet, text): the cells above the header, joined."""
    at = header.select(*SHEET, "header_row").distinct()
    cell = F.struct("row", "col", cell_text(F.col("v_str"), F.col("v_num")).alias("t"))
    rows = cells.join(at, SHEET).where(F.col("row") < F.col("header_row")).where(cell["t"] != "")
    return rows.groupBy(*SHEET).agg(F.array_join(F.transform(F.array_sort(F.collect_list(cell)), lambda x: x["t"]), " | ").alias("text"))


def export_window(cells: DataFrame, header: DataFrame, as_of: Column) -> DataFrame:
    part = lambda i: parse_date(F.regexp_extract("text", r"(?i)from\s+([^,|]+?)\s+to\s+([^,|]+)", i), as_of)
    return above_header(cells, header).select(*SHEET, part(1).alias("from_date"), part(2).alias("to_date"))


def roster_extraction_date(cells: DataFrame, header: DataFrame) -> DataFrame:
    return above_header(cells, header).select(*SHEET, F.regexp_extract("text", r"(\d{2}/\d{2}/\d{4}(?: \d{2}:\d{2}:\d{2})?)", 1).alias("extracted"))


def duplicate_identity(tracker: DataFrame) -> DataFrame:
    """Every repeat of (campaign, no) after the first."""
    w = W.partitionBy("campaign", "no").orderBy("excel_row")
    return tracker.withColumn("__k", F.row_number().over(w)).where("__k > 1").drop("__k")


def digest(df: DataFrame, bad: Column, code: str, part: Sequence[str] = (), shown: int = 5) -> DataFrame:
    """The first offending rows and their number. The first ones are kept by a bounded sort per group."""
    rows = df.where(bad).select(*part, "excel_row")
    total = rows.groupBy(*part).agg(F.count("*").alias("total"))
    place = F.row_number().over(W.partitionBy(*part).orderBy("excel_row"))
    few = rows.distinct().withColumn("__place", place).where(F.col("__place") <= shown)
    first = few.groupBy(*part).agg(F.array_sort(F.collect_list("excel_row")).alias("first_rows"))
    if not part:
        return total.where("total > 0").join(first, how="full_outer").select(F.lit(code).alias("code"), "total", "first_rows").where("total > 0")
    return total.join(first, list(part)).select(*part, F.lit(code).alias("code"), "total", "first_rows")


def export_checks(export: DataFrame) -> DataFrame:
    """Whether user names are missing altogether, and how many embedded ids differ from the post id."""
    from ..functions.urls import embedded_post_id

    inner = embedded_post_id(F.col("link_target"))
    return export.agg((F.count_if(F.coalesce("username", F.lit("")) != "") == 0).alias("no_usernames"), F.count_if((inner != "") & (inner != F.col("post_id"))).alias("id_mismatch"))
