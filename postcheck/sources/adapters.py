"""The domain tables derived from the provided ones. Each formula is portable SQL, used by Spark here and by the DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRACKER = {
    "excel_row": "o_orderkey + 2",
    "campaign": "'C#' || CAST(year(o_orderdate) AS STRING)",
    "no": "CAST(o_orderkey AS STRING)",
    "name": "'k' || CAST(o_custkey AS STRING) || 'z'",
    "post_date": "CAST(o_orderdate AS DATE)",
    "post_link": "'http://x.co/' || CAST(o_orderkey AS STRING)",
}
RESOLUTIONS = {
    "url": "'http://x.co/' || CAST(o_orderkey AS STRING)",
    "status": "CASE WHEN o_orderkey % 11 = 0 THEN 'failed' ELSE 'ok' END",
    "note_id": "CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE CAST(o_orderkey AS STRING) END",
    "author_id": "CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 7 = 0 THEN '' ELSE CAST(o_custkey AS STRING) END",
    "resolved_at": "CAST(o_orderkey % 100 AS DOUBLE) * 3600",
}
EXPORT = {
    "excel_row": "o_orderkey + 1",
    "post_id": "CAST(o_orderkey AS STRING)",
    "username": "CASE WHEN o_custkey % 25 = 0 THEN 'alt' || CAST(o_custkey AS STRING) ELSE CAST(o_custkey AS STRING) END",
    "blogger": "CASE WHEN o_orderkey % 4 = 0 AND o_custkey % 25 <> 0 THEN 'x' || CAST(o_custkey AS STRING) ELSE 'k' || CAST(o_custkey AS STRING) || 'z' END",
    "post_date": "CAST(first_ship AS DATE)",
    "likes_retweet": "o_orderkey % 1000",
    "share_favorites": "o_orderkey % 77",
    "comments": "CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderkey % 55 END",
    "engagement": "o_orderkey % 1000 + o_orderkey % 77",
    "weighted_eng": "CAST(o_orderkey % 1000 AS DOUBLE) / 4",
}
EXPORT_FILTER = "o_orderkey % 3 <> 0 AND (o_custkey % 5 <> 0 OR (o_custkey % 25 = 0 AND o_orderkey % 2 <> 0))"
#: Some names hold another customer's too, who is in no roster, and some entries have no id.
ROSTER = {
    "name": "'k' || CAST(c_custkey AS STRING) || 'z' || CASE WHEN c_custkey % 30 = 0 THEN 'k' || CAST(c_custkey + 5 AS STRING) || 'z' WHEN c_custkey % 60 = 10 THEN 'k' || CAST(c_custkey - 5 AS STRING) || 'z' ELSE '' END",
    "redbook_id": "CASE WHEN c_custkey % 90 = 0 THEN '' ELSE CAST(c_custkey AS STRING) END",
    "followers": "c_custkey % 1000",
    "roster_row": "c_custkey",
}
ROSTER_FILTER = {"micro": "c_custkey % 10 = 0", "macro": "c_custkey % 15 = 0"}
EFFICIENCY = {
    "excel_row": "l_orderkey * 8 + l_linenumber",
    "part": "l_partkey * 100000 + l_suppkey",
    "campaign": "'EFF'",
    "name": "'k' || CAST(l_orderkey AS STRING)",
    "type_raw": "CASE l_returnflag WHEN 'A' THEN '报备图文' WHEN 'R' THEN '软植图文' ELSE CASE WHEN l_linenumber % 2 = 0 THEN '报备' ELSE '其他' END END",
    "level_raw": "CASE l_linenumber WHEN 1 THEN '头部' WHEN 2 THEN '腰部' WHEN 3 THEN '尾部' WHEN 4 THEN '底部' WHEN 5 THEN 'KOC' ELSE '' END",
    "fanbase_raw": "CASE WHEN l_linenumber = 7 AND l_partkey % 2 = 0 THEN NULL ELSE CAST((l_partkey % 1500) * (CASE WHEN l_partkey % 50 = 0 THEN 1000 ELSE 1 END) AS DOUBLE) END",
    "mcn": "CASE WHEN l_suppkey % 10 = 0 THEN '' WHEN l_orderkey % 2 = 0 THEN upper(s_name) ELSE s_name END",
    "impression": "CASE WHEN l_quantity <= 1 THEN 0 ELSE CAST(l_quantity * 1000 AS BIGINT) END",
    "like_n": "CAST(l_linenumber * 10 AS BIGINT)",
    "collection": "l_suppkey % 7",
    "comment_n": "l_partkey % 5",
    "ttl_engagement": "CASE WHEN l_orderkey % 13 = 0 THEN 0 ELSE l_linenumber * 10 + l_suppkey % 7 + l_partkey % 5 END",
    "price": "CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_extendedprice END",
    "cpm_src": "CASE WHEN l_quantity > 1 THEN l_extendedprice / (l_quantity * 1000) * (CASE WHEN l_partkey % 20 = 0 THEN 1.5 ELSE 1.0 END) END",
    "cpe_src": "CAST(NULL AS DOUBLE)",
    "post_link": "'http://x.co/' || CAST(l_orderkey AS STRING) || '/' || CAST(l_linenumber AS STRING)",
}


def _select(formulas: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in formulas.items())


#: CTEs for the oracles, by table.
SQL = {
    "tracker": f"tracker AS (SELECT {_select(TRACKER)} FROM orders)",
    "resolutions": f"resolutions AS (SELECT {_select(RESOLUTIONS)} FROM orders)",
    "export": f"export AS (SELECT {_select(EXPORT)} FROM (SELECT o_orderkey, o_custkey, min(l_shipdate) AS first_ship FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey) WHERE {EXPORT_FILTER})",
    "micro": f"micro AS (SELECT {_select(ROSTER)} FROM customer WHERE {ROSTER_FILTER['micro']})",
    "macro": f"macro AS (SELECT {_select(ROSTER)} FROM customer WHERE {ROSTER_FILTER['macro']})",
    "efficiency": f"efficiency AS (SELECT {_select(EFFICIENCY)} FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)",
}


def with_tables(*names: str) -> str:
    """WITH clause of the named adapter tables."""
    return "WITH " + ", ".join(SQL[n] for n in names)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _columns(formulas: dict[str, str]) -> list[str]:
    return [f"{e} AS {n}" for n, e in formulas.items()]


def tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr(*_columns(TRACKER))


def resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr(*_columns(RESOLUTIONS))


def export(spark: SparkSession, sf_dir: str) -> DataFrame:
    ships = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("first_ship"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").where(EXPORT_FILTER)
    return orders.join(ships, "o_orderkey").selectExpr(*_columns(EXPORT))


def roster(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return read(spark, sf_dir, "customer").where(ROSTER_FILTER[kind]).selectExpr(*_columns(ROSTER))


def efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return read(spark, sf_dir, "lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).selectExpr(*_columns(EFFICIENCY))

#: Cells of five workbooks: a note on row 1, headers on row 2, one row for each supplier below.
CELL_HEADERS = (("NAME", 1), ("POST LINK", 2), ("Impression", 3), ("CAMPAIGN", 4), ("POST DATE", 5))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = read(spark, sf_dir, "supplier").selectExpr("'w' || CAST(s_nationkey % 5 AS STRING) AS workbook", "CAST(s_suppkey + 3 AS INT) AS row", "*")
    text = lambda e, col: F.struct(F.lit(col).alias("col"), F.expr(e).cast("string").alias("v_str"), F.lit(None).cast("double").alias("v_num"))
    number = F.struct(F.lit(3).alias("col"), F.lit(None).cast("string").alias("v_str"), F.col("s_acctbal").alias("v_num"))
    each = F.array(text("s_name", 1), text("'http://x.co/' || CAST(s_suppkey AS STRING)", 2), number, text("CASE WHEN s_suppkey % 4 = 0 THEN 'C' || CAST(s_suppkey AS STRING) ELSE '' END", 4),
                   text("CASE s_suppkey % 3 WHEN 0 THEN '2026-05-1' || CAST(s_suppkey % 10 AS STRING) WHEN 1 THEN '5/1' || CAST(s_suppkey % 10 AS STRING) || '/2026' ELSE '2026.05.1' || CAST(s_suppkey % 10 AS STRING) END", 5))
    body = base.select("workbook", "row", F.explode(each).alias("c")).select("workbook", "row", "c.*")
    head = F.array(*[F.struct(F.lit(2).alias("row"), F.lit(c).alias("col"), F.lit(h).alias("v_str")) for h, c in CELL_HEADERS], F.struct(F.lit(1).alias("row"), F.lit(1).alias("col"), F.lit("User: x, Top - From 2026/01/01 To 2026/07/20").alias("v_str")))
    heads = base.select("workbook").distinct().select("workbook", F.explode(head).alias("c")).select("workbook", "c.row", "c.col", "c.v_str", F.lit(None).cast("double").alias("v_num"))
    every = body.select("workbook", "row", "col", "v_str", "v_num").unionByName(heads)
    return every.select("workbook", F.lit("S1").alias("sheet"), F.lit(1).alias("sheet_no"), "row", "col", "v_str", "v_num", F.lit(None).cast("timestamp").alias("v_ts"), F.lit(None).cast("string").alias("link"))


def sheet(base: DataFrame, workbook: str, name: str, number: int, header_row: int, row: str, columns: list[tuple[str, str, str]], note: str = "") -> DataFrame:
    """Cells of one sheet in each workbook: headers in header_row, one row for each row of base, a note in the first cell.

    columns: header, formula, and how the value is held (str, num, ts, or link: the text of str and a hyperlink). Columns count from 1; a header
    that starts with = is a formula itself, null where the workbook lacks the column.
    """
    empty = {"v_str": F.lit(None).cast("string"), "v_num": F.lit(None).cast("double"), "v_ts": F.lit(None).cast("timestamp"), "link": F.lit(None).cast("string")}

    def cell(col: int, formula: str, kind: str):
        text, _, target = formula.partition(" ; ")
        given = {"num": {"v_num": F.expr(text).cast("double")}, "ts": {"v_ts": F.expr(text).cast("timestamp")}}.get(kind, {"v_str": F.expr(text).cast("string")})
        given |= {"link": F.expr(target).cast("string")} if kind == "link" else {}
        return F.struct(F.lit(col).alias("col"), *[(empty | given)[n].alias(n) for n in empty])

    at = base.withColumn("__workbook", F.expr(workbook))
    body = at.select(F.col("__workbook").alias("workbook"), F.expr(row).cast("int").alias("row"), F.explode(F.array(*[cell(i, f, k) for i, (_, f, k) in enumerate(columns, 1)])).alias("c"))
    titles = [(header_row, cell(i, h[1:] if h.startswith("=") else f"'{h}'", "str")) for i, (h, _, _) in enumerate(columns, 1)] + ([(1, cell(1, f"'{note}'", "str"))] if note else [])
    top = at.select(F.col("__workbook").alias("workbook")).distinct().select("workbook", F.explode(F.array(*[F.struct(F.lit(r).alias("row"), c.alias("c")) for r, c in titles])).alias("t"))
    heads = top.select("workbook", "t.row", "t.c")
    return body.unionByName(heads).select("workbook", F.lit(name).alias("sheet"), F.lit(number).alias("sheet_no"), "row", "c.*")


def export_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five export workbooks over the orders: a sheet that lacks a header, the export, and another export behind it."""
    o = read(spark, sf_dir, "orders")
    book, hyper = "'w' || CAST(o_orderkey % 5 AS STRING)", "CASE WHEN o_orderkey % 3 = 0 THEN 'http://h.co/' || CAST(o_orderkey AS STRING) END"
    weighted = "=CASE CAST(substr(workbook, 2) AS INT) % 3 WHEN 0 THEN 'Weighted Eng.' WHEN 1 THEN 'WEIGHTED ENG' ELSE 'weighted engagement' END"
    columns = [
        ("BLOGGER", "CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'k' || CAST(o_custkey AS STRING) || 'z' END", "str"),
        ("USERNAME", "CAST(o_custkey AS STRING)", "str"),
        ("POST ID", "CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE lpad(hex(o_orderkey), 24, '0') END", "str"),
        ("POST DATE", "o_orderdate", "ts"),
        ("LIKES_RETWEET", "o_orderkey % 1000", "num"),
        ("SHARE_FAVORITES", "CASE WHEN o_orderkey % 2 = 0 THEN '1,234' ELSE 'n/a' END", "str"),
        ("ENGAGEMENT", "o_totalprice", "num"),
        ("COMMENTS", "CAST(o_orderkey % 7 AS STRING)", "str"),
        ("LINK", "CASE WHEN o_orderkey % 2 = 0 THEN 'http://t.co/' || CAST(o_orderkey AS STRING) ELSE 'see note' END ; " + hyper, "link"),
        (weighted, "o_totalprice", "num"),
    ]
    other = [("BLOGGER", "'other'", "str"), ("NOTE", "'x'", "str")]
    return sheet(o, book, "Notes", 1, 1, "o_orderkey + 2", other).unionByName(sheet(o, book, "Data", 2, 3, "o_orderkey + 4", columns)).unionByName(sheet(o, book, "Old", 3, 1, "o_orderkey + 2", columns))


def roster_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three roster workbooks over the customers, with a market flag, with countries, with neither; the name's header occurs twice."""
    c = read(spark, sf_dir, "customer")
    columns = [
        ("NAME", "'old'", "str"),
        ("NAME BIS", "'b' || CAST(c_custkey AS STRING)", "str"),
        ("DMR ID", "CAST(c_custkey + 7 AS STRING)", "str"),
        ("=CASE WHEN workbook <> 'r2' THEN 'COUNTRY' END", "CASE WHEN c_custkey % 3 = 2 THEN NULL WHEN c_custkey % 4 < 2 THEN 'Mainland China' ELSE 'France' END", "str"),
        ("=CASE WHEN workbook = 'r0' THEN 'IN_CHINA_REPORTS' END", "CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'yes' ELSE 'NO' END END", "str"),
        ("REDBOOK_ID", "'ID' || CAST(c_custkey AS STRING)", "str"),
        ("REDBOOK_FOLLOWERS", "c_custkey % 1000", "num"),
        ("name", "c_name", "str"),
    ]
    book = "'r' || CAST(c_custkey % 3 AS STRING)"
    note = "Extracted 01/08/2026 10:00:00"
    return sheet(c, book, "List Macro", 1, 3, "c_custkey + 4", columns, note).unionByName(sheet(c, book, "List Micro", 2, 3, "c_custkey + 4", columns, note))


def efficiency_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four efficiency workbooks over the customers: the named sheet stands second in two, two have one sheet only, the last of which lacks the price."""
    c = read(spark, sf_dir, "customer")
    columns = [
        ("NO", "CAST(c_custkey AS STRING)", "str"), ("CAMPAIGN", "CASE WHEN c_custkey % 8 < 4 THEN 'C' || CAST(c_custkey AS STRING) ELSE '' END", "str"), ("TYPE", "c_mktsegment", "str"), ("LEVEL", "'L' || CAST(c_nationkey AS STRING)", "str"),
        ("NAME", "CASE WHEN c_custkey % 9 = 0 THEN '' ELSE c_name END", "str"), ("FANBASE (K)", "CAST(c_custkey % 300 AS STRING) || '.5'", "str"), ("POST DATE", "'2026/5/' || CAST(1 + c_custkey % 28 AS STRING)", "str"),
        ("POST LINK", "CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 'no link' END ; CASE WHEN c_custkey % 2 = 0 AND c_custkey % 9 <> 0 THEN 'http://x.co/' || CAST(c_custkey AS STRING) END", "link"),
        ("IMPRESSION", "c_custkey * 10", "num"), ("LIKE", "'1,' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0')", "str"), ("COLLECTION", "c_nationkey", "num"), ("COMMENT", "c_custkey % 5", "num"), ("TTL ENGAGEMENT", "c_custkey % 50", "num"),
        ("=CASE WHEN workbook <> 'e3' THEN 'PRICE' ELSE 'COST' END", "c_acctbal", "num"), ("MCN", "'m' || CAST(c_nationkey AS STRING)", "str"), ("CPM", "c_acctbal / 4", "num"),
    ]
    book = "'e' || CAST(c_custkey % 4 AS STRING)"
    two, one = c.where("c_custkey % 4 < 2"), c.where("c_custkey % 4 >= 2")
    wrong = [("NO", "'1'", "str"), ("PRICE", "1", "num")]
    parts = [sheet(two, book, "Cover", 1, 1, "c_custkey + 2", wrong), sheet(two, book, "MASTER KOL LIST", 2, 2, "c_custkey + 3", columns), sheet(one, book, "Data", 1, 2, "c_custkey + 3", columns), sheet(one, book, "Later", 2, 1, "c_custkey + 2", wrong)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
