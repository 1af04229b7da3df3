"""Queries of the export, roster and efficiency binders, and of stored outputs, rosters, answers and approvals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import adjudicate, match, output, remap, roster
from ..sources import adapters as a
from ..sources import bind
from .matching import _VERDICTS, verdicts
from .registry import query

AS_OF = "2026-08-01"
_ID = "printf('%024x', o_orderkey)"


def _as_of():
    return F.lit(AS_OF).cast("date")


@query(f"""SELECT 'w' || (o_orderkey % 5) AS workbook, 'Data' AS sheet, CAST(o_orderkey + 4 AS INTEGER) AS excel_row, 'k' || o_custkey || 'z' AS blogger, CAST(o_custkey AS VARCHAR) AS username, {_ID} AS post_id, upper({_ID}) AS post_id_raw,
    strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS post_date, o_orderkey % 1000 AS likes_retweet, CASE WHEN o_orderkey % 2 = 0 THEN CAST(1234 AS BIGINT) END AS share_favorites, CAST(trunc(o_totalprice) AS BIGINT) AS engagement, o_orderkey % 7 AS comments,
    CASE WHEN o_orderkey % 3 = 0 THEN 'http://h.co/' || o_orderkey WHEN o_orderkey % 2 = 0 THEN 'http://t.co/' || o_orderkey ELSE '' END AS link_target, o_totalprice AS weighted_eng FROM orders WHERE o_orderkey % 13 <> 0""")
def S2_S6_S10_bind_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bind.bind_export(a.export_cells(spark, sf_dir), _as_of())
    return rows.withColumn("post_date", F.date_format("post_date", "yyyy-MM-dd HH:mm:ss")).withColumn("share_favorites", F.col("share_favorites").cast("long"))


@query("""WITH r AS (SELECT *, 'r' || (c_custkey % 3) AS workbook, count(*) OVER (PARTITION BY c_custkey % 3) AS rows_scanned FROM customer)
    SELECT workbook, 'List Micro' AS sheet, CAST(c_custkey + 4 AS INTEGER) AS roster_row, c_name AS name, 'b' || c_custkey AS namebis, CAST(c_custkey + 7 AS VARCHAR) AS dmrid, 'id' || c_custkey AS redbook_id, c_custkey % 1000 AS followers,
        rows_scanned, lower(c_name) AS n_norm, 'b' || c_custkey AS b_norm FROM r WHERE CASE workbook WHEN 'r0' THEN c_custkey % 2 = 0 WHEN 'r1' THEN c_custkey % 4 < 2 ELSE true END""")
def S3_F2_bind_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bind.bind_roster(a.roster_cells(spark, sf_dir), "micro")
    return rows.select("workbook", "sheet", "roster_row", "name", "namebis", "dmrid", "redbook_id", "followers", "rows_scanned", "n_norm", "b_norm")


@query("SELECT DISTINCT 'r' || (c_custkey % 3) AS workbook, s AS sheet, '01/08/2026 10:00:00' AS extracted FROM customer, (VALUES ('List Micro'), ('List Macro')) x(s)")
def S8_roster_extraction_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = a.roster_cells(spark, sf_dir)
    return bind.roster_extraction_date(c, bind.find_header(c, ("name", "redbook_id"), last_wins=True))


@query("""WITH r AS (SELECT *, 'e' || (c_custkey % 4) AS workbook FROM customer WHERE c_custkey % 4 <> 3 AND c_custkey % 9 <> 0)
    SELECT workbook, CASE WHEN c_custkey % 4 < 2 THEN 'MASTER KOL LIST' ELSE 'Data' END AS sheet, CAST(c_custkey + 3 AS INTEGER) AS excel_row,
        coalesce(last_value(CASE WHEN c_custkey % 8 < 4 THEN 'C' || c_custkey END IGNORE NULLS) OVER (PARTITION BY workbook ORDER BY c_custkey ROWS UNBOUNDED PRECEDING), '') AS campaign,
        CAST(c_custkey AS VARCHAR) AS no, c_name AS name, c_mktsegment AS type_raw, 'L' || c_nationkey AS level_raw, 'm' || c_nationkey AS mcn, CAST(make_date(2026, 5, CAST(1 + c_custkey % 28 AS INTEGER)) AS VARCHAR) AS post_date,
        CASE WHEN c_custkey % 2 = 0 THEN 'http://x.co/' || c_custkey ELSE 'no link' END AS post_link, CAST(c_custkey % 300 + 0.5 AS DOUBLE) AS fanbase_raw, c_acctbal AS price, c_acctbal / 4 AS cpm_src, CAST(NULL AS DOUBLE) AS cpe_src,
        c_custkey * 10 AS impression, 1000 + c_custkey % 1000 AS like_n, c_nationkey AS collection, c_custkey % 5 AS comment_n, c_custkey % 50 AS ttl_engagement FROM r""")
def S4_S10_bind_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.bind_efficiency(a.efficiency_cells(spark, sf_dir), _as_of()).withColumn("post_date", F.col("post_date").cast("string"))


@query("SELECT DISTINCT 'e' || (c_custkey % 4) AS workbook, 'price' AS missing FROM customer WHERE c_custkey % 4 = 3")
def A10_missing_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.missing_headers(a.efficiency_cells(spark, sf_dir), bind.EFFICIENCY).select("workbook", F.array_join("missing", ",").alias("missing"))


@query(a.with_tables("tracker") + ", k AS (SELECT campaign, name AS no, excel_row, row_number() OVER (PARTITION BY campaign, name ORDER BY excel_row) AS n FROM tracker) SELECT campaign, no, excel_row FROM k WHERE n > 1")
def A23_duplicate_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.duplicate_identity(a.tracker(spark, sf_dir).select("campaign", F.col("name").alias("no"), "excel_row"))


@query(a.with_tables("tracker") + """, b AS (SELECT campaign, excel_row, row_number() OVER (PARTITION BY campaign ORDER BY excel_row) AS k FROM tracker WHERE year(post_date) % 2 = 0 OR excel_row % 97 = 0)
    SELECT campaign, 'dates' AS code, count(*) AS total, string_agg(excel_row, ',' ORDER BY excel_row) FILTER (WHERE k <= 5) AS first_rows FROM b GROUP BY campaign""")
def A24_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bind.digest(a.tracker(spark, sf_dir), F.expr("year(post_date) % 2 = 0 OR excel_row % 97 = 0"), "dates", ["campaign"])
    return out.withColumn("first_rows", F.array_join(F.transform("first_rows", lambda x: x.cast("string")), ","))


@query(a.with_tables("export") + " SELECT count(*) FILTER (WHERE username <> '') = 0 AS no_usernames, count(*) FILTER (WHERE CAST(post_id AS BIGINT) % 3 = 1) AS id_mismatch FROM export")
def A25_export_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.export(spark, sf_dir).withColumn("id24", F.lower(F.lpad(F.hex(F.col("post_id").cast("long")), 24, "0")))
    inner = F.when(F.col("post_id").cast("long") % 3 == 1, F.repeat(F.lit("f"), F.lit(24))).otherwise(F.col("id24"))
    return bind.export_checks(e.select("username", F.col("id24").alias("post_id"), F.concat(F.lit("http://example.com/discovery/item/"), inner).alias("link_target")))


@query(_VERDICTS + " SELECT excel_row, status, 'none' AS reviewer, out_of_window FROM v")
def S15_K4_stored_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are written with more fields than are read, and read with one that they lack."""
    doc = output.audit_document("run1", verdicts(spark, sf_dir).select("excel_row", "name", "status", "out_of_window"))
    schema = "excel_row bigint, status string, reviewer string, out_of_window boolean"
    from pyspark.sql.types import StructType

    return output.read_verdicts(doc, "document", StructType.fromDDL(schema), {"reviewer": "none"})


@query("""WITH s AS (SELECT user_id AS kind, event_id AS hash, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
    SELECT kind, hash, CASE WHEN hash % 3 <> 0 THEN hash % 10 ELSE -1 END AS version, hash % 3 = 0 AS stale FROM s WHERE k = 1""")
def S16_current_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.read(spark, sf_dir, "events")
    settings = e.select(F.col("user_id").alias("kind"), F.col("event_id").alias("hash"), F.col("ts").alias("promoted_at"))
    known = e.where("event_id % 3 <> 0").select(F.col("event_id").alias("hash"), (F.col("event_id") % 10).alias("version"))
    return roster.current_roster(settings, known).withColumn("version", F.coalesce("version", F.lit(-1)))


@query("SELECT o_orderkey AS run_id, CAST(o_custkey AS VARCHAR) AS roster_hash FROM orders WHERE o_custkey % 6 <> 0 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 1)")
def X21_roster_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = a.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_custkey") % 6 == 0, "").otherwise(F.col("o_custkey").cast("string")).alias("roster_hash"))
    kept = a.read(spark, sf_dir, "customer").where("c_custkey % 4 <> 1").select(F.col("c_custkey").cast("string").alias("hash"))
    return roster.roster_available(runs, kept).select("run_id", "roster_hash")


@query(_VERDICTS + """, w AS (SELECT *, CASE WHEN excel_row % 4 = 0 THEN 'UNSURE' WHEN excel_row % 4 = 1 THEN 'DIFFERENT' END AS answer FROM v)
    SELECT excel_row, status, coalesce(answer, '') AS answer, CAST(CASE WHEN answer IS NOT NULL THEN 0.75 ELSE -1 END AS DOUBLE) AS answer_confidence, CASE WHEN answer = 'UNSURE' AND status <> 'REVIEW' THEN 'noted' ELSE '' END AS note FROM w""")
def X15_Q2_apply_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the rows have two answers, the later of which counts; some answers name no row."""
    t = a.tracker(spark, sf_dir).where("excel_row % 4 < 2").select(adjudicate.row_key().alias("row"), F.when(F.col("excel_row") % 4 == 0, "UNSURE").otherwise("DIFFERENT").alias("verdict"))
    first = t.select("row", F.lit("SAME_POST").alias("verdict"), F.lit(0.25).alias("confidence"), F.lit(0).alias("position"))
    last = t.select("row", "verdict", F.lit(0.75), F.lit(1))
    lost = t.select(F.concat("row", F.lit("x")), "verdict", F.lit(0.5), F.lit(2))
    out = adjudicate.apply_answers(verdicts(spark, sf_dir), last.union(first).union(lost).toDF("row", "verdict", "confidence", "position"))
    return out.select("excel_row", "status", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("answer_confidence", F.lit(-1.0)).alias("answer_confidence"), F.when(F.col("answer_note") != "", "noted").otherwise("").alias("note"))


@query(_VERDICTS + """ SELECT excel_row, CASE WHEN m_post IS NOT NULL THEN 'MATCH' WHEN ok THEN 'REVIEW' ELSE 'LINK_ERROR' END AS status,
    CASE WHEN m_post IS NULL AND ok THEN CASE WHEN own_author <> '' THEN 'no-username' ELSE 'no-author' END ELSE '' END AS review_reason FROM b""")
def X3_no_usernames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No export row has a user name: authors decide nothing; siblings come from the rows' own authors only where these agree."""
    e = a.export(spark, sf_dir).withColumn("username", F.lit(""))
    t = a.tracker(spark, sf_dir).withColumn("name", F.concat("name", "no"))  # names of their own, so that no sibling lends an author
    out = match.reconcile(t, e, a.resolutions(spark, sf_dir), ascii_only=True, fuzzy=False)
    return out.select("excel_row", "status", "review_reason")


@query("""SELECT o_orderkey AS id, 'missing' AS error, 'post_link' AS what FROM orders WHERE o_orderkey % 3 = 0
    UNION ALL SELECT o_orderkey, 'duplicate', '1' FROM orders WHERE o_orderkey % 3 = 1""")
def H4_validate_approval(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.expr("map('name', 1, 'post_link', CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE 2 END, 'no', 3)")
    return remap.validate_approval(a.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.explode(fields).alias("field", "col")), "tracker")


@query()
def P8_P9_fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rungs of the ladder over the openings of all documents: which opening names another. No SQL; tested against brute force."""
    from ..functions import forms
    from ..functions.shared import settled

    names = a.read(spark, sf_dir, "documents").select(F.regexp_extract(F.coalesce("text", F.lit("")), r"^\s*(\S+(?:\s+\S+){0,2})", 1).alias("name")).where("name <> ''").distinct()
    form = settled(forms.add_forms(names, "name", "").select("name", "norm", "cjk", "ascii"))
    hits = match.name_hits(form.withColumnRenamed("name", "l_id"), form.withColumnRenamed("name", "r_id"), same=True)
    return hits.where("l_id <> r_id").select(F.col("l_id").alias("name"), F.col("r_id").alias("other"), "method")
