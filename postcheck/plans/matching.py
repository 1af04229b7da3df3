"""Reconciliation queries over the adapted orders, line items and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import match as m
from ..sources import adapters as a
from .registry import query

WINDOW = ("1996-01-01", "1999-12-31")
_VERDICTS = (
    a.with_tables("tracker", "resolutions", "export")
    + f""", r AS (SELECT t.*, coalesce(s.note_id, '') AS note_id, coalesce(s.author_id, '') AS own_author, coalesce(s.status = 'ok' AND s.note_id <> '', false) AS ok FROM tracker t LEFT JOIN resolutions s ON t.post_link = s.url),
    j AS (SELECT r.*, e.post_id AS m_post, e.username AS m_user, e.blogger AS m_blogger FROM r LEFT JOIN export e ON r.ok AND r.note_id = e.post_id),
    ids AS (SELECT name, own_author AS id FROM j WHERE ok AND own_author <> '' UNION SELECT name, m_user FROM j WHERE m_user <> ''),
    sib AS (SELECT name, min(id) AS sibling FROM ids GROUP BY name HAVING count(DISTINCT id) = 1),
    b AS (SELECT j.*, (ok AND m_post IS NULL AND own_author = '' AND sibling IS NOT NULL) AS via,
        CASE WHEN own_author <> '' THEN own_author WHEN ok AND m_post IS NULL THEN coalesce(sibling, '') ELSE '' END AS author_id FROM j LEFT JOIN sib USING (name)),
    pairs AS (SELECT b.excel_row, b.name, b.author_id, b.post_date AS t_date, e.post_id, e.username, e.blogger, e.excel_row AS e_row, e.post_date AS e_date,
        coalesce(abs(date_diff('day', b.post_date, e.post_date)) <= 7, true) AS near FROM b JOIN export e ON contains(e.blogger, b.name) WHERE b.m_post IS NULL),
    h AS (SELECT excel_row, count(*) AS hits, count(*) FILTER (WHERE near) AS n_near, bool_or(length(name) >= 4 AND username <> '' AND username <> author_id) AS foreign_hit, bool_or(username = author_id) AS own_hit,
        bool_or(length(name) >= 4) AS strong, arg_min(post_id, (abs(date_diff('day', t_date, e_date)), e_row)) FILTER (WHERE near) AS best,
        arg_min(blogger || ' ' || post_id || ' Δ=' || date_diff('day', t_date, e_date) || '天', (abs(date_diff('day', t_date, e_date)), e_row)) FILTER (WHERE near) AS best_text FROM pairs GROUP BY excel_row),
    users AS (SELECT DISTINCT username FROM export),
    v AS (SELECT b.*, h.hits, h.n_near, h.best, h.best_text, CASE
        WHEN m_post IS NOT NULL THEN 'MATCH'
        WHEN ok AND u.username IS NOT NULL AND coalesce(foreign_hit AND NOT own_hit, false) THEN 'REVIEW'
        WHEN ok AND u.username IS NOT NULL THEN 'NO_POST'
        WHEN ok AND author_id <> '' AND coalesce(strong, false) THEN 'REVIEW'
        WHEN ok AND author_id <> '' THEN 'NO_BLOGGER'
        WHEN ok THEN 'REVIEW' ELSE 'LINK_ERROR' END AS status, CASE
        WHEN m_post IS NOT NULL THEN '1:note-id-join'
        WHEN ok AND u.username IS NOT NULL AND coalesce(foreign_hit AND NOT own_hit, false) THEN '2:author-id+name-conflict'
        WHEN ok AND author_id <> '' AND u.username IS NULL AND coalesce(strong, false) THEN '2:author-id+name-conflict'
        WHEN ok AND author_id <> '' THEN CASE WHEN via THEN '2:author-id-sibling' ELSE '2:author-id' END
        WHEN ok THEN '1:resolved-no-author' ELSE '3:name-heuristic' END AS tier, CASE
        WHEN m_post IS NOT NULL OR NOT ok THEN ''
        WHEN u.username IS NOT NULL THEN CASE WHEN coalesce(foreign_hit AND NOT own_hit, false) THEN 'foreign-name' ELSE '' END
        WHEN author_id <> '' THEN CASE WHEN coalesce(strong, false) THEN 'same-name' ELSE '' END ELSE 'no-author' END AS review_reason,
        coalesce(m_post IS NOT NULL AND NOT contains(m_blogger, name), false) AS name_mislabel,
        coalesce(NOT (b.post_date BETWEEN DATE '{WINDOW[0]}' AND DATE '{WINDOW[1]}'), false) AS out_of_window
        FROM b LEFT JOIN h USING (excel_row) LEFT JOIN users u ON u.username = b.author_id)"""
)


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.reconcile(a.tracker(spark, sf_dir), a.export(spark, sf_dir), a.resolutions(spark, sf_dir), WINDOW, ascii_only=True, fuzzy=False)


@query(_VERDICTS + " SELECT excel_row, note_id, author_id, status, tier, name_mislabel, out_of_window, m_post AS matched_post FROM v")
def X1_X7_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark, sf_dir).select("excel_row", "note_id", "author_id", "status", "tier", "name_mislabel", "out_of_window", F.col("matched.m_post").alias("matched_post"))


@query(
    _VERDICTS
    + """, q AS (SELECT p.*, v.status, v.tier, v.own_author <> '' OR v.via AS has, v.ok AND v.author_id <> '' AND p.author_id NOT IN (SELECT username FROM users WHERE username IS NOT NULL) AS absent, length(p.name) >= 4 AS strong
            FROM pairs p JOIN v USING (excel_row)),
        c AS (SELECT excel_row, post_id, blogger, username, e_row, date_diff('day', t_date, e_date) AS delta, 'norm-substring' AS method FROM q WHERE (near AND (NOT absent OR strong))
                OR (absent AND strong AND excel_row NOT IN (SELECT excel_row FROM q WHERE near AND absent AND strong))
            UNION ALL SELECT v.excel_row, e.post_id, e.blogger, e.username, e.excel_row, date_diff('day', v.post_date, e.post_date), 'same-author' FROM v JOIN export e ON e.username = v.author_id
            WHERE v.m_post IS NULL AND v.ok AND v.author_id <> '' AND v.hits IS NULL AND coalesce(abs(date_diff('day', v.post_date, e.post_date)) <= 7, true))
        SELECT excel_row, CAST(row_number() OVER (PARTITION BY excel_row ORDER BY delta IS NULL, abs(delta), e_row) AS INTEGER) AS place, post_id, blogger, username, CAST(delta AS INTEGER) AS delta, method FROM c"""
)
def W3_F5_X7_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every row, in order: near ones, all of a conflict that has none near, the author's where no name fits."""
    return m.candidates(a.tracker(spark, sf_dir), a.export(spark, sf_dir), a.resolutions(spark, sf_dir), ascii_only=True, fuzzy=False)


@query(_VERDICTS + " SELECT excel_row, coalesce(n_near, 0) AS n_candidates, best FROM v WHERE status = 'LINK_ERROR' OR tier = '1:resolved-no-author'")
def W3_F5_rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = verdicts(spark, sf_dir).where("status = 'LINK_ERROR' or tier = '1:resolved-no-author'")
    return v.select("excel_row", "n_candidates", F.get("candidates", F.lit(0))["post_id"].alias("best"))


TEXTS = f"""CASE status WHEN 'MATCH' THEN CASE WHEN name_mislabel THEN '{m.MISLABEL}' ELSE '' END
    WHEN 'NO_BLOGGER' THEN '{m.TEXT['NO_BLOGGER']}' || CASE WHEN out_of_window THEN '{m.OUTSIDE}' ELSE '' END
    WHEN 'NO_POST' THEN '{m.TEXT['NO_POST']}' || CASE WHEN out_of_window THEN '{m.OUTSIDE}' ELSE '' END
    WHEN 'LINK_ERROR' THEN '{m.TEXT['LINK_ERROR']}' || coalesce('（同名候选: ' || best_text || '）', '（无同名候选）')
    ELSE '{m.TEXT['REVIEW']}' || CASE WHEN review_reason <> '' THEN '（' || review_reason || '）' ELSE '' END END"""


@query(_VERDICTS + f" SELECT excel_row, {TEXTS} AS annotation FROM v")
def P30_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = verdicts(spark, sf_dir)
    return v.select("excel_row", m.annotation(v).alias("annotation"))


@query(_VERDICTS + " SELECT status, count(*) AS n FROM v GROUP BY status UNION ALL SELECT 'MATCH_name_mislabel', count(*) FROM v WHERE name_mislabel HAVING count(*) > 0")
def A1_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.status_counts(verdicts(spark, sf_dir))


@query(_VERDICTS + """ SELECT e.excel_row, e.post_id, e.username FROM export e WHERE e.username IN (SELECT author_id FROM v WHERE author_id <> '')
    AND e.post_id NOT IN (SELECT m_post FROM v WHERE m_post IS NOT NULL) AND coalesce(e.post_date BETWEEN (SELECT min(post_date) - 1 FROM v) AND (SELECT max(post_date) + 1 FROM v), true)""")
def X18_F10_reverse_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.export(spark, sf_dir)
    return m.reverse_audit(verdicts(spark, sf_dir), e).select("excel_row", "post_id", "username")


@query(a.with_tables("tracker") + " SELECT campaign, min(excel_row) AS first_row, count(*) AS rows, CAST(min(post_date) AS VARCHAR) AS from_date, CAST(max(post_date) AS VARCHAR) AS to_date FROM tracker GROUP BY campaign")
def A3_A4_tracker_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = m.tracker_profile(a.tracker(spark, sf_dir))
    return out.withColumn("from_date", F.col("from_date").cast("string")).withColumn("to_date", F.col("to_date").cast("string"))


@query("SELECT l_orderkey, l_linenumber, min(l_partkey * 1000000 + l_suppkey * 1000 + CAST(l_quantity AS BIGINT)) AS first_key FROM lineitem GROUP BY ALL")
def W2_first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr("l_partkey * 1000000 + l_suppkey * 1000 + CAST(l_quantity AS BIGINT)").alias("first_key"))
    return m.first_per_key(rows, ["l_orderkey", "l_linenumber"], "first_key")


@query("""SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(lower(regexp_replace(d.text, '[\\^`\\s]+', '', 'g')), lower(regexp_replace(b.text, '[\\^`\\s]+', '', 'g')))""")
def X5_name_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocked containment join, on benchmark passages inside documents."""
    from ..functions.forms import norm

    form = lambda df, key, out: df.select(F.col(key).alias(out), norm(F.col("text"), True).alias("norm"))
    left, right = form(a.read(spark, sf_dir, "benchmark"), "item_id", "l_id"), form(a.read(spark, sf_dir, "documents"), "doc_id", "r_id")
    return m.contained_passages(left, right, "norm").select(F.col("l_id").alias("item_id"), F.col("r_id").alias("doc_id"))
