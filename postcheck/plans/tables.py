"""Queries of sources, coercions, links, rosters, outputs, evaluation and manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import coerce, forms, urls
from ..functions.shared import settled, shared_folder
from ..operators import adjudicate, evaluate, links, manifest, match, output, remap, roster
from ..sources import adapters as a
from ..sources import bind, versions
from ..streaming import jobs
from .matching import _VERDICTS, TEXTS, verdicts
from .registry import query

AS_OF = "2026-08-01"
_SUPPLIERS = "s AS (SELECT 'w' || (s_nationkey % 5) AS workbook, CAST(s_suppkey + 3 AS INTEGER) AS excel_row, * FROM supplier)"


@query("WITH " + _SUPPLIERS + """ SELECT workbook, h.key, CAST(2 AS INTEGER) AS header_row, h.col FROM (SELECT DISTINCT workbook FROM s),
    (VALUES ('name', 1), ('postlink', 2), ('impression', 3), ('campaign', 4), ('postdate', 5)) h(key, col)""")
def S5_find_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.find_header(a.cells(spark, sf_dir), ("name", "postlink"), ascii_only=True).select("workbook", "key", "header_row", "col")


@query("WITH " + _SUPPLIERS + """ SELECT workbook, excel_row, s_name AS name, 'http://x.co/' || s_suppkey AS post_link, CAST(trunc(s_acctbal) AS BIGINT) AS impression,
    coalesce(last_value(CASE WHEN s_suppkey % 4 = 0 THEN 'C' || s_suppkey END IGNORE NULLS) OVER (PARTITION BY workbook ORDER BY excel_row ROWS UNBOUNDED PRECEDING), '') AS campaign,
    '2026-05-1' || (s_suppkey % 10) AS post_date FROM s""")
def S1_W1_bind_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bind.bind_tracker(a.cells(spark, sf_dir), F.lit(AS_OF).cast("date"))
    return rows.select("workbook", "excel_row", "name", "post_link", "impression", "campaign", F.col("post_date").cast("string").alias("post_date"))


@query("WITH " + _SUPPLIERS + " SELECT DISTINCT workbook, '2026-01-01' AS from_date, '2026-07-20' AS to_date FROM s")
def S7_export_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = a.cells(spark, sf_dir)
    out = bind.export_window(c, bind.find_header(c, ("name", "postlink")), F.lit(AS_OF).cast("date"))
    return out.select("workbook", F.col("from_date").cast("string").alias("from_date"), F.col("to_date").cast("string").alias("to_date"))


@query("""WITH g AS (SELECT user_id, event_id, coalesce(event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) > 200, false) AS gap FROM events),
    c AS (SELECT *, bool_or(gap) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS cut FROM g) SELECT user_id, event_id FROM c WHERE NOT cut""")
def S9_truncate_after_blank_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.truncate_after_blank_run(a.read(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id")


@query("SELECT user_id, event_id, coalesce(last_value(nullif(event_type, 'view') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), '') AS event_type FROM events")
def W1_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.read(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("event_type"))
    return bind.forward_fill(e, "event_type", ["user_id"], "event_id")


@query("""SELECT workbook, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, left(text, 60) AS text FROM (WITH """ + _SUPPLIERS + """ SELECT workbook, excel_row AS row, u.col, u.text FROM s, LATERAL (VALUES (1, s_name), (2, 'http://x.co/' || s_suppkey), (4, CASE WHEN s_suppkey % 4 = 0 THEN 'C' || s_suppkey ELSE '' END)) u(col, text) WHERE excel_row <= 15)""")
def S13_structural_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remap.structural_sample(a.cells(spark, sf_dir)).where("row > 2 and col in (1, 2, 4)").select("workbook", "row", "col", "text")


@query("WITH " + _SUPPLIERS + ", t AS (SELECT DISTINCT workbook FROM s) SELECT workbook, header, CAST(col AS INTEGER) AS col FROM t, (VALUES ('NAME', 1), ('POST LINK', 2), ('Impression', 3), ('CAMPAIGN', 4), ('POST DATE', 5)) h(header, col)")
def H6_column_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = a.cells(spark, sf_dir)
    header = bind.find_header(c, ("name", "postlink")).select("workbook", "sheet", "header_row").distinct()
    return remap.column_choices(c, header).select("workbook", "header", "col")


@query("WITH " + _SUPPLIERS + " SELECT DISTINCT workbook, 'approved' AS approved_by, CAST(2 AS INTEGER) AS row FROM s")
def H1_H2_X19_lookup_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    sigs = remap.candidate_signatures(a.cells(spark, sf_dir))
    approved = sigs.where("row = 2").select(F.lit("tracker").alias("kind"), "sig", "sheet", F.col("row").alias("header_row"), F.create_map(F.lit("name"), F.lit(1)).alias("columns"), F.lit("approved").alias("approved_by")).dropDuplicates(["sig"])
    return remap.lookup_mapping(sigs, approved, "tracker").select("workbook", "approved_by", "row")


@query("WITH " + _SUPPLIERS + " SELECT workbook, excel_row AS row, s_name AS v_str FROM s UNION ALL SELECT DISTINCT workbook, 2, 'name' FROM s")
def H5_apply_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = a.cells(spark, sf_dir)
    m = c.select("workbook", "sheet").distinct().select("*", F.lit(2).alias("header_row"), F.create_map(F.lit("name"), F.lit(1), F.lit("post_link"), F.lit(2)).alias("columns"))
    return remap.apply_mapping(c, m, "tracker").where("col = 1 and row > 1").select("workbook", "row", "v_str")


@query("""SELECT s_suppkey AS id, 'name' AS field, CAST(1 + s_suppkey % 24 AS INTEGER) AS col FROM supplier
    UNION ALL SELECT s_suppkey, 'post_link', CAST(CASE WHEN 2 + s_suppkey % 30 <= 24 AND 2 + s_suppkey % 30 <> 1 + s_suppkey % 24 THEN 2 + s_suppkey % 30 ELSE -1 END AS INTEGER) FROM supplier""")
def H3_validate_proposal(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = a.read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "'S1' AS sheet", "1 AS header_row", "map('name', CAST(1 + s_suppkey % 24 AS INT), 'post_link', CAST(2 + s_suppkey % 30 AS INT), 'other', 3) AS columns")
    return remap.validate_proposal(p, "tracker", p.select("sheet").distinct()).select("id", "field", F.coalesce("col", F.lit(-1)).alias("col"))


@query("""SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS parsed FROM orders""")
def P21_parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = a.read(spark, sf_dir, "orders")
    layout = "CASE o_orderkey % 6 WHEN 0 THEN date_format(o_orderdate, 'yyyy-M-d') WHEN 1 THEN date_format(o_orderdate, 'yyyy/MM/dd') WHEN 2 THEN date_format(o_orderdate, 'yyyy.MM.dd') WHEN 3 THEN date_format(o_orderdate, 'M/d/yyyy') WHEN 4 THEN date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') ELSE date_format(o_orderdate, 'M/d/yy') END"
    wide = f"CASE WHEN o_orderkey % 12 < 6 THEN {layout} ELSE translate({layout}, '0123456789-/.:', '０１２３４５６７８９－／．：') END"
    return o.select("o_orderkey", coerce.parse_date(F.expr(wide), F.lit(AS_OF).cast("date")).cast("string").alias("parsed"))


@query("SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS n, CAST(trunc(CAST((o_orderkey % 100) || '.' || (o_orderkey % 100003) AS DOUBLE) * 10000) AS BIGINT) AS magnitude FROM orders")
def P12_P23_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = a.read(spark, sf_dir, "orders")
    return o.select("o_orderkey", coerce.parse_int(F.format_number("o_totalprice", 2)).alias("n"), coerce.magnitude_int(F.concat((F.col("o_orderkey") % 100).cast("string"), F.lit("."), (F.col("o_orderkey") % 100003).cast("string"), F.lit("万"))).alias("magnitude"))


@query("""SELECT page_id, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host, regexp_extract(url, '^https?://([^/?#:]+)', 1) LIKE '%.example.com' OR regexp_extract(url, '^https?://([^/?#:]+)', 1) LIKE '%.example.net' AS allowed FROM pages""")
def P40_P41_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = urls.normalize_url(F.regexp_replace("url", "^http://", ""))
    return a.read(spark, sf_dir, "pages").select("page_id", urls.url_host(u).alias("host"), urls.allowed_url(u, ("example.com", "example.net")).alias("allowed"))


@query("""SELECT page_id, printf('%024x', page_id) AS post_id, printf('%024x', page_id) AS inner_id FROM pages""")
def P42_P43_post_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = a.read(spark, sf_dir, "pages").select("page_id", F.lower(F.lpad(F.hex("page_id"), 24, "0")).alias("id"))
    canonical = F.concat(F.lit("https://www.example.com/explore/"), F.upper("id"), F.lit("?x=1"))
    redirect = F.concat(F.lit("https://r.example.org/redi.html?url=http%3A%2F%2Fexample.com%2Fdiscovery%2Fitem%2F"), F.col("id"))
    return p.select("page_id", urls.post_id_from_url(canonical, ("example.com",)).alias("post_id"), urls.embedded_post_id(redirect).alias("inner_id"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def J1_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.read(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"data":{"note":'), F.col("props"), F.lit("}}")).alias("json"))
    return links.walk(e, "json", ("missing", "k"), "k").select("event_id", F.col("k").cast("bigint").alias("k"))


@query("""WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, printf('%024x', event_id) AS id, event_id % 7 AS s, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events)
    SELECT event_id, CASE WHEN s IN (3, 6) THEN '' ELSE id END AS note_id,
        CASE s WHEN 3 THEN '' WHEN 4 THEN 'z' || user_id WHEN 6 THEN 'b' || user_id ELSE 'a' || user_id END AS author_id,
        CASE s WHEN 2 THEN 'N' || user_id WHEN 3 THEN '' WHEN 6 THEN '' ELSE 'n' || user_id END AS author_name,
        CASE s WHEN 3 THEN NULL WHEN 6 THEN NULL WHEN 5 THEN k ELSE k * 10000 END AS likes, CASE WHEN s IN (0, 1, 4) THEN event_id % 77 WHEN s = 5 THEN 0 END AS collects,
        CASE WHEN s NOT IN (3, 6) THEN event_id % 1000 END AS comments, CASE s WHEN 0 THEN '标题' || event_id WHEN 1 THEN 'shown' ELSE '' END AS title,
        CASE WHEN s IN (0, 1, 5) THEN strftime(make_timestamp(t * 1000000), '%Y-%m-%d %H:%M:%S') WHEN s = 2 THEN CAST(t AS VARCHAR) ELSE '' END AS published FROM e""")
def J2_extract_note_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven shapes: under data; in nested lists with times in milliseconds; bare keys and a time in text; no post; falsy values before true ones; counts without objects and a fractional epoch; an author's id only."""
    e = a.read(spark, sf_dir, "events").selectExpr("*", "upper(lpad(hex(event_id), 24, '0')) AS id", "get_json_object(props, '$.k') AS k", "event_id % 1000 AS c", "event_id % 77 AS d", "unix_seconds(CAST(ts AS timestamp)) AS t", "user_id AS u")
    shapes = [
        """'{"data":{"note_id":"' || id || '","title":"标题' || event_id || '","time":' || t || ',"user":{"user_id":"a' || u || '","nickname":"n' || u || '"},"interact_info":{"liked_count":"' || k || '万","collected_count":' || d || ',"comment_count":' || c || '}}}'""",
        """'{"data":{"data":[[],{"note_list":[{"id":"' || id || '","display_title":"shown","create_time":' || t || '000,"author":{"userid":"a' || u || '","name":"n' || u || '"},"interactInfo":{"likedCount":"' || k || 'w","collectedCount":"' || d || '","commentCount":"' || c || '"}}]}]}}'""",
        """'{"ok":true,"body":{"noteId":"' || id || '","publish_time":"' || t || '","x":{"userId":"a' || u || '","nick_name":"N' || u || '"},"y":[{"likes":"' || k || '万"},{"comments_count":' || c || '}]}}'""",
        """'{"id":"not-a-post","code":404}'""",
        """'{"z":{"note_id":"","title":[]},"a":{"noteId":"' || id || '","user":{"user_id":0,"id":"z' || u || '","nickname":"","name":"n' || u || '"},"interact_info":{"liked_count":0,"likedCount":"' || k || '万","collected_count":null,"collectedCount":"' || d || '","comment_count":"' || c || '"}}}'""",
        """'{"z":{"note_id":"' || id || '","post_time":' || t || '.75,"author_id":"a' || u || '","author_name":"n' || u || '"},"a":[{"like_count":"' || k || '"},{"collects":0},{"comment_count":"' || c || '"}]}'""",
        """'{"code":200,"data":{"user":{"user_id":"b' || u || '"},"desc":"' || id || '"}}'""",
    ]
    case = F.coalesce(*[F.when(F.col("event_id") % 7 == n, F.expr(shape)) for n, shape in enumerate(shapes)])
    shaped = e.select("event_id", case.alias("json"))
    return links.extract_note_fields(shaped, "json").select("event_id", "note_id", "author_id", "author_name", "likes", "collects", "comments", "title", "published")


@query("""WITH p AS (SELECT page_id, printf('%024x', page_id) AS id, page_id % 7 AS s FROM pages), q AS (SELECT *, s < 5 AS good FROM p)
    SELECT page_id, CASE WHEN good THEN id END AS state_note, CASE WHEN good THEN 'aaaa' || right(id, 20) END AS state_author, CASE WHEN good THEN 'n' || page_id END AS state_name, CASE WHEN good THEN 't' || page_id END AS state_title,
        CASE WHEN good THEN CASE WHEN s = 4 THEN page_id * 10000 ELSE nullif(page_id, 0) END END AS state_likes, CASE WHEN good THEN page_id % 9 + 1 END AS state_collects, CASE WHEN good AND s <> 3 THEN page_id % 5 + 1 END AS state_comments,
        CASE WHEN good THEN CASE WHEN s = 2 THEN '' ELSE strftime(make_timestamp((1700000000 + page_id) * 1000000), '%Y-%m-%d %H:%M:%S') END END AS state_published FROM q""")
def J3_extract_page_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their own markup and a state behind it: mobile, desktop (another entry first), buried in lists, without counts of comments, spelt with underscores; then another post's page and one whose author is no id."""
    p = a.read(spark, sf_dir, "pages").selectExpr("page_id", "html", "lower(lpad(hex(page_id), 24, '0')) AS id", "lower(lpad(hex(page_id + 1), 24, '0')) AS next", "page_id % 7 AS s")
    p = p.withColumn("author", F.when(F.col("s") == 6, "nobody").otherwise(F.concat(F.lit("aaaa"), F.substring("id", 5, 20))))
    counts = F.expr("""CASE s WHEN 3 THEN '{"likedCount":"' || page_id || '","collectedCount":' || (page_id % 9 + 1) || '}'
        WHEN 4 THEN '{"likedCount":"","liked_count":"' || page_id || '万","collected_count":' || (page_id % 9 + 1) || ',"comment_count":' || (page_id % 5 + 1) || '}'
        ELSE '{"likedCount":' || page_id || ',"collectedCount":"' || (page_id % 9 + 1) || '","commentCount":' || (page_id % 5 + 1) || '}' END""")
    p = p.withColumn("counts", counts).withColumn("time", F.expr("CASE s WHEN 2 THEN 'undefined' WHEN 1 THEN (1700000000 + page_id) || '000' ELSE cast(1700000000 + page_id AS string) END"))
    p = p.withColumn("post", F.expr("""'{"noteId":"' || if(s = 5, next, id) || '","title":"t' || page_id || '","user":{"userId":"' || author || '","' || if(s = 4, 'nickName', 'nickname') || '":"n' || page_id || '"},"interactInfo":' || counts || ',"time":' || time || ',"x":undefined}'"""))
    state = F.expr("""CASE s WHEN 0 THEN '{"noteData":{"data":{"noteData":' || post || '}}};' WHEN 1 THEN '{"note":{"noteDetailMap":{"' || next || '":{"note":{"user":{"userId":"x"}}},"' || id || '":{"note":' || post || '}}}} ;;'
        WHEN 2 THEN '{"a":[1,{"b":[[' || post || ']]}]}' ELSE '{"note":' || post || '} ; ' END""")
    page = F.concat(F.col("html"), F.lit("<script>window.__INITIAL_STATE__ = "), state, F.lit("</script>"))
    return links.extract_page_state(p.select("page_id", "id", page.alias("html")), "html", F.col("id")).drop("id", "html")


@query("""SELECT o_orderkey, 'r' || o_orderkey AS row, ['SAME_PERSON', 'SAME_POST', 'DIFFERENT', 'UNSURE'][1 + o_orderkey % 5] AS verdict FROM orders WHERE o_orderkey % 7 <> 3 AND o_orderkey % 5 <> 4""")
def J4_parse_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = """'{"row":"r' || o_orderkey || '","verdict":"' || element_at(array('SAME_PERSON', 'SAME_POST', 'DIFFERENT', 'UNSURE', 'same'), CAST(1 + o_orderkey % 5 AS INT)) || '","confidence":' || CASE WHEN o_orderkey % 7 = 3 THEN '7' ELSE '0.5' END || ',"rationale_en":"x","rationale_zh":"y"}'"""
    text = f"CASE o_orderkey % 3 WHEN 0 THEN '```json\n[' || {item} || ']\n```' WHEN 1 THEN '{{\"items\":[' || {item} || ']}}' ELSE 'Sure: [' || {item} || '] done' END"
    return adjudicate.parse_answers(a.read(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{text} AS answer"), "answer").select("o_orderkey", "row", "verdict")


@query(_VERDICTS + """ SELECT campaign || '|' || no || '|r' || excel_row AS row, CASE WHEN tier LIKE '%name-conflict' THEN 'same_person' ELSE 'same_post' END AS question, CAST(floor((row_number() OVER (PARTITION BY campaign ORDER BY excel_row) - 1) / 15) AS BIGINT) AS batch
    FROM v WHERE status IN ('REVIEW', 'LINK_ERROR') AND CASE WHEN tier = '2:author-id+name-conflict' THEN hits > 0 AND (n_near > 0 OR author_id NOT IN (SELECT username FROM users)) ELSE coalesce(n_near, 0) > 0 END""")
def Q1_W5_F8_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjudicate.questions(verdicts(spark, sf_dir)).select("row", "question", "batch")


@query(_VERDICTS + """, c AS (SELECT status, count(*) AS n FROM v GROUP BY status UNION ALL SELECT 'MATCH_name_mislabel', count(*) FROM v WHERE name_mislabel HAVING count(*) > 0),
    t AS (SELECT string_agg(status || '=' || n, ', ' ORDER BY status) AS line FROM c) SELECT 'Run summary: ' || line AS en, '运行摘要: ' || line AS zh FROM t""")
def Q3_summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjudicate.summary_text(match.status_counts(verdicts(spark, sf_dir)))


_MEMBERS = _VERDICTS + ", " + a.SQL["micro"] + ", " + a.SQL["macro"] + """, w AS (SELECT v.*, (i.redbook_id IS NOT NULL) AS in_i, (c.redbook_id IS NOT NULL) AS in_a FROM v LEFT JOIN micro i ON v.author_id = nullif(i.redbook_id, '') LEFT JOIN macro c ON v.author_id = nullif(c.redbook_id, '')),
    x AS (SELECT * EXCLUDE (status), CASE WHEN status = 'NO_BLOGGER' THEN CASE WHEN in_i AND in_a THEN 'both' WHEN in_i THEN 'micro' WHEN in_a THEN 'macro' ELSE 'none' END END AS membership,
        CASE WHEN status <> 'NO_BLOGGER' THEN status WHEN in_i OR in_a THEN 'NO_POST_IN_PERIMETER' ELSE 'NO_BLOGGER_NOT_IN_PERIMETER' END AS status FROM w)"""


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roster.membership(verdicts(spark, sf_dir), a.roster(spark, sf_dir, "micro"), a.roster(spark, sf_dir, "macro"))


@query(_MEMBERS + " SELECT excel_row, status, membership FROM x")
def X8_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir).select("excel_row", "status", "membership")


@query(_MEMBERS + " SELECT count(*) FILTER (WHERE status IN ('NO_POST', 'NO_POST_IN_PERIMETER')) AS gaps, count(*) FILTER (WHERE status = 'NO_BLOGGER_NOT_IN_PERIMETER') AS outside FROM x")
def A2_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.buckets(_members(spark, sf_dir))


@query(_MEMBERS + """ SELECT x.excel_row, count(*) AS hits, CASE WHEN x.status = 'LINK_ERROR' THEN 'dead-link' WHEN count(*) > 1 THEN 'several' WHEN max(redbook_id) = '' THEN 'unregistered' ELSE 'near-miss' END AS note
    FROM x JOIN micro ON contains(micro.name, x.name) WHERE x.status IN ('LINK_ERROR', 'NO_BLOGGER_NOT_IN_PERIMETER') GROUP BY x.excel_row, x.status""")
def X9_X11_roster_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roster.name_evidence(_members(spark, sf_dir), a.roster(spark, sf_dir, "micro"), ascii_only=True, fuzzy=False).select("excel_row", "hits", "note")


@query(_MEMBERS + """, hit AS (SELECT x.excel_row, x.status, 0 AS list, '' AS label, m.* FROM x JOIN micro m ON contains(m.name, x.name) UNION ALL SELECT x.excel_row, x.status, 1, 'Macro: ', m.* FROM x JOIN macro m ON contains(m.name, x.name)),
    near AS (SELECT *, label || name || ' [' || CASE WHEN redbook_id = '' THEN 'no REDBOOK_ID' ELSE redbook_id END || '] (norm-substring)' AS line, row_number() OVER (PARTITION BY excel_row, list ORDER BY roster_row) AS place
        FROM hit WHERE status IN ('LINK_ERROR', 'NO_BLOGGER_NOT_IN_PERIMETER')),
    per AS (SELECT excel_row, list, status = 'LINK_ERROR' AS dead, count(*) AS n, min(name) AS name, min(redbook_id) AS redbook_id, min(followers) AS followers, string_agg(line, '; ' ORDER BY roster_row) FILTER (WHERE place <= 8) AS lines FROM near GROUP BY ALL),
    told AS (SELECT *, CASE WHEN dead THEN 'dead-link' WHEN n > 1 THEN 'several' WHEN redbook_id = '' THEN 'unregistered' ELSE 'near-miss' END AS note, n = 1 AND NOT dead AS one FROM per)
    SELECT excel_row, string_agg(note, '; ' ORDER BY list) AS notes, coalesce(string_agg(lines, '; ' ORDER BY list) FILTER (WHERE NOT one), '') AS lines, CASE WHEN bool_or(one) THEN 'norm-substring' END AS method,
        arg_min(name, list) FILTER (WHERE one) AS name, arg_min(redbook_id, list) FILTER (WHERE one) AS redbook_id, CAST(arg_min(followers, list) FILTER (WHERE one) AS BIGINT) AS followers FROM told GROUP BY excel_row
    UNION ALL SELECT x.excel_row, '', '', 'redbook-id', coalesce(i.name, c.name), coalesce(i.redbook_id, c.redbook_id), CAST(coalesce(i.followers, c.followers) AS BIGINT) FROM x LEFT JOIN micro i ON x.author_id = i.redbook_id LEFT JOIN macro c ON x.author_id = c.redbook_id
    WHERE x.membership IN ('micro', 'macro', 'both')""")
def X10_P32_roster_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of both rosters with its precedence: near misses, entries without an id, several names, dead links, and rows whose id decided."""
    micro, macro = (a.roster(spark, sf_dir, kind) for kind in ("micro", "macro"))
    out = roster.evidence(settled(_members(spark, sf_dir)), micro, macro, ascii_only=True, fuzzy=False)
    return out.select("excel_row", F.array_join("notes", "; ").alias("notes"), F.array_join("lines", "; ").alias("lines"), "perimeter.method", "perimeter.name", "perimeter.redbook_id", "perimeter.followers")


@query(_MEMBERS + """ SELECT x.excel_row, x.status, nullif(x.m_blogger, '') AS matched_blogger, CASE membership WHEN 'micro' THEN 'Micro' WHEN 'macro' THEN 'Macro' WHEN 'both' THEN 'Micro + Macro' WHEN 'none' THEN 'None' END AS membership_text,
    e.likes_retweet, e.share_favorites, e.comments, e.engagement, e.weighted_eng FROM x LEFT JOIN export e ON x.m_post = e.post_id""")
def K1_P35_evidence_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return output.evidence_columns(_members(spark, sf_dir))


@query("""WITH c AS (SELECT DISTINCT 'w' || (s_suppkey % 40) AS workbook, 1 + (s_suppkey * s_nationkey) % 70 AS col FROM supplier WHERE s_acctbal > 0), w AS (SELECT DISTINCT 'w' || (s_suppkey % 40) AS workbook FROM supplier)
    SELECT workbook, CAST(min(s) AS INTEGER) AS start FROM w, generate_series(20, 200) g(s) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.workbook = w.workbook AND c.col BETWEEN s AND s + 7) GROUP BY workbook""")
def K1_free_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets with columns filled here and there; cells of suppliers in debt are blank."""
    cells = a.read(spark, sf_dir, "supplier").selectExpr("'w' || (s_suppkey % 40) AS workbook", "'S' AS sheet", "CAST(1 + (s_suppkey * s_nationkey) % 70 AS INT) AS col", "CASE WHEN s_acctbal > 0 THEN s_name ELSE '' END AS v_str", "CAST(NULL AS DOUBLE) AS v_num", "CAST(NULL AS TIMESTAMP) AS v_ts")
    return output.free_block(cells).select("workbook", "start")


@query(a.with_tables("micro") + " SELECT count(*) AS rows, count(*) FILTER (WHERE redbook_id <> '') AS with_id, count(DISTINCT nullif(redbook_id, '')) AS ids FROM micro")
def A26_roster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roster.roster_stats(a.roster(spark, sf_dir, "micro"))


@query(a.with_tables("resolutions") + " SELECT url, status FROM resolutions WHERE status = 'ok' OR resolved_at > 400000 - 24 * 3600")
def F9_fresh_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.fresh_resolutions(a.resolutions(spark, sf_dir), 400000).select("url", "status")


@query(a.with_tables("tracker", "resolutions", "export") + " SELECT t.excel_row, r.note_id FROM tracker t JOIN resolutions r ON t.post_link = r.url WHERE r.status = 'ok' AND r.note_id <> '' AND r.author_id = '' AND r.note_id NOT IN (SELECT post_id FROM export)")
def X12_X13_needs_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.needs_author(links.attach_resolutions(a.tracker(spark, sf_dir), a.resolutions(spark, sf_dir)), a.export(spark, sf_dir)).select("excel_row", "note_id")


_ANNOTATED = _VERDICTS + f", n AS (SELECT *, {TEXTS} AS annotation, CASE WHEN excel_row % 9 = 0 THEN '无帖子' ELSE '' END AS existing FROM v)"


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = verdicts(spark, sf_dir)
    return v.withColumn("annotation", match.annotation(v)).withColumn("existing", F.when(F.col("excel_row") % 9 == 0, "无帖子").otherwise(""))


@query(_ANNOTATED + f""" SELECT excel_row, CASE WHEN excel_row % 50 = 0 THEN '无博主' WHEN excel_row % 50 = 1 THEN '' WHEN existing <> '' THEN existing ELSE annotation END AS annotation_out,
    status || CASE WHEN excel_row % 50 IN (0, 1) THEN ' (override)' || CASE WHEN existing <> '' THEN ' (source S ''' || existing || ''' replaced by override)' ELSE '' END
        WHEN existing = '' THEN '' WHEN existing = trim(annotation) THEN ' (S kept from source)' ELSE ' (S kept from source; pipeline verdict was ' || CASE WHEN annotation = '' THEN '(blank=matched)' ELSE annotation END || ')' END AS status_out FROM n""")
def K1_X14_W7_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = a.tracker(spark, sf_dir).where("excel_row % 50 in (0, 1)").select("excel_row", F.explode(F.array(F.struct(F.lit("old").alias("status"), F.lit(1).alias("updated_at")), F.struct(F.when(F.col("excel_row") % 50 == 0, "无博主").otherwise(output.CLEARED).alias("status"), F.lit(2).alias("updated_at")))).alias("o")).select("excel_row", "o.*")
    return output.annotate(_annotated(spark, sf_dir), over).select("excel_row", "annotation_out", "status_out")


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'changed' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def K5_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = a.read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return output.upsert(base, base.where("c_custkey % 7 = 0").withColumn("c_mktsegment", F.lit("changed")), ["c_custkey"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'changed' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 14 = 0 THEN -1 ELSE c_nationkey END AS c_nationkey FROM customer")
def K5_merge_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = a.read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    patch = base.where("c_custkey % 7 = 0").selectExpr("c_custkey", "CASE WHEN c_custkey % 14 = 0 THEN map('c_mktsegment', 'changed', 'c_nationkey', CAST(NULL AS STRING)) ELSE map('c_mktsegment', 'changed') END AS supplied")
    return output.merge_fields(base, patch, ["c_custkey"], ["c_mktsegment", "c_nationkey"]).withColumn("c_nationkey", F.coalesce("c_nationkey", F.lit(-1)))


@query(_VERDICTS + " SELECT excel_row, status FROM v WHERE (status IN ('REVIEW', 'LINK_ERROR') OR name_mislabel) AND contains(lower(campaign || ' ' || no || ' ' || name || ' ' || status), '#1997')")
def F11_result_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return output.result_view(verdicts(spark, sf_dir), text="#1997", attention=True).select("excel_row", "status")


_CLASS = "CASE WHEN {0} = '' THEN 'MATCH' WHEN {0} LIKE '无博主%' THEN '无博主' WHEN {0} LIKE '无帖子%' THEN '无帖子' WHEN {0} LIKE '人工%' THEN '人工复核' WHEN {0} LIKE 'Check%' THEN 'Check链接错误' ELSE {0} END"
_LABELS = _ANNOTATED + f""", l AS (SELECT campaign, no, name, tier, post_date, CASE WHEN excel_row % 20 = 0 THEN '无帖子' ELSE annotation END AS lab, annotation FROM n),
    k AS (SELECT campaign, no, name, tier, post_date, {_CLASS.format("lab")} AS want, {_CLASS.format("annotation")} AS got FROM l)"""


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _annotated(spark, sf_dir)
    labels = evaluate.load_labels(n.withColumn("annotation", F.when(F.col("excel_row") % 20 == 0, "无帖子").otherwise(F.col("annotation"))))
    noise = n.where("excel_row % 40 = 0").select("name", "post_date")
    return evaluate.compare_labels(labels, n, noise)


@query(_LABELS + " SELECT want, got, count(*) AS n FROM k GROUP BY want, got")
def A27_X16_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(_compared(spark, sf_dir))


@query(_LABELS + """, z AS (SELECT want, got, tier, want <> got AND EXISTS (SELECT 1 FROM n q WHERE q.excel_row % 40 = 0 AND q.name = k.name AND q.post_date = k.post_date) AS excused FROM k)
    SELECT count(*) AS total, count(*) FILTER (WHERE want = got) AS agree, count(*) FILTER (WHERE excused) AS excused, count(*) FILTER (WHERE want <> got AND NOT excused AND tier NOT LIKE '3:%') AS id_proven,
        count(*) FILTER (WHERE want <> got AND NOT excused AND tier LIKE '3:%') AS unexplained, count(*) FILTER (WHERE want = got OR excused) >= count(*) - 2 AS accepted FROM z""")
def A28_X17_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.acceptance(_compared(spark, sf_dir))


@query("SELECT l_returnflag, l_linestatus, 'left' AS side, count(*) AS n FROM lineitem WHERE l_linenumber = 7 GROUP BY ALL")
def E5_table_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_partkey")
    return evaluate.table_diff(rows, rows.where("l_linenumber <> 7")).groupBy("l_returnflag", "l_linestatus", "side").agg(F.count("*").alias("n"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.read(spark, sf_dir, "orders").selectExpr("o_orderkey AS run_id", "o_orderdate AS created_at", "CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'queued' ELSE 'done' END AS status", "'' AS message")


@query("SELECT o_orderkey AS run_id FROM orders WHERE o_orderstatus NOT IN ('O', 'P') AND o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 400 DAY")
def M1_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.expired(_runs(spark, sf_dir), "1998-01-01", 400 * 86400.0).select("run_id")


@query("SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'error' ELSE 'done' END AS status FROM orders")
def M4_mark_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.mark_orphans(_runs(spark, sf_dir)).select("run_id", "status")


@query("SELECT l_orderkey AS run_id, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def M3_drop_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = a.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"))
    return manifest.drop_run(over, _runs(spark, sf_dir).where("status = 'done'")).groupBy("run_id").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT c_custkey AS run_id, c_custkey % 97 AS bytes, c_custkey % 13 AS modified_at, c_custkey % 5 = 0 AS protected FROM customer),
    b AS (SELECT *, coalesce(sum(bytes) OVER (ORDER BY modified_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r WHERE NOT protected) SELECT run_id FROM b WHERE (SELECT sum(bytes) FROM r) - before > 40000""")
def W6_over_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = a.read(spark, sf_dir, "customer").selectExpr("c_custkey AS run_id", "c_custkey % 97 AS bytes", "c_custkey % 13 AS modified_at", "c_custkey % 5 = 0 AS protected")
    return manifest.over_budget(runs, 40000).select("run_id")


@query("SELECT o_orderkey AS run_id FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 30")
def L6_recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.recent_runs(_runs(spark, sf_dir)).select("run_id")


@query("SELECT user_id AS run_id, event_type AS kind, count(*) AS calls FROM events GROUP BY ALL")
def A30_call_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.call_counts(a.read(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("kind"), F.lit(1).cast("long").alias("amount")))


@query("""WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events WHERE event_type = 'error'),
    f AS (SELECT *, count(*) OVER w AS failures, min(t) OVER w AS first FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW))
    SELECT event_id, failures, failures >= 5 AS blocked, CASE WHEN failures >= 5 THEN first + 86400 - t ELSE 0 END AS retry_after FROM f""")
def W8_sliding_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.read(spark, sf_dir, "events").where("event_type = 'error'")
    return manifest.sliding_failures(e, "user_id", "ts", 86400, 5).select("event_id", "failures", "blocked", "retry_after")


@query("""WITH w AS (SELECT user_id, date_trunc('hour', ts) - INTERVAL 1 HOUR * i AS from_ts FROM events, (VALUES (0), (1), (2), (3), (4)) x(i) WHERE event_type = 'error')
    SELECT user_id, CAST(from_ts AS VARCHAR) AS from_ts, count(*) AS failures FROM w GROUP BY ALL""")
def W8_failure_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.read(spark, sf_dir, "events").where("event_type = 'error'")
    out = jobs.failure_windows(e, "user_id", "ts", "5 hours", "1 hour")
    return out.select("user_id", F.date_format("from_ts", "yyyy-MM-dd HH:mm:ss").alias("from_ts"), "failures")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN '打开' WHEN o_orderstatus = 'F' THEN '订单 ' || o_orderkey || ' 完成' ELSE 'row ' || o_orderkey || ': P' END AS text FROM orders""")
def P15_translate_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = a.read(spark, sf_dir, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'row ' || o_orderkey || ': ' || o_orderstatus END AS message")
    dictionary = spark.createDataFrame([("open", "打开")], "source string, target string")
    return forms.translate_messages(o, "message", dictionary, [(r"row (\d+): F", "订单 $1 完成")], "text").select("o_orderkey", "text")


@query()
def P2_norm_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.add_forms(a.read(spark, sf_dir, "documents").select("doc_id", "text"), "text", "f_").select("doc_id", F.char_length("f_norm").alias("n_norm"), F.char_length("f_cjk").alias("n_cjk"))


@query(_VERDICTS + " SELECT 'run1' AS run_id, excel_row, status FROM v")
def K3_audit_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = output.audit_document("run1", verdicts(spark, sf_dir))
    return doc.select("run_id", "excel_row", F.get_json_object("document", "$.status").alias("status"))


@query(_VERDICTS + """ SELECT 'verdicts' AS section, CAST(excel_row AS BIGINT) AS excel_row, status AS first, CASE WHEN excel_row % 50 = 0 THEN 'o2' ELSE '' END AS second FROM v
    UNION ALL SELECT 'counts', -1, status, CAST(count(*) AS VARCHAR) FROM v GROUP BY status UNION ALL SELECT 'counts', -1, 'MATCH_name_mislabel', CAST(count(*) AS VARCHAR) FROM v WHERE name_mislabel HAVING count(*) > 0
    UNION ALL SELECT 'reverse_audit', e.excel_row, e.post_id, e.username FROM export e WHERE e.username IN (SELECT author_id FROM v WHERE author_id <> '')
    AND e.post_id NOT IN (SELECT m_post FROM v WHERE m_post IS NOT NULL) AND coalesce(e.post_date BETWEEN (SELECT min(post_date) - 1 FROM v) AND (SELECT max(post_date) + 1 FROM v), true)""")
def K3_run_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's whole document, written, read and taken apart into its tables again."""
    v = settled(verdicts(spark, sf_dir))
    over = v.where("excel_row % 50 = 0").select("excel_row", F.explode(F.array(F.struct(F.lit("o1").alias("status"), F.lit(1).alias("updated_at")), F.struct(F.lit("o2").alias("status"), F.lit(2).alias("updated_at")))).alias("o")).select("excel_row", "o.*")
    run = spark.range(1).select(F.lit("run1").alias("run_id"), F.lit("2026-05-01").alias("created_at"))
    doc = settled(output.run_document(run, v, over, match.status_counts(v), match.reverse_audit(v, a.export(spark, sf_dir))))
    schema = lambda ddl: T.StructType.fromDDL(ddl)
    judged = output.document_rows(doc, "verdicts", schema("excel_row bigint, status string, override struct<status: string>"))
    judged = judged.select(F.lit("verdicts").alias("section"), "excel_row", F.col("status").alias("first"), F.coalesce("override.status", F.lit("")).alias("second"))
    counts = doc.where("section = 'head'").select(F.explode(F.from_json("document", "counts map<string, bigint>")["counts"]).alias("status", "n"))
    counts = counts.select(F.lit("counts"), F.lit(-1).cast("long"), "status", F.col("n").cast("string"))
    found = output.document_rows(doc, "reverse_audit", schema("excel_row bigint, post_id string, username string")).select(F.lit("reverse_audit"), "excel_row", "post_id", "username")
    return judged.union(counts).union(found)


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'changed' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT c_custkey, 'changed' FROM customer WHERE c_nationkey = 3 AND c_custkey % 7 = 0")
def K5_versioned_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table, then changes to some keys and new keys, then the newest version."""
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    base = a.read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    output.store_upsert(base.where("c_nationkey <> 3").drop("c_nationkey"), path, ["c_custkey"])
    output.store_upsert(base.where("c_custkey % 7 = 0").select("c_custkey", F.lit("changed").alias("c_mktsegment")), path, ["c_custkey"])
    return versions.read(spark, path)


@query("SELECT workbook AS run_id, count(*) AS rows FROM (SELECT 'r' || (o_orderkey % 5) AS workbook FROM orders WHERE o_orderkey % 5 <> 3 AND (o_orderkey % 5 <> 1 OR o_orderkey % 2 = 0)) GROUP BY 1")
def K4_stored_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one table: all written, one written again with fewer rows, one dropped."""
    path = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    rows = a.read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("r"), F.col("o_orderkey") % 5).alias("run_id"))
    versions.replace_parts(rows, path, "run_id")
    output.write_run(rows.where("run_id = 'r1' and o_orderkey % 2 = 0").drop("run_id"), path, "r1")
    versions.drop_parts(spark, path, ["r3"])
    return versions.read(spark, path).groupBy("run_id").agg(F.count("*").alias("rows"))


@query("""SELECT doc_id, sha256('v1||' || coalesce(text, '')) AS hash, 'stored' AS state, length(coalesce(text, '')) AS n_chars,
    CASE WHEN coalesce(text, '') = '' THEN 'empty' WHEN contains(text, chr(10)) THEN '' ELSE 'one line' END AS warnings FROM documents""")
def S12_ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the ingest stream, twice; then what is told of each."""
    folder = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    path = f"{sf_dir}/documents.parquet"

    def parse(new: DataFrame) -> DataFrame:
        text = F.col("content").cast("string")
        warning = F.when(text == "", "empty").when(~F.contains(text, F.lit("\n")), "one line")
        return new.select("hash", F.to_json(F.struct(F.char_length(text).alias("n_chars"))).alias("payload"), F.array_compact(F.array(warning)).alias("warnings"))

    fields = [F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content")]
    # a file stream takes one file only as a glob
    arriving = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/documents.parque[t]").select(*fields)
    for _ in range(2):
        jobs.ingest_stream(arriving, f"{folder}/manifest", f"{folder}/checkpoint-{uuid.uuid4().hex}", parse, "v1").awaitTermination()
    told = manifest.replay(spark.read.parquet(path).select(*fields), f"{folder}/manifest", "v1")
    return told.select(F.col("path").cast("long").alias("doc_id"), "hash", "state", F.get_json_object("payload", "$.n_chars").cast("long").alias("n_chars"), F.array_join("warnings", ",").alias("warnings"))


@query("""SELECT sha256('v1||' || text) AS hash, min(doc_id) AS doc_id FROM documents GROUP BY text HAVING min(doc_id) % 2 = 0""")
def S12_ingest_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = a.read(spark, sf_dir, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.col("text").cast("binary").alias("content"))
    every = manifest.ingest_new(files, spark.createDataFrame([], "hash string"), "v1")
    known = every.where(F.col("path").cast("long") % 2 == 1).select("hash")
    return manifest.ingest_new(files, known, "v1").select("hash", F.col("path").cast("long").alias("doc_id"))
