"""Efficiency queries over the adapted line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import settled
from ..operators import efficiency as e
from ..sources import adapters as a
from .registry import query

_FANS = "(CASE WHEN fanbase_raw >= 10000 THEN fanbase_raw / 1000 ELSE fanbase_raw END)"
_CLASSIFIED = (
    a.with_tables("efficiency")
    + f""", c AS (
    SELECT *, {_FANS} AS fanbase_k, coalesce(fanbase_raw >= 10000, false) AS unit_fixed,
        CASE WHEN type_raw LIKE '%报备%' THEN 'PAID' WHEN type_raw LIKE '%软植%' THEN 'SOFT' ELSE '' END AS coop,
        CASE WHEN level_raw = '头部' THEN 'TOP' WHEN level_raw = '腰部' THEN 'MID' WHEN level_raw IN ('尾部', '底部') THEN 'BOT' WHEN level_raw = 'KOC' THEN 'KOC'
             WHEN {_FANS} >= 1000 THEN 'TOP' WHEN {_FANS} > 400 THEN 'MID' WHEN {_FANS} > 200 THEN 'BOT' WHEN fanbase_raw IS NOT NULL THEN 'KOC' ELSE '' END AS tier,
        (impression IS NULL OR like_n IS NULL OR collection IS NULL OR comment_n IS NULL OR ttl_engagement IS NULL OR price IS NULL) AS excluded
    FROM efficiency
), p AS (SELECT *, (level_raw = '' AND tier <> '') AS by_followers, CASE WHEN tier <> '' AND coop <> '' THEN tier || ' ' || coop ELSE '' END AS grp FROM c)"""
)
_GROUPS = (
    _CLASSIFIED
    + """, live AS (SELECT * FROM p WHERE NOT excluded), r AS (
    SELECT *, row_number() OVER (PARTITION BY grp ORDER BY impression DESC) AS k FROM live WHERE grp <> ''
), g AS (
    SELECT grp, tier, coop, count(*) AS n, round(count(*) / (SELECT count(*) FROM live) * 100, 1) AS share, avg(price) AS avg_price,
        sum(CASE WHEN impression > 0 THEN price END) / sum(impression) * 1000 AS cpm_pooled,
        sum(CASE WHEN ttl_engagement > 0 THEN price END) / sum(ttl_engagement) AS cpe_pooled,
        avg(CASE WHEN impression > 0 THEN price / impression * 1000 END) AS cpm_perpost,
        avg(CASE WHEN ttl_engagement > 0 THEN price / ttl_engagement END) AS cpe_perpost,
        sum(price) AS spend, CAST(sum(impression) AS BIGINT) AS impressions, CAST(sum(ttl_engagement) AS BIGINT) AS engagements,
        sum(CASE WHEN k <= 2 THEN impression END) / sum(impression) * 100 AS concentration_pct, CAST(least(2, count(*)) AS INTEGER) AS concentration_top_k
    FROM r GROUP BY grp, tier, coop
)"""
)
_MEASURES = ["avg_price", "cpm_pooled", "cpe_pooled", "cpm_perpost", "cpe_perpost", "spend", "concentration_pct"]


def _rounded_sql(columns: str, table: str) -> str:
    return f"SELECT {columns}, " + ", ".join(f"round({m}, 4) AS {m}" for m in _MEASURES) + f" FROM {table}"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 4).alias(c) if c in _MEASURES else F.col(c) for c in df.columns])


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.flag_missing(e.classify(a.efficiency(spark, sf_dir)))


@query(_CLASSIFIED + " SELECT coop, tier, grp, unit_fixed, by_followers, excluded, count(*) AS n, round(sum(fanbase_k), 3) AS fans FROM p GROUP BY ALL")
def P25_P29_F6_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts(spark, sf_dir).groupBy("coop", "tier", "grp", "unit_fixed", "by_followers", "excluded").agg(F.count("*").alias("n"), F.round(F.sum("fanbase_k"), 3).alias("fans"))


@query(_GROUPS + _rounded_sql("grp, tier, coop, n, share, impressions, engagements, concentration_top_k", "g"))
def A5_group_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(e.group_metrics(posts(spark, sf_dir)))


@query(_GROUPS + _rounded_sql("grp, tier, coop, n, share, impressions, engagements, concentration_top_k", "g"))
def A8_group_metrics_second_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(e.group_metrics_sql(posts(spark, sf_dir)))


@query("SELECT CAST('' AS VARCHAR) AS grp, '' AS column, CAST(0 AS DOUBLE) AS left, CAST(0 AS DOUBLE) AS right WHERE false")
def X20_E4_dual_path_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts(spark, sf_dir)
    return e.compare_metrics(_rounded(e.group_metrics(p)), _rounded(e.group_metrics_sql(p)), ["grp"], ["n", "share", *_MEASURES, "impressions", "engagements"])


_TOTALS = """t AS (SELECT count(*) AS rows, count(*) FILTER (WHERE grp <> '') AS classified, count(*) FILTER (WHERE grp = '') AS unclassified,
    round(count(*) FILTER (WHERE grp = '') / count(*) * 100, 1) AS unclassified_share, sum(price) AS spend, CAST(sum(impression) AS BIGINT) AS impressions,
    CAST(sum(ttl_engagement) AS BIGINT) AS engagements, (SELECT count(*) FROM p WHERE excluded) AS excluded_rows, count(*) FILTER (WHERE mcn = '') AS mcn_missing FROM live)"""


@query(_GROUPS + ", " + _TOTALS + " SELECT * REPLACE (round(spend, 2) AS spend) FROM t")
def A6_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.totals(posts(spark, sf_dir)).withColumn("spend", F.round("spend", 2))


@query(_GROUPS + """, m AS (SELECT lower(trim(mcn)) AS agency_key, arg_min(trim(mcn), excel_row) AS agency, count(*) AS n, round(sum(price), 2) AS spend,
    round(sum(CASE WHEN ttl_engagement > 0 THEN price END) / sum(ttl_engagement), 4) AS cpe_pooled, round(avg(CASE WHEN ttl_engagement > 0 THEN price / ttl_engagement END), 4) AS cpe_perpost
    FROM live WHERE trim(mcn) <> '' GROUP BY 1) SELECT *, CAST(row_number() OVER (ORDER BY n DESC, agency_key) AS INTEGER) AS rank FROM m""")
def A7_L3_agency_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = e.agency_metrics(posts(spark, sf_dir))
    return out.withColumn("spend", F.round("spend", 2)).withColumn("cpe_pooled", F.round("cpe_pooled", 4)).withColumn("cpe_perpost", F.round("cpe_perpost", 4))


@query("SELECT true AS rows_add_up, true AS spend_within, true AS shares_add_up")
def A9_reconcile_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts(spark, sf_dir)
    return e.reconcile_totals(e.group_metrics(p), e.totals(p))


_RULES = _GROUPS + """, f AS (
    SELECT 'V2' AS code, '' AS detail, excel_row FROM p WHERE excluded
    UNION ALL SELECT 'V3', 'impression', excel_row FROM live WHERE impression = 0
    UNION ALL SELECT 'V3', 'engagement', excel_row FROM live WHERE ttl_engagement = 0
    UNION ALL SELECT 'V4', '', excel_row FROM live WHERE ttl_engagement <> like_n + collection + comment_n
    UNION ALL SELECT 'V5', '', excel_row FROM live WHERE impression > 0 AND price / impression <> 0 AND abs(cpm_src - price / impression) / (price / impression) > 0.02
    UNION ALL SELECT 'V7', 'TYPE ' || type_raw, excel_row FROM p WHERE coop = ''
    UNION ALL SELECT 'V7', 'LEVEL ' || level_raw, excel_row FROM p WHERE tier = ''
    UNION ALL SELECT 'V11', level_raw, excel_row FROM p WHERE by_followers
    UNION ALL SELECT 'V12', '', excel_row FROM p WHERE unit_fixed
    UNION ALL SELECT 'V13', '', excel_row FROM live WHERE mcn = ''
), v8 AS (
    SELECT 'V8' AS code, printf('尾部 %d fans %s-%s / 底部 %d fans %s-%s / %d below', count(*) FILTER (WHERE level_raw = '尾部'), CAST(CAST(round(min(fanbase_k) FILTER (WHERE level_raw = '尾部')) AS BIGINT) AS VARCHAR), CAST(CAST(round(max(fanbase_k) FILTER (WHERE level_raw = '尾部')) AS BIGINT) AS VARCHAR),
        count(*) FILTER (WHERE level_raw = '底部'), CAST(CAST(round(min(fanbase_k) FILTER (WHERE level_raw = '底部')) AS BIGINT) AS VARCHAR), CAST(CAST(round(max(fanbase_k) FILTER (WHERE level_raw = '底部')) AS BIGINT) AS VARCHAR), count(*) FILTER (WHERE level_raw = '底部' AND fanbase_k < 200)) AS detail,
        count(*) FILTER (WHERE level_raw = '底部') AS n FROM p
)"""


@query(_RULES + """ SELECT code, detail, count(*) AS n, CAST(sum(excel_row) AS BIGINT) AS row_sum FROM f GROUP BY code, detail
    UNION ALL SELECT code, detail, n, 0 FROM v8
    UNION ALL SELECT 'V9', grp, n, 0 FROM g WHERE n < 3 UNION ALL SELECT 'V10', grp, n, 0 FROM g WHERE n > 2 AND concentration_pct > 50""")
def A11_A22_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts(spark, sf_dir)
    lines = e.finding_rows(p).groupBy("code", "detail").agg(F.count("*").alias("n"), F.sum("excel_row").alias("row_sum"))
    return lines.union(e.findings(p).where("code in ('V8', 'V9', 'V10')").select("code", "detail", "n", F.lit(0).cast("long")))


@query(_RULES + " SELECT code, detail, CAST(excel_row AS BIGINT) AS excel_row FROM f")
def A11_A22_finding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.finding_rows(posts(spark, sf_dir)).select("code", "detail", "excel_row")


@query(_GROUPS + " SELECT right(post_link, 24) AS detail, count(*) AS n, list(excel_row ORDER BY excel_row)::VARCHAR AS rows FROM p GROUP BY post_link HAVING count(*) > 1")
def A15_duplicate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.duplicate_links(posts(spark, sf_dir)).select("detail", "n", F.concat(F.lit("["), F.array_join("rows", ", "), F.lit("]")).alias("rows"))


_ORDER = "list_position(['TOP', 'MID', 'BOT', 'KOC'], tier)"
_PIVOT = "SELECT tier, max(CASE WHEN coop = 'PAID' THEN {0} END) AS paid, max(CASE WHEN coop = 'SOFT' THEN {0} END) AS soft FROM g GROUP BY tier HAVING paid IS NOT NULL AND soft IS NOT NULL"


@query(_GROUPS + f""", price AS ({_PIVOT.format('avg_price')}), cpm AS ({_PIVOT.format('cpm_pooled')}), cpe AS ({_PIVOT.format('cpe_pooled')})
    SELECT CASE WHEN paid >= soft THEN 'premium' ELSE 'inversion' END AS kind, {_ORDER} AS position, tier || ' ' || CASE WHEN paid >= soft THEN '+' ELSE '' END || printf('%.1fK', (paid - soft) / 1000) AS text FROM price
    UNION ALL SELECT 'cpm_winner', {_ORDER}, printf('%s: %s ¥%.0f VS ¥%.0f', tier, CASE WHEN paid <= soft THEN 'PAID' ELSE 'SOFT' END, least(paid, soft), greatest(paid, soft)) FROM cpm
    UNION ALL SELECT 'cpe_winner', {_ORDER}, printf('%s: %s ¥%.1f VS ¥%.1f', tier, CASE WHEN paid <= soft THEN 'PAID' ELSE 'SOFT' END, least(paid, soft), greatest(paid, soft)) FROM cpe
    UNION ALL SELECT 'footnote', 1, printf('Basis: pooled; n = %d posts: %s', (SELECT count(*) FROM live), (SELECT string_agg(tier || ' ' || n, ' · ' ORDER BY o) FROM (SELECT tier, {_ORDER} AS o, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY tier)))
    UNION ALL SELECT 'caveat', {_ORDER}, printf('%s: %d post(s), too few to compare', grp, n) FROM g WHERE n < 3""")
def R1_R4_A29_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts(spark, sf_dir)
    return e.insights(e.group_metrics(p), e.totals(p))


@query(_GROUPS + """, d AS (SELECT t, c, CAST(2 * i + j AS INTEGER) AS position FROM (VALUES (0, 'TOP'), (1, 'MID'), (2, 'BOT'), (3, 'KOC')) x(i, t), (VALUES (0, 'SOFT'), (1, 'PAID')) y(j, c))
    SELECT position, t AS tier, c AS coop, round(cpm_pooled, 4) AS value FROM d LEFT JOIN g ON t = tier AND c = coop""")
def R5_L4_chart_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.chart_series(e.group_metrics(posts(spark, sf_dir)), "cpm_pooled").withColumn("value", F.round("value", 4))


@query(_GROUPS + ", " + _TOTALS + """, s AS (SELECT grp, list_position(['TOP SOFT', 'TOP PAID', 'MID SOFT', 'MID PAID', 'BOT SOFT', 'BOT PAID', 'KOC SOFT', 'KOC PAID'], grp) AS position, share FROM g
    UNION ALL SELECT 'UNCLASSIFIED', 99, unclassified_share FROM t WHERE unclassified > 0) SELECT grp, CAST(position AS BIGINT) AS position, share, share < 3 AS sliver FROM s""")
def R6_share_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts(spark, sf_dir)
    return e.share_slices(e.group_metrics(p), e.totals(p))


@query(_GROUPS + """, m AS (SELECT lower(trim(mcn)) AS k, arg_min(trim(mcn), excel_row) AS agency, count(*) AS n, sum(CASE WHEN ttl_engagement > 0 THEN price END) / sum(ttl_engagement) AS v
    FROM live WHERE trim(mcn) <> '' GROUP BY 1), rk AS (SELECT *, row_number() OVER (ORDER BY n DESC, k) AS rank FROM m)
    SELECT CAST(rank AS INTEGER) AS rank, agency || ' (' || n || ')' AS label, round(v, 4) AS value, (SELECT count(*) FROM m WHERE v IS NOT NULL) AS of_total FROM rk WHERE v IS NOT NULL ORDER BY rank LIMIT 12""")
def R7_agency_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.agency_series(e.agency_metrics(posts(spark, sf_dir))).withColumn("value", F.round("value", 4))


@query("SELECT false AS blocked")
def R9_is_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.is_blocked(e.findings(posts(spark, sf_dir)))


_PUBLISHED = " UNION ALL ".join(f"SELECT '{c}', coop, {_ORDER}, {c} FROM d" for c in ("avg_price", "cpm_pooled", "cpe_pooled"))


@query(_GROUPS + ", d AS (SELECT t AS tier, c AS coop, avg_price, cpm_pooled, cpe_pooled FROM (VALUES ('TOP'), ('MID'), ('BOT'), ('KOC')) x(t), (VALUES ('SOFT'), ('PAID')) y(c) LEFT JOIN g ON t = tier AND c = coop), s(chart, series, position, value) AS (" + _PUBLISHED + """)
    SELECT chart, series, CAST(position AS BIGINT) AS position, round(value, 3) AS computed, CASE WHEN chart = 'avg_price' THEN round(value + 1, 3) ELSE -1 END AS published, CASE WHEN chart = 'avg_price' THEN 'value differs' ELSE 'series missing' END AS problem
    FROM s WHERE (chart = 'avg_price' AND position = 2 AND value IS NOT NULL) OR (chart = 'cpm_pooled' AND series = 'PAID')""")
def R8_series_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published prices of one tier are off by one and one CPM series is not published; all else agrees."""
    computed = settled(e.published_series(*e.settled_metrics(posts(spark, sf_dir))))
    shown = computed.where("NOT (chart = 'cpm_pooled' AND series = 'PAID')").withColumn("value", F.col("value") + F.when((F.col("chart") == "avg_price") & (F.col("position") == 2), 1.0).otherwise(0.0))
    out = e.series_differences(computed, shown)
    return out.withColumn("computed", F.round("computed", 3)).withColumn("published", F.coalesce(F.round("published", 3), F.lit(-1.0)))
