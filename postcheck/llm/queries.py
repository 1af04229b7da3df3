"""One query for each operator of this subpackage, with its production parameters, over its whole table, and their SQL."""

from __future__ import annotations

import json

from public_tokenizers import PATTERN, path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, lexical, line_dedup, minhash, mixing, packing, secret_scan, token_counts, topk, toxicity, url_rules, vector_dedup

RANKS = path("byte_bpe_multi_50k.tiktoken")
TOKENIZER = path("byte_bpe_50k.json")
PIECES = path("piece_bpe_32k.model")
WORDS = path("word_bpe_49k.json")
TOKEN_LIMIT = 512
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.encode(_read(spark, sf_dir, "documents").select("doc_id", "text"), RANKS, PATTERN, decoded="decoded")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    with open(TOKENIZER) as f:
        vocabulary = [w.lstrip("Ġ") for w in json.load(f)["model"]["vocab"]]
    found = secret_scan.candidates(docs)
    learn = found.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0)
    findings = learn.withColumn("label", secret_scan.weak_label(learn)).where("label is not null")
    return secret_scan.scan(docs, findings, secret_scan.dictionary_table(docs, vocabulary))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, cap=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, _read(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", token_counts.n_bytes(F.col("text")).alias("n_bytes"))
    counted = token_counts.count_tokens(docs, TOKENIZER, PATTERN)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(_read(spark, sf_dir, "embeddings"), threshold=0.95)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_rules.filter_urls(pages, url_rules.rule_table(spark, RULES), default="allow")
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.drop_common_lines(docs, min_documents=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), k=50)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), WORDS, capacity=4096, end_id=1)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_read(spark, sf_dir, "documents"), TOKENIZER, PIECES, groups=False)


QUERIES = {
    f.__name__: f
    for f in (op1_bpe, op2_secret_scan, op3_mix, op4_toxicity, op5_top_k, op6_token_counts, op7_near_vectors, op8_near_duplicates, op9_url_rules, op10_line_dedup, op11_ranked_search, op12_packing, op13_alignment)
}

ORACLE_SQL = {
    "op5_top_k": """
        WITH v AS (
            SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, q.e, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
            FROM (SELECT DISTINCT vec_id, e FROM v) q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, e ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op9_url_rules": r"""
        WITH rules(rule, rule_host, rule_path, verdict) AS (
            VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
                   ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
        ), p AS (
            SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
        ), h AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
        ), m AS (
            SELECT h.page_id, h.host, h.path, r.rule, r.verdict,
                   row_number() OVER (PARTITION BY h.page_id ORDER BY length(r.rule) DESC NULLS LAST) AS k
            FROM h LEFT JOIN rules r ON (h.host = r.rule_host OR ends_with(h.host, '.' || r.rule_host)) AND starts_with(h.path, r.rule_path)
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
    """,
    "op10_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
        ), k AS (
            SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l
        ), hot AS (
            SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
        )
        SELECT doc_id, count(*) AS n_lines, count(hot.key) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE hot.key IS NULL), '')) AS kept_sha256
        FROM k LEFT JOIN hot ON k.key = hot.key GROUP BY doc_id
    """,
    "op11_ranked_search": r"""
        WITH t AS (
            SELECT doc_id, row_number() OVER () AS doc, string_split_regex(
                       translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
        ), w AS (SELECT doc, doc_id, unnest(terms) AS term FROM t),
        p AS (SELECT doc, doc_id, term, count(*) AS tf FROM w WHERE term <> '' GROUP BY ALL),
        d AS (SELECT doc, sum(tf) AS n FROM p GROUP BY doc),
        c AS (SELECT count(*) AS total, sum(n) AS length FROM d),
        f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
        q AS (
            SELECT DISTINCT item_id, unnest(string_split_regex(
                       translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark WHERE item_id IS NOT NULL
        ), s AS (
            SELECT q.item_id, p.doc, p.doc_id, CAST(sum(
                       CAST(floor(1000 * ln(CAST(2 * c.total + 2 AS DOUBLE) / (2 * f.df + 1))) AS BIGINT)
                       * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (100 - 50 + CAST((50 * d.n * c.total) // c.length AS BIGINT))))) AS BIGINT) AS score
            FROM q JOIN f USING (term) JOIN p USING (term) JOIN d USING (doc) CROSS JOIN c GROUP BY q.item_id, p.doc, p.doc_id
        ), r AS (
            SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
        )
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
    """,
}
