"""URL filters by a sort-merge range join.

A host is keyed by its labels in reverse, each followed by a dot, so a rule's host and all its subdomains are one
interval of keys: ["net.example.", "net.example/"). Intervals of hosts nest or are disjoint. The rule side is swept once
into boundaries, each carrying the stack of rules active from there on; urls and boundaries are then sorted by key and a
running last() hands every url the stack at its place. Urls are dealt by a salt, not by host, and the boundaries (two
for each rule host) are repeated for each salt: a host with a third of all pages is spread like any other, and the sort
runs in spillable windows. Paths are prefixes within a host and are tested on the stack. All of it is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, UPPER, partitions, quoted


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; null or no :// gives the empty string."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; null or no :// gives the empty string."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """A table of rules from (verdict, host, path)."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def boundaries(rules: DataFrame) -> DataFrame:
    """The sweep over rules: at each key where an interval begins or ends, the stack active from there on."""
    own = rules.where("host is not null and verdict is not null").select(
        F.translate("host", UPPER, LOWER).alias("host"),
        F.struct(
            (F.char_length("host") + F.char_length(F.coalesce("path", F.lit("")))).alias("length"),
            F.concat(F.translate("host", UPPER, LOWER), F.coalesce("path", F.lit(""))).alias("rule"),
            F.coalesce("path", F.lit("")).alias("path"),
            "verdict",
        ).alias("r"),
    )
    hosts = own.groupBy("host").agg(F.collect_set("r").alias("rules"))
    labels = F.split("host", r"\.", -1)
    above = hosts.select(
        F.col("host").alias("below"),
        F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("host"),
    )
    stacks = above.join(hosts, "host").groupBy("below").agg(
        F.flatten(F.collect_list("rules")).alias("inside"),
        F.flatten(F.collect_list(F.when(F.col("host") != F.col("below"), F.col("rules")))).alias("outside"),
    )
    key = F.array_join(F.reverse(F.split("below", r"\.", -1)), ".")
    return stacks.select(
        F.explode(
            F.array(
                F.struct(F.concat(key, F.lit(".")).alias("key"), F.col("inside").alias("stack")),
                F.struct(F.concat(key, F.lit("/")).alias("key"), F.col("outside").alias("stack")),
            )
        ).alias("b")
    ).select("b.*")


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", salts: int | None = None) -> DataFrame:
    """Append host, path, rule and verdict to each page.

    rules has verdict, host and path. A rule fits its host and every subdomain if the url's path starts with the
    rule's; the longest (host and path together) wins, ties go to the greater rule text. No rule: rule is null and the
    verdict is `default`. Null urls and urls without :// have an empty host and path and meet no rule. Every row is
    returned, repeated rows too; columns named like the results are replaced, others are kept. Rules with a null host or
    verdict are ignored, a null path fits every path; empty tables on either side are fine.
    """
    spark = pages.sparkSession
    salts = salts or 4 * partitions(spark)
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    row = F.struct(*[quoted(c) for c in names])
    urls = pages.select(
        F.pmod(F.xxhash64(*[quoted(c) for c in names]), F.lit(salts)).alias("salt"),
        host_key(host_of(quoted(url))).alias("key"),
        F.lit(1).alias("order"),
        F.lit(None).cast("array<struct<length:int,rule:string,path:string,verdict:string>>").alias("stack"),
        row.alias("row"),
    )
    edges = boundaries(rules).select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"),
        "key",
        F.lit(0).alias("order"),
        "stack",
        F.lit(None).cast(urls.schema["row"].dataType).alias("row"),
    )
    sweep = W.partitionBy("salt").orderBy("key", "order").rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = edges.unionByName(urls).select("order", "row", F.last("stack", ignorenulls=True).over(sweep).alias("active"))
    path = path_of(F.col("row").getField(url))
    judged = swept.where(F.col("order") == 1).select(
        "row",
        host_of(F.col("row").getField(url)).alias("host"),
        path.alias("path"),
        F.array_max(F.filter("active", lambda r: F.startswith(path, r["path"]))).alias("best"),
    )
    return judged.select(
        *[F.col("row").getField(c).alias(c) for c in names],
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
