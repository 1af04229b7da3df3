"""Outputs: annotated trackers, audit documents, upserts and result views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import versions
from .match import ENGAGEMENT
from .roster import membership_text

#: The evidence columns of an annotated tracker by their headers' order, and the column from which room for them is looked for.
EVIDENCE = ("status", "matched_blogger", "membership_text", "likes_retweet", "share_favorites", "comments", "engagement", "weighted_eng")
FIRST_FREE = 20
#: Fixed value: the override that clears an annotation.
CLEARED = "已匹配（清空S）"
CAVEAT = "Export engagement is an early snapshot and not comparable with final tracker figures; it is context only and never used for matching."


def latest(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The most recent row of each key."""
    return df.withColumn("__k", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).where("__k = 1").drop("__k")


def annotate(verdicts: DataFrame, overrides: DataFrame, existing: str = "existing") -> DataFrame:
    """Append annotation_out and status_out: an override wins, else an existing annotation stays, else the verdict's text.

    verdicts has excel_row, status, annotation and the existing annotation; overrides has excel_row, status, updated_at.
    """
    o = latest(overrides, ["excel_row"], "updated_at").select(F.col("excel_row").alias("__row"), F.col("status").alias("__over"))
    out = verdicts.join(o, F.col("excel_row") == F.col("__row"), "left")
    over, kept, own = F.col("__over"), F.coalesce(F.col(existing), F.lit("")), F.coalesce("annotation", F.lit(""))
    text = F.when(over.isNotNull(), F.when(over == CLEARED, "").otherwise(over)).when(kept != "", kept).otherwise(own)
    # What a status says of overrides and kept annotations.
    shown = F.when(own == "", "(blank=matched)").otherwise(own)
    status = F.when(over.isNotNull(), F.concat(F.col("status"), F.lit(" (override)"), F.when(kept != "", F.concat(F.lit(" (source S '"), kept, F.lit("' replaced by override)"))).otherwise("")))
    status = status.when((kept != "") & (F.trim(kept) != F.trim(own)), F.concat(F.col("status"), F.lit(" (S kept from source; pipeline verdict was "), shown, F.lit(")")))
    status = status.when(kept != "", F.concat(F.col("status"), F.lit(" (S kept from source)"))).otherwise(F.col("status"))
    return out.withColumn("annotation_out", text).withColumn("status_out", status).drop("__row", "__over")


def evidence_columns(verdicts: DataFrame, status: str = "status") -> DataFrame:
    """Excel_row and the evidence columns beside an annotation, named by EVIDENCE: status, matched blogger, membership text and the matched post's engagement; empty where there is none."""
    values = [F.col(status), F.nullif("matched.m_blogger", F.lit("")), membership_text(F.col("membership")), *[F.col(f"matched.{c}") for c in ENGAGEMENT]]
    return verdicts.select("excel_row", *[v.alias(name) for name, v in zip(EVIDENCE, values, strict=True)])


def free_block(cells: DataFrame, first: int = FIRST_FREE, width: int = len(EVIDENCE)) -> DataFrame:
    """(workbook, sheet, start): the first of `width` columns side by side, from column `first` on, in which a sheet holds nothing.

    A sheet's distinct filled columns are ordered, not its cells; sheets without any start at `first`, and so do blank cells' columns count as free.
    """
    filled = F.coalesce(F.col("v_str") != "", F.lit(False)) | F.col("v_num").isNotNull() | F.col("v_ts").isNotNull()
    sheets = cells.select("workbook", "sheet").distinct()
    used = cells.where(filled & (F.col("col") >= first)).select("workbook", "sheet", "col").distinct().unionByName(sheets.withColumn("col", F.lit(first - 1)))
    after = F.lead("col").over(W.partitionBy("workbook", "sheet").orderBy("col"))
    free = used.withColumn("after", after).where(F.col("after").isNull() | (F.col("after") - F.col("col") > width))
    return free.groupBy("workbook", "sheet").agg((F.min("col") + 1).alias("start"))


def audit_document(run_id: str, verdicts: DataFrame) -> DataFrame:
    """One JSON line for each verdict under its run, for partitioned JSON output; the caveat travels on every line."""
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in verdicts.columns]))
    return verdicts.select(F.lit(run_id).alias("run_id"), F.col("excel_row"), F.lit(CAVEAT).alias("caveat"), body.alias("document"))


def run_document(run: DataFrame, verdicts: DataFrame, overrides: DataFrame, counts: DataFrame, reverse: DataFrame, size: int = 1000) -> DataFrame:
    """(run_id, section, band, piece, document): a run's audit document in pieces of at most `size` rows, whatever repeats.

    run is one row of the run's own fields with its run_id. Sections: head (the run, its counts by status, the caveat), verdicts (each
    with its newest override, null where there is none) and reverse_audit. Rows of a section lie in the order of excel_row;
    rows without one come first. A section without rows has no piece.
    """
    totals = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("counts"))  # a row for each status
    head = run.crossJoin(F.broadcast(totals)).withColumn("caveat", F.lit(CAVEAT))
    head = head.select("run_id", F.lit("head").alias("section"), F.lit(0).cast("long").alias("band"), F.lit(0).alias("piece"), F.to_json(F.struct("*")).alias("document"))

    band = F.coalesce(F.floor(F.col("excel_row") / size), F.lit(-1)).cast("long").alias("band")
    at = F.col("excel_row").alias("__at")

    # Verdicts and overrides move once, by the band: it holds a row's overrides and is what pieces are cut from.
    over = F.struct(*[c for c in overrides.columns if c != "excel_row"]).alias("override")
    said = overrides.select(band, at, over, F.col("updated_at").alias("__new"))
    both = verdicts.select(band, at, F.struct("*").alias("r")).unionByName(said, allowMissingColumns=True).repartition("band")
    own = W.partitionBy("band", "__at").orderBy(F.col("override").isNull(), F.desc("__new")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    judged = both.withColumn("override", F.first("override").over(own)).where("r is not null").select("band", "__at", F.struct("r.*", "override").alias("r"))

    def pieces(numbered: DataFrame, section: str) -> DataFrame:
        place = F.row_number().over(W.partitionBy("band").orderBy("__at"))
        cut = numbered.withColumn("__place", place).withColumn("piece", F.floor((F.col("__place") - 1) / size).cast("int"))
        rows = F.transform(F.array_sort(F.collect_list(F.struct("__place", F.to_json("r").alias("j")))), lambda x: x["j"])
        body = F.concat(F.lit("["), F.array_join(rows, ","), F.lit("]"))
        one = cut.groupBy("band", "piece").agg(body.alias("document"))
        return one.crossJoin(F.broadcast(run.select("run_id"))).select("run_id", F.lit(section).alias("section"), "band", "piece", "document")

    return head.unionByName(pieces(judged, "verdicts")).unionByName(pieces(reverse.select(band, at, F.struct("*").alias("r")), "reverse_audit"))


def document_rows(document: DataFrame, section: str, schema: T.StructType) -> DataFrame:
    """The rows of one section of run documents, with their run_id; unknown fields are dropped, missing ones are null."""
    return document.where(F.col("section") == section).select("run_id", F.explode(F.from_json("document", T.ArrayType(schema))).alias("r")).select("run_id", "r.*")


def write_run(verdicts: DataFrame, path: str, run_id: str) -> int:
    """Publish a run's verdicts as a part of the runs' table; a run written again replaces its own part only. Returns the table's version."""
    return versions.replace_parts(verdicts.withColumn("run_id", F.lit(run_id)), path, "run_id")


def store_upsert(changes: DataFrame, path: str, keys: Sequence[str]) -> int:
    """Publish a version in which rows of changes replace stored ones of the same key; only key buckets with changes are written again."""
    return versions.merge(changes, path, keys, lambda base, new: upsert(base, new, keys))


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of changes replace those of base with the same key."""
    both = base.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    return latest(both, keys, "__new").drop("__new")


def merge_fields(base: DataFrame, patch: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Only supplied fields change: patch has a map `supplied` from field to text, where a null value clears."""
    p = patch.select(*keys, F.col("supplied").alias("__s"))
    joined = base.join(p, list(keys), "full_outer")
    given = lambda f: F.coalesce(F.map_contains_key("__s", F.lit(f)), F.lit(False))
    new = {f: F.when(given(f), F.try_element_at("__s", F.lit(f)).cast(base.schema[f].dataType)).otherwise(F.col(f)) for f in fields}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in base.columns])


def result_view(verdicts: DataFrame, status: str | None = None, text: str = "", attention: bool = False) -> DataFrame:
    """Filter by status, search text and rows that need attention; tracker order."""
    search = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in ("campaign", "no", "name", "status") if c in verdicts.columns]))
    needs = F.col("status").isin("REVIEW", "LINK_ERROR") | F.col("name_mislabel")
    out = verdicts.where(F.contains(search, F.lit(text.lower())))
    out = out.where(F.col("status") == status) if status else out
    return (out.where(needs) if attention else out).orderBy("excel_row")


def read_verdicts(df: DataFrame, json: str, schema: T.StructType, defaults: dict) -> DataFrame:
    """Stored documents by a fixed schema: unknown fields are dropped, missing ones take their defaults."""
    parsed = df.select(F.from_json(F.col(json), schema).alias("d")).select("d.*")
    return parsed.select(*[F.coalesce(F.col(f.name), F.lit(defaults[f.name])).alias(f.name) if f.name in defaults else F.col(f.name) for f in schema.fields])
