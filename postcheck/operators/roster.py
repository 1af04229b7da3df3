"""Membership in monitored rosters: the id decides, names are evidence only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import forms
from ..functions.shared import settled
from .match import first_per_key, name_hits

#: Membership texts.
MEMBERSHIP = {"micro": "Micro", "macro": "Macro", "both": "Micro + Macro", "none": "None"}


#: What a roster row shows as evidence; columns that a roster lacks are null.
SHOWN = ("name", "namebis", "dmrid", "redbook_id", "followers")
#: Lines listed of each roster.
LISTED = 8


def _shown(roster: DataFrame, method: Column) -> Column:
    value = lambda c: (F.col(c) if c in roster.columns else F.lit(None)).cast("long" if c == "followers" else "string")
    return F.struct(method.alias("method"), *[value(c).alias(c) for c in SHOWN])


def _by_id(roster: DataFrame, prefix: str) -> DataFrame:
    one = first_per_key(roster.withColumn("__id", F.lower(F.trim("redbook_id"))), ["__id"], "roster_row")
    return one.select(F.col("__id").alias(f"{prefix}_id"), F.col("name").alias(f"{prefix}_name"), _shown(one, F.lit("redbook-id")).alias(f"{prefix}_row"))


def membership(verdicts: DataFrame, micro: DataFrame, macro: DataFrame) -> DataFrame:
    """Split absent bloggers by membership (case-insensitive ids, the first roster row of an id wins).

    Appended: membership, roster_name, and perimeter, the roster row whose id decided (the micro list's before the macro list's).
    """
    key = F.lower(F.trim("author_id"))
    out = verdicts.join(_by_id(micro, "__i"), key == F.col("__i_id"), "left").join(_by_id(macro, "__a"), key == F.col("__a_id"), "left")
    i, a, absent = F.col("__i_id").isNotNull(), F.col("__a_id").isNotNull(), F.col("status") == "NO_BLOGGER"
    kind = F.when(i & a, "both").when(i, "micro").when(a, "macro").otherwise("none")
    out = out.withColumn("membership", F.when(absent, kind)).withColumn("roster_name", F.when(absent, F.coalesce("__i_name", "__a_name")))
    out = out.withColumn("perimeter", F.when(absent, F.coalesce("__i_row", "__a_row")))
    split = F.when(i | a, "NO_POST_IN_PERIMETER").otherwise("NO_BLOGGER_NOT_IN_PERIMETER")
    return out.withColumn("status", F.when(absent, split).otherwise(F.col("status"))).drop("__i_id", "__i_name", "__i_row", "__a_id", "__a_name", "__a_row")


def membership_text(c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in MEMBERSHIP.items() for x in pair]), c)


def name_evidence(verdicts: DataFrame, roster: DataFrame, label: str = "", ascii_only: bool = False, fuzzy: bool = True, lexicon: DataFrame | None = None) -> DataFrame:
    """(excel_row, hits, note, lines, perimeter) for rows that a roster may hold under another id, and for dead links.

    Chinese forms are tested against namebis only, normal forms against both names. One hit names a near miss or an
    unregistered entry and fills perimeter, several are listed (at most eight lines in roster order), as are those of dead links. The status never changes.
    """
    wanted = verdicts.where(F.col("status").isin("NO_BLOGGER_NOT_IN_PERIMETER", "LINK_ERROR"))
    t = forms.add_forms(wanted, "name", "__", ascii_only)
    key = F.col("__norm")
    left = t.select(key.alias("l_id"), F.col("__norm").alias("norm"), F.col("__cjk").alias("cjk"), F.col("__ascii").alias("ascii")).distinct()
    if lexicon is not None:
        left = forms.transliterate(left, "cjk", lexicon, "pinyin")
    left = settled(left)
    names = forms.add_forms(roster, "name", "n_", ascii_only)
    if "namebis" in roster.columns:
        names = forms.add_forms(names, "namebis", "b_", ascii_only)
        second = names.select(F.col("roster_row").alias("r_id"), F.col("b_norm").alias("norm"), F.col("b_cjk").alias("cjk"), F.col("b_ascii").alias("ascii"))
    else:
        second = None
    first = names.select(F.col("roster_row").alias("r_id"), F.col("n_norm").alias("norm"), F.lit("").alias("cjk"), F.col("n_ascii").alias("ascii"))
    hits = name_hits(left, first, fuzzy=fuzzy)
    if second is not None:
        hits = hits.union(name_hits(left, second, fuzzy=fuzzy))
    order = F.array_position(F.array(F.lit("cjk-substring"), F.lit("norm-substring"), F.lit("ascii-fuzzy"), F.lit("pinyin-bridge")), F.col("method"))
    best = hits.groupBy("l_id", "r_id").agg(F.min_by("method", order).alias("method"))
    given, second_name = F.coalesce("redbook_id", F.lit("")), F.col("namebis") if "namebis" in roster.columns else F.lit("")
    # Fixed value: the form of an evidence line.
    line = F.concat(F.lit(f"{label}: " if label else ""), F.coalesce(F.nullif("name", F.lit("")), second_name, F.lit("")), F.lit(" ["), F.when(given == "", "no REDBOOK_ID").otherwise(given), F.lit("] ("), F.col("method"), F.lit(")"))
    found = best.join(roster.withColumnRenamed("roster_row", "r_id"), "r_id")
    found = found.select("l_id", "r_id", line.alias("line"), _shown(found, F.col("method")).alias("row"))
    # Counted and listed once for each distinct name, then joined to its rows: a list is cut by a window, never collected whole.
    counts = found.groupBy("l_id").agg(F.count("*").alias("hits"), F.min("row").alias("row"))
    top = found.withColumn("place", F.row_number().over(W.partitionBy("l_id").orderBy("r_id"))).where(F.col("place") <= LISTED)
    lines = top.groupBy("l_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]).alias("lines"))
    per = t.select("excel_row", "status", key.alias("l_id")).join(counts.join(lines, "l_id"), "l_id")
    dead, several = F.col("status") == "LINK_ERROR", F.col("hits") > 1
    note = F.when(dead, "dead-link").when(several, "several").when(F.coalesce("row.redbook_id", F.lit("")) == "", "unregistered").otherwise("near-miss")
    listed = F.when(dead | several, F.col("lines")).otherwise(F.array().cast("array<string>"))
    return per.select("excel_row", "hits", note.alias("note"), listed.alias("lines"), F.when(~dead & ~several, F.col("row")).alias("perimeter"))


def evidence(members: DataFrame, micro: DataFrame | None, macro: DataFrame | None, ascii_only: bool = False, fuzzy: bool = True, lexicon: DataFrame | None = None) -> DataFrame:
    """(excel_row, note, notes, lines, perimeter) of both rosters for the result of membership(); either may be None.

    The micro list comes first: its note is the row's, its one hit fills perimeter before the macro list's, its lines stand
    before those of the macro list, which carry its name. Rows whose id a roster holds keep the deciding roster row.
    """
    parts = [name_evidence(members, r, label, ascii_only, fuzzy, lexicon).withColumn("list", F.lit(n)) for n, (r, label) in enumerate(((micro, ""), (macro, "Macro"))) if r is not None]
    decided = members.where("perimeter is not null").select("excel_row", F.lit(None).cast("string").alias("note"), F.array().cast("array<string>").alias("notes"), F.array().cast("array<string>").alias("lines"), "perimeter")
    if not parts:
        return decided
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # At most one row of each list.
    per = both.groupBy("excel_row").agg(F.array_sort(F.collect_list(F.struct("list", "note", "lines", "perimeter"))).alias("l"))
    first = F.get(F.filter("l", lambda x: x["perimeter"].isNotNull()), F.lit(0))["perimeter"]
    named = per.select("excel_row", F.get("l", F.lit(0))["note"].alias("note"), F.col("l.note").alias("notes"), F.flatten("l.lines").alias("lines"), first.alias("perimeter"))
    return named.unionByName(decided)


def roster_stats(roster: DataFrame) -> DataFrame:
    has = F.coalesce(F.trim("redbook_id"), F.lit("")) != ""
    return roster.agg(F.count("*").alias("rows"), F.count_if(has).alias("with_id"), F.count_distinct(F.when(has, F.lower(F.trim("redbook_id")))).alias("ids"))


def current_roster(settings: DataFrame, manifest: DataFrame) -> DataFrame:
    """The latest promoted roster of each kind; stale if its content is missing. settings: kind, hash, promoted_at; manifest: hash, version."""
    latest = settings.groupBy("kind").agg(F.max_by("hash", F.struct("promoted_at", "hash")).alias("hash"))
    known = manifest.select("hash", F.col("version")).dropDuplicates(["hash"])
    return latest.join(known, "hash", "left").select("kind", "hash", "version", F.col("version").isNull().alias("stale"))


def roster_available(runs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Runs whose recorded roster is not in the manifest."""
    return runs.where("roster_hash <> ''").join(manifest.select(F.col("hash").alias("roster_hash")), "roster_hash", "left_anti")
