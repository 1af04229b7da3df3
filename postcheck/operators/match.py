"""Reconciliation of a tracker with an export: exact ids decide, names only rank candidates.

Joins are on ids. The name scan never compares all pairs: names are reduced to distinct forms, and a name can contain
another only if that is one of its pieces, so the pieces are the join keys (of names longer than twelve characters the rarest piece of twelve). Fuzzy rungs meet in blocks, where only pairs that
share a piece and enough bigrams are compared (both forms have four characters or more).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shared import settled
from ..functions.similarity import close_rows
from ..functions.urls import normalize_url

#: Annotation texts by status.
TEXT = {
    "MATCH": "",
    "NO_BLOGGER": "无博主",
    "NO_POST": "无帖子",
    "LINK_ERROR": "Check链接错误",
    "REVIEW": "人工复核",
    "NO_POST_IN_PERIMETER": "无博主（博主在Perimeter内）",
    "NO_BLOGGER_NOT_IN_PERIMETER": "无博主（不在Perimeter内）",
}
MISLABEL = "有 但是DMR博主名字标注错误"
OUTSIDE = "（超出DMR导出窗口，预期缺失）"
FUZZY_LEAST, FUZZY_CUTOFF = 4, 85.0
#: Names of up to so many characters are joined whole, and texts of up to so many are cut without splitting them.
WHOLE, SPLIT = 12, 256
#: Forms of a block of the fuzzy rungs, and blocks of a side at least, unless they had less than 1024 forms.
BLOCK, FEWEST = 8192, 8
#: Characters of a passage anchor, and what the code point of its first one is a multiple of.
GRAM, EVERY = 12, 8


def first_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row of each key in row order; empty and null keys are dropped."""
    for k in keys:
        df = df.where(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
    return df.withColumn("__k", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("__k = 1").drop("__k")


def _grams(c: Column) -> Column:
    """Distinct bigrams; the characters are split once, so a long text costs in proportion."""
    pairs = lambda x: F.transform(F.sequence(F.lit(0), F.size(x) - 2), lambda i: F.concat(F.get(x, i), F.get(x, i + 1)))
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    return F.array_distinct(F.get(F.transform(F.array(chars), pairs), F.lit(0)))


def _close_pairs(left: DataFrame, right: DataFrame, cutoff: float, same: bool = False) -> DataFrame:
    """(l_id, r_id) of forms lf and rf whose partial ratio reaches the cutoff; same: both sides hold the same ids and forms.

    Short forms share bigrams with a fixed share of all others, so a join on them meets most pairs one row at a time. Blocks of forms meet
    pairwise instead, and inside two blocks only forms that share a piece are compared (close_rows). The pieces met grow with the pairs, memory with
    the block; ids and forms move once for each block of the other side, half as often if both sides are the same.
    """
    left = settled(left)
    right = left.select(F.col("l_id").alias("r_id"), F.col("lf").alias("rf")) if same else settled(right)

    def blocks(df: DataFrame, side: str) -> tuple[DataFrame, int]:
        rows = df.count()
        count = max(1, -(-rows // BLOCK), min(FEWEST, -(-rows // 1024)))
        block = F.pmod(F.xxhash64(f"{side}_id"), F.lit(count))
        return df.groupBy(block.alias(f"{side}_block")).agg(F.collect_list(f"{side}_id").alias(f"{side}_ids"), F.collect_list(f"{side}f").alias(f"{side}fs")), count

    (l, n), (r, m) = blocks(left, "l"), blocks(right, "r")
    met = l.crossJoin(r).where(F.col("l_block") <= F.col("r_block") if same else F.lit(True))
    twice = F.col("l_block") < F.col("r_block") if same else F.lit(False)
    return close_rows(met.select("l_ids", "lfs", "r_ids", "rfs", twice.alias("twice")).repartition(n * m), cutoff)


def _pieces(c: Column, sizes: Sequence[int]) -> Column:
    """Distinct pieces of the given sizes; characters outside the basic plane count as one."""
    wide = F.regexp_extract_all(c, F.lit("(?s)(.)"), F.lit(1))  # a split would tear the characters beyond the basic plane
    chars = F.when(c.rlike(r"[\x{10000}-\x{10ffff}]"), wide).otherwise(F.filter(F.split(c, ""), lambda x: x != ""))
    places = lambda length, n: F.sequence(F.lit(1), length - n + 1)
    none = F.array().cast("array<string>")
    every = lambda length, cut: F.flatten(F.array(*[F.when(length >= n, cut(n)).otherwise(none) for n in sizes]))
    length = F.char_length(c)
    # A substring is looked for from the text's start, so the characters of long texts are split once instead.
    near = every(length, lambda n: F.transform(places(length, n), lambda i: F.substring(c, i, F.lit(n))))
    far = F.get(F.transform(F.array(chars), lambda x: every(F.size(x), lambda n: F.transform(places(F.size(x), n), lambda i: F.array_join(F.slice(x, i, n), "")))), F.lit(0))
    return F.array_distinct(F.when(length <= SPLIT, near).otherwise(far))


def _ends(c: Column) -> list[Column]:
    """For the first and the last character of c, a long with one of 64 bits set."""
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(x) % 64) for x in (c, F.substring(c, -1, 1))]


def _contained(left: DataFrame, right: DataFrame, form: str) -> DataFrame:
    """(l_id, r_id) where the left form is inside the right one; both are distinct forms.

    A left form of up to WHOLE characters is joined as it is with the right forms' pieces of the lengths that occur on the left, so each
    joined row is a hit and the work grows with the names, however many there are. Pieces that end in characters which no left form of
    their length ends in do not move. A longer form is joined by its rarest piece of WHOLE characters and then compared.
    """
    ls, rs = left.where(F.col(form) != "").select("l_id", F.col(form).alias("lf")), right.where(F.col(form) != "").select("r_id", F.col(form).alias("rf"))
    # At most WHOLE + 1 rows reach the driver.
    ends = ls.groupBy(F.least(F.char_length("lf"), F.lit(WHOLE + 1)).alias("n")).agg(*[F.bit_or(x).alias(k) for k, x in zip(("first", "last"), _ends(F.col("lf")))])
    ends = {r["n"]: (r["first"], r["last"]) for r in ends.collect()}
    sizes = sorted(ends)
    whole, longer = [n for n in sizes if n <= WHOLE], any(n > WHOLE for n in sizes)
    found = ls.where(F.lit(False)).select("l_id").crossJoin(rs.select("r_id"))
    if whole:
        short = ls.where(F.char_length("lf") <= WHOLE).withColumnRenamed("lf", "g")
        fits = F.lit(False)
        for n in whole:
            fits = F.when(F.char_length("g") == n, (_ends(F.col("g"))[0].bitwiseAND(F.lit(ends[n][0])) != 0) & (_ends(F.col("g"))[1].bitwiseAND(F.lit(ends[n][1])) != 0)).otherwise(fits)
        found = short.join(rs.select("r_id", F.explode(_pieces(F.col("rf"), whole)).alias("g")).where(fits), "g").select("l_id", "r_id")
    if longer:
        long = ls.where(F.char_length("lf") > WHOLE)
        lg = long.select("l_id", F.explode(_pieces(F.col("lf"), [WHOLE])).alias("g"))
        rg = rs.select("r_id", F.explode(_pieces(F.col("rf"), [WHOLE])).alias("g")).join(lg.select("g").distinct(), "g", "left_semi")
        counts = rg.groupBy("g").agg(F.count("*").alias("df"))
        rarest = lg.join(counts, "g", "left").groupBy("l_id").agg(F.min_by("g", F.struct(F.coalesce("df", F.lit(0)), "g")).alias("g"))
        compared = rarest.join(rg, "g").join(long, "l_id").join(rs, "r_id").where(F.contains("rf", F.col("lf"))).select("l_id", "r_id")
        found = found.union(compared) if whole else compared
    return found


def _contained_in_long(left: DataFrame, right: DataFrame, form: str) -> DataFrame:
    """(l_id, r_id) where the left form is inside the right one; both are distinct forms. Blocked by the left form's rarest bigram, of which a long text has few distinct ones."""
    ls, rs = left.where(F.col(form) != "").select("l_id", F.col(form).alias("lf")), right.where(F.col(form) != "").select("r_id", F.col(form).alias("rf"))
    rg = rs.where(F.char_length("rf") >= 2).select("r_id", F.explode(_grams(F.col("rf"))).alias("g"))
    counts = rg.groupBy("g").agg(F.count("*").alias("df"))
    lg = ls.where(F.char_length("lf") >= 2).select("l_id", "lf", F.explode(_grams(F.col("lf"))).alias("g")).join(counts, "g", "left")
    rarest = lg.groupBy("l_id", "lf").agg(F.min_by("g", F.struct(F.coalesce("df", F.lit(0)), "g")).alias("g"))
    long = rarest.join(rg, "g").join(rs, "r_id").where(F.contains("rf", F.col("lf"))).select("l_id", "r_id")
    one = ls.where(F.char_length("lf") == 1).join(rs.select("r_id", "rf", F.explode(F.array_distinct(F.split("rf", ""))).alias("lf")), "lf").select("l_id", "r_id")
    return long.union(one)


def _anchors(c: Column) -> Column:
    """Hashes of the GRAM-grams whose first character's code point is a multiple of EVERY: a text inside another has its anchors among the other's."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    places = lambda x: F.filter(F.sequence(F.lit(1), F.size(x) - GRAM + 1), lambda i: F.ascii(F.get(x, i - 1)) % EVERY == 0)
    hashes = lambda x: F.transform(places(x), lambda i: F.xxhash64(F.array_join(F.slice(x, i, GRAM), "")))
    return F.array_distinct(F.get(F.transform(F.array(chars), hashes), F.lit(0)))


def contained_passages(left: DataFrame, right: DataFrame, form: str) -> DataFrame:
    """(l_id, r_id) where the left form, a passage, is inside the right one, a long text.

    Blocked by the passage's rarest anchor; postings hold ids and hashes, texts are joined to the survivors only.
    Passages without an anchor go through their rarest bigram: a long text has few distinct ones.
    """
    ls, rs = left.where(F.col(form) != "").select("l_id", F.col(form).alias("lf")), right.where(F.col(form) != "").select("r_id", F.col(form).alias("rf"))
    posted = lambda df, key, c: df.where(F.char_length(c) >= GRAM).select(key, F.explode(_anchors(F.col(c))).alias("g"))
    la = posted(ls, "l_id", "lf")
    ra = posted(rs, "r_id", "rf").join(la.select("g").distinct(), "g", "left_semi")
    counts = ra.groupBy("g").agg(F.count("*").alias("df"))
    rarest = la.join(counts, "g", "left").groupBy("l_id").agg(F.min_by("g", F.struct(F.coalesce("df", F.lit(0)), "g")).alias("g"))
    found = rarest.join(ra, "g").join(ls, "l_id").join(rs, "r_id").where(F.contains("rf", F.col("lf"))).select("l_id", "r_id")
    rest = left.join(la.select("l_id").distinct(), "l_id", "left_anti").where(F.col(form) != "")
    return found if rest.isEmpty() else found.union(_contained_in_long(rest, right, form))


def name_hits(left: DataFrame, right: DataFrame, cutoff: float = FUZZY_CUTOFF, least: int = FUZZY_LEAST, fuzzy: bool = True, same: bool = False) -> DataFrame:
    """(l_id, r_id, method) for all pairs that a rung of the ladder links, the first rung of each.

    left and right have l_id / r_id and the forms norm, cjk, ascii (left also pinyin, if it has any). Rungs: cjk, norm,
    ascii-fuzzy, pinyin-bridge. Fuzzy blocking is lossless for cutoff 85 with four characters or more. same: both sides hold the same names.
    """
    if fuzzy and (cutoff < 85 or least < 4):
        raise ValueError("bigram blocking is lossless only from cutoff 85 and four characters on")
    rungs = [_contained(left, right, "cjk").withColumn("rung", F.lit(1)), _contained(left, right, "norm").withColumn("rung", F.lit(2))]
    found = rungs[0].union(rungs[1])
    best = found.groupBy("l_id", "r_id").agg(F.min("rung").alias("rung"))
    if fuzzy:
        for rung, form in ((3, "ascii"), (4, "pinyin")):
            if form not in left.columns:
                continue
            forms = [df.where(F.char_length(f) >= least).select(key, F.col(f).alias(out)) for df, key, f, out in ((left, "l_id", form, "lf"), (right, "r_id", "ascii", "rf"))]
            close = _close_pairs(*forms, cutoff, same and form == "ascii").join(best.select("l_id", "r_id"), ["l_id", "r_id"], "left_anti").withColumn("rung", F.lit(rung))
            best = best.union(close)
    method = F.element_at(F.array(F.lit("cjk-substring"), F.lit("norm-substring"), F.lit("ascii-fuzzy"), F.lit("pinyin-bridge")), F.col("rung"))
    return best.select("l_id", "r_id", method.alias("method"))


def sibling_authors(rows: DataFrame) -> DataFrame:
    """(nkey, sibling): names whose rows' own author, or the username of their exact match, is one id throughout. rows: nkey, author_id, matched_username."""
    ids = rows.select("nkey", F.explode(F.array("author_id", "matched_username")).alias("id")).where("id is not null and id <> ''")
    return ids.groupBy("nkey").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low = high").select("nkey", F.col("low").alias("sibling"))


def attach(tracker: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Append note_id, author_id and ok by the normalised post link; of several resolutions a good one, else the newest (resolved_at, where there is one) counts."""
    newest = F.desc("resolved_at") if "resolved_at" in resolutions.columns else F.lit(0)
    place = F.row_number().over(W.partitionBy("__url").orderBy(F.coalesce(F.col("status") != "ok", F.lit(True)), newest, "note_id", "author_id"))
    one = resolutions.withColumn("__url", normalize_url(F.col("url"))).withColumn("__place", place).where("__place = 1")
    joined = tracker.join(one.select("__url", "status", "note_id", "author_id"), normalize_url(F.col("post_link")) == F.col("__url"), "left")
    ok = F.coalesce((F.col("status") == "ok") & (F.col("note_id") != ""), F.lit(False))
    return joined.select(*[f"`{c}`" for c in tracker.columns], F.coalesce("note_id", F.lit("")).alias("note_id"), F.coalesce("author_id", F.lit("")).alias("author_id"), ok.alias("ok"))


#: The export's engagement figures that a matched row shows; figures the export lacks are null.
ENGAGEMENT = ("likes_retweet", "share_favorites", "comments", "engagement", "weighted_eng")
#: Candidates that a verdict lists, the nearest ones, and parts in which a row's are ranked before they meet.
KEEP, SALT = 100, 16
#: What a row shows of the post that its link is; null in open rows.
MATCHED = ("m_post", "m_user", "m_blogger", "m_row", "m_date", "m_figures")


def _near(need: DataFrame, posted: DataFrame, key: str, days: int) -> DataFrame:
    """Rows of need (t_date) with the rows of posted (x_date) of the same key within days of each other; an unknown date is near to all.

    Dates meet in bands of four such widths, each post in its own and each row, which is narrower, in the one or two that it reaches, so a frequent
    key is spread over its days. Both are tables that were written, so rows without a date are looked for first, and joined only where there are any.
    """
    day, width = lambda c: F.unix_date(F.col(c).cast("date")), 4 * max(days, 1)
    band = lambda d: F.floor(d / width)
    left = need.where("t_date is not null").withColumn("band", F.explode(F.sequence(band(day("t_date") - days), band(day("t_date") + days))))
    right = posted.where("x_date is not null").withColumn("band", band(day("x_date")))
    found = left.join(right, [key, "band"]).where(F.abs(day("x_date") - day("t_date")) <= days).drop("band")
    undated, some = posted.where("x_date is null"), need.where("t_date is null")
    if not undated.isEmpty():
        found = found.unionByName(need.join(undated, key))
    if not some.isEmpty():
        found = found.unionByName(some.join(posted.where("x_date is not null"), key))
    return found


def _evidence(u: DataFrame, e: DataFrame, export: DataFrame, hits: DataFrame, siblings: DataFrame, days: int) -> tuple[DataFrame, DataFrame]:
    """(the open rows of u with what siblings and the name scan say of each, candidates of all rows). e has r_id, hits (l_id, r_id, method, strong).

    What a row needs to know follows from its name, its author and whether its link is good, so it is settled for the distinct ones, which
    are few and narrow, and joined to the rows once. Of a name's posts that is a count and the least and greatest username, so rows and posts of
    a name meet only where they are near in time, and for conflicts that the window leaves without evidence.
    """
    shown = ["post_id", "blogger", "username"]
    post = lambda df: df.select(*df.columns[: df.columns.index("excel_row")], F.col("excel_row").alias("x_row"), *shown, F.col("post_date").alias("x_date"))
    posted = settled(hits.join(post(e.select("r_id", "excel_row", *shown, "post_date")), "r_id").drop("r_id"))
    named = F.when(F.col("strong"), F.nullif("username", F.lit("")))
    names = posted.groupBy("l_id").agg(F.count("*").alias("hits"), F.max("strong").alias("any_strong"), F.min(named).alias("u_low"), F.max(named).alias("u_high"))
    own = posted.where("username <> ''").select("l_id", F.col("username").alias("author"), F.lit(True).alias("own_hit")).distinct()

    open_rows, key = u.where("m_post is null").drop(*MATCHED), ["l_id", "author_id", "ok"]
    open_rows = open_rows.withColumnRenamed("__norm", "l_id")
    who = open_rows.select(*key).distinct().join(siblings.withColumnRenamed("nkey", "l_id"), "l_id", "left").join(names, "l_id", "left")
    mine = F.nullif(F.col("author_id"), F.lit(""))
    who = who.withColumn("via_sibling", F.col("ok") & mine.isNull() & F.col("sibling").isNotNull()).withColumn("author", F.when(F.col("via_sibling"), F.col("sibling")).otherwise(mine)).drop("sibling")
    authors = export.where("username is not null and username <> ''").select(F.col("username").alias("a_user")).distinct()
    who = who.join(authors, F.col("author") == F.col("a_user"), "left").join(own, ["l_id", "author"], "left")
    known = export.agg(F.coalesce(F.max(F.coalesce(F.col("username") != "", F.lit(False))), F.lit(False)).alias("has_users"))
    who = who.crossJoin(F.broadcast(known))  # one row
    foreign = F.coalesce((F.col("u_low") != F.col("author")) | (F.col("u_high") != F.col("author")), F.lit(False))
    who = who.select(*key, "via_sibling", "author", "a_user", "has_users", "hits", F.coalesce("any_strong", F.lit(False)).alias("any_strong"), (foreign & F.col("own_hit").isNull()).alias("conflict"))
    t = settled(open_rows.join(who, key))

    absent = F.col("ok") & F.col("author").isNotNull() & F.col("has_users") & F.col("a_user").isNull()
    rows = lambda df, key: df.select("excel_row", F.col("post_date").alias("t_date"), key, absent.alias("absent"))
    near = settled(_near(rows(t.where("hits is not null"), "l_id"), posted, "l_id", days).where(~F.col("absent") | F.col("strong")).drop("l_id", "strong"))
    # Conflicts without a post in the window show all of the name's.
    bare = settled(rows(t.where(absent & F.col("any_strong")), "l_id"))
    bare = bare.join(near.where("absent").select("excel_row").distinct(), "excel_row", "left_anti").join(posted.where("strong"), "l_id").drop("l_id", "strong")
    # Posts of the author stand in where no name hit exists at all; written, so that a few rows are known to be few before the export moves.
    lone = settled(rows(t.where("ok and a_user is not null and hits is null"), "author"))
    theirs = post(export.select(F.col("username").alias("author"), F.lit("same-author").alias("method"), "excel_row", *shown, "post_date"))
    found = near.unionByName(bare).unionByName(_near(lone, theirs, "author", days).drop("author"))
    return t, found.select("excel_row", "x_row", *shown, F.date_diff(F.col("x_date").cast("date"), "t_date").alias("delta"), "method")


def _by_nearness(*keys: str) -> Column:
    """The place among the candidates of keys: by known date first, nearest date, export row."""
    return F.row_number().over(W.partitionBy(*keys).orderBy(F.col("delta").isNull(), F.abs(F.coalesce("delta", F.lit(0))), "x_row"))


def _prepared(tracker: DataFrame, export: DataFrame, resolutions: DataFrame, days: int, ascii_only: bool, fuzzy: bool, lexicon: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tracker's matched rows, its open ones with authors and what the name scan says, and the candidates of all rows.

    A matched row needs nothing of the scan, so it moves for the joins of its link and its post only.
    """
    from ..functions import forms

    e = settled(forms.add_forms(export, "blogger", "__", ascii_only).drop("__ascii"))
    export = e.select(*[f"`{c}`" for c in export.columns])
    posts = first_per_key(e, ["post_id"], "excel_row").select(
        F.col("post_id").alias("m_post"), F.col("username").alias("m_user"), F.col("blogger").alias("m_blogger"), F.col("excel_row").alias("m_row"),
        F.col("post_date").alias("m_date"), F.col("__norm").alias("m_norm"), F.col("__cjk").alias("m_cjk"),
        F.struct(*[(F.col(c) if c in e.columns else F.lit(None).cast("double")).alias(c) for c in ENGAGEMENT]).alias("m_figures"))
    # Rows without a note are dealt by their link: they meet no post, and one key for all of them would fill one task.
    note = F.when(F.col("ok"), F.col("note_id")).otherwise(F.concat(F.lit("\0"), F.coalesce("post_link", F.lit(""))))
    t = attach(tracker, resolutions).join(posts, F.col("ok") & (note == F.col("m_post")), "left")
    t = forms.add_forms(t, "name", "__", ascii_only).drop("__ascii")
    contains = forms.name_contains(F.col("__norm"), F.col("__cjk"), F.col("m_norm"), F.col("m_cjk"))
    u = settled(t.withColumn("mislabel", F.col("m_post").isNotNull() & ~contains).drop("m_norm", "m_cjk"))
    siblings = sibling_authors(u.select(F.col("__norm").alias("nkey"), F.when(F.col("ok"), F.col("author_id")).alias("author_id"), F.col("m_user").alias("matched_username")))

    # The scan: distinct names of rows that need candidates against distinct blogger names. A name's other forms follow from its norm, which is its id.
    names = lambda df, id: settled(df.select(F.col("__norm").alias("norm"), F.col("__cjk").alias("cjk")).distinct().select(F.col("norm").alias(id), "norm", "cjk", forms.ascii_part(F.col("norm")).alias("ascii")))
    left, right = names(u.where("m_post is null"), "l_id"), names(e, "r_id")
    lengths = left.select("l_id", F.char_length("cjk").alias("nc"), F.char_length("norm").alias("nn"))
    if lexicon is not None:
        left = forms.transliterate(left, "cjk", lexicon, "pinyin")
    strong = ((F.col("method") == "cjk-substring") & (F.col("nc") >= 2)) | ((F.col("method") == "norm-substring") & (F.col("nn") >= 4))
    hits = name_hits(left, right, fuzzy=fuzzy).join(lengths, "l_id").select("l_id", "r_id", "method", strong.alias("strong"))
    opened, found = _evidence(u, e.withColumn("r_id", F.col("__norm")), export, hits, siblings, days)
    matched = u.where("m_post is not null").withColumn("author", F.nullif(F.col("author_id"), F.lit("")))
    return matched, opened, found


def candidates(tracker: DataFrame, export: DataFrame, resolutions: DataFrame, days: int = 7, ascii_only: bool = False, fuzzy: bool = True, lexicon: DataFrame | None = None) -> DataFrame:
    """All candidates of all tracker rows, one a row: excel_row, place (from 1), post_id, blogger, username, delta, method, nearest date first."""
    *_, found = _prepared(tracker, export, resolutions, days, ascii_only, fuzzy, lexicon)
    return found.select("excel_row", _by_nearness("excel_row").alias("place"), "post_id", "blogger", "username", "delta", "method")


def reconcile(tracker: DataFrame, export: DataFrame, resolutions: DataFrame, window: tuple | None = None, days: int = 7, ascii_only: bool = False, fuzzy: bool = True, lexicon: DataFrame | None = None, keep: int = KEEP) -> DataFrame:
    """One verdict for each tracker row. A lexicon (char, syllable) adds the rung that reads Chinese names aloud.

    tracker: excel_row, campaign, no, name, post_date, post_link; export: excel_row, post_id, username, blogger, post_date.
    Result: the tracker's columns, note_id, author_id, status, tier, matched (post with its engagement), name_mislabel, out_of_window,
    review_reason, n_candidates and candidates (post_id, blogger, username, delta, method), nearest date first: the
    first `keep` of them, so that a row stays bounded; candidates() has them all.
    """
    done, t, found = _prepared(tracker, export, resolutions, days, ascii_only, fuzzy, lexicon)
    found = settled(found)
    parts = found.withColumn("salt", F.pmod(F.xxhash64("x_row"), F.lit(SALT)))
    some = parts.withColumn("place", _by_nearness("excel_row", "salt")).where(F.col("place") <= keep).withColumn("place", _by_nearness("excel_row")).where(F.col("place") <= keep)
    value = F.struct("post_id", "blogger", "username", "delta", "method")
    listed = some.groupBy("excel_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", value.alias("value")))), lambda c: c["value"]).alias("candidates"))
    listed = listed.join(found.groupBy("excel_row").agg(F.count("*").alias("n_candidates")), "excel_row").withColumnRenamed("excel_row", "s_row")
    t = t.join(listed, F.col("excel_row") == F.col("s_row"), "left").unionByName(done, allowMissingColumns=True)

    matched, has = F.col("m_post").isNotNull(), F.col("author").isNotNull()
    in_export, ok = F.col("a_user").isNotNull(), F.col("ok")
    by_id = F.when(F.col("via_sibling"), "2:author-id-sibling").otherwise("2:author-id")
    cases = [
        (matched, "MATCH", F.lit("1:note-id-join"), ""),
        (ok & has & ~F.col("has_users"), "REVIEW", F.lit("2:no-username-column"), "no-username"),
        (ok & in_export & F.col("conflict"), "REVIEW", F.lit("2:author-id+name-conflict"), "foreign-name"),
        (ok & in_export, "NO_POST", by_id, ""),
        (ok & has & F.col("any_strong"), "REVIEW", F.lit("2:author-id+name-conflict"), "same-name"),
        (ok & has, "NO_BLOGGER", by_id, ""),
        (ok, "REVIEW", F.lit("1:resolved-no-author"), "no-author"),
    ]
    status, tier, reason = F.lit("LINK_ERROR"), F.lit("3:name-heuristic"), F.lit("")
    for test, s, r, why in reversed(cases):
        status, tier, reason = F.when(test, s).otherwise(status), F.when(test, r).otherwise(tier), F.when(test, why).otherwise(reason)
    nothing = F.array().cast(listed.schema["candidates"].dataType)
    lo, hi = (F.lit(None).cast("date"), F.lit(None).cast("date")) if window is None else (F.lit(window[0]).cast("date"), F.lit(window[1]).cast("date"))
    outside = F.coalesce(~F.col("post_date").between(lo, hi), F.lit(False))
    return t.select(
        *[f"`{n}`" for n in tracker.columns], "note_id", F.coalesce("author", F.lit("")).alias("author_id"), status.alias("status"), tier.alias("tier"), reason.alias("review_reason"),
        F.when(matched, F.struct("m_row", "m_post", "m_blogger", "m_user", "m_date", F.date_diff(F.col("m_date").cast("date"), "post_date").alias("delta"), *[F.col(f"m_figures.{c}").alias(c) for c in ENGAGEMENT])).alias("matched"),
        F.col("mislabel").alias("name_mislabel"), outside.alias("out_of_window"), F.coalesce("candidates", nothing).alias("candidates"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
    )


def annotation(df: DataFrame) -> Column:
    """The annotation text of a verdict."""
    status = F.col("status")
    base = F.element_at(F.create_map(*[F.lit(x) for pair in TEXT.items() for x in pair]), status)
    first = F.get("candidates", F.lit(0))
    delta = F.when(first["delta"].isNotNull(), F.concat(F.lit("Δ="), first["delta"].cast("string"), F.lit("天"))).otherwise("日期未知")
    absent = status.isin("NO_POST", "NO_BLOGGER", "NO_POST_IN_PERIMETER", "NO_BLOGGER_NOT_IN_PERIMETER")
    return (
        F.when(status == "MATCH", F.when(F.col("name_mislabel"), MISLABEL).otherwise(""))
        .when(absent & F.col("out_of_window"), F.concat(base, F.lit(OUTSIDE)))
        .when((status == "LINK_ERROR") & (F.size("candidates") > 0), F.concat(base, F.lit("（同名候选: "), first["blogger"], F.lit(" "), first["post_id"], F.lit(" "), delta, F.lit("）")))
        .when(status == "LINK_ERROR", F.concat(base, F.lit("（无同名候选）")))
        .when((status == "REVIEW") & (F.col("review_reason") != ""), F.concat(base, F.lit("（"), F.col("review_reason"), F.lit("）")))
        .otherwise(base)
    )


def window_override(window: tuple, lower: str | None, upper: str | None) -> tuple:
    """If one of the bounds reads as a date, both replace the window; a cleared side turns the check off."""
    import datetime

    def day(s: str | None):
        try:
            return datetime.date.fromisoformat((s or "").strip())
        except ValueError:
            return None

    new = (day(lower), day(upper))
    return new if any(new) else window


def tracker_profile(tracker: DataFrame) -> DataFrame:
    """Campaigns in first-seen order with rows and dates."""
    return tracker.groupBy("campaign").agg(F.min("excel_row").alias("first_row"), F.count("*").alias("rows"), F.min("post_date").alias("from_date"), F.max("post_date").alias("to_date"))


def status_counts(verdicts: DataFrame) -> DataFrame:
    counts = verdicts.groupBy("status").agg(F.count("*").alias("n"))
    wrong = verdicts.where("name_mislabel").agg(F.lit("MATCH_name_mislabel").alias("status"), F.count("*").alias("n")).where("n > 0")
    return counts.union(wrong)


def buckets(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(F.count_if(F.col("status").isin("NO_POST", "NO_POST_IN_PERIMETER")).alias("gaps"), F.count_if(F.col("status") == "NO_BLOGGER_NOT_IN_PERIMETER").alias("outside"))


def reverse_audit(verdicts: DataFrame, export: DataFrame) -> DataFrame:
    """Export rows of resolved authors that no tracker row matched, within a day of the tracker's dates; rows without a date stay. By blogger and date, undated first."""
    authors = verdicts.where("author_id <> ''").select(F.col("author_id").alias("__a")).distinct()
    matched = verdicts.where("matched is not null").select(F.col("matched.m_post").alias("__p")).distinct()
    bounds = verdicts.agg(F.date_sub(F.min("post_date"), 1).alias("__lo"), F.date_add(F.max("post_date"), 1).alias("__hi"))
    inside = F.coalesce(F.col("post_date").cast("date").between(F.col("__lo"), F.col("__hi")), F.lit(True))
    # Matched posts go first: they are most of an export, so that few rows are left to meet the authors.
    rows = export.where("username <> ''").join(matched, F.col("post_id") == F.col("__p"), "left_anti").join(authors, F.col("username") == F.col("__a"), "left_semi")
    return rows.crossJoin(F.broadcast(bounds)).where(inside).select(*[f"`{c}`" for c in export.columns]).orderBy("blogger", F.asc_nulls_first("post_date"))
