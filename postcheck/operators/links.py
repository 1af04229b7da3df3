"""Link resolutions as tables: cache freshness, work lists, payload fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import payload
from ..functions.coerce import epoch_text, magnitude_int
from ..functions.forms import is_hex24
from ..functions.urls import post_id_from_url


def resolve_canonical(df: DataFrame, url: str, roots: Sequence[str]) -> DataFrame:
    """Resolutions that the URL itself gives: url, status, note_id."""
    note = post_id_from_url(F.col(url), roots)
    return df.select(F.col(url).alias("url"), note.alias("note_id")).where("note_id is not null").select("url", F.lit("ok").alias("status"), "note_id")


def fresh_resolutions(cache: DataFrame, as_of: float, ttl_hours: float = 24, retry: bool = False) -> DataFrame:
    """Rows that may be used again: good ones always, failures for a while unless they are retried."""
    young = (F.col("resolved_at") > as_of - ttl_hours * 3600) & F.lit(not retry)
    return cache.where((F.col("status") == "ok") | F.coalesce(young, F.lit(False)))


def needs_author(resolved: DataFrame, export: DataFrame) -> DataFrame:
    """Resolved rows without an author whose post the export lacks."""
    open_rows = resolved.where("ok and author_id = ''")
    return open_rows.join(export.select(F.col("post_id").alias("note_id")), "note_id", "left_anti")


def attach_resolutions(tracker: DataFrame, cache: DataFrame) -> DataFrame:
    from .match import attach

    return attach(tracker, cache)


def find_first(df: DataFrame, json: str, wanted: dict[str, Sequence[str]]) -> DataFrame:
    """Append, for each entry of wanted, the first non-empty value under any of its keys, as text (objects as JSON).

    All entries are searched in one walk, level by level in the order of the text (keys in their given order within an
    object), through objects and arrays of any depth. Bad JSON and what is not found are null.
    """
    found = df.withColumn("__found", payload.values_of(F.col(json), {out: payload.Wanted(keys) for out, keys in wanted.items()}))
    return found.select(*[f"`{c}`" for c in df.columns if c not in wanted], *[F.col("__found")[out]["text"].alias(out) for out in wanted])


def walk(df: DataFrame, json: str, keys: Sequence[str], out: str) -> DataFrame:
    """Append the first non-empty value under any of the keys, at any depth."""
    return find_first(df, json, {out: keys})


#: The keys of a payload's fields, and of those that are read inside an object first.
_USER, _INTERACTIONS = ("user", "author", "user_info"), ("interact_info", "interactInfo")
_FIELDS = {
    "note": payload.Wanted(("note_id", "noteId")), "plain": payload.Wanted(("id",)),
    "author_in": payload.Wanted(_USER, ("user_id", "userid", "id")), "author": payload.Wanted(("user_id", "userId", "author_id")),
    "name_in": payload.Wanted(_USER, ("nickname", "name", "nick_name")), "name": payload.Wanted(("nickname", "nick_name", "author_name")),
    "likes_in": payload.Wanted(_INTERACTIONS, ("liked_count", "likedCount")), "likes": payload.Wanted(("liked_count", "likes", "like_count")),
    "collects_in": payload.Wanted(_INTERACTIONS, ("collected_count", "collectedCount")), "collects": payload.Wanted(("collected_count", "collects", "collected")),
    "comments_in": payload.Wanted(_INTERACTIONS, ("comment_count", "commentCount")), "comments": payload.Wanted(("comment_count", "comments_count")),
    "title": payload.Wanted(("title", "display_title")), "time": payload.Wanted(("time", "publish_time", "post_time", "create_time")),
}
#: The paths of a page's post, from the post down.
_PAGE = {
    "note": (("noteId",), ("id",)), "author": (("user", "userId"),), "name": (("user", "nickname"), ("user", "nickName")), "likes": (("interactInfo", "likedCount"), ("interactInfo", "liked_count")),
    "collects": (("interactInfo", "collectedCount"), ("interactInfo", "collected_count")), "comments": (("interactInfo", "commentCount"), ("interactInfo", "comment_count")), "title": (("title",),), "time": (("time",),),
}


def _plain(found: Column) -> Column:
    """A value as text; nothing, zero and false are empty."""
    return F.when((found["kind"] != "s") & found["text"].isin("0", "0.0", "-0.0", "false"), "").otherwise(F.coalesce(found["text"], F.lit("")))


def _moment(found: Column) -> Column:
    """A time as text: numbers are epochs, in milliseconds from 1e12 on; those beyond any calendar and texts stay as they are."""
    number = F.when(found["kind"] == "n", found["text"].try_cast("double"))
    return F.when(F.abs(number) < 2.5e14, epoch_text(number)).otherwise(F.coalesce(found["text"], F.lit("")))


def extract_note_fields(df: DataFrame, json: str) -> DataFrame:
    """Append note_id, author_id, author_name, likes, collects, comments, title, published from an API payload of any nesting.

    A note id must be a text of 24 hexadecimal characters; it is never searched for in other text. Author and counts come from the
    first user and interaction objects, where the next key counts if one holds nothing, zero or false, else from their
    keys anywhere. Bad JSON gives empty texts and null counts.
    """
    found = df.withColumn("__found", payload.values_of(F.col(json), _FIELDS))
    c = lambda k: F.col("__found")[k]
    hexed = lambda k: F.when((c(k)["kind"] == "s") & is_hex24(c(k)["text"]), c(k)["text"])
    either = lambda k: F.coalesce(F.nullif(_plain(c(f"{k}_in")), F.lit("")), _plain(c(k)))
    count = lambda k: F.coalesce(magnitude_int(c(f"{k}_in")["text"]), magnitude_int(c(k)["text"])).alias(k)
    return found.select(
        *[f"`{x}`" for x in df.columns], F.lower(F.coalesce(hexed("note"), hexed("plain"), F.lit(""))).alias("note_id"),
        either("author").alias("author_id"), either("name").alias("author_name"), count("likes"), count("collects"), count("comments"), _plain(c("title")).alias("title"), _moment(c("time")).alias("published"),
    )


def extract_page_state(df: DataFrame, html: str, expected: Column, landed: Column | None = None) -> DataFrame:
    """Append state_note, state_author, state_name, state_title, state_likes, state_collects, state_comments and state_published from a page's embedded state.

    All are null where the state is no JSON once `undefined` is null and closing semicolons are off, its author no id, or
    the page another post's: by its own id, or by that of the address where it was reached (landed). A page without
    an id of its own has the landed or expected one.
    """
    raw = F.regexp_extract(F.col(html), r"(?s)__INITIAL_STATE__\s*=\s*(\{.*?)</script>", 1)
    state = F.regexp_replace(F.regexp_replace(raw, r"[\s;]+$", ""), r"\bundefined\b", "null")
    found = df.withColumn("__want", F.lower(F.coalesce(expected, F.lit("")))).withColumn("__end", F.lower(F.coalesce(F.lit("") if landed is None else landed, F.lit(""))))
    found = found.withColumn("__found", payload.page_values(state, F.col("__want"), _PAGE))
    c = lambda k: F.col("__found")[k]
    own, want, end = F.lower(_plain(c("note"))), F.col("__want"), F.col("__end")
    other = lambda id: (id != "") & (want != "") & (id != want)
    good = is_hex24(c("author")["text"]) & ~other(own) & ~other(end)
    keep = lambda x, name: F.when(good, x).alias(f"state_{name}")
    note = F.coalesce(F.nullif(own, F.lit("")), F.nullif(end, F.lit("")), want)
    return found.select(
        *[f"`{x}`" for x in df.columns], keep(note, "note"), keep(c("author")["text"], "author"), keep(_plain(c("name")), "name"), keep(_plain(c("title")), "title"),
        *[keep(magnitude_int(c(k)["text"]), k) for k in ("likes", "collects", "comments")], keep(_moment(c("time")), "published"),
    )
