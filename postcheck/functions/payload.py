"""Fields of JSON payloads of any nesting: one walk of each payload in an Arrow map, whatever its depth and the number of fields.

Objects keep the order of their text, which Spark's VARIANT does not. A payload is parsed and walked inside its row, so
nothing is shuffled and a worker holds one payload at a time.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Wanted(NamedTuple):
    """The first non-empty value under any of the keys; with `inner`, the first true value under one of these in that value, if it is an object."""

    keys: Sequence[str]
    inner: Sequence[str] = ()


#: A found value: strings as they are, numbers and truth values as JSON writes them, the rest as JSON. Kinds: s, n, b, o.
FOUND = T.StructType([T.StructField("text", T.StringType()), T.StructField("kind", T.StringType())])
#: What counts as nothing in a payload; zero and false are values.
_EMPTY = (None, "", [], {})


def nodes(root: object, breadth: bool) -> Iterator[dict]:
    """All objects of a payload: level by level in text order, or depth first from the last child."""
    waiting = deque([root])
    while waiting:
        node = waiting.popleft() if breadth else waiting.pop()
        if isinstance(node, dict):
            yield node
            waiting.extend(node.values())
        elif isinstance(node, list):
            waiting.extend(node)


def parsed(text: str | None) -> object:
    """The payload, or nothing where the text is no JSON."""
    try:
        return json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None


def first_values(root: object, wanted: Mapping[str, Wanted]) -> dict[str, object]:
    """Each entry's value, found in one walk that ends as soon as all are; within an object the keys count in order."""
    found: dict[str, object] = {}
    open_ones = dict(wanted)
    for node in nodes(root, breadth=True):
        for name, (keys, inner) in list(open_ones.items()):
            for value in (node[k] for k in keys if k in node):
                # 0 == False, but neither equals "" or None, so the comparison is right for them.
                if value not in _EMPTY:
                    found[name] = next((value[k] for k in inner if value.get(k)), None) if inner and isinstance(value, dict) else None if inner else value
                    del open_ones[name]
                    break
        if not open_ones:
            break
    return found


def shown(value: object) -> tuple[str | None, str | None]:
    if value is None:
        return None, None
    if isinstance(value, str):
        return value, "s"
    kind = "b" if isinstance(value, bool) else "n" if isinstance(value, (int, float)) else "o"
    return json.dumps(value, ensure_ascii=False, separators=(",", ":")), kind


def _frame(rows: Sequence[Mapping[str, object]], names: Sequence[str]) -> pd.DataFrame:
    return pd.DataFrame({n: [dict(zip(("text", "kind"), shown(r.get(n)))) for r in rows] for n in names}, columns=list(names))


def _found_by(pick: Callable[..., Mapping[str, object]], names: Sequence[str], *columns: Column) -> Column:
    """A struct of FOUND by name, computed row by row in Arrow batches."""

    def run(*series: pd.Series) -> pd.DataFrame:
        return _frame([pick(*values) for values in zip(*series)], names)

    def one(s: pd.Series) -> pd.DataFrame:
        return run(s)

    def two(s: pd.Series, t: pd.Series) -> pd.DataFrame:
        return run(s, t)

    return F.pandas_udf(one if len(columns) == 1 else two, T.StructType([T.StructField(n, FOUND) for n in names]))(*columns)


def values_of(payload: Column, wanted: Mapping[str, Wanted]) -> Column:
    return _found_by(lambda text: first_values(parsed(text), wanted), list(wanted), payload)


def post_of_state(state: object, expected: str | None) -> dict:
    """A page's post: at its place in the mobile state, else in the desktop state's map (the expected one first, then in order), else the first object met, last children first, with a user id and interactions or a time."""
    at = lambda node, *path: at(node[path[0]], *path[1:]) if path and isinstance(node, dict) and path[0] in node else None if path else node
    fits = lambda node: isinstance(node, dict) and bool(node.get("user"))
    mobile, details = at(state, "noteData", "data", "noteData"), at(state, "note", "noteDetailMap")
    entries = list(details.items()) if isinstance(details, dict) else []
    entries.sort(key=lambda e: e[0].lower() != (expected or "").lower())
    known = [mobile, *(at(entry, "note") for _, entry in entries)]
    for node in known:
        if fits(node):
            return node
    for node in nodes(state, breadth=False):
        if isinstance(node.get("user"), dict) and node["user"].get("userId") and ("interactInfo" in node or "time" in node):
            return node
    return {}


def page_values(state: Column, expected: Column, fields: Mapping[str, Sequence[Sequence[str]]]) -> Column:
    """FOUND by name of a page's post: the first true value under any of each field's paths."""

    def pick(text: str | None, want: str | None) -> dict[str, object]:
        post = post_of_state(parsed(text), want)
        out = {}
        for name, paths in fields.items():
            for path in paths:
                value: object = post
                for key in path:
                    value = value.get(key) if isinstance(value, dict) else None
                if value:
                    out[name] = value
                    break
        return out

    return _found_by(pick, list(fields), state, expected)
