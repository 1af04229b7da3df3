"""Partial ratio of two texts, over whole Arrow batches of pairs.

One pass over the grid of two texts gives the common subsequence of the shorter one with *every* part of the longer one
(semi-local alignment by strands: each column's strand is followed from the top edge to the bottom edge, two strands cross at
most once and never at equal characters). A part's common subsequence is as long as the part less the strands that both begin and
end inside it, so all parts of one length are counted by adding up strand intervals; no part is aligned by itself. The grid is
walked by antidiagonals, for all pairs of a block at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Strands (pairs x both lengths) of a block: what a task holds at a time, unless one pair has more.
CELLS = 1 << 20
#: Places that bigrams are hashed to, and pairs compared at a time.
PLACES, PAIRS = 256, 1 << 16
#: Shared pieces of two blocks that are held at once.
MEETING = 1 << 23
#: Characters of a piece at most; of a shorter and of a longer text, up to which bits tell whether a part is near.
SPAN, WIDE, LONG = 6, 64, 512


def _codes(texts: list[str], size: int, pad: int) -> np.ndarray:
    out = np.full((len(texts), size), pad, dtype=np.int32)
    for row, t in zip(out, texts):
        row[: len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.int32)
    return out


def _strands(short: list[str], long: list[str]) -> np.ndarray:
    """For each pair and column of the longer text: the column where the strand that ends there began, negative if it came in from the side."""
    m, n = max(map(len, short)), max(map(len, long))
    a, b = _codes(short, m, -1)[:, ::-1], _codes(long, n, -2)
    side = np.tile(np.arange(m, dtype=np.int32), (len(short), 1))
    down = np.tile(np.arange(m, m + n, dtype=np.int32), (len(short), 1))
    for d in range(m + n - 1):
        first, last = max(0, d - n + 1), min(m - 1, d)
        rows, cols = slice(m - 1 - last, m - first), slice(d - last, d - first + 1)
        h, v = side[:, rows], down[:, cols]
        turn = (a[:, rows] == b[:, cols]) | (h > v)
        side[:, rows], down[:, cols] = np.where(turn, v, h), np.where(turn, h, v)
    return down - m


def _best(short: list[str], long: list[str]) -> np.ndarray:
    """The best 200 * LCS / (both lengths) over the parts of the longer text of the shorter one's length, or cut at an end."""
    begin = _strands(short, long)
    count, n = begin.shape
    m, length = (np.array([len(t) for t in ts])[:, None] for ts in (short, long))
    place = np.arange(n)[None, :]
    inside = (begin >= 0) & (place < length)
    pair, end = np.nonzero(inside)
    start = begin[pair, end]

    def score(lost: np.ndarray, size: np.ndarray, valid: np.ndarray) -> np.ndarray:
        return np.where(valid, 200.0 * (size - lost) / (m + size), 0.0).max(axis=1)

    # whole parts [i, i + m): a strand lies in those that begin from end - m + 1 to its own start
    low, high = np.maximum(0, end - m[pair, 0] + 1), np.minimum(start, length[pair, 0] - m[pair, 0])
    some = low <= high
    steps = np.zeros((count, n + 1), dtype=np.int64)
    np.add.at(steps, (pair[some], low[some]), 1)
    np.add.at(steps, (pair[some], high[some] + 1), -1)
    best = score(steps.cumsum(axis=1)[:, :n], np.broadcast_to(m, (count, n)), place <= length - m)
    # beginnings [0, j] shorter than the shorter text, then endings [i, length)
    best = np.maximum(best, score(inside.cumsum(axis=1), np.broadcast_to(place + 1, (count, n)), place + 1 < m))
    begun = np.zeros((count, n), dtype=np.int64)
    np.add.at(begun, (pair, start), 1)
    tail = begun[:, ::-1].cumsum(axis=1)[:, ::-1]
    rest = length - place
    return np.maximum(best, score(tail, np.broadcast_to(np.maximum(rest, 0), (count, n)), (rest > 0) & (rest < m)))


def partial_ratios(left: list[str], right: list[str]) -> np.ndarray:
    """The best similarity 200 * LCS / (both lengths) of the shorter text with any part of the longer one, by pair; 0 if one is empty.

    Parts have the shorter text's length or are cut at an end; of two texts of one length each is tried as the shorter.
    Pairs go through in blocks of like sizes, so a long text pads no short ones.
    """
    out = np.zeros(len(left))
    todo = []
    for i, (a, b) in enumerate(zip(left, right)):
        if a and a == b:
            out[i] = 100.0
        elif a and b:
            todo.append((len(a), len(b), i, a, b) if len(a) <= len(b) else (len(b), len(a), i, b, a))
            if len(a) == len(b):
                todo.append((len(a), len(b), i, b, a))
    todo.sort(key=lambda x: x[:3])
    at = 0
    while at < len(todo):
        upto, widest = at, 0
        while upto < len(todo) and (upto == at or (upto + 1 - at) * (todo[upto][0] + max(widest, todo[upto][1])) <= CELLS):
            widest = max(widest, todo[upto][1])
            upto += 1
        block = todo[at:upto]
        np.maximum.at(out, [x[2] for x in block], _best([x[3] for x in block], [x[4] for x in block]))
        at = upto
    return out


def _ratio_series(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(partial_ratios(a.fillna("").tolist(), b.fillna("").tolist()))


def partial_ratio(a: Column, b: Column) -> Column:
    """Partial ratio of two text columns; a null text counts as empty."""
    return F.pandas_udf(_ratio_series, T.DoubleType())(a, b)


@dataclass(frozen=True)
class _Texts:
    """Texts laid end to end: code points, the text of each and its end; the texts' beginnings and lengths."""

    codes: np.ndarray
    owner: np.ndarray
    ends: np.ndarray
    begins: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def of(texts: list[str]) -> _Texts:
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        ends = sizes.cumsum()
        owner = np.repeat(np.arange(len(texts)), sizes)
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        return _Texts(codes, owner, ends[owner], ends - sizes, sizes)


@cache
def _room(m: int, cutoff: float) -> tuple[int, int, int]:
    """For a shorter text of m characters, over all parts that reach the cutoff: most characters in one of the two only, most bigrams lost, fewest characters in common."""
    part = np.arange(1, m + 1)
    least = np.ceil(cutoff * (m + part) / 200 - 1e-9).astype(np.int64)
    part, least = part[least <= part], least[least <= part]
    return (int((m + part - 2 * least).max()), int((2 * (m - least) + part - least).max()), int(least.min())) if len(part) else (0, 0, m)


def _rooms(t: _Texts, cutoff: float) -> np.ndarray:
    sizes, at = np.unique(t.sizes, return_inverse=True)
    return np.array([_room(m, cutoff) for m in sizes.tolist()])[at]


@cache
def _cuts(m: int, cutoff: float) -> tuple[tuple[int, int, bool], ...]:
    """Pieces (begin, size, slack) of a text of m characters, one of which any part at the cutoff holds: whole, or with one character more or less where there is slack.

    Each character in one text only spoils a piece without slack, two spoil one with slack; so the pieces have to take one more than there can be. The
    cheapest such pieces, if a piece is the rarer the longer it is. One piece of no characters, which all texts hold, where there are none.
    """
    need = _room(m, cutoff)[0] + 1
    if m > WIDE:
        count = -(-need // 2)
        size = min(SPAN, m // count)
        return tuple((i * size, size, True) for i in range(count)) if size > 1 else ((0, 0, False),)
    kinds = [(n, False, 1, 8.0**-n) for n in range(1, SPAN + 1)] + [(n, True, 2, n * (8.0 ** (1 - n) + 8.0**-n)) for n in range(2, SPAN + 1)]
    best: dict[tuple[int, int], tuple[float, tuple]] = {}
    for room in range(m + 1):
        best[room, 0] = (0.0, ())
        for units in range(1, need + 1):
            tried = [(best[room - n, max(units - u, 0)][0] + cost, i) for i, (n, _, u, cost) in enumerate(kinds) if n <= room]
            cost, i = min(tried, default=(math.inf, 0))
            n, slack, u, _ = kinds[i]
            best[room, units] = (cost, ((n, slack), *best[room - n, max(units - u, 0)][1])) if cost < math.inf else (math.inf, ())
    cost, pieces = best[m, need]
    if cost == math.inf:
        return ((0, 0, False),)
    return tuple((sum(n for n, _ in pieces[:i]), n, slack) for i, (n, slack) in enumerate(pieces))


def _hashes(t: _Texts, at: np.ndarray, kept: Sequence[int], kind: int) -> np.ndarray:
    """Hashes of the characters kept from the places on."""
    out = np.full(len(at), kind + 2 * len(kept) + 1, dtype=np.uint64)
    for k in kept:
        out = (out + t.codes[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _sought(t: _Texts, cutoff: float) -> tuple[np.ndarray, np.ndarray, dict[tuple[int, bool], int]]:
    """Hashes of what a longer text holds of the pieces of a shorter one, their texts, and the shortest text that has each kind of piece."""
    hashes, owners, kinds = [], [], {}
    for m in np.unique(t.sizes[t.sizes > 0]).tolist():
        rows = np.nonzero(t.sizes == m)[0]
        for begin, n, slack in _cuts(m, cutoff):
            kinds.setdefault((n, slack), m)
            forms = [(range(n), 0)] + ([(range(n), 1)] + [([k for k in range(n) if k != d], 0) for d in range(n)] if slack else [])
            for kept, kind in forms:
                hashes.append(_hashes(t, t.begins[rows] + begin, kept, kind))
                owners.append(rows)
    return np.concatenate(hashes), np.concatenate(owners), kinds


def _held(t: _Texts, kinds: dict[tuple[int, bool], int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the pieces that texts hold, as _sought has them, and their texts."""
    grams: dict[int, int] = {}
    for (n, slack), m in kinds.items():
        for size in (n, n - 1)[: 1 + slack]:
            grams[size] = min(m, grams.get(size, m))
    forms = [(n, range(n), 0, m) for n, m in grams.items()]
    forms += [(n + 1, [k for k in range(n + 1) if k != d], 1, m) for (n, slack), m in kinds.items() if slack for d in range(1, n)]
    for size, kept, kind, m in forms:
        at = np.nonzero((np.arange(len(t.codes)) + size <= t.ends) & (t.sizes[t.owner] >= m))[0] if size else t.begins[t.sizes >= m]
        yield _hashes(t, at, kept, kind), t.owner[at]


def _distinct(x: np.ndarray) -> np.ndarray:
    x.sort()
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _bigrams(t: _Texts) -> np.ndarray:
    """The places that each text's bigrams are hashed to, one bit each, in words of all texts."""
    at = np.nonzero(np.arange(len(t.codes)) + 2 <= t.ends)[0]
    place = ((t.codes[at] * np.uint64(2654435761) + t.codes[at + 1] * np.uint64(40503)) >> np.uint64(7)) % np.uint64(PLACES)
    out = np.zeros((len(t.sizes), PLACES), dtype=np.uint8)
    out[t.owner[at], place.astype(np.int64)] = 1
    return np.ascontiguousarray(np.packbits(out, axis=1).view(np.uint64).T)


def _met(short: _Texts, long: _Texts, cutoff: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Pairs of texts, the second no shorter, that share a piece and enough bigrams; None where too many share a piece to be held at once."""
    sought, owner, kinds = _sought(short, cutoff)
    order = sought.argsort(kind="stable")
    owner = owner[order]
    keys, begin, count = np.unique(sought[order], return_index=True, return_counts=True)
    seen = np.zeros(1 << 20, dtype=bool)
    seen[keys >> np.uint64(44)] = True
    shared = []
    for hashes, texts in _held(long, kinds):
        some = np.nonzero(seen[hashes >> np.uint64(44)])[0]
        at = np.minimum(keys.searchsorted(hashes[some]), len(keys) - 1)
        hit = keys[at] == hashes[some]
        shared.append((at[hit], texts[some[hit]]))
    at, texts = (np.concatenate(x) for x in zip(*shared))
    upto = count[at].cumsum()
    if len(at) and upto[-1] > MEETING and len(short.sizes) * len(long.sizes) > PAIRS:
        return None
    a, b = _bigrams(short), _bigrams(long)
    least = np.maximum(np.bitwise_count(a).sum(axis=0).astype(np.int64) - _rooms(short, cutoff)[:, 1], 0).astype(np.int16)
    found = [np.zeros(0, dtype=np.int64)]
    for part in np.split(np.arange(len(at)), upto.searchsorted(np.arange(PAIRS, upto[-1] if len(at) else 0, PAIRS))):
        many = count[at[part]]
        i = owner[np.repeat(begin[at[part]] - (many.cumsum() - many), many) + np.arange(many.sum())]
        j = np.repeat(texts[part], many)
        fits = np.nonzero(short.sizes[i] <= long.sizes[j])[0]
        i, j = i[fits], j[fits]
        both = sum(np.bitwise_count(x.take(i) & y.take(j)).astype(np.int16) for x, y in zip(a, b))
        enough = np.nonzero(both >= least[i])[0]
        found.append(i[enough] * len(long.sizes) + j[enough])
    return np.divmod(_distinct(np.concatenate(found)), len(long.sizes))


def _places(t: _Texts) -> np.ndarray:
    """The places of the characters in a table of 128, and 128 behind the last one."""
    return np.append((t.codes ^ (t.codes >> np.uint64(7))) & np.uint64(127), np.uint64(128)).astype(np.int32)


def _bits(t: _Texts, places: np.ndarray, back: bool) -> np.ndarray:
    """For each text of WIDE characters at most and each place a bit for each character there, from the end on if back."""
    out = np.zeros((len(t.sizes), 129), dtype=np.uint64)
    for k in range(min(WIDE, t.sizes.max(initial=0))):
        rows = np.nonzero((t.sizes > k) & (t.sizes <= WIDE))[0]
        out[rows, places[t.begins[rows] + (t.sizes[rows] - 1 - k if back else k)]] |= np.uint64(1) << np.uint64(k)
    return out.ravel()


def _close(short: _Texts, long: _Texts, i: np.ndarray, j: np.ndarray, cutoff: float) -> np.ndarray:
    """Whether texts i and j may reach the cutoff, by their common subsequence with the beginnings, the endings and the other parts in turn, one bit for each
    character of the shorter one; characters of one place count as equal. True where a text has too many characters for that."""
    out = (short.sizes[i] > WIDE) | (long.sizes[j] > LONG)
    todo = np.nonzero(~out)[0]
    if not len(todo):
        return out
    todo = todo[np.lexsort((i[todo], long.sizes[j[todo]]))]
    mine, places = _places(short), _places(long)
    tables = {back: {kind: bits.astype(kind) for kind in (np.uint32, np.uint64)} for back in (False, True) for bits in [_bits(short, mine, back)]}
    low = _rooms(short, cutoff)[:, 2]

    def walk(back: bool, pairs: np.ndarray, begin: np.ndarray, size: np.ndarray, check: bool) -> tuple[np.ndarray, np.ndarray]:
        """Characters in common with the size characters from begin on; whether a part of up to as many as the shorter text has reaches the cutoff on the way."""
        m, most = short.sizes[i[pairs]].astype(np.int32), size.max(initial=0)
        kind = np.uint32 if m.max(initial=0) <= 32 else np.uint64
        bits, row, begin = tables[back][kind], (i[pairs] * 129).astype(np.int32), begin.astype(np.int32)
        full = ~kind(0)
        mask = full >> (8 * full.itemsize - m).astype(kind)
        open_, reached, fewest = np.full(len(pairs), full), np.zeros(len(pairs), dtype=bool), low[i[pairs]].min(initial=LONG)
        fewest_at = size.min(initial=LONG)
        for k in range(most):
            at = begin - k if back else begin + k
            hit = open_ & bits.take(row + places.take(at if k < fewest_at else np.where(k < size, at, len(places) - 1)))
            open_ = (open_ + hit) | (open_ - hit)
            if check and fewest <= k + 1 <= m.max():
                reached |= (k + 1 <= m) & (200.0 * np.bitwise_count(~open_ & mask) >= cutoff * (m + k + 1) - 1e-6)
        return np.bitwise_count(~open_ & mask).astype(np.int64), reached

    for at in range(0, len(todo), PAIRS // 4):
        rest = todo[at : at + PAIRS // 4]
        common, good = walk(False, rest, long.begins[j[rest]], long.sizes[j[rest]], True)
        out[rest] = good
        may = ~good & (common >= low[i[rest]])
        rest, common = rest[may], common[may]
        m, n = short.sizes[i[rest]], long.sizes[j[rest]]
        good = walk(True, rest, long.begins[j[rest]] + n - 1, m, True)[1]
        out[rest] = good
        may = ~good & (200 * common >= cutoff * 2 * m - 1e-6)
        rest = rest[may]
        for w in range(1, LONG):
            m, n = short.sizes[i[rest]], long.sizes[j[rest]]
            rest, m = rest[w < n - m], m[w < n - m]
            if not len(rest):
                break
            good = 200 * walk(False, rest, long.begins[j[rest]] + w, m, False)[0] >= cutoff * 2 * m - 1e-6
            out[rest] = good
            rest = rest[~good]
    return out


def close_parts(left: list[str], right: list[str], cutoff: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (left, right) of all pairs of two blocks whose partial ratio reaches the cutoff, in parts.

    A part of the longer form at the cutoff leaves so few characters of either side out that it holds one of a few pieces of the shorter form, whole or
    with one character more or less (_cuts), so forms meet where hashes of those are equal, not all with all. Pairs that met go on if they share
    enough hashed bigrams (a character left out breaks two at most, one put in breaks one) and then if some part has enough in common by a test of bits.
    All of these are lossless; what is left is compared. Either side may be the shorter one. Blocks of which too many meet at once are halved.
    """
    a, b = _Texts.of(left), _Texts.of(right)
    if not len(a.codes) or not len(b.codes):
        return
    met = [_met(a, b, cutoff), _met(b, a, cutoff)]
    if any(x is None for x in met):
        for x in (0, 1):
            for y in (0, 1):
                at, to = x * (len(left) // 2), y * (len(right) // 2)
                for i, j in close_parts(left[at : None if x else len(left) // 2], right[to : None if y else len(right) // 2], cutoff):
                    yield i + at, j + to
        return
    pairs = []
    for short, long, (i, j), flip in ((a, b, met[0], False), (b, a, met[1], True)):
        some = _close(short, long, i, j, cutoff)
        i, j = (j[some], i[some]) if flip else (i[some], j[some])
        pairs.append(i * len(right) + j)
    i, j = np.divmod(_distinct(np.concatenate(pairs)), len(right))
    for at in range(0, len(i), PAIRS):
        x, y = i[at : at + PAIRS], j[at : at + PAIRS]
        kept = partial_ratios([left[k] for k in x], [right[k] for k in y]) >= cutoff
        yield x[kept], y[kept]


def close_pairs(left: list[str], right: list[str], cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of close_parts at once."""
    parts = [(np.zeros(0, dtype=np.int64),) * 2, *close_parts(left, right, cutoff)]
    i, j = (np.concatenate(x) for x in zip(*parts))
    return i, j


def close_rows(met: DataFrame, cutoff: float) -> DataFrame:
    """(l_id, r_id) of the pairs whose partial ratio reaches the cutoff; each row of met has two blocks, l_ids with lfs and r_ids with rfs, and whether the pairs hold the other way too (twice)."""
    ids = [met.schema[k].dataType.elementType for k in ("l_ids", "r_ids")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                l, lf, r, rf = (batch.column(k)[row].values for k in ("l_ids", "lfs", "r_ids", "rfs"))
                for i, j in close_parts(lf.to_pylist(), rf.to_pylist(), cutoff):
                    x, y = l.take(pa.array(i)), r.take(pa.array(j))
                    yield pa.RecordBatch.from_arrays([x, y], names=["l_id", "r_id"])
                    if batch.column("twice")[row].as_py():
                        yield pa.RecordBatch.from_arrays([y, x], names=["l_id", "r_id"])

    return met.mapInArrow(run, T.StructType([T.StructField("l_id", ids[0]), T.StructField("r_id", ids[1])]))
