"""Byte-level BPE with a hierarchical-bitmap rank queue.

A text is split by the tokenizer's pattern; each pre-token starts as single bytes. Every adjacent pair that has a merge
rank is a queue entry: the bucket of its rank holds linked-list positions, leftmost first. Two bitmap levels mark
the ranks with a bucket, so find-first-set gives the next rank in two steps whatever the pre-token's length; entries that no longer describe their pair are skipped when they come up. A pre-token of n bytes costs
O(n log n), which matters for very long ones. New pre-tokens of several texts share one list and one queue, so that
a rank comes up once for all of them.

Pre-tokens repeat, so each Python worker keeps a bounded memo of them. Texts never leave their row: encode and decode
are narrow maps without a shuffle.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterable
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Memo, held, map_rows, texts

#: Entries of each of a memo's two generations; about 180 bytes each.
MEMO_SIZE = 150_000
#: Two token ids below 2 to this power make one pair key.
SHIFT = 24
#: Characters of texts that are split together.
TOGETHER = 1 << 20
#: Pre-tokens of one list: more share a rank's turn, fewer stay in the processor's cache.
LIST = 512
#: What stands between the pre-tokens of one list: no token's id, so that it merges with nothing.
GAP = (1 << SHIFT) - 1


def basic_plane(pattern: str) -> str | None:
    """The pattern for the standard engine, right for texts without code points over U+FFFF; None where it is not translated.

    Letters, numbers and white space become explicit classes, listed by the engine that the pattern was written for.
    """
    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))

    def members(kind: str) -> str:
        out = ""
        for run in regex.findall(kind + "+", plane):
            out += "".join(re.escape(a) + "-" + re.escape(b) for a, b in ([(run[0], "\ud7ff"), ("\ue000", run[-1])] if run[0] < "\ud800" < run[-1] else [(run[0], run[-1])]))
        return out

    sets = {kind: members(kind) for kind in (r"\p{L}", r"\p{N}", r"\s")}
    out, inside, at = "", False, 0
    while at < len(pattern):
        kind = next((k for k in (*sets, r"\S") if pattern.startswith(k, at)), None)
        if kind is None and (pattern[at] == "\\" or pattern.startswith(("(?i", "(?>", "++", "*+", "?+"), at)):
            return None
        if kind == r"\S":
            if inside:
                return None
            out += f"[^{sets[chr(92) + 's']}]"
        elif kind:
            out += sets[kind] if inside else f"[{sets[kind]}]"
        else:
            inside = (inside or pattern[at] == "[") and pattern[at] != "]"
            out += pattern[at]
        at += len(kind or " ")
    return out


class Splitter:
    """All matches of a pattern in a text: the standard engine where it is proven equal, else the one that the pattern was written for."""

    def __init__(self, pattern: str, basic: str | None) -> None:
        self.any = regex.compile(pattern).findall
        self.basic = re.compile(basic).findall if basic else None

    def __call__(self, text: str) -> list[str]:
        # Two bytes for each character of the basic plane, four for the others.
        if self.basic and (text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)):
            return self.basic(text)
        return self.any(text)


class RankQueue:
    """Buckets by rank under a bitmap of 256-bit words: a bucket is one position, or a heap of several. Empty between pre-tokens, so one serves all."""

    def __init__(self, ranks: int) -> None:
        self.low = [0] * ((ranks >> 8) + 1)
        self.buckets: list[int | list[int] | None] = [None] * ranks
        self.bit = [1 << (r & 255) for r in range(ranks)]


def merge(ids: list[int], pair: dict[int, int], product: list[int], queue: RankQueue) -> list[int]:
    """The tokens of one pre-token, given as byte ids: always the pair of least rank next, leftmost first.

    pair maps two neighbours' key to their rank, product a rank to the token that it makes. The bitmap has a summary
    integer `top` over words of 256 ranks; find-first-set is (x & -x).bit_length() on either level.
    """
    end = len(ids)
    if end < 2:
        return ids
    get, low, buckets, bit, top = pair.get, queue.low, queue.buckets, queue.bit, 0
    ranks = [get(a << 24 | b, -1) for a, b in zip(ids, ids[1:])]
    ranks.append(-1)
    after, before = list(range(1, end + 1)), list(range(-1, end - 1))
    i = 0
    for rank in ranks:
        if rank >= 0:
            bucket = buckets[rank]
            if bucket is None:
                buckets[rank] = i
                low[word := rank >> 8] |= bit[rank]
                top |= 1 << word
            elif bucket.__class__ is list:
                heappush(bucket, i)
            else:
                buckets[rank] = [bucket, i]
        i += 1
    while top:
        word = (top & -top).bit_length() - 1
        x = low[word]
        rank = (word << 8) + (x & -x).bit_length() - 1
        i = buckets[rank]
        if i.__class__ is list:
            bucket = i
            i = heappop(bucket)
            if len(bucket) == 1:
                buckets[rank] = bucket[0]
        else:
            buckets[rank] = None
            low[word] = x = x & (x - 1)
            if not x:
                top &= top - 1
        if ranks[i] != rank:
            continue  # stale
        j = after[i]
        after[i] = k = after[j]
        ids[i] = token = product[rank]
        ids[j] = ranks[j] = -1
        if k < end:
            before[k] = i
            ranks[i] = new = get(token << 24 | ids[k], -1)
            if new >= 0:
                bucket = buckets[new]
                if bucket is None:
                    buckets[new] = i
                    low[word := new >> 8] |= bit[new]
                    top |= 1 << word
                elif bucket.__class__ is list:
                    heappush(bucket, i)
                else:
                    buckets[new] = [bucket, i] if bucket < i else [i, bucket]
        else:
            ranks[i] = -1
        h = before[i]
        if h >= 0:
            ranks[h] = new = get(ids[h] << 24 | token, -1)
            if new >= 0:
                bucket = buckets[new]
                if bucket is None:
                    buckets[new] = h
                    low[word := new >> 8] |= bit[new]
                    top |= 1 << word
                elif bucket.__class__ is list:
                    heappush(bucket, h)
                else:
                    buckets[new] = [bucket, h] if bucket < h else [h, bucket]
    return [s for s in ids if s >= 0]


def merge_many(data: list[bytes], byte_id: np.ndarray, first: np.ndarray, nexts: list[dict[int, int] | None], lasts: list[dict[int, int] | None], queue: RankQueue) -> list[bytes]:
    """The packed ids of many pre-tokens that merge in one linked list, a GAP after each; the id is the rank.

    first has the rank of each pair of bytes, or -1; nexts the ranks of a token with its right neighbours, lasts with its left ones, None where
    it merges with none, as most do. Only for vocabularies in which each token is made of tokens of lower ranks
    (RankEncoder.rising): then all that a rank holds merges when it comes up, leftmost first, and what that adds comes up later.
    """
    lengths = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
    gaps = np.cumsum(lengths + 1)
    flat = np.frombuffer(b"\0" + b"\0".join(data) + b"\0", dtype=np.uint8).astype(np.int64)  # a gap before the first one, too
    between = np.concatenate(([0], gaps))
    start = byte_id[flat]
    start[between] = GAP
    known = np.append(first[flat[:-1] << 8 | flat[1:]], -1)
    known[between] = -1
    known[gaps - 1] = -1
    at = np.flatnonzero(known >= 0)
    at = at[np.argsort(known[at], kind="stable")]
    found, cuts = np.unique(known[at], return_index=True)
    places, cuts = at.tolist(), [*cuts.tolist(), len(at)]
    low, buckets, bit, top = queue.low, queue.buckets, queue.bit, 0
    for n, rank in enumerate(found.tolist()):
        buckets[rank] = places[cuts[n] : cuts[n + 1]]
        low[word := rank >> 8] |= bit[rank]
        top |= 1 << word
    ids, ranks, end = start.tolist(), known.tolist(), len(flat)
    after, before = list(range(1, end + 1)), list(range(-1, end - 1))
    while top:
        word = (top & -top).bit_length() - 1
        x = low[word]
        token = (word << 8) + (x & -x).bit_length() - 1
        low[word] = x = x & (x - 1)
        if not x:
            top &= top - 1
        bucket = buckets[token]
        buckets[token] = None
        bucket.sort()
        right, left = nexts[token], lasts[token]
        for i in bucket:
            if ranks[i] != token:
                continue  # stale
            j = after[i]
            after[i] = k = after[j]
            before[k] = i
            ids[i] = token
            ids[j] = ranks[j] = ranks[i] = -1
            if right and (new := right.get(ids[k], -1)) >= 0:
                ranks[i] = new
                if buckets[new] is None:
                    buckets[new] = [i]
                    low[word := new >> 8] |= bit[new]
                    top |= 1 << word
                else:
                    buckets[new].append(i)
            h = before[i]
            ranks[h] = -1
            if left and (new := left.get(ids[h], -1)) >= 0:
                ranks[h] = new
                if buckets[new] is None:
                    buckets[new] = [h]
                    low[word := new >> 8] |= bit[new]
                    top |= 1 << word
                else:
                    buckets[new].append(h)
    out = np.array(ids, dtype=np.int32)
    ends = np.cumsum((out >= 0) & (out != GAP))[gaps].tolist()
    packed = out[(out >= 0) & (out != GAP)].tobytes()
    return [packed[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]


class Vocabulary:
    """A rank file: token bytes by rank, enough to decode."""

    def __init__(self, raw: bytes) -> None:
        lines = (line.split() for line in raw.splitlines() if line)
        self.tokens = {int(rank): base64.b64decode(token) for token, rank in lines}

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class RankEncoder(Vocabulary):
    """A rank-file vocabulary: any two neighbours whose joined bytes have a rank may merge; a pre-token that is itself in the vocabulary is one token."""

    def __init__(self, raw: bytes, pattern: str, basic: str | None = None) -> None:
        super().__init__(raw)
        self.ranks = {token: rank for rank, token in self.tokens.items()}
        self.byte_id = [self.ranks[bytes([b])] for b in range(256)]
        get = self.ranks.get
        self.pair, odd = {}, {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = get(token[:i]), get(token[i:])
                if a is not None and b is not None:
                    self.pair[a << SHIFT | b] = rank
                    if (i > 1 and a > rank) or (i < len(token) - 1 and b > rank):
                        odd.setdefault(token, set()).add((a, b))
        self.bytes = np.array(self.byte_id, dtype=np.int64)
        self.first = np.array([get(bytes((a, b)), -1) for a in range(256) for b in range(256)], dtype=np.int64)
        self.product = list(range(max(self.tokens) + 1))  # the id is the rank
        self.pieces = Splitter(pattern, basic)
        self.queue = RankQueue(len(self.product))
        self.rising = max(self.tokens) < GAP and not any(self.last_pair(token) in pairs for token, pairs in odd.items())
        self.nexts: list[dict[int, int] | None] = [None] * len(self.product)
        self.lasts: list[dict[int, int] | None] = [None] * len(self.product)
        if self.rising:
            for key, rank in self.pair.items():
                a, b = key >> SHIFT, key & GAP
                for side, one, other in ((self.nexts, a, b), (self.lasts, b, a)):
                    if side[one] is None:
                        side[one] = {}
                    side[one][other] = rank
        self.memo = Memo(self.piece_ids, MEMO_SIZE)

    def last_pair(self, token: bytes) -> tuple[int, ...]:
        """What a token is made of, wherever it is made: merges inside its bytes come in the same order in any text, unless one crosses their ends and the token is not made."""
        get, pair = self.ranks.get, self.pair
        own = [(get(token[:i]), get(token[i:])) for i in range(1, len(token))]
        own = {a << SHIFT | b: self.ranks[token] for a, b in own if a is not None and b is not None}
        for key in own:
            del pair[key]
        parts = merge([self.byte_id[b] for b in token], pair, self.product, self.queue)
        pair.update(own)
        return tuple(parts)

    def piece_ids(self, piece: str) -> bytes:
        """The ids of a pre-token as packed int32, so that a text's ids are one join."""
        data = piece.encode()
        if data in self.ranks:
            return array("i", (self.ranks[data],)).tobytes()
        byte_id = self.byte_id
        return array("i", merge([byte_id[b] for b in data], self.pair, self.product, self.queue)).tobytes()

    def learn(self, pieces: Iterable[str]) -> None:
        """Put the pre-tokens that the memo lacks into it, together where the vocabulary allows it."""
        if not self.rising:
            return
        ranks, long, put = self.ranks, [], self.memo.put
        for piece in self.memo.unknown(pieces):
            data = piece.encode()
            if data in ranks:
                put(piece, array("i", (ranks[data],)).tobytes())
            else:
                long.append((piece, data))
        for n in range(0, len(long), LIST):
            part = long[n : n + LIST]
            for (piece, _), ids in zip(part, merge_many([d for _, d in part], self.bytes, self.first, self.nexts, self.lasts, self.queue)):
                put(piece, ids)

    def packed_all(self, texts: Iterable[str]) -> list[bytes]:
        """The packed ids of each text; texts are split and their new pre-tokens learnt some at a time."""
        out: list[bytes] = []
        waiting: list[list[str]] = []
        size, find = 0, self.memo.__getitem__

        def finish() -> None:
            self.learn(chain.from_iterable(waiting))
            out.extend(b"".join(map(find, pieces)) for pieces in waiting)
            waiting.clear()

        for text in texts:
            waiting.append(self.pieces(text))
            size += len(text)
            if size >= TOGETHER:
                finish()
                size = 0
        finish()
        return out

    def packed(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, self.pieces(text)))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), dtype=np.int32)


def _shared(df: DataFrame, ranks_path: str, pattern: str):
    """The rank file, read once by the driver and broadcast with the patterns: its size is the vocabulary's, whatever the corpus."""
    with open(ranks_path, "rb") as f:
        raw = f.read()
    return df.sparkSession.sparkContext.broadcast((hash(raw), raw, pattern, basic_plane(pattern)))


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """Append the token ids of each whole text as array<int>, and with `decoded` the bytes that these ids decode to.

    Null and empty texts give an empty array and empty bytes. Rows are independent, so repeated rows and ids keep their
    own result; an empty table gives an empty table; columns already named like the results are replaced, all others are kept.
    """
    shared = _shared(df, ranks_path, pattern)

    def make():
        key, raw, full, basic = shared.value
        own = held(("encode", key, full), lambda: RankEncoder(raw, full, basic))

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            packed = own.packed_all(texts(batch, text))
            offsets = np.zeros(len(packed) + 1, dtype=np.int32)
            np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
            flat = np.frombuffer(b"".join(packed), dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=pa.int32()))
            return [ids] if decoded is None else [ids, _decoded(own, ids)]

        return work

    new = [T.StructField(out, T.ArrayType(T.IntegerType()))]
    return map_rows(df, new if decoded is None else [*new, T.StructField(decoded, T.BinaryType())], make, rows=256)


def _decoded(vocabulary: Vocabulary, column: pa.ListArray) -> pa.Array:
    ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return pa.array([vocabulary.decode(flat[a:b].tolist()) for a, b in zip([0, *ends[:-1]], ends)], type=pa.binary())


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Append the bytes that an id array stands for. Null and empty arrays give empty bytes; an id outside the vocabulary fails.

    Rows are independent: repeated rows keep their own result, an empty table stays empty, a column named like `out` is
    replaced and all others are kept.
    """
    with open(ranks_path, "rb") as f:
        raw = f.read()
    shared = df.sparkSession.sparkContext.broadcast((hash(raw), raw))

    def make():
        key, raw = shared.value
        own = held(("decode", key), lambda: Vocabulary(raw))
        return lambda batch: [_decoded(own, batch.column(batch.schema.get_field_index(ids)))]

    return map_rows(df, [T.StructField(out, T.BinaryType())], make, rows=256)
