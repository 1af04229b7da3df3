"""Token counts by the whole-token shortcut.

Before the job, every vocabulary string is run through the merges once: those that come out as a single token are
proven whole tokens. A pre-token among them counts 1 without any merging; only the others are merged, and each
worker remembers their counts in a bounded memo. Special strings inside a text split it and count one each, as the
library does by default.
"""

from __future__ import annotations

import json

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import SHIFT, RankQueue, Splitter, basic_plane, merge
from .common import Memo, held, map_rows, texts

#: Bytes up to which a pre-token's pairs are scanned for the least rank; longer ones go through the rank queue.
SCANNED = 64
#: Entries of each of the memo's two generations.
MEMO_SIZE = 150_000
#: No merge: above every rank.
_NONE = 1 << 30


def byte_of() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next code point from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def scan_merge(ids: list[int], pair: dict[int, int], product: list[int]) -> list[int]:
    """The same tokens as merge(), by scanning a short pre-token's pairs for the least rank."""
    get = pair.get
    ranks = [get(a << SHIFT | b, _NONE) for a, b in zip(ids, ids[1:])]
    while ranks and (rank := min(ranks)) != _NONE:
        i = ranks.index(rank)
        ids[i] = token = product[rank]
        del ids[i + 1], ranks[i]
        if i:
            ranks[i - 1] = get(ids[i - 1] << SHIFT | token, _NONE)
        if i < len(ranks):
            ranks[i] = get(token << SHIFT | ids[i + 1], _NONE)
    return ids


class Counter:
    """Counts tokens by a byte-level BPE of a tokenizer.json."""

    def __init__(self, raw: bytes, pattern: str, basic: str | None = None, whole: frozenset[bytes] | None = None) -> None:
        spec = json.loads(raw)
        stand_in = byte_of()
        as_bytes = lambda s: bytes(stand_in[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.ids = {as_bytes(s): i for s, i in vocab.items() if all(c in stand_in for c in s)}
        self.byte_id = [self.ids[bytes([b])] for b in range(256)]
        self.pair: dict[int, int] = {}
        self.product: list[int] = []
        for rank, both in enumerate(spec["model"]["merges"]):
            a, b = both if isinstance(both, list) else both.split(" ")
            self.pair.setdefault(vocab[a] << SHIFT | vocab[b], rank)
            self.product.append(vocab[a + b])
        specials = [t["content"] for t in spec.get("added_tokens", []) if t.get("content")]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True))) if specials else None
        self.pieces = Splitter(pattern, basic)
        self.queue = RankQueue(len(self.product) + 1)
        self.whole = self.prove() if whole is None else whole
        self.memo = Memo(self.piece_count, MEMO_SIZE)

    def prove(self) -> frozenset[bytes]:
        """The vocabulary strings that encode alone as one token."""
        return frozenset(v for v in self.ids if len(self.merged(v)) == 1)

    def merged(self, piece: bytes) -> list[int]:
        byte_id = self.byte_id
        ids = [byte_id[b] for b in piece]
        return scan_merge(ids, self.pair, self.product) if len(ids) <= SCANNED else merge(ids, self.pair, self.product, self.queue)

    def piece_count(self, piece: str) -> int:
        data = piece.encode()
        return 1 if data in self.whole else len(self.merged(data))

    def count(self, text: str) -> int:
        if self.special is None or self.special.search(text) is None:
            return sum(map(self.memo.__getitem__, self.pieces(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.memo[p] for part in parts for p in self.pieces(part))


def count_tokens(df: DataFrame, tokenizer_path: str, pattern: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Append the token count of each whole text as long.

    Null and empty texts count 0. Rows are independent: repeated rows keep their own counts, an empty table stays
    empty, other columns are kept and one named like `out` is replaced. The vocabulary and the proven set are
    broadcast; both have the vocabulary's size, whatever the corpus.
    """
    with open(tokenizer_path, "rb") as f:
        raw = f.read()
    basic = basic_plane(pattern)
    shared = df.sparkSession.sparkContext.broadcast((hash(raw), raw, basic, Counter(raw, pattern, basic).whole))

    def make():
        key, raw, basic, whole = shared.value
        own = held(("count", key, pattern), lambda: Counter(raw, pattern, basic, whole))
        return lambda batch: [pa.array([own.count(t) for t in texts(batch, text)], type=pa.int64())]

    return map_rows(df, [T.StructField(out, T.LongType())], make)


def n_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text, null as empty."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
