"""Best-two-fit packing of tokenized documents into sequences of a fixed capacity.

What a packing needs to know of a corpus is how many pieces of each length it has: at most `capacity` counts, whatever
the corpus. The plan is made from these counts: a sequence is filled greedily, the longest piece that fits the gap next;
then its smallest piece gives way to two unpacked ones that fill the widened gap more tightly. The same filling is used
as often as the counts allow, so the plan is a bounded list of fillings with their multiples, and no task ever holds
the corpus. The pieces of each length are then numbered over the cluster, in buckets whose sizes are summed up, and the
number decides the sequence and the place in it.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, held, make_importable, quoted, stored

#: Entries of each of the memo's two generations: a word and its packed ids.
MEMO_SIZE = 300_000
#: A bucket of pieces of one length holds this share of all pieces, and no more than so many.
SHARE, BUCKET = 1000, 1_000_000
_PIECES = T.StructType([T.StructField(c, T.LongType()) for c in ("row", "doc_id", "start", "length", "ids_crc32")] + [T.StructField("piece", T.IntegerType())])


#: ASCII punctuation but the apostrophe, after an ASCII letter or digit: a token ends between them.
_TAIL = re.compile(rb"[!-&(-/:-@\[-`{-~](?<=[A-Za-z0-9].)")
#: What no text is folded with: the first two characters of the special tokens' strings.
_SPECIAL = b"<|"


class WordEncoder:
    """Ids of whole texts by the tokenizers library, remembered by word.

    Every step of these tokenizers (composition, folding, splitting, added tokens) ends at ASCII white space, which yields no
    token, so a text's ids are those of its words in a row; where the tokenizer allows, A-Z are lower-cased and punctuation
    is split off words first, which leaves the ids alone. The library itself encodes every word that is not in the memo,
    many at once with a special token between them.
    """

    def __init__(self, raw: bytes) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_buffer(raw)
        self.folds = word_by_word(raw)[1]
        self.special = next((i, t.content) for i, t in self.library.get_added_tokens_decoder().items() if t.content.encode().startswith(_SPECIAL))
        self.memo = Memo(self.word_ids, MEMO_SIZE)

    def word_ids(self, word: bytes) -> bytes:
        return np.array(self.library.encode(word.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, words: list[bytes]) -> None:
        """Words without special strings into the memo."""
        mark, between = self.special
        for at in range(0, len(words), 128):
            part = words[at : at + 128]
            ids = np.array(self.library.encode(between.join(map(bytes.decode, part)), add_special_tokens=False).ids, dtype="<u4")
            ends = [0, *(4 * np.flatnonzero(ids == mark)).tolist(), 4 * len(ids)]
            packed = ids.tobytes()
            for k, word in enumerate(part):
                self.memo.put(word, packed[ends[k] + 4 * (k > 0) : ends[k + 1]])

    def packed(self, text: str) -> bytes:
        data = text.encode()
        if _SPECIAL in data:
            return b"".join(map(self.memo.__getitem__, data.split()))
        words = (_TAIL.sub(rb" \g<0>", data.lower()) if self.folds else data).split()
        if unknown := self.memo.unknown(words):
            self.learn(unknown)
        return b"".join(map(self.memo.__getitem__, words))


@lru_cache(2)
def word_by_word(raw: bytes) -> tuple[bool, bool]:
    """Whether a tokenizer drops white space and cuts at it, and whether it also folds A-Z and cuts before punctuation after letters and digits: tried on every pair of kinds."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_buffer(raw)

    def ids(texts: list[str]) -> list[list[int]]:
        return [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]

    def apart(left: list[str], right: list[str], between: tuple[str, ...]) -> bool:
        one, two = ids(left), ids(right)
        whole = ids([x + s + y for x in left for y in right for s in between])
        return whole == [a + b for a in one for b in two for _ in between]

    words = ["a", "Ab", "'s", "1", ".", "é", "漢", "\u0301", "\u0338"] + [t.content for t in library.get_added_tokens_decoder().values()]
    spaces = apart(words, words, (" ", "\n", "\t", " \r\n", "\x0b", "\x0c"))
    alnum, marks = [c for c in map(chr, range(48, 123)) if c.isalnum()], [c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'"]
    folded = ids(["x" + c for c in alnum]) == ids(["x" + c.lower() for c in alnum])
    return spaces, spaces and folded and apart(alnum, [m + x for m in marks for x in ("", "a", "'s", "é", "\u0338", ".")], ("",))


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, doc_id: str, text: str) -> DataFrame:
    """(row, doc_id, start, length, ids_crc32, piece), row numbering all pieces uniquely: texts never leave their partition."""
    with open(tokenizer_path, "rb") as f:
        raw = f.read()
    if not word_by_word(raw)[0]:
        raise ValueError("this tokenizer's tokens may span words")
    shared = docs.sparkSession.sparkContext.broadcast((hash(raw), raw))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, raw = shared.value
        own = held(("words", key), lambda: WordEncoder(raw))
        last, row = np.array([end_id], dtype="<u4").tobytes(), TaskContext.get().partitionId() << 40
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = own.packed(t or "") + last
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for c, x in zip(columns, (row, doc, at // 4, len(part) // 4, zlib.crc32(part), piece)):
                        c.append(x)
                    row += 1
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.int32())], names=_PIECES.names)

    return docs.select(quoted(doc_id).cast("long").alias("doc_id"), F.coalesce(quoted(text), F.lit("")).alias("text")).mapInArrow(run, _PIECES)


def _filling(have: np.ndarray, capacity: int, two: bool = True) -> dict[int, int]:
    """One sequence: length to number of pieces, by greed alone unless two. have (pieces by length) is not changed."""
    have = have.copy()
    here: dict[int, int] = {}

    def take(length: int, times: int = 1) -> None:
        have[length] -= times
        here[length] = here.get(length, 0) + times

    lengths, gap = np.flatnonzero(have), capacity
    while gap and (at := np.searchsorted(lengths, gap, side="right")):
        length = int(lengths[at - 1])
        times = min(gap // length, int(have[length]))
        take(length, times)
        gap -= times * length
        lengths = lengths[: at - 1]
    while two and gap:
        smallest = min(here)
        room = gap + smallest
        fits = have[: room + 1] > 0
        # For every length x the greatest that is unpacked and at most x, 0 if none.
        floor = np.maximum.accumulate(np.where(fits, np.arange(room + 1), 0))
        one = np.flatnonzero(fits)
        other = floor[room - one]
        twice = (other == one) & (have[one] < 2)
        other[twice] = floor[one[twice] - 1]
        both = np.where(other > 0, one + other, 0)
        if not len(both) or both.max() <= smallest:
            break
        best = int(both.argmax())
        here[smallest] -= 1
        have[smallest] += 1
        if not here[smallest]:
            del here[smallest]
        take(int(one[best]))
        take(int(other[best]))
        gap = room - int(both[best])
    return here


def plan(counts: np.ndarray, capacity: int) -> np.ndarray:
    """The packing of counts[length] pieces as rows (length, first number, times in a sequence, first sequence, offset), sorted by the first two.

    Where the swaps of two for one leave more sequences than greed alone, which few large pieces can bring about, greed's plan is taken.
    """
    sequences, runs = min((_planned(counts, capacity, two) for two in (True, False)), key=lambda x: x[0])
    out = np.array(runs, dtype=np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def _planned(counts: np.ndarray, capacity: int, two: bool) -> tuple[int, list[tuple]]:
    """The number of sequences and the plan's rows.

    A filling's repeats use up one of its lengths down to less than that filling takes, so there are at most
    capacity * (1 + ln capacity) fillings, each with at most sqrt(2 * capacity) different lengths, whatever the counts.
    """
    have, used, runs, sequence = counts.astype(np.int64).copy(), np.zeros(capacity + 1, np.int64), [], 0
    while have.any():
        here = _filling(have, capacity, two)
        times = min(int(have[length]) // n for length, n in here.items())
        offset = 0
        for length in sorted(here, reverse=True):
            n = here[length]
            runs.append((length, used[length], n, sequence, offset))
            used[length] += n * times
            have[length] -= n * times
            offset += n * length
        sequence += times
    return sequence, runs


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every document's tokens and end_id, packed into sequences of at most `capacity`.

    Null and empty texts are the end id alone. Only documents over the capacity are cut, into full pieces and a last one
    that may be shorter. Rows are documents of their own, also those that share an id or have none; an empty table gives
    an empty result; other columns are ignored. In a sequence the offsets leave no gap from 0. ids_crc32 is that of the
    little-endian 32-bit ids. The driver sees one count for each length.
    """
    spark = docs.sparkSession
    make_importable(spark)
    cut = stored(pieces(docs, tokenizer_path, capacity, end_id, doc_id, text))
    counted = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    counts = np.zeros(capacity + 1, np.int64)
    counts[list(counted)] = list(counted.values())
    most = min(BUCKET, max(1, int(counts.sum()) // SHARE))
    sizes = spark.createDataFrame([(k, math.ceil(n / most)) for k, n in counted.items()], "length long, buckets long")
    dealt = cut.join(F.broadcast(sizes), "length").withColumn("bucket", F.pmod(F.xxhash64("row"), F.col("buckets")))
    before = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = before.select("length", "bucket", (F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = F.row_number().over(W.partitionBy("length", "bucket").orderBy("row"))
    numbered = dealt.withColumn("inside", inside).join(before, ["length", "bucket"]).withColumn("number", F.col("before") + F.col("inside") - 1)
    shared = spark.sparkContext.broadcast(plan(counts, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        keys = runs[:, 0] << 48 | runs[:, 1]
        for batch in batches:
            columns = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            length, number = columns["length"].to_numpy(), columns["number"].to_numpy()
            run = runs[np.searchsorted(keys, length << 48 | number, side="right") - 1] if batch.num_rows else np.empty((0, 5), np.int64)
            rest = number - run[:, 1]
            sequence, offset = run[:, 3] + rest // np.maximum(run[:, 2], 1), run[:, 4] + rest % np.maximum(run[:, 2], 1) * length
            yield pa.RecordBatch.from_arrays([columns[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(sequence), pa.array(offset)], names=_PACKED.names)

    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(place, _PACKED)


_PACKED = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "sequence_id", "offset"))]
)
