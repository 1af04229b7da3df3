"""Cross-tokenizer alignment with an identity-map fast path.

Two tokenizers cut the same bytes differently. Where tokens of both end at one offset, the text falls into groups; a
token of one is linked to each of the other that shares a byte with it. Most groups hold one token of either kind and
the same bytes, so a fixed array maps each A id to the B id of its bytes: links that follow it are counted in vectors of
the vocabulary's length, one for each task, and only the other pairs enter a shuffle.

Neither tokenizer has a token across the place where white space follows something else, or punctuation a letter or digit;
for the pattern of one that is plain, for the pieces of the other it is proven from the vocabulary, character by
character. Texts are therefore cut there and each worker remembers the alignment of the segments in a bounded memo.

The pairs' counts are needed again with each document. The most frequent ones, at most HEAD, are broadcast; the others
occur in few documents each, whatever the corpus, and are joined, so no key of that join is hot.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, held, make_importable, quoted, stored
from .token_counts import byte_of

#: Entries of each of the memo's two generations.
MEMO_SIZE = 300_000
#: Pairs whose counts are broadcast: 16 bytes each.
HEAD = 1 << 19
#: Two ids make one pair key.
SHIFT = 24
#: Levels of a doubling of the counts, by which the broadcast pairs are chosen.
LEVELS = 16
_SPACE_PIECE = "▁"


class Aligner:
    """Both tokenizers, the map of ids with the same bytes, and the alignment of segments."""

    def __init__(self, raw_a: bytes, raw_b: bytes) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(raw_a)
        self.a.encode_special_tokens = True
        self.joined = Tokenizer.from_buffer(raw_a)
        self.mark, self.between = next((i, t.content) for i, t in self.joined.get_added_tokens_decoder().items() if t.special)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=raw_b)
        self.a_bytes, self.b_bytes = bytes_of_a(raw_a), bytes_of_b(self.b)
        named = {}
        for i in reversed(range(len(self.b_bytes))):
            # Of two B ids with the same bytes, a plain piece goes before a single byte's stand-in.
            if not (self.b.is_byte(i) and self.b_bytes[i] in named):
                named[self.b_bytes[i]] = i
        self.same = np.array([named.get(x, -1) for x in self.a_bytes], dtype=np.int64)
        self.a_long, self.b_long = list(map(len, self.a_bytes)), list(map(len, self.b_bytes))
        self.a_text, self.b_text = list(map(str, range(len(self.a_bytes)))), list(map(str, range(len(self.b_bytes))))
        self.space = self.b.piece_to_id(_SPACE_PIECE)
        safe, marks = cutting_spaces(self.b), "".join(map(re.escape, sorted(cutting_marks(self.b))))
        self.odd = re.compile("[" + "".join(re.escape(c) for c in map(chr, range(0x3001)) if c.isspace() and c not in safe) + "]").search
        self.cut = re.compile(rf"(?<=\S)(?=[{''.join(map(re.escape, sorted(safe)))}])").split
        stop = rf"(?=[{marks}])|" if marks else ""
        self.plain = re.compile(rf"\s*+(?:[{_LATIN}]++(?:{stop}\S*)|\S+)|\s+").findall
        self.memo = Memo(self.aligned, MEMO_SIZE)

    def segments(self, text: str) -> list[str]:
        """Parts of a text that starts with a space which both tokenizers encode by themselves."""
        return self.plain(text) if self.odd(text) is None else self.cut(text)

    def b_ids(self, segments: list[str]) -> list[list[int]]:
        """B's ids of segments inside a text. The library puts a space before what it encodes: the segment's own, or one that is taken off again where it can be told apart."""
        out = self.b.encode([x[1:] if x[0] == " " else x if x[0].isspace() else "\n" + x for x in segments], num_threads=1)
        return [[self.space] if x == " " else ids if x[0] == " " else ids[1 if x[0].isspace() else 2 :] for x, ids in zip(segments, out)]

    def aligned(self, segment: str) -> tuple[str, bytes, int, int] | None:
        return self.matched(segment, self.a.encode(segment, add_special_tokens=False).ids, self.b_ids([segment])[0])

    def learn(self, segments: list[str]) -> None:
        """Segments into the memo, many at once: A encodes them with a special token between, which ends what it splits."""
        plain = [x for x in segments if self.between not in x]
        for at in range(0, len(plain), 128):
            part = plain[at : at + 128]
            ids, begin = self.joined.encode(self.between.join(part), add_special_tokens=False).ids, 0
            ids.append(self.mark)
            for segment, b in zip(part, self.b_ids(part)):
                end = ids.index(self.mark, begin)
                self.memo.put(segment, self.matched(segment, ids[begin:end], b))
                begin = end + 1

    def parts(self, text: str) -> list[tuple[str, bytes, int, int] | None]:
        """The alignments of a text's segments."""
        segments = self.segments(" " + text)
        if unknown := self.memo.unknown(segments):
            self.learn(unknown)
        return list(map(self.memo.__getitem__, segments))

    def matched(self, segment: str, a: list[int], b: list[int]) -> tuple[str, bytes, int, int] | None:
        """Groups as text, the links' keys, and both numbers of tokens; None where a side's bytes are not the segment's."""
        raw = segment.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        a_long, b_long, a_text, b_text = self.a_long, self.b_long, self.a_text, self.b_text
        i = j = 0
        x, y = a[0], b[0]
        left, right, end_i, end_j = a_text[x], b_text[y], a_long[x], b_long[y]
        groups, links, last = [], [], len(raw)
        while True:
            links.append(x << SHIFT | y)
            if end_i == end_j:
                groups.append(f"{left}|{right}")
                if end_i == last:
                    return ";".join(groups), pack(f"<{len(links)}q", *links), len(a), len(b)
                i, j = i + 1, j + 1
                x, y = a[i], b[j]
                left, right = a_text[x], b_text[y]
                end_i += a_long[x]
                end_j += b_long[y]
            elif end_i < end_j:
                i += 1
                x = a[i]
                left = f"{left},{a_text[x]}"
                end_i += a_long[x]
            else:
                j += 1
                y = b[j]
                right = f"{right},{b_text[y]}"
                end_j += b_long[y]


def bytes_of_a(raw: bytes) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; of an added token, those of its string."""
    spec, stand_in = json.loads(raw), byte_of()
    out = {i: bytes(stand_in[c] for c in s) if all(c in stand_in for c in s) else s.encode() for s, i in spec["model"]["vocab"].items()}
    out |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens", []) if t["id"] not in out}
    return [out.get(i, b"") for i in range(max(out) + 1)]


#: Stands for a piece that is no text: bytes that no text holds.
_NO_TEXT = b"\xff\xfe\xff"


def bytes_of_b(model) -> list[bytes]:
    """The bytes of each piece; control pieces and the unknown one have some that no text holds."""
    out: list[bytes] = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        plain = piece.replace(_SPACE_PIECE, " ").encode()
        out.append(_NO_TEXT if model.is_control(i) or model.is_unknown(i) else bytes([int(piece[1:-1], 16)]) if model.is_byte(i) else plain)
    return out


def cutting_spaces(model) -> frozenset[str]:
    """The white space before which, after something else, no piece of B can go on: it stands inside no piece but in runs of plain spaces."""
    inside = set()
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if not model.is_byte(i):
            piece = piece.replace(_SPACE_PIECE, " ").lstrip(" ") if set(piece) != {_SPACE_PIECE} else ""
            inside.update(piece[1:] if not model.id_to_piece(i).startswith(_SPACE_PIECE) else piece)
    # Separators U+001C to U+001F are white space to this language's engine only.
    return frozenset(c for c in map(chr, range(0x3001)) if c.isspace() and not 0x1C <= ord(c) <= 0x1F and c not in inside)


#: Latin letters and digits as a class of characters: what punctuation is cut off from.
_LATIN = "0-9A-Za-zÀ-ÖØ-öø-ɏ"


def cutting_marks(model) -> frozenset[str]:
    """The ASCII punctuation, but for the apostrophe, that follows a Latin letter or digit inside no piece of B."""
    latin = re.compile(f"[{_LATIN}]").match
    inside = set()
    for i in range(model.get_piece_size()):
        if not model.is_byte(i):
            piece = model.id_to_piece(i)
            inside.update(y for x, y in zip(piece, piece[1:]) if latin(x))
    return frozenset(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'" and c not in inside)


_LISTS = [T.StructField(c, T.ArrayType(t)) for c, t in (("same", T.IntegerType()), ("same_n", T.IntegerType()), ("pairs", T.LongType()), ("pairs_n", T.IntegerType()))]
_ALIGNED = T.StructType([*(T.StructField(c, T.LongType()) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links")), T.StructField("groups_sha256", T.StringType()), T.StructField("groups", T.StringType()), *_LISTS])


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64), kind))


def _align(shared, texts: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each document's alignment; the task's last row, without a row number, holds its vector of identity counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, raw_a, raw_b = shared.value
        own = held(("align", key), lambda: Aligner(raw_a, raw_b))
        # Nothing here makes cycles, and the memo's many entries would be walked again and again in search of some.
        gc.disable()
        vector, row, none = np.zeros(len(own.same), np.int64), TaskContext.get().partitionId() << 40, np.empty(0, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                numbers, digests, groups, lists = [], [], [], ([], [], [], [])
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    parts = own.parts(text) if text else [None]
                    if None in parts:
                        numbers.append((row, doc, 0, 0, 0, 0))
                        digests.append("")
                        groups.append("")
                        for x in lists:
                            x.append(none)
                    else:
                        cut, links, n_a, n_b = zip(*parts)
                        cut = ";".join(cut)
                        links = np.frombuffer(b"".join(links), dtype="<i8")
                        pairs, n = np.unique(links, return_counts=True)
                        a = pairs >> SHIFT
                        same = own.same[a] == pairs & (1 << SHIFT) - 1
                        vector[a[same]] += 1
                        numbers.append((row, doc, sum(n_a), sum(n_b), cut.count(";") + 1, len(links)))
                        digests.append(hashlib.sha256(cut.encode()).hexdigest())
                        groups.append(cut if texts else None)
                        for x, part in zip(lists, (a[same], n[same], pairs[~same], n[~same])):
                            x.append(part)
                    row += 1
                columns = [pa.array(x, pa.int64()) for x in zip(*numbers)]
                columns += [pa.array(digests, pa.string()), pa.array(groups, pa.string())]
                columns += [_lists(x, kind) for x, kind in zip(lists, (pa.int32(), pa.int32(), pa.int64(), pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=_ALIGNED.names)
        used = np.flatnonzero(vector)
        empty = [pa.nulls(1, pa.int64())] * 6 + [pa.nulls(1, pa.string())] * 2
        yield pa.RecordBatch.from_arrays([*empty, _lists([used], pa.int32()), _lists([none], pa.int32()), _lists([vector[used]], pa.int64()), _lists([none], pa.int32())], names=_ALIGNED.names)

    return run


def _scored(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums over the links whose counts are broadcast; the other pairs stay with the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, same, best = shared.value
        for batch in batches:
            column = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            flat = {c: column[c].flatten().to_numpy() for c in ("same", "same_n", "pairs", "pairs_n")}
            document = {c: np.repeat(np.arange(batch.num_rows), column[c].value_lengths().to_numpy(zero_copy_only=False)) for c in ("same", "pairs")}
            n_best, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)

            def add(rows: np.ndarray, a: np.ndarray, count: np.ndarray, n: np.ndarray) -> None:
                np.add.at(total, rows, count * n)
                np.add.at(n_best, rows, np.where(count == best[a], n, 0))

            add(document["same"], flat["same"], same[flat["same"]], flat["same_n"])
            at = np.searchsorted(known, flat["pairs"])
            found = np.zeros(len(at), bool)
            if len(known):
                at = np.minimum(at, len(known) - 1)
                found = known[at] == flat["pairs"]
                add(document["pairs"][found], flat["pairs"][found] >> SHIFT, counts[at[found]], flat["pairs_n"][found])
            rest = np.cumsum([0, *np.bincount(document["pairs"][~found], minlength=batch.num_rows)], dtype=np.int32)
            left = [pa.ListArray.from_arrays(pa.array(rest), pa.array(flat[c][~found], kind)) for c, kind in (("pairs", pa.int64()), ("pairs_n", pa.int32()))]
            names = [c for c in batch.schema.names if c not in flat]
            yield pa.RecordBatch.from_arrays([*(column[c] for c in names), pa.array(n_best), pa.array(total), *left], names=[*names, "n_best", "count_sum", "pairs", "pairs_n"])

    return run


def align(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", groups: bool = True) -> DataFrame:
    """One row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and the groups themselves as text unless left out.

    A encodes a space and the text, B the text, to which it adds the space; strings of special tokens are plain text. A pair's
    count is the number of rows that hold it linked; n_best counts the links whose count is the highest of their A id, ties
    included, count_sum adds the counts over all links. Null and empty texts, and those whose tokens' bytes are not the
    text's on either side, have zeros and empty groups, and lend no counts. Rows that share an id or have none
    are documents of their own; other columns are ignored; an empty table gives an empty result; long texts are read whole.
    """
    spark = docs.sparkSession
    make_importable(spark)
    raw = []
    for path in (path_a, path_b):
        with open(path, "rb") as f:
            raw.append(f.read())
    shared = spark.sparkContext.broadcast((hash(tuple(raw)), *raw))
    all_rows = stored(docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text")).mapInArrow(_align(shared, groups), _ALIGNED))
    aligned = all_rows.where("row is not null")
    zipped = lambda a, b: F.explode(F.arrays_zip(F.col(a).alias("k"), F.col(b).alias("n"))).alias("x")
    same = all_rows.where("row is null").select(zipped("same", "pairs")).groupBy(F.col("x.k").cast("long").alias("a")).agg(F.sum("x.n").alias("count"))
    pairs = stored(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count")).withColumn("level", F.floor(F.log2("count") * LEVELS).cast("int")))
    a = F.shiftright("pair", SHIFT).alias("a")
    best = stored(same.union(pairs.select(a, "count")).groupBy("a").agg(F.max("count").alias("best")))
    # Both vectors and the levels are bounded by the vocabulary and by the bits of a count.
    by_level = sorted(((r["level"], r["n"]) for r in pairs.groupBy("level").agg(F.count("*").alias("n")).collect()), reverse=True)
    lowest, taken = 1 << 30, 0
    for level, n in by_level:
        if taken + n > HEAD:
            break
        lowest, taken = level, taken + n
    head = pairs.where(F.col("level") >= lowest).select("pair", "count").toArrow().sort_by("pair")
    size = len(bytes_of_a(raw[0]))
    vectors = []
    for table, name in ((same, "count"), (best, "best")):
        got = table.toArrow()
        vector = np.zeros(size, np.int64)
        vector[got["a"].to_numpy()] = got[name].to_numpy()
        vectors.append(vector)
    known = spark.sparkContext.broadcast((head["pair"].to_numpy(), head["count"].to_numpy(), *vectors))
    sums = [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())]
    scored = aligned.mapInArrow(_scored(known), T.StructType([*_ALIGNED.fields[:8], *sums, *_LISTS[2:]]))
    if taken < sum(n for _, n in by_level):
        scored = stored(scored)
        rare = pairs.where(F.col("level") < lowest).withColumn("a", a).join(F.broadcast(best), "a").select("pair", "count", "best")
        met = scored.select("row", zipped("pairs", "pairs_n")).select("row", F.col("x.k").alias("pair"), F.col("x.n").alias("n")).join(rare, "pair")
        more = met.groupBy("row").agg(F.sum(F.col("count") * F.col("n")).alias("more_sum"), F.sum(F.when(F.col("count") == F.col("best"), F.col("n")).otherwise(0)).alias("more_best"))
        scored = scored.join(more, "row", "left").withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0)))
        scored = scored.withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0)))
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if groups else []))
