import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import sentencepiece
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postcheck.llm import alignment, lexical, packing
from postcheck.llm.queries import ORACLE_SQL, PIECES, TOKENIZER, WORDS

ODD = [None, "", " ", "\n\n", "a", "A a  a", "Ärger ärger ÄRGER", "x" * 9000, "naïve 漢字 🥚", "don't\tstop\r\n now );\r x", "\x1c.\x1d a\x85b\xa0c", "<|endoftext|> <s>", "ends  ", "▁ underscore", "é ́x", " lead"]


def _texts(seed: int, n: int, words: int = 60) -> list[str]:
    draw = random.Random(seed)
    pool = ["".join(draw.choice("abcdeéñ漢") for _ in range(draw.randint(1, 4))) for _ in range(90)]
    return [draw.choice([" ", "\n", "  "]).join(draw.choice(pool) for _ in range(draw.randint(1, words))) + draw.choice(["", ".", "!\n"]) for _ in range(n)]


def _search(docs: list, items: list, k: int) -> list:
    """The ranking straight from its definition."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(d, Counter(split(t))) for d, t in docs if d is not None]
    held = [(d, c) for d, c in held if c]
    total, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked, out = defaultdict(set), []
    for i, t in items:
        if i is not None:
            asked[i].update(split(t))
    for i, terms in asked.items():
        scores = []
        for d, c in held:
            m = 50 + 50 * sum(c.values()) * total // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                scores.append((-score, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_search_equals_definition(spark, monkeypatch, small):
    if small:  # many blocks, many batches of items, many rounds
        for name, value in (("BLOCK", 16), ("BATCH", 40), ("FIRST_DEPTH", 1), ("DEEPER", 2)):
            monkeypatch.setattr(lexical, name, value)
    texts = _texts(1, 150) + ODD
    docs = [*enumerate(texts), *((900 + i, texts[3]) for i in range(40)), (3, texts[3]), (3, texts[4]), (None, texts[5])]
    items = [(i, t) for i, t in enumerate(_texts(2, 12, 15))] + [(50, None), (51, "zzz9"), (None, "a"), (1, texts[3]), (52, texts[7] + " a")]
    left = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "terms", "score", "item_id")}).repartition(3)
    right = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    got = sorted(tuple(r) for r in lexical.ranked_search(left, right, k=7).collect())
    assert got == _search(docs, items, 7)


def test_search_sql_and_empty_tables(spark, tmp_path):
    docs, items = list(enumerate(_texts(4, 80) + ODD)), list(enumerate(_texts(5, 6, 12)))
    for name, rows, key in (("documents", docs, "doc_id"), ("benchmark", items, "item_id")):
        spark.createDataFrame(rows, f"{key} long, text string").write.parquet(f"{tmp_path}/{name}.parquet")
        duckdb.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(duckdb.sql(ORACLE_SQL["op11_ranked_search"]).fetchall()) == _search(docs, items, 50)
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame(items, "item_id long, text string")
    assert lexical.ranked_search(none, some).count() == 0
    assert lexical.ranked_search(none.union(spark.createDataFrame(docs, none.schema)), some.limit(0)).count() == 0


def test_nra_stops_early_and_settles_scores():
    # One document leads both lists by far: the rest of them stays unread.
    rows = 50_000
    impacts = np.concatenate([[10**6], np.sort(np.random.default_rng(1).integers(1, 100, rows - 1))[::-1]])
    left, scores, read = lexical.nra([(np.arange(rows), impacts), (np.arange(rows), impacts)], rows, 1)
    assert left.tolist() == [0] and scores.tolist() == [2 * 10**6] and read < 2000
    # Two documents of one score: both stay.
    left, scores, _ = lexical.nra([(np.array([0, 1, 2]), np.array([5, 5, 1]))], 3, 1)
    assert left.tolist() == [0, 1] and scores.tolist() == [5, 5]
    assert not len(lexical.nra([(np.array([0, 1]), np.array([5, 4]))], 2, 1, floor=6)[0])


def test_packing_keeps_every_token_and_wastes_little(spark):
    texts = [*ODD, *_texts(6, 400, 40), "ab " * 3000, "q" * 700, "漢 " * 700]
    docs = [*enumerate(texts), (3, texts[30]), (3, texts[30]), (None, "a b")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(-1) for c in ("piece", "length", "row", "number", "bucket")})
    rows = packing.pack(frame.repartition(3), WORDS, capacity=512, end_id=1).collect()
    library, want, total = Tokenizer.from_file(WORDS), Counter(), 0
    for d, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        for k, at in enumerate(range(0, len(ids), 512)):
            part = ids[at : at + 512]
            want[d, k, at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 512
    assert len(bins) <= -(-total // 512) + 1


def test_two_documents_replace_the_smallest():
    # 60 + 30 leaves 10; 30 gives way to 25 + 15.
    counts = np.zeros(101, np.int64)
    counts[[60, 30, 25, 15]] = 1
    assert packing._filling(counts, 100) == {60: 1, 25: 1, 15: 1}
    counts[[25, 15]] = 0, 2  # one length twice
    counts[30] = 2
    assert packing._filling(counts, 90) == {60: 1, 30: 1}
    assert packing._filling(counts, 95) == {60: 1, 30: 1}
    for seed in range(60):
        draw = np.random.default_rng(seed)
        capacity = int(draw.integers(1, 80))
        counts = np.concatenate([[0], draw.integers(0, 9, capacity) * draw.integers(0, 2, capacity)])
        used, gaps = np.zeros(capacity + 1, int), defaultdict(int)
        for length, first, times, sequence, _ in packing.plan(counts, capacity):
            assert first == used[length]
            after = [f for k, f, *_ in packing.plan(counts, capacity) if k == length and f > first]
            n = (after[0] if after else counts[length]) - first
            used[length] += n
            for x in range(n):
                gaps[sequence + x // times] += length
        assert (used == counts).all() and all(0 < x <= capacity for x in gaps.values())
        # Never worse than first-fit decreasing.
        bins: list[int] = []
        for length in [k for k in range(capacity, 0, -1) for _ in range(counts[k])]:
            at = next((i for i, x in enumerate(bins) if x + length <= capacity), None)
            bins.append(length) if at is None else bins.__setitem__(at, bins[at] + length)
        assert len(gaps) <= len(bins)


def test_words_are_encoded_as_the_library_does():
    raw, draw = open(WORDS, "rb").read(), random.Random(4)
    assert packing.word_by_word(raw) == (True, True) and packing.word_by_word(open(TOKENIZER, "rb").read()) == (False, False)
    own, library = packing.WordEncoder(raw), Tokenizer.from_file(WORDS)
    pool = [*" \n\t\x1c\x85\xa0.,;'-&=_aAbZ019éÉßİΣσ漢²\u0301\u0338🥚", "'S", "don't", "<|endoftext|>", "<|EndOfText|>"]
    for _ in range(4000):
        text = "".join(draw.choice(pool) for _ in range(draw.randint(1, 16)))
        assert np.frombuffer(own.packed(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_packing_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), WORDS).count() == 0


def _links(text: str | None, a, b, a_bytes, b_bytes):
    """Tokens, groups and links of a whole text, straight from the definition."""
    if not text:
        return None
    left, right = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw = (" " + text).encode()
    if b"".join(a_bytes[i] for i in left) != raw or b"".join(b_bytes[i] or b"" for i in right) != raw:
        return None
    spans = [np.cumsum([0, *(len(names[i]) for i in ids)]).tolist() for ids, names in ((left, a_bytes), (right, b_bytes))]
    ends = sorted(set(spans[0][1:]) & set(spans[1][1:]))
    groups, at = [], 0
    for end in ends:
        groups.append("|".join(",".join(str(i) for i, x, y in zip(ids, span, span[1:]) if at <= x and y <= end) for ids, span in ((left, spans[0]), (right, spans[1]))))
        at = end
    pairs = [(i, j) for i, x, y in zip(left, spans[0], spans[0][1:]) for j, u, v in zip(right, spans[1], spans[1][1:]) if x < v and u < y]
    return len(left), len(right), len(ends), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest()


@pytest.mark.parametrize("head", [alignment.HEAD, 40, 0])
def test_alignment_equals_definition(spark, monkeypatch, head):
    monkeypatch.setattr(alignment, "HEAD", head)
    texts = [*ODD[:7], *ODD[8:], *_texts(8, 60, 30), "aaaaaaaaaaaaaaaa aaa aaaaa", "antidisestablishmentarianism " * 4, "x" * 400, "\t\tif (x) {\r\n\r\n  y();\r\n}", "　wide　space m"]
    docs = [*enumerate(texts), (3, texts[30]), (None, texts[31])] + [(700 + i, texts[29]) for i in range(20)]
    a, b = Tokenizer.from_file(TOKENIZER), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    names = alignment.bytes_of_a(open(TOKENIZER, "rb").read()), alignment.bytes_of_b(b)
    found = [(d, _links(t, a, b, *names)) for d, t in docs]
    count = Counter(p for _, x in found if x for p in set(x[3]))
    best: dict[int, int] = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    want = Counter((d, 0, 0, 0, 0, 0, 0, "") if x is None else (d, *x[:3], len(x[3]), sum(count[p] == best[p[0]] for p in x[3]), sum(count[p] for p in x[3]), x[4]) for d, x in found)
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("?") for c in ("row", "pairs", "same", "n_a", "groups")})
    rows = alignment.align(frame.repartition(3), TOKENIZER, PIECES).collect()
    assert Counter(tuple(r)[:8] for r in rows) == want
    assert all(r["groups_sha256"] == (hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") for r in rows)


def test_segments_stand_alone():
    own = alignment.Aligner(open(TOKENIZER, "rb").read(), open(PIECES, "rb").read())
    draw = random.Random(9)
    for _ in range(6000):
        text = "".join(draw.choice(" \n\t\r\x0b\x1c\x85\xa0 ab.;)é漢'sA1_-ß²\u0301") for _ in range(draw.randint(1, 14)))
        parts = own.segments(" " + text)
        assert "".join(parts) == " " + text
        assert [i for x in own.b_ids(parts) for i in x] == own.b.encode(text)
        assert [i for p in parts for i in own.a.encode(p, add_special_tokens=False).ids] == own.a.encode(" " + text, add_special_tokens=False).ids


def test_alignment_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER, path("piece_bpe_32k.model")).count() == 0
