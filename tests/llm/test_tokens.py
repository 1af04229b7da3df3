import base64
import hashlib
import random
from array import array

import tiktoken
from public_tokenizers import PATTERN, path
from tokenizers import Tokenizer

from postcheck.llm import bpe, common, token_counts
from postcheck.llm.queries import RANKS, TOKENIZER

TEXTS = [
    "", " ", "Hello world's  end\n\n\tx", "naïve façade 漢字 🥚🥚", "a" * 3000, "ab" * 5000 + " " * 500, "l0ser!!! <|endoftext|> b", "<|endoftext|><|endoftext|>",
    "\x1c\x85   mixed　space", "x" * 70 + "1234567890" * 9, "'s 't 're 'LL don't",
]


def _noise(seed: int) -> str:
    draw = random.Random(seed)
    return "".join(draw.choice("aAbcdeéßñ漢 \n\t.,!01'") for _ in range(draw.randint(1, 400)))


def _library() -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encode_equals_library_and_decodes(spark):
    texts = TEXTS + [_noise(i) for i in range(60)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(900, None, None), (900, None, None), (None, "a b", "y")], "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df, RANKS, PATTERN, decoded="both"), RANKS).collect()
    assert len(out) == len(texts) + 3
    library = _library()
    for r in out:
        assert r["ids"] == library.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == bytes(r["both"]) == (r["text"] or "").encode()


def test_every_character_splits_as_the_library_does():
    own, library = bpe.RankEncoder(open(RANKS, "rb").read(), PATTERN), _library()
    for c in [*range(0x3100), *range(0xFE00, 0xFF00), *range(0x1F300, 0x1F400)]:
        s = f"a{chr(c)} b{chr(c)}{chr(c)}1"
        assert own.encode(s).tolist() == library.encode_ordinary(s)


def test_both_engines_split_alike():
    pieces = bpe.Splitter(PATTERN, bpe.basic_plane(PATTERN))
    plane = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x10000)]]
    draw = random.Random(3)
    for form in ("a{0}b", "{0}{0} {0}", " {0}\n {0}", "1{0}'s{0}"):
        for at in range(0, len(plane), 64):
            text = "".join(form.format(c) for c in plane[at : at + 64])
            assert pieces.basic(text) == pieces.any(text) == pieces(text)
    for _ in range(3000):  # triples of every kind
        text = "".join(draw.choice("aZé漢 \t\n\x1c\x85\u200b\u3000.'!s1²٣_\u0301") for _ in range(draw.randint(1, 12)))
        assert pieces.basic(text) == pieces.any(text)
    assert pieces("a𝒳𝒳 1🥚") == pieces.any("a𝒳𝒳 1🥚")
    assert bpe.basic_plane(r"(?i:'s)|\p{L}+") is None and bpe.basic_plane(r"\w+") is None


def test_scanned_merges_equal_the_queue():
    own = token_counts.Counter(open(TOKENIZER, "rb").read(), PATTERN)
    for i in range(300):
        ids = [own.byte_id[b] for b in _noise(i).encode()]
        assert token_counts.scan_merge(list(ids), own.pair, own.product) == bpe.merge(list(ids), own.pair, own.product, own.queue)


def test_workers_keep_one_operator():
    assert common.held("a", lambda: [1]) is common.held("a", lambda: [2])
    assert common.held("b", lambda: [3]) == [3] and common._HELD[0] == "b"


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_SIZE", 10)
    own = bpe.RankEncoder(open(RANKS, "rb").read(), PATTERN)
    text = " ".join(_noise(i) for i in range(50))
    assert own.encode(text).tolist() == _library().encode_ordinary(text)
    assert len(own.memo) <= 10 and len(own.memo.old) <= 10


def test_op1_digests(spark, tmp_path):
    from postcheck.llm.queries import op1_bpe

    spark.createDataFrame([(1, "Ça va bien"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op1_bpe(spark, str(tmp_path)).collect()}
    ids = _library().encode_ordinary("Ça va bien")
    assert got[1]["n_tokens"] == len(ids)
    assert got[1]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got[1]["decoded_sha256"] == hashlib.sha256("Ça va bien".encode()).hexdigest()
    assert got[2]["n_tokens"] == 0 and got[2]["ids_sha256"] == got[2]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()


def test_counts_equal_library(spark):
    texts = TEXTS + [_noise(i) for i in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, TOKENIZER, PATTERN).collect()}
    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    assert got[99] == 0
    for i, t in enumerate(texts):
        assert got[i] == len(library.encode(t, add_special_tokens=False)), t[:40]


def test_whole_tokens_are_proven():
    own = token_counts.Counter(open(TOKENIZER, "rb").read(), PATTERN)
    assert own.whole == {v for v in own.ids if len(own.merged(v)) == 1}
    assert all(own.piece_count(v.decode()) == 1 for v in list(own.whole)[:500] if v.isascii())


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(df, RANKS, PATTERN, decoded="both"), RANKS).count() == 0
    assert token_counts.count_tokens(df, TOKENIZER, PATTERN).count() == 0


def test_new_pre_tokens_merge_in_one_list_as_each_alone():
    own, rng = bpe.RankEncoder(open(RANKS, "rb").read(), PATTERN), random.Random(5)
    words = [bytes(rng.choice(b"aaabcdeh \xe4\xbd\xa0zZ01") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    words += [part * n for part in (b"a", b"ab", b" ", b"\x00") for n in range(1, 60)]
    alone = [own_ids.tobytes() for own_ids in (array("i", bpe.merge([own.byte_id[b] for b in w], own.pair, own.product, own.queue)) for w in words)]
    assert own.rising and bpe.merge_many(words, own.bytes, own.first, own.nexts, own.lasts, own.queue) == alone
    assert all(b is None for b in own.queue.buckets) and not any(own.queue.low)


def test_new_pre_tokens_of_several_texts_are_learnt_together(monkeypatch):
    """Only those too long for the memo merge alone, whatever the groups of texts; a vocabulary whose merges may go down goes one by one."""
    raw, rng = open(RANKS, "rb").read(), random.Random(6)
    texts = ["", *(" ".join("".join(rng.choice("aebcdxqzü你") for _ in range(rng.choice((3, 9, 90)))) for _ in range(30)) for _ in range(40))]
    own, library = bpe.RankEncoder(raw, PATTERN), _library()
    alone, one = [], own.memo.make
    monkeypatch.setattr(own.memo, "make", lambda piece: alone.append(len(piece)) or one(piece))
    monkeypatch.setattr(bpe, "TOGETHER", 1000)
    monkeypatch.setattr(bpe, "LIST", 7)
    expected = [array("i", library.encode_ordinary(t)).tobytes() for t in texts]
    assert own.packed_all(texts) == expected and alone and min(alone) > own.memo.longest
    # Token 257 is made of "a" and "bc", which has a higher rank.
    down = {bytes([b]): b for b in range(256)} | {b"xa": 256, b"abc": 257, b"bc": 258}
    raw = b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in down.items())
    odd = bpe.RankEncoder(raw, PATTERN)
    assert not odd.rising and odd.last_pair(b"abc") == (97, 258) and odd.packed_all(["abc bc xabc"]) == [odd.packed("abc bc xabc")]
