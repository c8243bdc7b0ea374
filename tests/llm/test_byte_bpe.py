"""Byte-level BPE against the library, and whole round trips."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tessera import llm
from tessera.llm import byte_bpe
from tessera.llm.common import table

from .test_tokens_and_packing import texts as odd_texts

VOCABS = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")


def library(vocab):
    with open(public_tokenizers.path(vocab), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def as_list(ids):
    return np.frombuffer(ids, dtype="<u4").tolist()


@pytest.mark.parametrize("vocab", VOCABS)
def test_ids_equal_the_library_and_decode_to_the_text(vocab):
    r, lib = random.Random(7), library(vocab)
    given = odd_texts() + ["".join(r.choices("abcdefghij klmnopqrstuvwxyz", k=r.randint(1, 300))) for _ in range(1000)]
    given += ["".join(chr(r.randrange(32, 0xD800)) for _ in range(40)) for _ in range(500)]
    encoder = byte_bpe.Encoder(vocab)
    found = list(encoder(given))
    assert [as_list(ids) for ids in found] == [lib.encode_ordinary(t) for t in given]
    assert [encoder.bpe.decode(ids).decode() for ids in found] == given


def test_plain_chunks_skip_the_pattern_and_are_cut_as_by_it():
    r, encoder = random.Random(9), byte_bpe.Encoder(VOCABS[0])
    pieces = ["don't", "it's", "'s", "'", "''t", "a'll", "x", "é", "ß", "\u0130", "\u02b0", "\u0301", "4", "²", "Ⅷ", "_", "...", "!?", "###", "\u2014", "\u00a0", "\n", "\x1c", " ", "日本", "🙂"]
    chunks = {c for _ in range(20_000) for c in byte_bpe.CHUNK.findall("".join(r.choices(pieces, k=r.randint(1, 5))))} | {" ", "\n", " a", "...", " ..."}
    assert all(encoder.cut(c) == encoder.pattern.findall(c) for c in chunks)

    class Never:
        def findall(self, chunk):
            raise AssertionError(chunk)

    encoder.pattern = Never()
    lib = library(VOCABS[0])
    text = " heeaon. Adoll### Stesth, über-\tx"[:-2]
    assert as_list(next(iter(encoder([text])))) == lib.encode_ordinary(text)


def test_the_two_files_of_a_vocabulary_are_the_same():
    assert byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.json")) == byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def plain_merges(ranks, word):
    parts = [bytes([b]) for b in word]
    while True:
        best = min(((ranks.get(parts[k] + parts[k + 1], byte_bpe.NEVER), k) for k in range(len(parts) - 1)), default=(byte_bpe.NEVER, 0))
        if best[0] == byte_bpe.NEVER:
            return [ranks[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


@pytest.mark.parametrize("seed", range(8))
def test_small_random_vocabularies_with_many_dead_places(tmp_path, seed):
    """Few letters and many overlapping merges, so that the longest matches are wrong most of the time."""
    r = random.Random(seed)
    tokens = [bytes([b]) for b in range(256)]
    words = ["".join(r.choices("abc", k=40)).encode() for _ in range(30)]
    for _ in range(60):  # a vocabulary as training makes it, with pairs taken at random
        ranks = {t: k for k, t in enumerate(tokens)}
        cut = [[tokens[i] for i in plain_merges(ranks, w)] for w in words]
        pairs = sorted({a + b for w in cut for a, b in zip(w, w[1:], strict=False)} - ranks.keys())
        if not pairs:
            break
        tokens.append(r.choice(pairs))
    path = tmp_path / "ranks.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % k for k, t in enumerate(tokens)))
    bpe, ranks = byte_bpe.BytePairs(str(path)), {t: k for k, t in enumerate(tokens)}
    backtracked = 0
    for _ in range(600):
        word = "".join(r.choices("abc", k=r.randint(1, 60)))
        greedy = [t for _, t in bpe.automaton.iter_long(word)]
        want = plain_merges(ranks, word.encode()) if word.encode() not in ranks else [ranks[word.encode()]]
        assert bpe.encode(word) == want
        backtracked += greedy != want
    assert backtracked > 50


def test_a_token_that_merging_never_makes_stands_for_itself_alone(tmp_path):
    tokens = [bytes([b]) for b in range(256)] + [b"bc", b"ab", b"abc", b"abcabd", b"xy"]
    path = tmp_path / "ranks.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % k for k, t in enumerate(tokens)))
    bpe = byte_bpe.BytePairs(str(path))
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
    assert bpe.left_edge[259] is None
    for word in ("abcabd", "abcabdx", "abc", "xyabcabd", "aabcabdd", "xxyy"):
        assert bpe.encode(word) == lib.encode_ordinary(word)
    path.write_bytes(base64.b64encode(b"a") + b" 0")
    with pytest.raises(ValueError):
        byte_bpe.BytePairs(str(path))


def test_long_pre_tokens_of_one_letter():
    lib = library(VOCABS[0])
    for text in ("a" * 200_000, " " * 100_000, "é" * 50_000, "ab" * 60_000):
        assert as_list(next(iter(byte_bpe.Encoder(VOCABS[0])([text])))) == lib.encode_ordinary(text)


def test_forgotten_chunks_are_learnt_again(monkeypatch):
    monkeypatch.setattr("tessera.llm.packing.REMEMBERED", 40)
    monkeypatch.setattr(byte_bpe, "BLOCK_CHARS", 100)
    monkeypatch.setattr(byte_bpe, "REMEMBERED_PAIRS", 10)
    lib, given = library(VOCABS[0]), odd_texts(400, seed=2)
    assert [as_list(x) for x in byte_bpe.Encoder(VOCABS[0])(given)] == [lib.encode_ordinary(t) for t in given]


def test_odd_rows(odd, none):
    lib = library(VOCABS[0])
    encoded = byte_bpe.encode(odd)
    rows = encoded.collect()
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], lib.encode_ordinary(r["text"] or "")) for r in odd.collect())
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], as_list(r["ids"])) for r in rows) == want
    assert all(r["n_tokens"] == len(r["ids"]) // 4 for r in rows)
    texts = sorted((r["text"] or "").encode() for r in odd.collect())
    assert sorted(bytes(r["decoded"]) for r in byte_bpe.decode(encoded).collect()) == texts
    assert byte_bpe.encode(none).collect() == [] and dict(byte_bpe.encode(none, decoded=True).dtypes) == {"doc_id": "bigint", "n_tokens": "bigint", "ids": "binary", "decoded": "binary"}
    nothing = byte_bpe.decode(encoded.selectExpr("doc_id", "CAST(NULL AS BINARY) AS ids"))
    assert {r["decoded"] for r in nothing.collect()} == {None}


def test_op11(spark, sf):
    lib, texts = library(VOCABS[0]), {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").collect()}
    rows = llm.queries()["op11_byte_bpe"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        ids = np.array(lib.encode_ordinary(text), dtype="<u4")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
