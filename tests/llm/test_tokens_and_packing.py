import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing, token_counts

ALPHABET = [*"aaabc  \n\t\r'sdtllvre09²½éèñß$%&*#.,漢字🙂́\x1c\x85\xa0　\x00ΣİA", "<|endoftext|>", "<|startoftext|>", " \n ", "THE", "ing"]


def texts(n=1500, seed=0):
    r = random.Random(seed)
    return ["".join(r.choices(ALPHABET, k=r.randint(0, 60))) for _ in range(n)] + ["a" * 5000, "", " " * 3000, "aaa", "é" * 999]


@pytest.mark.parametrize("vocab", ["byte_bpe_50k.json"])
def test_counts_equal_the_library(vocab):
    t = Tokenizer.from_file(public_tokenizers.path(vocab))
    given = texts()
    assert token_counts.TokenCounter(vocab)(given) == [len(x.ids) for x in t.encode_batch(given, add_special_tokens=False)]


def test_overlapping_pairs_merge_from_the_left():
    bpe = token_counts.merger(public_tokenizers.path("byte_bpe_50k.json"))
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    words = ["a" * n for n in range(1, 40)] + ["ab" * n for n in range(1, 20)]
    ids, sizes = bpe.merge([w.encode() for w in words], symbols_too=True)
    want = [t.encode(w).ids for w in words]
    assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_token_counts_of_odd_texts(odd, none):
    rows = token_counts.token_counts(odd).collect()
    assert len(rows) == 14
    by = {r["doc_id"]: r for r in rows}
    assert (by[0]["n_bytes"], by[0]["n_tokens"], by[0]["over_limit"]) == (0, 0, False)
    assert by[7]["over_limit"] and by[7]["n_bytes"] == 300_000 and by[5]["n_bytes"] == 11
    empty = token_counts.token_counts(none)
    assert empty.collect() == [] and dict(empty.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}


def test_ids_equal_the_library():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    given = texts(seed=5)
    want = [np.array(x.ids, dtype="<u4").tobytes() for x in t.encode_batch(given, add_special_tokens=False)]
    assert list(packing.ChunkIds("word_bpe_49k.json")(given)) == want


def check_pieces(rows, docs, size):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {}
    for r in docs:
        ids.setdefault(r["doc_id"], np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 1], dtype="<u4"))
    sequences, covered = {}, {}
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        covered.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at == size or at & (at - 1) == 0 and at < size
    return ids, covered


@pytest.mark.parametrize("size", [1, 16, 100, 2048])
def test_every_id_is_in_one_piece_and_nothing_is_padded(odd, size):
    docs = [r for r in odd.select("doc_id", "text").collect() if len(r["text"] or "") < 50_000 or size > 500]
    kept = odd.where(f"length(coalesce(text, '')) < 50000 OR {size} > 500")
    ids, covered = check_pieces(packing.pack(kept, size=size).collect(), docs, size)
    copies = {}
    for r in docs:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    for d, pieces in covered.items():
        assert sum(n for _, n in pieces) == copies[d] * len(ids[d])
        if copies[d] == 1:
            at = 0
            for start, n in sorted(pieces):
                assert start == at
                at += n
    assert set(covered) == set(ids)


def test_packing_an_empty_table(none):
    assert packing.pack(none).collect() == []
    with pytest.raises(ValueError):
        packing.pack(none, size=0)


def test_placement_minimises_the_sum_of_squares():
    r, level = random.Random(1), packing.Level(12)
    for _ in range(400):
        s = r.randint(1, 12)
        before = level.count.copy()

        def after(h, before=before, s=s):
            c = before.copy()
            c[h] -= h > 0
            c[h + s] += h + s < 12
            return int((c * c).sum())

        choices = [after(h) for h in range(13 - s) if h == 0 or before[h]]
        level.place(("d", b"", 0, s), s)
        assert int((level.count * level.count).sum()) == min(choices)
