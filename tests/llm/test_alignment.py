"""Alignment of two vocabularies against the libraries and pairwise overlaps."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessera import llm
from tessera.llm import alignment
from tessera.llm.common import table
from tessera.llm.token_counts import byte_characters

from .test_tokens_and_packing import ALPHABET

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
BYTE_OF = {c: b for b, c in byte_characters().items()}


def bytes_a(i):
    return bytes(BYTE_OF[c] for c in A.id_to_token(i))


def bytes_b(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()


def spans(ids, bytes_of):
    at, out = 0, []
    for i in ids:
        n = len(bytes_of(i))
        out.append((i, at, at + n))
        at += n
    return out


def plain(text):
    """(A ids with spans, B ids with spans, groups, links) of one text."""
    text = text or ""
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    want = b" " + text.encode()
    if not text or b"".join(map(bytes_a, a)) != want or b"".join(map(bytes_b, b)) != want:
        return [], [], "", []
    a, b = spans(a, bytes_a), spans(b, bytes_b)
    ends = {e for _, _, e in a} & {e for _, _, e in b}
    grouped = []
    for side in (a, b):
        grouped.append([[]])
        for i, _, e in side:
            grouped[-1][-1].append(str(i))
            if e in ends:
                grouped[-1].append([])
    grouped = ["|".join(map(",".join, pair)) for pair in zip(grouped[0][:-1], grouped[1][:-1], strict=True)]
    links, j = [], 0
    for i, s, e in a:
        while j < len(b) and b[j][2] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][1] < e:
            links.append((i, b[k][0]))
            k += 1
    return a, b, ";".join(grouped), links


def plain_table(docs):
    found = [(d, *plain(t)) for d, t in docs]
    counts = Counter(p for *_, links in found for p in set(links))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    rows = []
    for d, a, b, groups, links in found:
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        rows.append((d, len(a), len(b), groups.count(";") + bool(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), digest))
    return rows, counts


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def check(got, docs):
    assert ordered(tuple(r[c] for c in COLUMNS) for r in got) == ordered(plain_table(docs)[0])


MARKS = [*ALPHABET, "▁", "<s>", "<0x0A>", "  ", " word", "ﬁ", "½"]


def random_docs(n, seed=0):
    r = random.Random(seed)
    return [(k, "".join(r.choices(MARKS, k=r.randint(0, 40)))) for k in range(n)]


def second(align, texts):
    found = align(texts)
    cuts = found.n_b.cumsum()[:-1]
    return [x.tolist() for x in alignment.np.split(found.b, cuts)]


def test_cut_texts_give_the_library_s_pieces(monkeypatch):
    texts = [t for _, t in random_docs(3000, 4)] + ["", " ", "   ", "a", "a ", " a", "\n", "x  y ", "a" * 3000, "a\n b", "\n\n  c", "\u3000d \u3000", "e\x1c f", "a;\r\n b);\r", "\t  a\r\r b\r \r"]
    align = alignment.Aligner("byte_bpe_50k.tiktoken", "piece_bpe_32k.model")
    want = [[i for i, _, _ in plain(t)[1]] for t in texts]
    assert align.ids.pieces.cut and second(align, texts) == want
    chunks = alignment.np.concatenate([alignment.np.frombuffer(x, "<u4") for x in align.ids([t for t, w in zip(texts, want, strict=True) if w])])
    assert (chunks != alignment.INEXACT).all()  # whole texts are encoded only where bytes are lost
    monkeypatch.setattr(align.ids.pieces, "cut", False)
    assert second(align, texts) == want


def test_groups_links_and_counts_of_random_texts(make, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_DOCS", 7)
    monkeypatch.setattr(alignment, "GROUP_BLOCKS", 4)
    docs = random_docs(150, 1) + [(500, "the same words"), (501, "the same words"), (501, "the same words"), (None, "no id"), (502, None)]
    given = make(docs)
    check(alignment.alignment(given).collect(), docs)
    assert ordered((r["doc_id"], r["groups"]) for r in alignment.groups(given).collect()) == ordered((d, plain(t)[2]) for d, t in docs)
    assert {(r["a"], r["b"]): r["n_docs"] for r in alignment.pair_counts(given).collect()} == plain_table(docs)[1]


def test_other_widths_of_stripes_change_nothing(make, monkeypatch):
    monkeypatch.setattr(alignment, "STRIPE_IDS", 5000)
    docs = random_docs(40, 3)
    check(alignment.alignment(make(docs)).collect(), docs)


def test_blocks_are_bounded_but_for_long_texts(monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_DOCS", 3)
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 10)
    batch = alignment.pd.DataFrame({"text": ["é" * 30, "a", "b", "", "c", "d" * 9, "e", "é" * 4]})
    assert [b["text"].tolist() for b in alignment.blocks_of(batch)] == [["é" * 30], ["a", "b", ""], ["c", "d" * 9], ["e", "é" * 4]]


def test_odd_rows(odd, none):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = alignment.alignment(odd)
    check(got.collect(), docs)
    assert got.columns == list(COLUMNS)
    empty = alignment.alignment(none)
    assert empty.collect() == [] and [k for _, k in empty.dtypes] == ["bigint"] * 7 + ["string"]
    nothing = odd.where("coalesce(text, '') = ''")
    assert {r["n_links"] for r in alignment.alignment(nothing).collect()} == {0}


def test_forgotten_chunks_are_learnt_again(monkeypatch):
    monkeypatch.setattr("tessera.llm.packing.REMEMBERED", 50)
    monkeypatch.setattr(alignment, "REMEMBERED_WORDS", 20)
    monkeypatch.setattr(alignment, "BLOCK_CHARS", 200)
    texts = [t for _, t in random_docs(300, 9)]
    align, want = alignment.Aligner("byte_bpe_50k.tiktoken", "piece_bpe_32k.model"), [[i for i, _, _ in plain(t)[1]] for t in texts]
    assert second(align, texts) == want
    for most in (30, 0):  # as between two tasks
        align.ids.forget_but(most)
        assert len(align.ids.known) == len(align.ids.starts) == len(align.ids.uses) <= most and second(align, texts) == want


@pytest.mark.parametrize("name", ["op12_token_alignment"])
def test_op12(spark, sf, name):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    check(llm.queries()[name](spark, sf).collect(), docs)
