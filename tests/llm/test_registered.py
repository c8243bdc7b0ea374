"""The registered queries on the whole small table, against the libraries and plain code. Those of ops 4 to 7 and 10 are in the operators' own tests."""

import hashlib
import math

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera import llm
from tessera.llm.common import table

from . import test_mixing_search_secrets as mss
from . import test_pii
from .test_tokens_and_packing import check_pieces


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").collect()}


def test_op1(spark, sf, texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = llm.queries()["op1_token_counts"](spark, sf).collect()
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        n = len(t.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 512)


def test_op2(spark, sf, texts):
    rows = llm.queries()["op2_pii"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        counts, spans = test_pii.stated(texts[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == counts and r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()


def test_op3(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    rows = llm.queries()["op3_packing"](spark, sf).collect()
    ids, covered = check_pieces(rows, docs, 2048)
    for d, pieces in covered.items():
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
        assert at == len(ids[d])
    assert set(covered) == set(ids)


def test_op8(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "source").collect()
    size = {r["doc_id"]: mss.words(r["text"]) for r in docs}
    source = {r["doc_id"]: r["source"] for r in docs}
    names = sorted({s for s in source.values() if s is not None}) + [None] * any(s is None for s in source.values())
    sizes = [sum(size[d] for d in size if source[d] == s) for s in names]
    targets = mss.plain_targets(sizes, [(5, 2, 1)[k % 3] for k in range(len(names))], 1.5 * sum(sizes), 2)
    taken = dict.fromkeys(names, 0)
    rows = llm.queries()["op8_source_mixing"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        k = names.index(source[r["doc_id"]])
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], sizes[k]) and math.isclose(r["target"], targets[k]) and r["taken"] <= 2 * r["size"]
        taken[names[k]] += r["taken"]
    assert all(t - 1.001 < taken[s] <= t + 1e-6 for s, t in zip(names, targets, strict=True))


def test_op9(spark, sf, texts):
    rows = llm.queries()["op9_secret_scans"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        counts, spans = mss.stated(texts[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == counts and r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()


def test_names_of_the_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in llm.queries()) == list(range(1, 14))
