import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import common, language_id, mixing, packing, pii, simhash
from tessera.llm.common import table, written

from .test_duplicates import plain_similar
from .test_mixing_search_secrets import words
from .test_pii import stated


def test_stages_one_by_one(spark, sf):
    docs = table(spark, sf, "documents")
    names = docs.columns
    out = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        docs = written(stage(spark, docs, sf), "test")
        after = docs.collect()
        out[name] = (before, after)
        if k < 4:
            assert docs.columns == names
    before, after = out["language ID"]
    assert sorted(r["doc_id"] for r in before) == sorted(r["doc_id"] for r in after)
    before, after = out["SimHash near-dedup"]
    rows = sorted(before, key=lambda r: r["doc_id"])
    roots = plain_similar([r["text"] for r in rows])
    assert sorted(r["doc_id"] for r in after) == sorted({rows[k]["doc_id"] for k in roots})
    before, after = out["PII"]
    texts = {r["doc_id"]: r["text"] for r in after}
    for r in before:
        spans, text, at = stated(r["text"])[1], "", 0
        for s in spans:
            kind, i, j = s.split(":")
            if int(i) >= at:
                text, at = text + r["text"][at : int(i)] + f"<{kind.upper()}>", int(j)
        assert texts[r["doc_id"]] == text + r["text"][at:]
    before, after = out["mixing"]
    total, mixed = sum(words(r["text"]) for r in before), sum(words(r["text"]) for r in after)
    assert 1.5 * total - 25 < mixed <= 1.5 * total
    before, after = out["packing"]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sum(r["length"] for r in after) == sum(len(t.encode(r["text"], add_special_tokens=False).ids) + 1 for r in before)
    ids = {zlib.crc32(np.array([*t.encode(r["text"], add_special_tokens=False).ids, 1], dtype="<u4").tobytes()) for r in before}
    whole = [r for r in after if r["length"] == r["doc_tokens"]]
    assert whole and all(r["ids_crc32"] in ids for r in whole)


def test_odd_and_empty_documents(spark, odd, none, tmp_path):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, str(tmp_path)), "test")
        docs.collect()
    kept = corpus_pipeline.identify_language(spark, odd, "").select("doc_id").collect()
    assert {r["doc_id"] for r in kept}.isdisjoint({0, 1, 2, 4})


def test_run_is_registered(spark, sf):
    import __spark_entry__ as entry

    rows = entry.queries()["pipeline"](spark, sf)
    assert {"doc_id", "sequence_id", "offset"} <= set(rows.columns) and rows.count() > 0


#: Names that the stages make for themselves, and some that need quoting.
MADE = sorted({*re.findall(r"__[a-z_]+", "".join(open(m.__file__).read() for m in (pii, simhash, mixing, language_id, packing, common)))} | {"__hit_email", "others", "c0", "row", "k", "slot", "turn", "fp", "node", "a.b", "a`b", "Größe", "x y"})


@pytest.mark.parametrize("ids", ["whole", "repeated", "null"])
@pytest.mark.parametrize("stage", ["redact", "keep_one", "mixed_documents", "keep_languages"])
def test_no_stage_loses_or_changes_a_column(spark, ids, stage):
    n = 24
    rows = [(k if ids == "whole" else k // 2 if ids == "repeated" else None, f"Write to me{k}@mail.example and see number {k} of the {k * 7919 % 97} red, {k * 31 % 89} blue and {k * 17 % 83} green words", "en", f"s{k % 2}", 5, k) for k in range(n)]
    plain_ = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, mark long")
    clash = plain_.select("*", *[F.concat(F.lit(f"{c}-"), "mark").alias(c) for c in MADE]).drop("mark").repartition(3)
    run = {"redact": pii.redact, "keep_one": lambda d: simhash.keep_one(d, similarity=0.8), "mixed_documents": mixing.mixed_documents, "keep_languages": lambda d: language_id.keep_languages(d, language_id.train(plain_.withColumn("doc_id", F.col("mark"))), 0.0)}[stage]
    got = run(clash)
    assert got.columns == clash.columns and got.dtypes == clash.dtypes
    found = got.collect()
    assert found and (stage == "mixed_documents" or len(found) == n)
    for r in found:
        marks = {r[c].removeprefix(f"{c}-") for c in MADE}
        assert len(marks) == 1 and r["source"] == f"s{int(marks.pop()) % 2}"
