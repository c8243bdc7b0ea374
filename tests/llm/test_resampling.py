"""Importance resampling against a plain version, and its SQL on the whole small table."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from tessera import llm
from tessera.llm import resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
CAPITALS = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def plain_features(text, n):
    words = WORD.findall((text or "").translate(CAPITALS))
    return len(words), [" ".join(words[k : k + m]) for k in range(len(words)) for m in range(1, n + 1) if k + m <= len(words)]


def plain(docs, target, n=1, buckets=10_000, min_words=20, percent=10, seed=2024):
    """(n_features, weight, score) of each (doc_id, text), and the ids drawn in order."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    features = [(d, *plain_features(t, n)) for d, t in docs]
    s, t = Counter(bucket(f) for _, _, fs in features for f in fs), Counter(bucket(f) for x in target for f in plain_features(x, n)[1])
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t)))
    rows, able = [], []
    for d, count, fs in features:
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((d, len(fs), weight, score))
        able += [(-score, math.inf if d is None else d)] * (count >= min_words)
    return rows, [d for _, d in sorted(able)[: percent * len(able) // 100]]


def sortable(rows):
    return sorted(rows, key=lambda r: tuple(-1 if x is None else x for x in r))


def check(got, docs, target, **options):
    rows, drawn = plain(docs, target, **options)
    assert sortable((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == sortable(rows)
    ranked = sorted((r["rank"], math.inf if r["doc_id"] is None else r["doc_id"]) for r in got if r["rank"] is not None)
    assert ranked == list(enumerate(drawn, 1))


@pytest.mark.parametrize(("n", "buckets", "percent", "min_words"), [(1, 10_000, 10, 20), (3, 97, 50, 5), (2, 1, 100, 0), (1, 50, 0, 1)])
def test_equals_the_plain_version(make, spark, n, buckets, percent, min_words):
    r = random.Random(n)
    vocabulary = ["tax", "Tree", "ÉÀ", "x1", "a", "Zeit", "漢字"]
    docs = [(k, "".join(r.choice(vocabulary) + r.choice([" ", ", ", "-", "\x00", "\n"]) for _ in range(r.randint(0, 40)))) for k in range(300)]
    docs += [(1000, None), (1001, ""), (None, "no id " * 12), (5, docs[5][1]), (5, docs[5][1]), (1002, "long text here " * 20_000)]
    target = ["Tree tree x1", None, "zeit"]
    options = {"n": n, "buckets": buckets, "percent": percent, "min_words": min_words}
    got = resampling.importance(make(docs), spark.createDataFrame([(t,) for t in target], "text string"), **options)
    check(got.collect(), docs, target, **options)


def test_the_ring_gives_every_run_once():
    words = [w.encode() for w in ("a", "é", "c", "d", "a")]
    for n in range(1, 8):
        want = [zlib.crc32(b" ".join(words[k : k + m])) for k in range(5) for m in range(1, n + 1) if k + m <= 5]
        assert Counter(resampling.ngram_hashes(words, n)) == Counter(want)


def test_odd_rows_and_empty_tables(odd, none, spark):
    aim = spark.createDataFrame([("same text here",)], "text string")
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check(resampling.importance(odd, aim, min_words=1, percent=50).collect(), docs, ["same text here"], min_words=1, percent=50)
    check(resampling.importance(odd, aim.limit(0)).collect(), docs, [])
    empty = resampling.importance(none, aim)
    assert empty.collect() == [] and [k for _, k in empty.dtypes] == ["bigint"] * 5
    with pytest.raises(ValueError):
        resampling.importance(odd, aim, percent=101)


def test_ties_go_to_the_smaller_id(make, spark, monkeypatch):
    monkeypatch.setattr(resampling, "gumbel_score", lambda weight, doc_id, seed: weight)
    docs = make([(k, "the same words") for k in range(200, 0, -1)])
    got = resampling.importance(docs, spark.createDataFrame([("other",)], "text string"), min_words=1, percent=10).collect()
    assert sorted((r["rank"], r["doc_id"]) for r in got if r["rank"]) == [(k, k) for k in range(1, 21)]


def test_drawn_rows_lean_to_the_target_and_keep_their_columns(make, spark):
    docs = make([(k, ("river boat water " if k % 10 == 0 else "tax court law ") * 10) for k in range(400)])
    aim = spark.createDataFrame([("boat on the river",), ("water",)], "text string")
    drawn = resampling.resampled(docs, aim)
    rows = drawn.collect()
    assert set(drawn.columns) == set(docs.columns) and len(rows) == 40 and all(r["doc_id"] % 10 == 0 for r in rows)


def test_op13(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = llm.queries()["op13_importance_resampling"](spark, sf).select("doc_id", "n_features", "weight", "score", "rank").collect()
    check(rows, [(r["doc_id"], r["text"]) for r in docs], target)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert sorted(con.sql(f"SELECT doc_id, n_features, weight, score, rank FROM ({llm.oracle_sql()['op13_importance_resampling']})").fetchall()) == sorted(tuple(r) for r in rows)
