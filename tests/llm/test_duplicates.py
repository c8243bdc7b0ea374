import hashlib
import random
import re
import time

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import common, components, fingerprints, simhash
from tessera.llm.common import table, written


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, bits):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    fps = np.array(fps, dtype=np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= bits) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_whole_small_table(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    ids = sorted(docs)
    fps = [plain_fingerprint(docs[d]) for d in ids]
    roots = plain_components(fps, 4)
    rows = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op7_simhash_near_dedup(spark, sf).collect()}
    assert rows == {d: (f"{f:016x}", ids[r]) for d, f, r in zip(ids, fps, roots, strict=True)}


def test_odd_texts(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 14
    by = {r["doc_id"]: r for r in rows}
    assert [by[k]["fingerprint"] for k in (0, 1, 2)] == ["0" * 16] * 3 and {by[k]["component_id"] for k in (0, 1, 2)} == {0}
    assert by[10]["component_id"] == 9
    assert simhash.near_duplicates(none).collect() == [] and simhash.keep_one(none).columns == none.columns


def test_one_of_each_group_stays(make, odd):
    docs = make([(5, "one two three four five"), (2, "One two three four FIVE"), (9, "other words are here now"), (7, "one two three four five")])
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [2, 9]
    assert simhash.keep_one(docs).columns == docs.columns
    texts = sorted(str(r["text"])[:20] for r in simhash.keep_one(odd).collect())
    assert len(texts) == len(set(texts))


@pytest.mark.parametrize("bits,long", [(4, 4096), (4, 60), (3, 60)])
def test_dense_lists(spark, bits, long):
    r = np.random.default_rng(0)
    centres = r.integers(0, 2**63, 3)
    fps = {int(c) ^ sum(1 << int(k) for k in set(r.integers(0, 63, r.integers(0, 7)))) for c in centres for _ in range(150)} | {int(x) for x in r.integers(0, 2**63, 100)}
    fps = sorted(fps)
    df = spark.createDataFrame(pd.DataFrame({"fp": np.array(fps, dtype=np.int64)}))
    got = {x["node"]: x["root"] for x in components.components(simhash.links(df, bits, long)).collect()}
    roots = plain_components(fps, bits)
    want = {f: fps[k] for f, k in zip(fps, roots, strict=True) if roots.count(k) > 1}
    assert got == want


def test_negative_fingerprints_link(spark):
    fps = [-1, -2, -4, 2**62, 2**62 + 1, -(2**63)]
    df = spark.createDataFrame(pd.DataFrame({"fp": np.array(fps, dtype=np.int64)}))
    got = {x["node"]: x["root"] for x in components.components(simhash.links(df, 4)).collect()}
    assert got == {-1: -4, -2: -4, -4: -4, 2**62: -(2**63), 2**62 + 1: -(2**63), -(2**63): -(2**63)}


def plain_similar(texts, words=5, least=0.8, bits=4):
    """Components of texts by similarity of shingles or by bits, all pairs."""
    sets = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    fps = [plain_fingerprint(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            small, large = sorted((len(sets[i]), len(sets[j])))
            near = (fps[i] ^ fps[j]).bit_count() <= bits
            if near or small and small >= least * large and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_similar_texts_are_linked(make):
    """Families of copies edited more and more, among them pairs near the bound, against all pairs."""
    r = random.Random(5)
    texts = []
    for _ in range(30):
        own = [f"w{r.randint(0, 5000)}" for _ in range(r.choice([3, 30, 120, 400]))]
        for _ in range(r.choice([1, 2, 6, 40])):
            copy = own[:]
            for _ in range(r.randint(0, max(1, len(own) // 25))):
                copy[r.randrange(len(copy))] = f"x{r.randint(0, 5000)}"
            texts.append(" ".join(copy))
    texts += ["", None, "one", "one", "two words"]
    docs = make(list(enumerate(texts)))
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(docs, similarity=0.8).collect()}
    want = plain_similar(texts)
    assert sum(got[k] == w for k, w in enumerate(want)) >= 0.99 * len(texts)
    assert all(want[v] == want[k] for k, v in got.items())  # none is in a component with a text that it has no path to
    kept = {x["doc_id"] for x in simhash.keep_one(docs, similarity=0.8).collect()}
    assert kept == {k for k, v in got.items() if k == v}


@pytest.mark.parametrize("long", [40, 4096])
def test_refused_candidates_hide_no_link(make, long):
    """Large families whose texts are similar to some of the others only: a forest's candidates are mostly refused, and links between its leaves count all the same."""
    r, texts = random.Random(11), []
    for _ in range(3):
        own = [f"w{r.randint(0, 10**6)}" for _ in range(300)]
        for _ in range(120):
            copy = own[:]
            for k in r.sample(range(0, 300, 10), 4 + r.randint(0, 4)):
                copy[k] = f"x{r.randint(0, 1)}"
            texts.append(" ".join(copy))
    docs = make(list(enumerate(texts)), clash=False)
    marked = simhash.fingerprints(docs).withColumn("fp", F.col("doc_id"))  # no fingerprint joins them
    got = {x["node"]: x["root"] for x in components.components(simhash.similar_links(docs, marked, 5, 0.8, long)).collect()}
    want = plain_similar(texts, bits=-1)
    assert got == {k: w for k, w in enumerate(want) if want.count(w) > 1}
    assert 10 < len(set(want)) < len(texts)  # neither all apart nor all together


@pytest.mark.parametrize("long", [4096, 100, 8])
def test_refused_candidates_leave_no_rows(make, monkeypatch, long):
    """A family of texts of some 0.7 that no link joins, and a few links hidden in it: what the tasks give is links, not pairs; with families whole, in blocks, and by lists."""
    r = random.Random(7)
    own, texts = [f"w{k}" for k in range(400)], []
    for n in range(90):
        copy = own[:]
        for k in r.sample(range(0, 400, 8), 8):
            copy[k] = f"x{n}"
        texts.append(" ".join(copy))
    for n in range(3):
        texts.append(texts[n].replace("w399", f"y{n}"))
    docs = make(list(enumerate(texts)), clash=False)
    tables, plain = {}, simhash.written
    monkeypatch.setattr(simhash, "written", lambda df, label: tables.setdefault(label, plain(df, label)))
    marked = simhash.fingerprints(docs).withColumn("fp", F.col("doc_id"))
    got = {x["node"]: x["root"] for x in components.components(simhash.similar_links(docs, marked, 5, 0.8, long)).collect()}
    want = plain_similar(texts, bits=-1)
    assert got == {k: w for k, w in enumerate(want) if want.count(w) > 1}
    assert len(set(want)) >= 80 and tables["candidates"].count() > 60
    assert tables["refused"].count() <= len(texts)


def test_only_texts_with_candidates_are_shuffled(spark, make):
    """Of 1,200 texts of 11 kB that hardly compress, 40 are near copies: the stage shuffles their texts and not all, where no side is small enough to be broadcast."""
    r = random.Random(3)
    texts = [" ".join(f"{r.getrandbits(40):x}" for _ in range(1000)) for _ in range(1200)]
    for n in range(20):
        texts[2 * n] = texts[2 * n + 1] + f" and {n}"
    docs = written(make(list(enumerate(texts)), clash=False), "test")
    before, key = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), "spark.sql.autoBroadcastJoinThreshold"
    shuffled = lambda: spark._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    spark.conf.set(key, "-1")
    try:
        at_first = shuffled()
        kept = simhash.keep_one(docs, similarity=0.8).collect()
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        moved = shuffled() - at_first
    finally:
        spark.conf.set(key, before)
    assert {x["doc_id"] for x in kept} == set(range(1200)) - {2 * n + 1 for n in range(20)}
    assert all(x["text"] == texts[x["doc_id"]] for x in kept)
    assert moved < 0.5 * sum(map(len, texts))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_rows_told_apart_by_a_map_of_ids(spark, monkeypatch, kind):
    for bits in (common.MAP_BITS, 64):  # a map that is full tells none apart, and the result is the same
        monkeypatch.setattr(common, "MAP_BITS", bits)
        rows = spark.range(-500, 3000).selectExpr(f"cast(id AS {kind}) AS doc_id", "id AS mark")
        ids = spark.range(0, 6000, 7).selectExpr(f"cast(id AS {kind}) AS gone")
        have = set(range(0, 3000, 7))
        assert {x["mark"] for x in common.only(rows, ids).collect()} == have
        assert {x["mark"] for x in common.without(rows, ids).collect()} == set(range(-500, 3000)) - have
        assert common.without(rows, ids.limit(0)).count() == 3500 and common.only(rows, ids.limit(0)).count() == 0
        told = common.may_have(rows, ids, "doc_id", "may").where("may").count()
        assert told < 500 if bits > 64 else told >= 429


def test_first_shared_list():
    a = np.zeros((3, simhash.SIGNATURE), dtype=np.uint8)
    b = a.copy()
    b[1, [0, simhash.SET + 1]] = b[2, :-simhash.SET - 1] = 1
    kind = simhash.BySignature(1)
    assert kind.first_lists(a, b).tolist() == [0, 2, simhash.SIGNATURE // simhash.SET - 1]
    assert kind.first_lists(a[:0], b[:0]).tolist() == []


def test_long_lists_of_signatures(spark):
    r = np.random.default_rng(3)
    base = r.integers(0, 256, (3, simhash.SIGNATURE), dtype=np.uint8)
    rows = []
    for n in range(600):
        own = base[n % 3].copy()
        own[r.integers(0, simhash.SIGNATURE, 5)] = r.integers(0, 256, 5)
        rows.append((int(n % 3), n, own.tobytes()))
    index = spark.createDataFrame(rows, "key long, node long, sig binary").repartition(4)
    got = {x["node"]: x["root"] for x in components.components(simhash.listed_links(index, simhash.BySignature(38), 100)).collect()}
    assert got == {n: n % 3 for n in range(600)}


def test_long_chain_and_loops(spark):
    pairs = [(k, k + 1) for k in range(200)] + [(5, 5), (None, 7), (300, 301), (301, 300)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {x["node"]: x["root"] for x in components.components(df).collect()}
    assert got == {k: 0 for k in range(201)} | {300: 300, 301: 300}
    assert components.components(df.limit(0)).collect() == []


def test_sketch_equals_plain_code(spark, make):
    r = random.Random(2)
    texts = [" ".join(r.choices("alpha beta gamma Delta é1".split(), k=k)) for k in (0, 1, 3, 4, 5, 6, 40, 400)] + [None, "!!! ...", "a,b;c\nd e f"]
    rows = {x["doc_id"]: x for x in fingerprints.sketches(make(list(enumerate(texts)))).collect()}
    for k, t in enumerate(texts):
        words = re.sub(r"[\W_]+", " ", (t or "").lower()).split()
        runs = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        hashes = sorted(h - 2**64 if h >= 2**63 else h for h in (xxhash.xxh64_intdigest(x.encode(), 42) for x in runs))
        assert rows[k]["sketch"] == [h for i, h in enumerate(hashes) if i == 0 or h < -(2**62)]


def edited(docs):
    """(doc_id, edited text) of documents in descending order of ids."""
    order = sorted(docs, key=lambda d: -d[0])
    out = {}
    for (d, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        cut = len(t) // 3
        out[d] = t[: len(t) - cut] + n[:cut]
    return out


@pytest.mark.parametrize("n,range_rows", [(1, 2000), (2, 1), (40, 7), (40, 1), (40, 2000)])
def test_next_documents(make, n, range_rows):
    docs = [(k * k, f"text {k} 🙂 " * (k % 5)) for k in range(n)]
    frame = make(docs)
    rows = fingerprints.with_next(fingerprints.sketches(frame), frame.select("doc_id", "text"), ["text"], range_rows).collect()
    want = edited(docs)
    assert len(rows) == n
    for r in rows:
        cut = len(r["text"]) // 3
        assert r["text"][: len(r["text"]) - cut] + r["next_text"][:cut] == want[r["doc_id"]]


@pytest.mark.parametrize("range_rows", [3, 10, 1000])
def test_frequent_ids_are_dealt_over_ranges(make, range_rows):
    """Each row has one successor and all rows form a single ring, in descending order of ids, whatever ids are frequent."""
    docs = [(None, f"none {k}") for k in range(30)] + [(7, f"seven {k}") for k in range(30)] + [(k, f"own {k}") for k in range(-5, 12)] + [(11, "own 11"), (-(2**63), "least")]
    frame = make(docs, clash=False)
    rows = fingerprints.with_next(frame, frame.select("doc_id", "text"), ["text", "doc_id"], range_rows).collect()
    assert sorted(r["text"] for r in rows) == sorted(t for _, t in docs) == sorted(r["next_text"] for r in rows)
    following = {}
    for r in rows:
        following.setdefault(r["text"], []).append(r["next_text"])
        if r["doc_id"] is not None and r["next_doc_id"] is not None and r["next_doc_id"] > r["doc_id"]:
            raise AssertionError(r)
    at, seen = "own 11", []
    for _ in docs:
        seen.append(at)
        at = following[at].pop()
    assert at == "own 11" and sorted(seen) == sorted(t for _, t in docs)


def test_many_ranges_cost_little_more_than_few(spark):
    """Rows look at as many bounds as their number has bits, not at all of them."""
    rows = spark.range(200_000).selectExpr("id * 37 AS doc_id")

    def run(n):
        bounds = [(k * 37 * 200_000 // n, 0) for k in range(1, n)]
        found = rows.select(fingerprints.number_below(bounds, F.col("doc_id"), F.lit(1)).alias("lot"))
        began = time.perf_counter()
        got = found.groupBy("lot").count().agg(F.count("*"), F.max("count")).first()
        return time.perf_counter() - began, tuple(got)

    run(25)
    (few, (a, _)), (many, (b, most)) = run(25), run(8_000)
    assert a == 25 and b == 8_000 and most <= 26 and many < 4 * few + 2


def plain_sketch(text):
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    runs = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    hashes = sorted(h - 2**64 if h >= 2**63 else h for h in (xxhash.xxh64_intdigest(x.encode(), 42) for x in runs))
    return [h for i, h in enumerate(hashes) if i == 0 or h < -(2**62)]


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0


@pytest.mark.parametrize("range_rows", [20, 2000])
def test_edited_fingerprints(spark, sf, range_rows):
    """The whole small table against plain code."""
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    order = [d for d, _ in sorted(docs, reverse=True)]
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    want, text = edited(docs), dict(docs)
    rows = fingerprints.edited_fingerprints(table(spark, sf, "documents"), range_rows=range_rows).collect()
    assert len(rows) == len(docs)
    as_text = lambda s: ",".join(f"{h & 2**64 - 1:016x}" for h in s)
    for r in rows:
        d = r["doc_id"]
        own, other, changed = plain_sketch(text[d]), plain_sketch(text[after[d]]), plain_sketch(want[d])
        assert r["edited_sha256"] == hashlib.sha256(want[d].encode()).hexdigest() and r["n_chars"] == len(text[d])
        assert (r["fingerprint"], r["edited_fingerprint"]) == (as_text(own), as_text(changed))
        assert (r["near_edited"], r["near_next"]) == (jaccard(own, changed), jaccard(own, other))


def test_edited_fingerprints_of_odd_texts(odd, none):
    by = fingerprints.edited_fingerprints(odd).collect()
    assert len(by) == 14 and len({r["fingerprint"] for r in by if r["doc_id"] in (9, 10)}) == 1
    assert fingerprints.edited_fingerprints(none).collect() == []
    plan = fingerprints.edited_fingerprints(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan.split("== Physical Plan ==")[1].replace("LogicalRDD", "")


def test_containment_and_merging(spark):
    text = " ".join(f"w{k}" for k in range(2000))
    df = spark.createDataFrame([(text, " ".join(f"w{k}" for k in range(400)), " ".join(f"w{k}" for k in range(396, 2000)))], "whole string, part string, rest string")
    s = lambda c: fingerprints.sketch(fingerprints.plain_words(F.col(c)))
    r = df.select(fingerprints.containment(s("part"), s("whole")).alias("c"), (fingerprints.merged(F.array(s("part"), s("rest"))) == s("whole")).alias("m"), fingerprints.likeness(s("part"), s("whole")).alias("j")).first()
    assert r["c"] == 1.0 and r["m"] and abs(r["j"] - 0.2) < 0.06


@pytest.mark.parametrize("block", [1, 7, 10**6])
def test_components_of_random_links(spark, block):
    r = np.random.default_rng(block)
    pairs = r.integers(0, 400, (300, 2)) * 10**12
    df = spark.createDataFrame(pd.DataFrame(pairs, columns=["a", "b"]))
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs.tolist():
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert {x["node"]: x["root"] for x in components.components(df).collect()} == {x: find(x) for x in list(parent)}
    edges = df.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")
    stars = components.in_blocks(edges, block).withColumnsRenamed({"u": "a", "v": "b"})
    assert {x["node"]: x["root"] for x in components.components(stars).collect()} == {x: find(x) for x in list(parent)}


def test_list_over_many_batches(spark):
    """A list that streams in over many Arrow batches is linked like one that is held whole."""
    r = np.random.default_rng(1)
    fps = sorted({int(x) << 32 | 7 for x in r.integers(0, 2**12, 900)} | {int(x) for x in r.integers(0, 2**63, 300)})
    df = spark.createDataFrame(pd.DataFrame({"fp": np.array(fps, dtype=np.int64)}))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "50")
    try:
        got = {x["node"]: x["root"] for x in components.components(simhash.links(df, 4, 120)).collect()}
    finally:
        spark.conf.set(key, before)
    roots = plain_components(fps, 4)
    assert got == {f: fps[k] for f, k in zip(fps, roots, strict=True) if roots.count(k) > 1}
