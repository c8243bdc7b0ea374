"""Near-duplicates by SimHash, found through an inverted index of positional bytes with count filtering.

A 64-bit fingerprint is eight bytes at eight positions. Two fingerprints that differ in at most ``bits`` bits differ in at most that many bytes, so they share
at least m = 8 - bits positional bytes: the guaranteed minimum. Every pair that meets in the index is tallied, how many positional bytes it shares; pairs whose tally
reaches m are retained, and those are verified bit by bit.

The index has one posting list for every set of m (position, byte) pairs, not one for each single pair. This gives the same tallies: two fingerprints that share t
bytes meet in the C(t, m) lists of the sets of m among these, so in none if t < m and in at least one if t >= m. Hence the pairs that meet are those which counting through single-byte
lists would retain, and no other pair need be tallied; a list of single bytes has a 256th of all fingerprints, one of m = 4 bytes a 2^32nd. A pair is
reported by the first of its lists, which its shared bytes tell.

Fingerprints are indexed once each, however many documents have them. Lists stream through sorted partitions. Inside a longer list a
forest of links takes the place of all pairs, which leaves the components as they are; lists above LONG entries are cut into blocks, and
each two blocks meet in a task of their own.

Where a similarity of shingles is asked for, which 64 bits can't guarantee to find, texts that have it are linked as well: see ``similar_links``.

Edge cases: a null or empty text has fingerprint zero, which is linked like any other; repeated rows each get their row; null ids
never become a component's id unless it has no other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import carrying, lean, map_rows, only, small_batches, table, without, written
from tessera.llm.components import components

SHINGLE_WORDS, SEED, BITS, BYTES = 4, 42, 4, 8
#: Entries of a posting list up to which all of its pairs are looked at at once, and up to which one task takes it whole.
SHORT, LONG = 16, 4096
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 16
#: Shingles, of all texts of a group, up to which a task verifies the group whole.
HASHES = 1 << 20
#: Bytes of a minwise signature, of a set of them that makes a list's key, and the permutations' factors and shifts.
SIGNATURE, SET = 64, 3
FACTORS, SHIFTS = (np.random.default_rng(SEED).integers(0, 2**64, SIGNATURE, dtype=np.uint64) | np.uint64(k) for k in (1, 0))


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles, repeats included."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    runs = zip(*(found[k:] for k in range(words)), strict=False) if len(found) >= words else [found]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(SEED)), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [fingerprint(t, words) for t in batch.pop("text").tolist()]
            batch["fp"] = np.array(found, dtype=np.uint64).view(np.int64)
            yield batch

    given = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(given, run, "fp long")


def _list_keys(fp: Column, sets: list[tuple[int, ...]]) -> Column:
    """The posting lists of a fingerprint: the set's number above the bytes it names."""
    keys = []
    for number, positions in enumerate(sets):
        packed = F.lit(number).cast("long")
        for p in positions:
            packed = F.shiftleft(packed, 8).bitwiseOR(F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255)))
        keys.append(packed)
    return F.array(*keys)


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """Whether each byte is equal, lowest byte first, from the exclusive-or of two fingerprints."""
    return x.view(np.uint8).reshape(-1, BYTES) == 0


def tally(x: np.ndarray) -> np.ndarray:
    """The number of equal bytes, from the exclusive-or of two fingerprints."""
    x = x.view(np.uint64)
    x = x | x >> np.uint64(4)
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)  # the lowest bit of each byte: whether any of it is set
    return BYTES - np.bitwise_count(x & np.uint64(0x0101010101010101))


def retained(x: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs share enough bytes and, of those, differ in few enough bits; from their exclusive-or."""
    keep = tally(x) >= BYTES - bits
    keep[keep] = np.bitwise_count(x[keep].view(np.uint64)) <= bits  # of signed numbers it counts the absolute value
    return keep


@dataclass(frozen=True)
class ByFingerprint:
    """How entries of a posting list are compared, when what they hold is the fingerprint itself."""

    bits: int
    sets: np.ndarray

    def held(self, batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("node").to_numpy()

    def pairs(self, keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs (one in each place) are links and share no earlier list; each pair comes from the first list that it shares."""
        x = a ^ b
        near = retained(x, self.bits)
        same = shared_bytes(x[near])
        first = same & (np.cumsum(same, axis=1) <= self.sets.shape[1])
        want = np.zeros_like(first)
        want[np.arange(len(first))[:, None], self.sets[keys[near] >> (8 * self.sets.shape[1])]] = True
        near[near] = (first == want).all(axis=1)
        return near

    def closeness(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For every two entries a number above 0 if they are a link."""
        return retained((a[:, None] ^ b[None, :]).ravel(), self.bits).reshape(len(a), len(b))

    width = 1


@dataclass(frozen=True)
class BySignature:
    """The same for signatures of SIGNATURE bytes; a pair is a candidate if it shares ``least`` of them."""

    least: int

    def held(self, batch: pa.RecordBatch) -> np.ndarray:
        packed = batch.column("sig")
        return np.frombuffer(b"".join(packed.to_pylist()), dtype=np.uint8).reshape(-1, SIGNATURE)

    def pairs(self, keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a == b).sum(axis=1) >= self.least

    def closeness(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        shared = (a[:, None, :] == b[None, :, :]).sum(axis=2)
        return np.where(shared >= self.least, shared, 0)

    def first_lists(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of the first list that each pair (one in each place) shares; it must share one."""
        return (a == b)[:, : SIGNATURE // SET * SET].reshape(len(a), SIGNATURE // SET, SET).all(axis=2).argmax(axis=1)

    width = SIGNATURE


def forest(nodes: np.ndarray, held: np.ndarray, kind: ByFingerprint | BySignature) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever links connect, at most one for each entry: to the closest entry of those before it in a breadth-first search."""
    nodes, at = np.unique(nodes, return_index=True)
    held, rest, left, right = held[at], np.arange(len(at)), [], []
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            step = max(1, 1_000_000 // (len(rest) * kind.width))
            part, front = front[:step], front[step:]
            close = kind.closeness(held[part], held[rest])
            hit = close.any(axis=0)
            left.append(nodes[part[close[:, hit].argmax(axis=0)]])
            right.append(nodes[rest[hit]])
            front, rest = np.r_[front, rest[hit]], rest[~hit]
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate(left or [none]), np.concatenate(right or [none])


def links(distinct: DataFrame, bits: int = BITS, long: int = LONG) -> DataFrame:
    """Pairs (a, b) of fingerprints that connect all fingerprints of ``distinct`` which differ in at most ``bits`` bits."""
    if not 0 < bits < BYTES:
        raise ValueError("bits must be 1 to 7: with 8, two fingerprints need not share a byte")
    minimum = BYTES - bits
    sets = list(combinations(range(BYTES), minimum))
    if 8 * minimum + len(sets).bit_length() > 63:
        raise ValueError("the keys of posting lists don't fit in 63 bits; use more bits")
    # every task gets its share of the fingerprints, few as their bytes are, before each becomes so many entries
    dealt = distinct.select("fp").repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    index = dealt.select(F.explode(_list_keys(F.col("fp"), sets)).alias("key"), F.col("fp").alias("node"), F.lit(None).cast("binary").alias("sig"))
    return listed_links(index, ByFingerprint(bits, np.array(sets)), long)


def listed_links(index: DataFrame, kind: ByFingerprint | BySignature, long: int = LONG) -> DataFrame:
    """Pairs (a, b) of nodes that are links, from an index (key, node, sig): all of lists of up to SHORT entries, a forest of longer ones.

    The forest connects what the links connect. Where pairs are only candidates, and some are refused later, that isn't enough: see ``refused_links``.
    """
    return links_and_longer(index, kind, long)[0]


def links_and_longer(index: DataFrame, kind: ByFingerprint | BySignature, long: int = LONG, longer: bool = False) -> tuple[DataFrame, DataFrame]:
    """``listed_links`` and, if ``longer``, the entries (key, node) of the lists of which they hold a forest alone."""
    schema = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("sig", pa.binary())])

    def found_pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, handed_on = None, None

        def for_later(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column("key"), batch.column("node"), pa.nulls(len(batch), pa.int64()), batch.column("sig")], schema=schema)

        def lists_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            keys, nodes = batch.column("key").to_numpy(), batch.column("node").to_numpy()
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
            sizes = np.diff(np.r_[starts, len(keys)])
            if not (sizes > 1).any():
                return
            data, number = kind.held(batch), np.repeat(np.arange(len(sizes)), sizes)
            left, right = [], []
            few = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SHORT), sizes))
            for step in range(1, int(sizes[sizes <= SHORT].max(initial=1))):
                at = few[:-step][number[few[step:]] == number[few[:-step]]]
                at = at[kind.pairs(keys[at], data[at], data[at + step])]
                left.append(nodes[at])
                right.append(nodes[at + step])
            for k in np.flatnonzero((sizes > SHORT) & (sizes <= long)):
                part = slice(starts[k], starts[k] + sizes[k])
                a, b = forest(nodes[part], data[part], kind)
                left.append(a)
                right.append(b)
                if longer:
                    yield pa.RecordBatch.from_arrays([batch.column("key")[part], batch.column("node")[part], batch.column("node")[part], pa.nulls(int(sizes[k]), pa.binary())], schema=schema)
            if sum(map(len, left)):
                yield found_pairs(np.concatenate(left), np.concatenate(right))
            for k in np.flatnonzero(sizes > long):
                yield for_later(batch.slice(starts[k], sizes[k]))

        for batch in batches:
            if handed_on is not None:  # what else the list has that was handed on; keys are sorted
                more = int(np.searchsorted(batch.column("key").to_numpy(), handed_on, side="right"))
                if more:
                    yield for_later(batch.slice(0, more))
                batch = batch.slice(more)
            batch = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches(max_chunksize=None)[0] if len(held) + len(batch) else batch
            if not len(batch):
                continue
            keys = batch.column("key").to_numpy()
            last = int(np.searchsorted(keys, keys[-1], side="left"))
            held = batch.slice(last)
            yield from lists_of(batch.slice(0, last))
            if len(held) > long:  # known to be long: no need to hold the whole list
                handed_on = int(keys[-1])
                yield for_later(held)
                held = held.slice(0, 0)
        if held is not None:
            yield from lists_of(held)

    found = index.select("key", "node", "sig").repartition("key").sortWithinPartitions("key").mapInArrow(lean(run), "key long, a long, b long, sig binary")
    found = written(found, "pairs")
    near = found.where("key IS NULL").select("a", "b")
    late = found.where("key IS NOT NULL AND b IS NULL").select("key", F.col("a").alias("node"), "sig")
    entries = found.where("key IS NOT NULL").select("key", F.col("a").alias("node"))
    if late.isEmpty():
        return near, entries

    def block_pair(rows: pa.Table) -> pa.Table:
        batch = rows.combine_chunks().to_batches(max_chunksize=None)[0]
        a, b = forest(batch.column("node").to_numpy(), kind.held(batch), kind)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    blocks = late.groupBy("key").agg(F.ceil(F.count("*") * 2 / F.lit(long)).cast("int").alias("blocks"))
    dealt = in_block_pairs(late.join(blocks, "key")).drop("mine", "blocks")
    return near.unionAll(dealt.groupBy("key", "i", "j").applyInArrow(block_pair, "a long, b long")), entries


def in_block_pairs(rows: DataFrame) -> DataFrame:
    """``rows`` (key, node, blocks and others) once for each two blocks i <= j of their list that one of them, ``mine``, is theirs."""
    mine = rows.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    mine = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return mine.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")}).drop("other")


def verified_forest(group: pa.Table, kind: BySignature, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of this similarity that connect whatever such links between the group's candidates connect: less than it has nodes.

    Columns: ``in_block_pairs``', node, root (what links found before connect to), sig, hashes, and nth, the number of the list that the group is, or null. Pairs of a list count if it is the first that
    they share, pairs inside a block if the group is of that block alone.
    """
    node, mine = (group.column(c).to_numpy() for c in ("node", "mine"))
    label, held, nth = np.unique(group.column("root").to_numpy(), return_inverse=True)[1], kind.held(group), group.column("nth")[0].as_py()
    lists = group.column("hashes").combine_chunks()
    size = lists.value_lengths().to_numpy().astype(np.int64)
    begin, (known, places) = np.cumsum(size) - size, np.unique(lists.flatten().to_numpy(), return_inverse=True)
    same_block, own, left, right = group.column("i")[0].as_py() == group.column("j")[0].as_py(), np.zeros(len(known), dtype=bool), [], []
    for a in range(len(node) - 1):
        b = a + 1 + np.flatnonzero(label[a + 1 :] != label[a])
        b = b[np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b])]
        b = b if same_block else b[mine[b] != mine[a]]
        b = b[kind.closeness(held[a : a + 1], held[b])[0] > 0]
        if nth is not None:
            b = b[kind.first_lists(held[[a]].repeat(len(b), axis=0), held[b]) == nth]
        if not len(b):
            continue
        mark = places[begin[a] : begin[a] + size[a]]
        own[mark] = True
        until = np.cumsum(size[b])
        theirs = own[places[np.arange(until[-1]) + np.repeat(begin[b] - until + size[b], size[b])]]
        shared = np.add.reduceat(theirs, until - size[b], dtype=np.int64)
        own[mark] = False
        b = b[shared >= similarity * (size[a] + size[b] - shared)]
        joined, first = np.unique(label[b], return_index=True)
        left += [node[a]] * len(first)
        right += node[b[first]].tolist()
        label[np.isin(label, joined)] = label[a]
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


def refused_links(entries: DataFrame, candidates: DataFrame, nodes: DataFrame, sets: DataFrame, good: DataFrame, kind: BySignature, similarity: float, long: int = LONG) -> DataFrame:
    """Links (a, b) that connect what links between nodes of a longer list connect, where a forest left them out and links found so far, ``good``, don't connect them.

    ``nodes`` has each node's sig and size, ``sets`` the shingles of the nodes that have ``candidates``. The pairs that meet in a shorter list have all been looked at. Candidates, refused ones included, connect nodes to
    families. A family is verified as one group, which gets each text once, or in pairs of blocks; one of so many blocks that its lists take fewer copies of a text goes by these.
    What a task gives are links alone, less than it has nodes, however many candidates it refuses. Lists whose entries are all connected, as those of copies are, go at once.
    """
    roots = written(components(good), "roots")
    labelled = entries.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    labelled = written(labelled.join(mixed, "key"), "mixed")
    ends = candidates
    for side in ("a", "b"):
        ends = ends.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
    ends = ends.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    families = components(ends).select(F.col("node").alias("root"), F.col("root").alias("family"))
    members = written(labelled.select("node", "root").distinct().join(families, "root").join(nodes.select("node", "sig", "size"), "node"), "members")
    blocks = F.ceil(F.greatest(F.count("*") * 4 / F.lit(long), F.sum("size") * 2 / F.lit(HASHES))).cast("int").alias("blocks")
    counted = members.groupBy("family").agg(blocks)
    whole = members.join(counted.where(F.col("blocks") <= SIGNATURE // SET), "family").select(F.col("family").alias("key"), F.lit(None).cast("long").alias("nth"), "node", "root", "sig", "blocks")
    large = members.join(counted.where(F.col("blocks") > SIGNATURE // SET).select("family"), "family")
    listed = labelled.select("key", "node").join(large, "node")
    listed = listed.join(listed.groupBy("key").agg(blocks), "key").select("key", F.shiftright("key", 8 * SET).alias("nth"), "node", "root", "sig", "blocks")
    rows = in_block_pairs(whole.unionAll(listed)).join(only(sets, members.select("node")).select(F.col("doc_id").alias("node"), "hashes"), "node")

    def between(group: pa.Table) -> pa.Table:
        a, b = verified_forest(group, kind, similarity)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("nth", "key", "i", "j").applyInArrow(between, "a long, b long")


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles; none for a text without words."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    runs = zip(*(found[k:] for k in range(words)), strict=False) if len(found) >= words else [found]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(SEED)), dtype=np.uint64))


def signature(hashes: np.ndarray) -> bytes:
    """SIGNATURE positional bytes: of each of as many permutations of the hashes a byte of the least. Two texts share a byte with the chance of their shingles' Jaccard similarity."""
    least = np.full(SIGNATURE, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[at : at + 2048, None] * FACTORS + SHIFTS).min(axis=0))
    return (least >> np.uint64(24)).astype(np.uint8).tobytes()


def similar_links(docs: DataFrame, marked: DataFrame, words: int, similarity: float, long: int = LONG) -> DataFrame:
    """Pairs (a, b) of fingerprints that connect texts of a Jaccard similarity of word shingles from ``similarity`` on. ``docs`` has unique ids; ``marked`` their fingerprints.

    At this similarity 64-bit SimHashes differ in some ten bits and need not share a byte, so the positional bytes are those of minwise hashes: each is shared with the chance of the
    similarity. The index has a list for every set of SET bytes; a pair is tallied over all SIGNATURE bytes and retained from five standard deviations below the
    expected number on; what is retained is verified by the shingles themselves, and where that refuses a forest's candidates, the others are verified too, unless links connect them already: see ``refused_links``. Of the texts only those that have candidates are shuffled.
    A pair meets in no list with a chance of (1 - similarity^3)^21, 3 in 10,000,000 at 0.8. Texts of the same set of shingles are one node.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = [shingle_hashes(t, words) for t in batch.pop("text").tolist()]
            batch["sig"] = [signature(h) if len(h) else None for h in hashes]
            batch["whole"] = [xxhash.xxh3_128_digest(h.tobytes()) for h in hashes]
            batch["size"] = np.fromiter(map(len, hashes), dtype=np.int64, count=len(hashes))
            yield batch

    expected = SIGNATURE * (similarity + (1 - similarity) / 256)
    kind = BySignature(max(1, math.floor(expected - 5 * math.sqrt(expected * (1 - expected / SIGNATURE)))))
    given = small_batches(docs).select("doc_id", F.col("text").cast("string").alias("text"))
    signed = written(map_rows(given, run, "sig binary, whole binary, size long").where("sig IS NOT NULL").join(marked, "doc_id"), "signatures")
    classes = signed.groupBy("whole").agg(F.min("doc_id").alias("node"), F.min("fp").alias("fp"), F.min("sig").alias("sig"), F.min("size").alias("size"))
    classes = written(classes.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node"), "classes")
    keys = F.array(*[F.substring("sig", 1 + SET * k, SET) for k in range(SIGNATURE // SET)])
    index = classes.select(F.posexplode(keys).alias("nth", "part"), "node", "sig")
    index = index.select((F.conv(F.hex("part"), 16, 10).cast("long") + F.col("nth") * F.lit(1 << (8 * SET))).alias("key"), "node", "sig")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["hashes"] = [shingle_hashes(t, words).view(np.int64) for t in batch.pop("text").tolist()]
            yield batch

    found, entries = links_and_longer(index, kind, long, longer=True)
    candidates = written(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "candidates")
    asked = candidates.select(F.col("a").alias("doc_id")).union(candidates.select("b")).distinct()
    sets = written(map_rows(only(given, asked), hashed, "hashes array<long>"), "shingles")
    both = candidates.join(sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    good = written(both.where(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b"), "similar")
    if not entries.isEmpty():
        good = good.unionAll(written(refused_links(entries, candidates, classes, sets, good, kind, similarity, long), "refused"))
    of = lambda side: classes.select(F.col("node").alias(side), F.col("fp").alias(f"fp_{side}"))
    apart = good.join(of("a"), "a").join(of("b"), "b").select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))
    alike = signed.select("fp", "whole").distinct().join(classes.select("whole", F.col("fp").alias("least")), "whole").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    return apart.unionAll(alike.where("a <> b"))


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, similar_words: int = 5) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, the smallest id that links lead to.

    With ``similarity``, texts of that Jaccard similarity of their shingles of ``similar_words`` words are linked as well; ids must then be unique.
    """
    marked = written(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    found = links(distinct.select("fp"), bits)
    if similarity is not None:
        found = found.unionAll(similar_links(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), marked, similar_words, similarity))
    joined = components(found).select(F.col("node").alias("fp"), "root")
    named = joined.join(distinct, "fp")
    least = named.groupBy("root").agg(F.min("first_id").alias("least_id"))
    named = named.join(least, "root").select("fp", "least_id")
    classes = distinct.join(named, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id"))
    # one row of classes for each fingerprint: AQE splits the partition of a fingerprint that many documents have
    rows = marked.join(classes, "fp")
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS, bits: int = BITS, similarity: float | None = None, similar_words: int = 5) -> DataFrame:
    """The documents without near-duplicates: of each component the one with the smallest doc_id, all columns as they are.

    Where ids are null or repeat, rows are numbered first, and the first row of a component stays. Columns may have any names.
    """
    return carrying(docs, lambda d: _one_each(d, words, bits, similarity, similar_words))


def _one_each(docs: DataFrame, words: int, bits: int, similarity: float | None, similar_words: int) -> DataFrame:
    ids = docs.select("doc_id").groupBy("doc_id").count().agg(F.max("count"), F.max(F.col("doc_id").isNull())).first()
    if ids[0] in (None, 1) and not ids[1]:
        return without(docs, written(near_duplicates(docs, words, bits, similarity=similarity, similar_words=similar_words).where("doc_id <> component_id").select("doc_id"), "duplicates"))
    numbered = written(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    gone = written(near_duplicates(numbered, words, bits, id_col="__row", similarity=similarity, similar_words=similar_words).where("doc_id <> component_id").select("doc_id"), "duplicates")
    return without(numbered, gone, "__row").select(*docs.columns)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
