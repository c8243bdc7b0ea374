"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often over the corpus.

Documents are encoded by both vocabularies, a block of them at a time; in the block's bytes the ends of tokens are marked, and running counts over the marks give
groups (places where both end), links (pairs of tokens that overlap: one for each different end) and each document's share of them. What differs in a document's links is
written once: id pairs, documents and multiplicities, dealt to stripes by the first id. The pairs of a stripe are counted in a dense matrix, one row for each of its ids,
by adding at their cells; the row maxima are the best counts. Links then meet the matrix of their stripe, and what they score is summed for each document.

A stripe of a large corpus is dealt to as many tasks as blocks require, ``GROUP_BLOCKS`` blocks each, so that no task holds more than that; their counts are added up, and the sums
go back to each of them. A pair's count is the number of rows that hold it, so nothing is expanded within a hot pair.

Edge cases: a text that is null or empty, or that a vocabulary doesn't give back byte by byte, has no tokens (zeros, an empty string); repeated rows count row by row;
special strings in texts are plain text; a document of any length is one block at most; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pandas as pd
import regex
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.byte_bpe import byte_pairs
from tessera.llm.common import map_rows, small_batches, table, text_or_empty, written
from tessera.llm.packing import BLOCK_CHARS, ChunkIds
from tessera.llm.token_counts import PRE_TOKEN, SOLID, SPACE, vocabulary_path

#: Bytes and documents of a block, blocks of a task's links, and first ids of a stripe: a stripe's matrix has so many rows.
BLOCK_BYTES, BLOCK_DOCS, GROUP_BLOCKS, STRIPE_IDS = 4_000_000, 1_000, 256, 512
#: Bits of a document's number in its block.
DOC_BITS = 16
SPACE_MARK = "▁"
#: A word and the white space before it, and white space at the end. Words part only before a space or line feed: pieces hold other white space behind marks. SPACE_MARK is a letter here.
OTHER = r"[^\S\x1c-\x1f \n]"
SPACED = re.compile(f"{SPACE}*{SOLID}+(?:{OTHER}{SPACE}*{SOLID}*)*|{SPACE}+")
#: What is added to ids of the second vocabulary, and the mark of a chunk that it doesn't give back.
SECOND, INEXACT = 1 << 31, (1 << 32) - 1
#: Pre-tokens whose ids a worker remembers beside its chunks, and chunks that it keeps for its next task.
REMEMBERED_WORDS, KEPT = 250_000, 60_000


class Pieces:
    """A vocabulary of pieces with byte fallback, the bytes of each, and whether a text may be cut behind a word: no piece holds a space or line feed behind anything else."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        names = list(map(self.model.id_to_piece, range(self.size)))
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(names)]
        self.lengths = np.fromiter(map(len, self.bytes), dtype=np.int64, count=self.size)
        self.space = self.model.piece_to_id(SPACE_MARK)
        self.cut = not any(re.search(f"[^ \n{SPACE_MARK}][ \n{SPACE_MARK}]", p) for p in names)


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


class PairIds(ChunkIds):
    """Ids of a space and a text under both vocabularies, as little-endian 32-bit integers: the second's have SECOND added.

    Each distinct chunk, a word and the white space before it, is encoded once. A chunk that the second vocabulary doesn't give back byte by byte has INEXACT among its ids.
    """

    def __init__(self, vocab_a: str, vocab_b: str):
        self.bpe, self.pattern, self.pieces = byte_pairs(vocabulary_path(vocab_a)), regex.compile(PRE_TOKEN), pieces(vocabulary_path(vocab_b))
        self.forget()

    def forget(self) -> None:
        super().forget()
        self.words: dict[str, list[int]] = {}

    def forget_but(self, most: int) -> None:
        """Leaves the chunks that were used most."""
        names, keep = list(self.known), np.sort(np.argsort(-self.uses, kind="stable")[:most])
        ids, sizes, uses = self.ids_at(keep), self.sizes[keep], self.uses[keep] // 2
        self.forget()
        self.add([names[k] for k in keep.tolist()], ids, sizes)
        self.uses = uses

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        held, chars = [], 0
        for text in texts:
            held.append(SPACED.findall(" " + text) if text else [])
            chars += len(text)
            if chars >= BLOCK_CHARS:
                yield from self.block(held)
                held, chars = [], 0
        if held:
            yield from self.block(held)

    def first(self, chunk: str) -> list[int]:
        words, out = self.words, []
        for word in [chunk] if chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()) else self.pattern.findall(chunk):
            ids = words.get(word)
            if ids is None:
                ids = words[word] = self.bpe.encode(word)
            out += ids
        return out

    def second(self, chunks: list[str]) -> list[list[int]]:
        """The model puts a space before what it is given: that of a chunk, or one that goes again."""
        space, lengths, bytes_of = self.pieces.space, self.pieces.lengths, self.pieces.bytes
        found = self.pieces.model.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        lost = set()
        for k, chunk in enumerate(chunks):
            if chunk == " ":
                found[k] = [space]
            elif chunk[0] != " ":
                lost |= {k} if found[k][:1] != [space] else set()
                found[k] = found[k][1:]
        # all at once, and one by one only if that isn't so
        raw, sizes = [c.encode() for c in chunks], np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        flat = list(chain.from_iterable(found))
        ends = np.r_[0, np.cumsum(lengths[np.array(flat, dtype=np.int64)])][np.cumsum(sizes)]
        if lost or b"".join(map(bytes_of.__getitem__, flat)) != b"".join(raw) or ends.tolist() != list(accumulate(map(len, raw))):
            found = [ids if k not in lost and b"".join([bytes_of[i] for i in ids]) == want else [INEXACT - SECOND] for k, (ids, want) in enumerate(zip(found, raw, strict=True))]
        return found

    def learn(self, new: set[str]) -> None:
        chunks = list(new)
        if len(self.words) > REMEMBERED_WORDS:
            self.words.clear()
        one, two = list(map(self.first, chunks)), self.second(chunks) if chunks else []
        sizes_one, sizes_two = (np.fromiter(map(len, x), dtype=np.int64, count=len(x)) for x in (one, two))
        # a chunk's ids of the first vocabulary, then those of the second
        ids = np.empty(int(sizes_one.sum() + sizes_two.sum()), dtype="<u4")
        is_first = np.ones(len(ids), dtype=bool)
        is_first[np.arange(int(sizes_two.sum())) + np.repeat(np.cumsum(sizes_one), sizes_two)] = False
        ids[is_first] = np.fromiter(chain.from_iterable(one), dtype="<u4", count=int(sizes_one.sum()))
        ids[~is_first] = np.fromiter(chain.from_iterable(two), dtype="<u4", count=int(sizes_two.sum())) + np.uint32(SECOND)
        self.add(chunks, ids, sizes_one + sizes_two)


class Aligned:
    """The tokens of a block of texts, one after another, and what their ends say. ``sizes``: the bytes of each text with its space, 0 for one without tokens."""

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], lengths_a: np.ndarray, lengths_b: np.ndarray, sizes: list[int]):
        self.a, self.b = (np.concatenate(ids).astype(np.int64) for ids in (a, b))
        ends_a, ends_b, doc_ends = np.cumsum(lengths_a[self.a]), np.cumsum(lengths_b[self.b]), np.cumsum(sizes)
        at_a, at_b = (np.zeros(sum(sizes) + 1, dtype=bool) for _ in range(2))
        at_a[ends_a] = at_b[ends_b] = True
        both = at_a & at_b
        upto_a, upto_b, upto_both = (np.cumsum(marks, dtype=np.int32) for marks in (at_a, at_b, both))
        self.n_a, self.n_b, self.n_groups = (np.diff(counts[doc_ends], prepend=0).astype(np.int64) for counts in (upto_a, upto_b, upto_both))
        self.n_links = self.n_a + self.n_b - self.n_groups
        # before each different end lies exactly one token of each side
        link_ends = np.flatnonzero(at_a | at_b)
        self.link_a, self.link_b = self.a[upto_a[link_ends] - at_a[link_ends]], self.b[upto_b[link_ends] - at_b[link_ends]]
        self.link_doc = np.repeat(np.arange(len(sizes)), self.n_links)
        # the order of ``groups``: a token stands behind the other side's tokens of earlier groups, and of its own for the second side
        common = np.flatnonzero(both)
        a_upto, b_before = upto_a[common], np.r_[0, upto_b[common][:-1]]
        self.place_a = np.arange(len(self.a)) + (b_before[upto_both[ends_a] - both[ends_a]] if len(self.a) else 0)
        self.place_b = np.arange(len(self.b)) + (a_upto[upto_both[ends_b] - both[ends_b]] if len(self.b) else 0)
        self.last_a, self.last_b = both[ends_a], both[ends_b]

    def groups(self) -> list[bytes]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
        ids, marks = np.empty(len(self.a) + len(self.b), dtype=np.int64), np.empty(len(self.a) + len(self.b), dtype=np.uint8)
        ids[self.place_a], ids[self.place_b] = self.a, self.b
        marks[self.place_a], marks[self.place_b] = np.where(self.last_a, ord("|"), ord(",")), np.where(self.last_b, ord(";"), ord(","))
        digits, widths = spelled(int(ids.max(initial=0)).bit_length())
        widths = widths[ids]
        letters = digits[ids]
        letters[np.arange(len(ids)), widths] = marks
        text = letters[np.arange(letters.shape[1]) <= widths[:, None]].tobytes()
        ends = np.r_[0, np.cumsum(widths + 1)][np.cumsum(self.n_a + self.n_b)].tolist()
        return [text[max(start, 0) : max(end - 1, start)] for start, end in zip([0, *ends[:-1]], ends, strict=True)]

    def by_stripe(self, stripes: int, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each stripe: cells of its matrix in order, documents and multiplicities of the different links."""
        cell = (self.link_a % stripes * STRIPE_IDS + self.link_a // stripes) * width + self.link_b
        key, times = np.unique(cell << DOC_BITS | self.link_doc, return_counts=True)
        cell, doc = key >> DOC_BITS, key & ((1 << DOC_BITS) - 1)
        of = cell // (STRIPE_IDS * width)
        cuts = np.flatnonzero(np.diff(of, prepend=-1))
        for start, end in zip(cuts, np.r_[cuts, len(of)][1:], strict=True):
            yield int(of[start]), cell[start:end] - of[start] * STRIPE_IDS * width, doc[start:end], times[start:end]


@lru_cache(maxsize=4)
def spelled(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of each number below 2^bits, from the left, with room for a mark behind; and how many there are."""
    names = list(map(str, range(1 << bits)))
    widths = np.fromiter(map(len, names), dtype=np.int64, count=len(names))
    return np.array(names, dtype=f"S{widths[-1] + 1}").view(np.uint8).reshape(len(names), -1), widths


class Aligner:
    """Aligns texts under two vocabularies: a byte-level one, given a space and the text, and one of pieces, which adds the space itself."""

    def __init__(self, vocab_a: str, vocab_b: str):
        self.ids = PairIds(vocab_a, vocab_b)
        self.size_a, self.size_b = self.ids.bpe.size, self.ids.pieces.size
        self.lengths_a = np.array(self.ids.bpe.lengths, dtype=np.int64)
        self.stripes = -(-self.size_a // STRIPE_IDS)

    def whole(self, text: str) -> np.ndarray:
        """The second vocabulary's ids of a text that it wasn't given in chunks; none if their bytes aren't the text's."""
        ids = self.ids.pieces.model.encode(text)
        exact = b"".join([self.ids.pieces.bytes[i] for i in ids]) == b" " + text.encode()
        return np.array(ids if exact else [], dtype="<u4")

    def __call__(self, texts: list[str]) -> Aligned:
        a, b, sizes = [], [], []
        for text, packed in zip(texts, self.ids(texts), strict=True):
            ids = np.frombuffer(packed, dtype="<u4")
            first = ids < SECOND
            one, two = ids[first], ids[~first]
            two = two - np.uint32(SECOND) if self.ids.pieces.cut and not (two == INEXACT).any() else self.whole(text)
            size = len(text.encode()) + 1 if len(two) else 0
            if size and self.lengths_a[one].sum() != size:
                raise ValueError("byte-level tokens don't give back a text's bytes")
            a.append(one if size else two)
            b.append(two)
            sizes.append(size)
        return Aligned(a, b, self.lengths_a, self.ids.pieces.lengths, sizes)


@lru_cache(maxsize=1)
def aligner(vocab_a: str, vocab_b: str) -> Aligner:
    """A worker's own, which tasks that follow each other share."""
    return Aligner(vocab_a, vocab_b)


def blocks_of(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The batch in blocks of BLOCK_DOCS rows and, but for a longer text, BLOCK_BYTES bytes at most."""
    start, held = 0, 0
    for k, text in enumerate(batch["text"]):
        size = len(text) if text.isascii() else len(text.encode())
        if k > start and (held + size > BLOCK_BYTES or k - start == BLOCK_DOCS):
            yield batch.iloc[start:k]
            start, held = k, 0
        held += size
    if start < len(batch):
        yield batch.iloc[start:]


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return small_batches(docs).select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))


def groups(docs: DataFrame, vocab_a: str = "byte_bpe_50k.tiktoken", vocab_b: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and ``groups``, the aligned ids as ``a1,a2|b1;a3|b2,b3``. A scan and a map."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        align = Aligner(vocab_a, vocab_b)
        for batch in batches:
            for block in blocks_of(batch):
                yield pd.DataFrame({"doc_id": block["doc_id"], "groups": [g.decode() for g in align(block["text"].tolist()).groups()]})

    return map_rows(texts_of(docs, id_col, text_col), run, "groups string")


def encoded(docs: DataFrame, vocab_a: str, vocab_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of documents (``stripe`` is null), by block and number in it, and rows of links: those of a block and stripe, packed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        align = aligner(vocab_a, vocab_b)
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        for batch in batches:
            for block in blocks_of(batch):
                found = align(block["text"].tolist())
                hashes = [hashlib.sha256(g).hexdigest() if g else "" for g in found.groups()]
                yield frame({"doc_id": block["doc_id"].tolist(), "block": number, "at": np.arange(len(block)), "n_a": found.n_a, "n_b": found.n_b, "n_groups": found.n_groups, "n_links": found.n_links, "groups_sha256": hashes}, len(block))
                rows = [(s, c.astype("<u4").tobytes(), d.astype("<u2").tobytes(), t.astype("<u4").tobytes()) for s, c, d, t in found.by_stripe(align.stripes, align.size_b)]
                if rows:
                    yield frame({"block": number, **{n: [r[k] for r in rows] for k, n in enumerate(("stripe", "cells", "docs", "times"))}}, len(rows))
                number += 1
        align.ids.forget_but(KEPT)

    kinds = {"block": "long", "at": "int", "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string", "stripe": "int", "cells": "binary", "docs": "binary", "times": "binary"}

    def frame(columns: dict, rows: int) -> pd.DataFrame:
        """Columns by name, the others null."""
        return pd.DataFrame({c: pd.Series(columns.get(c), index=range(rows), dtype=object) for c in ("doc_id", *kinds)})

    return map_rows(texts_of(docs, id_col, text_col), run, ", ".join(f"{c} {k}" for c, k in kinds.items()))


def stripe_counts(links: DataFrame, width: int) -> DataFrame:
    """stripe, cell, n: how many documents hold the pair of a cell. ``links`` has ``stripe`` and ``salt``."""

    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        matrix, used = np.zeros(STRIPE_IDS * width, dtype=np.int32), np.zeros(STRIPE_IDS, dtype=bool)
        for packed in rows["cells"]:
            cells = np.frombuffer(packed, dtype="<u4")
            np.add.at(matrix, cells, 1)
            used[cells // width] = True
        found = [row * width + np.flatnonzero(matrix[row * width : (row + 1) * width]) for row in np.flatnonzero(used)]
        cells = np.concatenate(found) if found else np.zeros(0, np.int64)
        return pd.DataFrame({"stripe": np.full(len(cells), key[0], dtype=np.int32), "cell": cells, "n": matrix[cells].astype(np.int64)})

    found = links.select("stripe", "salt", "cells").groupBy("stripe", "salt").applyInPandas(count, "stripe int, cell long, n long")
    return found.groupBy("stripe", "cell").agg(F.sum("n").alias("n"))


def scored(links: DataFrame, counts: DataFrame, salts: int, width: int) -> DataFrame:
    """block, at, n_best, count_sum of each document that has links; the links of a stripe's share meet the stripe's whole matrix."""
    by_row = counts.groupBy("stripe", (F.col("cell") / width).cast("int").alias("row")).agg(F.collect_list("cell").alias("cells"), F.collect_list("n").alias("ns"))  # as many as the second vocabulary has ids, at most
    by_row = by_row.select("stripe", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "row", "cells", "ns")

    def score(key: tuple, rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        matrix, best, out = np.zeros(STRIPE_IDS * width, dtype=np.int64), np.zeros(STRIPE_IDS, dtype=np.int64), []
        for row, cells, ns in zip(known["row"], known["cells"], known["ns"], strict=True):
            matrix[np.asarray(cells)] = ns
            best[row] = matrix[row * width : (row + 1) * width].max()
        for block, cells, docs, times in zip(rows["block"], rows["cells"], rows["docs"], rows["times"], strict=True):
            cells, docs, times = np.frombuffer(cells, dtype="<u4"), np.frombuffer(docs, dtype="<u2"), np.frombuffer(times, dtype="<u4").astype(np.int64)
            count = matrix[cells]
            sums = np.zeros((2, int(docs.max()) + 1), dtype=np.int64)
            np.add.at(sums[0], docs, np.where(count == best[cells // width], times, 0))
            np.add.at(sums[1], docs, count * times)
            at = np.unique(docs)
            out.append(pd.DataFrame({"block": block, "at": at.astype(np.int32), "n_best": sums[0, at], "count_sum": sums[1, at]}))
        return pd.concat(out) if out else pd.DataFrame({"block": [], "at": [], "n_best": [], "count_sum": []}, dtype=np.int64)

    met = links.groupBy("stripe", "salt").cogroup(by_row.groupBy("stripe", "salt")).applyInPandas(score, "block long, at int, n_best long, count_sum long")
    return met.groupBy("block", "at").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def prepared(docs: DataFrame, vocab_a: str, vocab_b: str, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int]:
    """The documents' rows and the links, both from one written table, and the number of shares of a stripe."""
    both = written(encoded(docs, vocab_a, vocab_b, id_col, text_col), "aligned")
    kept = both.where("stripe IS NULL")
    salts = max(1, -(-kept.where("at = 0").count() // GROUP_BLOCKS))
    links = both.where("stripe IS NOT NULL").select("stripe", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"), "block", "cells", "docs", "times")
    return kept, links.repartition("stripe", "salt"), salts


def pair_counts(docs: DataFrame, vocab_a: str = "byte_bpe_50k.tiktoken", vocab_b: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a, b, n_docs: each pair of ids that overlap somewhere and the number of documents that hold it; the dictionary between the vocabularies."""
    _, links, _ = prepared(docs, vocab_a, vocab_b, id_col, text_col)
    align = Aligner(vocab_a, vocab_b)
    row = F.floor(F.col("cell") / align.size_b)
    return stripe_counts(links, align.size_b).select((row * align.stripes + F.col("stripe")).alias("a"), (F.col("cell") % align.size_b).alias("b"), F.col("n").alias("n_docs"))


def alignment(docs: DataFrame, vocab_a: str = "byte_bpe_50k.tiktoken", vocab_b: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, n_a and n_b tokens, n_groups, n_links, n_best (links that are their first id's most frequent), count_sum (of all links), and a digest of its groups."""
    kept, links, salts = prepared(docs, vocab_a, vocab_b, id_col, text_col)
    width = pieces(vocabulary_path(vocab_b)).size
    sums = scored(links, stripe_counts(links, width), salts, width)
    none = F.lit(0).cast("long")
    made = kept.select("doc_id", "block", "at", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, ["block", "at"], "left")
    return made.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents")).withColumn("doc_id", F.col("doc_id").cast("long"))
