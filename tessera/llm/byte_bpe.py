"""Byte-level BPE encoding and decoding of whole texts.

Texts are cut into pre-tokens. A pre-token's bytes, as Latin-1 characters, go once through an Aho-Corasick automaton of the vocabulary, which gives the
longest token that begins at each byte. From the left the encoder takes that token, or a shorter one that begins there, if it may stand behind the
token before; where none may, the place is dead, and the token before is taken back for a shorter one. Two tokens may stand side by side if the merges
that build them leave their border alone; this is worked out from the tokens' edges and remembered. A sequence of tokens is what merging by rank gives
exactly if all its neighbours may stand side by side, and no place dies twice, so the work is linear in the text's length.

Edge cases: a null text counts as empty (no ids); repeated rows and ids are encoded row by row; a text may be of any length, of which a worker holds one batch;
an empty table gives an empty result; other columns of the input are ignored, whatever their names. An id that the vocabulary doesn't have can't be decoded: an error.
"""

from __future__ import annotations

import base64
import gc
import json
import string
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_rows, small_batches, table, text_or_empty
from tessera.llm.packing import BLOCK_CHARS, ID_BYTES, ChunkIds
from tessera.llm.token_counts import CHUNK, PRE_TOKEN, byte_characters, vocabulary_path

#: Pairs of tokens that a worker remembers.
REMEMBERED_PAIRS = 2_000_000
NEVER = 2**31 - 1
#: ASCII marks: neither letters, nor numbers, nor white space. No pre-token parts two of them.
MARKS = string.punctuation


def read_ranks(path: str) -> list[bytes]:
    """The tokens by id, from a file of ranks or from a tokenizer's JSON; ids must be 0, 1, 2... and every byte a token."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in byte_characters().items()}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        found = {i: bytes(map(byte_of.__getitem__, t)) for t, i in spec["model"]["vocab"].items() if t not in special}
    else:
        with open(path, "rb") as f:
            found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    tokens = [found[i] for i in range(len(found))]
    if {bytes([b]) for b in range(256)} - set(tokens):
        raise ValueError("a byte-level vocabulary has every single byte")
    return tokens


class BytePairs:
    """Encodes byte strings by a vocabulary's ranks, and decodes ids."""

    def __init__(self, path: str):
        self.tokens = read_ranks(path)
        self.ids = {t: i for i, t in enumerate(self.tokens)}
        self.whole = {t.decode("latin-1"): i for t, i in self.ids.items()}
        self.lengths = array("i", map(len, self.tokens))
        self.size = len(self.tokens)
        self.may: dict[int, bool] = {}
        #: the token that two tokens merge to, by both; the tokens that begin, or end, where a token does, from its byte to itself
        self.merged: dict[int, int] = {}
        self.left_edge: list[tuple[int, ...] | None] = [None] * self.size
        self.right_edge: list[tuple[int, ...] | None] = [None] * self.size
        self.split_all()
        #: the longest shorter token that a token begins with, -1: none
        self.shorter = array("i", [-1]) * self.size
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(self.tokens):
            if self.left_edge[i] is None:
                continue
            self.automaton.add_word(t.decode("latin-1"), i)
            for n in range(len(t) - 1, 0, -1):
                k = self.ids.get(t[:n])
                if k is not None and self.left_edge[k] is not None:
                    self.shorter[i] = k
                    break
        self.automaton.make_automaton()

    def split_all(self) -> None:
        """The two tokens that each token is merged from: of all its cuts into two earlier tokens, the one whose sides may stand side by side.

        A token without such a cut is what merging never makes; it stands for a pre-token of just its bytes alone, as in the library.
        """
        for i, t in enumerate(self.tokens):
            if len(t) == 1:
                self.left_edge[i] = self.right_edge[i] = (i,)
                continue
            for n in range(len(t) - 1, 0, -1):
                a, b = self.ids.get(t[:n], NEVER), self.ids.get(t[n:], NEVER)
                if a < i and b < i and self.left_edge[a] and self.left_edge[b] and self.side_by_side(a, b):
                    self.merged[a * self.size + b] = i
                    self.left_edge[i] = (*self.left_edge[a], i)
                    self.right_edge[i] = (*self.right_edge[b], i)
                    break

    def side_by_side(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border of a and b while they are built.

        On the border lie, one after another, the tokens of a's right edge and of b's left edge; a token of an edge stands there until the merge of the next.
        Two that stand there together mustn't have a merge that comes first; of equal ranks the leftmost merges first.
        """
        right, left, size, merged = self.right_edge[a], self.left_edge[b], self.size, self.merged
        i, j, last_i, last_j = 0, 0, len(right) - 1, len(left) - 1
        while True:
            x, y = right[i], left[j]
            until_x = right[i + 1] if i < last_i else NEVER
            until_y = left[j + 1] if j < last_j else NEVER
            rank = merged.get(x * size + y, NEVER)
            if rank < until_x and rank <= until_y and rank != NEVER:
                return False
            if until_x == until_y == NEVER:
                return True
            if until_x <= until_y:
                i += 1
            else:
                j += 1

    def compatible(self, a: int, b: int) -> bool:
        """``side_by_side``, remembered in ``may``."""
        if len(self.may) >= REMEMBERED_PAIRS:
            self.may.clear()
        known = self.may[a * self.size + b] = self.side_by_side(a, b)
        return known

    def encode(self, word: str) -> list[int]:
        """The ids of one pre-token."""
        word = word if word.isascii() else word.encode().decode("latin-1")
        whole = self.whole.get(word)
        if whole is not None:
            return [whole]
        tokens = [token for _, token in self.automaton.iter_long(word)]
        size, may, last = self.size, self.may, tokens[0]
        for k in range(1, len(tokens)):
            token = tokens[k]
            fits = may.get(last * size + token)
            if fits is None:
                fits = self.compatible(last, token)
            if not fits:
                return self.backtrack(word, tokens[:k], token)
            last = token
        return tokens

    def backtrack(self, word: str, tokens: list[int], refused: int) -> list[int]:
        """The ids of a pre-token, as Latin-1, of which ``tokens`` agree with each other and the longest behind them, ``refused``, doesn't."""
        lengths, shorter, may, size, longest, whole = self.lengths, self.shorter, self.may, self.size, self.automaton.iter_long, len(word)
        at, dead, token = sum(map(lengths.__getitem__, tokens)), set(), shorter[refused]
        while True:
            while token < 0:  # nothing may begin here: the token before must be another
                dead.add(at)
                last = tokens.pop()
                at -= lengths[last]
                token = shorter[last]
            end = at + lengths[token]
            if end in dead:
                token = shorter[token]
                continue
            if tokens:
                fits = may.get(tokens[-1] * size + token)
                if fits is None:
                    fits = self.compatible(tokens[-1], token)
                if not fits:
                    token = shorter[token]
                    continue
            tokens.append(token)
            if end == whole:
                return tokens
            at, token = end, next(longest(word, end))[1]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of little-endian 32-bit ids."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=4)
def byte_pairs(path: str) -> BytePairs:
    return BytePairs(path)


class Encoder(ChunkIds):
    """Ids of whole texts, as little-endian 32-bit integers; each distinct chunk is encoded once while it is remembered.

    A chunk is a word, its marks and the one space before it; no pre-token crosses a chunk's edge.
    """

    def __init__(self, vocab: str):
        self.bpe, self.pattern = byte_pairs(vocabulary_path(vocab)), regex.compile(PRE_TOKEN)
        self.forget()

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        held, chars = [], 0
        for text in texts:
            held.append(CHUNK.findall(text))
            chars += len(text)
            if chars >= BLOCK_CHARS:
                yield from self.block(held)
                held, chars = [], 0
        if held:
            yield from self.block(held)

    def cut(self, chunk: str) -> list[str]:
        """The pre-tokens of a chunk. Letters, with or without a space before them, and ASCII marks behind them, as most chunks are, needn't go through the pattern."""
        word = chunk.rstrip(MARKS)
        if word.isalpha() or word[:1] == " " and word[1:].isalpha():
            return [chunk] if len(word) == len(chunk) else [word, chunk[len(word) :]]
        return self.pattern.findall(chunk)

    def learn(self, new: set[str]) -> None:
        """Takes in chunks: first their pre-tokens, each by itself, and then those of several."""
        chunks = list(new)
        cut = list(map(self.cut, chunks))
        alone = list(set(chain.from_iterable(cut)).difference(self.known))
        found = list(map(self.bpe.encode, alone))
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        self.add(alone, np.fromiter(chain.from_iterable(found), dtype="<u4", count=int(sizes.sum())), sizes)
        joined = [(c, words) for c, words in zip(chunks, cut, strict=True) if len(words) > 1]
        at = np.array([self.known[w] for _, words in joined for w in words], dtype=np.int64)
        starts = np.cumsum([0, *(len(words) for _, words in joined)])[:-1]
        self.add([c for c, _ in joined], self.ids_at(at), np.add.reduceat(self.sizes[at], starts) if joined else np.zeros(0, np.int64))


def encode(docs: DataFrame, vocab: str = "byte_bpe_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """One row per row of ``docs``: its id, n_tokens, and ``ids``, little-endian unsigned 32-bit integers; with ``decoded`` also the bytes that these ids decode to.

    A scan and a map: nothing is shuffled and a worker holds one Arrow batch. Special tokens are never made: their strings are plain text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(vocab)
        for batch in batches:
            gc.disable()  # millions of short lists and no cycles among them: the collector would go over all that is remembered
            try:
                found = list(encoder(batch.pop("text").tolist()))
            finally:
                gc.enable()
            batch["n_tokens"] = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // ID_BYTES
            batch["ids"] = found
            if decoded:
                batch["decoded"] = list(map(encoder.bpe.decode, found))
            yield batch

    given = small_batches(docs).select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return map_rows(given, run, "n_tokens long, ids binary" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, vocab: str = "byte_bpe_50k.tiktoken", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``encoded``: its id and ``decoded``, the bytes of its ids (null ids: null)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = byte_pairs(vocabulary_path(vocab))
        for batch in batches:
            batch["decoded"] = [None if ids is None else bpe.decode(ids) for ids in batch.pop("ids")]
            yield batch

    return map_rows(small_batches(encoded).select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")), run, "decoded binary")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode(table(spark, sf_dir, "documents"), decoded=True)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
