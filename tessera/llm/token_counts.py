"""Token counts of whole texts under a byte-level BPE vocabulary.

Texts are cut into pre-tokens; the pre-tokens not seen before are held as one ragged numpy array of symbols. In every round each
sequence finds its lowest-ranked neighbouring pair and all sequences merge theirs at the same time, until no pair of any sequence is
in the vocabulary's merge list. What remains of a sequence are its tokens; they are counted, never built.

Edge cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows and ids are counted row by row; an empty table gives an empty
result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_rows, small_batches, table, text_or_empty

#: Fixed value: the byte-level pre-token pattern that the vocabulary was made with.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space here leaves out U+001C to U+001F, which Python's ``re`` counts in and the pre-token pattern doesn't.
SPACE, SOLID = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
CHUNK = re.compile(f"{SPACE}?{SOLID}+|{SPACE}+(?!{SOLID})|{SPACE}+")
#: Characters of text whose chunks are held at a time, and chunks remembered by a worker.
BLOCK_CHARS, REMEMBERED = 1_000_000, 400_000
NO_RANK = np.int32(2**31 - 1)


def byte_characters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stays, other bytes follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class RankMerger:
    """Merges the symbols of many pre-tokens at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.size = len(vocab) + 1
        suffix = spec["model"].get("end_of_word_suffix") or ""
        characters = [c for _, c in sorted(byte_characters().items())]
        self.of_byte = np.array([vocab[c] for c in characters], dtype=np.int64)
        self.of_last_byte = np.array([vocab[c + suffix] for c in characters], dtype=np.int64)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        added = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.pattern = regex.compile(PRE_TOKEN)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """The number of tokens of each non-empty byte string."""
        return self.merge(words)[1]

    def merge(self, words: list[bytes], symbols_too: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of non-empty byte strings one after another (if ``symbols_too``), and the number of each string's."""
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        out, done = length.copy(), []
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols = self.of_byte[raw]
        last = np.cumsum(length) - 1
        symbols[last] = self.of_last_byte[raw[last]]
        owner = np.repeat(np.arange(len(words)), length)
        # ranks[i] belongs to the pair (i, i + 1); the last symbol of a sequence has no pair
        ranks = np.full(len(symbols), NO_RANK, dtype=np.int32)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        ranks[inner] = self.rank(symbols[inner], symbols[inner + 1])
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(symbols)])
            lowest = np.minimum.reduceat(ranks, starts)
            live = lowest != NO_RANK
            if not live.all():
                out[owner[starts[~live]]] = sizes[~live]
                stay = np.repeat(live, sizes)
                if symbols_too:
                    done.append((owner[~stay], symbols[~stay]))
                symbols, owner, ranks = symbols[stay], owner[stay], ranks[stay]
                sizes, lowest = sizes[live], lowest[live]
                if not len(symbols):
                    break
            hit = np.flatnonzero(ranks == np.repeat(lowest, sizes))
            # of equal pairs that overlap, as in "aaa", every second one merges, from the left
            chained = np.r_[False, (hit[1:] == hit[:-1] + 1) & (owner[hit[1:]] == owner[hit[:-1]])]
            if chained.any():
                place = np.arange(len(hit))
                first = np.maximum.accumulate(np.where(chained, 0, place))
                hit = hit[(place - first) % 2 == 0]
            symbols[hit] = self.made[ranks[hit]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[hit + 1] = False
            moved = np.cumsum(keep) - 1
            symbols, owner, ranks = symbols[keep], owner[keep], ranks[keep]
            at = moved[hit]
            ranks[at] = NO_RANK
            near = np.zeros(len(symbols), dtype=bool)
            near[at] = near[np.maximum(at - 1, 0)] = True
            near[-1] = False
            near[:-1] &= owner[1:] == owner[:-1]
            fresh = np.flatnonzero(near)
            ranks[fresh] = self.rank(symbols[fresh], symbols[fresh + 1])
        if not done:
            return symbols, out
        order = np.argsort(np.concatenate([o for o, _ in done]), kind="stable")
        return np.concatenate([x for _, x in done])[order], out


@lru_cache(maxsize=4)
def merger(path: str) -> RankMerger:
    return RankMerger(path)


def vocabulary_path(vocab: str) -> str:
    """A path as it is, or the place of a public tokenizer's file by its name."""
    if "/" in vocab:
        return vocab
    import public_tokenizers

    return public_tokenizers.path(vocab)


class TokenCounter:
    """Counts tokens text by text, with a bounded memory of chunks: a word, its punctuation and the one space before it.

    No pre-token crosses a chunk's edge, so a text's count is the sum of its chunks' counts.
    """

    def __init__(self, vocab: str):
        self.bpe, self.known = merger(vocabulary_path(vocab)), {}

    def chunks(self, text: str) -> tuple[list[str], int]:
        """The chunks of a text and the number of special tokens between them."""
        special = self.bpe.special
        if special is None or "<|" not in text:
            return CHUNK.findall(text), 0
        parts = special.split(text)
        return [w for part in parts for w in CHUNK.findall(part)], len(parts) - 1

    def __call__(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        held: list[tuple[list[str], int]] = []
        chars = 0
        for text in texts:
            held.append(self.chunks(text))
            chars += len(text)
            if chars >= BLOCK_CHARS:
                out += self.block(held)
                held, chars = [], 0
        return out + self.block(held)

    def block(self, held: list[tuple[list[str], int]]) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list({w for words, _ in held for w in words}.difference(self.known))
        if new:
            pieces = list(map(self.bpe.pattern.findall, new))
            counts = self.bpe.counts([w.encode() for p in pieces for w in p])
            starts = np.cumsum([0, *map(len, pieces[:-1])])
            self.known.update(zip(new, np.add.reduceat(counts, starts).tolist(), strict=True))
        get = self.known.__getitem__
        return [extra + sum(map(get, words)) for words, extra in held]


def token_counts(docs: DataFrame, vocab: str = "byte_bpe_50k.json", limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, n_bytes, n_tokens and whether it has more than ``limit`` tokens.

    A scan and a map: nothing is shuffled and a worker holds one Arrow batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = TokenCounter(vocab)
        for batch in batches:
            batch["n_tokens"] = np.array(count(batch.pop("text").tolist()), dtype=np.int64)
            yield batch

    given = small_batches(docs).select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    given = given.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    counted = map_rows(given, run, "n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
