"""Sum-of-squares online packing of tokenized documents into sequences.

Documents come one by one. What is longer than a sequence first fills whole sequences; the rest, of s tokens, goes to the fill level h
(0: a new sequence) for which the sum of the squared counts of partly filled sequences grows least, read from an array that has
the count of each level. When a partition of the input ends, its partly filled sequences are closed: the emptiest are cut up to fill
the fullest, and the one that remains becomes sequences whose lengths are powers of two. So nothing is padded at all.

Each partition packs its own documents: nothing is shuffled, and a task that runs again packs the same way. A worker holds the ids of its partly filled
sequences (of a document its last piece alone), which are fewer than the squares' rule lets pile up, one block of texts and a bounded cache of chunks.

Edge cases: a null text counts as empty, and an empty text is the end token alone; repeated rows are packed as often as they occur; an
empty table gives an empty result; very long texts are cut into whole sequences; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_rows, small_batches, table, text_or_empty
from tessera.llm.token_counts import merger, vocabulary_path

#: Characters of text that are cut up at a time, and chunks whose ids a worker remembers.
BLOCK_CHARS, REMEMBERED = 500_000, 300_000
PLAIN = re.compile("[\\x00-\u024f]*")
#: The one letter below U+0250 whose lower case is more than letters.
DOTTED_I = "\u0130"
#: Marks that are often a word's end.
MARKS = (",", ".")
ID_BYTES = 4


def small_letters(chunk: str) -> bool:
    return chunk.isalpha() and chunk.islower() and PLAIN.fullmatch(chunk) is not None


class ChunkIds:
    """Token ids of texts under a lower-case vocabulary that drops white space.

    No token crosses a space, so a text's ids are the ids of its chunks between spaces in order, and each distinct chunk is tokenized once: chunks of
    letters alone many at a time by rank-synchronous merging, others by the tokenizer itself. No token holds both a letter and a comma or full stop, so
    a word that ends in one has the word's ids and the mark's. Ids lie one after another in ``pool``; a chunk has its place in ``starts`` and ``sizes``.
    """

    def __init__(self, vocab: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; each thread would keep memory of its own
        from tokenizers import Tokenizer

        path = vocabulary_path(vocab)
        self.tokenizer, self.bpe = Tokenizer.from_file(path), merger(path)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.sizes, self.uses, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def forget_rare(self) -> None:
        """Leaves the half of REMEMBERED chunks that were used most; older uses count half from then on."""
        names, keep = list(self.known), np.sort(np.argsort(-self.uses, kind="stable")[: REMEMBERED // 2])
        ids, sizes, uses = self.ids_at(keep), self.sizes[keep], self.uses[keep] // 2
        self.forget()
        self.add([names[k] for k in keep.tolist()], ids, sizes)
        self.uses = uses

    def ids_at(self, at: np.ndarray) -> np.ndarray:
        """The ids of the chunks in these places, one after another."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        return self.pool[np.arange(ends[-1] if len(at) else 0) + np.repeat(self.starts[at] - (ends - sizes), sizes)]

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        held, chars = [], 0
        for text in texts:
            # below U+0250 nothing combines, and lower case doesn't depend on what stands around a letter
            if PLAIN.fullmatch(text) and DOTTED_I not in text:
                text = text.lower()
            held.append(text.replace("\n", " ").split(" "))
            chars += len(text)
            if chars >= BLOCK_CHARS:
                yield from self.block(held)
                held, chars = [], 0
        if held:
            yield from self.block(held)

    def block(self, held: list[list[str]]) -> Iterator[bytes]:
        flat = list(chain.from_iterable(held))
        if len(self.known) > REMEMBERED:
            self.forget_rare()
        self.learn(set(flat).difference(self.known))
        at = np.fromiter(map(self.known.__getitem__, flat), dtype=np.int64, count=len(flat))
        self.uses += np.bincount(at, minlength=len(self.uses))
        ids, last = self.ids_at(at).tobytes(), 0
        for end in np.r_[0, np.cumsum(self.sizes[at])][np.cumsum([len(c) for c in held])].tolist():
            yield ids[last * ID_BYTES : end * ID_BYTES]
            last = end

    def learn(self, new: set[str]) -> None:
        known = self.known
        lower = {w for w in new if small_letters(w)}
        rest = new - lower
        marked = [w for w in rest if w[-1:] in MARKS and small_letters(w[:-1])]
        alone = [*rest.difference(marked), *(m for m in MARKS if m not in known and m not in rest)]
        lower.update(w[:-1] for w in marked if w[:-1] not in known)
        ordered = list(lower)
        self.add(ordered, *self.bpe.merge([w.encode() for w in ordered], symbols_too=True))
        found = [x.ids for x in self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)]
        self.add(alone, np.array([*chain.from_iterable(found)], dtype="<u4"), np.array([*map(len, found)], dtype=np.int64))
        at = np.array([p for w in marked for p in (known[w[:-1]], known[w[-1]])], dtype=np.int64)  # a word's ids and its mark's
        self.add(marked, self.ids_at(at), self.sizes[at].reshape(-1, 2).sum(axis=1))

    def add(self, chunks: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.known.update(zip(chunks, range(len(self.starts), len(self.starts) + len(chunks)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
        self.sizes, self.pool = np.concatenate([self.sizes, sizes]), np.concatenate([self.pool, ids.astype("<u4")])
        self.uses = np.concatenate([self.uses, np.zeros(len(chunks), dtype=np.int64)])


@dataclass(frozen=True)
class Piece:
    """``length`` ids of a document from ``start`` on; ``ids`` begin at the document's id ``base``."""

    doc: object
    doc_tokens: int
    base: int
    ids: bytes
    start: int
    length: int

    def cut(self, n: int) -> tuple[Piece, Piece]:
        """The first n ids and what is behind them."""
        return replace(self, length=n), replace(self, start=self.start + n, length=self.length - n)

    def checksum(self) -> int:
        at = (self.start - self.base) * ID_BYTES
        return zlib.crc32(self.ids[at : at + self.length * ID_BYTES])


class Level:
    """Partly filled sequences by fill level, packed by the sum-of-squares rule."""

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = defaultdict(list)
        self.full: list[list] = []

    def place(self, piece: Piece, s: int) -> None:
        """Puts a piece of s tokens, 0 < s <= size, where the squares grow least; ties go to the fullest sequence."""
        c, size = self.count, self.size
        # from level h to h + s: (c[h] - 1)^2 - c[h]^2 + (c[h + s] + 1)^2 - c[h + s]^2; levels 0 and size aren't counted
        levels = np.arange(size - s + 1)
        change = 2 * (c[levels + s] - c[levels]) + 2
        change[0] -= 1
        change[-1] -= 2 * c[size] + 1
        change[1:][c[1 : size - s + 1] == 0] = np.iinfo(np.int64).max
        h = int(size - s - np.argmin(change[::-1]))
        at = self.open[h].pop() if h else []
        at.append((piece, s))
        if h:
            c[h] -= 1
        if h + s == size:
            self.full.append(at)
        else:
            c[h + s] += 1
            self.open[h + s].append(at)

    def close(self) -> list[list]:
        """The sequences that are left, none padded: full ones and, at the end, some of a power of two tokens each."""
        left = [seq for h in sorted(self.open, reverse=True) for seq in self.open[h]]
        out, room = [], []
        i, j = 0, len(left) - 1
        donor: list = []
        while i <= j or donor:
            if i <= j:
                room = left[i]
                i += 1
            else:
                room, donor = donor, []
            need = self.size - sum(n for _, n in room)
            while need:
                if not donor:
                    if i > j:
                        break
                    donor = left[j]
                    j -= 1
                (piece, n) = donor.pop()
                take = min(n, need)
                if n > take:  # the front of the piece stays with the donor
                    front, piece = piece.cut(n - take)
                    donor.append((front, n - take))
                room.append((piece, take))
                need -= take
            out += [room] if not need else binary(room, self.size)
        self.open.clear()
        self.count[:] = 0
        return out


def binary(pieces: list, size: int) -> list[list]:
    """Pieces of less than ``size`` tokens as sequences of powers of two."""
    rest, out = list(pieces), []
    total = sum(n for _, n in rest)
    power = 1
    while power * 2 <= size:
        power *= 2
    while total:
        if power > total:
            power //= 2
            continue
        seq, need = [], power
        while need:
            piece, n = rest.pop(0)
            take = min(n, need)
            if n > take:
                piece, behind = piece.cut(take)
                rest.insert(0, (behind, n - take))
            seq.append((piece, take))
            need -= take
        out.append(seq)
        total -= power
    return out


def pack(docs: DataFrame, vocab: str = "word_bpe_49k.json", size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, and a checksum of its ids.

    sequence_id: the input partition's number in the upper bits, a running number in the lower 33.
    """
    if size < 1:
        raise ValueError("size must be 1 or more")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of, levels = ChunkIds(vocab), Level(size)
        next_id = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        rows: list[tuple] = []

        def emit(seq: list) -> None:
            nonlocal next_id
            offset = 0
            for piece, _ in seq:
                rows.append((piece.doc, piece.start, piece.length, piece.checksum(), piece.doc_tokens, next_id, offset))
                offset += piece.length
            next_id += 1

        for batch in batches:
            for doc, ids in zip(batch["doc_id"].tolist(), ids_of(batch["text"].tolist()), strict=True):
                doc = None if doc is None or doc != doc else doc
                ids += end
                n = len(ids) // ID_BYTES
                for start in range(0, n - size + 1, size):
                    emit([(Piece(doc, n, 0, ids, start, size), size)])
                if n % size:
                    base = n - n % size
                    levels.place(Piece(doc, n, base, ids[base * ID_BYTES :], base, n - base), n - base)
                    for seq in levels.full:
                        emit(seq)
                    levels.full.clear()
            yield as_frame(rows, columns)
            rows.clear()
        ids_of.forget()
        for seq in levels.close():
            emit(seq)
        yield as_frame(rows, columns)

    def as_frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=names, dtype=object)
        return frame.astype(dict.fromkeys(names[1:], "int64"))

    given = small_batches(docs).select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return map_rows(given, run, "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
