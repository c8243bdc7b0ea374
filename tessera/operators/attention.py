"""Attention maps from queries and keys, or from attention tensors: token layout, head means and patch vectors, scaled and resized.

A tile's tensors are flat arrays, and matrices are made in Arrow batches, a block of tiles and query tokens at a time; no row stands for a pair of tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.dice import min_max


def token_layout(n: Column) -> tuple[Column, Column]:
    """(side, special) of n tokens: a square grid without special tokens, else the largest square below n and what is left before it."""
    root = lambda x: F.floor(F.sqrt(x.cast("double")) + 1e-9).cast("int")
    square = root(n) * root(n) == n
    side = F.when(square, root(n)).otherwise(root(n - 1))
    return side, (n - side * side).cast("int")


#: Scores of a block.
BLOCK_SCORES = 2_000_000


def layout(n: int) -> tuple[int, int]:
    """``token_layout`` of a number."""
    root = int(n**0.5 + 1e-9)
    side = root if root * root == n else int((n - 1) ** 0.5 + 1e-9)
    return side, n - side * side


def softmax_blocks(q: np.ndarray, k: np.ndarray, scale: float, first: int | None = None) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """The head mean of the softmax of scale q k^T, a block of tiles and query tokens at a time: (tiles, tokens, values), of the first query tokens alone if asked."""
    tiles, heads, tokens, _ = q.shape
    queries = tokens if first is None else first
    rows = max(1, min(queries, BLOCK_SCORES // (heads * tokens)))
    step = max(1, BLOCK_SCORES // (heads * tokens * rows))
    for at in range(0, tiles, step):
        turned = k[at : at + step].transpose(0, 1, 3, 2)
        for row in range(0, queries, rows):
            a = np.matmul(q[at : at + step, :, row : min(row + rows, queries)], turned) * scale
            a -= a.max(axis=-1, keepdims=True)
            np.exp(a, out=a)
            a /= a.sum(axis=-1, keepdims=True)
            yield slice(at, at + step), slice(row, min(row + rows, queries)), a.mean(axis=1)


def _in_batches(rows: DataFrame, columns: list[str], sizes: Column, make: Callable[[dict[str, list[np.ndarray]]], np.ndarray]) -> DataFrame:
    """tile_id and ``v``, the array that ``make`` gives for each row of flat arrays; rows whose arrays aren't of the size asked (or are null) are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            given = {c: np.split(batch.column(c).flatten().to_numpy(zero_copy_only=False), batch.column(c).value_lengths().to_numpy().cumsum()[:-1]) for c in columns}
            made = np.ascontiguousarray(make(given), dtype=np.float64).reshape(n, -1)
            values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * made.shape[1]), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("tile_id"), values], names=["tile_id", "v"])

    given = rows.where(F.coalesce(sizes, F.lit(False))).select("tile_id", *[F.col(c).cast("array<double>").alias(c) for c in columns])
    return given.mapInArrow(run, f"tile_id {given.schema['tile_id'].dataType.simpleString()}, v array<double>")


def _dimensions(rows: DataFrame, heads: int, tokens: int, dim: int) -> tuple[list[str], Column, Callable]:
    shape = lambda x: np.stack(x).reshape(-1, heads, tokens, dim)
    return ["q", "k"], (F.size("q") == heads * tokens * dim) & (F.size("k") == heads * tokens * dim), shape


def head_means(rows: DataFrame, heads: int, tokens: int, dim: int, scale: float | None = None) -> DataFrame:
    """(tile_id, v): the mean over heads of each tile's attention, tokens by tokens, from q and k (heads by tokens by dim). ``scale`` is 1 / sqrt(dim) unless given."""
    columns, sizes, shape = _dimensions(rows, heads, tokens, dim)

    def make(given: dict[str, list[np.ndarray]]) -> np.ndarray:
        q, k = shape(given["q"]), shape(given["k"])
        out = np.empty((len(q), tokens, tokens))
        for tiles, queries, values in softmax_blocks(q, k, dim**-0.5 if scale is None else scale):
            out[tiles, queries] = values
        return out

    return _in_batches(rows, columns, sizes, make)


def patch_vectors(rows: DataFrame, heads: int, tokens: int, dim: int, scale: float | None = None) -> DataFrame:
    """(tile_id, v): the attention of each patch of a tile, from q and k as above: with special tokens the first token's, which alone is worked out; else each column's mean."""
    columns, sizes, shape = _dimensions(rows, heads, tokens, dim)
    special = layout(tokens)[1]

    def make(given: dict[str, list[np.ndarray]]) -> np.ndarray:
        q, k = shape(given["q"]), shape(given["k"])
        out = np.zeros((len(q), tokens))
        for tiles, _, values in softmax_blocks(q, k, dim**-0.5 if scale is None else scale, 1 if special else None):
            out[tiles] += values.sum(axis=1)
        return out[:, special:] / (1 if special else tokens)

    return _in_batches(rows, columns, sizes, make)


def patch_vectors_of_maps(rows: DataFrame, tokens: int, attention: str = "a") -> DataFrame:
    """(tile_id, v) from attention that is there already: a matrix, a matrix for each head, or a batch of one of these; each array's length tells which."""
    special, pairs = layout(tokens)[1], tokens * tokens

    def make(given: dict[str, list[np.ndarray]]) -> np.ndarray:
        maps = (a.reshape(-1, tokens, tokens) for a in given["a"])
        return np.stack([a[:, 0, special:].mean(axis=0) if special else a.mean(axis=(0, 1)) for a in maps])

    size = F.size("a")
    return _in_batches(rows.select("tile_id", F.col(attention).alias("a")), ["a"], (size >= pairs) & (size % pairs == 0), make)


def as_pixels(vectors: DataFrame) -> DataFrame:
    """The long form (tile_id, pix, v) of vectors."""
    return vectors.select("tile_id", F.posexplode("v").alias("pix", "v"))


def as_pairs(means: DataFrame, tokens: int) -> DataFrame:
    """The long form (tile_id, i, j, a) of head means."""
    return means.select("tile_id", F.posexplode("v").alias("p", "a")).select("tile_id", F.floor(F.col("p") / tokens).cast("int").alias("i"), (F.col("p") % tokens).alias("j"), "a")


def softmax_rows(scores: DataFrame, keys: tuple[str, ...] = ("tile_id", "head", "i")) -> DataFrame:
    """``scores`` (keys, j, s) with ``a``, the softmax of s over j; the greatest score is taken off first."""
    row = Window.partitionBy(*keys)  # as many scores as a tile has tokens
    rows = scores.withColumn("__e", F.exp(F.col("s") - F.max("s").over(row)))
    return rows.select(*keys, "j", (F.col("__e") / F.sum("__e").over(row)).alias("a"))


def first_tiles(rows: DataFrame, most: int = 100) -> DataFrame:
    """The rows of the first tiles by id, at most ``most`` of them."""
    tiles = rows.select("tile_id").distinct().orderBy("tile_id").limit(most)
    return rows.join(F.broadcast(tiles), "tile_id", "left_semi")


def as_heads(attention: DataFrame) -> DataFrame:
    """(tile_id, head, i, j, a) from a table that may lack the head: a single matrix is that of head 0."""
    return attention if "head" in attention.columns else attention.withColumn("head", F.lit(0)).select("tile_id", "head", *[c for c in attention.columns if c != "tile_id"])


def head_mean(attention: DataFrame) -> DataFrame:
    """The mean over heads of (tile_id, head, i, j, a)."""
    return attention.groupBy("tile_id", "i", "j").agg(F.avg("a").alias("a"))


def patch_vector(mean: DataFrame, n_tokens: int) -> DataFrame:
    """(tile_id, pix, v) from (tile_id, i, j, a): with special tokens the first token's attention to the patches, else each column's mean."""
    root = int(n_tokens**0.5 + 1e-9)
    special = 0 if root * root == n_tokens else n_tokens - int((n_tokens - 1) ** 0.5 + 1e-9) ** 2
    if special:
        return mean.where((F.col("i") == 0) & (F.col("j") >= special)).select("tile_id", (F.col("j") - special).cast("int").alias("pix"), F.col("a").alias("v"))
    return mean.groupBy("tile_id", F.col("j").cast("int").alias("pix")).agg(F.avg("a").alias("v"))


def normalise(patches: DataFrame) -> DataFrame:
    return patches.withColumn("v", min_max(F.col("v"), ["tile_id"]))


def bilinear(maps: DataFrame, side: int, target: int) -> DataFrame:
    """Square maps (tile_id, pix, v) of ``side`` resized to ``target``, with half-pixel centres and clamped borders.

    Each pixel is sent to the target pixels that it weighs on, by a table of at most 4 * target ** 2 rows that depends on the sizes alone.
    """
    def ends(k: int) -> list[tuple[int, float]]:
        at = min(max((k + 0.5) * side / target - 0.5, 0.0), side - 1.0)
        low = min(int(at), side - 1)
        high, part = min(low + 1, side - 1), at - low
        return [(low, 1 - part), (high, part)]

    weights = [(r * target + c, i * side + j, wr * wc) for r in range(target) for c in range(target) for i, wr in ends(r) for j, wc in ends(c)]
    table = maps.sparkSession.createDataFrame(weights, "to int, pix int, w double")
    spread = maps.join(F.broadcast(table), "pix")
    return spread.groupBy("tile_id", F.col("to").alias("pix")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def map_name(tile: Column, layer: int, head: Column) -> Column:
    """File name of a tile's map: its number, layer, and head or 'avg'."""
    return F.concat(F.lit("tile"), tile.cast("string"), F.lit(f"_L{layer}_H"), F.coalesce(head.cast("string"), F.lit("avg")), F.lit(".png"))
