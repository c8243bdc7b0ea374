"""Bilinear resizing of tiles and maps by two small matrices, one for rows and one for columns.

Where a picture shrinks, the triangle of weights widens with it, so that every pixel counts. The 8-bit path holds weights as whole parts of 2^22 and rounds to bytes after
each of its passes, columns first; products and sums stay below 2^53, so matrix products of doubles give them exactly.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.patches import three_channels

#: Fixed value: the bits of a weight in the 8-bit path.
WEIGHT_BITS = 22


@lru_cache(maxsize=64)
def weights(size: int, target: int) -> np.ndarray:
    """The share of each of ``size`` pixels in each of ``target``, with half-pixel centres."""
    step = size / target
    wide = max(step, 1.0)
    w = np.maximum(0.0, 1 - np.abs((np.arange(size) + 0.5) - (np.arange(target)[:, None] + 0.5) * step) / wide)
    return w / w.sum(axis=1, keepdims=True)


@lru_cache(maxsize=64)
def whole_weights(size: int, target: int) -> np.ndarray:
    return np.floor(weights(size, target) * (1 << WEIGHT_BITS) + 0.5)


def resize_bytes(pictures: np.ndarray, height: int, width: int) -> np.ndarray:
    """8-bit pictures (count, height, width, channels) in another size; a side that fits already isn't touched."""

    def one_pass(a: np.ndarray, matrix: np.ndarray) -> np.ndarray:
        """Along the second axis."""
        n, rows, *rest = a.shape
        out = np.matmul(matrix, a.reshape(n, rows, -1).astype(np.float64)).reshape(n, len(matrix), *rest)
        return np.clip(np.floor((out + (1 << (WEIGHT_BITS - 1))) / (1 << WEIGHT_BITS)), 0, 255).astype(np.uint8)

    if pictures.shape[2] != width:
        pictures = one_pass(pictures.swapaxes(1, 2), whole_weights(pictures.shape[2], width)).swapaxes(1, 2)
    if pictures.shape[1] != height:
        pictures = one_pass(pictures, whole_weights(pictures.shape[1], height))
    return pictures


def resize_tiles(tiles: DataFrame, size: int) -> DataFrame:
    """``tiles`` (image, height, width, channels and other columns) as squares of ``size`` with three channels; those of that size keep their pixels.

    Tiles are resized one by one, so a task holds one Arrow batch of them, which ``spark.sql.execution.arrow.maxBytesPerBatch`` bounds.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            shapes = zip(batch["image"], batch["height"], batch["width"], batch["channels"], strict=True)
            pictures = (three_channels(raw, (h, w, c) if c > 1 else (h, w)) for raw, h, w, c in shapes)
            batch["image"] = [resize_bytes(p[None], size, size)[0].tobytes() for p in pictures]
            batch["height"], batch["width"], batch["channels"] = size, size, 3
            yield batch

    return tiles.mapInPandas(run, tiles.schema)


def resized(values: Column, height: Column, width: Column, to_height: Column, to_width: Column) -> Column:
    """A map of values from 0 to 1, row by row, in another size by way of bytes: cut to whole steps of 255, resized, divided by 255. One of that size is cut to bytes too; one whose length isn't its size gives null."""

    @F.pandas_udf("array<double>")
    def run(v: pd.Series, h: pd.Series, w: pd.Series, th: pd.Series, tw: pd.Series) -> pd.Series:
        out, alike = [None] * len(v), defaultdict(list)
        for k, (x, *sizes) in enumerate(zip(v, h, w, th, tw, strict=True)):
            if x is not None and len(x) == sizes[0] * sizes[1]:
                alike[tuple(map(int, sizes))].append(k)
        for (rows, columns, to_rows, to_columns), places in alike.items():
            steps = np.clip(np.stack([v.iloc[k] for k in places]) * 255.0, 0, 255).astype(np.uint8).reshape(-1, rows, columns, 1)
            for k, made in zip(places, resize_bytes(steps, to_rows, to_columns), strict=True):
                out[k] = made.ravel() / 255.0
        return pd.Series(out, dtype=object)

    return run(values, height, width, to_height, to_width)


def resized_to(maps: DataFrame, like: DataFrame) -> DataFrame:
    """(tile_id, height, width, pixels) of ``maps`` in the sizes that ``like`` has for the same tiles."""
    sizes = like.select("tile_id", F.col("height").alias("th"), F.col("width").alias("tw"))
    rows = maps.join(sizes, "tile_id")
    return rows.select("tile_id", F.col("th").alias("height"), F.col("tw").alias("width"), resized(F.col("pixels"), F.col("height"), F.col("width"), F.col("th"), F.col("tw")).alias("pixels"))
