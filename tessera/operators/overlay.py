"""Confusion overlays: rectangles blended over slide pictures, turned by 90 degrees and written as PNG.

Pictures are cut into bands of rows and rectangles dealt to the bands that they reach; a band's rows and its rectangles stream through a task in drawing
order, so a task holds one band, however many rectangles reach it. Bands are deflated where they are blended; an image's stream is their pieces one behind another, with
the checksum worked out from theirs, so that joining an image handles compressed bytes alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.grid import colour

#: Rows of a band.
BAND_ROWS = 256
BAND = "slide_id string, band int, top int, width int, height int, pixels binary"
#: A PNG file's signature, the colour type of red, green and blue, the first bytes of a zlib stream, its empty last block, and what checksums count modulo.
SIGNATURE, RGB, ZLIB_HEADER, LAST_BLOCK, ADLER = b"\x89PNG\r\n\x1a\n", 2, b"\x78\x01", b"\x03\x00", 65521
PLACE = ("row_idx", "x0", "y0", "x1", "y1", "r", "g", "b", "alpha")


def coloured(rects: DataFrame, cls: str = "cls") -> DataFrame:
    """The rectangles with r, g, b and alpha of their confusion class; other columns go."""
    return rects.select("slide_id", *PLACE[:5], colour(F.col(cls)).alias("c")).select("slide_id", *PLACE[:5], "c.*")


def turned(rects: DataFrame, height: int | str) -> DataFrame:
    """Rectangles of pictures of a height (a number, or a column's name) turned by 90 degrees clockwise with them."""
    h = F.col(height) if isinstance(height, str) else F.lit(height)
    return rects.withColumns({"x0": h - F.col("y1"), "x1": h - F.col("y0"), "y0": F.col("x0"), "y1": F.col("x1")})


def bands(pictures: DataFrame, rows: int = BAND_ROWS, turn: bool = False) -> DataFrame:
    """The bands of pictures (slide_id, width, height, pixels: red, green and blue, row by row), turned clockwise first if ``turn``."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for slide, width, height, pixels in zip(batch["slide_id"], batch["width"], batch["height"], batch["pixels"], strict=True):
                picture = np.frombuffer(pixels, dtype=np.uint8).reshape(height, width, 3)
                picture = np.rot90(picture, k=-1) if turn else picture
                for top in range(0, len(picture), rows):
                    yield pd.DataFrame({"slide_id": [slide], "band": top // rows, "top": top, "width": picture.shape[1], "height": len(picture), "pixels": [picture[top : top + rows].tobytes()]})

    return pictures.select("slide_id", "width", "height", "pixels").mapInPandas(cut, BAND)


def composite(pieces: DataFrame, rects: DataFrame, rows: int = BAND_ROWS) -> DataFrame:
    """The bands with their rectangles (slide_id, PLACE) blended in order of row_idx, then of place as drawn and colour: round(below (1 - alpha) + colour alpha), half to even.

    Rectangles are clamped to the picture; those of slides without a picture, or with a null in their place, aren't drawn. A slide has one picture.
    """
    last = F.floor((F.col("y1") - 1) / rows).cast("int")
    drawn = rects.select("slide_id", *PLACE).na.drop(subset=["slide_id", *PLACE]).where("x0 < x1 AND y0 < y1 AND y1 > 0")
    drawn = drawn.withColumn("band", F.explode(F.sequence(F.floor(F.greatest(F.col("y0"), F.lit(0)) / rows).cast("int"), last)))
    both = pieces.withColumn("drawn", F.lit(0)).unionByName(drawn.withColumn("drawn", F.lit(1)), allowMissingColumns=True)
    both = both.repartition("slide_id", "band").sortWithinPartitions("slide_id", "band", "drawn", *PLACE)

    def blend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, canvas, head = None, None, None
        done = lambda: pd.DataFrame([(*head, canvas.tobytes())], columns=["slide_id", "band", "top", "width", "height", "pixels"])
        for batch in batches:
            for r in batch.itertuples(index=False):
                if not r.drawn:
                    if key == (r.slide_id, r.band):
                        raise ValueError(f"two pictures of {r.slide_id}")
                    if canvas is not None:
                        yield done()
                    key, head = (r.slide_id, r.band), (r.slide_id, r.band, int(r.top), int(r.width), int(r.height))
                    canvas = np.frombuffer(r.pixels, dtype=np.uint8).reshape(-1, head[3], 3).copy()
                elif key == (r.slide_id, r.band):
                    top = head[2]
                    area = canvas[max(int(r.y0) - top, 0) : max(int(r.y1) - top, 0), max(int(r.x0), 0) : max(int(r.x1), 0)]
                    area[...] = np.rint(area * (1 - r.alpha) + np.array((r.r, r.g, r.b)) * r.alpha).astype(np.uint8)
        if canvas is not None:
            yield done()

    return both.mapInPandas(blend, BAND)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def joined_adler(first: int, second: int, length: int) -> int:
    """The Adler checksum of two pieces one behind another, the second of ``length`` bytes: its low half is one more than the bytes' sum, the high half sums the low ones."""
    low, high = first & 0xFFFF, first >> 16
    low_2, high_2 = second & 0xFFFF, second >> 16
    return (low + low_2 - 1) % ADLER | (high + high_2 + length * (low - 1)) % ADLER << 16


def as_png(pieces: DataFrame) -> DataFrame:
    """slide_id, width, height and png of each picture whose bands these are."""

    def deflate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for width, pixels in zip(batch["width"], batch["pixels"], strict=True):
                lines = np.frombuffer(pixels, dtype=np.uint8).reshape(-1, 3 * width)
                raw = np.concatenate([np.zeros((len(lines), 1), np.uint8), lines], axis=1).tobytes()  # each line's filter: none
                squeeze = zlib.compressobj(wbits=-zlib.MAX_WBITS)
                out.append((chunk(b"IDAT", squeeze.compress(raw) + squeeze.flush(zlib.Z_FULL_FLUSH)), zlib.adler32(raw), len(raw)))
            batch = batch.drop(columns=["top", "pixels"])
            batch["data"], batch["adler"], batch["length"] = [x[0] for x in out], [x[1] for x in out], [x[2] for x in out]
            yield batch

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("band")
        adler = 1
        for one, length in zip(rows["adler"].tolist(), rows["length"].tolist(), strict=True):
            adler = joined_adler(adler, one, length)
        slide, width, height = rows["slide_id"].iloc[0], int(rows["width"].iloc[0]), int(rows["height"].iloc[0])
        head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, RGB, 0, 0, 0)) + chunk(b"IDAT", ZLIB_HEADER)
        tail = chunk(b"IDAT", LAST_BLOCK + struct.pack(">I", adler)) + chunk(b"IEND", b"")
        return pd.DataFrame({"slide_id": [slide], "width": width, "height": height, "png": [b"".join([SIGNATURE, head, *rows["data"], tail])]})

    parts = pieces.mapInPandas(deflate, "slide_id string, band int, width int, height int, data binary, adler long, length long")
    return parts.groupBy("slide_id").applyInPandas(join, "slide_id string, width int, height int, png binary")


def overlay(pictures: DataFrame, rects: DataFrame, rows: int = BAND_ROWS, turn: bool = True) -> DataFrame:
    """The bands of ``pictures`` with rectangles (slide_id, row_idx, cls, x0, y0, x1, y1, in the picture as it is) blended over them, turned clockwise if ``turn``."""
    drawn = coloured(rects)
    if turn:
        drawn = turned(drawn.join(pictures.select("slide_id", F.col("height").alias("__h")), "slide_id"), "__h")
    return composite(bands(pictures, rows, turn), drawn, rows)


def sums(pieces: DataFrame) -> DataFrame:
    """width, height, the sum of each channel, and one in which each pixel weighs by its place, of each picture whose bands these are."""

    @F.pandas_udf("red long, green long, blue long, placed long")
    def one(top: pd.Series, width: pd.Series, pixels: pd.Series) -> pd.DataFrame:
        out = []
        for t, w, raw in zip(top, width, pixels, strict=True):
            band = np.frombuffer(raw, dtype=np.uint8).reshape(-1, w, 3).astype(np.int64)
            weight = 1 + (31 * np.arange(w) + 17 * (t + np.arange(len(band)))[:, None]) % 97
            out.append((*band.sum(axis=(0, 1)).tolist(), int(((band * (1, 2, 3)).sum(axis=2) * weight).sum())))
        return pd.DataFrame(out, columns=["red", "green", "blue", "placed"])

    found = pieces.select("slide_id", "width", "height", one("top", "width", "pixels").alias("s"))
    return found.groupBy("slide_id", "width", "height").agg(*[F.sum(f"s.{c}").alias(c) for c in ("red", "green", "blue", "placed")])
