"""Reading and writing tables of patches, labels, tiles, maps and weights as Parquet."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATCHES = "slide_id string, row_idx bigint, x double, y double, features array<float>, label int"
TILES = "slide_id string, row_idx bigint, image binary, height int, width int, channels int, x double, y double"
RECORDS = "key string, image binary, shape array<int>, dtype string, label int, slide_id string"


def read_patches(spark: SparkSession, path: str, columns: Sequence[str] = ("slide_id", "row_idx", "x", "y", "features", "label")) -> DataFrame:
    """The named columns of a table of patches; a missing label column reads as NULL. Unreadable files are skipped if the session says so."""
    return spark.read.schema(PATCHES).parquet(path).select(*columns)


def list_files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """path, length and modificationTime of the files below ``path`` whose names end in ``suffix``; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "modificationTime")


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Tiles whose images are in a column ``images`` or else ``imgs`` or ``image``, as ``image``."""
    rows = spark.read.parquet(path)
    for name in ("images", "imgs", "image"):
        if name in rows.columns:
            return rows.withColumnRenamed(name, "image")
    raise ValueError("no column images, imgs or image")


def read_records(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """Key-value tile records, the first ``limit`` by their 8-digit keys if it is above 0; the bound on the key reaches the scan."""
    rows = spark.read.schema(RECORDS).parquet(path)
    return rows.where(F.col("key") < F.lit(f"{limit:08d}")) if limit > 0 else rows


def three_channels(raw: bytes, dims: Sequence[int]) -> np.ndarray:
    """An 8-bit image as height by width by 3: gray counts as three equal channels, alpha goes, and channels may come first."""
    a = np.frombuffer(raw, dtype=np.uint8).reshape([int(d) for d in dims])
    if a.ndim == 3 and a.shape[2] not in (1, 3, 4) and a.shape[0] in (1, 3, 4):
        a = a.transpose(1, 2, 0)
    if a.ndim == 2:
        a = a[..., None]
    if a.ndim != 3 or a.shape[2] not in (1, 3, 4):
        raise ValueError(f"an image of shape {tuple(dims)}")
    return np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a[..., :3]


def decode_records(rows: DataFrame, mean: Sequence[float] = (0.0, 0.0, 0.0), std: Sequence[float] = (1.0, 1.0, 1.0), scale: float = 1.0) -> DataFrame:
    """key, label, slide_id and the mean of each of the first three channels of raw 8-bit images, divided by ``scale`` and normalised by the channels' ``mean`` and ``std``."""
    @F.pandas_udf("array<double>")
    def means(image: pd.Series, shape: pd.Series) -> pd.Series:
        one = lambda raw, dims: ((three_channels(raw, dims).astype(np.float64).mean(axis=(0, 1)) / scale - mean) / std).tolist()
        return pd.Series([one(i, s) for i, s in zip(image, shape, strict=True)])

    return rows.select("key", "label", "slide_id", means("image", "shape").alias("channel_means"))


def first_rows(df: DataFrame, most: int) -> DataFrame:
    """The first rows of each slide by row_idx; 0 is all. A filter that reaches the scan, not a sort."""
    return df.where(F.col("row_idx") < most) if most > 0 else df


def write_labels(df: DataFrame, path: str) -> None:
    """A new version of a label table; it is never written over what is being read."""
    df.select("slide_id", "row_idx", "label").write.mode("overwrite").partitionBy("slide_id").parquet(path)


def replace_labels(df: DataFrame, path: str) -> None:
    """Replaces the labels of the slides that ``df`` has; those of other slides stay as they are."""
    df.select("slide_id", "row_idx", "label").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slide_id").parquet(path)


def write_tiles(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "gzip").parquet(path)


def read_gray(spark: SparkSession, path: str) -> DataFrame:
    """name and pixels (0 to 1, row by row) of binary PGM files, read with ``binaryFile``."""
    @F.pandas_udf("array<double>")
    def pixels(content: pd.Series) -> pd.Series:
        import re

        def one(raw: bytes) -> list[float]:
            m = re.match(rb"P5\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", raw)
            if not m:
                return []
            n = int(m[1]) * int(m[2])
            return (np.frombuffer(raw, dtype=np.uint8, count=n, offset=m.end()) / float(m[3])).tolist()

        return pd.Series([one(c) for c in content])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pgm").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), pixels("content").alias("pixels"))


def profile(df: DataFrame) -> DataFrame:
    """n_rows, n_labels and the least and greatest coordinates of each slide."""
    return df.groupBy("slide_id").agg(F.count("*").alias("n_rows"), F.count("label").alias("n_labels"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))
