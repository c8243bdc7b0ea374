"""Matching files to slides by their names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUFFIX = "(_patches|_coords|_features|_images)$"
#: Fixed value: formats of slide images, in the order in which exact names are looked for.
EXTENSIONS = (".svs", ".tif", ".tiff", ".ndpi", ".mrxs")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The base name without its last extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def strip_suffix(name: Column) -> Column:
    """A slide's name without one trailing role suffix."""
    return F.regexp_replace(name, SUFFIX, "")


def tile_id(name: Column) -> Column:
    """The number behind the first 'tile' that has one, else NULL."""
    return F.regexp_extract(name, r"tile(\d+)", 1).try_cast("int")


def first_file_per_tile(files: DataFrame, name: str = "name") -> DataFrame:
    """The first file by name of each tile id."""
    return files.select(tile_id(F.col(name)).alias("tile_id"), name).where("tile_id IS NOT NULL").groupBy("tile_id").agg(F.min(name).alias(name))


def containing(ids: DataFrame, id_col: str, texts: DataFrame, text_col: str) -> DataFrame:
    """Pairs of a row of ``ids`` and one of ``texts`` whose text contains the id.

    A containment join has no equality, so texts are spread over their parts: a text contains an id if one of its parts of the id's length equals it.
    What comes to the driver are the distinct lengths of ids.
    """
    lengths = [r["n"] for r in ids.select(F.length(id_col).alias("n")).distinct().collect() if r["n"]]
    parts = texts.withColumn("__len", F.explode(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")))
    parts = parts.where(F.length(text_col) >= F.col("__len")).withColumn("__at", F.explode(F.sequence(F.lit(1), F.length(text_col) - F.col("__len") + 1)))
    parts = parts.select(*texts.columns, F.substring(text_col, F.col("__at"), F.col("__len")).alias(id_col)).distinct()
    return ids.join(parts, id_col)


def match_annotations(slides: DataFrame, paths: DataFrame) -> DataFrame:
    """The first annotation path, by path, that contains the slide's id, in its folders or its name."""
    return containing(slides.select("slide_id"), "slide_id", paths.select("path"), "path").groupBy("slide_id").agg(F.min("path").alias("path"))


def match_images(slides: DataFrame, images: DataFrame, extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """Each slide's image file name or NULL: its exact name by the extensions' order, else the shortest name of these formats that contains it, then by name.

    An exact name's extension is in lower case; other names' may be in either.
    """
    ids = slides.select("slide_id", strip_suffix(F.col("slide_id")).alias("__id"))
    suffix = F.regexp_extract("name", r"(\.[^.]*)$", 1)
    pairs = containing(ids, "__id", images.select("name").where(F.lower(suffix).isin(*extensions)), "name")
    exact = (stem(F.col("name")) == F.col("__id")) & suffix.isin(*extensions)
    order = F.array_position(F.array(*map(F.lit, extensions)), suffix)
    # the least of (not exact, the extension's place, length, name)
    best = pairs.groupBy("slide_id").agg(F.min(F.struct(~exact, F.when(exact, order).otherwise(0), F.length("name"), "name")).alias("__best"))
    return slides.select("slide_id").join(best.select("slide_id", F.col("__best.name").alias("name")), "slide_id", "left")
