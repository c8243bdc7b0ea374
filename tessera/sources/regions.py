"""Annotated regions from XML files: every Region element, however deep, with all vertices below it."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.geometry import POINTS, with_validity


def regions_of(content: bytes) -> Iterator[list[tuple[float, float]]]:
    """The vertices of each region in document order; an outer region has those of the regions in it too. A vertex without both coordinates is left out."""
    for region in ET.fromstring(content).iter("Region"):
        places = ((v.get("X"), v.get("Y")) for v in region.iter("Vertex"))
        yield [(float(x), float(y)) for x, y in places if x is not None and y is not None]


def read_regions(spark: SparkSession, path: str, glob: str = "*.xml") -> DataFrame:
    """path, and vertices of each region that has at least three and is a simple ring with an area; others are dropped.

    A file is parsed whole by one task, as it must be to find regions in regions; rings of any size are held against themselves by bands.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                found = [[{"x": x, "y": y} for x, y in ring] for ring in regions_of(content) if len(ring) >= 3]
                yield pd.DataFrame({"path": [name] * len(found), "vertices": found})

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")
    return with_validity(files.mapInPandas(parse, f"path string, vertices {POINTS}")).where(F.col("valid")).select("path", "vertices")
