"""Polygons against square patches. A polygon is an array of points (x, y); squares are closed, so touching counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double>>"


def edges(vertices: Column) -> Column:
    """The ring's edges as an array of x1, y1, x2, y2, the last back to the first vertex. A repeated closing vertex is dropped."""
    closed = (F.size(vertices) > 1) & (F.element_at(vertices, 1) == F.element_at(vertices, -1))
    ring = F.when(closed, F.slice(vertices, F.lit(1), F.greatest(F.size(vertices) - 1, F.lit(0)))).otherwise(vertices)
    rest = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, rest, lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))


def _side(e: Column, x: Column, y: Column) -> Column:
    return (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])


def edge_meets_square(e: Column, x: Column, y: Column, size: Column) -> Column:
    """Whether a segment meets the closed square: boxes overlap and the corners aren't all on one side of its line."""
    boxes = (F.least(e["x1"], e["x2"]) <= x + size) & (F.greatest(e["x1"], e["x2"]) >= x) & (F.least(e["y1"], e["y2"]) <= y + size) & (F.greatest(e["y1"], e["y2"]) >= y)
    sides = [_side(e, x, y), _side(e, x + size, y), _side(e, x, y + size), _side(e, x + size, y + size)]
    return boxes & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


def inside(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside, by the parity of the edges that a ray from it crosses."""
    crosses = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"])
    return F.size(F.filter(ring, crosses)) % 2 == 1


def _meet(p: Column, q: Column, n: Column) -> Column:
    """Whether two numbered edges of a ring of n cross or touch that don't follow each other."""
    a, b = p["e"], q["e"]
    boxes = (F.least(a["x1"], a["x2"]) <= F.greatest(b["x1"], b["x2"])) & (F.greatest(a["x1"], a["x2"]) >= F.least(b["x1"], b["x2"]))
    boxes = boxes & (F.least(a["y1"], a["y2"]) <= F.greatest(b["y1"], b["y2"])) & (F.greatest(a["y1"], a["y2"]) >= F.least(b["y1"], b["y2"]))
    across = (_side(a, b["x1"], b["y1"]) * _side(a, b["x2"], b["y2"]) <= 0) & (_side(b, a["x1"], a["y1"]) * _side(b, a["x2"], a["y2"]) <= 0)
    apart = (q["i"] > p["i"] + 1) & ~((p["i"] == 0) & (q["i"] == n - 1))
    return apart & boxes & across


def _has_area(ring: Column) -> Column:
    area = F.aggregate(ring, F.lit(0.0), lambda a, e: a + e["x1"] * e["y2"] - e["x2"] * e["y1"])
    return F.coalesce((F.size(ring) >= 3) & (F.abs(area) > 0), F.lit(False))


def valid(vertices: Column) -> Column:
    """At least three vertices, an area, and no two edges that cross or touch unless they follow each other. For rings of few edges: it compares all."""
    ring = edges(vertices)
    numbered = F.transform(ring, lambda e, i: F.struct(i.alias("i"), e.alias("e")))
    return _has_area(ring) & ~F.exists(numbered, lambda p: F.exists(numbered, lambda q: _meet(p, q, F.size(ring))))


def _in_bands(edge: Column, height: Column) -> Column:
    """The horizontal bands of a height that an edge reaches."""
    return F.sequence(F.floor(F.least(edge["y1"], edge["y2"]) / height), F.floor(F.greatest(edge["y1"], edge["y2"]) / height))


def with_validity(polygons: DataFrame, vertices: str = "vertices") -> DataFrame:
    """``polygons`` with ``valid``, as ``valid`` tells it, for rings of any size.

    Edges that meet share a horizontal band of their polygon. Each ring is cut into about as many bands as the root of its edges, and edges are compared inside a band.
    """
    rows = polygons.withColumn("__ring", edges(F.col(vertices))).withColumn("__id", F.xxhash64(F.col(vertices)))
    shapes = rows.where(F.size("__ring") > 3).dropDuplicates(["__id"])
    ys = F.transform("__ring", lambda e: e["y1"])
    height = F.greatest((F.array_max(ys) - F.array_min(ys)) / F.ceil(F.sqrt(F.size("__ring"))), F.lit(1e-9), F.abs(F.array_max(ys)) * 1e-9)
    # sizes first, in a step of their own: beside the edges they would be worked out for each edge again
    each = shapes.select("__id", "__ring", F.size("__ring").alias("n"), height.alias("h")).select("__id", "n", "h", F.posexplode("__ring").alias("i", "e"))
    bands = each.withColumn("band", F.explode(_in_bands(F.col("e"), F.col("h")))).groupBy("__id", "band", "n").agg(F.collect_list(F.struct("i", "e")).alias("es"))
    crossing = bands.where(F.exists("es", lambda p: F.exists("es", lambda q: _meet(p, q, F.col("n"))))).select("__id", F.lit(True).alias("__crosses")).distinct()
    rows = rows.join(crossing, "__id", "left")
    return rows.withColumn("valid", _has_area(F.col("__ring")) & F.col("__crosses").isNull()).drop("__ring", "__id", "__crosses")


def label_patches(patches: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """``patches`` (slide_id, row_idx, x, y) with label 1 where any valid polygon of the slide meets the patch's square, else 0.

    Both sides are dealt into horizontal bands of the patch size and joined by band; nothing is broadcast and no slide is compared whole. A band of a polygon carries
    the edges that reach it alone: those that can meet a square there, or that a ray from the square's corner crosses. A square reaches two bands at most.
    """
    s = F.lit(float(size))
    shapes = with_validity(polygons).where("valid").select("slide_id", edges(F.col("vertices")).alias("ring"), F.xxhash64(F.col("vertices")).alias("pid"))
    shapes = shapes.dropDuplicates(["slide_id", "pid"]).withColumns({"left": F.array_min(F.transform("ring", lambda e: e["x1"])), "right": F.array_max(F.transform("ring", lambda e: e["x1"]))})
    bands = shapes.select("slide_id", "pid", "left", "right", F.explode("ring").alias("e")).withColumn("band", F.explode(_in_bands(F.col("e"), s)))
    bands = bands.groupBy("slide_id", "pid", "left", "right", "band").agg(F.collect_list("e").alias("near"))
    spread = patches.select("slide_id", "row_idx", "x", "y", F.posexplode(F.sequence(F.floor(F.col("y") / s), F.floor((F.col("y") + s) / s))).alias("nth", "band"))
    beside = (F.col("left") <= F.col("x") + s) & (F.col("right") >= F.col("x"))
    within = (F.col("nth") == 0) & inside(F.col("near"), F.col("x"), F.col("y"))
    meets = F.exists("near", lambda e: edge_meets_square(e, F.col("x"), F.col("y"), s)) | within
    hits = spread.join(bands, ["slide_id", "band"]).where(beside & meets).select("slide_id", "row_idx").distinct()
    return patches.join(hits.withColumn("__hit", F.lit(1)), ["slide_id", "row_idx"], "left").withColumn("label", F.coalesce("__hit", F.lit(0))).drop("__hit")
