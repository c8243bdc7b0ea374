"""Patches on a grid: where coordinates point, cells, confusion classes and the rectangles that draw them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Colour of each confusion class (red, green, blue, alpha 0 to 1).
COLOURS = {"TP": (0, 255, 0, 0.4), "FN": (255, 0, 0, 0.4), "FP": (0, 0, 255, 0.4), "TN": (0, 0, 0, 0.0)}


def _with_extent(patches: DataFrame) -> DataFrame:
    """``patches`` with the least and greatest coordinates of their slide, which come from partial aggregates as one row a slide."""
    of = [f(c).alias(f"__{name}_{c}") for c in ("x", "y") for name, f in (("min", F.min), ("max", F.max))]
    extents = patches.groupBy(F.col("slide_id").alias("__slide")).agg(*of)
    return patches.join(extents, F.col("slide_id").eqNullSafe(F.col("__slide"))).drop("__slide")


def coordinate_mode(patches: DataFrame, tile: float) -> DataFrame:
    """mode of each slide: 'center' if offsets from the slide's least coordinates, modulo the tile, lie nearer to half a tile than to 0."""
    t = F.lit(float(tile))
    off = lambda c: F.pmod(F.col(c) - F.col(f"__min_{c}"), t)
    rows = _with_extent(patches).select("slide_id", off("x").alias("ox"), off("y").alias("oy"))
    near = lambda o, to: F.avg(F.abs(F.col(o) - to))
    sums = rows.groupBy("slide_id").agg((near("ox", F.lit(0.0)) + near("oy", F.lit(0.0))).alias("to_corner"), (near("ox", t / 2) + near("oy", t / 2)).alias("to_centre"))
    return sums.select("slide_id", "to_corner", "to_centre", F.when(F.col("to_centre") + 1e-6 < F.col("to_corner"), "center").otherwise("topleft").alias("mode"))


def to_corner(c: Column, mode: Column, tile: float) -> Column:
    """A coordinate as that of the patch's upper left corner."""
    return F.when(mode == "center", c - float(tile) / 2).otherwise(c)


def grid_snap(patches: DataFrame, tile: float) -> DataFrame:
    """``patches`` with col and row, half-even rounded steps from the slide's least coordinates, and the grid's n_cols and n_rows."""
    step = lambda v, c: F.rint((F.col(v) - F.col(f"__min_{c}")) / float(tile)).cast("int")
    rows = _with_extent(patches).withColumns({"col": step("x", "x"), "row": step("y", "y")})
    rows = rows.withColumns({"n_cols": step("__max_x", "x") + 1, "n_rows": step("__max_y", "y") + 1})
    return rows.drop(*[f"__{name}_{c}" for name in ("min", "max") for c in ("x", "y")])


def confusion_class(pred: Column, truth: Column) -> Column:
    return F.when((pred == 1) & (truth == 1), "TP").when((pred == 0) & (truth == 1), "FN").when((pred == 1) & (truth == 0), "FP").otherwise("TN")


def draw_rectangles(cells: DataFrame, width: int, height: int, pad: int = 1) -> DataFrame:
    """x0, y0, x1, y1 of each cell that is drawn, in an image of the given size: floored and ceiled, padded, clamped; empty ones go.

    ``cells`` has col, row, n_cols, n_rows and ``cls``; true negatives are transparent and aren't drawn. Rows keep their row_idx, the order of drawing.
    """
    w, h = F.lit(float(width)) / F.col("n_cols"), F.lit(float(height)) / F.col("n_rows")
    low = lambda c, s: F.greatest(F.floor(F.col(c) * s).cast("int") - pad, F.lit(0))
    high = lambda c, s, most: F.least(F.ceil((F.col(c) + 1) * s).cast("int") + pad, F.lit(most))
    rows = cells.where("cls <> 'TN'").withColumns({"x0": low("col", w), "y0": low("row", h), "x1": high("col", w, width), "y1": high("row", h, height)})
    return rows.where("x1 > x0 AND y1 > y0")


def colour(cls: Column) -> Column:
    """The colour of a confusion class as a struct r, g, b, alpha."""
    one = lambda c: F.struct(*[F.lit(v).alias(n) for n, v in zip(("r", "g", "b", "alpha"), c, strict=True)])
    out = F.when(cls == "TP", one(COLOURS["TP"]))
    for name in ("FN", "FP", "TN"):
        out = out.when(cls == name, one(COLOURS[name]))
    return out


def rotate_clockwise(cells: DataFrame) -> DataFrame:
    """``cells`` turned by 90 degrees clockwise: (row, col) goes to (col, n_rows - 1 - row) and the extents change places."""
    return cells.withColumns({"row": F.col("col"), "col": F.col("n_rows") - 1 - F.col("row"), "n_rows": F.col("n_cols"), "n_cols": F.col("n_rows")})
