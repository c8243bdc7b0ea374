"""Overlap of two maps of each tile: thresholds, masks, soft and hard Dice.

Maps are long tables (tile_id, pix, v) or one array a tile; statistics are grouped by tile, so a tile's pixels never leave their group.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BINS, SMALL = 256, 1e-8
#: Maps whose bins a worker holds densely at a time.
ROWS = 256


@dataclass(frozen=True)
class Threshold:
    """How a threshold is found: 'otsu', 'percentile' (value: 0 to 100) or 'number'."""

    kind: str
    value: float = 0.0


def parse_threshold(spec: str) -> Threshold:
    """'otsu', 'pNN' (a whole percentile, clamped to 0 to 100) or a number; case and outer blanks don't matter."""
    s = spec.strip().lower()
    if s == "otsu":
        return Threshold("otsu")
    if m := re.fullmatch(r"p(-?\d+)", s):
        return Threshold("percentile", float(min(100, max(0, int(m[1])))))
    return Threshold("number", float(s))


def histogram(value: Column, bins: int = BINS) -> Column:
    """The bin of [0, 1] that a value falls in; what is outside counts for the outermost."""
    return F.least(F.floor(F.greatest(value, F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")


def best_bin(counts: np.ndarray) -> np.ndarray:
    """Of each row of bins, the first whose upper edge parts it with the greatest variance between the sides.

    Variances are rounded before they are ranked: empty bins make ties that the last digits would break at random.
    """
    bins = counts.shape[1]
    w = np.cumsum(counts, axis=1)
    s = np.cumsum(counts * ((np.arange(bins) + 0.5) / bins), axis=1)
    w1 = w[:, -1:] - w  # the split lies behind a bin, so the last bin has no upper side
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.nan_to_num(w * w1 * (s / w - (s[:, -1:] - s) / w1) ** 2, nan=0.0, posinf=0.0)
    return np.argmax(np.round(between, 6), axis=1)


def bin_centres(found: pd.Series, numbers: pd.Series, bins: int) -> np.ndarray:
    """The centre of each row's best bin, from the bins that it has and their counts. ROWS rows are dense at a time, however many a batch has."""
    out = np.zeros(len(found))
    for at in range(0, len(found), ROWS):
        some, counted = found.iloc[at : at + ROWS].to_list(), numbers.iloc[at : at + ROWS].to_list()
        dense = np.zeros((len(some), bins))
        dense[np.repeat(np.arange(len(some)), [len(x) for x in some]), np.concatenate(some).astype(np.int64)] = np.concatenate(counted)
        out[at : at + ROWS] = (best_bin(dense) + 0.5) / bins
    return out


def otsu_of(counts: Column, bins: int = BINS) -> Column:
    """The centre of the bin that maximises the variance between the two sides, the first of equal ones, from a map of bins to counts; maps come in Arrow batches."""

    @F.pandas_udf("double")
    def centres(found: pd.Series, numbers: pd.Series) -> pd.Series:
        return pd.Series(bin_centres(found, numbers, bins))

    return centres(F.map_keys(counts), F.map_values(counts))


def _counted(values: DataFrame, by: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """A map of bins to counts for each named column, one row a group: counts by bin first, so a group is at most BINS rows a column when it meets."""
    sides = F.explode(F.array(*[F.struct(F.lit(name).alias("side"), histogram(F.col(c)).alias("bin")) for name, c in columns.items()])).alias("x")
    counts = values.select(*by, sides).groupBy(*by, "x.side", "x.bin").agg(F.count("*").cast("double").alias("n"))
    of = lambda name: F.map_from_entries(F.collect_list(F.when(F.col("side") == name, F.struct("bin", "n")))).alias(name)
    return counts.groupBy(*by).agg(*map(of, columns))


def otsu(values: DataFrame, by: Sequence[str] = ("tile_id",), value: str = "v") -> DataFrame:
    """threshold of each group: the centre of the bin of [0, 1] that maximises the variance between the two sides, the first of equal ones."""
    return _counted(values, by, {"__bins": value}).select(*by, otsu_of(F.col("__bins")).alias("threshold"))


def thresholds(values: DataFrame, wanted: dict[str, tuple[Threshold, str]], by: Sequence[str] = ("tile_id",)) -> DataFrame:
    """The named thresholds of each group, each of a column: all percentiles (exact, by linear interpolation) in one aggregation, all histograms in another."""
    percentile = {n: F.percentile(c, F.lit(t.value / 100)).alias(n) for n, (t, c) in wanted.items() if t.kind == "percentile"}
    number = {n: F.lit(t.value).alias(n) for n, (t, _) in wanted.items() if t.kind == "number"}
    found = values.groupBy(*by).agg(*percentile.values(), F.count("*").alias("__n")).select(*by, *percentile, *number.values())
    if binned := {n: c for n, (t, c) in wanted.items() if t.kind == "otsu"}:
        found = found.join(_counted(values, by, binned).select(*by, *[otsu_of(F.col(n)).alias(n) for n in binned]), list(by))
    return found


def soft_dice(a: Column, b: Column, mask: Column) -> Column:
    """2 sum(ab) / (sum(aa) + sum(bb)) over the mask, as an aggregate."""
    inside = lambda x: F.coalesce(F.sum(F.when(mask, x)), F.lit(0.0))
    return 2 * inside(a * b) / (inside(a * a) + inside(b * b) + SMALL)


def hard_dice(a: Column, b: Column, mask: Column) -> Column:
    """2 |A and B| / (|A| + |B|) of two boolean maps over the mask, as an aggregate."""
    n = lambda x: F.count_if(mask & x).cast("double")
    return 2 * n(a & b) / (n(a) + n(b) + SMALL)


def first_common(a: DataFrame, b: DataFrame, limit: int) -> DataFrame:
    """tile_id of the first ``limit`` tiles, by id, that both tables have."""
    return a.select("tile_id").distinct().join(b.select("tile_id").distinct(), "tile_id").orderBy("tile_id").limit(limit)


def compare(a: DataFrame, b: DataFrame, foreground: Threshold, hard: Threshold | None = None, soft: bool = True, limit: int = 0) -> DataFrame:
    """Of each tile in both tables (the first ``limit`` of them if that is above 0): foreground thresholds and share, soft_dice and, with ``hard``, its thresholds and hard_dice.

    The foreground is where either map reaches its own threshold; hard thresholds are taken over whole maps.
    """
    if not soft and hard is None:
        raise ValueError("soft or hard, at least")
    if limit > 0:
        tiles = first_common(a, b, limit)
        a, b = a.join(tiles, "tile_id", "left_semi"), b.join(tiles, "tile_id", "left_semi")
    pair = a.select("tile_id", "pix", F.col("v").alias("a")).join(b.select("tile_id", "pix", F.col("v").alias("b")), ["tile_id", "pix"])
    found = thresholds(pair, {f"{name}_thr_{side}": (spec, side) for name, spec in (("fg", foreground), ("hard", hard)) if spec is not None for side in ("a", "b")})
    rows = pair.join(found, "tile_id")
    x, y = F.col("a"), F.col("b")
    mask = (x >= F.col("fg_thr_a")) | (y >= F.col("fg_thr_b"))
    aggs = [F.first("fg_thr_a").alias("fg_thr_a"), F.first("fg_thr_b").alias("fg_thr_b"), F.avg(mask.cast("double")).alias("fg_fraction")]
    if soft:
        aggs.append(soft_dice(x, y, mask).alias("soft_dice"))
    if hard is not None:
        aggs += [F.first("hard_thr_a").alias("hard_thr_a"), F.first("hard_thr_b").alias("hard_thr_b"), hard_dice(x >= F.col("hard_thr_a"), y >= F.col("hard_thr_b"), mask).alias("hard_dice")]
    return rows.groupBy("tile_id").agg(*aggs)


def min_max(v: Column, by: Sequence[str]) -> Column:
    """Values scaled to [0, 1] inside each group."""
    w = Window.partitionBy(*by)
    return (v - F.min(v).over(w)) / (F.max(v).over(w) - F.min(v).over(w) + SMALL)


def report_name(a: str, b: str, foreground: str, hard: str = "otsu") -> str:
    """A report's file name from its folders' names, as they are, and its thresholds, whose points become p and whose blanks go."""
    clean = lambda s: s.replace(".", "p").replace(" ", "")
    return f"dice_{a}_vs_{b}_fg{clean(foreground)}_hard{clean(hard)}.csv"


def write_report(df: DataFrame, path: str) -> None:
    """One CSV file with a header. A report has a row a tile, which one task writes."""
    df.orderBy("tile_id").coalesce(1).write.mode("overwrite").option("header", True).csv(path)

