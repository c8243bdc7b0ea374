"""Bringing rows of several sources together by position or by key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.votes import majority_label

POSITION = ("slide_id", "row_idx")


def strict_scan(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the slides that have as many labels as features; a slide with other counts is left out whole."""
    n = lambda df, name: df.groupBy("slide_id").agg(F.count("*").alias(name))
    good = n(features, "n_features").join(n(labels, "n_labels"), "slide_id").where("n_features = n_labels").select("slide_id")
    return features.join(labels, list(POSITION)).join(good, "slide_id", "left_semi")


def truncating_scan(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows that have both features and a label: each slide up to the shorter of the two."""
    return features.join(labels, list(POSITION))


def count_mismatch(features: DataFrame, labels: DataFrame) -> DataFrame:
    """n_features and n_labels of the slides where they differ, absent ones as 0."""
    a = features.groupBy("slide_id").agg(F.count("*").alias("a"))
    b = labels.groupBy("slide_id").agg(F.count("*").alias("b"))
    both = a.join(b, "slide_id", "full_outer").select("slide_id", F.coalesce("a", F.lit(0)).alias("n_features"), F.coalesce("b", F.lit(0)).alias("n_labels"))
    return both.where("n_features <> n_labels")


def positional(sources: Sequence[DataFrame]) -> DataFrame:
    """Row i of a slide with row i in every source: features_<k> and label_<k>, and whether all labels agree."""
    parts = [s.select(*POSITION, F.col("features").alias(f"features_{k}"), F.col("label").alias(f"label_{k}")) for k, s in enumerate(sources)]
    joined = reduce(lambda a, b: a.join(b, list(POSITION)), parts)
    same = reduce(lambda a, b: a & b, [F.col("label_0") == F.col(f"label_{k}") for k in range(1, len(parts))], F.lit(True))
    return joined.withColumn("consistent", same)


def fuse(sources: Sequence[DataFrame], order: Sequence[int]) -> DataFrame:
    """Rows with the same label in every source, their features concatenated in ``order``, which the caller must state."""
    rows = positional(sources).where("consistent")
    return rows.select(*POSITION, F.concat(*[F.col(f"features_{k}") for k in order]).alias("features"), F.col("label_0").alias("label"))


def fuse_report(sources: Sequence[DataFrame]) -> DataFrame:
    """n_common, n_kept and n_dropped rows of each slide that all sources have."""
    return positional(sources).groupBy("slide_id").agg(F.count("*").alias("n_common"), F.count_if("consistent").alias("n_kept"), F.count_if(~F.col("consistent")).alias("n_dropped"))


def fuse_strict_slides(sources: Sequence[DataFrame], order: Sequence[int]) -> DataFrame:
    """As ``fuse``, but without every slide in which any label differs."""
    whole = positional(sources).groupBy("slide_id").agg(F.bool_and("consistent").alias("ok")).where("ok").select("slide_id")
    return fuse(sources, order).join(whole, "slide_id", "left_semi")


def patch_key(slide: Column, x: Column, y: Column, row_idx: Column) -> Column:
    """'slide|x,y' with coordinates rounded half to even, or 'slide|idx:i' where there are none."""
    whole = lambda c: F.rint(c).cast("bigint").cast("string")
    return F.concat(slide, F.lit("|"), F.coalesce(F.concat(whole(x), F.lit(","), whole(y)), F.concat(F.lit("idx:"), row_idx.cast("string"))))


def last_per_key(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row of each (source_id, slide_id, key): the one with the largest row_idx."""
    kept = F.max_by(F.struct(*keep), "row_idx").alias("kept")
    return rows.groupBy("source_id", "slide_id", "key").agg(kept).select("source_id", "slide_id", "key", "kept.*")


def align_keys(rows: DataFrame, sources: int, keep: Sequence[str] = ("label",)) -> DataFrame:
    """Keys that every source has, in one grouping: n_positive, the majority label and ``parts``, the kept columns by source.

    ``rows`` is the union of the sources, with source_id, slide_id, key and row_idx.
    """
    one = last_per_key(rows, keep)
    found = one.groupBy("slide_id", "key").agg(F.count("*").alias("n"), F.sum("label").alias("n_positive"), F.sort_array(F.collect_list(F.struct("source_id", *keep))).alias("parts"))
    return found.where(F.col("n") == sources).select("slide_id", "key", "n_positive", majority_label(F.col("n_positive"), sources).alias("label"), "parts")


def align_report(rows: DataFrame, sources: int) -> DataFrame:
    """Of each slide in all sources: n_aligned, the fewest keys of a source, and n_dropped = the difference."""
    keys = rows.select("source_id", "slide_id", "key").distinct()
    fewest = keys.groupBy("slide_id", "source_id").agg(F.count("*").alias("n")).groupBy("slide_id").agg(F.min("n").alias("n_fewest"), F.count("*").alias("k")).where(F.col("k") == sources)
    full = keys.groupBy("slide_id", "key").agg(F.count("*").alias("k")).where(F.col("k") == sources).groupBy("slide_id").agg(F.count("*").alias("n_aligned"))
    both = fewest.join(full, "slide_id", "left").withColumn("n_aligned", F.coalesce("n_aligned", F.lit(0)))
    return both.select("slide_id", "n_aligned", "n_fewest", F.greatest(F.col("n_fewest") - F.col("n_aligned"), F.lit(0)).alias("n_dropped"))


def common_slides(sources: Sequence[DataFrame]) -> DataFrame:
    """Names of slides that every source has."""
    return reduce(lambda a, b: a.intersect(b), [s.select("slide_id") for s in sources])


def only_in_all(base: DataFrame, others: Sequence[DataFrame]) -> DataFrame:
    """Rows of ``base`` whose slide no other source lacks."""
    return reduce(lambda a, b: a.join(b.select("slide_id"), "slide_id", "left_semi"), others, base)


def same_coordinates(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether two sources have the same coordinates in the same rows, for each slide of either."""
    pair = a.select(*POSITION, F.struct("x", "y").alias("pa")).join(b.select(*POSITION, F.struct("x", "y").alias("pb")), list(POSITION), "full_outer")
    return pair.groupBy("slide_id").agg(F.bool_and(F.coalesce(F.col("pa") == F.col("pb"), F.lit(False))).alias("same"))


def row_counts(sources: Sequence[DataFrame]) -> DataFrame:
    """slide_id, counts (rows in each source, 0 where it has none) and whether all are equal."""
    each = [d.groupBy("slide_id").agg(F.count("*").alias("n")).select("slide_id", F.lit(k).alias("k"), "n") for k, d in enumerate(sources)]
    by_source = reduce(DataFrame.unionByName, each).groupBy("slide_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(len(sources) - 1)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0).cast("long")))
    return by_source.select("slide_id", counts.alias("counts"), (F.size(F.array_distinct(counts)) == 1).alias("equal"))


def require_equal_counts(sources: Sequence[DataFrame]) -> None:
    """Raises an error that names slides whose numbers of rows differ between the sources."""
    wrong = row_counts(sources).where("NOT equal").orderBy("slide_id").limit(5).collect()
    if wrong:
        raise ValueError("numbers of rows differ: " + ", ".join(f"{r['slide_id']} {r['counts']}" for r in wrong))
