"""Reproducible splits with exact counts, from ranks of hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DIGITS = 3


def shuffled_rank(df: DataFrame, key: Column, strata: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """``df`` with ``rank`` (from 1) in the order of md5(seed|key), then key, and ``n``, the size of the row's stratum.

    Rows fall into 16 ** DIGITS buckets by their hash's first digits. Counts of buckets are summed along the order, and ranks are taken inside
    buckets, so no task sorts a whole stratum.
    """
    rows = df.withColumn("__key", key).withColumn("__md5", F.md5(F.concat(F.lit(f"{seed}|"), F.col("__key").cast("string"))))
    rows = rows.withColumn("__bucket", F.substring("__md5", 1, DIGITS))
    by = list(strata)
    counts = rows.groupBy(*by, "__bucket").agg(F.count("*").alias("__c"))
    whole = Window.partitionBy(*(by or [F.lit(0)]))
    before = whole.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*by, "__bucket", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__base"), F.sum("__c").over(whole).alias("n"))
    inside = F.row_number().over(Window.partitionBy(*by, "__bucket").orderBy("__md5", "__key"))
    rows = rows.withColumn("__inside", inside).join(counts, [*by, "__bucket"])
    return rows.withColumn("rank", F.col("__base") + F.col("__inside")).drop("__key", "__md5", "__bucket", "__base", "__inside", "__c")


def three_way(df: DataFrame, key: Column, strata: Sequence[str] = (), train: float = 0.8, validation: float = 0.1, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: floor(train * n) rows, floor(validation * n) rows and the rest as test, in each stratum."""
    ranked = shuffled_rank(df, key, strata, seed)
    a, b = F.floor(F.lit(train) * F.col("n")), F.floor(F.lit(validation) * F.col("n"))
    split = F.when(F.col("rank") <= a, "train").when(F.col("rank") <= a + b, "validation").otherwise("test")
    return ranked.withColumn("split", split).drop("rank", "n")


def two_way(df: DataFrame, key: Column, validation: float = 0.2, up: bool = False, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: floor(validation * n) rows (or, ``up``, its ceiling; all rows train if that takes them all) and the rest as train."""
    ranked = shuffled_rank(df, key, (), seed)
    v = (F.ceil if up else F.floor)(F.lit(validation) * F.col("n"))
    v = F.when(v >= F.col("n"), 0).otherwise(v) if up else v
    return ranked.withColumn("split", F.when(F.col("rank") <= v, "validation").otherwise("train")).drop("rank", "n")


def _number(text: Column) -> Column:
    """A whole number below 16^14 from a text's md5."""
    return F.conv(F.substring(F.md5(text), 1, 14), 16, 10).cast("long")


def weighted_resample(df: DataFrame, key: Column, truth: str = "label", seed: int = 42) -> DataFrame:
    """As many rows, drawn with replacement, each class with the same chance: ``df`` with ``draw``, the number of the draw.

    A draw's hash gives its class, and another a rank inside it in the order of hashed keys, so a rerun draws the same rows however they are partitioned.
    Labels that are null have a class of their own. Counts of classes come to the driver.
    """
    counts = df.groupBy(truth).count().orderBy(F.col(truth).asc_nulls_first()).collect()
    ranked = shuffled_rank(df.withColumn("__class", F.coalesce(F.col(truth).cast("string"), F.lit("\0"))), key, ["__class"], seed).drop("n")
    n, k = sum(r["count"] for r in counts), len(counts)
    names = F.array(*[F.lit("\0" if r[truth] is None else str(r[truth])) for r in counts]) if k else F.array().cast("array<string>")
    sizes = F.array(*[F.lit(r["count"]) for r in counts]) if k else F.array().cast("array<bigint>")
    text = lambda what: F.concat(F.lit(f"{seed}|{what}|"), F.col("draw").cast("string"))
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw").withColumn("__at", (_number(text("class")) % max(1, k)).cast("int"))
    draws = draws.select("draw", F.get(names, F.col("__at")).alias("__class"), (_number(text("rank")) % F.get(sizes, F.col("__at")) + 1).alias("rank"))
    return ranked.join(draws, ["__class", "rank"]).drop("__class", "rank")
