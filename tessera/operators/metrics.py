"""Classification metrics as conditional aggregates, for any grouping. What a single class leaves undefined is NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges of a group's scores that are summed before levels inside them are.
RANGES = 256


def ratio(a: Column, b: Column) -> Column:
    """a / b in doubles; NULL where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def confusion(df: DataFrame, by: Sequence[str] = (), pred: str = "pred", truth: str = "label") -> DataFrame:
    """tn, fp, fn, tp of each group."""
    p, y = F.col(pred), F.col(truth)
    return df.groupBy(*by).agg(
        F.count_if((p == 0) & (y == 0)).alias("tn"), F.count_if((p == 1) & (y == 0)).alias("fp"), F.count_if((p == 0) & (y == 1)).alias("fn"), F.count_if((p == 1) & (y == 1)).alias("tp")
    )


def metrics(df: DataFrame, by: Sequence[str] = (), pred: str = "pred", truth: str = "label") -> DataFrame:
    """The confusion counts of each group, accuracy, sensitivity (0 without positives), specificity (NULL without negatives) and F1."""
    c = confusion(df, by, pred, truth)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    return c.select(
        *by, "tn", "fp", "fn", "tp",
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        F.coalesce(ratio(tp, tp + fn), F.lit(0.0)).alias("sensitivity"),
        ratio(tn, tn + fp).alias("specificity"),
        F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
    )


def valid_labels(df: DataFrame, truth: str = "label", classes: Sequence[int] = (0, 1)) -> DataFrame:
    """The rows whose label is one of the classes; null, NaN and other values go."""
    return df.where(F.col(truth).isin(*classes))


def roc_auc(df: DataFrame, by: Sequence[str], score: str = "score", truth: str = "label") -> DataFrame:
    """The area under the ROC curve of each group: the share of (positive, negative) pairs in order, ties counting half.

    Equal scores are grouped first. Levels fall into RANGES ranges of a group's scores, bounded by approximate quantiles; negatives below a level are those of the
    ranges before its own, of which a group has RANGES, and those before it in its range, so no task sorts a whole group.
    """
    y, by = F.col(truth), list(by)
    levels = valid_labels(df, truth).groupBy(*by, F.col(score).alias("__score")).agg(F.sum(y).cast("double").alias("pos"), F.sum(1 - y).cast("double").alias("neg"))
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by]
    bounds = levels.groupBy(*by).agg(F.percentile_approx("__score", [k / RANGES for k in range(1, RANGES)], RANGES * 10).alias("__bounds"))
    here = F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(RANGES.bit_length()))]), F.lit(0), lambda low, n: F.when(F.get("__bounds", low + n - 1) < F.col("__score"), low + n).otherwise(low))
    levels = levels.alias("l").join(bounds.alias("b"), same("l", "b") or F.lit(True)).select("l.*", here.alias("__range"))
    ranges = levels.groupBy(*by, "__range").agg(F.sum("neg").alias("__neg"))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*by, "__range", F.coalesce(F.sum("__neg").over(earlier), F.lit(0.0)).alias("__base"))
    inside = Window.partitionBy(*by, "__range").orderBy("__score").rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.withColumn("__inside", F.coalesce(F.sum("neg").over(inside), F.lit(0.0)))
    levels = levels.alias("l").join(ranges.alias("r"), [*same("l", "r"), F.col("l.__range") == F.col("r.__range")]).select("l.*", "r.__base")
    won = F.col("pos") * (F.col("__base") + F.col("__inside") + F.col("neg") / 2)
    sums = levels.groupBy(*by).agg(F.sum(won).alias("won"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return sums.select(*by, (F.col("won") / F.nullif(F.col("p") * F.col("n"), F.lit(0.0))).alias("auc"))


def class_report(df: DataFrame, by: Sequence[str] = (), pred: str = "pred", truth: str = "label") -> DataFrame:
    """precision, recall, f1 and support of each class that a group's predictions or labels have, and the macro and weighted averages, as rows named by ``entry``."""
    p, y, n = F.col(pred), F.col(truth), F.col("n")
    pairs = df.where(p.isNotNull() & y.isNotNull()).groupBy(*by, p.alias("p"), y.alias("y")).agg(F.count("*").alias("n"))
    none, right = F.lit(0).cast("long"), F.col("p") == F.col("y")
    one = lambda c, hit, over, missed: F.struct(F.col(c).cast("string").alias("entry"), hit.alias("hit"), over.alias("over"), missed.alias("missed"))
    each = F.array(one("p", F.when(right, n).otherwise(none), F.when(~right, n).otherwise(none), none), one("y", none, none, F.when(~right, n).otherwise(none)))
    rows = pairs.select(*by, F.explode(each).alias("c")).groupBy(*by, "c.entry").agg(*[F.sum(f"c.{x}").alias(x) for x in ("hit", "over", "missed")])
    hit, over, missed = F.col("hit"), F.col("over"), F.col("missed")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    per = rows.select(
        *by, "entry", zero(ratio(hit, hit + over)).alias("precision"), zero(ratio(hit, hit + missed)).alias("recall"), zero(ratio(2 * hit, 2 * hit + over + missed)).alias("f1"), (hit + missed).alias("support")
    )
    n = F.sum("support")
    average = lambda name, f: per.groupBy(*by).agg(F.lit(name).alias("entry"), *[f(x).alias(x) for x in ("precision", "recall", "f1")], n.alias("support"))
    return per.unionByName(average("macro", F.avg)).unionByName(average("weighted", lambda x: ratio(F.sum(F.col(x) * F.col("support")), n)))


def true_positive_rates(df: DataFrame, by: Sequence[str], preds: Sequence[str], truth: str = "label") -> DataFrame:
    """pos, and tp_<name> and tpr_<name> of each prediction column, for each group; a rate is NULL without positives."""
    y = F.col(truth)
    sums = df.groupBy(*by).agg(F.sum(y).alias("pos"), *[F.sum(F.col(p) * y).alias(f"tp_{p}") for p in preds])
    return sums.select(*by, "pos", *[f"tp_{p}" for p in preds], *[ratio(F.col(f"tp_{p}"), F.col("pos")).alias(f"tpr_{p}") for p in preds])


def class_counts(df: DataFrame, by: Sequence[str] = (), truth: str = "label") -> DataFrame:
    return df.groupBy(*by, truth).agg(F.count("*").alias("n"))


def inverse_weights(df: DataFrame, truth: str = "label") -> DataFrame:
    """weight = 1 / count of each class; counts are joined to rows by the caller, as a table of a row a class."""
    return class_counts(df, (), truth).withColumn("weight", 1 / F.col("n").cast("double"))


def balanced_weights(df: DataFrame, truth: str = "label") -> DataFrame:
    """weight = rows / (classes * count) of each class."""
    counts = class_counts(df, (), truth)
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return counts.crossJoin(F.broadcast(total)).select(truth, "n", (F.col("total") / (F.col("k") * F.col("n")).cast("double")).alias("weight"))


def best_epoch(log: DataFrame, metric: str = "acc", by: Sequence[str] = ()) -> DataFrame:
    """The row of the highest metric of each group's epoch log, the earliest of equal ones."""
    best = F.max_by(F.struct(*log.columns), F.struct(F.col(metric), -F.col("epoch"))).alias("__best")
    return log.groupBy(*by).agg(best).where("__best IS NOT NULL").select("__best.*")


def mean_loss(batches: DataFrame, by: Sequence[str] = ("epoch",)) -> DataFrame:
    """The mean over batches and the mean over samples of the loss in each epoch."""
    return batches.groupBy(*by).agg(F.avg("loss").alias("loss_by_batch"), ratio(F.sum(F.col("loss") * F.col("n")), F.sum("n")).alias("loss_by_sample"))


def score_summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """mean, median, sample standard deviation (0 for a single value) and n of each group."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.avg(v).alias("mean"), F.median(v).alias("median"), F.when(F.count(v) > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0))).alias("std"), F.count(v).alias("n"))
