"""Ranking slides by what ensembles gain or by how far models disagree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.metrics import true_positive_rates

CRITERIA = ("ensemble_tpr", "tp_delta", "tp_count", "max_disagreement")


def max_disagreement(models: Sequence[str], ensembles: Sequence[str]) -> Column:
    """The largest absolute difference between a model's rate and an ensemble's."""
    return F.array_max(F.array(*[F.abs(F.col(f"tpr_{m}") - F.col(f"tpr_{e}")) for m in models for e in ensembles]))


def slide_table(scored: DataFrame, models: Sequence[str], ensembles: Sequence[str], hard: str | None = None, slide: str = "slide_id") -> DataFrame:
    """The rates of each slide with positives, and max_delta over models and ensembles (the hard vote aside)."""
    names = [*models, *ensembles, *([hard] if hard else [])]
    rates = true_positive_rates(scored.where("label IS NOT NULL"), [slide], names).where("pos > 0")
    return rates.withColumn("max_delta", max_disagreement(models, ensembles))


def rank_slides(table: DataFrame, criterion: str = "max_disagreement", top: int = 3, baseline: str = "c", ensemble: str = "deep", slide: str = "slide_id") -> DataFrame:
    """The first ``top`` slides by the criterion, descending; equal ones by name. Planned as a top-k, not as a sort of all slides."""
    if criterion not in CRITERIA:
        raise ValueError(f"criterion must be one of {CRITERIA}")
    metric = {
        "ensemble_tpr": F.col(f"tpr_{ensemble}"),
        "tp_delta": F.col(f"tpr_{ensemble}") - F.col(f"tpr_{baseline}"),
        "tp_count": F.col(f"tp_{ensemble}").cast("double"),
        "max_disagreement": F.col("max_delta"),
    }[criterion]
    return table.withColumn("metric", metric).orderBy(F.col("metric").desc(), slide).limit(top)


def first_slides(df: DataFrame, most: int, slide: str = "slide_id") -> DataFrame:
    """The rows of the first ``most`` slides by name: a limit that comes before any metric."""
    names = df.select(slide).distinct().orderBy(slide).limit(most)
    return df.join(names, slide, "left_semi")
