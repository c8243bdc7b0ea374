"""Classes from scores, and votes of several models on a row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax_positive(logit0: Column, logit1: Column) -> Column:
    """The probability of class 1 of two logits."""
    return 1 / (1 + F.exp(logit0 - logit1))


def argmax_class(logit0: Column, logit1: Column) -> Column:
    """The class of the larger logit; equal logits are class 0."""
    return (logit1 > logit0).cast("int")


def threshold_class(p: Column, threshold: float = 0.5) -> Column:
    """Class 1 from the threshold on; a probability equal to it is class 1."""
    return (p >= F.lit(float(threshold))).cast("int")


def soft_vote(probabilities: Sequence[Column], threshold: float = 0.5) -> Column:
    """The class of the mean probability."""
    return threshold_class(reduce(add, probabilities) / len(probabilities), threshold)


def hard_vote(classes: Sequence[Column]) -> Column:
    """The class that more than half of the models give."""
    return (reduce(add, classes) >= len(classes) // 2 + 1).cast("int")


def majority_label(total: Column, sources: int) -> Column:
    """Class 1 where more than half of the sources' labels sum to it."""
    return (total >= sources // 2 + 1).cast("int")
