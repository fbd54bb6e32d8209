"""Array math on logits (M9): softmax, argmax (lowest index on ties), top prob."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(logits: Column) -> Column:
    x = F.transform(logits, lambda e: e.cast("double"))
    m = F.array_max(x)
    ex = F.transform(x, lambda e: F.exp(e - m))
    tot = F.aggregate(ex, F.lit(0.0), lambda a, e: a + e)
    return F.transform(ex, lambda e: e / tot)


def argmax(values: Column) -> Column:
    """0-based index of the first maximum (numpy argmax tie rule)."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def top_prob(probs: Column) -> Column:
    return F.array_max(probs)
