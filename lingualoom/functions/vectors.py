"""Scores of logit vectors as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_sum_exp(logits: Column) -> Column:
    """Shifted by the largest element, so that nothing overflows."""
    top = F.array_max(logits).cast("double")
    return top + F.ln(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top)))


def surprisal(logits: Column, target: Column) -> Column:
    """Bits of the target (index from 0); null if it is out of range."""
    return (log_sum_exp(logits) - F.get(logits, target).cast("double")) / F.ln(F.lit(2.0))


def log_share(logits: Column, indices: Column) -> Column:
    """Log probability of a set of vocabulary indices."""
    chosen = F.transform(indices, lambda i: F.get(logits, i))
    return log_sum_exp(chosen) - log_sum_exp(logits)
