"""Numeric expressions over arrays: argmax, log-sum-exp, cross-entropy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, by passing it through a one-entry array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, v: s + v)


def argmax(items: Column) -> Column:
    """Zero-based index of the first maximum."""
    return F.array_position(items, F.array_max(items)) - 1


def log_sum_exp(items: Column) -> Column:
    """Stable ``ln(sum(exp(x)))``."""
    return bind(items, lambda x: bind(
        F.array_max(x), lambda m: m + F.ln(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - m)))))


def softmax(items: Column) -> Column:
    return bind(items, lambda x: bind(log_sum_exp(x), lambda z: F.transform(x, lambda v: F.exp(v - z))))


def cross_entropy(logits: Column, label: Column, ignored: int = -100) -> Column:
    """Negative log-probability of the label; NULL where the label is ignored."""
    return F.when(label != ignored, log_sum_exp(logits) - F.element_at(logits, label.cast("int") + 1))
