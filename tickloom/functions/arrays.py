"""Expressions on array columns: logits and step blocks. String arguments are SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions import text


def argmax_class(logits: str) -> Column:
    """0-based position of the first largest entry."""
    return F.expr(text.argmax_class(logits))


def softmax(logits: str) -> Column:
    shifted = f"transform({logits}, x -> exp(x - array_max({logits})))"
    return F.expr(f"transform({shifted}, x -> x / {text.array_sum(shifted)})")


def cross_entropy_parts(logits: str, klass: str) -> tuple[Column, Column]:
    num, den = text.cross_entropy_parts(logits, klass)
    return F.expr(num), F.expr(den)


def array_mean(steps: str) -> Column:
    return F.expr(text.array_mean(steps))


def step(steps: str, index: int) -> Column:
    """0-based entry, null past the end."""
    return F.expr(text.item(steps, index))
