"""Vector and score arithmetic as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; norms of under 1e-10 count as 1e-10."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-10)) * F.greatest(norm(b), F.lit(1e-10)))


def hoyer(a: Column, b: Column) -> Column:
    """Hoyer sparsity of the difference; its length counts as 1e-9 at least."""
    gap = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    root = F.sqrt(F.size(a).cast("double"))
    return (root - _sum(F.transform(gap, F.abs)) / F.greatest(norm(gap), F.lit(1e-9))) / (root - 1)


def contradiction_score(a: Column, b: Column, alpha: float = 1.5) -> Column:
    """Cosine and ``alpha`` times the sparsity of what differs."""
    return cosine(a, b) + alpha * hoyer(a, b)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(powers, lambda p: p / _sum(powers))


def warmup_linear(step: Column, warmup: int, total: int, least: float = 0.0) -> Column:
    """Learning-rate factor: up to 1 over ``warmup`` steps, then down."""
    down = F.greatest(F.lit(least), (F.lit(total) - step) / max(1, total - warmup))
    return F.when(step < warmup, step / max(1, warmup)).otherwise(down)
