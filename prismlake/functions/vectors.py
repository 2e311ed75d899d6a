"""Vector arithmetic as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def normalise(v: Column) -> Column:
    """Unit length; a norm up to 1e-12 leaves the vector as it is."""
    return F.when(norm(v) > 1e-12, F.transform(v, lambda x: x.cast("double") / norm(v))).otherwise(v.cast("array<double>"))


def softmax(v: Column) -> Column:
    e = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def share_of(logits: Column, positive: list[int]) -> Column:
    """The share of some positions in the softmax of logits."""
    p = softmax(logits)
    total = F.lit(0.0)
    for i in positive:
        total = total + p[i]
    return total


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
