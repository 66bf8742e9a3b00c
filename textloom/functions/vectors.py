"""Vector expressions on ``array<float>`` / ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import let


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """Unit vector; the zero vector stays as it is."""

    def scaled(norm: Column) -> Column:
        unit = F.transform(v, lambda x: x.cast("double") / norm)
        return F.when(norm == 0, v.cast("array<double>")).otherwise(unit).cast("array<float>")

    return let(l2_norm(v), scaled)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either side is the zero vector."""
    return let(
        l2_norm(a) * l2_norm(b), lambda scale: F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)
    )
