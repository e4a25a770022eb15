"""Helpers shared by the column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else (x if isinstance(x, Column) else F.lit(x))


def rounded(x, digits: int = 6) -> Column:
    """Round and turn -0.0 into 0.0."""
    return F.round(col(x), digits) + F.lit(0.0)


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(x, F.lit(float(hi))), F.lit(float(lo)))


def ratio(a, b, default: float = 0.0) -> Column:
    """a / b, or ``default`` where b is zero."""
    b = col(b)
    return F.when(b == 0, F.lit(default)).otherwise(col(a) / F.nullif(b.cast("double"), F.lit(0.0)))


def dist(a: str, b: str) -> Column:
    """Euclidean distance of two x,y,z column groups named by prefix."""
    return F.sqrt(sum((F.pow(F.col(f"{a}{k}") - F.col(f"{b}{k}"), 2) for k in "xyz"), F.lit(0.0)))


def let(value, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.get(F.transform(F.array(col(value)), body), 0)


def freeze(df: DataFrame) -> DataFrame:
    """Stop filters from being pushed through deep column chains.

    Pushing a predicate below a projection inlines every alias it uses; over a
    chain of shared columns that multiplies the expression. Passing the row
    through a one-element generator keeps each column computed once.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.select(F.explode(F.array(row)).alias("_row")).select("_row.*")
