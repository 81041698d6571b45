"""Helpers for Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with ``value`` in the plan and computed once however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns``, each worked out once for a row.

    Filters and projections above name a column that is derived as often as they use it, and the optimizer puts its
    expression there each time; it can't look through a generator, so the columns pass through one of a single row.
    They are made in a projection of their own below it: a generator that isn't compiled with its stage, as none with a
    higher-order function is, interprets its whole expression.
    """
    kept = [c for c in df.columns if c not in columns]
    made = df.select(*kept, F.struct(*[c.alias(name) for name, c in columns.items()]).alias("_made"))
    return made.select(*kept, F.explode(F.array("_made")).alias("_held")).select(*kept, *[F.col("_held")[name].alias(name) for name in columns])
