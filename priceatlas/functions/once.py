"""Values that several expressions read, worked out once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """rows with new columns that later filters read as they are: Spark moves a filter below a projection and works its columns out anew there, but not below a generator."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))
