"""Array to rows without the hidden cost of a plain explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread_array(df: DataFrame, keep: list[str], array: Column | str, name: str, position: str | None = None) -> DataFrame:
    """One row per element, for arrays that are costly to build.

    A plain explode makes Spark test the array's size below the step that builds it, which builds
    the array twice. The outer form adds no such test; the row it gives for an empty array is
    dropped afterwards.
    """
    if position is None:
        out = df.select(*keep, F.explode_outer(array).alias(name))
    else:
        out = df.select(*keep, F.posexplode_outer(array).alias(position, name))
    return out.filter(F.col(name).isNotNull())
